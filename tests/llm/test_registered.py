"""The registered queries on the smallest tables: against SQL where there is some, else against plain versions."""

import zlib

import numpy as np
import public_tokenizers
import pytest

from checks.compare import compare, connect
from staffmatch.llm import queries as q
from tests.llm.helpers import plain_components, plain_simhash


@pytest.mark.parametrize("name", list(q.SQL))
def test_query_agrees_with_sql(spark, sf, name):
    ok, note = compare(spark, connect(sf), sf, name)
    assert ok, note


def documents(spark, sf):
    return sorted((r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect())


def test_op1(spark, sf):
    docs = documents(spark, sf)
    prints = [plain_simhash(t) for _, t in docs]
    heads = plain_components(prints, lambda a, b: (a ^ b).bit_count() <= 2)
    got = sorted((r["doc_id"], r["fingerprint"], r["component_id"]) for r in q.op1_simhash(spark, sf).collect())
    assert got == [(d, f"{p:016x}", docs[h][0]) for (d, _), p, h in zip(docs, prints, heads)]


def test_op2(spark, sf):
    rows = q.op2_packing(spark, sf).collect()
    assert sum(r["length"] for r in rows) == sum(len(t.encode().split()) for _, t in documents(spark, sf))


@pytest.mark.parametrize("name", ["op3_langid", "op7_toxicity"])
def test_predictions_cover_all_documents_and_name_the_held_out(spark, sf, name):
    rows = q.QUERIES[name](spark, sf).collect()
    assert sorted(r["doc_id"] for r in rows) == [d for d, _ in documents(spark, sf)]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) and 0 <= r["score"] <= 1 for r in rows)


def test_op6(spark, sf):
    from tokenizers import Tokenizer

    tokenizer, want, start = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")), [], 0
    for d, t in documents(spark, sf):
        ids = np.array([*tokenizer.encode(t, add_special_tokens=False).ids, 2], dtype="<u4")
        want.append((d, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    assert sorted(map(tuple, q.op6_tokens(spark, sf).collect())) == want


def test_op10_and_the_names(spark, sf):
    assert q.op10_pieces(spark, sf).count() == len(documents(spark, sf))
    assert [n for n in q.QUERIES if n != "pipeline"] == sorted((n for n in q.QUERIES if n != "pipeline"), key=lambda n: int(n[2:].split("_")[0]))
