import random

import numpy as np
import pytest

from staffmatch.llm import simhash_bk
from staffmatch.llm.bktree import Forest
from staffmatch.llm.components import connected_components
from staffmatch.llm.scratch import Scratch
from tests.llm.helpers import awkward_docs, awkward_texts, empty_docs, plain_components, plain_simhash


def test_fingerprints_match_the_plain_version():
    for text in awkward_texts():
        assert simhash_bk.fingerprint(None if text is None else text.encode()) == plain_simhash(text)


def test_forest_finds_exactly_the_pairs_within_the_radius():
    rng = np.random.default_rng(5)
    centres = rng.integers(0, 1 << 63, 6, dtype=np.uint64)
    near = [int(c) ^ sum(1 << int(b) for b in rng.integers(0, 64, rng.integers(0, 4))) for c in centres for _ in range(30)]
    shards = [np.unique(np.array(near[::2], dtype=np.uint64)), np.unique(np.array(near[1::2], dtype=np.uint64))]
    values = np.concatenate(shards)
    roots = np.repeat([0, len(shards[0])], [len(s) for s in shards])
    q, n = Forest(values, roots).within(np.arange(len(values)), 2)
    want = {(i, j) for i in range(len(values)) for j in range(i + 1, len(values))
            if roots[i] == roots[j] and (int(values[i]) ^ int(values[j])).bit_count() <= 2}
    assert set(zip(q.tolist(), n.tolist())) == want and len(q) == len(want)


def test_children_hang_by_their_distance():
    values = np.random.default_rng(1).integers(0, 1 << 63, 500, dtype=np.uint64)
    forest = Forest(values, np.zeros(500, dtype=np.int64))
    hung = forest.parent >= 0
    assert (np.bitwise_count(values[hung] ^ values[forest.parent[hung]]) == forest.edge[hung]).all() and hung.sum() == 499
    assert len({(p, e) for p, e in zip(forest.parent[hung], forest.edge[hung])}) == 499


@pytest.mark.parametrize("limit", [simhash_bk.SHARD_LIMIT, 2])
def test_components_match_brute_force(spark, limit):
    """limit 2 cuts all larger shards again, down to the last level."""
    rng = random.Random(2)
    values = []
    for _ in range(40):
        v = rng.getrandbits(64)
        for _ in range(rng.randint(1, 6)):
            values.append(v)
            v ^= sum(1 << rng.randrange(64) for _ in range(rng.randint(1, 2)))
    values = sorted({v - (1 << 64) if v >> 63 else v for v in values})
    prints = spark.createDataFrame([(v,) for v in values], "fp long")
    edges = simhash_bk.near_edges(prints, Scratch(spark, "test"), limit)
    got = {r["node"]: r["component"] for r in connected_components(edges, Scratch(spark, "test")).collect()}
    want = plain_components(values, lambda a, b: ((a ^ b) & (1 << 64) - 1).bit_count() <= 2)
    assert [got.get(v, v) for v in values] == [values[w] for w in want]


def test_operator_on_awkward_rows(spark):
    docs = awkward_docs(spark, extra=True)
    rows = simhash_bk.near_duplicates(docs).collect()
    texts = awkward_texts()
    prints = [plain_simhash(t) for t in texts]
    want = plain_components(prints, lambda a, b: (a ^ b).bit_count() <= 2)
    assert len(rows) == len(texts) + 2
    for r in rows:
        assert r["fingerprint"] == f"{prints[r['doc_id']]:016x}"
        assert r["component_id"] == want[r["doc_id"]]


def test_null_ids_and_empty_tables(spark):
    rows = simhash_bk.near_duplicates(spark.createDataFrame([(None, "a b c d"), (9, "a b c d"), (None, "x y z q")], "doc_id long, text string")).collect()
    assert sorted((r["doc_id"] or -1, r["component_id"] or -1) for r in rows) == [(-1, -1), (-1, 9), (9, 9)]
    assert simhash_bk.near_duplicates(empty_docs(spark)).count() == 0


def test_long_chain_is_one_component(spark):
    chain = spark.range(1, 200).selectExpr("id AS a", "id - 1 AS b")
    got = connected_components(chain, Scratch(spark, "test")).collect()
    assert len(got) == 200 and {r["component"] for r in got} == {0}


def test_cuts_leave_few_bits_and_cover_every_pair():
    """A pair within two bits agrees in one band of every cut, down to the last level."""
    masks = [0]
    for _ in range(simhash_bk.LEVELS):
        for m in masks:
            cuts = simhash_bk._cuts(m)
            added = [c & ~m for c in cuts]
            assert sum(added) == ~m & (1 << 64) - 1 and all(c & m == m for c in cuts)
        masks = [c for m in masks for c in simhash_bk._cuts(m)]
    assert max((~m & (1 << 64) - 1).bit_count() for m in masks) <= 14
