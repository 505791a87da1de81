"""The pipeline against plain versions of its stages, each on what its predecessor kept."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as cp
from staffmatch.llm import langid_nb, packing, toxicity_gru
from tests.llm.helpers import awkward_docs, empty_docs, plain_components, plain_repeats, plain_simhash, words_of


@pytest.fixture(scope="module")
def folder(spark, sf, tmp_path_factory):
    """The first documents of the smallest tables, and rows that only some stages notice."""
    path = str(tmp_path_factory.mktemp("small"))
    docs = spark.read.parquet(f"{sf}/documents.parquet").where("doc_id < 120")
    extra = docs.where("doc_id IN (3, 8)").withColumn("doc_id", F.col("doc_id") + 1000).unionByName(
        spark.createDataFrame([(2000, None, "en", "s", 0), (2001, "1 2 3", "en", "s", 5), (None, "the and that of", "en", "s", 5)], docs.schema))
    docs.unionByName(extra).write.parquet(f"{path}/documents.parquet")
    spark.read.parquet(f"{sf}/labels.parquet").write.parquet(f"{path}/labels.parquet")
    return path


def test_run_matches_plain_stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    rows = {r["doc_id"]: r["text"] for r in docs.collect()}
    net = toxicity_gru.fit(docs, spark.read.parquet(f"{folder}/labels.parquet"))
    kept = {r["doc_id"] for r in toxicity_gru.score(docs, net).collect() if r["predicted"] == 0}
    assert 0 < len(kept)
    docs = docs.where(F.col("doc_id").isin([k for k in kept if k is not None]) | F.col("doc_id").isNull())
    found = langid_nb.identify(docs, langid_nb.fit(docs)).collect()
    kept = {r["doc_id"] for r in found if r["lang_pred"] != "und" and r["score"] >= 0.5}
    assert 2000 not in kept and 2001 not in kept and None in kept
    ids = sorted(k for k in kept if k is not None)
    heads = plain_components([plain_simhash(rows[i]) for i in ids], lambda a, b: (a ^ b).bit_count() <= 2)
    stay = [i for n, i in enumerate(ids) if heads[n] == n]
    assert len(stay) < len(ids)
    left = plain_repeats([(i, rows[i]) for i in stay], 13)
    want = {(i, p, min(packing.CAPACITIES[-1], n - p * packing.CAPACITIES[-1]))
            for i, n in [(i, len(left[i][3])) for i in stay] + [(None, len(words_of(rows[None])))]
            for p in range(-(-n // packing.CAPACITIES[-1]))}
    got = cp.run(spark, folder).collect()
    assert {(r["doc_id"], r["part"], r["length"]) for r in got} == want and len(got) == len(want)


def test_every_stage_keeps_columns_and_takes_awkward_and_empty_tables(spark, folder):
    docs = awkward_docs(spark, extra=True)
    for docs_in in (docs, empty_docs(spark)):
        for name, stage in cp.STAGES[:-1]:
            out = stage(spark, docs_in, folder)
            assert out.columns == docs_in.columns, name
            out.collect()
        cp.STAGES[-1][1](spark, docs_in, folder).collect()


def test_near_duplicates_keep_one_row_of_each_group(spark, folder):
    docs = spark.createDataFrame([(4, "a b c d"), (4, "a b c d"), (7, "a b c d"), (9, "x y z w v"), (None, "a b c d")], "doc_id long, text string")
    assert sorted(r["doc_id"] or 0 for r in cp.near_duplicates(spark, docs, folder).collect()) == [0, 4, 9]


def test_texts_under_one_id_all_stay(spark, folder):
    docs = spark.createDataFrame([(4, "a b c d", "en"), (4, "p q r s t", "en"), (4, "a b c d", "de"), (9, "a b c d", "en"), (2, "k l m n", None)],
                                 "doc_id long, text string, lang string")
    rows = [cp.near_duplicates(spark, d, folder).collect() for d in (docs, docs.repartition(5))]
    assert sorted((r["doc_id"], r["text"]) for r in rows[0]) == [(2, "k l m n"), (4, "a b c d"), (4, "p q r s t")]
    assert sorted(map(str, rows[0])) == sorted(map(str, rows[1]))


def test_cut_documents_have_their_new_length(spark, folder):
    passage = " ".join(f"w{i}" for i in range(20))
    docs = spark.createDataFrame([(1, passage, 5), (2, "keep\n\nthis  space", 77), (3, "tail " + passage, 9)], "doc_id long, text string, n_chars int")
    assert sorted(map(tuple, cp.repeated_passages(spark, docs, folder).collect())) == [(1, passage, 5), (2, "keep\n\nthis  space", 77), (3, "tail", 4)]
