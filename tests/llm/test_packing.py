from collections import defaultdict

import numpy as np

from staffmatch.llm import packing
from tests.llm.helpers import awkward_docs, empty_docs, words_of, awkward_texts

SIZES = (16, 64, 256)


def lengths(spark):
    rng = np.random.default_rng(3)
    rows = [(i, int(n)) for i, n in enumerate(rng.geometric(0.02, 500))] + [(900, None), (901, 0), (902, -3), (903, 1000), (904, 256), (7, 5), (7, 5)]
    return spark.createDataFrame(rows, "doc_id long, length long").selectExpr("*", "'x' AS shard", "1 AS bin")


def test_every_piece_is_in_one_bin_without_overlap(spark):
    rows = packing.pack(lengths(spark), SIZES, shard_rows=200).collect()
    want = defaultdict(int)
    for r in lengths(spark).where("length > 0").collect():
        want[r["doc_id"]] += r["length"]
    got, bins = defaultdict(int), defaultdict(list)
    for r in rows:
        got[r["doc_id"]] += r["length"]
        bins[r["shard"], r["bin"]].append(r)
    assert got == want
    for pieces in bins.values():
        pieces.sort(key=lambda r: r["start"])
        assert [p["start"] for p in pieces] == np.cumsum([0] + [p["length"] for p in pieces])[:-1].tolist()
        used = sum(p["length"] for p in pieces)
        assert {p["used"] for p in pieces} == {used}
        assert {p["capacity"] for p in pieces} == {min(c for c in SIZES if c >= used)}


def test_best_fit_takes_the_tightest_bin_and_beats_one_size():
    lens = np.array([200, 60, 60, 56, 40, 16, 10, 6])
    bins, starts, sizes = packing.pack_shard(lens, SIZES)
    assert bins[3] == bins[0]  # 56 fits exactly beside 200
    rng = np.random.default_rng(0)
    many = np.sort(rng.integers(1, 257, 3000))[::-1]
    joint = sum(map(packing.sequence_cost, packing.pack_shard(many, SIZES)[2].tolist()))
    single = sum(map(packing.sequence_cost, packing.pack_shard(many, (256,))[2].tolist()))
    assert joint <= single
    assert joint >= many.sum()  # a word costs at least one


def test_same_result_for_any_partitioning(spark):
    key = lambda df: sorted(map(tuple, df.collect()))
    assert key(packing.pack(lengths(spark).repartition(1), SIZES, 100)) == key(packing.pack(lengths(spark).repartition(7), SIZES, 100))


def test_words_and_empty_tables(spark):
    got = {r["doc_id"]: r["length"] for r in packing.word_lengths(awkward_docs(spark, extra=True)).collect()}
    assert got == {i: len(words_of(t)) for i, t in enumerate(awkward_texts())}
    assert packing.pack(packing.word_lengths(empty_docs(spark))).count() == 0
