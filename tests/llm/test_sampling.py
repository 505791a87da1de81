"""Bounded samples at any size."""

from staffmatch.llm import sampling


def test_the_share_never_falls_to_zero():
    for total in (10**9, 10**12, 10**15):
        for most in (400, 1500, 20_000):
            share = sampling.hash_limit(most, total) / (1 << sampling.HASH_BITS)
            assert abs(share * total / most - 1) < 0.01


def test_a_faked_count_of_a_billion_takes_its_share(spark, monkeypatch):
    """A table that says it has 10^9 rows: of 20,000 real ones the same share is taken."""
    rows = spark.range(20_000).withColumnRenamed("id", "doc_id")
    monkeypatch.setattr(type(rows), "count", lambda self: 10**9)
    sample = sampling.bounded_sample(rows, "doc_id", 10**8)
    monkeypatch.undo()
    assert 1800 < sample.count() < 2200
    small = sampling.bounded_sample(rows, "doc_id", 500)
    assert 400 < small.count() < 600 and small.exceptAll(rows).count() == 0
    assert sampling.bounded_sample(rows, "doc_id", 20_000).count() == 20_000
