import random

import pytest

from staffmatch.llm import debruijn
from staffmatch.llm.debruijn import remove_repeats
from tests.llm.helpers import awkward_docs, awkward_texts, empty_docs, plain_repeats


@pytest.mark.parametrize("seed", [1, 2])
def test_random_small_vocabulary_matches_brute_force(spark, seed):
    """Few words: paths branch, join and repeat within documents."""
    rng = random.Random(seed)
    texts = []
    for _ in range(60):
        words = [rng.choice("ab") for _ in range(rng.randint(0, 60))]
        if texts and rng.random() < 0.6:
            other = rng.choice(texts).split()
            a = rng.randint(0, max(len(other) - 1, 0))
            words[rng.randint(0, len(words)):0] = other[a:a + rng.randint(5, 40)]
        texts.append(" ".join(words))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    want = plain_repeats(list(enumerate(texts)), 13)
    rows = remove_repeats(docs).collect()
    assert len(rows) == len(texts)
    for r in rows:
        n, gone, digest, kept = want[r["doc_id"]]
        assert (r["n_words"], r["n_removed"], r["kept_sha256"]) == (n, gone, digest)
        assert r["text"] == (b" ".join(kept).decode() if gone else texts[r["doc_id"]])


def test_awkward_rows(spark):
    texts = awkward_texts()
    docs = awkward_docs(spark, extra=True)
    want = plain_repeats(list(enumerate(texts)), 13)
    out = remove_repeats(docs)
    assert set(docs.columns) - set(out.columns) == {"checks"}
    rows = out.collect()
    assert len(rows) == len(texts) + 2
    for r in rows:
        assert (r["n_words"], r["n_removed"], r["kept_sha256"]) == want[r["doc_id"]][:3]
        assert r["class"] == "other"


def test_null_ids_are_left_alone(spark):
    passage = " ".join(f"w{i}" for i in range(40))
    rows = remove_repeats(spark.createDataFrame([(1, passage), (None, passage), (3, "z " + passage)], "doc_id long, text string")).collect()
    assert sorted((r["doc_id"] or 0, r["n_removed"]) for r in rows) == [(0, 0), (1, 0), (3, 40)]
    assert remove_repeats(empty_docs(spark)).count() == 0


def test_texts_under_one_id_are_documents_of_their_own(spark):
    passage, other = (" ".join(f"{c}{i}" for i in range(40)) for c in "wv")
    rows = [(1, passage), (2, passage + " x"), (2, "y " + passage), (2, passage + " x"), (-(1 << 62), other), (2, other), (3, "z " + passage),
            (5, " ".join(f"u{i}" for i in range(20))), (5, "more " + " ".join(f"u{i}" for i in range(20))), (7, " ".join(f"u{i}" for i in range(20))), (2, None), (2, "")]
    got = sorted((r["doc_id"], r["text"] or "", r["n_removed"]) for r in remove_repeats(
        spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect())
    u = " ".join(f"u{i}" for i in range(20))
    assert got == sorted([(1, passage, 0), (2, "x", 40), (2, "y", 40), (2, "x", 40), (-(1 << 62), other, 0), (2, "", 40), (3, "z", 40),
                          (5, u, 0), (5, "more " + u, 0), (7, "", 20), (2, "", 0), (2, "", 0)])


def test_random_texts_under_few_ids_match_brute_force(spark):
    rng = random.Random(9)
    rows = [(rng.randint(0, 6), " ".join(rng.choice("ab") for _ in range(rng.randint(0, 40)))) for _ in range(40)]
    k, first = 13, {}
    for doc, text in rows:
        words = text.split()
        for i in range(len(words) - k + 1):
            key = tuple(words[i:i + k])
            first[key] = min(first.get(key, doc), doc)
    want = []
    for doc, text in rows:
        words = text.split()
        gone = {j for i in range(len(words) - k + 1) if first[tuple(words[i:i + k])] < doc for j in range(i, i + k)}
        want.append((doc, len(words), len(gone), " ".join(w for j, w in enumerate(words) if j not in gone) if gone else text))
    out = remove_repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    assert sorted((r["doc_id"], r["n_words"], r["n_removed"], r["text"]) for r in out) == sorted(want)


def test_a_hash_collision_is_found_and_mended(spark, monkeypatch):
    """Under the first seed the two words that differ have one hash; the digests tell, and the next seed is right."""
    whole = debruijn.xxhash.xxh64_intdigest

    class Weak:
        @staticmethod
        def xxh64_intdigest(word, seed):
            return whole(b"same" if seed == 1 and word in (b"left", b"right") else word, seed)

    monkeypatch.setattr(debruijn, "xxhash", Weak)
    head = " ".join(f"w{i}" for i in range(20))
    docs = [(1, f"{head} left {head} end"), (2, f"{head} right {head} tail")]
    rows = remove_repeats(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    want = plain_repeats(docs, 13)
    assert {r["doc_id"]: r["n_removed"] for r in rows} == {d: w[1] for d, w in want.items()} == {1: 0, 2: 40}
