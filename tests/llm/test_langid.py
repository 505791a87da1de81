import zlib

import numpy as np

from staffmatch.llm import langid_nb as nb
from tests.llm.helpers import awkward_docs, awkward_texts, empty_docs


def test_ngrams_stay_within_texts():
    joined = list(nb.ngram_buckets(["abc", "", "de", "f"]))
    alone = [list(nb.ngram_buckets([t])) for t in ("abc", "de", "f")]
    for order, (buckets, firsts) in enumerate(joined):
        assert np.diff(firsts).tolist() == [max(0, n - order) for n in (3, 0, 2, 1)]
        assert buckets.tolist() == [b for t in alone if len(t) > order for b in t[order][0].tolist()]


def test_scores_match_a_plain_sum():
    rng = np.random.default_rng(0)
    model = nb.Model(["x", "y"], np.log(rng.dirichlet(np.ones(nb.BUCKETS), 2).T), np.log([0.25, 0.75]))
    names, scores = nb.score_texts(model, ["abca", None, "12 !", "", "é"])
    total = model.log_prior.copy()
    for buckets, _ in nb.ngram_buckets(["abca"]):
        for b in buckets:
            total += model.log_prob[b]
    p = np.exp(total - total.max())
    assert names[0] == model.languages[int(total.argmax())] and np.isclose(scores[0], (p / p.sum()).max())
    assert names[1:4] == ["und"] * 3 and not scores[1:4].any() and names[4] != "und"


def test_held_out_accuracy(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = nb.identify(docs, nb.fit(docs)).collect()
    held = [r for r in rows if zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0]
    assert len(rows) == docs.count() and sum(r["lang"] == r["lang_pred"] for r in held) >= 0.97 * len(held)
    assert all(0 <= r["score"] <= 1 for r in rows)


def test_awkward_rows(spark):
    docs = awkward_docs(spark, extra=True)
    out = nb.identify(docs, nb.fit(docs))
    assert sorted(out.columns) == sorted(docs.columns)
    letters = [t is not None and any(c.isalpha() for c in t) for t in awkward_texts()]
    for r in out.collect():
        assert (r["lang_pred"] == "en") == letters[r["doc_id"]] and r["score"] == (1.0 if letters[r["doc_id"]] else 0.0)
    nothing = nb.fit(empty_docs(spark))
    assert nothing.languages == [] and nb.identify(empty_docs(spark), nothing).count() == 0
    assert {r["lang_pred"] for r in nb.identify(docs, nothing).collect()} == {"und"}
