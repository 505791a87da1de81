"""The audit against a plain version with Python's integers, and the skyband against all pairs."""

import random
import re
from collections import Counter, defaultdict

import pytest

from staffmatch.llm import divergence as dv
from tests.llm.helpers import DOC_SCHEMA, awkward_docs, empty_docs, prose, vocabulary


def plain(rows, least, top):
    rows = [tuple(x or "" for x in r) for r in rows]
    fold = {c: chr(c + 32) for c in range(65, 91)}
    docs = [(lang, source, re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", text.translate(fold))) for lang, source, text in rows]
    out = []
    for lang in {d[0] for d in docs}:
        seen = Counter(t for x, _, ts in docs if x == lang for t in set(ts))
        kept = sorted(t for t, n in seen.items() if n >= least)
        counts = {s: Counter(t for x, y, ts in docs if (x, y) == (lang, s) for t in ts if seen[t] >= least) for x, s, _ in docs if x == lang}
        whole = sum(counts.values(), Counter())

        def weights(c):
            total = sum(c.values()) + 2 * len(kept)
            return {t: 1 + 10**9 * (c[t] + 2) // total for t in kept}

        q, ps = weights(whole), {s: weights(c) for s, c in counts.items()}
        f = lambda a, b: (a - b) ** 2 // (a + b)
        for s, p in ps.items():
            pairs = [(-sum(f(p[t], ps[o][t]) for t in kept), o.encode(), o) for o in ps if o != s]
            terms = [(-f(p[t], q[t]), t.encode(), t) for t in kept if counts[s][t] and p[t] > q[t]]
            for part, items in (("pair", sorted(pairs)), ("term", sorted(terms)[:top])):
                out += [(lang, s, part, name, -v, rank) for rank, (v, _, name) in enumerate(items, 1)]
    return sorted(out)


def result(df):
    return sorted(tuple(r) for r in df.select("lang", "source", "part", "item", "value", "rank").collect())


def triples(docs):
    return [(r["lang"], r["source"], r["text"]) for r in docs.collect()]


@pytest.mark.parametrize("least", [1, 2, 10])
def test_awkward_rows_match_the_plain_version(spark, least, monkeypatch):
    monkeypatch.setattr(dv, "LEAST_DOCS", least)
    docs = awkward_docs(spark, extra=True)
    assert result(dv.divergence(docs)) == plain(triples(docs), least, dv.TOP)


def test_a_hot_source_and_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(dv, "LEAST_DOCS", 3)
    monkeypatch.setattr(dv, "BLOCK_CELLS", 64)
    rng = random.Random(5)
    words = vocabulary(9, 150) + ["ÄRGER", "Zoë", "日本"]
    rows = [(i, prose(rng, words[:80 + i % 70], rng.randint(0, 60)), "en" if i % 4 else "de", f"s{0 if i % 3 == 0 else i % 7}", 0) for i in range(120)]
    docs = spark.createDataFrame(rows, DOC_SCHEMA).repartition(7)
    assert result(dv.divergence(docs)) == plain(triples(docs), 3, dv.TOP)


def test_no_kept_term_leaves_pairs_of_nothing(spark):
    docs = spark.createDataFrame([(1, "one", "en", "a", 3), (2, "", "en", "b", 0), (3, "1 2 3", None, None, 5)], DOC_SCHEMA)
    assert result(dv.divergence(docs)) == [("en", "a", "pair", "b", 0, 1), ("en", "b", "pair", "a", 0, 1)]
    assert dv.divergence(empty_docs(spark)).count() == 0


def test_skyband_holds_exactly_what_fewer_than_k_dominate(spark):
    rng = random.Random(8)
    rows = [("en", f"s{g}", "".join(rng.choice("abcdeé") for _ in range(6)) + str(i), rng.randint(1, 12), rng.randint(12, 40))
            for g in range(2) for i in range(700)]
    frame = spark.createDataFrame(rows, "lang string, source string, term string, n long, lang_n long").repartition(5)
    for k in (1, 3, 10):
        got = sorted((r["source"], r["term"]) for r in dv.skybands(frame, k).collect())
        groups = defaultdict(list)
        for _, s, t, n, m in rows:
            groups[s].append((t.encode(), n, m, t))
        want = [(s, b[3]) for s, g in groups.items() for b in g
                if sum(a[1] >= b[1] and a[2] <= b[2] and a[0] < b[0] for a in g) < k]
        assert got == sorted(want)
