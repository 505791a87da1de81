import random
import re
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from staffmatch.llm import quality_adaptive as q
from staffmatch.llm.scratch import Scratch
from tests.llm.helpers import awkward_docs, awkward_texts, empty_docs

HARD = ["a b c d e a b c d e", "a b c d e f a b c d e f", "x\nx\n\nx \nx\n", "\n\n  \n", "# a\n# a\n", "é é é\n日本\n日本", "a a a a a a a", "w\r\nw\r\nw", "no end\nno end"]


def plain(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    grams = Counter(tuple(words[i:i + 5]) for i in range(len(words) - 4))
    covered = {j for i in range(len(words) - 4) if grams[tuple(words[i:i + 5])] > 1 for j in range(i, i + 5)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered), len(lines))


def test_measures_match_the_plain_version(spark):
    texts = HARD + awkward_texts()
    docs = spark.createDataFrame([(i, t, "en", "s") for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string")
    for r in q.document_measures(docs.repartition(3)).collect():
        n, chars, symbols, dup, repeat, lines = plain(texts[r["doc_id"]])
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == (n, chars, symbols, dup, repeat)
        assert r["base_failed"] == (n < 10 or 100 * repeat > 20 * n)
        assert r["dup_line_permille"] == (dup * 1000 // lines if lines else 0)


def test_buckets_hold_their_values_within_a_32nd(spark):
    values = [*range(300), 1023, 1024, 1025, 65_535, 65_536, 10**9, 2**40 + 12345]
    rows = spark.createDataFrame([(v,) for v in values], "v long").select("v", q.bucket(F.col("v")).alias("b")).withColumn("top", q.bucket_top(F.col("b"))).collect()
    rows.sort(key=lambda r: r["v"])
    assert all(r["v"] <= r["top"] <= r["v"] * (1 + 1 / 32) for r in rows)
    assert [r["b"] for r in rows] == sorted(r["b"] for r in rows)


def test_sketches_merge_to_the_same_fences(spark, sf):
    measures = q.document_measures(spark.read.parquet(f"{sf}/documents.parquet"))
    whole = q.sketches(measures)
    parts = q.sketches(measures.where("doc_id % 3 = 0")).unionByName(q.sketches(measures.where("doc_id % 3 <> 0")))
    rows = lambda s: sorted(map(tuple, q.fences(s, ["lang"]).collect()))
    assert rows(whole) == rows(parts)
    # The fences are those of the exact quartiles, up to the width of a bucket.
    exact = defaultdict(list)
    for r in measures.where("NOT base_failed").collect():
        for m in q.MEASURES:
            exact[r["lang"], m].append(r[m])
    for lang, measure, docs, fence in rows(whole):
        v = sorted(exact[lang, measure])
        q1, q3 = v[-(-len(v) // 4) - 1], v[-(-3 * len(v) // 4) - 1]
        assert docs == len(v) and abs(fence - (q3 + q.FENCE * (q3 - q1 + q.SLACK))) <= (q3 * 4 + q1 * 3) / 32 + 1


def test_groups_lean_on_their_parents_by_their_size(spark):
    """Plain quartiles and the plain mean: each source's fence lies between its own and its language's."""
    rng = random.Random(4)
    rows = []
    for lang, source, n, marks in (("en", "calm", 400, 0), ("en", "noisy", 300, 6), ("en", "tiny", 3, 9), ("de", "only", 5, 2), (None, None, 2, 4)):
        for i in range(n):
            words = ["word"] * 30 + ["#" * rng.randint(1, 3)] * rng.randint(0, marks)
            rows.append((len(rows), " ".join(f"{w}{j}" for j, w in enumerate(words)), lang, source))
    measures = q.document_measures(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string"))
    table = [r for r in measures.collect() if not r["base_failed"]]
    top = lambda v: next(r[0] for r in spark.range(1).select(q.bucket_top(q.bucket(F.lit(v).cast("long")))).collect())

    def fence(picked):
        v = sorted(r["symbol_permille"] for r in picked)
        q1, q3 = top(v[-(-len(v) // 4) - 1]), top(v[-(-3 * len(v) // 4) - 1])
        return q3 + q.FENCE * (q3 - q1 + q.SLACK)

    corpus = fence(table)
    for r in q.thresholds(measures).collect():
        of_lang = [x for x in table if x["lang"] == r["lang"]]
        own = [x for x in of_lang if x["source"] == r["source"]]
        around = (len(of_lang) * fence(of_lang) + 50 * corpus) // (len(of_lang) + 50)
        assert r["symbol_permille_fence"] == (len(own) * fence(own) + 50 * around) // (len(own) + 50)
    kept = {r["doc_id"]: r["kept"] for r in q.apply_rules(measures, q.thresholds(measures)).collect()}
    assert len(kept) == len(rows) and any(kept.values())


def test_an_outlier_among_clean_documents_goes(spark):
    clean = "one two three four five six seven eight nine ten eleven"
    rows = [(i, clean + f" w{i}", "en", "s") for i in range(40)] + [(100, "## ## ## ## ## ## ### #### ##### ###### #######", "en", "s"), (101, clean, None, None)]
    out = {r["doc_id"]: r["kept"] for r in q.quality(
        spark.createDataFrame(rows, "doc_id long, text string, lang string, source string"), Scratch(spark, "test")).collect()}
    assert not out.pop(100) and all(out.values())


def test_awkward_rows(spark):
    docs = awkward_docs(spark, extra=True)
    rows = q.quality(docs, Scratch(spark, "test")).collect()
    assert len(rows) == len(awkward_texts()) + 2 and all(isinstance(r["kept"], bool) and isinstance(r["base_failed"], bool) for r in rows)
    assert not any(r["kept"] for r in rows if r["base_failed"])
    assert q.quality(empty_docs(spark), Scratch(spark, "test")).count() == 0
