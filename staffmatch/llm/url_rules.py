"""URL filtering by listed rules and, where none fits, by association rules mined with FP-growth.

The listed rules label the URLs that they decide. Spark's FP-growth mines these URLs' tokens with the label as one more
token; rules that conclude a label are pruned by support, by confidence, and where a shorter rule within them is at
least as confident. An inverted index holds every rule under its rarest token: a URL's tokens find their rules by an
equi-join, and only those found are compared in full.

Everything is DataFrame work; no Python runs on the executors.
"""

from __future__ import annotations

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from staffmatch.llm.scratch import Scratch

#: (host, path, verdict); a rule fits its host and all subdomains where the path starts with the rule's.
LISTED = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]
#: Share of the labelled URLs that hold all tokens of a rule and its verdict.
LEAST_SUPPORT = 1 / 64
LEAST_CONFIDENCE = 7 / 8
#: Tokens of a labelled URL that mining looks at: all, as matching does.
MINED_TOKENS = None
#: Listed rules become one expression of a plan.
MOST_LISTED = 1000
#: Mined rules up to so many are broadcast; beyond it the index is joined by a shuffle.
BROADCAST_RULES = 20_000
SALTS = 16

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BLOCK, ALLOW = "block", "allow"


def _part(url: Column, number: int) -> Column:
    return F.coalesce(F.regexp_extract(url, r"://([^/?#]*)([^?#]*)([^#]*)", number), F.lit(""))


def url_host(url: Column) -> Column:
    return F.translate(_part(url, 1), UPPER, LOWER)


def url_path(url: Column) -> Column:
    return _part(url, 2)


def url_tokens(url: Column) -> Column:
    """Distinct tokens: host labels from the right (`h:`), words of the path (`p:`), names of the query (`q:`).

    Words of digits only name a page rather than a kind of pages and are left out.
    """
    def found(text: Column, pattern: str, kind: str) -> Column:
        words = F.filter(F.regexp_extract_all(text, F.lit(pattern), F.lit(1)), lambda x: ~x.rlike("^[0-9]*$"))
        return F.transform(words, lambda x: F.concat(F.lit(kind), x))

    path = F.translate(url_path(url), UPPER, LOWER)
    return F.array_distinct(F.concat(
        F.reverse(found(url_host(url), r"([^.]+)", "h:")), found(path, r"([^/._-]+)", "p:"), found(_part(url, 3), r"[?&]([^=&]+)", "q:")))


def listed_rule(host: Column, path: Column, listed=LISTED) -> tuple[Column, Column]:
    """The longest listed rule that fits and its verdict, null where none does."""
    if len(listed) > MOST_LISTED:
        raise ValueError(f"{len(listed)} listed rules; at most {MOST_LISTED} fit in one expression")
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for name, start, what in sorted(listed, key=lambda r: (len(r[0] + r[1]), r)):
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(start)
        rule, verdict = F.when(fits, F.lit(name + start)).otherwise(rule), F.when(fits, F.lit(what)).otherwise(verdict)
    return rule, verdict


def _indexed(rules: DataFrame, supports: DataFrame) -> DataFrame:
    """The rules with the rarest of their tokens, which is their key in the index."""
    rarest = (rules.select("tokens", F.explode("tokens").alias("token")).distinct().join(supports, "token")
              .groupBy("tokens").agg(F.min(F.struct("freq", "token")).alias("r")).select("tokens", F.col("r.token").alias("key")))
    return rules.join(rarest, "tokens")


def _hits(sets: DataFrame, index: DataFrame) -> DataFrame:
    """Rows of `sets` (with `items`) beside every rule of the index all of whose tokens they hold."""
    return (sets.withColumn("key", F.explode("items")).join(index, "key")
            .where(F.size(F.array_except("tokens", "items")) == 0).drop("key"))


def mine(labelled: DataFrame, scratch: Scratch, support: float = LEAST_SUPPORT, confidence: float = LEAST_CONFIDENCE) -> DataFrame:
    """Index of mined rules (key, tokens, verdict, confidence, support) from (items, verdict) rows."""
    baskets = labelled.select(F.array_append("items", F.concat(F.lit("verdict:"), "verdict")).alias("items"))
    model = FPGrowth(itemsCol="items", minSupport=support, minConfidence=confidence).fit(baskets)
    supports = scratch.store(model.freqItemsets.where(F.size("items") == 1).select(
        F.get("items", F.lit(0)).alias("token"), "freq"), "supports")
    said = F.get("consequent", F.lit(0))
    rules = scratch.store(model.associationRules.where(said.startswith("verdict:")).select(
        F.sort_array("antecedent").alias("tokens"), F.substring(said, 9, 1 << 20).alias("verdict"), "confidence", "support"), "rules")
    index = scratch.store(_indexed(rules, supports), "index")
    inner = index.select("key", "tokens", F.col("verdict").alias("v"), F.col("confidence").alias("c"))
    outer = index.select(F.col("tokens").alias("items"), "verdict", "confidence")
    needless = _hits(outer, inner).where(
        "size(tokens) < size(items) AND v = verdict AND c >= confidence").select(F.col("items").alias("tokens"), "verdict").distinct()
    return scratch.store(index.join(needless, ["tokens", "verdict"], "left_anti"), "pruned")


def judge(pages: DataFrame, listed=LISTED, scratch: Scratch | None = None) -> DataFrame:
    """(page_id, host, path, rule, verdict, evidence) per row of `pages` (page_id, url).

    A listed rule decides where one fits; else the mined rule of highest confidence, then support, then most tokens, then
    `block` before `allow`, then the last tokens in UTF-8, which `evidence` names; else the URL is allowed. A URL is
    mined once, however many pages have it. URLs that are null or without `://` have an empty host and path, no tokens
    and are allowed. Repeated rows and null ids come out once each; without labelled URLs nothing is mined. Other columns are
    ignored.
    """
    spark = pages.sparkSession
    scratch = scratch or Scratch(spark, "urls")
    host, path = url_host(F.col("url")), url_path(F.col("url"))
    rule, verdict = listed_rule(F.col("host"), F.col("path"), listed)
    urls = scratch.store(
        pages.where("url IS NOT NULL").select("url").distinct().select("url", host.alias("host"), path.alias("path"), url_tokens(F.col("url")).alias("items"))
        .select("url", "items", verdict.alias("verdict")), "urls")
    index = mine(urls.where("verdict IS NOT NULL").select("items", "verdict"), scratch)
    if index.count() <= BROADCAST_RULES:
        index = F.broadcast(index)
    strength = F.struct("confidence", "support", F.size("tokens").alias("n"), "v", F.array_join("tokens", " ").alias("evidence"))
    mined = scratch.store(
        _hits(urls.where("verdict IS NULL").select("url", "items"), index.withColumnRenamed("verdict", "v"))
        .groupBy("url").agg(F.max(strength).alias("best")).select("url", F.col("best.v").alias("mined"), "best.evidence"), "mined")

    rows = pages.select("page_id", "url", host.alias("host"), path.alias("path")).select("*", rule.alias("rule"), verdict.alias("verdict"))
    open_ = F.col("rule").isNull() & F.col("url").isNotNull()
    # A URL may stand on very many pages: its copies are shared out. The copied side is larger than its files tell, so
    # it is not left to a broadcast.
    salted = rows.where(open_).withColumn("salt", F.pmod(F.xxhash64("page_id"), F.lit(SALTS)))
    copies = mined.withColumn("salt", F.explode(F.expr(f"sequence(0L, {SALTS - 1}L)")))
    judged = salted.join(copies.hint("merge"), ["url", "salt"], "left").select(
        "page_id", "host", "path", "rule", F.coalesce("mined", F.lit(ALLOW)).alias("verdict"), "evidence")
    decided = rows.where(~open_).select(
        "page_id", "host", "path", "rule", F.coalesce("verdict", F.lit(ALLOW)).alias("verdict"), F.lit(None).cast("string").alias("evidence"))
    return decided.unionByName(judged)
