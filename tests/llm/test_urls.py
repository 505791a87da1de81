"""Listed and mined URL rules against a plain version that tries every token combination."""

import re
from collections import Counter
from itertools import combinations

import pytest

from staffmatch.llm import url_rules as ur
from staffmatch.llm.scratch import Scratch

SCHEMA = "page_id long, url string"
FOLD = {c: chr(c + 32) for c in range(65, 91)}


def plain_parts(url):
    found = re.search(r"://([^/?#]*)([^?#]*)([^#]*)", url or "")
    host, path, query = found.groups() if found else ("", "", "")
    host = host.translate(FOLD)
    tokens = ["h:" + x for x in reversed(re.findall(r"[^.]+", host))] + ["p:" + x for x in re.findall(r"[^/._-]+", path.translate(FOLD))]
    tokens += ["q:" + x for x in re.findall(r"[?&]([^=&]+)", query)]
    tokens = list(dict.fromkeys(t for t in tokens if not re.fullmatch("[0-9]*", t[2:])))
    fits = [(len(h + s), h + s, v) for h, s, v in ur.LISTED if (host == h or host.endswith("." + h)) and path.startswith(s)]
    return host, path, tokens, max(fits)[1:] if fits else (None, None)


def plain_judge(rows):
    urls = {u: plain_parts(u) for _, u in rows if u is not None}
    labelled = [(t[:ur.MINED_TOKENS], v) for _, _, t, (_, v) in urls.values() if v]
    total, both = Counter(), Counter()
    for tokens, verdict in labelled:
        for n in range(1, len(tokens) + 1):
            for c in combinations(sorted(tokens), n):
                total[c] += 1
                both[c, verdict] += 1
    strong = {k: n / total[k[0]] for k, n in both.items() if n >= ur.LEAST_SUPPORT * len(labelled) and n >= ur.LEAST_CONFIDENCE * total[k[0]]}
    rules = [(conf, both[c, v], len(c), v, " ".join(c), set(c)) for (c, v), conf in strong.items()
             if not any(w == v and len(d) < len(c) and set(d) <= set(c) and other >= conf for (d, w), other in strong.items())]
    out = []
    for page, url in rows:
        host, path, tokens, (rule, verdict) = plain_parts(url)
        best = None if verdict else max((r[:5] for r in rules if r[5] <= set(tokens)), default=None)
        out.append((page, host, path, rule, verdict or (best[3] if best else "allow"), best[4] if best else None))
    return sorted(out, key=repr)


def result(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


AWKWARD = [None, "", "no scheme", "http://", "://", "http://A.Example.NET/en/1", "http://example.net", "http://net/x", "http://xnet/", "http://example.net/EN/",
           "http://a.org/fr/", "http://a.org/fr", "https://h.org/fr/x://y.net/z", "http://h.com/de/?a=1&b=2#c?d=3", "http://sub.example.com/de/9", "http://.net/",
           "http://u.net?x=/en/", "http://u.net#/en/", "http://h\nx.net/en/", "http://Ä.net/Ä/", "http://a.net/" + "x/" * 3000, "ftp://1.2.3.4/5"]


def test_awkward_urls_match_the_plain_version(spark):
    rows = [(i, u) for i, u in enumerate(AWKWARD)] + [(3, "http://b.de/de/1"), (3, "http://b.de/de/1"), (None, "http://b.de/fr/1"), (None, None)]
    frame = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "'x' AS host", "'y' AS verdict", "1 AS items", "2 AS salt", "3 AS mined")
    assert result(ur.judge(frame.repartition(3))) == plain_judge(rows)


@pytest.mark.parametrize("most", [ur.BROADCAST_RULES, 0])
def test_mined_rules_decide_other_urls(spark, most, monkeypatch):
    monkeypatch.setattr(ur, "BROADCAST_RULES", most)  # both ways of joining the index
    kinds = [("shop.example.net", "/en/buy"), ("bet.net", "/fr/win"), ("bet.example.com", "/de/win"), ("news.org", "/fr/read"), ("news.info", "/es/read"),
             ("bet.info", "/es/win"), ("shop.info", "/en/buy"), ("x.info", "/none")]
    rows = [(i, f"http://{h}{p}/{i // 3}{'?ref=a' if i % 2 else ''}") for i in range(160) for h, p in [kinds[i % len(kinds)]]]
    rows += [(1000 + i, "http://bet.info/es/win") for i in range(300)]  # one hot URL
    got = result(ur.judge(spark.createDataFrame(rows, SCHEMA).repartition(4)))
    assert got == plain_judge(rows)
    verdicts = {r[1]: r[4] for r in got if r[3] is None}
    assert verdicts == {"news.info": "allow", "bet.info": "block", "shop.info": "allow", "x.info": "allow"}


def test_no_labelled_url_and_no_rows(spark):
    rows = [(1, "http://a.info/x"), (2, None)]
    assert result(ur.judge(spark.createDataFrame(rows, SCHEMA))) == [(1, "a.info", "/x", None, "allow", None), (2, "", "", None, "allow", None)]
    assert ur.judge(spark.createDataFrame([], SCHEMA)).count() == 0


def test_rules_within_others_are_pruned(spark):
    rows = [(["h:net", "p:a"], "block")] * 8 + [(["h:net", "p:b"], "block")] * 8 + [(["h:org", "p:b", "q:x"], "allow")] * 8
    index = ur.mine(spark.createDataFrame(rows, "items array<string>, verdict string"), Scratch(spark, "test"))
    assert sorted((tuple(r["tokens"]), r["verdict"]) for r in index.collect()) == [
        (("h:net",), "block"), (("h:org",), "allow"), (("p:a",), "block"), (("q:x",), "allow")]


def test_no_python_in_the_plan(spark, sf):
    plan = ur.judge(spark.read.parquet(f"{sf}/pages.parquet"))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "html" not in plan.split("Physical Plan")[1]


def test_too_many_listed_rules_are_refused(spark):
    with pytest.raises(ValueError, match="listed"):
        ur.judge(spark.createDataFrame([(1, "http://a.b/")], SCHEMA), [(f"h{i}", "/", "block") for i in range(1001)])


def test_a_token_behind_the_first_twelve_makes_a_rule(spark):
    long = "/".join("abcdefghijkl")  # other words in every URL, so that none of them is frequent
    rows = [(i, f"http://h{i}.example.net/" + "/".join(f"{c}{i}" for c in long.split("/")) + "/casino") for i in range(80)]
    rows += [(80 + i, f"http://g{i}.example.net/en/" + "/".join(f"{c}{i}" for c in long.split("/"))) for i in range(80)]
    rows.append((900, "http://k.com/casino"))
    got = {r["page_id"]: (r["verdict"], r["evidence"]) for r in ur.judge(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got[900] == ("block", "p:casino")
