"""SQL counterparts, for the operators whose results plain SQL can express."""

from __future__ import annotations

# The rules of the quality operator, written down once more for the comparison.
FENCE, SLACK, PRIOR = 3, 25, 50
MEASURES = ("symbol_permille", "dup_line_permille", "repeat_permille", "word_length_permille")
WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

WARC = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
o AS (SELECT h, max(page_id) AS owner FROM p GROUP BY h)
SELECT page_id, strlen(h)::BIGINT AS payload_bytes, sha1(h) AS payload_digest,
    CASE WHEN strlen(h) >= 1000 AND page_id <> owner THEN 'revisit' ELSE 'response' END AS record_type,
    CASE WHEN strlen(h) >= 1000 AND page_id <> owner THEN owner END AS refers_to
FROM p JOIN o USING (h)
"""

SUBSTRING = f"""
WITH w AS (SELECT doc_id, {WORDS} AS ws FROM documents),
starts AS (SELECT doc_id, ws, unnest(range(1, len(ws) - 11)) AS i FROM w),
windows AS (SELECT doc_id, i, array_to_string(list_slice(ws, i, i + 12), ' ') AS k FROM starts),
firsts AS (SELECT k, min(doc_id) AS d FROM windows GROUP BY k),
gone AS (SELECT DISTINCT doc_id, i + unnest(range(0, 13)) AS i FROM windows JOIN firsts USING (k) WHERE d < doc_id),
single AS (SELECT doc_id, unnest(range(1, len(ws) + 1)) AS i, unnest(ws) AS word FROM w),
kept AS (SELECT doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY i) AS t FROM single ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id)
SELECT doc_id, len(ws)::BIGINT AS n_words, (len(ws) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM w LEFT JOIN kept USING (doc_id)
"""

EMBEDDINGS = """
WITH RECURSIVE v AS (
    SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings
    WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS (
    SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
    WHERE list_cosine_similarity(a.e, b.e) >= 0.9),
reach AS (
    SELECT vec_id, vec_id AS other FROM embeddings
    UNION
    SELECT reach.vec_id, links.b FROM reach JOIN links ON reach.other = links.a),
component AS (SELECT vec_id, min(other) AS component_id FROM reach GROUP BY vec_id),
degree AS (SELECT a AS vec_id, count(*) AS n FROM links GROUP BY a)
SELECT vec_id, coalesce(n, 0)::BIGINT AS n_links, component_id, vec_id = component_id AS kept
FROM component LEFT JOIN degree USING (vec_id)
"""


def _quality() -> str:
    power = lambda v: f"(length(bin({v})) - 1)"
    bucket = lambda v: f"CASE WHEN {v} < 64 THEN {v} ELSE ({power(v)} - 4) * 32 + ({v} >> ({power(v)} - 5)) END"
    top = lambda b: (f"CASE WHEN {b} < 64 THEN {b} ELSE "  # noqa: E731
                     f"(({b} - ({b} // 32 - 1) * 32 + 1) << ({b} // 32 - 2)) - 1 END")
    fence = lambda keys: (
        f"SELECT {keys}measure, max(total) AS docs, max({top('q3')} + {FENCE} * ({top('q3')} - {top('q1')} + {SLACK})) AS fence FROM ("
        f"SELECT {keys}measure, max(total) AS total, min(CASE WHEN upto * 4 >= total THEN bucket END) AS q1, "
        f"min(CASE WHEN upto * 4 >= total * 3 THEN bucket END) AS q3 FROM ("
        f"SELECT {keys}measure, bucket, sum(n) OVER (PARTITION BY {keys}measure ORDER BY bucket) AS upto, "
        f"sum(n) OVER (PARTITION BY {keys}measure) AS total FROM ("
        f"SELECT {keys}measure, bucket, count(*) AS n FROM long GROUP BY ALL)) GROUP BY ALL) GROUP BY ALL")
    long = " UNION ALL ".join(f"SELECT lang, source, '{m}' AS measure, {bucket(m)} AS bucket FROM measured WHERE NOT base_failed" for m in MEASURES)
    over = " OR ".join(
        f"coalesce({m} > (SELECT fence FROM limits l WHERE l.measure = '{m}' AND l.lang IS NOT DISTINCT FROM measured.lang "
        f"AND l.source IS NOT DISTINCT FROM measured.source), false)" for m in MEASURES)
    return rf"""
WITH w AS (SELECT doc_id, lang, source, coalesce(text, '') AS t, {WORDS} AS ws FROM documents),
windows AS (SELECT doc_id, unnest(range(1, len(ws) - 3)) AS i, ws FROM w),
grams AS (SELECT doc_id, i, list_slice(ws, i, i + 4) AS g FROM windows),
twice AS (SELECT doc_id, g FROM grams GROUP BY ALL HAVING count(*) > 1),
covered AS (SELECT doc_id, count(*) AS n_repeat FROM (
    SELECT DISTINCT doc_id, i + unnest(range(0, 5)) AS p FROM grams JOIN twice USING (doc_id, g)) GROUP BY doc_id),
lines AS (SELECT doc_id, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup FROM (
    SELECT doc_id, unnest(string_split(t, chr(10))) AS line FROM w) WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY doc_id),
counted AS (SELECT w.doc_id, lang, source, len(ws)::BIGINT AS n_words,
    coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0)::BIGINT AS word_chars,
    length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
    coalesce(n_dup, 0)::BIGINT AS n_dup_lines, coalesce(n_repeat, 0)::BIGINT AS n_repeat_words, coalesce(n_lines, 0) AS n_lines
    FROM w LEFT JOIN covered USING (doc_id) LEFT JOIN lines USING (doc_id)),
measured AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
    coalesce(n_symbols * 1000 // nullif(word_chars, 0), 0)::BIGINT AS symbol_permille,
    coalesce(n_dup_lines * 1000 // nullif(n_lines, 0), 0)::BIGINT AS dup_line_permille,
    coalesce(n_repeat_words * 1000 // nullif(n_words, 0), 0)::BIGINT AS repeat_permille,
    coalesce(word_chars * 1000 // nullif(n_words, 0), 0)::BIGINT AS word_length_permille FROM counted),
long AS ({long}),
own AS ({fence('lang, source, ')}), by_lang AS ({fence('lang, ')}), corpus AS ({fence('')}),
limits AS (SELECT own.lang, own.source, own.measure,
    (own.docs * own.fence + {PRIOR} * ((by_lang.docs * by_lang.fence + {PRIOR} * corpus.fence) // (by_lang.docs + {PRIOR})))
        // (own.docs + {PRIOR}) AS fence
    FROM own JOIN by_lang ON own.lang IS NOT DISTINCT FROM by_lang.lang AND own.measure = by_lang.measure
    JOIN corpus ON own.measure = corpus.measure)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND NOT ({over}) AS kept
FROM measured
"""

DIVERGENCE = r"""
WITH d AS (SELECT row_number() OVER () AS id, coalesce(text, '') AS t, coalesce(lang, '') AS lang, coalesce(source, '') AS source FROM documents),
tokens AS (SELECT id, lang, source, translate(unnest(regexp_extract_all(t, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS term FROM d),
kept AS (SELECT lang, term FROM tokens GROUP BY ALL HAVING count(DISTINCT id) >= 10),
vocabulary AS (SELECT lang, count(*) AS v FROM kept GROUP BY lang),
found AS (SELECT lang, source, term, count(*) AS n FROM tokens JOIN kept USING (lang, term) GROUP BY ALL),
occurring AS (SELECT DISTINCT lang, source FROM d),
counts AS (SELECT lang, source, term, v, coalesce(n, 0)::HUGEINT AS n
    FROM occurring JOIN kept USING (lang) JOIN vocabulary USING (lang) LEFT JOIN found USING (lang, source, term)),
p AS MATERIALIZED (SELECT *, (1 + 1000000000::HUGEINT * (n + 2) // (sum(n) OVER (PARTITION BY lang, source) + 2 * v))::BIGINT AS p FROM counts),
whole AS (SELECT lang, term, any_value(v) AS v, sum(n) AS n FROM counts GROUP BY ALL),
q AS (SELECT lang, term, (1 + 1000000000::HUGEINT * (n + 2) // (sum(n) OVER (PARTITION BY lang) + 2 * v))::BIGINT AS q FROM whole),
pairs AS (SELECT a.lang, a.source, b.source AS item, coalesce(s, 0)::BIGINT AS value
    FROM occurring a JOIN occurring b ON a.lang = b.lang AND a.source <> b.source
    LEFT JOIN (SELECT x.lang, x.source AS source, y.source AS item, sum((x.p - y.p) * (x.p - y.p) // (x.p + y.p)) AS s
        FROM p x JOIN p y ON x.lang = y.lang AND x.term = y.term AND x.source <> y.source GROUP BY ALL) t
    ON t.lang = a.lang AND t.source = a.source AND t.item = b.source),
terms AS (SELECT lang, source, term AS item, (p - q) * (p - q) // (p + q) AS value FROM p JOIN q USING (lang, term) WHERE n > 0 AND p > q),
ranked AS (
    SELECT lang, source, 'pair' AS part, item, value, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) AS rank FROM pairs
    UNION ALL
    SELECT lang, source, 'term', item, value, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) FROM terms)
SELECT lang, source, part, item, value::BIGINT AS value, rank::INTEGER AS rank FROM ranked WHERE part = 'pair' OR rank <= 10
"""

URLS = r"""
WITH u AS (SELECT DISTINCT url FROM pages WHERE url IS NOT NULL),
split AS (SELECT url, translate(regexp_extract(url, '://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(url, '://[^/?#]*([^?#]*)', 1) AS path, regexp_extract(url, '://[^/?#]*[^?#]*([^#]*)', 1) AS query FROM u),
rules AS (SELECT * FROM (VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')) AS t(h, s, v)),
fitting AS (SELECT url, arg_max(h || s, length(h || s)) AS rule, arg_max(v, length(h || s)) AS listed
    FROM split JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, s) GROUP BY url),
words AS (SELECT url, host, path, [x FOR x IN list_concat(
        ['h:' || w FOR w IN list_reverse(regexp_extract_all(host, '[^.]+'))],
        ['p:' || w FOR w IN regexp_extract_all(translate(path, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^/._-]+')],
        ['q:' || w FOR w IN regexp_extract_all(query, '[?&]([^=&]+)', 1)])
    IF NOT regexp_matches(x, '^.:[0-9]*$')] AS w FROM split),
items AS (SELECT url, host, path, rule, listed, [w[i] FOR i IN range(1, len(w) + 1) IF list_position(w, w[i]) = i] AS items
    FROM words LEFT JOIN fitting USING (url)),
baskets AS (SELECT listed, list_slice(items, 1, 12) AS items FROM items WHERE listed IS NOT NULL),
subsets AS (SELECT listed, list_sort([items[i] FOR i IN range(1, len(items) + 1) IF (m >> (i - 1)) & 1 = 1]) AS s
    FROM (SELECT *, unnest(range(1, 1 << len(items))) AS m FROM baskets)),
counted AS (SELECT *, sum(hits) OVER (PARTITION BY s) AS n FROM (SELECT s, listed, count(*) AS hits FROM subsets GROUP BY ALL)),
strong AS MATERIALIZED (SELECT s, listed, hits::DOUBLE / n::DOUBLE AS confidence, hits FROM counted
    WHERE hits * 64 >= (SELECT count(*) FROM baskets) AND hits * 8 >= n * 7),
mined AS MATERIALIZED (SELECT * FROM strong a WHERE NOT EXISTS (SELECT 1 FROM strong b WHERE b.listed = a.listed AND len(b.s) < len(a.s)
    AND list_has_all(a.s, b.s) AND b.confidence >= a.confidence)),
best AS (SELECT url, mined.listed AS verdict, array_to_string(s, ' ') AS evidence FROM items JOIN mined ON items.listed IS NULL AND list_has_all(items.items, s)
    QUALIFY row_number() OVER (PARTITION BY url ORDER BY confidence DESC, hits DESC, len(s) DESC, mined.listed DESC, array_to_string(s, ' ') DESC) = 1)
SELECT page_id, coalesce(host, '') AS host, coalesce(path, '') AS path, rule, coalesce(listed, verdict, 'allow') AS verdict, evidence
FROM pages LEFT JOIN items USING (url) LEFT JOIN best USING (url)
"""


def _codes() -> str:
    distance = "list_sum([(v[i] - e[i]) * (v[i] - e[i]) FOR i IN range(1, len(v) + 1)])"
    rounds = []
    for r in range(7):
        rounds.append(f"""near{r} AS MATERIALIZED (SELECT id, k.part, entry, {distance} AS gap, v FROM cut JOIN book{r} k ON cut.part = k.part
    QUALIFY row_number() OVER (PARTITION BY id, k.part ORDER BY gap, entry) = 1)""")
        if r < 6:
            rounds.append(f"""book{r + 1} AS MATERIALIZED (SELECT part, entry, coalesce(m, e) AS e FROM book{r} LEFT JOIN (
    SELECT part, entry, list((t - ((t % n) + n) % n) // n ORDER BY i) AS m FROM (
        SELECT part, entry, i, sum(x)::BIGINT AS t, count(*) AS n FROM (
            SELECT part, entry, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM near{r}) GROUP BY ALL) GROUP BY ALL) USING (part, entry))""")
    return """
WITH usable AS (SELECT row_number() OVER (ORDER BY vec_id) AS id, vec_id, label, [floor(4096 * x::DOUBLE)::BIGINT FOR x IN embedding] AS ints
    FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
cut AS MATERIALIZED (SELECT id, p AS part, list_slice(ints, p * len(ints) // 8 + 1, (p + 1) * len(ints) // 8) AS v
    FROM usable, (SELECT unnest(range(8)) AS p)),
book0 AS (SELECT part, id - 1 AS entry, v AS e FROM cut WHERE id <= 16),
""" + ",\n".join(rounds) + """,
digest AS (SELECT sha256(string_agg(array_to_string(e, ','), ',' ORDER BY part, entry)) AS codebooks_sha256 FROM book6),
coded AS (SELECT id, string_agg(printf('%02x', entry), '' ORDER BY part) AS code, sum(gap)::BIGINT AS error FROM near6 GROUP BY id)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256
FROM usable JOIN coded USING (id), digest
"""


SQL = {"op4_warc": WARC, "op5_substring": SUBSTRING, "op8_embeddings": EMBEDDINGS, "op9_quality": _quality(),
       "op11_divergence": DIVERGENCE, "op12_urls": URLS, "op13_codes": _codes()}
