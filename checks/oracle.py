"""The registered queries as plain SQL for an independent engine.

Texts are assembled from named common table expressions; each query lists only those it needs.
"""

from __future__ import annotations

import re

CTES: dict[str, str] = {}

CTES["people"] = """
SELECT c_custkey AS k, concat('EMP', lpad(CAST(c_custkey AS VARCHAR), 12, '0')) AS employee_id,
       c_name AS employee_name, c_mktsegment AS domain, c_nationkey,
       CAST(1 + (c_custkey*5)%12 AS DOUBLE) AS domain_experience_years,
       CAST(3 + (c_custkey*7)%18 AS DOUBLE) AS total_experience_years,
       CAST(((c_custkey*13)%21)*5 AS DOUBLE) AS current_bandwidth_percent,
       c_acctbal
FROM customer"""

CTES["employee_skill"] = """
SELECT p.*,
       (l_orderkey*8 + l_linenumber)*1048576
         + (l_partkey*7919 + l_suppkey*104729 + CAST(l_quantity AS BIGINT)*15485863)%1048573 AS row_seq,
       CASE l_suppkey%41 WHEN 0 THEN '' WHEN 1 THEN '  ' WHEN 2 THEN concat(' ', p_brand, '  ') WHEN 3 THEN upper(p_brand)
            ELSE p_brand END AS skill,
       CASE WHEN l_suppkey%7 <> 6 THEN p_type END AS skill_category,
       CAST(1 + CAST(l_quantity AS BIGINT)%12 AS DOUBLE) + CASE WHEN l_suppkey%5 = 4 THEN 0.5 ELSE 0 END AS skill_experience_years
FROM lineitem JOIN orders ON l_orderkey = o_orderkey
JOIN part ON l_partkey = p_partkey
JOIN people p ON o_custkey = p.k"""

CTES["summaries"] = """
SELECT k, text AS past_project_execution_summary
FROM people LEFT JOIN documents ON doc_id = k % (SELECT count(*) FROM documents)"""

CTES["header"] = """
SELECT k, employee_id, arg_min(employee_name, row_seq) AS employee_name, arg_min(domain, row_seq) AS domain,
       arg_min(domain_experience_years, row_seq) AS domain_experience_years,
       arg_min(total_experience_years, row_seq) AS total_experience_years,
       arg_min(current_bandwidth_percent, row_seq) AS current_bandwidth_percent
FROM employee_skill GROUP BY k, employee_id"""

CTES["skill_last"] = """
SELECT employee_id, lower(trim(skill)) AS skill_key, arg_max(skill_experience_years, row_seq) AS years
FROM employee_skill WHERE skill <> '' GROUP BY 1, 2"""

def _number(value: str) -> str:
    return f"CASE WHEN {value} = floor({value}) THEN CAST(CAST({value} AS BIGINT) AS VARCHAR) ELSE CAST({value} AS VARCHAR) END"


CTES["skill_first"] = f"""
SELECT employee_id, lower(trim(skill)) AS skill_key, min(row_seq) AS first_seq,
       concat('- Skill: ', arg_min(trim(skill), row_seq), ' | Category: ', arg_min(coalesce(skill_category, ''), row_seq),
              ' | Experience: ', arg_min({_number('skill_experience_years')}, row_seq), ' years') AS line
FROM employee_skill WHERE trim(skill) <> '' GROUP BY 1, 2"""

# Lines of the rows in the opposite order.
CTES["skill_reversed"] = CTES["skill_first"].replace("row_seq", "(-row_seq)")

CTES["skill_list"] = """
SELECT employee_id, string_agg(skill, '|' ORDER BY first_seq) AS skills
FROM (SELECT employee_id, skill, min(row_seq) AS first_seq FROM employee_skill GROUP BY 1, 2) GROUP BY 1"""

CTES["profile"] = """
SELECT h.employee_id, concat('Employee Profile', chr(10), 'Primary Domain: ', h.domain, chr(10),
       'Domain Experience: ', CAST(CAST(domain_experience_years AS BIGINT) AS VARCHAR), ' years', chr(10),
       'Total Experience: ', CAST(CAST(total_experience_years AS BIGINT) AS VARCHAR), ' years', chr(10),
       'Past Project Summary: ', coalesce(s.past_project_execution_summary, ''), chr(10),
       'Skills:', chr(10), f.lines) AS profile_text
FROM header h JOIN summaries s USING (k)
JOIN (SELECT employee_id, string_agg(line, chr(10) ORDER BY first_seq) AS lines FROM skill_first GROUP BY 1) f USING (employee_id)"""

CTES["requirement"] = """
SELECT s_suppkey AS s, concat('REQ', lpad(CAST(s_suppkey AS VARCHAR), 12, '0')) AS requirement_id,
       concat('Project for ', s_name) AS project_description,
       CASE WHEN s_suppkey%7 = 6 THEN '' ELSE
         (['AUTOMOBILE','BUILDING','FURNITURE','HOUSEHOLD','MACHINERY'])[CAST(s_suppkey%5 AS INTEGER) + 1] END AS domain,
       (['High','Medium','Low'])[CAST(s_suppkey%3 AS INTEGER) + 1] AS project_criticality,
       CAST(1 + s_suppkey%24 AS DOUBLE) AS project_duration_months,
       CAST((s_suppkey%5)*25 AS DOUBLE) AS required_bandwidth_percentage,
       CAST(nullif(s_suppkey%11, 0) AS DOUBLE) AS minimum_overall_experience_years
FROM supplier"""

CTES["mandatory"] = """
SELECT s_suppkey AS s, concat('REQ', lpad(CAST(s_suppkey AS VARCHAR), 12, '0')) AS requirement_id, j,
       concat('Brand#', CAST(1 + (s_suppkey*3 + j*7)%25 AS VARCHAR)) AS skill,
       CASE WHEN (s_suppkey + j)%4 = 0 THEN '' ELSE 'Tech' END AS category,
       nullif((s_suppkey + j)%6, 0) AS years
FROM supplier, (SELECT unnest([0, 1, 2]) AS j) WHERE s_suppkey%13 <> 12"""

CTES["optional"] = """
SELECT s_suppkey AS s, concat('REQ', lpad(CAST(s_suppkey AS VARCHAR), 12, '0')) AS requirement_id,
       concat('Brand#', CAST(1 + (s_suppkey*3 + 11)%25 AS VARCHAR)) AS skill
FROM supplier WHERE s_suppkey%4 <> 3"""

CTES["active"] = """
SELECT * FROM people WHERE k IN (SELECT o_custkey FROM orders JOIN lineitem ON o_orderkey = l_orderkey)"""

CTES["vector"] = """
SELECT a.employee_id, a.k, a.c_nationkey, CAST(e.embedding AS DOUBLE[]) AS vec FROM active a JOIN embeddings e ON e.vec_id = a.k % (SELECT count(*) FROM embeddings)"""

CTES["query_vector"] = """
SELECT r.requirement_id, r.s, CAST(e.embedding AS DOUBLE[]) AS vec FROM requirement r JOIN embeddings e ON e.vec_id = r.s % (SELECT count(*) FROM embeddings)"""

def _candidates(most: int) -> str:
    return f"""
SELECT *, row_number() OVER (PARTITION BY requirement_id ORDER BY similarity DESC, employee_id) AS candidate_rank
FROM (SELECT q.requirement_id, v.employee_id,
             floor(list_inner_product(q.vec, v.vec)*1000000000.0 + 0.5)/1000000000.0 AS similarity
      FROM query_vector q, vector v)
QUALIFY candidate_rank <= {most}"""


CTES["candidate"] = _candidates(50)
CTES["candidate_100"] = _candidates(100)

CTES["centroid"] = """
SELECT cell, [x/sqrt(list_inner_product(mean, mean)) FOR x IN mean] AS centre FROM (
  SELECT cell, list(total/n ORDER BY pos) AS mean FROM (
    SELECT vec_id%20 AS cell, pos, CAST(sum(CAST(floor(CAST(x AS DOUBLE)*1e9 + 0.5) AS BIGINT)) AS DOUBLE) AS total, CAST(count(*) AS DOUBLE) AS n
    FROM (SELECT vec_id, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS pos FROM embeddings) GROUP BY 1, 2)
  GROUP BY cell)"""

CTES["celled"] = """
SELECT v.employee_id, v.vec, v.c_nationkey, c.cell FROM vector v, centroid c
QUALIFY row_number() OVER (PARTITION BY v.employee_id
  ORDER BY floor(list_inner_product(v.vec, c.centre)*1000000000.0 + 0.5) DESC, c.cell) = 1"""

CTES["probe"] = """
SELECT q.requirement_id, q.vec, c.cell, row_number() OVER (PARTITION BY q.requirement_id
  ORDER BY floor(list_inner_product(q.vec, c.centre)*1000000000.0 + 0.5) DESC, c.cell) AS position
FROM query_vector q, centroid c QUALIFY position <= 10"""

CTES["probed"] = """
SELECT *, row_number() OVER (PARTITION BY requirement_id ORDER BY similarity DESC, employee_id) AS candidate_rank
FROM (SELECT p.requirement_id, v.employee_id,
             floor(list_inner_product(p.vec, v.vec)*1000000000.0 + 0.5)/1000000000.0 AS similarity
      FROM probe p JOIN celled v USING (cell))
QUALIFY candidate_rank <= 50"""


CTES["distinct_vector"] = """
SELECT vec, count(*) AS n, min(employee_id) AS first_id FROM vector WHERE list_inner_product(vec, vec) > 0 GROUP BY vec"""

CTES["trained_0"] = """
SELECT row_number() OVER (ORDER BY sha256('7:' || first_id), first_id) - 1 AS cell, [x/sqrt(list_inner_product(vec, vec)) FOR x IN vec] AS centre
FROM distinct_vector QUALIFY cell < 20"""

# A round: vectors to their nearest centre, weighted sums on a grid of 2^-40, unit length again.
for _round in range(4):
    CTES[f"nearest_{_round}"] = f"""
SELECT v.vec, v.n, c.cell FROM distinct_vector v, trained_{_round} c
QUALIFY row_number() OVER (PARTITION BY v.first_id
  ORDER BY floor(list_inner_product(v.vec, c.centre)*1000000000.0 + 0.5) DESC, c.cell) = 1"""
    CTES[f"trained_{_round + 1}"] = f"""
SELECT cell, [x/sqrt(list_inner_product(total, total)) FOR x IN total] AS centre FROM (
  SELECT cell, list(CAST(total AS DOUBLE) ORDER BY pos) AS total FROM (
    SELECT cell, pos, sum(CAST(floor(x*1099511627776.0 + 0.5) AS BIGINT)*n) AS total
    FROM (SELECT cell, n, unnest(vec) AS x, generate_subscripts(vec, 1) AS pos FROM nearest_{_round}) GROUP BY 1, 2) GROUP BY 1)"""


def _scored(ratio: str = "1.0", candidate: str = "candidate") -> str:
    return f"""
SELECT c.requirement_id, c.employee_id, c.similarity, h.employee_name, h.domain, h.total_experience_years,
       h.current_bandwidth_percent, r.s,
       CASE WHEN m.n IS NULL THEN CAST(1.0 AS DOUBLE) ELSE CAST(m.matched AS DOUBLE)/m.n END AS skill_coverage,
       CASE WHEN m.n IS NULL THEN CAST(0.0 AS DOUBLE) ELSE m.ratios/m.n END AS skill_experience_score,
       CASE WHEN r.minimum_overall_experience_years > 0
            THEN least(h.domain_experience_years/r.minimum_overall_experience_years, CAST(1.0 AS DOUBLE))
            ELSE CAST(1.0 AS DOUBLE) END AS domain_score,
       least(h.total_experience_years/CAST(10.0 AS DOUBLE), CAST(1.0 AS DOUBLE)) AS experience_score,
       CAST(0.5 AS DOUBLE) + h.current_bandwidth_percent/CAST(200.0 AS DOUBLE) AS availability
FROM {candidate} c JOIN requirement r USING (requirement_id) JOIN header h USING (employee_id)
LEFT JOIN (
  SELECT p.requirement_id, p.employee_id, count(*) AS n,
         count(DISTINCT CASE WHEN l.years IS NOT NULL THEN q.skill_key END) AS matched,
         list_sum(list(CASE WHEN l.years IS NULL THEN CAST(0.0 AS DOUBLE) ELSE CAST({ratio} AS DOUBLE) END ORDER BY q.j)) AS ratios
  FROM {candidate} p JOIN (SELECT *, lower(trim(skill)) AS skill_key FROM mandatory) q USING (requirement_id)
  LEFT JOIN skill_last l ON l.employee_id = p.employee_id AND l.skill_key = q.skill_key
  GROUP BY 1, 2) m ON m.requirement_id = c.requirement_id AND m.employee_id = c.employee_id"""


CTES["scored"] = _scored()
CTES["scored_100"] = _scored("1.0", "candidate_100")
CTES["scored_probed"] = _scored("1.0", "probed")
CTES["scored_by_years"] = _scored("CASE WHEN q.years > 0 THEN least(l.years/q.years, 1.0) ELSE 1.0 END")


def _ruled(source: str, m: str = "0.4", e: str = "0.3", d: str = "0.2", x: str = "0.1") -> str:
    return f"""
SELECT *,
       floor(technical_score*availability*100.0*100.0 + 0.5)/100.0 AS rule_score,
       floor(technical_score*availability*100.0/100.0*1000.0 + 0.5)/1000.0 AS calibrated_rule_score
FROM (SELECT *, {m}*skill_coverage + {e}*skill_experience_score + {d}*domain_score + {x}*experience_score AS technical_score
      FROM {source})"""


CTES["ruled"] = _ruled("scored")
CTES["ruled_100"] = _ruled("scored_100")
CTES["ruled_probed"] = _ruled("scored_probed")
CTES["ruled_by_years"] = _ruled("scored_by_years", "0.25", "0.25", "0.4", "0.1")
CTES["ruled_weighted"] = _ruled(
    "scored",
    "CASE WHEN s%3 = 1 THEN CAST(0.5 AS DOUBLE) ELSE CAST(0.4 AS DOUBLE) END", "CAST(0.3 AS DOUBLE)",
    "CASE WHEN s%3 = 0 THEN CAST(0.2 AS DOUBLE) ELSE s%5/CAST(3.0 AS DOUBLE) END",
    "CASE WHEN s%3 = 0 THEN CAST(0.1 AS DOUBLE) ELSE CAST(0.15 AS DOUBLE) END",
)


def _ranked(source: str, where: str = "true") -> str:
    return f"""
SELECT *, CASE WHEN final_rank >= 0.82 THEN 'High' WHEN final_rank >= 0.65 THEN 'Medium' ELSE 'Low' END AS confidence,
       CAST(row_number() OVER (PARTITION BY requirement_id ORDER BY final_rank DESC, similarity DESC, employee_id) AS INTEGER) AS rank,
       count(*) OVER (PARTITION BY requirement_id) AS total_matches
FROM (SELECT *, floor((0.6*similarity + 0.4*calibrated_rule_score)*10000.0 + 0.5)/10000.0 AS final_rank FROM {source})
WHERE {where}"""


# 0/3, 1/3, 2/3, 3/3 and 4/3 are the domain weights; the last is out of range.
CTES["ranked"] = _ranked("ruled")
CTES["ranked_100"] = _ranked("ruled_100")
CTES["ranked_probed"] = _ranked("ruled_probed")
CTES["ranked_by_years"] = _ranked("ruled_by_years")
CTES["ranked_weighted"] = _ranked("ruled_weighted", "s%3 = 0 OR s%5 <= 3")


def _matches(source: str, top_n: int = 20, where: str = "true") -> str:
    return f"""
SELECT requirement_id, rank, employee_id, employee_name, domain, total_experience_years, current_bandwidth_percent,
       skills, floor(similarity*10000.0 + 0.5)/10000.0 AS similarity, rule_score, calibrated_rule_score, final_rank,
       confidence, total_matches
FROM {source} JOIN skill_list USING (employee_id) WHERE rank <= {top_n} AND {where}"""


CTES["match_rows"] = _matches("ranked")

CTES["office_snapshot"] = """
SELECT step, employee_id, CASE step WHEN 1 THEN c_nationkey <> 0 WHEN 2 THEN c_nationkey <> 1 ELSE true END AS present,
       c_nationkey FROM active, (SELECT unnest([1, 2, 3, 4]) AS step)"""

CTES["labelled"] = """
SELECT CAST(step AS INTEGER) AS step, employee_id, present AS is_active,
       CASE WHEN present AND NOT known THEN 'NEW' WHEN present AND was THEN 'KEEP' WHEN present THEN 'REACTIVATE'
            WHEN was THEN 'DELETE' ELSE 'ABSENT' END AS action
FROM (SELECT *, coalesce(lag(present) OVER w, false) AS was,
             coalesce(bool_or(present) OVER (PARTITION BY employee_id ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS known
      FROM office_snapshot WINDOW w AS (PARTITION BY employee_id ORDER BY step))
WHERE present OR known"""

_VECTOR_ID = "CAST(concat('0x', substr(sha256(employee_id), 1, 15)) AS BIGINT)"


def _sql(body: str) -> str:
    """Prepend the needed expressions, in dependency order."""
    needed: list[str] = []

    def visit(text: str) -> None:
        for name in CTES:
            if re.search(rf"\b(?:FROM|JOIN|,)\s+{name}\b", text) and name not in needed:
                visit(CTES[name])
                needed.append(name)

    visit(body)
    head = ",\n".join(f"{n} AS MATERIALIZED ({CTES[n].strip()})" for n in needed)
    return f"WITH {head}\n{body.strip()}" if needed else body.strip()


def _similarity4(name: str = "similarity") -> str:
    return f"floor({name}*10000.0 + 0.5)/10000.0 AS similarity"


_EMBEDDING_TEXT = """
SELECT r.requirement_id, concat('Employee Profile', chr(10), 'Primary Domain: ', coalesce(nullif(r.domain, ''), 'N/A'), chr(10),
  'Domain Experience: ', CAST(CAST(coalesce(minimum_overall_experience_years, 0) AS BIGINT) AS VARCHAR), ' years', chr(10),
  'Total Experience: ', CAST(CAST(coalesce(minimum_overall_experience_years, 0) AS BIGINT) AS VARCHAR), ' years', chr(10),
  'Past Project Summary: ', project_description, chr(10), 'Skills:', chr(10), coalesce(l.lines, 'None')) AS embedding_text
FROM requirement r LEFT JOIN (
  SELECT requirement_id, string_agg(line, chr(10) ORDER BY j) AS lines FROM (
    SELECT requirement_id, j, concat('- Skill: ', skill, ' | Category: ', coalesce(nullif(category, ''), 'General'),
           CASE WHEN years IS NULL THEN '' ELSE concat(' | Experience: ', CAST(years AS VARCHAR), ' years') END) AS line
    FROM mandatory
    UNION ALL SELECT requirement_id, 9, concat('- Skill: ', skill, ' | Category: Tools | Optional') FROM optional)
  GROUP BY 1) l USING (requirement_id)"""

CTES["requirement_text"] = _EMBEDDING_TEXT

_DISPLAY_TEXT = """
SELECT r.requirement_id, concat('Project Description:', chr(10), project_description, chr(10), chr(10),
  'Domain: ', coalesce(nullif(r.domain, ''), 'N/A'), chr(10), 'Criticality: ', project_criticality, chr(10),
  'Duration: ', CAST(CAST(project_duration_months AS BIGINT) AS VARCHAR), ' months', chr(10),
  'Required Bandwidth: ', CAST(CAST(required_bandwidth_percentage AS BIGINT) AS VARCHAR), '%', chr(10),
  'Minimum Overall Experience: ', coalesce(CAST(CAST(minimum_overall_experience_years AS BIGINT) AS VARCHAR), 'N/A'), ' years',
  chr(10), chr(10), 'Mandatory Skills:', chr(10), coalesce(m.skills, 'None'), chr(10), chr(10),
  'Optional Skills:', chr(10), coalesce(o.skill || ' (Tools)', 'None')) AS display_text
FROM requirement r LEFT JOIN (
  SELECT requirement_id, string_agg(concat(skill, CASE
      WHEN years IS NOT NULL AND category <> '' THEN concat(' (', CAST(years AS VARCHAR), ' years, ', category, ')')
      WHEN years IS NOT NULL THEN concat(' (', CAST(years AS VARCHAR), ' years)')
      WHEN category <> '' THEN concat(' (', category, ')') ELSE '' END), ', ' ORDER BY j) AS skills
  FROM mandatory GROUP BY 1) m USING (requirement_id)
LEFT JOIN optional o USING (requirement_id)"""

CTES["requirement_display"] = _DISPLAY_TEXT

_PARSED = """
SELECT r.requirement_id, project_description, r.domain, project_criticality, project_duration_months,
  required_bandwidth_percentage, minimum_overall_experience_years, coalesce(m.skills, '') AS mandatory,
  coalesce(o.skill || ':Tools:-', '') AS optional
FROM requirement r LEFT JOIN (
  SELECT requirement_id, string_agg(concat(skill, ':', category, ':', coalesce(CAST(years AS VARCHAR), '-')), '|' ORDER BY j) AS skills
  FROM mandatory GROUP BY 1) m USING (requirement_id)
LEFT JOIN optional o USING (requirement_id) WHERE r.s%10 NOT IN (8, 9)"""

_INGEST_COLUMNS = """employee_id, row_seq, employee_name, domain, domain_experience_years, total_experience_years,
       current_bandwidth_percent, skill, coalesce(skill_category, '') AS skill_category, skill_experience_years"""

_KNN = f"SELECT requirement_id, employee_id, CAST(candidate_rank AS INTEGER) AS candidate_rank, {_similarity4()} FROM "


def _score_sql(name: str) -> str:
    return f"SELECT requirement_id, employee_id, {name} FROM ruled"


_PROMPT = f"""
SELECT r.requirement_id, r.employee_id, r.rank, concat(
  'Wanted:', chr(10), t.embedding_text, chr(10), chr(10), 'Offered:', chr(10), p.profile_text, chr(10), chr(10),
  'Findings:', chr(10), '- Place ', CAST(r.rank AS VARCHAR), ' of ', CAST(r.total_matches AS VARCHAR), ', score ',
  printf('%.4f', r.final_rank), ' (', r.confidence, ')', chr(10), '- Mandatory skills: ', CAST(coalesce(f.wanted, 0) AS VARCHAR),
  ' wanted, ', CAST(coalesce(f.absent, 0) AS VARCHAR), ' absent', chr(10), '- Absent: ', coalesce(f.missing, 'none'), chr(10),
  '- Short of years: ', coalesce(f.short, 'none'), chr(10), '- Free capacity: ',
  CAST(CAST(r.current_bandwidth_percent AS BIGINT) AS VARCHAR), ' percent', chr(10), chr(10),
  'Which of these findings decide the match, and what should be clarified before it is made?') AS prompt
FROM ranked r JOIN profile p USING (employee_id) JOIN requirement_text t USING (requirement_id)
LEFT JOIN (
  SELECT c.requirement_id, c.employee_id, count(*) AS wanted, count(*) FILTER (l.years IS NULL) AS absent,
         string_agg(lower(trim(m.skill)), ', ' ORDER BY m.j) FILTER (l.years IS NULL) AS missing,
         string_agg(concat(trim(m.skill), ' (', {_number('l.years')}, ' of ', CAST(m.years AS VARCHAR), ')'), ', ' ORDER BY m.j)
           FILTER (l.years < m.years) AS short
  FROM candidate c JOIN mandatory m USING (requirement_id)
  LEFT JOIN skill_last l ON l.employee_id = c.employee_id AND l.skill_key = lower(trim(m.skill)) GROUP BY 1, 2) f
  ON f.requirement_id = r.requirement_id AND f.employee_id = r.employee_id
WHERE r.rank <= 10"""


def _words(source: str, key: str, text: str) -> str:
    """Unit vectors of hashed word counts, one row per bucket; components are kept as 4-byte floats."""
    return f"""
SELECT {key}, b, CAST(CAST(n/sqrt(sum(n*n) OVER (PARTITION BY {key})) AS FLOAT) AS DOUBLE) AS x FROM (
  SELECT {key}, CAST(concat('0x', substr(sha256(w), 1, 15)) AS BIGINT)%256 AS b, CAST(count(*) AS DOUBLE) AS n
  FROM (SELECT {key}, unnest(regexp_extract_all(lower({text}), '[^\\x20\\x09-\\x0D]+')) AS w FROM {source}) GROUP BY 1, 2)"""


CTES["profile_words"] = _words("profile", "employee_id", "profile_text")
CTES["requirement_words"] = _words("requirement_text", "requirement_id", "embedding_text")
CTES["word_candidate"] = """
SELECT *, row_number() OVER (PARTITION BY requirement_id ORDER BY similarity DESC, employee_id) AS candidate_rank
FROM (SELECT requirement_id, employee_id, floor(sum(r.x*p.x)*1000000000.0 + 0.5)/1000000000.0 AS similarity
      FROM requirement_words r JOIN profile_words p USING (b) GROUP BY 1, 2)
QUALIFY candidate_rank <= 50"""


def _letters(source: str, key: str, text: str) -> str:
    return f"""
SELECT {key}, [CAST(CAST(x/sqrt(list_inner_product(v, v)) AS FLOAT) AS DOUBLE) FOR x IN v] AS vec FROM (
  SELECT {key}, [CAST(length({text}) - length(replace({text}, c, '')) AS DOUBLE) FOR c IN string_split('abcdefghijklmnopqrstuvwxyz', '')] AS v
  FROM {source})"""


CTES["profile_letters"] = _letters("profile", "employee_id", "profile_text")
CTES["requirement_letters"] = _letters("requirement_text", "requirement_id", "embedding_text")
CTES["letter_candidate"] = """
SELECT *, row_number() OVER (PARTITION BY requirement_id ORDER BY similarity DESC, employee_id) AS candidate_rank
FROM (SELECT r.requirement_id, p.employee_id, floor(list_inner_product(r.vec, p.vec)*1000000000.0 + 0.5)/1000000000.0 AS similarity
      FROM requirement_letters r, profile_letters p)
QUALIFY candidate_rank <= 50"""

# The text columns of the CSV files and what is wrong with a row; numbers beyond those checks are in order.
CTES["csv_row"] = """
SELECT *, CASE WHEN k%19 = 3 THEN '' ELSE employee_id END AS id, concat(employee_name, ' "of"', chr(10), 'two, lines') AS full_name,
  concat_ws('; ', CASE WHEN k%19 = 3 THEN 'employee_id is empty' END,
    CASE WHEN k%17 = 5 THEN 'domain_experience_years is not a number' END,
    CASE WHEN k%23 = 7 THEN 'total_experience_years is not a number' END,
    CASE WHEN k%29 = 1 THEN 'skill_experience_years is not a number' END,
    CASE WHEN k%31 = 2 THEN 'current_bandwidth_percent is not a number' END) AS reason
FROM employee_skill"""

_INDEXES = "(SELECT unnest(['all', 'cells']) AS index_name)"

BODIES = {
    "csv_load": "SELECT id AS employee_id, full_name AS employee_name, skill, coalesce(skill_category, '') AS skill_category, reason, "
                "row_number() OVER (PARTITION BY k ORDER BY row_seq) AS place FROM csv_row",
    "csv_load_split": "SELECT employee_id, employee_name, skill, coalesce(skill_category, '') AS skill_category, "
                      "row_number() OVER (ORDER BY row_seq) AS place, "
                      "row_number() OVER (PARTITION BY employee_id ORDER BY row_seq) AS own_place FROM employee_skill",
    "sync_detect_changes": """SELECT employee_id, CASE WHEN changed THEN 'CHANGE' ELSE 'KEEP' END AS action,
        CAST(CASE WHEN changed THEN 2 ELSE 1 END AS BIGINT) AS vector_version FROM (
          SELECT a.employee_id, c_nationkey = 2 OR (c_nationkey = 3 AND f.lines IS DISTINCT FROM r.lines) AS changed FROM active a
          LEFT JOIN (SELECT employee_id, string_agg(line, chr(10) ORDER BY first_seq) AS lines FROM skill_first GROUP BY 1) f USING (employee_id)
          LEFT JOIN (SELECT employee_id, string_agg(line, chr(10) ORDER BY first_seq) AS lines FROM skill_reversed GROUP BY 1) r USING (employee_id))""",
    "vector_id_conflicts": """SELECT k // 10 AS vector_id, count(*) AS employees, min(employee_id) AS first_id, max(employee_id) AS last_id
        FROM active GROUP BY 1 HAVING count(*) > 1""",
    "knn_exact_blocks": _KNN + "candidate",
    "ivf_exact_probe": _KNN + "candidate",
    "ivf_train": """SELECT cell, n, pos, floor(x*1000000.0 + 0.5)/1000000.0 AS x FROM (
          SELECT cell, unnest(centre) AS x, generate_subscripts(centre, 1) AS pos FROM trained_3)
        JOIN (SELECT cell, CAST(sum(n) AS BIGINT) AS n FROM nearest_3 GROUP BY 1) USING (cell)""",
    "index_pairing": """SELECT count(*) FILTER (c_nationkey NOT IN (0, 1)) AS paired, count(*) FILTER (c_nationkey = 0) AS ids_without_vector,
        count(*) FILTER (c_nationkey = 1) AS vectors_without_id, count(*) FILTER (c_nationkey = 2) AS wrong_dim, CAST(64 AS BIGINT) AS dim
        FROM vector""",
    "vectors_after_compaction": """SELECT what, employee_id, floor(vec[1]*CASE c_nationkey WHEN 2 THEN -1 ELSE 1 END*10000.0 + 0.5)/10000.0 AS first_component,
        (SELECT count(*) FROM vector) AS kept, (SELECT count(*) FROM vector WHERE c_nationkey = 2) AS dropped,
        (SELECT count(*) FROM vector WHERE c_nationkey = 2) AS index_dropped
        FROM vector, (SELECT unnest(['live', 'index']) AS what) WHERE c_nationkey <> 1""",
    "stored_index_probe": _matches("ranked_probed"),
    "requirement_result": """SELECT r.requirement_id, r.project_description, r.project_criticality, display_text, embedding_text,
        m.total_matches, m.results FROM requirement r JOIN requirement_display USING (requirement_id) JOIN requirement_text USING (requirement_id)
        JOIN (SELECT requirement_id, max(total_matches) AS total_matches,
              string_agg(concat(CAST(rank AS VARCHAR), ':', employee_id, ':', printf('%.4f', final_rank), ':', confidence), '|' ORDER BY rank) AS results
              FROM ranked WHERE rank <= 5 GROUP BY 1) m USING (requirement_id)""",
    "requirement_files": "SELECT display_text || chr(10) AS requirement_text FROM requirement_display",
    "encode_default": "SELECT requirement_id, employee_id, CAST(candidate_rank AS INTEGER) AS candidate_rank, "
                      "floor(similarity*10000.0 + 0.5)/10000.0 AS similarity FROM word_candidate",
    "encode_batch": "SELECT requirement_id, employee_id, CAST(candidate_rank AS INTEGER) AS candidate_rank, "
                    "floor(similarity*10000.0 + 0.5)/10000.0 AS similarity FROM letter_candidate",
    "sync_after_failure": """SELECT CAST(step AS INTEGER) AS step, employee_id, CAST(1 AS BIGINT) AS vectors FROM active,
        (SELECT unnest([2, 3]) AS step) WHERE step = 3 OR c_nationkey NOT IN (0, 1)""",
    "index_after_append": f"""SELECT step, index_name, employee_id,
        CAST(CASE step WHEN 'before' THEN (SELECT count(*) FROM vector WHERE c_nationkey <> 0)
             ELSE (SELECT count(*) FROM vector WHERE c_nationkey <> 1) END AS BIGINT) AS stored_total
        FROM vector, (SELECT unnest(['before', 'after']) AS step), {_INDEXES}
        WHERE c_nationkey <> 1 AND (step = 'after' OR c_nationkey <> 0)""",
    "index_after_change": f"""SELECT step, index_name, employee_id,
        floor(vec[1]*CASE WHEN step = 'after' AND c_nationkey = 2 THEN -1 ELSE 1 END*10000.0 + 0.5)/10000.0 AS first_component,
        (SELECT count(*) FROM vector) AS stored_total
        FROM vector, (SELECT unnest(['before', 'after']) AS step), {_INDEXES}""",
    "index_after_rebuild": f"""SELECT index_name, employee_id, (SELECT count(*) FROM vector WHERE c_nationkey <> 1) AS stored_total,
        CAST(20 AS INTEGER) AS nlist
        FROM vector, {_INDEXES} WHERE c_nationkey <> 1""",
    "index_after_drop": "SELECT 'all' AS index_name, (SELECT count(*) FROM vector WHERE c_nationkey <> 1) AS vector_count",
    "ingest_clean": f"SELECT {_INGEST_COLUMNS} FROM employee_skill WHERE c_acctbal >= 0",
    "ingest_quarantine": "SELECT employee_id, row_seq, skill, 'total_experience_years is not a number' AS reason "
                         "FROM employee_skill WHERE c_acctbal < 0",
    "snapshot_roundtrip": f"SELECT {_INGEST_COLUMNS} FROM employee_skill WHERE c_acctbal >= 0",
    "employee_header": "SELECT employee_id, employee_name, domain, domain_experience_years, total_experience_years, "
                       "current_bandwidth_percent, past_project_execution_summary FROM header JOIN summaries USING (k)",
    "employee_skill_list": "SELECT employee_id, skills FROM skill_list",
    "employee_skill_years": "SELECT employee_id, skill_key, years FROM skill_last",
    "employee_skill_lines": "SELECT employee_id, skill_key, line FROM skill_first",
    "employee_row_order": "SELECT employee_id, row_seq AS source_order, row_number() OVER "
                          "(PARTITION BY employee_id ORDER BY row_seq) AS row_seq FROM employee_skill",
    "profile_text": "SELECT employee_id, profile_text FROM profile",
    "vector_ids": f"SELECT employee_id, {_VECTOR_ID} AS vector_id FROM active",
    "requirement_parsed": _PARSED,
    "requirement_errors": "SELECT requirement_id, CASE s%10 WHEN 9 THEN 'JSON parsing failed' ELSE 'Extraction failed' END AS error "
                          "FROM requirement WHERE s%10 IN (8, 9)",
    "requirement_embedding_text": "SELECT requirement_id, embedding_text FROM requirement_text",
    "requirement_display_text": "SELECT requirement_id, display_text FROM requirement_display",
    "sync_labels": "SELECT step, employee_id, action, is_active FROM labelled",
    "registry_after_sync": f"SELECT employee_id, {_VECTOR_ID} AS vector_id, "
                           "CAST(CASE WHEN action = 'NEW' THEN 2 ELSE 1 END AS BIGINT) AS vector_version, is_active "
                           "FROM labelled WHERE step = 2",
    "registry_active": f"SELECT employee_id, {_VECTOR_ID} AS vector_id FROM labelled WHERE step = 2 AND is_active",
    "sync_summary": """SELECT step, count(*) FILTER (action = 'NEW') AS new_count, CAST(0 AS BIGINT) AS changed_count,
        count(*) FILTER (action = 'DELETE') AS deleted_count, count(*) FILTER (action = 'REACTIVATE') AS reactivated_count,
        count(*) FILTER (is_active) AS total_active, count(*) FILTER (action IN ('DELETE', 'REACTIVATE')) > 0 AS rebuild_indexes_required
        FROM labelled GROUP BY step""",
    "vector_id_lookup": f"SELECT requirement_id, employee_id, {_VECTOR_ID} AS vector_id FROM candidate",
    "vectors_normalized": """SELECT vec_id, floor(sqrt(list_inner_product(unit, unit))*10000.0 + 0.5)/10000.0 AS norm,
        array_to_string([CAST(CAST(floor(x*10000.0 + 0.5) AS BIGINT) AS VARCHAR) FOR x IN unit], ' ') AS components
        FROM (SELECT vec_id, [CAST(CAST(x/sqrt(list_inner_product(v, v)) AS FLOAT) AS DOUBLE) FOR x IN v] AS unit FROM
              (SELECT vec_id, [CAST(x*3 AS DOUBLE) FOR x IN embedding] AS v FROM embeddings))""",
    "pair_similarity": "SELECT q.requirement_id, p.employee_id, "
                       "floor(list_inner_product(q.vec, CAST(e.embedding AS DOUBLE[]))*10000.0 + 0.5)/10000.0 AS similarity "
                       "FROM query_vector q JOIN people p ON p.k = q.s JOIN embeddings e ON e.vec_id = p.k % (SELECT count(*) FROM embeddings)",
    "knn_exact": _KNN + "candidate",
    "knn_exact_grid": _KNN + "candidate",
    "ivf_cells": "SELECT employee_id, cell FROM celled",
    "ivf_probes": "SELECT requirement_id, position, cell FROM probe",
    "ivf_search": _KNN + "probed",
    "ivf_search_grid": _KNN + "probed",
    "ivf_full_probe_equals_exact": _KNN + "candidate",
    "index_append_missing": "SELECT employee_id, cell FROM celled WHERE c_nationkey = 0",
    "index_catalog": """SELECT index_name, index_type, 'table/64' AS model, CAST(64 AS INTEGER) AS dim, CAST(20 AS INTEGER) AS nlist,
        CAST(nprobe AS INTEGER) AS nprobe, (SELECT count(*) FROM vector) AS vector_count
        FROM (VALUES ('all', 'exact', 10), ('cells', 'ivf', 20)) AS t(index_name, index_type, nprobe)""",
    "embedding_sets": "SELECT 'table/64' AS model, count(*) AS vector_count, CAST(max(len(vec)) AS INTEGER) AS dim FROM vector",
    "stored_index_match": "SELECT * FROM match_rows",
    "skill_coverage": _score_sql("skill_coverage"),
    "skill_experience": _score_sql("skill_experience_score"),
    "domain_score": _score_sql("domain_score"),
    "experience_score": _score_sql("experience_score"),
    "technical_score": _score_sql("technical_score"),
    "availability": _score_sql("availability"),
    "rule_score": "SELECT requirement_id, employee_id, rule_score, calibrated_rule_score FROM ruled",
    "final_rank": "SELECT requirement_id, employee_id, final_rank, confidence, rank FROM ranked",
    "confidence_counts": "SELECT confidence, count(*) AS pairs FROM ranked GROUP BY confidence",
    "match_top_n": "SELECT * FROM match_rows",
    "match_top_100": _matches("ranked_100", 100),
    "weights_rejected": "SELECT requirement_id, 'weights must lie in [0, 1]' AS error FROM query_vector WHERE s%3 <> 0 AND s%5 > 3",
    "match_top_n_weighted": _matches("ranked_weighted"),
    "match_skill_years": _matches("ranked_by_years", 50),
    "explanation_prompts": _PROMPT,
    "match_with_explanations": "SELECT requirement_id, employee_id, rank, CASE WHEN rank <= 10 THEN 'fit: ' || confidence END "
                               "AS explanation FROM ranked WHERE rank <= 15",
    "stream_match": _matches("ranked", 20, "s%10 NOT IN (8, 9)"),
    "stream_sync": f"SELECT employee_id, {_VECTOR_ID} AS vector_id, true AS is_active FROM active",
}


def oracle_sql() -> dict[str, str]:
    return {name: _sql(body) for name, body in BODIES.items()}
