"""DuckDB SQL fragments shared by the checks."""

from __future__ import annotations

from rankweave.functions.scoring import BM25_B, BM25_K1
from rankweave.functions.text import FOLD_FROM, FOLD_TO, STOP_WORDS
from rankweave.operators.prompt import (
    BLOCK_LINES, CASES_HEAD, INSTRUCTION, SYSTEM_NAME, SYSTEM_PROMPT, USER_HEAD,
)
from rankweave.plans.tables import DIM

STOPS = ", ".join(f"'{w}'" for w in STOP_WORDS)

CASES = """cases AS (
  SELECT doc_id AS case_id, n_chars::INT AS patient_age, lang AS gender, string_split(text, chr(10))[1] AS chief_complaint,
         text AS symptoms, string_split(text, chr(10))[2] AS medical_history, source AS diagnosis, text AS treatment_plan,
         string_split(text, chr(10))[3] AS outcome,
         CASE WHEN n_chars < 1000 THEN 'Low' WHEN n_chars < 4000 THEN 'High' ELSE 'Critical' END AS severity
  FROM documents)"""
LOGS = """logs AS (
  SELECT event_id AS id, user_id, event_type AS query_type, props AS patient_description,
         round(value * 100)::BIGINT AS latency_ms,
         CASE WHEN event_type = 'error' THEN 'error' ELSE 'success' END AS status, ts AS created_at
  FROM events)"""


def words(expr: str) -> str:
    return (f"list_filter(regexp_split_to_array(translate(lower({expr}), '{FOLD_FROM}', '{FOLD_TO}'), "
            r"'[^\p{L}\p{N}]+'), lambda w: w <> '')")


def keyword(requests: str, fields: tuple[str, ...] = ("treatment_plan",), prefix: bool = False) -> str:
    """CTEs ending in kw(query_id, case_id, keyword_score) for `requests`, a CTE body."""
    occ = " UNION ALL ".join(
        f"SELECT case_id, '{f}' AS field, unnest(ws) AS term, generate_subscripts(ws, 1) - 1 AS pos "
        f"FROM (SELECT case_id, {words(f'coalesce({f}, {chr(39)}{chr(39)})')} AS ws FROM cases)" for f in fields)
    by_prefix = ("UNION ALL SELECT lt.leaf, o.case_id, o.field, o.pos, lt.idx FROM occ o JOIN lt "
                 "ON lt.is_prefix AND starts_with(o.term, lt.term)") if prefix else ""
    return rf"""req AS ({requests}),
parts AS (SELECT query_id, unnest(p) AS part, generate_subscripts(p, 1) AS i FROM
  (SELECT query_id, regexp_extract_all(keyword_search, '("[^"]*"\*?|[^\s"]+)') AS p FROM req)),
marked AS (SELECT *, upper(part) NOT IN ('AND', 'OR', 'NOT') AS is_leaf,
  lag(upper(part), 1) OVER w AS p1, lag(upper(part), 2) OVER w AS p2 FROM parts WINDOW w AS (PARTITION BY query_id ORDER BY i)),
flagged AS (SELECT *, coalesce(p1 = 'NOT', false) AS negated,
  coalesce(CASE WHEN p1 = 'NOT' THEN p2 ELSE p1 END = 'AND', false) AS anded FROM marked),
grouped AS (SELECT *, sum(CASE WHEN is_leaf AND NOT anded THEN 1 ELSE 0 END)
  OVER (PARTITION BY query_id ORDER BY i) AS group_no FROM flagged),
leaves AS (SELECT query_id, group_no, negated, {words('part')} AS ws, regexp_matches(part, '\*"?$') AS is_prefix
  FROM grouped WHERE is_leaf),
named AS (SELECT *, array_to_string(ws, ' ') || CASE WHEN is_prefix THEN '*' ELSE '' END AS leaf FROM leaves
  WHERE len(list_filter(ws, lambda w: w NOT IN ({STOPS}))) > 0),
lt AS (SELECT DISTINCT leaf, is_prefix, idx, term FROM
  (SELECT leaf, is_prefix, unnest(ws) AS term, generate_subscripts(ws, 1) - 1 AS idx FROM named) WHERE term NOT IN ({STOPS})),
nt AS (SELECT leaf, count(*) AS n_terms FROM lt GROUP BY leaf),
occ AS MATERIALIZED (SELECT * FROM ({occ}) WHERE term NOT IN ({STOPS})),
dl AS (SELECT case_id, count(*) AS dl FROM occ GROUP BY case_id),
tot AS (SELECT (SELECT count(*) FROM cases)::DOUBLE AS n, (SELECT count(*) FROM occ)::DOUBLE AS len),
found AS (SELECT lt.leaf, o.case_id, o.field, o.pos, lt.idx FROM occ o JOIN lt ON NOT lt.is_prefix AND o.term = lt.term {by_prefix}),
starts AS (SELECT leaf, case_id, field, pos - idx AS start, count(*) AS n FROM found GROUP BY ALL),
hits AS (SELECT s.leaf, s.case_id, count(*) AS tf FROM starts s JOIN nt USING (leaf) WHERE s.n >= nt.n_terms GROUP BY ALL),
df AS (SELECT leaf, count(*) AS df FROM hits GROUP BY leaf),
scored AS (SELECT leaf, case_id, ln(1.0::DOUBLE + (tot.n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * tf * {BM25_K1 + 1.0}::DOUBLE
   / (tf + {BM25_K1}::DOUBLE * ({1.0 - BM25_B}::DOUBLE + {BM25_B}::DOUBLE * dl / (tot.len / tot.n))) AS s
  FROM hits JOIN df USING (leaf) JOIN dl USING (case_id), tot),
asked AS (SELECT query_id, leaf, bool_or(NOT negated) AS counts FROM named GROUP BY ALL),
pairs AS (SELECT a.query_id, s.case_id, a.leaf, a.counts, s.s FROM scored s JOIN asked a USING (leaf)),
meets AS (SELECT DISTINCT query_id, case_id FROM (
  SELECT n.query_id, p.case_id, n.group_no FROM (SELECT DISTINCT query_id, group_no, leaf, negated FROM named) n
  JOIN pairs p USING (query_id, leaf) GROUP BY ALL
  HAVING count(*) FILTER (NOT n.negated) = any_value((SELECT count(DISTINCT m.leaf) FROM named m
           WHERE m.query_id = n.query_id AND m.group_no = n.group_no AND NOT m.negated))
     AND count(*) FILTER (NOT n.negated) > 0 AND count(*) FILTER (n.negated) = 0)),
kw AS (SELECT query_id, case_id, round(sum(CASE WHEN counts THEN s END), 8) AS keyword_score
  FROM pairs JOIN meets USING (query_id, case_id) GROUP BY ALL)"""


def one(condition: str) -> str:
    return f"SELECT 0 AS query_id, '{condition}' AS keyword_search"


def hashed(name: str, source: str, key: str, text: str) -> str:
    """CTEs ending in `name`({key}, embedding): the feature-hash vectors of a text."""
    return f"""{name}_w AS (SELECT {key}, unnest({words(text)}) AS t FROM {source}),
{name}_h AS (SELECT {key}, concat('0x', substr(md5(t), 1, 8))::BIGINT AS h FROM {name}_w WHERE t NOT IN ({STOPS})),
{name}_s AS (SELECT {key}, h % {DIM} AS b, sum(CASE WHEN (h // {DIM}) % 2 = 0 THEN 1 ELSE -1 END)::DOUBLE AS v
  FROM {name}_h GROUP BY ALL),
{name}_n AS (SELECT {key}, sqrt(sum(v * v)) AS norm FROM {name}_s GROUP BY {key} HAVING sum(v * v) > 0),
{name}_g AS (SELECT {key}, norm, unnest(range({DIM})) AS b FROM {name}_n),
{name} AS (SELECT {key}, list((coalesce(v, 0) / norm)::FLOAT::DOUBLE ORDER BY b) AS embedding
  FROM {name}_g LEFT JOIN {name}_s USING ({key}, b) GROUP BY {key})"""


def distance(a: str, b: str) -> str:
    return f"round(1 - list_cosine_similarity({a}::DOUBLE[], {b}::DOUBLE[]), 12)"


def rrf(vr: str, kr: str, wv: str, wk: str, k: str = "60") -> str:
    return f"({wv}::DOUBLE * (1.0::DOUBLE / ({k} + coalesce({vr}, 9999))) + {wk}::DOUBLE * (1.0::DOUBLE / ({k} + coalesce({kr}, 9999))))"


def case_block() -> str:
    parts = ["'Case '", "rank::VARCHAR", "':' || chr(13)"]
    for label, name, default in BLOCK_LINES:
        parts += [f"'{label}'", f"coalesce({name}::VARCHAR, '{default}')", "chr(13)"]
    score = r"regexp_replace(round(hybrid_score, 4)::DECIMAL(10,4)::VARCHAR, '\.?0+$', '')"
    return " || ".join([*parts, "'  Hybrid Score: '", score, "chr(13) || chr(13)"])


def user_prompt(text: str, context: str) -> str:
    return (f"'{USER_HEAD}' || {text} || chr(13) || chr(13) || '{CASES_HEAD.format(system=SYSTEM_NAME)}' || chr(13) || "
            f"{context} || '{INSTRUCTION}'")


def system_prompt() -> str:
    return f"'{SYSTEM_PROMPT.format(system=SYSTEM_NAME)}'"
