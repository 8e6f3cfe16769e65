"""The searches as table functions that SQL text can call.

`register` names the tables by temporary views and creates temporary functions over them:

    SELECT * FROM find_similar(:question, 5, 'FullCase')
    SELECT * FROM keyword_hits('"chest pain" AND NOT asthma', 50)
    SELECT * FROM hybrid_search(:question, 'cough OR fever', 10, 'FullCase', 0.6, 0.4, 60)

Their bodies are SQL, which Spark puts in place of the call: constants reach the scans, and a
bound on a rank becomes a top-k of each task. The keyword side reads the stored postings, only
the term buckets of its words.

Conditions are bare words and quoted phrases with AND, OR and NOT; AND binds closer than OR,
neighbours mean OR. Parentheses, NEAR and prefixes raise an error here; `keyword_search` knows
them. Ties are broken by case id. Vectors without length, of another dimension than the
question, or without a case have no rank. An empty table gives no rows. A bound outside 1 to 100
and a blank condition raise an error.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rankweave.functions.scoring import BM25_B, BM25_K1
from rankweave.functions.text import FOLD_FROM, FOLD_TO, STOP_WORDS, WORD_BREAK
from rankweave.operators.keyword import KeywordIndex, unfolded
from rankweave.schemas import CANDIDATES, CASE_COLS, MISSING_RANK

CASES_VIEW, VECTORS_VIEW, POSTINGS_VIEW, LENGTHS_VIEW = "search_cases", "search_vectors", "search_postings", "search_lengths"


def _text(value: str) -> str:
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _checked(name: str) -> str:
    return f"if({name} BETWEEN 1 AND 100, {name}, cast(raise_error('{name} must be between 1 and 100') AS INT))"


_COSINE = """1 - try_divide(search_dot(v.embedding, question),
         sqrt(search_dot(v.embedding, v.embedding)) * sqrt(search_dot(question, question)))"""


def _near(only_existing: bool) -> str:
    """(case_id, vector_distance) of the vectors of a type."""
    semi = f"LEFT SEMI JOIN {CASES_VIEW} c ON v.case_id = c.case_id" if only_existing else ""
    return f"""SELECT * FROM (SELECT v.case_id, round({_COSINE}, 12) AS vector_distance FROM {VECTORS_VIEW} v {semi}
      WHERE v.embedding_type = embedding_kind AND size(v.embedding) = size(question)) WHERE vector_distance IS NOT NULL"""


def _keyword_ctes(stop_words: Sequence[str], buckets: int) -> str:
    """CTEs ending in kw(case_id, keyword_score) for the parameter `condition`."""
    stops = ", ".join(_text(w) for w in stop_words) or "''"
    return f"""
    parts AS (SELECT pos, part, upper(part) AS word FROM (SELECT search_parts(condition) AS p) LATERAL VIEW posexplode(p) t AS pos, part),
    marked AS (SELECT *, lag(word, 1) OVER (ORDER BY pos) AS p1, lag(word, 2) OVER (ORDER BY pos) AS p2 FROM parts),
    flagged AS (SELECT pos, part, word NOT IN ('AND', 'OR', 'NOT') AS is_leaf, coalesce(p1 = 'NOT', false) AS negated,
      coalesce(if(p1 = 'NOT', p2, p1) = 'AND', false) AS anded FROM marked),
    grouped AS (SELECT *, sum(if(is_leaf AND NOT anded, 1, 0)) OVER (ORDER BY pos) AS group_no FROM flagged),
    leaves AS (SELECT group_no, negated, search_words(part) AS ws FROM grouped WHERE is_leaf),
    named AS (SELECT DISTINCT group_no, negated, array_join(ws, ' ') AS leaf, ws FROM leaves
      WHERE exists(ws, w -> w NOT IN ({stops}))),
    terms AS (SELECT leaf, idx, term, cast(pmod(xxhash64(term), {buckets}) AS INT) AS term_bucket,
        size(filter(ws, w -> w NOT IN ({stops}))) AS n_terms
      FROM (SELECT DISTINCT leaf, ws FROM named) LATERAL VIEW posexplode(ws) t AS idx, term WHERE term NOT IN ({stops})),
    starts AS (SELECT leaf, case_id, field, n_terms, tf, start
      FROM (SELECT t.leaf, t.n_terms, p.case_id, p.field, p.tf,
              if(t.n_terms = 1, array(-1), transform(p.positions, x -> x - t.idx)) AS found
            FROM {POSTINGS_VIEW} p JOIN terms t ON p.term_bucket = t.term_bucket AND p.term = t.term)
      LATERAL VIEW explode(found) f AS start),
    places AS (SELECT leaf, case_id, n_terms, if(n_terms = 1, sum(tf), if(count(*) >= n_terms, 1, 0)) AS tf
      FROM starts GROUP BY leaf, case_id, field, start, n_terms),
    hits AS (SELECT leaf, case_id, sum(tf) AS tf FROM places GROUP BY leaf, case_id HAVING sum(tf) > 0),
    spread AS (SELECT leaf, count(*) AS df FROM hits GROUP BY leaf),
    scored AS (SELECT h.leaf, h.case_id, search_bm25(h.tf, l.dl, s.df, (SELECT count(*) FROM {LENGTHS_VIEW}),
        (SELECT avg(dl) FROM {LENGTHS_VIEW})) AS part
      FROM hits h JOIN spread s ON h.leaf = s.leaf JOIN {LENGTHS_VIEW} l ON h.case_id = l.case_id),
    needed AS (SELECT group_no, count_if(NOT negated) AS n FROM named GROUP BY group_no),
    met AS (SELECT DISTINCT case_id FROM (
      SELECT h.case_id, n.group_no, count_if(NOT n.negated) AS has, count_if(n.negated) AS hurts
      FROM hits h JOIN named n ON h.leaf = n.leaf GROUP BY h.case_id, n.group_no) g
      JOIN needed d ON g.group_no = d.group_no WHERE g.has = d.n AND g.has > 0 AND g.hurts = 0),
    counting AS (SELECT DISTINCT leaf FROM named WHERE NOT negated),
    kw AS (SELECT s.case_id, round(sum(s.part), 8) AS keyword_score
      FROM scored s LEFT SEMI JOIN counting c ON s.leaf = c.leaf LEFT SEMI JOIN met m ON s.case_id = m.case_id GROUP BY s.case_id)"""


def register(spark: SparkSession, cases: DataFrame, embeddings: DataFrame, index: KeywordIndex | None = None) -> None:
    """Create the views and functions of this session; the keyword ones only where a stored `index` is given."""
    shown = cases.select(*CASE_COLS)
    shown.createOrReplaceTempView(CASES_VIEW)
    embeddings.select("case_id", "embedding_type", F.col("embedding").cast("array<double>").alias("embedding")
                      ).createOrReplaceTempView(VECTORS_VIEW)
    result = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in shown.schema.fields)
    columns = ", ".join(f"c.{name}" for name in CASE_COLS)

    def create(head: str, body: str) -> None:
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {head} RETURN {body}")

    create("search_dot(a ARRAY<DOUBLE>, b ARRAY<DOUBLE>) RETURNS DOUBLE",
           "aggregate(zip_with(a, b, (x, y) -> x * y), 0D, (total, x) -> total + x)")
    create(f"find_similar(question ARRAY<DOUBLE>, top_k INT DEFAULT 5, embedding_kind STRING DEFAULT 'FullCase') "
           f"RETURNS TABLE({result}, similarity DOUBLE)",
           f"""SELECT {columns}, 1 - n.vector_distance FROM
    (SELECT *, row_number() OVER (ORDER BY vector_distance, case_id) AS place FROM ({_near(True)})) n
    JOIN {CASES_VIEW} c ON n.case_id = c.case_id WHERE n.place <= {_checked('top_k')}""")
    if index is None:
        return
    if index.postings is None:
        raise ValueError("SQL functions need a stored index")
    unfolded(index.postings).createOrReplaceTempView(POSTINGS_VIEW)
    index.lengths.select("case_id", F.aggregate("lens", F.lit(0).cast("long"), lambda n, x: n + x).alias("dl")
                         ).createOrReplaceTempView(LENGTHS_VIEW)
    create("search_words(part STRING) RETURNS ARRAY<STRING>",
           f"array_remove(split(translate(lower(part), {_text(FOLD_FROM)}, {_text(FOLD_TO)}), {_text(WORD_BREAK)}), '')")
    tokens = _text(r'"[^"]*"\*?|[()]|[^\s"()]+')
    create("search_parts(condition STRING) RETURNS ARRAY<STRING>", f"""CASE
      WHEN coalesce(trim(condition), '') = '' THEN cast(raise_error('condition cannot be blank') AS ARRAY<STRING>)
      WHEN exists(regexp_extract_all(condition, {tokens}, 0), p -> p IN ('(', ')') OR p LIKE '%*')
        THEN cast(raise_error('parentheses, NEAR and prefixes are not for SQL functions') AS ARRAY<STRING>)
      ELSE regexp_extract_all(condition, {tokens}, 0) END""")
    create("search_bm25(tf DOUBLE, dl DOUBLE, df DOUBLE, n DOUBLE, avg_dl DOUBLE) RETURNS DOUBLE",
           f"ln(1D + (n - df + 0.5D) / (df + 0.5D)) * tf * {BM25_K1 + 1.0}D / (tf + {BM25_K1}D * ({1.0 - BM25_B}D + {BM25_B}D * dl / avg_dl))")
    keyword = _keyword_ctes(index.stop_words, index.buckets)
    best = "row_number() OVER (ORDER BY keyword_score DESC, case_id)"
    create(f"keyword_hits(condition STRING, top_k INT DEFAULT {CANDIDATES}) RETURNS TABLE(case_id BIGINT, keyword_score DOUBLE)",
           f"""WITH {keyword}
    SELECT case_id, keyword_score FROM (SELECT *, {best} AS place FROM kw) WHERE place <= {_checked('top_k')}""")

    def part(weight: str, rank: str) -> str:
        return f"coalesce({weight} * (1D / (rrf_k + coalesce({rank}, {MISSING_RANK}))), 0D)"

    create("hybrid_search(question ARRAY<DOUBLE>, condition STRING, top_n INT DEFAULT 10, embedding_kind STRING DEFAULT 'FullCase', "
           "vector_weight DOUBLE DEFAULT 0.6, keyword_weight DOUBLE DEFAULT 0.4, rrf_k INT DEFAULT 60) "
           f"RETURNS TABLE({result}, vector_distance DOUBLE, keyword_score DOUBLE, hybrid_score DOUBLE)",
           f"""WITH {keyword},
    kr AS (SELECT * FROM (SELECT *, {best} AS keyword_rank FROM kw) WHERE keyword_rank <= {CANDIDATES}),
    vc AS (SELECT * FROM (SELECT *, row_number() OVER (ORDER BY vector_distance, case_id) AS place FROM ({_near(False)}))
      WHERE place <= {CANDIDATES}),
    vr AS (SELECT n.case_id, n.vector_distance, row_number() OVER (ORDER BY n.vector_distance, n.case_id) AS vector_rank
      FROM vc n LEFT SEMI JOIN {CASES_VIEW} c ON n.case_id = c.case_id),
    fused AS (SELECT coalesce(v.case_id, k.case_id) AS case_id, v.vector_distance, k.keyword_score,
        {part('vector_weight', 'v.vector_rank')} + {part('keyword_weight', 'k.keyword_rank')} AS hybrid_score
      FROM vr v FULL OUTER JOIN kr k ON v.case_id = k.case_id)
    SELECT {columns}, f.vector_distance, f.keyword_score, f.hybrid_score FROM
      (SELECT *, row_number() OVER (ORDER BY hybrid_score DESC, case_id) AS place FROM fused) f
      JOIN {CASES_VIEW} c ON f.case_id = c.case_id WHERE f.place <= {_checked('top_n')}""")
