"""The queries of this subpackage on the given tables, and the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable
from hashlib import sha256

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rankweave.llm import (
    centroids, decontaminate, exact, html, licenses, mixing, pii, quality, secrets, simhash, spelling, tokens, toxicity,
)
from rankweave.plans.registry import Query, with_package
from rankweave.session import written
from rankweave.sources.tables import read_table

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(fn: Query) -> Query:
        QUERIES[name] = with_package(fn)
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


def fold(column: str, parts: int) -> Column:
    """crc32 of the id as text, modulo `parts`."""
    return F.pmod(F.crc32(F.col(column).cast("string").cast("binary")), F.lit(parts))


@query("op1_simhash")
def op1_simhash(spark: SparkSession, folder: str) -> DataFrame:
    found = simhash.near_duplicates(read_table(spark, folder, "documents"))
    return found.select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("print"), 16, "0")).alias("fingerprint"),
                        F.col("component").alias("component_id"))


@query("op2_html")
def op2_html(spark: SparkSession, folder: str) -> DataFrame:
    found = html.extracted(read_table(spark, folder, "pages"))
    return found.withColumn("n_chars", F.length("text").cast("long"))


@query("op3_licenses")
def op3_licenses(spark: SparkSession, folder: str) -> DataFrame:
    return licenses.licenses(read_table(spark, folder, "documents")).withColumnRenamed("id", "doc_id").drop("spans")


OP4_SQL = r"""
WITH words AS (
    SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
        'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
    FROM documents),
asked AS (
    SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
        'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
    FROM benchmark),
windows AS (
    SELECT DISTINCT item_id, least(10, len(w)) AS width, array_to_string(w[i:i + least(10, len(w)) - 1], ' ') AS line
    FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM asked WHERE len(w) > 0)),
widths AS (SELECT DISTINCT width FROM windows),
starts AS (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM words),
hits AS (
    SELECT s.doc_id, s.i, k.width, h.item_id
    FROM starts s JOIN widths k ON s.i + k.width - 1 <= len(s.w)
    JOIN windows h ON h.width = k.width AND h.line = array_to_string(s.w[s.i:s.i + k.width - 1], ' ')),
marked AS (
    SELECT doc_id, count(DISTINCT place) AS n_hit
    FROM (SELECT doc_id, unnest(range(i, i + width)) AS place FROM hits) GROUP BY doc_id),
listed AS (
    SELECT doc_id, count(DISTINCT item_id) AS n_items,
        array_to_string(list_sort(list(DISTINCT CAST(item_id AS VARCHAR))), ',') AS line
    FROM hits GROUP BY doc_id)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
    sha256(coalesce(line, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM words LEFT JOIN marked USING (doc_id) LEFT JOIN listed USING (doc_id)
"""


@query("op4_decontaminate", OP4_SQL)
def op4_decontaminate(spark: SparkSession, folder: str) -> DataFrame:
    found = decontaminate.contamination(read_table(spark, folder, "documents"), read_table(spark, folder, "benchmark"),
                                        keep=["doc_id"])
    names = F.array_sort(F.transform("items", lambda item: item.cast("string")))
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
                        F.sha2(F.array_join(names, ","), 256).alias("items_sha256"),
                        (F.col("n_hit") > 0).alias("contaminated"))


@query("op5_quality")
def op5_quality(spark: SparkSession, folder: str) -> DataFrame:
    facts = written(quality.measured(read_table(spark, folder, "documents")), "facts")
    labels = read_table(spark, folder, "labels").where(fold("doc_id", 4) != 2)
    found = quality.scored(facts, quality.fit(facts, labels))
    return found.select(F.col("id").alias("doc_id"), (fold("id", 4) == 2).alias("held_out"), "score",
                        (F.col("score") >= 0.7).cast("int").alias("predicted"))


@query("op6_mix")
def op6_mix(spark: SparkSession, folder: str) -> DataFrame:
    found = mixing.mixed(read_table(spark, folder, "documents"))
    return found.select(F.col("id").alias("doc_id"), "size", "source_size", "target", "taken")


@query("op7_toxicity")
def op7_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    docs = read_table(spark, folder, "documents")
    labels = read_table(spark, folder, "labels").where(fold("doc_id", 5) != 0)
    found = toxicity.score(docs, toxicity.fit(docs, labels))
    return found.select(F.col("id").alias("doc_id"), (fold("id", 5) == 0).alias("held_out"), "score",
                        (F.col("score") >= 0.5).cast("int").alias("predicted"))


@query("op8_pii")
def op8_pii(spark: SparkSession, folder: str) -> DataFrame:
    found = pii.personal_data(read_table(spark, folder, "documents"))
    counts = [F.size(k.name).cast("long").alias(f"n_{k.name}") for k in pii.KINDS if k.base]
    base = F.concat(*(F.col(k.name) for k in pii.KINDS if k.base))
    every = F.concat(*(F.col(k.name) for k in pii.KINDS))
    return found.select(F.col("id").alias("doc_id"), *counts, F.sha2(pii.as_line(base), 256).alias("base_sha256"),
                        pii.as_line(every).alias("spans"))


@query("op9_secrets")
def op9_secrets(spark: SparkSession, folder: str) -> DataFrame:
    found = secrets.secrets(read_table(spark, folder, "documents"))
    base = secrets.KINDS[:3]
    kinds = F.transform("spans", lambda s: s["kind"])
    counts = [(F.size(kinds) - F.size(F.array_remove(kinds, k))).cast("long").alias(f"n_{k}") for k in base]
    only = F.filter("spans", lambda s: s["kind"].isin(*base))
    return found.select(F.col("id").alias("doc_id"), *counts, F.sha2(pii.as_line(only), 256).alias("base_sha256"),
                        pii.as_line(F.col("spans")).alias("spans"))


OP10_SQL = """
WITH rows AS (
    SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS line
    FROM documents)
SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
    doc_id = max(doc_id) OVER same AS kept, sha256(line) AS text_sha256
FROM rows WINDOW same AS (PARTITION BY line)
"""


@query("op10_exact_dedup", OP10_SQL)
def op10_exact_dedup(spark: SparkSession, folder: str) -> DataFrame:
    found = exact.exact_duplicates(read_table(spark, folder, "documents"), keep="max")
    return found.withColumnRenamed("id", "doc_id")


@query("op11_spelling")
def op11_spelling(spark: SparkSession, folder: str) -> DataFrame:
    words = written(spelling.count_words(read_table(spark, folder, "documents")), "words")
    return spelling.variants(words)


def _next_centroids(n: int) -> str:
    """The assignment to centroids `n`, and the centroids that follow from it."""
    return f"""
d{n} AS (SELECT r, c, list_sum(list_transform(list_zip(p.v, k.v), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT AS d
    FROM kept p, c{n} k),
a{n} AS (SELECT r, min(d) AS d, arg_min(c, {{'d': d, 'c': c}}) AS c FROM d{n} GROUP BY r),
m{n} AS (SELECT c, i, sum(v[i])::BIGINT AS s, count(*) AS n
    FROM a{n} JOIN kept USING (r), (SELECT unnest(range(1, 65)) AS i) GROUP BY c, i),
u{n} AS (SELECT c, list((s - ((s % n) + n) % n) // n ORDER BY i) AS v FROM m{n} GROUP BY c),
c{n + 1} AS (SELECT k.c, coalesce(u.v, k.v) AS v FROM c{n} k LEFT JOIN u{n} u USING (c))"""


OP12_SQL = f"""
WITH given AS (
    SELECT vec_id, embedding FROM embeddings
    WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
kept AS (
    SELECT row_number() OVER (ORDER BY vec_id, embedding) AS r, vec_id,
        list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM given),
c0 AS (
    SELECT row_number() OVER (ORDER BY h, v) - 1 AS c, v FROM (
        SELECT sha256('1:' || coalesce(CAST(vec_id AS VARCHAR), '')) AS h, v FROM kept ORDER BY h, v LIMIT 16)),
{",".join(_next_centroids(n) for n in range(4))}
SELECT vec_id, CAST(c AS INTEGER) AS cluster, d AS distance,
    CAST(sum(d) OVER (PARTITION BY c) AS BIGINT) AS cluster_inertia, CAST(sum(d) OVER () AS BIGINT) AS inertia,
    sha256(array_to_string(c3.v, ',')) AS centroid_sha256
FROM a3 JOIN kept USING (r) JOIN c3 USING (c)
"""


@query("op12_centroids", OP12_SQL)
def op12_centroids(spark: SparkSession, folder: str) -> DataFrame:
    points = centroids.integer_vectors(read_table(spark, folder, "embeddings"), dim=64, scale=64)
    found, last = centroids.clustered(points, clusters=16, rounds=3, seed=1)
    digests = [sha256(",".join(map(str, c.tolist())).encode()).hexdigest() for c in last]
    digest = F.get(F.array(*map(F.lit, digests)), F.col("cluster")) if digests else F.lit("")
    return centroids.with_inertia(found).select(
        F.col("id").alias("vec_id"), "cluster", "distance", "cluster_inertia", "inertia", digest.alias("centroid_sha256"))


@query("op13_tokens")
def op13_tokens(spark: SparkSession, folder: str) -> DataFrame:
    import public_tokenizers

    vocabulary = tokens.read_vocabulary(public_tokenizers.path("byte_bpe_50k.json"))
    return tokens.token_counts(read_table(spark, folder, "documents"), vocabulary, limit=1024).withColumnRenamed("id", "doc_id")
