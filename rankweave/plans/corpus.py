"""Registered queries of corpus preparation, validation and settings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rankweave.functions.text import compose_text
from rankweave.operators import quality
from rankweave.operators.embed import HashEmbedder, append_embeddings, embed, embed_missing, missing_pairs
from rankweave.operators.prompt import conversation_requests
from rankweave.plans import sql
from rankweave.plans.registry import query
from rankweave.plans.retrieval import REQUESTS
from rankweave.plans.tables import DIM, cases, conversations, embeddings, logs, now
from rankweave.schemas import DEFAULT_CONFIG
from rankweave.session import run_dir
from rankweave.sources import tables

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents",
          "embeddings", "pages", "benchmark", "labels", "conversations")
FULL_TEXT = ("'Patient: ' || patient_age || ' year old ' || gender || '. Chief Complaint: ' || coalesce(chief_complaint, '') || "
             "'. Symptoms: ' || coalesce(symptoms, '') || '. Medical History: ' || coalesce(medical_history, '') || "
             "'. Diagnosis: ' || diagnosis || '. Treatment: ' || treatment_plan || '. Outcome: ' || coalesce(outcome, '')")


def _csv_cases(spark: SparkSession, folder: str) -> DataFrame:
    return cases(spark, folder).select("case_id", "patient_age", "gender", "chief_complaint", "symptoms",
                                       "medical_history", "outcome", "severity")


@query("load_cases_csv", f"""
WITH {sql.CASES}
SELECT case_id, patient_age, gender, chief_complaint, symptoms, medical_history, outcome, severity, NULL::VARCHAR AS _corrupt FROM cases""")
def load_cases_csv(spark: SparkSession, folder: str) -> DataFrame:
    path = run_dir(spark, "csv")
    source = _csv_cases(spark, folder)
    tables.write_csv(source, path)
    return tables.load_cases_csv(spark, path, source.schema)


@query("load_embeddings_csv", """
SELECT vec_id AS case_id, label::VARCHAR AS embedding_type, len(embedding)::INT AS dim,
       round(list_sum(embedding::DOUBLE[]), 6) AS total FROM embeddings""")
def load_embeddings_csv(spark: SparkSession, folder: str) -> DataFrame:
    path = run_dir(spark, "csv")
    source = embeddings(spark, folder).select("case_id", "embedding_type", F.to_json("embedding").alias("vector"))
    tables.write_csv(source, path)
    loaded = tables.load_embeddings_csv(spark, path)
    total = F.aggregate("embedding", F.lit(0.0), lambda acc, x: acc + x.cast("double"))
    return loaded.select("case_id", "embedding_type", F.size("embedding").alias("dim"), F.round(total, 6).alias("total"))


@query("append_query_log", f"""
WITH {sql.LOGS} SELECT id, user_id, latency_ms, status, created_at::DATE AS event_date FROM logs""")
def append_query_log(spark: SparkSession, folder: str) -> DataFrame:
    path = run_dir(spark, "log")
    missing = [f for f in tables.QUERY_LOG.fields if f.name not in logs(spark, folder).columns]
    full = logs(spark, folder).select("*", *[F.lit(None).cast(f.dataType).alias(f.name) for f in missing])
    tables.append_query_log(full.where("status = 'success'"), path)
    tables.append_query_log(full.where("status = 'error'"), path)
    return tables.read_query_log(spark, path).select("id", "user_id", "latency_ms", "status", "event_date")


@query("seed_and_append_missing", """
SELECT c_custkey AS key, c_name AS value FROM customer""")
def seed_and_append_missing(spark: SparkSession, folder: str) -> DataFrame:
    path = run_dir(spark, "seed")
    schema = T.StructType([T.StructField("key", T.LongType()), T.StructField("value", T.StringType())])
    customers = tables.read_table(spark, folder, "customer")
    rows = customers.select(F.col("c_custkey").alias("key"), F.col("c_name").alias("value"))
    earlier = customers.where("c_mktsegment = 'BUILDING'").select(
        F.col("c_custkey").alias("key"), F.col("c_name").alias("value"))
    for batch in (earlier, rows, rows):
        tables.seed_defaults(spark, path, schema, batch, "key")
    return spark.read.parquet(path)


SETTINGS = """base AS (SELECT c_custkey AS key, c_mktsegment AS value, TIMESTAMP '1990-01-01' AS updated_at FROM customer),
upd AS (SELECT user_id AS key, nullif(event_type, 'view') AS value, ts AS updated_at FROM events),
merged AS (SELECT * FROM base UNION ALL SELECT * FROM upd WHERE value IS NOT NULL),
stored AS (SELECT key, value, updated_at FROM merged QUALIFY row_number() OVER (PARTITION BY key ORDER BY updated_at DESC, value DESC) = 1)"""


def _settings_parts(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    base = tables.read_table(spark, folder, "customer").select(
        F.col("c_custkey").alias("key"), F.col("c_mktsegment").alias("value"),
        F.lit("1990-01-01").cast("timestamp_ntz").alias("updated_at"))
    updates = tables.read_table(spark, folder, "events").select(
        F.col("user_id").alias("key"), F.when(F.col("event_type") != "view", F.col("event_type")).alias("value"),
        F.col("ts").alias("updated_at"))
    return base, updates


def _settings(spark: SparkSession, folder: str) -> DataFrame:
    base, updates = _settings_parts(spark, folder)
    return tables.upsert_latest(base, updates, ["key"], "updated_at", skip_null="value")


@query("upsert_latest", f"WITH {SETTINGS} SELECT key, value, updated_at FROM stored")
def upsert_latest(spark: SparkSession, folder: str) -> DataFrame:
    return _settings(spark, folder)


@query("update_table", f"WITH {SETTINGS} SELECT key, value, updated_at FROM stored")
def update_table(spark: SparkSession, folder: str) -> DataFrame:
    path = run_dir(spark, "settings")
    base, updates = _settings_parts(spark, folder)
    tables.write_version(base, path)
    return tables.update_table(path, updates, ["key"], "updated_at", skip_null="value")


@query("config_overlay", f"""
WITH {SETTINGS}, changed AS (SELECT * FROM stored WHERE updated_at > TIMESTAMP '1990-01-01')
SELECT c_custkey AS key, coalesce(s.value, c_mktsegment) AS value FROM customer LEFT JOIN changed s ON s.key = c_custkey""")
def config_overlay(spark: SparkSession, folder: str) -> DataFrame:
    defaults = tables.read_table(spark, folder, "customer").select(
        F.col("c_custkey").alias("key"), F.col("c_mktsegment").alias("value"))
    changed = _settings(spark, folder).where(F.col("updated_at") > F.lit("1990-01-01").cast("timestamp_ntz"))
    return tables.effective_config(defaults, changed)


@query("compose_text", f"""
WITH {sql.CASES}
SELECT case_id, {FULL_TEXT} AS full_case, 'Chief Complaint: ' || coalesce(chief_complaint, '') || '. Symptoms: ' || symptoms AS symptoms_only,
       'Diagnosis: ' || diagnosis AS diagnosis_only,
       CASE WHEN trim(treatment_plan, ' ') <> '' THEN 'Treatment: ' || treatment_plan END AS treatment_only,
       CASE WHEN trim(outcome, ' ') <> '' THEN 'Outcome: ' || outcome END AS outcome_only FROM cases""")
def composed(spark: SparkSession, folder: str) -> DataFrame:
    return cases(spark, folder).select(
        "case_id", compose_text("FullCase").alias("full_case"), compose_text("SymptomsOnly").alias("symptoms_only"),
        compose_text("DiagnosisOnly").alias("diagnosis_only"), compose_text("TreatmentOnly").alias("treatment_only"),
        compose_text("OutcomeOnly").alias("outcome_only"))


def _vector_sql(cte: str) -> str:
    return f"""WITH {sql.CASES}, {cte},
x AS (SELECT case_id, unnest(embedding) AS value, generate_subscripts(embedding, 1) - 1 AS dim FROM v)
SELECT case_id, dim::INT AS dim, round(value, 6) AS value FROM x WHERE value <> 0"""


@query("hash_embed", _vector_sql(sql.hashed("v", "cases", "case_id", "treatment_plan")))
def hash_embed(spark: SparkSession, folder: str) -> DataFrame:
    texts = cases(spark, folder).select("case_id", "treatment_plan")
    return _long(embed(texts, "treatment_plan", HashEmbedder(DIM)))


def _long(vectors: DataFrame) -> DataFrame:
    return vectors.select("case_id", F.posexplode_outer("embedding").alias("dim", "x")).where("x <> 0").select(
        "case_id", "dim", F.round(F.col("x").cast("double"), 6).alias("value"))


@query("embed_missing_pairs", """
SELECT doc_id AS case_id FROM documents WHERE NOT EXISTS (SELECT 1 FROM embeddings WHERE vec_id = doc_id AND label = 3)""")
def embed_missing_pairs(spark: SparkSession, folder: str) -> DataFrame:
    return missing_pairs(cases(spark, folder), embeddings(spark, folder), "3").select("case_id")


UNSTORED = "NOT EXISTS (SELECT 1 FROM embeddings WHERE vec_id = case_id AND label = 3)"


def _stored(spark: SparkSession, folder: str) -> DataFrame:
    """The given vectors; those labelled 3 count as whole-case vectors."""
    kind = F.when(F.col("embedding_type") == "3", "FullCase").otherwise(F.col("embedding_type"))
    return embeddings(spark, folder).withColumn("embedding_type", kind)


@query("embed_missing", _vector_sql(
    f"todo AS (SELECT case_id, {FULL_TEXT} AS t FROM cases WHERE {UNSTORED}), " + sql.hashed("v", "todo", "case_id", "t")))
def embed_missing_vectors(spark: SparkSession, folder: str) -> DataFrame:
    return _long(embed_missing(cases(spark, folder), _stored(spark, folder), "FullCase", HashEmbedder(DIM), now()))


@query("append_embeddings", _vector_sql(
    f"todo AS (SELECT case_id, {FULL_TEXT} AS t FROM cases WHERE {UNSTORED}), " + sql.hashed("v", "todo", "case_id", "t")))
def appended(spark: SparkSession, folder: str) -> DataFrame:
    path = run_dir(spark, "vectors")
    stored = _stored(spark, folder).select(
        "case_id", "embedding", F.lit("given").alias("model_used"),
        now().cast("timestamp").alias("created_date"), "embedding_type")
    stored.write.partitionBy("embedding_type").parquet(path)
    for _ in range(2):                                   # the second run finds nothing to do
        append_embeddings(cases(spark, folder), path, "FullCase", HashEmbedder(DIM), now().cast("timestamp"))
    return _long(spark.read.parquet(path).where("model_used <> 'given'"))


@query("embedding_summary", """
SELECT label::VARCHAR AS embedding_type, count(*) AS total_embeddings, count(DISTINCT vec_id) AS unique_cases
FROM embeddings GROUP BY label""")
def embedding_summary(spark: SparkSession, folder: str) -> DataFrame:
    return quality.embedding_summary(embeddings(spark, folder))


@query("count_by_type", "SELECT label::VARCHAR AS embedding_type, count(*) AS n FROM embeddings GROUP BY label")
def count_by_type(spark: SparkSession, folder: str) -> DataFrame:
    return quality.count_by_type(embeddings(spark, folder))


@query("row_counts", " UNION ALL ".join(f"SELECT '{t}' AS table_name, count(*) AS row_count FROM {t}" for t in TABLES))
def row_counts(spark: SparkSession, folder: str) -> DataFrame:
    return quality.table_counts({t: tables.read_table(spark, folder, t) for t in TABLES})


@query("health_report", " UNION ALL ".join(
    [f"SELECT '{t}' AS object_name, 'OK' AS status, count(*) AS row_count FROM {t}" for t in TABLES]
    + ["SELECT 'absent' AS object_name, 'MISSING' AS status, NULL::BIGINT AS row_count"]))
def health_report(spark: SparkSession, folder: str) -> DataFrame:
    report = quality.health_report(spark, {t: f"{folder}/{t}.parquet" for t in (*TABLES, "absent")})
    counts = quality.table_counts({t: tables.read_table(spark, folder, t) for t in TABLES})
    return report.join(counts.withColumnRenamed("table_name", "object_name"), "object_name", "left")


@query("duplicates", "SELECT user_id, event_type, count(*) AS n FROM events GROUP BY ALL HAVING count(*) > 1")
def duplicates(spark: SparkSession, folder: str) -> DataFrame:
    return quality.find_duplicates(tables.read_table(spark, folder, "events"), ["user_id", "event_type"])


@query("orphans", """
SELECT vec_id AS case_id, label::VARCHAR AS embedding_type FROM embeddings
WHERE NOT EXISTS (SELECT 1 FROM labels WHERE doc_id = vec_id)""")
def orphans(spark: SparkSession, folder: str) -> DataFrame:
    parent = tables.read_table(spark, folder, "labels")
    return quality.find_orphans(embeddings(spark, folder), parent, "case_id", "doc_id").select("case_id", "embedding_type")


@query("orphan_counts", """
SELECT user_id, count(*) AS n FROM events WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = user_id) GROUP BY user_id""")
def orphan_counts(spark: SparkSession, folder: str) -> DataFrame:
    return quality.orphan_counts(tables.read_table(spark, folder, "events"), tables.read_table(spark, folder, "orders"),
                                 "user_id", "o_custkey")


@query("cascade_rewrite", """
SELECT vec_id AS case_id, label::VARCHAR AS embedding_type FROM embeddings WHERE vec_id NOT IN (SELECT vec_id FROM embeddings WHERE label IN (0, 3) AND vec_id % 2 = 0)
  AND label <> 5""")
def cascade_rewrite(spark: SparkSession, folder: str) -> DataFrame:
    """Two types lose half of their rows, one all of them; the stored table is read again."""
    path, rows = run_dir(spark, "stored-vectors"), embeddings(spark, folder)
    rows.write.partitionBy("embedding_type").parquet(path)
    gone = rows.where("embedding_type IN ('0', '3') AND case_id % 2 = 0 OR embedding_type = '5'").select("case_id")
    quality.cascade_rewrite(spark, path, gone, "case_id", "embedding_type")
    schema = "case_id long, embedding_type string"
    return spark.read.schema(schema).parquet(path).select("case_id", "embedding_type")


@query("cascade_delete", """
SELECT vec_id AS case_id, label::VARCHAR AS embedding_type FROM embeddings
WHERE vec_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)""")
def cascade_delete(spark: SparkSession, folder: str) -> DataFrame:
    gone = tables.read_table(spark, folder, "labels").where("toxic = 1").withColumnRenamed("doc_id", "case_id")
    return quality.cascade_delete(embeddings(spark, folder), gone, "case_id").select("case_id", "embedding_type")


@query("enum_violations", """
SELECT event_type AS value, count(*) AS n FROM events WHERE event_type NOT IN ('click', 'view') GROUP BY event_type""")
def enum_violations(spark: SparkSession, folder: str) -> DataFrame:
    return quality.enum_violations(tables.read_table(spark, folder, "events"), "event_type", ("click", "view"))


@query("null_counts", f"""
WITH {sql.CASES}
SELECT count(*) FILTER (chief_complaint IS NULL) AS chief_complaint, count(*) FILTER (medical_history IS NULL) AS medical_history,
       count(*) FILTER (outcome IS NULL) AS outcome FROM cases""")
def null_counts(spark: SparkSession, folder: str) -> DataFrame:
    return quality.null_counts(cases(spark, folder), ["chief_complaint", "medical_history", "outcome"])


@query("wrong_dimension", "SELECT vec_id AS case_id FROM embeddings WHERE embedding IS NULL OR len(embedding) <> 32")
def wrong_dimension(spark: SparkSession, folder: str) -> DataFrame:
    return quality.wrong_dimension(embeddings(spark, folder), 32).select("case_id")


CHECKED = f"""{REQUESTS},
drafts AS (SELECT query_id, query_text, keyword_search, (turn * 40)::INT AS top_n, turn / 8.0::DOUBLE AS vector_weight,
  0.4::DOUBLE AS keyword_weight, (turn % 3)::INT AS rrf_k FROM requests),
checked AS (SELECT query_id, concat_ws(',',
  CASE WHEN length(query_text) < 10 THEN 'query_text' END,
  CASE WHEN length(keyword_search) < 3 OR trim(keyword_search, ' ') = '' THEN 'keyword_search' END,
  CASE WHEN top_n < 1 OR top_n > 100 THEN 'top_n' END, CASE WHEN vector_weight > 1 THEN 'vector_weight' END,
  CASE WHEN rrf_k < 1 THEN 'rrf_k' END) AS reasons FROM drafts)"""


def _drafts(spark: SparkSession, folder: str) -> DataFrame:
    return conversation_requests(conversations(spark, folder)).select(
        (F.col("conv_id") * 1000000 + F.col("turn")).alias("query_id"), "query_text", "keyword_search",
        (F.col("turn") * 40).cast("int").alias("top_n"), (F.col("turn") / F.lit(8.0)).alias("vector_weight"),
        "keyword_weight", (F.col("turn") % 3).cast("int").alias("rrf_k"))


@query("valid_requests", f"WITH {CHECKED} SELECT query_id FROM checked WHERE reasons = ''")
def valid_requests(spark: SparkSession, folder: str) -> DataFrame:
    return quality.split_valid(_drafts(spark, folder))[0].select("query_id")


@query("rejected_requests", f"WITH {CHECKED} SELECT query_id, reasons FROM checked WHERE reasons <> ''")
def rejected_requests(spark: SparkSession, folder: str) -> DataFrame:
    return quality.split_valid(_drafts(spark, folder))[1].select("query_id", F.array_join("reasons", ",").alias("reasons"))


SETTINGS_SQL = f"""{REQUESTS},
open AS (SELECT query_id, CASE WHEN turn % 2 = 0 THEN 7 END AS top_n, CASE WHEN turn % 3 = 0 THEN 0.9::DOUBLE END AS vector_weight FROM requests)"""


@query("requests_with_settings", f"""
WITH {SETTINGS_SQL}
SELECT query_id, coalesce(top_n, (SELECT (max(c_custkey) % 50 + 1)::INT FROM customer)) AS top_n, 'FullCase' AS embedding_type,
       coalesce(vector_weight, 0.6::DOUBLE) AS vector_weight, 0.4::DOUBLE AS keyword_weight, 60 AS rrf_k FROM open""")
def requests_with_settings(spark: SparkSession, folder: str) -> DataFrame:
    """Requests that leave settings open; one stored setting comes from the customer table, the rest are defaults."""
    turns = conversation_requests(conversations(spark, folder))
    requests = turns.select(
        (F.col("conv_id") * 1000000 + F.col("turn")).alias("query_id"),
        F.when(F.col("turn") % 2 == 0, 7).alias("top_n"), F.when(F.col("turn") % 3 == 0, 0.9).alias("vector_weight"))
    defaults = spark.createDataFrame(list(DEFAULT_CONFIG.items()), "key string, value string")
    stored = tables.read_table(spark, folder, "customer").agg(
        (F.max("c_custkey") % 50 + 1).cast("string").alias("value")).select(F.lit("top_n").alias("key"), "value")
    return tables.apply_settings(requests, tables.effective_config(defaults, stored))
