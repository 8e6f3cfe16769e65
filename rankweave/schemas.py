"""Table schemas, enums and default settings."""

from __future__ import annotations

from pyspark.sql import types as T

CASES = T.StructType([
    T.StructField("case_id", T.LongType(), False),
    T.StructField("patient_age", T.IntegerType(), False),
    T.StructField("gender", T.StringType(), False),
    T.StructField("chief_complaint", T.StringType(), False),
    T.StructField("symptoms", T.StringType(), False),
    T.StructField("medical_history", T.StringType(), True),
    T.StructField("diagnosis", T.StringType(), False),
    T.StructField("treatment_plan", T.StringType(), False),
    T.StructField("outcome", T.StringType(), True),
    T.StructField("severity", T.StringType(), False),
    T.StructField("length_of_stay", T.IntegerType(), True),
    T.StructField("cost_of_care", T.DecimalType(12, 2), True),
    T.StructField("created_date", T.TimestampType(), False),
    T.StructField("updated_date", T.TimestampType(), True),
])

EMBEDDINGS = T.StructType([
    T.StructField("embedding_id", T.LongType(), False),
    T.StructField("case_id", T.LongType(), False),
    T.StructField("embedding_type", T.StringType(), False),
    T.StructField("embedding", T.ArrayType(T.FloatType(), False), False),
    T.StructField("model_used", T.StringType(), False),
    T.StructField("created_date", T.TimestampType(), False),
])

QUERY_LOG = T.StructType([
    T.StructField("id", T.LongType(), False),
    T.StructField("user_id", T.LongType(), False),
    T.StructField("query_type", T.StringType(), False),
    T.StructField("patient_description", T.StringType(), True),
    T.StructField("keyword_search", T.StringType(), True),
    T.StructField("top_n", T.IntegerType(), True),
    T.StructField("embedding_type", T.StringType(), True),
    T.StructField("vector_weight", T.DoubleType(), True),
    T.StructField("keyword_weight", T.DoubleType(), True),
    T.StructField("latency_ms", T.LongType(), True),
    T.StructField("status", T.StringType(), False),
    T.StructField("error_message", T.StringType(), True),
    T.StructField("created_at", T.TimestampType(), False),
])

CONFIG = T.StructType([
    T.StructField("key", T.StringType(), False),
    T.StructField("value", T.StringType(), False),
    T.StructField("updated_by", T.LongType(), True),
    T.StructField("updated_at", T.TimestampType(), False),
])

# Retrieval rows: every search returns a subset of these, in this order.
RESULT_COLS = [
    ("case_id", "long"), ("patient_age", "int"), ("gender", "string"),
    ("chief_complaint", "string"), ("diagnosis", "string"), ("severity", "string"),
    ("treatment_plan", "string"), ("similarity", "double"), ("vector_distance", "double"),
    ("keyword_score", "double"), ("hybrid_score", "double"),
]
CASE_COLS = [name for name, _ in RESULT_COLS[:7]]

# Names and settings that stored data and callers rely on.
EMBEDDING_TYPES = ("FullCase", "SymptomsOnly", "DiagnosisOnly", "TreatmentOnly", "OutcomeOnly")
QUERY_TYPES = ("rag", "vector", "hybrid")
STATUSES = ("success", "error")
INDEXED_FIELDS = ("chief_complaint", "symptoms", "medical_history", "diagnosis",
                  "treatment_plan", "outcome")
SEARCHED_FIELDS = ("chief_complaint", "symptoms", "diagnosis", "treatment_plan")
DEFAULT_CONFIG = {"top_n": "5", "embedding_type": "FullCase", "vector_weight": "0.6",
                  "keyword_weight": "0.4", "rrf_k": "60"}
CANDIDATES = 50
MISSING_RANK = 9999
