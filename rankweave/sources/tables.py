"""Reading, appending and upserting tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rankweave.schemas import CASES, QUERY_LOG

EMBEDDING_STORE = T.StructType([
    T.StructField("case_id", T.LongType()),
    T.StructField("embedding", T.ArrayType(T.FloatType())),
    T.StructField("model_used", T.StringType()),
    T.StructField("created_date", T.TimestampType()),
    T.StructField("embedding_type", T.StringType()),
])


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def read_table_stream(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A given table, one file or a folder of files, as a stream.

    The name is a pattern that matches only itself: Spark takes a plain path for the base of
    partition folders, which a file cannot be, and `pathGlobFilter` asks the files in a folder
    for the name of the table.
    """
    schema = read_table(spark, folder, name).schema
    return spark.readStream.schema(schema).parquet(f"{folder}/{{{name}.parquet}}")


# Fixed value: how a null is written, so that a quoted empty field stays an empty string.
CSV_NULL = "\\N"


def load_cases_csv(spark: SparkSession, path: str, schema: T.StructType = CASES, header: bool = False,
                   multi_line: bool = True) -> DataFrame:
    """Cases from CSV with standard quoting; unreadable rows keep their text in `_corrupt`.

    An unquoted empty field is null, a quoted one an empty string. Quoted line breaks need `multi_line`, which reads each file as one split. Large loads
    should therefore come as many files, or set it to False where fields hold no breaks.
    """
    with_corrupt = T.StructType(
        [T.StructField(f.name, f.dataType, True) for f in schema.fields]
        + [T.StructField("_corrupt", T.StringType(), True)]
    )
    return (
        spark.read.schema(with_corrupt)
        .option("sep", ",").option("header", header).option("quote", '"').option("escape", '"')
        .option("multiLine", multi_line).option("mode", "PERMISSIVE")
        .option("columnNameOfCorruptRecord", "_corrupt").option("emptyValue", "").option("nullValue", CSV_NULL)
        .csv(path)
    )


def write_csv(df: DataFrame, path: str, header: bool = False) -> None:
    """The counterpart of `load_cases_csv`: quotes doubled, null written as `CSV_NULL`."""
    (
        df.write.option("header", header).option("quote", '"').option("escape", '"')
        .option("quoteAll", True).option("emptyValue", "").option("nullValue", CSV_NULL).option("lineSep", "\n").csv(path)
    )


def load_embeddings_csv(spark: SparkSession, path: str, header: bool = False) -> DataFrame:
    """Precomputed vectors: case_id, embedding_type, vector as a JSON array.

    A vector that cannot be read is null and keeps its text in `_corrupt`.
    """
    rows = spark.read.schema("case_id long, embedding_type string, vector string").option("header", header).option(
        "escape", '"').csv(path)
    parsed = rows.withColumn("embedding", F.from_json("vector", "array<float>"))
    bad = F.col("embedding").isNull() | F.exists("embedding", lambda x: x.isNull())
    return parsed.select("case_id", "embedding_type", F.when(~bad, F.col("embedding")).alias("embedding"),
                         F.when(bad, F.col("vector")).alias("_corrupt"))


def ensure_table(spark: SparkSession, path: str, schema: T.StructType, partition_by: Sequence[str] = ()) -> None:
    """Create an empty table unless one is there."""
    spark.createDataFrame([], schema).write.mode("ignore").partitionBy(*partition_by).parquet(path)


def read_or_empty(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def append_query_log(df: DataFrame, path: str) -> None:
    """Append log rows, partitioned by day so time filters prune folders."""
    (
        df.select(*[F.col(f.name).cast(f.dataType) for f in QUERY_LOG.fields])
        .withColumn("event_date", F.to_date("created_at"))
        .write.mode("append").partitionBy("event_date").parquet(path)
    )


def read_query_log(spark: SparkSession, path: str, since: Column | None = None) -> DataFrame:
    """The log, optionally from `since` on; the day predicate prunes partitions."""
    log = spark.read.parquet(path)
    if since is not None:
        log = log.where((F.col("event_date") >= F.to_date(since)) & (F.col("created_at") >= since))
    return log


def one_per_key(df: DataFrame, keys: Sequence[str], order_col: str | None = None) -> DataFrame:
    """One row per key: the greatest by `order_col`, then by the other columns in their order."""
    rest = [c for c in df.columns if c not in keys and c != order_col]
    rest = ([order_col] if order_col and order_col not in keys else []) + rest
    if not rest:
        return df.distinct()
    best = df.groupBy(*keys).agg(F.max(F.struct(*rest)).alias("row"))
    return best.select(*[c if c in keys else F.col(f"row.{c}").alias(c) for c in df.columns])


def missing_rows(new: DataFrame, existing: DataFrame, keys: Sequence[str], order_col: str | None = None) -> DataFrame:
    """Rows of `new` whose key is not in `existing`; of a repeated key the greatest row, by `order_col` first."""
    return one_per_key(new, keys, order_col).join(existing.select(*keys), list(keys), "left_anti")


def append_missing(new: DataFrame, existing: DataFrame, keys: Sequence[str], path: str,
                   partition_by: Sequence[str] = (), order_col: str | None = None) -> None:
    """Insert only what is not there yet; running it again adds nothing."""
    missing_rows(new, existing, keys, order_col).write.mode("append").partitionBy(*partition_by).parquet(path)


def seed_defaults(spark: SparkSession, path: str, schema: T.StructType, rows: DataFrame, key: str) -> None:
    """Create the table if needed and add the default rows whose key is absent."""
    ensure_table(spark, path, schema)
    append_missing(rows, spark.read.schema(schema).parquet(path), [key], path)


def upsert_latest(base: DataFrame, updates: DataFrame, keys: Sequence[str], order_col: str,
                  skip_null: str | None = None) -> DataFrame:
    """One row per key, the newest of base and updates; updates with a null value are skipped.

    An aggregate rather than a window: a key updated millions of times is reduced on the
    map side instead of meeting in one task. Equal times keep the greater row.
    """
    if skip_null:
        updates = updates.where(F.col(skip_null).isNotNull())
    rest = [c for c in base.columns if c not in keys]
    merged = base.unionByName(updates.select(*base.columns))
    newest = F.max(F.struct(order_col, *[c for c in rest if c != order_col])).alias("row")
    return merged.groupBy(*keys).agg(newest).select(*[
        c if c in keys else F.col(f"row.{c}").alias(c) for c in base.columns
    ])


def write_version(df: DataFrame, path: str) -> int:
    """Write the next version of a small table. Earlier versions stay for running readers.

    One writer at a time is required: of two that start together both may take the number.
    """
    spark = df.sparkSession
    number = latest_version(spark, path) + 1
    df.write.parquet(f"{path}/version={number}")
    return number


def latest_version(spark: SparkSession, path: str) -> int:
    """The newest version, -1 if there is none; answered from folder names."""
    try:
        return spark.read.parquet(path).agg(F.max("version")).first()[0]
    except AnalysisException as e:
        if e.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        return -1


def read_version(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    number = latest_version(spark, path) if version is None else version
    return spark.read.parquet(f"{path}/version={number}")


def update_table(path: str, updates: DataFrame, keys: Sequence[str], order_col: str,
                 skip_null: str | None = None) -> DataFrame:
    """Upsert into the newest version and write the result as the next one."""
    spark = updates.sparkSession
    write_version(upsert_latest(read_version(spark, path), updates, keys, order_col, skip_null), path)
    return read_version(spark, path)


def effective_config(defaults: DataFrame, overrides: DataFrame) -> DataFrame:
    """(key, value): the stored value where there is one, else the default."""
    stored = overrides.select("key", F.col("value").alias("stored"))
    return defaults.join(stored, "key", "left").select("key", F.coalesce("stored", "value").alias("value"))


def apply_settings(requests: DataFrame, config: DataFrame) -> DataFrame:
    """`requests` with the settings they leave open taken from (key, value) `config`.

    The few settings reach every row as one scalar.
    """
    kinds = {"top_n": "int", "embedding_type": "string", "vector_weight": "double", "keyword_weight": "double", "rrf_k": "int"}
    one = config.agg(F.struct(*[
        F.max(F.when(F.col("key") == name, F.col("value"))).cast(kind).alias(name) for name, kind in kinds.items()
    ]).alias("s")).scalar()
    return requests.withColumns({
        name: F.coalesce(F.col(name).cast(kind), one[name]) if name in requests.columns else one[name]
        for name, kind in kinds.items()
    })


def config_updates(changes: dict, updated_by: int, now: Column, spark: SparkSession) -> DataFrame:
    """Update rows of one settings change; settings left at None stay out."""
    rows = [(k, str(v)) for k, v in changes.items() if v is not None]
    return spark.createDataFrame(rows, "key string, value string").select(
        "key", "value", F.lit(updated_by).cast("long").alias("updated_by"), now.alias("updated_at")
    )
