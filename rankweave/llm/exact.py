"""Exact duplicates by sorting the texts themselves, with DataFrame functions only.

The normalised texts are range-partitioned: Spark samples them, picks splitters and sends
each range to a task of its own, which sorts it, on disk where memory ends. A splitter holds
the first characters of a text and a hash of all of it, so what the driver samples does not
grow with the texts. Equal texts then stand next to each other in one range and are compared
in full: a row opens a run where its whole text differs from the row before, and each run
gives its winner and its length.

A text whose copies weigh more than `HOT` bytes would make one range too large. Bytes are
counted by hash beforehand, and such a text ends its splitter with a salt of the id, one salt
for each `HOT` bytes. Its few runs are put together by their SHA-256; the run of any other
text is whole already.

Texts are equal when identical after lower-casing A-Z only; null counts as empty. A row
without an id wins only where no row of the group has one. Of rows that repeat the winning id
all are flagged, and `deduplicated` returns one of them.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankweave.session import written

#: bytes of one text's copies from which they are cut into several ranges, and what a row weighs beside its text
HOT, ROW = 1 << 20, 256
#: characters of a text in a splitter
PREFIX = 32


def normalised(text: Column | str) -> Column:
    """A-Z in lower case, nothing else changed, null as empty."""
    text = F.col(text) if isinstance(text, str) else text
    text = F.coalesce(text.cast("string"), F.lit(""))
    plain = F.octet_length(text) == F.length(text)       # ASCII only, where `lower` does the same, faster
    return F.when(plain, F.lower(text)).otherwise(
        F.translate(text, string.ascii_uppercase, string.ascii_lowercase))


def hot_texts(rows: DataFrame, hot: int = HOT) -> DataFrame:
    """(whole, salts) of the hashes whose copies weigh more than `hot` bytes together.

    At most one row for each `hot` bytes of the corpus.
    """
    sums = rows.groupBy("whole").agg(F.count("*").alias("n"), F.sum("size").alias("size"))
    salts = F.least("n", F.ceil(F.col("size") / hot)).cast("int")
    return sums.where((F.col("n") > 1) & (F.col("size") > hot)).select("whole", salts.alias("salts"))


def sorted_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "min",
                hot: int = HOT) -> DataFrame:
    """(line, salt, keep_id, n) of every run of equal neighbours; a text that is not hot has one run."""
    pick = {"min": F.min, "max": F.max}[keep]
    rows = docs.select(F.col(id_col).alias("id"), normalised(text_col).alias("line"))
    rows = rows.withColumn("whole", F.xxhash64("line"))
    # written first, so that Spark broadcasts it only where it is small
    salted = written(hot_texts(rows.select("whole", (F.octet_length("line") + ROW).alias("size")), hot), "hot-texts")
    salt = F.pmod(F.xxhash64("id"), F.coalesce("salts", F.lit(1))).cast("int")
    rows = rows.join(salted, "whole", "left").select(
        "id", "line", F.substring("line", 1, PREFIX).alias("head"), "whole", salt.alias("salt"))
    ranges = rows.repartitionByRange("head", "whole", "salt").sortWithinPartitions("head", "whole", "salt", "line")
    # A struct cannot be summed up in a hash table: Spark compares each row with the one before.
    some = F.when(F.col("id").isNotNull(), F.struct("id"))
    return ranges.groupBy("head", "whole", "salt", "line").agg(pick(some)["id"].alias("keep_id"), F.count("*").alias("n"))


def runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "min",
         hot: int = HOT) -> DataFrame:
    """(text_sha256, keep_id, group_size) of every distinct text, found by sorting."""
    pick = {"min": F.min, "max": F.max}[keep]
    found = sorted_runs(docs, id_col, text_col, keep, hot).select(F.sha2("line", 256).alias("text_sha256"), "keep_id", "n")
    return found.groupBy("text_sha256").agg(pick("keep_id").alias("keep_id"), F.sum("n").alias("group_size"))


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "min") -> DataFrame:
    """(id, keep_id, group_size, kept, text_sha256) of every row, dropped ones too.

    `keep` says whether the smallest or the largest id of equal texts stays.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.sha2(normalised(text_col), 256).alias("text_sha256"))
    # written first, so that both sides of the join come straight from a shuffle and a hot text can be split
    found = rows.join(written(runs(docs, id_col, text_col, keep), "runs"), "text_sha256")
    return found.select("id", "keep_id", "group_size", F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"),
                        "text_sha256")


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "min") -> DataFrame:
    """The row of `docs` that stays of each text, all columns as they were."""
    key, digest = "row_key", "row_sha256"
    while {key, digest} & {c.lower() for c in docs.columns}:
        key, digest = key + "_", digest + "_"
    as_key = F.coalesce(F.concat(F.lit("="), F.col(id_col).cast("string")), F.lit(""))
    winners = runs(docs, id_col, text_col, keep).select(
        F.coalesce(F.concat(F.lit("="), F.col("keep_id").cast("string")), F.lit("")).alias(key),
        F.col("text_sha256").alias(digest))
    rows = docs.withColumns({key: as_key, digest: F.sha2(normalised(text_col), 256)})
    return rows.join(winners, [key, digest], "left_semi").dropDuplicates([key, digest]).select(*docs.columns)
