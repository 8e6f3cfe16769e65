from __future__ import annotations

import pytest
from pyspark.sql import types as T

DOCS = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
    T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())])


@pytest.fixture(scope="session")
def table(spark):
    """A documents table from (doc_id, text) or (doc_id, text, source) rows."""
    def make(rows, *more):
        full = [(r[0], r[1], None, r[2] if len(r) > 2 else "s", None if r[1] is None else len(r[1])) for r in rows]
        df = spark.createDataFrame(full, DOCS)
        for name in more:                                # further columns, of names the operators may use themselves
            df = df.selectExpr("*", f"'kept' AS `{name}`")
        return df

    return make


ODD = [
    (1, ""), (2, None), (3, "   \n\t "), (4, "same words here again"), (4, "same words here again"),
    (5, "SAME words here again"), (None, "no id here at all"), (6, "é ß ñ 汉字 😀 naïve"), (7, "x" * 200_000),
    (8, "word " * 40_000), (9, " a b　"), (10, "one"), (11, "1.2.3.4 +1 " + " " * 50_000),
]
