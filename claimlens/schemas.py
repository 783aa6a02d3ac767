"""Schemas of the data that the engine reads and writes."""

from __future__ import annotations

from pyspark.sql import types as T

ARTICLE = T.StructType([T.StructField("id", T.StringType()), T.StructField("text", T.StringType()), T.StructField("lines", T.StringType())])
CLAIM = T.StructType(
    [
        T.StructField("id", T.LongType()),
        T.StructField("claim", T.StringType()),
        T.StructField("label", T.StringType()),
        T.StructField("verifiable", T.StringType()),
        T.StructField("evidence", T.ArrayType(T.ArrayType(T.ArrayType(T.StringType())))),
    ]
)
# The closed, ordered set of labels.
LABELS = ("SUPPORTS", "REFUTES", "NOT ENOUGH INFO")
