"""Rows that every operator has to bear."""

from pyspark.sql import types as T

SCHEMA = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
    T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()), T.StructField("fp", T.StringType()),
    T.StructField("score", T.StringType()), T.StructField("key", T.StringType()), T.StructField("node", T.StringType()),
])

ODD = [
    (1, None), (2, ""), (3, " \n\t "), (4, "one"), (5, "one two"), (6, "a b c d e f g"), (7, "a b c d e f g"), (7, "a b c d e f g"),
    (None, "no id here"), (None, None), (8, "x" * 50_000), (9, "lorem ipsum dolor " * 4000), (-5, "Ünïcode ßtraße 日本語 👩‍👩‍👧   end"),
    (10, "mail bob@example.com, call +1 (555) 555-1234 or 10.0.0.255; card 4111 1111 1111 1111."), (11, "\0 control \x0b\x0c chars"),
]


def documents(spark, rows=None):
    rows = ODD if rows is None else rows
    return spark.createDataFrame([(i, t, "en", "s", None if t is None else len(t), "f", "s", "k", "n") for i, t in rows], SCHEMA)
