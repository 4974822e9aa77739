"""Small tables with nulls, empty and long texts, ties, repeated rows and clashing names."""

from pyspark.sql import types as T

DOCUMENTS = T.StructType(
    [T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())]
)


def documents(spark, rows):
    """rows: (doc_id, text[, source])."""
    return spark.createDataFrame([(r[0], r[1], "en", r[2] if len(r) > 2 else "src0", len(r[1] or "")) for r in rows], DOCUMENTS)


ODD = [
    (1, None, None),
    (2, "", "b"),
    (3, "one two three", "b"),
    (3, "one two three", "b"),
    (None, "one two three", None),
    (4, "déjà vu  \t\n\n ça — 'tis we'll they've it's 123 १२३ 漢字 😀", "a"),
    (5, "x" * 5000 + " " + "word " * 3000, "a"),
    (6, " \n\t ", "a"),
    (7, "Nul \x00 byte and <|endoftext|> and tail   ", "é"),
]
