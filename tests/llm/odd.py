"""Rows with nulls, empty and long texts, ties, repeats and columns whose names clash with internal ones."""

from pyspark.sql import functions as F

CLASHING = ("n_words", "fp", "host", "size", "copies", "h", "rest", "text_hash", "n", "key", "score", "kept", "component",
            "rate", "taken", "prior", "cut", "spans", "items", "known", "base", "token", "rule", "archive", "payload", "formatted", "parts")
LONG = " ".join(f"word{i % 977} of{i % 31}" for i in range(30_000))
WORDS = "the quick brown fox jumps over a lazy dog while seven green birds sing in an old tree by the river today"
DOCS = [
    (1, WORDS, "en", "a"), (1, WORDS, "en", "a"), (2, WORDS, "en", None), (3, None, "en", "a"), (4, "", None, "b"), (5, " \n\t ", "fr", None),
    (None, WORDS + " again", None, "b"), (None, WORDS + " again", None, "b"), (6, LONG, "en", "a"), (7, "1234 --", "de", "b"),
    (8, "Größe und Straße für alle", "de", "é"), (9, "one", None, None), (10, "one", "en", "a"),
]


def docs(spark, rows=None):
    table = spark.createDataFrame(DOCS if rows is None else rows, "doc_id long, text string, lang string, source string")
    table = table.withColumn("n_chars", F.length("text").cast("long"))
    return table.select("*", *[F.lit(f"x {c}").alias(c) for c in CLASHING])


def empty(spark):
    return docs(spark).filter("false")


def same_rows(a, b):
    """Whether two tables have the same rows, repeats counted."""
    return a.exceptAll(b.select(*a.columns)).isEmpty() and b.exceptAll(a.select(*b.columns)).isEmpty()
