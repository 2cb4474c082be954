"""Rows that every operator on documents must take."""

from pyspark.sql import DataFrame, SparkSession

#: Names that operators use inside or give back.
CLASHING = ("node", "key", "score", "kept", "digest", "content", "copies", "shard", "rank", "token", "_text", "_id", "ids")
FIELDS = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{c}` string" for c in CLASHING)

LONG = "word " * 20_000 + "end"
ROWS = [
    (1, "the same text for all of us here", "en", "a", 5),
    (2, "the same text for all of us here", None, None, None),
    (2, "the same text for all of us here", None, None, None),
    (3, None, "en", "a", None),
    (4, "", "en", "b", 0),
    (5, " \n\t ", "en", "b", 0),
    (6, LONG, "en", "b", 1),
    (7, "one", "en", "c", 1),
    (None, "no id, but a text", "en", "c", 1),
    (None, None, None, None, None),
    (8, "Éa ñ  ß　中文 😀\x00 ́x", "fr", "c", 1),
    (8, "another text under an id already used", "fr", "c", 1),
]


def documents(spark: SparkSession, rows=ROWS) -> DataFrame:
    return spark.createDataFrame([(*row, *["x"] * len(CLASHING)) for row in rows], FIELDS)


def none(spark: SparkSession) -> DataFrame:
    return documents(spark, [])
