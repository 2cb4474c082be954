"""Exact duplicates: a 128-bit content hash groups, the bytes decide.

DataFrame functions only. The text travels once, combined before the shuffle: rows are grouped by hash and text
together, so equal hashes of different bytes never meet in one group. What goes back to the rows is joined by digests
of 48 bytes; should two different texts ever share both digests, the query fails instead of merging them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paceline.llm.common import text_or_empty, written


def groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per distinct text that occurs more than once: digests, rows in the group, largest id."""
    text = text_or_empty(text_col)
    rows = docs.select(F.col(id_col).alias("_id"), F.unhex(F.md5(text)).alias("content"), text.alias("_text"))
    by_bytes = rows.groupBy("content", "_text").agg(F.count(F.lit(1)).alias("group_size"), F.max("_id").alias("keep_id"))
    by_digest = by_bytes.groupBy("content", F.unhex(F.sha2("_text", 256)).alias("digest")).agg(
        F.count(F.lit(1)).alias("texts"), F.sum("group_size").alias("group_size"), F.max("keep_id").alias("keep_id")
    )
    one = F.when(F.col("texts") == 1, F.col("group_size")).otherwise(
        F.raise_error(F.lit("different texts share both digests")).cast("long")
    )
    return by_digest.select("content", "digest", one.alias("group_size"), "keep_id").where("group_size > 1")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every row with the row of the same text that stays: the one with the largest id.

    Returns doc_id, keep_id, group_size, kept, text_sha256. A null text counts as empty. A null id is smaller than any
    other; where all ids of a text are null, keep_id is null. Of rows that repeat both id and text one stays. No rows
    give no rows; other columns are not read.
    """
    text = text_or_empty(text_col)
    rows = docs.select(
        F.col(id_col).alias("doc_id"), F.unhex(F.md5(text)).alias("content"), F.unhex(F.sha2(text, 256)).alias("digest")
    )
    # Repeated rows are counted, so that exactly one of them can stay.
    rows = rows.groupBy("doc_id", "content", "digest").agg(F.count(F.lit(1)).alias("copies"))
    # Read back as a table, the groups are joined by a plain exchange, whose partition of a hot group Spark can split.
    found = rows.join(written(groups(docs, id_col, text_col), "copy-groups"), ["content", "digest"], "left")
    alone = F.col("group_size").isNull()
    keep = F.when(alone, F.col("doc_id")).otherwise(F.col("keep_id"))
    return found.select(
        "doc_id",
        keep.alias("keep_id"),
        F.coalesce("group_size", F.lit(1).cast("long")).alias("group_size"),
        F.lower(F.hex("digest")).alias("text_sha256"),
        F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))).alias("_copy"),
    ).select(
        "doc_id",
        "keep_id",
        "group_size",
        (F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("_copy") == 1)).alias("kept"),
        "text_sha256",
    )


def unique_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of `docs` that stay, with all their columns; one shuffle.

    Of rows that share text and largest id, the one with the largest other columns stays. A kept null text stays null
    only if no row of its group is the empty text.
    """
    others = [c for c in docs.columns if c not in (id_col, text_col)]
    text = text_or_empty(text_col)
    rows = docs.select(
        F.unhex(F.md5(text)).alias("_content"),
        text.alias("_text"),
        F.struct(F.col(id_col), F.col(text_col).isNotNull().alias("_given"), *others).alias("_row"),
    )
    best = rows.groupBy("_content", "_text").agg(F.max("_row").alias("_row"))
    cells = {c: F.col("_row").getField(c) for c in (id_col, *others)}
    cells[text_col] = F.when(F.col("_row").getField("_given"), F.col("_text"))
    return best.select(*[cells[c].alias(c) for c in docs.columns])
