"""Shards that all hold the same mixture: proportional stratified interleaving.

DataFrame functions only. Rows are shuffled inside each source by a seeded hash and ranked; the fractional rank
(rank - offset) / rows of the source puts all sources on one line, on which any stretch holds each source in proportion.
The line is cut into shards of equal row counts. The offset is drawn per source, so that sources of one row spread out
instead of meeting in the middle.

Neither ranking needs a source in one task: rows are dealt to ranges of the hash, whose sizes are counted first, and a
rank is the count of the ranges before plus the place in the own range. The text is read once; later steps move
a slim table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paceline.llm.common import text_or_empty, written

#: Bits of a seeded hash: seven less than a long has, so that sums and products stay exact.
BITS = 56


def seeded(seed: int, *parts: Column) -> Column:
    """A uniform integer below 2 ** BITS."""
    digest = F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.coalesce(p.cast("string"), F.lit("-")) for p in parts]))
    return F.conv(F.substring(digest, 1, BITS // 4), 16, 10).cast("long")


def shards(
    docs: DataFrame,
    n_shards: int = 16,
    seed: int = 20,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    rows_per_range: int = 20_000,
) -> DataFrame:
    """Every row with its shard and its slot there; the law is `rows`: shard sizes differ by one at most.

    Returns doc_id, size, text_crc32, law, shard, slot, grown_shard, source. Equal texts may go to different shards,
    since a group of copies can be larger than a shard. A null text has size 1 and the checksum of the empty text; null
    sources form one source; rows with equal ids are ordered by checksum and size, and full repeats are interchangeable.
    No rows give no rows; other columns are not read.
    """
    text = text_or_empty(text_col)
    slim = docs.select(
        F.col(id_col).alias("doc_id"),
        F.col(source_col).alias("source"),
        (F.octet_length(text).cast("long") + 1).alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
    ).withColumn("key", seeded(seed, F.col("doc_id"), F.col("text_crc32")))
    slim = written(slim, "shard-rows")
    total = slim.count()
    ranges = max(1, -(-total // rows_per_range))

    # Rank inside the source, by ranges of the hash.
    width = -(-(1 << BITS) // ranges)
    dealt = slim.withColumn("range", F.expr(f"key div {width}L"))
    by_source = Window.partitionBy("source")
    sizes = dealt.groupBy("source", "range").agg(F.count(F.lit(1)).alias("n")).select(
        "source",
        "range",
        (F.sum("n").over(by_source.orderBy("range")) - F.col("n")).alias("before"),
        F.sum("n").over(by_source).alias("source_rows"),
    )
    place = F.row_number().over(Window.partitionBy("source", "range").orderBy("key", "doc_id", "text_crc32", "size"))
    same = F.col("d.source").eqNullSafe(F.col("s.source")) & (F.col("d.range") == F.col("s.range"))
    ranked = dealt.withColumn("place", place).alias("d").join(sizes.alias("s"), same).select(
        "d.doc_id", "d.source", "size", "text_crc32", (F.col("before") + F.col("place")).alias("rank"), "source_rows"
    )
    offset = (seeded(seed, F.col("source"), F.lit("offset")) + 1) / F.lit(float(1 << BITS))
    line = written(ranked.withColumn("share", (F.col("rank") - offset) / F.col("source_rows")), "shard-line")

    # Position on the line, by ranges of the share.
    line = line.withColumn("range", F.least(F.floor(F.col("share") * ranges), F.lit(ranges - 1)))
    counted = line.groupBy("range").agg(F.count(F.lit(1)).alias("n"))
    # One row per `rows_per_range` rows.
    before = counted.select("range", (F.sum("n").over(Window.orderBy("range")) - F.col("n")).alias("before"))
    place = F.row_number().over(Window.partitionBy("range").orderBy("share", "source", "rank"))
    position = (F.col("before") + F.col("place") - 1).alias("position")
    at = line.withColumn("place", place).join(before, "range").select("*", position)
    shard = F.expr(f"cast((position * {n_shards}L) div {max(total, 1)}L as int)")
    first = F.expr(f"(shard * {total}L + {n_shards - 1}L) div {n_shards}L")
    return at.withColumn("shard", shard).select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("rows").alias("law"),
        "shard",
        (F.col("position") - first).alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
        "source",
    )
