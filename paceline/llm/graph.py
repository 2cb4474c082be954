"""Connected components of a graph given as links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paceline.llm.common import written


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Every linked node with the smallest node it can reach: node, root.

    Alternating large-star and small-star steps: each node hands its smallest neighbour to the others, until the links
    are stars, all of them pointing to the smallest node of their component. Steps grow with the logarithm of the longest path; after each the
    links are written to the shared folder. Rows with a null end and links to itself are left out.
    """
    high, low = F.greatest(a, b).alias("u"), F.least(a, b).alias("v")
    links = written(links.where(F.col(a) != F.col(b)).select(high, low).distinct(), "links")
    while True:
        ends = F.array(F.struct(F.col("u").alias("node"), F.lit(1).alias("above")), F.struct(F.col("v").alias("node"), F.lit(0).alias("above")))
        held = links.select(F.inline(ends)).groupBy("node").agg(F.sum("above").alias("above"), F.min("above").alias("least"))
        # A node that is the larger end of one link only, and of no other the smaller, hangs on the top of its component.
        if not held.where("above > 1 or (above = 1 and least = 0)").agg(F.count(F.lit(1))).first()[0]:
            break
        both = links.union(links.select(F.col("v"), F.col("u")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = large.groupBy("u").agg(F.min("v").alias("m"))
        moved = large.join(small, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        links = written(moved.union(small.select("u", F.col("m").alias("v"))).distinct(), "links")
    return links.select(F.col("u").alias("node"), F.col("v").alias("root")).union(links.select("v", "v").distinct())
