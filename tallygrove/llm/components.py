"""Connected components of a table of links, by alternating large-star and small-star steps (Kiveris et al., 2014).

Every step is a grouped minimum and an equi-join; no group of neighbours is gathered. Each round is written to the shared
folder, so lineage stays short and a lost executor costs no more than the round at hand.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import dropped, written

MOST_ROUNDS = 60


def _star(links: DataFrame, large: bool) -> DataFrame:
    """Links (u, v), u > v, after one step: each node's neighbours are hung on its smallest one."""
    both = links.union(links.select("v", "u")).toDF("u", "v") if large else links
    least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
    joined = both.join(least, "u")
    out = joined.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")) if large else joined.select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", "m"))
    return out.where("u != v").distinct()


def components(links: DataFrame) -> DataFrame:
    """`node` and `label`, the smallest node of its component, for every node of links (two columns of one type, any names)."""
    a, b = links.columns
    now = written(links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u != v").distinct(), "links")
    mark = None
    for _ in range(MOST_ROUNDS):
        new = written(_star(_star(now, True), False), "links")
        dropped(now.sparkSession, now)
        now = new
        row = now.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(row) == mark:
            break
        mark = tuple(row)
    else:
        raise RuntimeError("components did not settle")
    # Settled links are stars: every node but the label hangs on the label.
    return now.select(F.col("u").alias("node"), F.col("v").alias("label")).union(now.select("v", "v").distinct())
