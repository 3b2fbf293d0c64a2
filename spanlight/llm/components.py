"""Connected components of an edge table by alternating large-star and small-star steps.

Edges stay distributed; every round is written to the shared folder. The driver sees two numbers a round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut


def _both_ways(edges: DataFrame) -> DataFrame:
    ends = F.array(F.struct(F.col("u").alias("u"), F.col("v").alias("v")), F.struct(F.col("v").alias("u"), F.col("u").alias("v")))
    return edges.select(F.inline(ends))


def _large_star(edges: DataFrame) -> DataFrame:
    near = _both_ways(edges)
    least = near.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    return near.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    hung = down.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v")
    return hung.union(least.select("u", F.col("m").alias("v"))).distinct()


def _mark(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return row[0], row[1]


def components(edges: DataFrame, u: str, v: str) -> DataFrame:
    """(node, root): root is the smallest node reachable. Only nodes with an edge appear, roots not.

    Nulls and loops are no edges; repeated edges count once. Without edges the result is empty.
    """
    now = cut(edges.select(F.col(u).alias("u"), F.col(v).alias("v")).filter("u <> v").distinct())
    mark = _mark(now)
    while mark[0]:
        now = cut(_small_star(_large_star(now)))
        old, mark = mark, _mark(now)
        if old == mark:
            break
    return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
