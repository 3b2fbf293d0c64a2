"""Resampling with md5 draws: repeatable, equal in any engine, and distributed over replicates."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.stats import draw


def cluster_sums(rows: DataFrame, cluster: str, value: str) -> DataFrame:
    """(c, s, n, k): each cluster's sum and count, and its place from 0 in order."""
    sums = rows.groupBy(F.col(cluster).alias("c")).agg(F.sum(F.col(value).cast("double")).alias("s"), F.count(value).alias("n"))
    return sums.withColumn("k", F.row_number().over(Window.orderBy("c")) - 1)


def cluster_bootstrap(rows: DataFrame, cluster: str, value: str, replicates: int = 200, seed: int = 42) -> DataFrame:
    """(replicate, mean): whole clusters drawn with replacement, ratio of sums.

    Only the clusters' sums are resampled: rows are summed once, replicates x clusters small rows remain.
    """
    sums = cluster_sums(rows, cluster, value)
    m = sums.agg(F.count("*").alias("m"))
    draws = F.broadcast(m).select("m", F.explode(F.sequence(F.lit(0), F.lit(replicates - 1))).alias("replicate")).select(
        "m", "replicate", F.explode(F.sequence(F.lit(0), F.col("m").cast("int") - 1)).alias("i")
    )
    picked = draws.filter("m > 0").select("replicate", draw(seed, F.col("replicate"), F.col("i"), of=F.col("m")).alias("k"))
    return picked.join(sums, "k").groupBy("replicate").agg((F.sum("s") / F.sum("n")).alias("mean"))


def interval(replicates: DataFrame, value: str = "mean", level: float = 0.95) -> DataFrame:
    """Percentile interval, median and sample deviation over finite replicates."""
    tail = (1 - level) / 2
    ok = replicates.filter(F.col(value).isNotNull() & ~F.isnan(value))
    p = lambda q: F.percentile(value, F.lit(q))
    return ok.agg(p(tail).alias("low"), p(0.5).alias("median"), p(1 - tail).alias("high"), F.stddev_samp(value).alias("std"), F.count("*").alias("n"))


def sign_flip(differences: DataFrame, cluster: str, value: str, replicates: int = 200, seed: int = 7) -> DataFrame:
    """Cluster sign-flip test of a mean difference: p = (as extreme + 1) / (replicates + 1)."""
    sums = cluster_sums(differences, cluster, value)
    seen = sums.agg((F.sum("s") / F.sum("n")).alias("observed"))
    flips = sums.select("c", "k", "s", "n", F.explode(F.sequence(F.lit(0), F.lit(replicates - 1))).alias("replicate"))
    sign = 1 - 2 * draw(seed, F.col("replicate"), F.col("k"), of=F.lit(2))
    means = flips.groupBy("replicate").agg((F.sum(sign * F.col("s")) / F.sum("n")).alias("mean"))
    extreme = F.sum(F.when(F.abs("mean") >= F.abs("observed") - 1e-12, 1).otherwise(0))
    return means.crossJoin(F.broadcast(seen)).groupBy("observed").agg(((extreme + 1) / (F.lit(replicates) + 1)).alias("p"))


def stratified_sample(rows: DataFrame, key: str, stratum: str, size: int, seed: int = 42) -> DataFrame:
    """At most `size` rows of each stratum in md5 order, with their place."""
    order = F.md5(F.concat_ws("|", F.lit(str(seed)), F.col(key).cast("string")))
    w = Window.partitionBy(stratum).orderBy(order, key)
    return rows.withColumn("draw", F.row_number().over(w)).filter(F.col("draw") <= size)


def shortfalls(rows: DataFrame, stratum: str, size: int) -> DataFrame:
    """Strata with fewer rows than asked, and how many are missing."""
    return rows.groupBy(stratum).agg(F.count("*").alias("n")).filter(F.col("n") < size).withColumn("missing", size - F.col("n"))


def hard_negatives(targets: DataFrame, key: str, group: str, seed: int = 11) -> DataFrame:
    """(key, negative): for each row, another row of its group drawn by md5; none in groups of one."""
    w = Window.partitionBy(group).orderBy(key)
    placed = targets.select(key, group, (F.row_number().over(w) - 1).alias("k"), F.count("*").over(Window.partitionBy(group)).alias("m"))
    step = 1 + draw(seed, F.col(key), of=F.greatest(F.col("m") - 1, F.lit(1)))
    want = placed.filter("m > 1").select(F.col(key).alias("key"), F.col(group).alias("g"), ((F.col("k") + step) % F.col("m")).alias("k"))
    pool = placed.select(F.col(key).alias("negative"), F.col(group).alias("g"), "k")
    return want.join(pool, ["g", "k"]).select("key", "negative")


def grouped_folds(rows: DataFrame, group: str, folds: int, seed: int = 5) -> DataFrame:
    """rows with fold: whole groups, dealt by md5 order so that folds hold equally many groups."""
    groups = rows.select(group).distinct()
    order = F.md5(F.concat_ws("|", F.lit(str(seed)), F.col(group).cast("string")))
    dealt = groups.withColumn("fold", ((F.row_number().over(Window.orderBy(order)) - 1) % folds).cast("int"))
    return rows.join(dealt, group)
