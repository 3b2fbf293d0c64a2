"""Systems against each other on the same queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.stats import draw
from .evaluation import mcnemar_exact


def paired(a: DataFrame, b: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """(key, a_c, b_c, d_c) of rows that both systems have; a key may occur once in each."""
    x = a.select(key, *(F.col(c).alias(f"a_{c}") for c in columns))
    y = b.select(key, *(F.col(c).alias(f"b_{c}") for c in columns))
    return x.join(y, key).select("*", *((F.col(f"b_{c}") - F.col(f"a_{c}")).alias(f"d_{c}") for c in columns))


def summary(pairs: DataFrame, metric: str, hit: str) -> DataFrame:
    """n, mean difference, wins, losses, and McNemar's exact p of the 0/1 column."""
    d, up, down = F.col(f"d_{metric}"), F.sum((F.col(f"d_{hit}") > 0).cast("bigint")), F.sum((F.col(f"d_{hit}") < 0).cast("bigint"))
    one = pairs.agg(F.count("*").alias("n"), F.avg(d).alias("delta"), F.coalesce(up, F.lit(0)).alias("gained"), F.coalesce(down, F.lit(0)).alias("lost"))
    return one.withColumn("p", mcnemar_exact(F.col("gained"), F.col("lost")))


def bootstrap_p(replicates: DataFrame, value: str = "mean") -> DataFrame:
    """Two-sided p of replicates around zero: twice the smaller tail, at most one, never below 1 / (n + 1)."""
    n, low, high = F.count(value), F.sum((F.col(value) <= 0).cast("int")), F.sum((F.col(value) >= 0).cast("int"))
    return replicates.agg(F.least(F.lit(1.0), F.greatest(2 * F.least(low, high) / n, 1 / (n + 1))).alias("p"))


def consensus(rows: DataFrame, votes: list[str], threshold: float = 0.5) -> DataFrame:
    """rows with the share of thresholded votes that are cast, and whether all agree; null votes are not cast."""
    cast = [F.when(F.col(v).isNotNull(), (F.col(v) >= threshold).cast("double")) for v in votes]
    given = F.array_compact(F.array(*cast))
    share = F.aggregate(given, F.lit(0.0), lambda s, x: s + x) / F.size(given)
    return rows.withColumn("votes", F.when(F.size(given) > 0, share)).withColumn("unanimous", F.when(F.size(given) > 0, share.isin(0.0, 1.0)))


def spread_flags(rows: DataFrame, spread: str, label: str, cut: DataFrame) -> DataFrame:
    """Rate of negatives among rows at or above a spread cut (one row, `cut`) and among the others."""
    flagged = rows.crossJoin(F.broadcast(cut)).withColumn("flagged", F.col(spread) >= F.col("cut"))
    return flagged.groupBy("flagged").agg(F.count("*").alias("n"), F.avg(1 - F.col(label)).alias("negative_rate"))


def top_fraction_risk(rows: DataFrame, score: str, correct: str, shares: list[float]) -> DataFrame:
    """(share, kept, precision) of the best max(1, ceil(share n)) rows; rows of a tie at the edge count by their mean."""
    by = rows.groupBy(F.col(score).alias("s")).agg(F.count("*").alias("m"), F.sum(F.col(correct).cast("double")).alias("x"))
    w = Window.orderBy(F.desc("s")).rowsBetween(Window.unboundedPreceding, 0)
    upto = by.select("m", "x", F.sum("m").over(w).alias("upto"))
    want = by.agg(F.sum("m").alias("n")).select(F.explode(F.array(*map(F.lit, shares))).alias("share"), "n")
    want = want.select("share", F.greatest(F.lit(1), F.least(F.col("n"), F.ceil(F.col("share") * F.col("n") - 1e-9))).alias("kept"))
    part = F.greatest(F.lit(0), F.least(F.col("m"), F.col("kept") - (F.col("upto") - F.col("m"))))
    return upto.crossJoin(F.broadcast(want)).groupBy("share", "kept").agg((F.sum(F.col("x") * part / F.col("m")) / F.col("kept")).alias("precision"))


def null_draws(pool: DataFrame, key: str, count: int, seed: int) -> DataFrame:
    """(draw, key): `count` md5 draws with replacement from a pool in key order."""
    placed = pool.select(key, (F.row_number().over(Window.orderBy(key)) - 1).alias("k"))
    n = F.broadcast(pool.agg(F.count("*").alias("n"))).filter("n > 0")
    draws = n.select("n", F.explode(F.sequence(F.lit(0), F.lit(count - 1))).alias("draw")).select("draw", draw(seed, F.col("draw"), of=F.col("n")).alias("k"))
    return draws.join(placed, "k").select("draw", key)


def anonymous_order(rows: DataFrame, key: str, seed: int) -> DataFrame:
    """rows with item_id, their place in md5 order from 1: a blind sheet's order."""
    order = F.md5(F.concat_ws("|", F.lit(str(seed)), F.col(key).cast("string")))
    return rows.withColumn("item_id", F.row_number().over(Window.orderBy(order, key)))
