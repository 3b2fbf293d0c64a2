"""Speakers collected over texts: words, roles, majorities, recurrence."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T

CHAIR_MIN_WORDS = 10


def drop_reason(turns: DataFrame, role: str, text: str, chair: str, least: int = CHAIR_MIN_WORDS) -> DataFrame:
    """turns with reason: the first that applies of empty, stage direction, short chair turn; null keeps a turn."""
    n = T.word_count(F.col(text))
    why = F.when(F.col(text).isNull() | (n == 0), "empty").when(T.is_stage_direction(F.col(text)), "stage_direction").when((F.col(role) == chair) & (n < least), "short_chair")
    return turns.withColumn("n_words", n).withColumn("reason", why)


def words_by(turns: DataFrame, keys: list[str], text: str) -> DataFrame:
    return turns.groupBy(*keys).agg(F.sum(T.word_count(F.col(text))).cast("bigint").alias("words"), F.count("*").alias("turns"))


def shares(rows: DataFrame, value: str) -> DataFrame:
    """rows with their share of the whole sum."""
    total = F.broadcast(rows.agg(F.sum(value).alias("__total")))
    return rows.crossJoin(total).withColumn("share", F.col(value) / F.col("__total")).drop("__total")


def majority(rows: DataFrame, key: str, owner: str) -> DataFrame:
    """Of each key the most frequent owner, the smallest on ties, and its count; null owners don't count."""
    counts = rows.filter(F.col(owner).isNotNull()).groupBy(key, owner).agg(F.count("*").alias("n"))
    w = Window.partitionBy(key).orderBy(F.desc("n"), owner)
    return counts.withColumn("k", F.row_number().over(w)).filter("k = 1").drop("k")


def group_histogram(rows: DataFrame, key: str, group: str) -> DataFrame:
    """How many keys occur in how many groups."""
    per_key = rows.groupBy(key).agg(F.countDistinct(group).alias("groups"))
    return per_key.groupBy("groups").agg(F.count("*").alias("keys"))


def at_least(histogram: DataFrame) -> DataFrame:
    """A histogram (groups, keys) with the keys at that many groups or more."""
    return histogram.withColumn("keys_at_least", F.sum("keys").over(Window.orderBy(F.desc("groups")).rowsBetween(Window.unboundedPreceding, 0)))


def cut_sweep(rows: DataFrame, value: str, cuts: list[int]) -> DataFrame:
    """(cut, kept, sum) of rows at or above each cut, from one pass."""
    each = rows.select(F.col(value).alias("v"), F.explode(F.array(*map(F.lit, cuts))).alias("cut"))
    return each.groupBy("cut").agg(F.sum((F.col("v") >= F.col("cut")).cast("bigint")).alias("kept"), F.coalesce(F.sum(F.when(F.col("v") >= F.col("cut"), F.col("v"))), F.lit(0)).cast("bigint").alias("total"))


def distribution(rows: DataFrame, value: str, groups: list[str]) -> DataFrame:
    """Count, least, quartiles (linear), largest and mean."""
    p = lambda q: F.percentile(F.col(value).cast("double"), F.lit(q))
    v = F.col(value).cast("double")
    return rows.groupBy(*groups).agg(F.count(value).alias("n"), F.min(v).alias("low"), p(0.25).alias("q25"), p(0.5).alias("median"), p(0.75).alias("q75"), F.max(v).alias("high"), F.avg(v).alias("mean"))


def lower_quantile(rows: DataFrame, value: str, shares_: list[float]) -> DataFrame:
    """(q, value): the sorted value at index int(n q), not interpolated."""
    counts = rows.groupBy(F.col(value).alias("v")).agg(F.count("*").alias("m"))
    upto = counts.withColumn("upto", F.sum("m").over(Window.orderBy("v").rowsBetween(Window.unboundedPreceding, 0)))
    n = F.broadcast(counts.agg(F.sum("m").alias("n")))
    want = F.explode(F.array(*map(F.lit, shares_))).alias("q")
    at = n.select("n", want).select("q", F.least(F.floor(F.col("n") * F.col("q")), F.col("n") - 1).alias("index"))
    return upto.join(F.broadcast(at), F.col("upto") > F.col("index")).groupBy("q").agg(F.min("v").alias("value"))


def fixed_histogram(rows: DataFrame, value: str, width: float) -> DataFrame:
    return rows.filter(F.col(value).isNotNull()).groupBy(F.floor(F.col(value) / width).cast("bigint").alias("bin")).agg(F.count("*").alias("n"))


def with_all(rows: DataFrame, group: str, aggregates: list) -> DataFrame:
    """Aggregates by group and over all, the latter under `all`."""
    return rows.cube(group).agg(*aggregates, F.grouping(group).alias("__g")).withColumn(group, F.when(F.col("__g") == 1, "all").otherwise(F.col(group))).drop("__g")
