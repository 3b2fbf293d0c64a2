"""Date-based splits: where to cut, who goes where, and what must hold."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def cut_candidates(days: DataFrame, day: str) -> DataFrame:
    """(day, n, upto, fraction, next_day, gap_days) of every distinct day."""
    per_day = days.filter(F.col(day).isNotNull()).groupBy(F.col(day).alias("day")).agg(F.count("*").alias("n"))
    w = Window.orderBy("day")
    rows = per_day.select("day", "n", F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("upto"), F.lead("day").over(w).alias("next_day"))
    total = F.broadcast(per_day.agg(F.sum("n").alias("total")))
    return rows.crossJoin(total).select("day", "n", "upto", (F.col("upto") / F.col("total")).alias("fraction"), "next_day", F.datediff("next_day", "day").alias("gap_days"))


def choose_cut(candidates: DataFrame, target: float, min_gap: int = 1) -> DataFrame:
    """The day whose fraction is nearest to the target among those with the gap behind; larger gap, then earlier day on ties."""
    ok = candidates.filter(F.col("gap_days") >= min_gap).withColumn("distance", F.round(F.abs(F.col("fraction") - target), 12))
    return ok.orderBy("distance", F.desc("gap_days"), "day").limit(1)


def assign(rows: DataFrame, day: str, train_end: DataFrame, validation_end: DataFrame) -> DataFrame:
    """rows with split: train, validation or test by their day and two one-row tables of cuts; null days have none."""
    cuts = train_end.select(F.col("day").alias("__t")).crossJoin(validation_end.select(F.col("day").alias("__v")))
    split = F.when(F.col(day) <= F.col("__t"), "train").when(F.col(day) <= F.col("__v"), "validation").when(F.col(day).isNotNull(), "test")
    return rows.crossJoin(F.broadcast(cuts)).withColumn("split", split).drop("__t", "__v")


def calendar(rows: DataFrame, day: str, groups: list[str]) -> DataFrame:
    """First and last day, distinct days and the most rows of one day."""
    per_day = rows.groupBy(*groups, day).agg(F.count("*").alias("n"))
    return per_day.groupBy(*groups).agg(F.min(day).alias("first_day"), F.max(day).alias("last_day"), F.count("*").alias("days"), F.max("n").alias("max_per_day"), F.sum("n").alias("n"))


def key_overlap(rows: DataFrame, key: str, split: str) -> DataFrame:
    """How many keys occur in each set of splits."""
    sets = rows.groupBy(key).agg(F.concat_ws("+", F.array_sort(F.collect_set(split))).alias("splits"))
    return sets.groupBy("splits").agg(F.count("*").alias("n"))


def straddling_days(rows: DataFrame, day: str, split: str) -> DataFrame:
    """Days that occur in two splits or more."""
    return rows.groupBy(day).agg(F.countDistinct(split).alias("n_splits")).filter("n_splits > 1")


def order_problems(calendars: DataFrame, min_gap: int = 1) -> DataFrame:
    """Neighbouring splits (by first day) that overlap or are too close."""
    w = Window.orderBy("first_day")
    rows = calendars.withColumn("next_first", F.lead("first_day").over(w)).withColumn("gap", F.datediff("next_first", "last_day"))
    return rows.filter(F.col("gap") < min_gap)


WEEKDAYS = ("monday", "tuesday", "wednesday", "thursday", "friday", "saturday", "sunday")


def mention_date(published, day):
    """The latest date up to 30 days before a date that has this day of the month."""
    back = F.sequence(F.lit(0), F.lit(30))
    dates = F.filter(F.transform(back, lambda k: F.date_sub(published, k)), lambda d: F.dayofmonth(d) == day)
    return F.get(dates, F.lit(0))


def weekday_agrees(date, name):
    """Whether a date falls on a weekday by name, Monday first."""
    return F.get(F.array(*map(F.lit, WEEKDAYS)), F.weekday(date)) == F.lower(name)
