"""Checks as queries: each returns the rows that break a rule, so an empty result is a pass."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def duplicates(rows: DataFrame, keys: list[str]) -> DataFrame:
    return rows.groupBy(*keys).agg(F.count("*").alias("n")).filter("n > 1")


def missing_keys(expected: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    return expected.select(*keys).join(rows, keys, "left_anti")


def not_in_one_part(rows: DataFrame, key: str, part: str, universe: DataFrame) -> DataFrame:
    """Keys of the universe that lie in no part or in several."""
    n = rows.groupBy(key).agg(F.countDistinct(part).alias("n_parts"))
    return universe.select(key).join(n, key, "left").select(key, F.coalesce("n_parts", F.lit(0)).alias("n_parts")).filter("n_parts <> 1")


def leaks(rows: DataFrame, key: str, others: DataFrame) -> DataFrame:
    """Keys of rows that the others hold too."""
    return rows.select(key).distinct().join(others, key, "left_semi")


def wrong_slices(rows: DataFrame, text: str, start: str, end: str, expected: str) -> DataFrame:
    """Rows whose half-open slice isn't the expected text; nulls are no slice."""
    cut = F.col(text).substr(F.col(start).cast("int") + 1, (F.col(end) - F.col(start)).cast("int"))
    return rows.filter(F.col(start).isNotNull() & ~cut.eqNullSafe(F.col(expected)))


def forbidden_tokens(rows: DataFrame, key: str, columns: list[str], tokens: list[str]) -> DataFrame:
    """(key, column, token) of every forbidden token in a text column, whatever its case."""
    cells = F.explode(F.array(*(F.struct(F.lit(c).alias("column"), F.lower(F.col(c)).alias("text")) for c in columns)))
    hits = rows.select(key, cells.alias("c")).select(key, "c.column", F.explode(F.filter(F.array(*map(F.lit, tokens)), lambda t: F.contains(F.col("c.text"), t))).alias("token"))
    return hits


def counter_differences(reported: DataFrame, recomputed: DataFrame, key: str, value: str) -> DataFrame:
    a, b = reported.select(key, F.col(value).alias("reported")), recomputed.select(key, F.col(value).alias("recomputed"))
    return a.join(b, key, "full_outer").filter(~F.col("reported").eqNullSafe(F.col("recomputed")))


def value_differences(a: DataFrame, b: DataFrame, key: str, columns: list[str], tolerance: float = 1e-9) -> DataFrame:
    """(key, column) that differ; numbers by more than the tolerance, others at all."""

    def differs(c: str) -> Column:
        x, y = F.col(f"a.{c}"), F.col(f"b.{c}")
        if dict(a.dtypes)[c] in ("double", "float"):
            return (x.isNull() != y.isNull()) | F.coalesce(F.abs(x - y) > tolerance, F.lit(False))
        return ~x.eqNullSafe(y)

    joined = a.alias("a").join(b.alias("b"), F.col(f"a.{key}") == F.col(f"b.{key}"))
    found = F.array(*(F.when(differs(c), F.lit(c)) for c in columns))
    return joined.select(F.col(f"a.{key}").alias(key), F.explode(F.array_compact(found)).alias("column"))


def require_empty(problems: DataFrame, what: str) -> None:
    """Raises with the first problem row, if there is one."""
    if found := problems.take(1):
        raise ValueError(f"{what}: {found[0]}")
