"""Evidence tiers, their counters, and the differences between two runs."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T

TIERS = ("quote", "semantic_high", "semantic_weak", "no_evidence", "person_not_resolved")
SUPPORT_TYPES = ("literal", "literal_short", "semantic")
TRUSTED_WORDS = 6


def tier(resolved: Column, has_units: Column, quote_words: Column, score: Column, threshold: float) -> Column:
    """The five-way tier; at the threshold a score is high."""
    return (
        F.when(~F.coalesce(resolved, F.lit(False)), "person_not_resolved")
        .when(F.coalesce(quote_words, F.lit(0)) >= TRUSTED_WORDS, "quote")
        .when(~F.coalesce(has_units, F.lit(False)) | score.isNull(), "no_evidence")
        .when(score >= threshold, "semantic_high")
        .otherwise("semantic_weak")
    )


def provenance(tier_col: Column) -> Column:
    return F.when(tier_col == "quote", "literal").when(tier_col.isin("semantic_high", "semantic_weak"), "semantic")


def support_type(quote_words: Column, corroborated: Column) -> Column:
    return F.when(quote_words >= TRUSTED_WORDS, "literal").when(corroborated, "literal_short").otherwise("semantic")


def best_overlap(queries: DataFrame, q_id: str, q_text: str, texts: DataFrame, t_text: str, block: int = 20_000) -> DataFrame:
    """(id, score): each query's largest token Jaccard with any text; queries that share no word with one score 0, without texts null.

    Texts stream past the queries' words, so no pair of a query and a text is ever put out: a task gives one number
    a query. Queries come in blocks of that many, each read by the driver and scanned for once.
    """
    spark = queries.sparkSession
    kind = queries.schema[q_id].dataType.simpleString()
    rows = queries.select(F.col(q_id).alias("id"), T.token_set(F.col(q_text)).alias("t"))
    n_blocks = max(1, -(-rows.count() // block))
    words = texts.select(T.token_set(F.coalesce(t_text, F.lit(""))).alias("t"))
    numbered = rows.withColumn("b", F.pmod(F.xxhash64("id", "t"), F.lit(n_blocks))) if n_blocks > 1 else rows.withColumn("b", F.lit(0))
    parts = []
    for b in range(n_blocks):
        own = numbered.filter(F.col("b") == b).select("id", "t").collect()
        shared = spark.sparkContext.broadcast(_postings([r.t or [] for r in own]))

        def run(batches, shared=shared):
            index, at, owners, size = shared.value
            best = np.full(len(size), -1.0)
            for batch in batches:
                for have in batch.column(0).to_pylist():
                    hit = [k for w in have if (k := index.get(w)) is not None]
                    both = np.bincount(np.concatenate([owners[at[k] : at[k + 1]] for k in hit]), minlength=len(size)) if hit else np.zeros(len(size))
                    union = size + len(have) - both
                    np.maximum(best, np.divide(both, union, out=np.zeros(len(size)), where=union > 0), out=best)
            yield pa.RecordBatch.from_arrays([pa.array(range(len(best)), pa.int64()), pa.array(best, pa.float64())], ["k", "score"])

        found = words.mapInArrow(run, "k bigint, score double").groupBy("k").agg(F.max("score").alias("score"))
        ids = spark.createDataFrame([(k, r.id) for k, r in enumerate(own)], f"k bigint, id {kind}")
        parts.append(ids.join(found, "k", "left").select("id", F.when(F.col("score") >= 0, F.col("score")).alias("score")))
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out


def _postings(sets: list[list[str]]) -> tuple[dict[str, int], np.ndarray, np.ndarray, np.ndarray]:
    """Numbers of the words, and of word k the sets that hold it, owners[at[k] : at[k + 1]]; and the size of each set."""
    index: dict[str, int] = {}
    pairs = np.array([(index.setdefault(w, len(index)), k) for k, s in enumerate(sets) for w in s], np.int64).reshape(-1, 2)
    pairs = pairs[np.argsort(pairs[:, 0], kind="stable")]
    return index, np.searchsorted(pairs[:, 0], np.arange(len(index) + 1)), pairs[:, 1], np.array([len(s) for s in sets], float)


def domain_counts(rows: DataFrame, column: str, domain: tuple[str, ...]) -> DataFrame:
    """(value, n) for every value of the domain, zeros too."""
    whole = rows.sparkSession.createDataFrame([(d,) for d in domain], f"{column} string")
    counts = rows.groupBy(column).agg(F.count("*").alias("n"))
    return whole.join(counts, column, "left").select(column, F.coalesce("n", F.lit(0)).alias("n"))


def run_diff(old: DataFrame, new: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """(key, state) of rows that are missing, extra or changed in a column (nulls equal nulls)."""
    a = old.select(key, F.struct(*columns).alias("__a"))
    b = new.select(key, F.struct(*columns).alias("__b"))
    both = a.join(b, key, "full_outer")
    state = F.when(F.col("__b").isNull(), "missing").when(F.col("__a").isNull(), "extra").when(~F.col("__a").eqNullSafe(F.col("__b")), "changed")
    return both.select(key, state.alias("state")).filter("state is not null")


def transitions(old: DataFrame, new: DataFrame, key: str, column: str) -> DataFrame:
    """Counts of (old value, new value)."""
    a, b = old.select(key, F.col(column).alias("old")), new.select(key, F.col(column).alias("new"))
    return a.join(b, key).groupBy("old", "new").agg(F.count("*").alias("n"))


def span_relation(a_start: Column, a_end: Column, b_start: Column, b_end: Column) -> Column:
    """Of span b to span a: same, superset, moved (they touch) or none."""
    return (
        F.when((a_start == b_start) & (a_end == b_end), "same")
        .when((b_start <= a_start) & (b_end >= a_end), "superset")
        .when((b_start < a_end) & (a_start < b_end), "moved")
        .otherwise("none")
    )


def change_kind(old_tier: Column, new_tier: Column, old_text: Column, new_text: Column) -> Column:
    same = old_text.eqNullSafe(new_text)
    return (
        F.when(same & (old_tier == new_tier), "identical")
        .when(same, "tier_only")
        .when((old_tier == "quote") & F.contains(new_text, old_text), "quote_extended")
        .when(old_tier == "quote", "quote_changed")
        .when(F.contains(new_text, old_text), "window_contains")
        .otherwise("window_elsewhere")
    )
