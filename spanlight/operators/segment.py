"""Turns, sentences, sliding windows and their spans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T

# Fixed value: a turn opens with an article, a name in capitals, perhaps a parenthesis, and a dash.
TURN_HEADER = r"(?U)(?:O\s+SR\.|A\s+SRA\.)\s*([A-ZÀ-Ü][A-ZÀ-Ü.\s]{0,60}?)\s*(?:\(([^)]*)\))?\s*-\s?"


def turns(hearings: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """One row a turn: (id, turn, raw_name, info, speech, start_char, end_char), half-open spans of the trimmed speech.

    A text without a header, null or empty, has none. The header's end is found by splitting, so offsets count
    code points.
    """
    mark = "\x03"
    marked = F.regexp_replace(F.col(text_col), TURN_HEADER, f"{mark}$0{mark}")
    parts = hearings.select(F.col(id_col).alias("id"), F.posexplode(F.split(marked, mark)).alias("k", "part"))
    w = Window.partitionBy("id").orderBy("k")
    placed = parts.withColumn("at", F.coalesce(F.sum(F.length("part")).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    placed = placed.withColumn("header", F.lag("part").over(w)).filter((F.col("k") % 2 == 0) & (F.col("k") > 0))
    lead = F.length("part") - F.length(F.regexp_replace("part", r"^(?U:\s+)", ""))
    speech = F.regexp_replace(F.regexp_replace("part", r"^(?U:\s+)", ""), r"(?U:\s+)$", "")
    info = F.regexp_extract("header", TURN_HEADER, 2)
    return placed.select(
        "id",
        (F.col("k") / 2 - 1).cast("int").alias("turn"),
        F.trim(F.regexp_extract("header", TURN_HEADER, 1)).alias("raw_name"),
        F.when(info != "", info).alias("info"),
        speech.alias("speech"),
        (F.col("at") + lead).cast("bigint").alias("start_char"),
        (F.col("at") + lead + F.length(speech)).cast("bigint").alias("end_char"),
    )


def sentences(texts: DataFrame, keys: list[str], text_col: str) -> DataFrame:
    """keys, position (from 0 among sentences) and sentence."""
    return texts.select(*keys, F.posexplode(T.sentences(F.col(text_col))).alias("position", "sentence"))


def part_spans(texts: DataFrame, keys: list[str], text_col: str) -> DataFrame:
    """keys, position, part, start_char, end_char of every part, boundaries excluded.

    Each part is searched behind its predecessors: their lengths and one character of each boundary are a lower bound.
    """
    cut = texts.select(*keys, F.col(text_col).alias("__t"), F.posexplode(T.sentence_parts(F.col(text_col))).alias("position", "part"))
    w = Window.partitionBy(*keys).orderBy("position").rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum(F.length("part") + 1).over(w), F.lit(0))
    at = cut.withColumn("__before", before).withColumn("__s", F.expr("locate(part, __t, 1 + cast(__before as int))").cast("bigint") - 1)
    return at.select(*keys, "position", "part", F.col("__s").alias("start_char"), (F.col("__s") + F.length("part")).alias("end_char"))


def windows(rows: DataFrame, group: list[str], size: int, order: str = "position", text: str = "sentence") -> DataFrame:
    """group, first, last, text of each `size` neighbours, stride 1; a shorter group gives one window of all it has."""
    w = Window.partitionBy(*group).orderBy(order)
    ahead = w.rowsBetween(0, size - 1)
    found = rows.select(
        *group,
        F.col(order).alias("first"),
        F.last(order).over(ahead).alias("last"),
        F.count("*").over(ahead).alias("__n"),
        F.array_join(F.collect_list(text).over(ahead), " ").alias("text"),
        F.row_number().over(w).alias("__k"),
    )
    return found.filter(f"__n = {size} or __k = 1").drop("__n", "__k")


def unit_kinds(texts: DataFrame, keys: list[str], text_col: str) -> DataFrame:
    """The union of whole texts, sentences and windows of two and three, with their kind and id."""
    parts = sentences(texts, keys, text_col)
    kinds = [
        texts.select(*keys, F.lit("turn").alias("kind"), F.lit(0).alias("first"), F.lit(0).alias("last"), T.normalize_whitespace(F.col(text_col)).alias("text")),
        parts.select(*keys, F.lit("sentence").alias("kind"), F.col("position").alias("first"), F.col("position").alias("last"), F.col("sentence").alias("text")),
        *(windows(parts, keys, n).select(*keys, F.lit(f"window{n}").alias("kind"), "first", "last", "text") for n in (2, 3)),
    ]
    out = kinds[0]
    for k in kinds[1:]:
        out = out.unionByName(k)
    return out


def enclosing(parts: DataFrame, spans: DataFrame, key: str) -> DataFrame:
    """For each span (key, start, end): the parts that it touches, joined in order. Parts and spans meet by key."""
    hit = parts.join(spans, key).filter("start_char < `end` and start < end_char")
    return hit.groupBy(key, "start", "end").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("start_char", "part"))), lambda x: x["part"]), " ").alias("text"))


def joined_segments(rows: DataFrame, group: list[str], order: str, text: str, separator: str = " ") -> DataFrame:
    """Rows with start, the place of their text in the group's joined text."""
    w = Window.partitionBy(*group).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn("start", F.coalesce(F.sum(F.length(text) + len(separator)).over(w), F.lit(0)).cast("bigint"))
