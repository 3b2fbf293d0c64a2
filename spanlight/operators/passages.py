"""Passages in their surroundings: located sentences, contexts, premises, segments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T


def literal_pattern(sentence: Column) -> Column:
    """A pattern for a text whatever its white space."""
    escaped = F.regexp_replace(T.normalize_whitespace(sentence), r"([\\^$.|?*+()\[\]{}])", r"\\$1")
    return F.concat(F.lit("(?U)"), F.replace(escaped, F.lit(" "), F.lit(r"\s+")))


def locate_sentences(turns: DataFrame, sentences: DataFrame, key: str, turn: str, text: str, start: str, sentence: str) -> DataFrame:
    """sentences (key, sentence) with the first turn that holds each, and its absolute span there; nulls if none does.

    Turns carry the absolute start of their text. Both sides meet by key, so a text is searched in its own turns only.
    """
    pairs = sentences.join(turns.select(key, F.col(turn).alias("__turn"), F.col(text).alias("__text"), F.col(start).alias("__start")), key, "left")
    span = F.get(T.hit_spans(F.col("__text"), literal_pattern(F.col(sentence))), F.lit(0))
    hit = pairs.withColumn("__span", F.when(F.col("__text").isNotNull(), span))
    best = F.min(F.when(F.col("__span").isNotNull(), F.struct("__turn", (F.col("__start") + F.col("__span.start")).alias("s"), (F.col("__start") + F.col("__span.end")).alias("e"))))
    out = hit.groupBy(key, sentence).agg(best.alias("__b"))
    return out.select(key, sentence, F.col("__b.__turn").alias("turn"), F.col("__b.s").alias("start_char"), F.col("__b.e").alias("end_char"))


def context_window(text: Column, start: Column, end: Column, size: int) -> Column:
    """Struct (before, after): up to `size` characters on each side of a half-open span, cut at a word, with marks where cut."""
    left, right = F.substr(text, F.lit(1), start), F.substr(text, end + 1)
    before = F.when(F.length(left) <= size, left).otherwise(F.concat(F.lit("…"), F.regexp_replace(F.right(left, F.lit(size)), r"^\S*\s+", "")))
    after = F.when(F.length(right) <= size, right).otherwise(F.concat(F.regexp_replace(F.left(right, F.lit(size)), r"\s+\S*\z", ""), F.lit("…")))
    return F.struct(before.alias("before"), after.alias("after"))


def concatenated_premise(items: Column, separator: str = " ", single: bool = False) -> Column:
    """The non-empty items joined; null without any, or with one only unless asked for."""
    full = F.filter(items, lambda x: x.isNotNull() & (F.trim(x) != ""))
    return F.when(F.size(full) >= (1 if single else 2), F.array_join(full, separator))


def numbered_statements(rows: DataFrame, key: str, order: str, text: str) -> DataFrame:
    """(key, statements): "1. a" lines of each key's texts in order."""
    place = F.row_number().over(Window.partitionBy(key).orderBy(order))
    lines = rows.select(key, place.alias("k"), F.concat(place.cast("string"), F.lit(". "), F.col(text)).alias("line"))
    return lines.groupBy(key).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("k", "line"))), lambda x: x["line"]), "\n").alias("statements"))


def merged_parts(text: Column, abbreviations: list[str], least: int = 4) -> Column:
    """Sentence parts, where one that ends in an abbreviation or has few words joins the next; a short rest joins the last."""
    tail = "(?:" + "|".join(a.replace(".", r"\.") for a in abbreviations) + r")$" if abbreviations else r"(?!)"
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("open"))

    def step(a: Column, p: Column) -> Column:
        joined = F.when(a["open"] == "", p).otherwise(F.concat(a["open"], F.lit(" "), p))
        wait = joined.rlike(tail) | (T.word_count(joined) < least)
        return F.struct(F.when(wait, a["done"]).otherwise(F.array_append(a["done"], joined)).alias("done"), F.when(wait, joined).otherwise("").alias("open"))

    def finish(a: Column) -> Column:
        n = F.size(a["done"])
        last = F.concat(F.element_at(a["done"], -1), F.lit(" "), a["open"])
        return F.when(a["open"] == "", a["done"]).when(n == 0, F.array(a["open"])).otherwise(F.array_append(F.slice(a["done"], F.lit(1), n - 1), last))

    return F.aggregate(T.sentence_parts(text), start, step, finish)


def rebuilt(segments: DataFrame, texts: DataFrame, key: str, text: str) -> DataFrame:
    """(key, rebuilt): a text put together from its located segments (key, start_char, end_char) in order."""
    cut = segments.join(texts.select(key, F.col(text).alias("__t")), key)
    piece = F.expr("substring(__t, cast(start_char as int) + 1, cast(end_char - start_char as int))")
    return cut.groupBy(key).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("start_char", piece.alias("x")))), lambda s: s["x"]), " ").alias("rebuilt"))


def overlapping(a: DataFrame, b: DataFrame, key: str, width: int = 1024) -> DataFrame:
    """(key, a_id, b_id) of half-open spans (key, id, start_char, end_char) that touch.

    Spans meet by key and bucket of positions, and a pair counts in the bucket of its later start only.
    """

    def dealt(df: DataFrame, n: str) -> DataFrame:
        span = df.select(key, F.col("id").alias(f"{n}_id"), F.col("start_char").alias(f"{n}_s"), F.col("end_char").alias(f"{n}_e")).filter(f"{n}_s < {n}_e")
        return span.withColumn("__k", F.explode(F.sequence(F.floor(F.col(f"{n}_s") / width), F.floor((F.col(f"{n}_e") - 1) / width))))

    pairs = dealt(a, "a").join(dealt(b, "b"), [key, "__k"]).filter("a_s < b_e and b_s < a_e")
    return pairs.filter(F.col("__k") == F.floor(F.greatest("a_s", "b_s") / width)).select(key, "a_id", "b_id")


def reachable(chunks: DataFrame, key: str) -> DataFrame:
    """(key, reachable): whether every segment (key, segment, inside) has an occurrence inside the person's turns."""
    seg = chunks.groupBy(key, "segment").agg(F.max(F.col("inside").cast("int")).alias("ok"))
    return seg.groupBy(key).agg((F.min("ok") == 1).alias("reachable"))
