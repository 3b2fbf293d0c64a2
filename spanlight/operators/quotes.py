"""Literal evidence: which texts hold a quotation's first words, and which occurrence to take."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T

LADDER = (10, 6, 4, 3)
TRUSTED_WORDS = 6
MIN_PREFIX_CHARS = 6
MAX_SPAN_RATIO = 2.0
SUFFIXES = (6, 4, 3)
#: First words of prefixes up to which they filter the texts' n-grams; beyond, all n-grams are put out.
FIRST_WORDS = 10_000


def prefixes(quotes: DataFrame, id_col: str, text_col: str, ladder: tuple[int, ...] = LADDER) -> DataFrame:
    """(id, words, prefix): the folded first words of each quotation, for each step that it is long enough for."""
    steps = F.array(*(F.struct(F.lit(n).alias("words"), F.lit(n).alias("n")) for n in ladder))
    rows = quotes.select(F.col(id_col).alias("id"), T.tokens(F.col(text_col)).alias("t"), F.explode(steps).alias("s"))
    cut = rows.filter("size(t) > 0").select("id", F.least("s.n", F.size("t")).alias("words"), F.expr("array_join(slice(t, 1, s.n), ' ')").alias("prefix"))
    return cut.filter(F.length("prefix") >= MIN_PREFIX_CHARS).distinct()


def occurrences(quotes: DataFrame, q_id: str, q_text: str, texts: DataFrame, t_id: str, t_text: str, ladder: tuple[int, ...] = LADDER) -> DataFrame:
    """(id, words, text_id, position) wherever a prefix occurs in a text, by folded words.

    An equi join on word n-grams, which are built inside a text's row, so no row carries its whole text along. As
    long as there are few of them, only n-grams that begin with a prefix's first word are put out.
    """
    want = prefixes(quotes, q_id, q_text, ladder)
    first = [r.w0 for r in want.select(F.substring_index("prefix", " ", 1).alias("w0")).distinct().limit(FIRST_WORDS + 1).collect()]
    steps = [r.words for r in want.select("words").distinct().collect()]  # at most as many as the longest step
    toks = texts.select(F.col(t_id).alias("text_id"), T.tokens(F.col(t_text)).alias("t"))
    places = F.transform("t", lambda w, i: F.when(w.isin(first), i) if len(first) <= FIRST_WORDS else i)
    size = F.array(*map(F.lit, steps)).cast("array<int>")

    def gram(i, n):
        return F.struct(i.alias("position"), n.alias("words"), F.array_join(F.slice("t", i + 1, n), " ").alias("prefix"))

    grams = F.flatten(F.transform(F.array_compact(places), lambda i: F.transform(F.filter(size, lambda n: i + n <= F.size("t")), lambda n: gram(i, n))))
    return want.join(toks.select("text_id", F.inline(grams)), ["words", "prefix"]).select("id", "words", "text_id", "position")


def first_match(found: DataFrame) -> DataFrame:
    """Of each quotation: its longest prefix that occurs, the number of texts with it, and the first of them."""
    w = Window.partitionBy("id")
    best = found.withColumn("__m", F.max("words").over(w)).filter("words = __m")
    return best.groupBy("id", "words").agg(F.countDistinct("text_id").alias("n_texts"), F.count("*").alias("n_occurrences"), F.min("text_id").alias("first_text"))


def best_occurrence(found: DataFrame, quotes: DataFrame, q_id: str, q_text: str, texts: DataFrame, t_id: str, t_text: str) -> DataFrame:
    """Of the texts with the longest prefix, the one of largest token Jaccard with the quotation, first id on ties."""
    w = Window.partitionBy("id")
    best = found.withColumn("__m", F.max("words").over(w)).filter("words = __m").select("id", "words", "text_id").distinct()
    q = quotes.select(F.col(q_id).alias("id"), T.token_set(F.col(q_text)).alias("q"))
    t = texts.select(F.col(t_id).alias("text_id"), T.token_set(F.col(t_text)).alias("t"))
    scored = best.join(q, "id").join(t, "text_id").withColumn("jaccard", F.round(T.jaccard(F.col("q"), F.col("t")), 9))
    rank = Window.partitionBy("id").orderBy(F.desc("jaccard"), "text_id")
    return scored.withColumn("k", F.row_number().over(rank)).filter("k = 1").select("id", "words", "text_id", "jaccard")


def _first_of(words):
    """The first span with the prefix's words and the number of spans, null without any."""

    def of(s):
        hit = F.struct(words.alias("words"), s[0]["start"].alias("start_char"), s[0]["end"].alias("end_char"), F.size(s).alias("n"))
        return F.when(F.size(s) > 0, hit)

    return of


def match_in_speech(pairs: DataFrame, speech: str, quote: str, ladder: tuple[int, ...] = LADDER) -> DataFrame:
    """pairs with match {words, start_char, end_char, n}: the first step of the ladder found in the row's own speech.

    Offsets count code points; n is the number of occurrences, the first one is taken; null if nothing is found.
    """
    text, q = F.col(speech), F.col(quote)
    found = []
    for n in ladder:
        prefix = T.quote_prefix(q, n)
        ok = F.length(prefix) >= MIN_PREFIX_CHARS
        spans = F.when(ok, T.hit_spans(text, T.prefix_pattern(F.when(ok, prefix))))
        words = F.least(F.lit(n), T.word_count(q))
        one = T.let(spans, _first_of(words))
        found.append(one)
    return pairs.withColumn("match", F.coalesce(*found))


def extend_match(pairs: DataFrame, speech: str, quote: str) -> DataFrame:
    """pairs (with match) with end_char and rule: `suffix` where the quotation's last words follow within twice its length.

    Else the end of as many sentence parts as the quotation has, from the part that the match begins in (`sentence_count`).
    """
    text, q, m = F.col(speech), F.col(quote), F.col("match")
    limit = m["start_char"] + MAX_SPAN_RATIO * F.length(q)
    ends = []
    for n in SUFFIXES:
        suffix = T.quote_suffix(q, n)
        ok = suffix.isNotNull() & (F.length(suffix) >= MIN_PREFIX_CHARS)
        spans = F.when(ok, T.hit_spans(text, T.prefix_pattern(F.when(ok, suffix))))
        fits = F.filter(spans, lambda s: (s["start"] >= m["start_char"]) & (s["end"] >= m["end_char"]) & (s["end"] <= limit))
        ends.append(F.get(fits, F.lit(0))["end"])
    by_suffix = F.coalesce(*ends)
    bounds = T.hit_spans(text, F.lit(r"(?U)(?:(?<=[.!?])|(?<=[.!?]\))(?<!\(\.\.\.\)))\s+"))
    wanted = F.size(F.filter(T.sentence_parts(q), lambda p: p.rlike(r"(?U)\w")))
    behind = F.filter(bounds, lambda b: b["start"] >= m["end_char"])
    by_count = F.coalesce(F.get(behind, F.greatest(wanted - 1, F.lit(0)))["start"], F.length(text))
    return pairs.withColumn("end_char", F.when(m.isNotNull(), F.coalesce(by_suffix, by_count))).withColumn(
        "rule", F.when(by_suffix.isNotNull() & m.isNotNull(), "suffix").when(m.isNotNull(), "sentence_count")
    )


def longest_common_run(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """pairs with run: the length of the longest run of equal folded words in both texts.

    Rows stay rows: the run's possible lengths are bisected, a length fits if some n-gram is in both texts.
    """
    rows = pairs.withColumn("__a", T.tokens(F.col(a))).withColumn("__b", T.tokens(F.col(b)))

    def grams(t: str, n):
        return F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size(t) - n + 1)), lambda i: F.array_join(F.slice(F.col(t), i, n), " "))

    start = F.struct(F.lit(0).alias("low"), F.least(F.size("__a"), F.size("__b")).alias("high"))

    def bisect(s, _):
        mid = ((s["low"] + s["high"] + 1) / 2).cast("int")
        fits = (mid > 0) & F.arrays_overlap(grams("__a", mid), grams("__b", mid))
        next_low, next_high = F.when(fits, mid).otherwise(s["low"]), F.when(fits, s["high"]).otherwise(mid - 1)
        return F.when(s["low"] >= s["high"], s).otherwise(F.struct(next_low.alias("low"), next_high.alias("high")))

    run = F.aggregate(F.sequence(F.lit(1), F.lit(20)), start, bisect, lambda s: s["low"])
    return rows.withColumn("run", run).drop("__a", "__b")
