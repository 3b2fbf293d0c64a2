"""Line-first cleaning, in DataFrame functions only.

Each line with a word is held against four rules, the first that fits names it:

    punctuation  8 words or more, and no sentence ends in it or at its end
    navigation   3 separators or more, and one to each 5 words
    symbols      3 symbols or more, and 3 to each 10 words
    shouting     3 runs of marks or more, and one to each 5 words
    boilerplate  a phrase of site furniture

Lines that a rule names are removed; a document that loses more than `max_loss` of its lines' characters is
rejected, as is one that fails the base checks (fewer than 10 words, or a fifth of them in repeated 5-word windows).
Everything happens inside the row: no shuffle, and a text's cost is that of sorting its windows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import table

SPACE = r" \t-\r"
SPACES = " \t\n\x0b\x0c\r"
WORD = rf"[^{SPACE}]+"
SYMBOLS = r"[#*$%&|<>]"

# Patterns of the line rules; the phrases are matched in lower case.
SENTENCE_END = rf"[.!?…:;][\"»”’')]*([{SPACE}]|$)"
SEPARATORS = r"[|»›•·]"
MARKS = r"[#*$%&|<>{}~^=_\\]"
RUNS = r"[!]{2,}|[?]{2,}|[.]{4,}"
PHRASES = (
    r"(lorem ipsum|enable javascript|javascript (is disabled|aktivieren)|accept (all )?cookies|cookie (policy|settings)|use of cookies|"
    r"privacy policy|terms (of (use|service)|and conditions)|all rights reserved|sign up for our newsletter|subscribe to our|click here to|"
    r"cookies akzeptieren|alle rechte vorbehalten|datenschutzerkl|tous droits r|politique de confidentialit|accepter les cookies|"
    r"todos los derechos reservados|pol.tica de privacidad|aceptar (las )?cookies)"
)
MAX_LOSS = 0.3
WINDOW = 5


def _let(value: Column, use) -> Column:
    """use(value), with value computed once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _count(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(pattern)).cast("bigint")


def words_of(text: Column) -> Column:
    trimmed = F.btrim(text, F.lit(SPACES))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, rf"[{SPACE}]+"))


def line_rule(line: Column) -> Column:
    """The name of the rule that removes a line with a word; null if none does."""

    def decide(n: Column) -> Column:
        seps, marks, runs = _count(line, SEPARATORS), _count(line, MARKS), _count(line, RUNS)
        return (
            F.when((n >= 8) & ~line.rlike(SENTENCE_END), "punctuation")
            .when((seps >= 3) & (5 * seps >= n), "navigation")
            .when((marks >= 3) & (10 * marks >= 3 * n), "symbols")
            .when((runs >= 3) & (5 * runs >= n), "shouting")
            .when(F.lower(line).rlike(PHRASES), "boilerplate")
        )

    return _let(_count(line, WORD), decide)


def _covered(grams: Column) -> Column:
    """Words in windows found twice or more; grams: the windows as structs."""

    def of_sorted(s: Column) -> Column:
        twice = F.filter(s, lambda x, k: ((k > 0) & (F.try_element_at(s, k).getField("g") == x.getField("g"))) | (F.try_element_at(s, k + 2).getField("g") == x.getField("g")))
        at = F.sort_array(F.transform(twice, lambda x: x.getField("k")))
        start = F.struct(F.lit(0).cast("bigint").alias("n"), F.lit(0).alias("end"))
        return F.aggregate(
            at,
            start,
            lambda a, k: F.struct((a.getField("n") + F.least(F.lit(WINDOW), k + WINDOW - a.getField("end"))).alias("n"), (k + WINDOW).alias("end")),
            lambda a: a.getField("n"),
        )

    return _let(F.sort_array(F.transform(grams, lambda g, k: F.struct(F.xxhash64(g).alias("h"), g.alias("g"), k.alias("k")))), of_sorted)


def repeated_words(words: Column) -> Column:
    """Words inside 5-word windows that the text holds twice or more, first ones included."""

    def of_words(w: Column) -> Column:
        n = F.size(w) - (WINDOW - 1)
        grams = F.arrays_zip(*(F.slice(w, k + 1, n).alias(f"w{k}") for k in range(WINDOW)))

        def of_grams(g: Column) -> Column:
            # Equal windows have equal hashes: as many hashes as windows means that none repeats.
            distinct = F.size(F.array_distinct(F.transform(g, lambda x: F.xxhash64(x))))
            return F.when(distinct == F.size(g), F.lit(0).cast("bigint")).otherwise(_covered(g))

        return F.when(n < 2, F.lit(0).cast("bigint")).otherwise(_let(grams, of_grams))

    return _let(words, of_words)


def measure(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with a struct __quality of every measure, and the verdict.

    n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, lost_chars, removed (rule of each
    removed line), clean_text (the text without removed lines; null stays null). A null or empty text has no words
    and fails the base check. Each row stands for itself: ties and repeated rows do nothing.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    facts = docs.select(
        "*",
        F.struct(
            text.alias("text"),
            words_of(text).alias("words"),
            F.filter(F.split(text, "\n"), lambda x: x.rlike(rf"[^{SPACE}]")).alias("lines"),
        ).alias("__a"),
    )
    judged = facts.select(
        *docs.columns,
        "__a",
        F.transform("__a.lines", lambda x: F.struct(x.alias("line"), line_rule(x).alias("rule"))).alias("__b"),
    )
    a, b = F.col("__a"), F.col("__b")
    n = F.size(a["words"]).cast("bigint")
    total = lambda lines: F.aggregate(lines, F.lit(0).cast("bigint"), lambda s, x: s + F.length(x["line"]))
    bad = F.filter(b, lambda x: x["rule"].isNotNull())
    measured = judged.select(
        *docs.columns,
        # Out of a generator: a filter on the verdict stays above it, so nothing here is computed twice.
        F.explode(F.array(F.struct(
            n.alias("n_words"),
            F.length(F.array_join(a["words"], "")).cast("bigint").alias("word_chars"),
            _count(a["text"], SYMBOLS).alias("n_symbols"),
            (F.size(a["lines"]) - F.size(F.array_distinct(a["lines"]))).cast("bigint").alias("n_dup_lines"),
            repeated_words(a["words"]).alias("n_repeat_words"),
            total(b).alias("line_chars"),
            total(bad).alias("lost_chars"),
            F.transform(bad, lambda x: x["rule"]).alias("removed"),
            F.when(F.size(bad) == 0, F.col(text_col)).otherwise(F.array_join(F.transform(F.filter(b, lambda x: x["rule"].isNull()), lambda x: x["line"]), "\n")).alias("clean_text"),
        ))).alias("__m"),
    )
    m = F.col("__m")
    failed = (m["n_words"] < 10) | (100 * m["n_repeat_words"] > 20 * m["n_words"])
    kept = ~failed & (m["lost_chars"] <= MAX_LOSS * m["line_chars"])
    return measured.select(*docs.columns, m.withField("base_failed", failed).withField("kept", kept).alias("__quality"))


def clean(docs: DataFrame, text_col: str = "text", n_chars_col: str | None = "n_chars") -> DataFrame:
    """The kept documents, all columns, with their removed lines gone from the text (and from n_chars, if there is one)."""
    found = measure(docs, text_col).filter("__quality.kept")
    cleaned = F.col("__quality.clean_text")
    found = found.withColumn(text_col, cleaned)
    if n_chars_col in docs.columns:
        n = F.when(F.size("__quality.removed") > 0, F.length(cleaned)).otherwise(F.col(n_chars_col))
        found = found.withColumn(n_chars_col, n.cast(docs.schema[n_chars_col].dataType))
    return found.select(docs.columns)


COLUMNS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "lost_chars")


def op1_quality(spark, sf_dir: str) -> DataFrame:
    """The measures and the verdict of every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return measure(docs).select("doc_id", *(F.col(f"__quality.{c}").alias(c) for c in COLUMNS))


_SPACE = r" \t\n\x0B\x0C\r"


def _sql(pattern: str) -> str:
    return "'" + pattern.replace("'", "''").replace(SPACE, _SPACE) + "'"


def _n(pattern: str, text: str = "line") -> str:
    return f"len(regexp_extract_all({text}, {_sql(pattern)}))"


ORACLE_SQL = f"""
WITH docs AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents),
words AS (SELECT rid, regexp_extract_all(text, {_sql(WORD)}) AS ws FROM docs),
grams AS (
  SELECT rid, unnest(range(1, len(ws) - 3)) AS i, unnest(list_transform(range(1, len(ws) - 3), lambda i: array_to_string(list_slice(ws, i, i + 4), ' '))) AS g
  FROM words WHERE len(ws) >= 5
),
repeats AS (
  SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, g) AS n FROM grams) WHERE n > 1
),
covered AS (
  SELECT rid, count(DISTINCT p) AS n_repeat_words FROM (SELECT rid, unnest(range(i, i + 5)) AS p FROM repeats) GROUP BY rid
),
lines AS (
  SELECT rid, line FROM (SELECT rid, unnest(string_split(text, chr(10))) AS line FROM docs) WHERE regexp_matches(line, {_sql(f"[^{SPACE}]")})
),
counted AS (
  SELECT rid, line, {_n(WORD)} AS n, {_n(SEPARATORS)} AS seps, {_n(MARKS)} AS marks, {_n(RUNS)} AS runs FROM lines
),
judged AS (
  SELECT rid, line,
    (n >= 8 AND NOT regexp_matches(line, {_sql(SENTENCE_END)})) OR (seps >= 3 AND 5 * seps >= n) OR (marks >= 3 AND 10 * marks >= 3 * n)
    OR (runs >= 3 AND 5 * runs >= n) OR regexp_matches(lower(line), {_sql(PHRASES)}) AS bad
  FROM counted
),
per_doc AS (
  SELECT rid, count(*) - count(DISTINCT line) AS n_dup_lines, sum(length(line)) AS line_chars,
    coalesce(sum(length(line)) FILTER (WHERE bad), 0) AS lost_chars
  FROM judged GROUP BY rid
),
m AS (
  SELECT doc_id, len(ws) AS n_words, length(array_to_string(ws, '')) AS word_chars, {_n(SYMBOLS, "text")} AS n_symbols,
    coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words,
    coalesce(lost_chars, 0) AS lost_chars, coalesce(line_chars, 0) AS line_chars
  FROM docs JOIN words USING (rid) LEFT JOIN covered USING (rid) LEFT JOIN per_doc USING (rid)
)
SELECT doc_id, n_words::BIGINT AS n_words, coalesce(word_chars, 0)::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols,
  n_dup_lines::BIGINT AS n_dup_lines, n_repeat_words::BIGINT AS n_repeat_words,
  (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AS base_failed,
  NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AND lost_chars <= {MAX_LOSS} * line_chars AS kept,
  lost_chars::BIGINT AS lost_chars
FROM m
"""
