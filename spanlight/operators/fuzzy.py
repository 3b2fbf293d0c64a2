"""Fuzzy string operators, as Arrow-batched functions: built-in expressions have no substring alignment.

Similarities are those of insertions and deletions: 200 * lcs(a, b) / (len(a) + len(b)), the longest common
subsequence by bit-parallel addition. Null texts are empty; two empty texts are alike.
"""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Iterator, Sequence

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def lcs_length(a: Sequence, b: Sequence) -> int:
    """Of two strings, or of two lists of words."""
    masks: dict = {}
    for k, c in enumerate(a):
        masks[c] = masks.get(c, 0) | 1 << k
    full = (1 << len(a)) - 1
    state = full
    for c in b:
        hit = state & masks.get(c, 0)
        state = ((state + hit) | (state - hit)) & full
    return len(a) - state.bit_count()


def ratio(a: Sequence, b: Sequence) -> float:
    return 100.0 if not a and not b else 200.0 * lcs_length(a, b) / (len(a) + len(b))


def folded_words(text: str) -> tuple[list[str], list[tuple[int, int]]]:
    """The text's words in lower case without accents, and the half-open span of each."""
    places = [m.span() for m in re.finditer(r"\w+", text)]
    plain = lambda x: "".join(c for c in unicodedata.normalize("NFD", x.lower()) if unicodedata.category(c) != "Mn")
    return [plain(text[a:b]) for a, b in places], places


def word_alignment(needle: str, text: str) -> tuple[float, int, int] | None:
    """(score, start, end) of the run of whole words of text most like the needle's; None if either has no word.

    A text of fewer words than the needle is compared as a whole.
    """
    want, _ = folded_words(needle)
    have, places = folded_words(text)
    if not want or not have:
        return None
    score, first, end = (ratio(want, have), 0, len(have)) if len(have) < len(want) else partial_alignment(want, have)
    return (score, places[first][0], places[end - 1][1]) if end > first else (score, 0, 0)


def best_alignment(needles: list[str], texts: list[str], by_words: bool = False) -> tuple[float, int, int, int, int] | None:
    """(score, needle, text, start, end) of the best alignment of any needle with any text: the first needle, then text, wins ties."""
    best = None
    for i, needle in enumerate(needles):
        for j, text in enumerate(texts):
            found = word_alignment(needle, text) if by_words else (partial_alignment(needle, text) if needle and text else None)
            if found and (best is None or found[0] > best[0]):
                best = (found[0], i, j, found[1], found[2])
    return best


def partial_alignment(needle: Sequence, text: Sequence) -> tuple[float, int, int]:
    """(score, start, end) of the window of text most like the needle, as long as it or shorter at the text's ends; first wins."""
    n, m = len(needle), len(text)
    if not n or not m:
        return (100.0 if n == m else 0.0), 0, 0
    best = (-1.0, 0, 0)
    for start in range(1 - n, m):
        a, b = max(0, start), min(m, start + n)
        if b > a and 200.0 * (b - a) / (n + b - a) > best[0]:
            score = ratio(needle, text[a:b])
            if score > best[0]:
                best = (score, a, b)
    return best


def token_set_ratio(a: str, b: str) -> float:
    """The best ratio of the common tokens, and of these with either side's own; 0 if a side has none."""
    x, y = set(a.split()), set(b.split())
    if not x or not y:
        return 0.0
    both = " ".join(sorted(x & y))
    left, right = (" ".join(filter(None, (both, " ".join(sorted(s))))) for s in (x - y, y - x))
    if both and (x <= y or y <= x):
        return 100.0
    return max(ratio(left, right), *((ratio(both, left), ratio(both, right)) if both else (0.0, 0.0)))


def jaro_winkler(a: str, b: str, weight: float = 0.1) -> float:
    if not a or not b:
        return 1.0 if a == b else 0.0
    reach = max(0, max(len(a), len(b)) // 2 - 1)
    taken, matched = [False] * len(b), []
    for i, c in enumerate(a):
        for j in range(max(0, i - reach), min(len(b), i + reach + 1)):
            if not taken[j] and b[j] == c:
                taken[j] = True
                matched.append(c)
                break
    if not matched:
        return 0.0
    others = [c for c, t in zip(b, taken) if t]
    swaps = sum(x != y for x, y in zip(matched, others)) / 2
    m = len(matched)
    jaro = (m / len(a) + m / len(b) + (m - swaps) / m) / 3
    prefix = 0
    for x, y in zip(a[:4], b[:4]):
        if x != y:
            break
        prefix += 1
    return jaro + prefix * weight * (1 - jaro)


def json_objects(text: str) -> tuple[list[str], int]:
    """Every JSON object that begins at a brace outside of an earlier one, and how many braces began none."""
    found, failures, at, read = [], 0, 0, json.JSONDecoder().raw_decode
    while (at := text.find("{", at)) >= 0:
        try:
            value, end = read(text, at)
            found.append(json.dumps(value, ensure_ascii=False))
            at = end
        except ValueError:
            failures += 1
            at += 1
    return found, failures


# A section's title, a claim's bullet (indented by one at most), and the section before any title.
TITLE = re.compile(r"#{1,6}\s+(.+?)\s*#*\s*")
BULLET = re.compile(r"\s?[-*]\s+(.+?)\s*")
UNTITLED = "Sem título"


def parse_profile(text: str) -> list[tuple[int, str, int, str]]:
    """(number of the section, its title, position, claim) of a Markdown profile; blank lines do nothing.

    A bullet opens a claim, any other line joins the open one, or opens a section's first. Sections without
    claims have no row; sections of one title stay apart.
    """
    out: list[tuple[int, str, int, str]] = []
    number, title, position = -1, UNTITLED, 0
    for line in text.splitlines():
        bare = line.strip()
        if not bare:
            continue
        if heading := TITLE.fullmatch(bare):
            number, title, position = number + 1, heading[1].strip(), 0
            continue
        number = max(number, 0)
        bullet = BULLET.fullmatch(line)
        if bullet or not position:
            out.append((number, title, position, bullet[1] if bullet else bare))
            position += 1
        else:
            out[-1] = (*out[-1][:3], f"{out[-1][3]} {bare}")
    return out


def _scored(fn):
    @F.pandas_udf("double")
    def udf(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([fn(x or "", y or "") for x, y in zip(a, b)], dtype=float)

    return udf


def name_scores(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """pairs with token_set and jaro_winkler, both from 0 to 100."""
    return pairs.withColumn("token_set", _scored(token_set_ratio)(a, b)).withColumn("jaro_winkler", _scored(lambda x, y: 100 * jaro_winkler(x, y))(a, b))


def align(pairs: DataFrame, needle: str, text: str) -> DataFrame:
    """pairs with alignment {score, start_char, end_char}."""

    @F.pandas_udf("score double, start_char int, end_char int")
    def udf(a: pd.Series, b: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([partial_alignment(x or "", y or "") for x, y in zip(a, b)], columns=["score", "start_char", "end_char"])

    return pairs.withColumn("alignment", udf(needle, text))


def align_best(rows: DataFrame, needles: str, texts: str, by_words: bool = False) -> DataFrame:
    """rows with best {score, needle, text, start_char, end_char} of their arrays of needles and texts, by letters or by words.

    needle and text count from 0; null where no needle meets a text.
    """

    @F.pandas_udf("score double, needle int, text int, start_char int, end_char int")
    def udf(a: pd.Series, b: pd.Series) -> pd.DataFrame:
        found = [best_alignment([n or "" for n in (x if x is not None else [])], [t or "" for t in (y if y is not None else [])], by_words) for x, y in zip(a, b)]
        return pd.DataFrame([f or (None,) * 5 for f in found], columns=["score", "needle", "text", "start_char", "end_char"]).astype({"score": "float64", **{c: "Int32" for c in ("needle", "text", "start_char", "end_char")}})

    found = udf(needles, texts)
    return rows.withColumn("best", F.when(found["score"].isNotNull(), found))


def scan_json(rows: DataFrame, key: str, text: str) -> DataFrame:
    """(key, objects array<string>, failures)."""
    kind = rows.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [json_objects(t or "") for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([f[0] for f in found], pa.list_(pa.string())), pa.array([f[1] for f in found], pa.int32())], [key, "objects", "failures"])

    return rows.select(key, text).mapInArrow(run, f"{key} {kind}, objects array<string>, failures int")


def profile_claims(rows: DataFrame, key: str, text: str) -> DataFrame:
    """(key, number, section, position, claim) of every claim; texts without claims give no row."""
    kind = rows.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [parse_profile(t or "") for t in batch.column(1).to_pylist()]
            at = pa.array([k for k, claims in enumerate(found) for _ in claims], pa.int64())
            flat = [c for claims in found for c in claims]
            columns = [pa.array([c[i] for c in flat], t) for i, t in enumerate((pa.int32(), pa.string(), pa.int32(), pa.string()))]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), *columns], [key, "number", "section", "position", "claim"])

    return rows.select(key, text).mapInArrow(run, f"{key} {kind}, number int, section string, position int, claim string")


def greedy_batches(rows: DataFrame, key: str, length: str, budget: int, most: int = 1 << 30) -> DataFrame:
    """(key, length, batch): longest first, ties by key; a batch closes when its padded size or its number would pass the bound.

    One greedy pass over all rows. Where it stands depends on the lengths alone, so the driver walks the table of distinct
    lengths (their number is bounded by the longest row) and each row finds its batch from its place among its length's.
    A row longer than the budget has a batch of its own.
    """
    n = F.coalesce(F.col(length), F.lit(0)).cast("bigint").alias("length")
    sized = rows.select(F.col(key).alias(key), n)
    runs: list[tuple[int, int, int, int, int]] = []  # length, place of its first row, batch there, rows to a batch, of which one is begun
    number, count, widest = 0, 0, 0
    for size, total in sized.groupBy("length").agg(F.count("*").alias("n")).orderBy(F.desc("length")).toLocalIterator():
        at = 0
        if count:
            room = min(most, budget // widest if widest else most) - count
            taken = max(0, min(room, total))
            if taken:
                runs.append((size, 0, number, taken, 0))
                at, count = taken, count + taken
            if at < total:
                number, count = number + 1, 0
        if at < total:
            whole = max(1, min(most, budget // size if size else most))
            runs.append((size, at, number, whole, 1))
            left = total - at
            number, count, widest = number + (left - 1) // whole, (left - 1) % whole + 1, size
    steps = rows.sparkSession.createDataFrame(runs, "length bigint, at bigint, first bigint, whole bigint, own int")
    placed = sized.withColumn("k", F.row_number().over(Window.partitionBy("length").orderBy(key)) - 1)
    found = placed.join(steps, "length").filter("k >= at and (own = 1 or k < whole)")
    return found.select(key, "length", (F.col("first") + F.when(F.col("own") == 1, F.floor((F.col("k") - F.col("at")) / F.col("whole"))).otherwise(0)).alias("batch"))
