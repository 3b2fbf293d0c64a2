"""Names in headers and dates in articles, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import text as T

# The stamps of articles, and their weekday mentions with Monday as 0.
TIMESTAMP = r"\d{2}/\d{2}/\d{4}\s*-\s*\d{2}:\d{2}"
UPDATED = r"(?i)Atualizado\s+em\s+(\d{2}/\d{2}/\d{4}\s*-\s*\d{2}:\d{2})"
WEEKDAY_MENTION = r"(?iu)(nest[ae]\s+)?(segunda|ter[cç]a|quarta|quinta|sexta)-feira\s*\((\d{1,2})\)"
WEEKDAYS = ("segunda", "terca", "quarta", "quinta", "sexta")


def _stamp(text: Column) -> Column:
    return F.try_to_timestamp(F.regexp_replace(text, r"\s*-\s*", " "), F.lit("dd/MM/yyyy HH:mm")).cast("timestamp_ntz")


def updated_at(article: Column) -> Column:
    """The stamp after the update marker, null without one (or with an impossible date)."""
    found = F.regexp_extract(article, UPDATED, 1)
    return F.when(found != "", _stamp(found))


def published_at(article: Column) -> Column:
    """The first stamp outside of update markers."""
    found = F.regexp_extract(F.regexp_replace(article, UPDATED, ""), TIMESTAMP, 0)
    return F.when(found != "", _stamp(found))


def weekday_mentions(article: Column) -> Column:
    """array<struct<text, current, weekday, day>> of every mention: current says that it names this event."""

    def parse(m: Column) -> Column:
        name = T.fold_text(F.regexp_extract(m, WEEKDAY_MENTION, 2))
        return F.struct(
            F.trim(m).alias("text"),
            (F.regexp_extract(m, WEEKDAY_MENTION, 1) != "").alias("current"),
            (F.array_position(F.array(*map(F.lit, WEEKDAYS)), name) - 1).cast("int").alias("weekday"),
            F.regexp_extract(m, WEEKDAY_MENTION, 3).cast("int").alias("day"),
        )

    return F.transform(F.regexp_extract_all(article, F.lit(WEEKDAY_MENTION), F.lit(0)), parse)


#: What marks a parenthesis as a party's.
PARTY_MARKERS = ("/", " - ")


def is_party_info(info: Column, markers: tuple[str, ...] = PARTY_MARKERS) -> Column:
    """Whether a parenthesis names a party; null does not."""
    hit = F.lit(False)
    for m in markers:
        hit = hit | F.contains(info, F.lit(m))
    return F.coalesce(hit, F.lit(False))


def _before_party(info: Column) -> Column:
    return F.regexp_extract(info, r"(?s)^(.*)\. ", 1)


def _tail(info: Column) -> Column:
    return F.regexp_extract(info, r"(?s)^.*\. (.*)$", 1)


def resolve_turn_name(raw_name: Column, info: Column, party=is_party_info) -> Column:
    """The name in a parenthesis before its last ". ", if a party follows; else the header's own."""
    return F.when(F.contains(F.coalesce(info, F.lit("")), F.lit(". ")) & party(_tail(info)), F.trim(_before_party(info))).otherwise(raw_name)


def turn_name_candidates(raw_name: Column, info: Column, party=is_party_info) -> Column:
    """The names that a header may stand for: its own, and the parenthesis's (before its party, or whole if it names none)."""
    resolved, note = resolve_turn_name(raw_name, info, party), F.coalesce(info, F.lit(""))
    second = F.when(resolved != raw_name, resolved).when((note != "") & ~party(note), note)
    return F.array_compact(F.array(raw_name, second))


def turn_party(raw_name: Column, info: Column, party=is_party_info) -> Column:
    moved = resolve_turn_name(raw_name, info, party) != raw_name
    return F.when(moved, F.trim(_tail(info))).when(party(F.coalesce(info, F.lit(""))), info)


def turn_role(raw_name: Column, chairs: list[str]) -> Column:
    return F.when(raw_name.isin(chairs), "chair").otherwise("speaker")


def merged_key(key: Column, hearing: Column, scoped: dict[tuple[int, str], str], aliases: dict[str, str]) -> Column:
    """A key after reassignment within a hearing, else after its alias."""
    out = key
    for old, new in aliases.items():
        out = F.when(key == old, new).otherwise(out)
    for (h, old), new in scoped.items():
        out = F.when((hearing == h) & (key == old), new).otherwise(out)
    return out


def parse_level(answer: Column, labels: list[str]) -> Column:
    """The first label that begins the folded answer, null if none does."""
    folded = T.fold_text(F.trim(answer))
    out = F.lit(None).cast("string")
    for label in reversed(labels):
        out = F.when(F.startswith(folded, F.lit(label)), label).otherwise(out)
    return out


def coverage_bucket(words: Column, floors: list[int]) -> Column:
    """The largest floor that a number of words reaches, null below all."""
    out = F.lit(None).cast("int")
    for f in sorted(floors):
        out = F.when(words >= f, f).otherwise(out)
    return out


def citation_problem(citation: Column, source: Column, least: int) -> Column:
    """`missing`, `too_short`, `not_found` or null for a quotation copied from a source."""
    clean = T.normalize_whitespace(citation)
    return (
        F.when(citation.isNull() | (clean == ""), "missing")
        .when(T.word_count(clean) < least, "too_short")
        .when(~F.contains(T.fold_text(T.normalize_whitespace(F.coalesce(source, F.lit("")))), T.fold_text(clean)), "not_found")
    )
