"""Scalar text functions as column expressions; none leaves the JVM. Null in, null out unless said otherwise."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

def _decomposed() -> tuple[str, str]:
    """Letters that decompose into a base and marks, and their bases: one to one, so folding keeps offsets."""
    pairs = []
    for k in (*range(0xC0, 0x590), *range(0x1E00, 0x2000)):
        parts = unicodedata.normalize("NFD", chr(k))
        if len(parts) > 1 and all(unicodedata.category(c) == "Mn" for c in parts[1:]):
            pairs.append((chr(k), parts[0]))
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


ACCENTED, BASES = _decomposed()
NON_WORD = r"[^\p{L}\p{N}_]+"


def let(value: Column, use) -> Column:
    """use(value), value being computed once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def normalize_whitespace(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def without_whitespace(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)\s+", "")


def strip_accents(text: Column) -> Column:
    """Bases for accented letters; marks that stand alone go."""
    return F.regexp_replace(F.translate(text, ACCENTED, BASES), r"\p{Mn}+", "")


def fold_text(text: Column) -> Column:
    """Lower case without accents, of the same length (a mark that stands alone stays)."""
    return F.lower(F.translate(text, ACCENTED, BASES))


def normalize_name(name: Column) -> Column:
    return F.upper(normalize_whitespace(strip_accents(name)))


def name_tokens(name: Column) -> Column:
    """The distinct parts of a name between white space, in capitals without accents."""
    return F.array_distinct(words(normalize_name(name)))


def tokens(text: Column) -> Column:
    """Folded word tokens in order."""
    return F.filter(F.split(fold_text(text), NON_WORD), lambda x: x != "")


def token_set(text: Column) -> Column:
    return F.array_distinct(tokens(text))


def words(text: Column) -> Column:
    """Parts between white space."""
    return F.filter(F.split(text, r"(?U)\s+"), lambda x: x != "")


def jaccard(a: Column, b: Column) -> Column:
    """Of two token sets; 0 for an empty union."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, 0.0).otherwise(F.size(F.array_intersect(a, b)) / union)


def name_contains(a: Column, b: Column) -> Column:
    """Whether two token sets match as names: equal, or one inside the other with two tokens or more on both sides."""
    common = F.size(F.array_intersect(a, b))
    least = F.least(F.size(a), F.size(b))
    equal = (common == F.size(a)) & (common == F.size(b))
    return (least > 0) & (equal | ((least >= 2) & (common == least)))


#: Fixed value: where sentences part.
SENTENCE_BOUNDARY = r"(?U)(?:(?<=[.!?])|(?<=[.!?]\)))(?<!\(\.\.\.\))\s+"


def sentence_parts(text: Column) -> Column:
    """Parts between boundaries: white space behind one of .!? (and a closing parenthesis), but not behind "(...)"."""
    return F.filter(F.split(text, SENTENCE_BOUNDARY), lambda x: x != "")


def word_count(text: Column) -> Column:
    return F.size(words(text))


def is_stage_direction(text: Column) -> Column:
    return F.trim(text).rlike(r"^(\([^()]*\)\s*)+$")


def is_sentence(text: Column, least: int = 4) -> Column:
    return (word_count(text) >= least) & ~is_stage_direction(text)


def sentences(text: Column) -> Column:
    return F.transform(F.filter(sentence_parts(text), lambda x: is_sentence(x)), lambda x: normalize_whitespace(x))


# What counts as a quotation, double and single.
DOUBLE_QUOTES = "“([^”]{10,})”|\"([^\"]{10,})\""
SINGLE_QUOTES = r"(?U)(?<!\w)'([^']{10,})'(?!\w)"


def quoted_spans(text: Column) -> Column:
    """Quotations of ten characters or more, in text order, longer first at the same start, white space collapsed."""
    hits = F.concat(*(F.regexp_extract_all(text, F.lit(p), F.lit(0)) for p in (DOUBLE_QUOTES, SINGLE_QUOTES)))
    placed = F.array_sort(F.transform(hits, lambda h: F.struct(F.call_function("locate", h, text).alias("at"), (-F.length(h)).alias("n"), h.alias("hit"))))
    return F.transform(placed, lambda x: normalize_whitespace(F.substr(x["hit"], F.lit(2), F.length(x["hit"]) - 2)))


def hit_spans(text: Column, pattern: Column) -> Column:
    """array<struct<start,end>> of a pattern's hits, in code points; the pattern must not match nothing."""

    def fold(hits: Column) -> Column:
        before = F.slice(F.split(text, pattern, -1), F.lit(1), F.size(hits))
        start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("spans"))

        def step(a: Column, x: Column) -> Column:
            at = a["at"] + F.length(x["b"])
            end = at + F.length(x["h"])
            return F.struct(end.alias("at"), F.array_append(a["spans"], F.struct(at.alias("start"), end.alias("end"))).alias("spans"))

        return F.aggregate(F.arrays_zip(before.alias("b"), hits.alias("h")), start, step, lambda a: a["spans"])

    return let(F.regexp_extract_all(text, pattern, F.lit(0)), fold)


def mask_quotes(text: Column) -> Column:
    return normalize_whitespace(F.regexp_replace(text, "[\"“][^\"“”]+[\"”]", " "))


def quote_prefix(text: Column, n: int) -> Column:
    """The first n words, or all if there are fewer."""
    return F.array_join(F.slice(words(text), 1, n), " ")


def quote_suffix(text: Column, n: int) -> Column:
    """The last n words without trailing marks, null if there are fewer."""
    return let(words(text), lambda w: F.when(F.size(w) >= n, F.regexp_replace(F.array_join(F.slice(w, -n, n), " "), r"(?U)\W+$", "")))


def prefix_pattern(prefix: Column) -> Column:
    """A pattern for a prefix whatever its case: word-bounded, but a capital first letter waives the left bound."""
    escape = lambda c: F.regexp_replace(c, r"([\\^$.|?*+()\[\]{}])", r"\\$1")
    first, rest = F.substring(prefix, 1, 1), F.substr(prefix, F.lit(2))
    either = F.concat(F.lit(r"(?:(?<!\w)"), F.lower(first), F.lit("|"), F.upper(first), F.lit(")"))
    head = F.when(F.lower(first) == F.upper(first), F.concat(F.lit(r"(?<!\w)"), escape(first))).otherwise(either)
    return F.concat(F.lit("(?U)"), head, F.lit("(?iu:"), escape(rest), F.lit(r")(?!\w)"))


def actor_slug(name: Column, default: str = "ator") -> Column:
    """Folded letters and digits between hyphens; the default for a name without any."""
    slug = F.regexp_replace(F.regexp_replace(fold_text(name), "[^a-z0-9]+", "-"), "^-+|-+$", "")
    return F.when(slug == "", default).otherwise(slug)


def clean_role(role: Column) -> Column:
    """A role without its (PARTY-ST) suffix."""
    return normalize_whitespace(F.regexp_replace(role, r"\(\s*\p{Lu}+(?:\s*[-/]\s*\p{Lu}{2})?\s*\)", " "))


def normalize_label(label: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(fold_text(F.trim(label)), r"[-\s]+", "_"), "_+", "_")


#: The mark of a cut passage, and what is taken off before it.
PASSAGE_MARK, PASSAGE_TRAILING = " […]", " ,;:"


def trim_passage(text: Column, limit: int = 480, mark: str = PASSAGE_MARK) -> Column:
    """The first limit characters, cut at their last space if it lies past the half, with a mark; shorter texts stay."""
    head = F.substring(text, 1, limit)
    at_space = F.length(head) - F.length(F.substring_index(head, " ", -1)) - 1
    cut = F.when(at_space > limit // 2, F.substr(head, F.lit(1), at_space)).otherwise(head)
    return F.when(F.length(text) <= limit, text).otherwise(F.concat(F.rtrim(cut, F.lit(PASSAGE_TRAILING)), F.lit(mark)))


def character_class(text: Column) -> Column:
    first = F.substring(text, 1, 1)
    return F.when(first.rlike(r"^\p{Lu}"), "upper").when(first.rlike(r"^\p{Ll}"), "lower").otherwise("other")


def display_title(title: Column, subject: Column, limit: int = 120) -> Column:
    """The title's first line with text, else the subject, white space collapsed; if longer than limit, cut at a space with an ellipsis."""
    lines = F.transform(F.split(F.coalesce(title, F.lit("")), r"\r\n|[\n\r\u000b\u000c\u001c-\u001e\u0085\u2028\u2029]"), normalize_whitespace)
    first = F.coalesce(F.get(F.filter(lines, lambda x: x != ""), F.lit(0)), normalize_whitespace(subject))
    room = F.substring(first, 1, limit)
    at_space = F.length(room) - F.length(F.substring_index(room, " ", -1)) - 1
    cut = F.when(at_space > 0, F.substr(room, F.lit(1), at_space)).otherwise(F.substring(first, 1, limit - 1))
    return F.when(F.length(first) <= limit, first).otherwise(F.concat(F.rtrim(cut, F.lit(" ,;:-")), F.lit("…")))


def pair_digest(a: Column, b: Column) -> Column:
    """sha256 of two texts around a unit separator."""
    return F.sha2(F.concat(a, F.lit("\x1f"), b), 256)


def cache_key(identity: Column, *texts: Column) -> Column:
    """sha256 of an identity and texts around record separators; a null text differs from an empty and from an absent one."""
    return F.sha2(F.concat_ws("\x1e", identity, *(F.coalesce(t, F.lit("\x00")) for t in texts)), 256)


def fingerprint(*columns: Column, size: int = 16) -> Column:
    """The beginning of the sha256 of the columns as JSON."""
    return F.substring(F.sha2(F.to_json(F.struct(*columns)), 256), 1, size)


def leading_sentences(parts: Column, budget: int) -> Column:
    """The longest run of first sentences whose words stay within a budget."""
    start = F.struct(F.lit(0).alias("n"), F.lit(0).alias("k"), F.lit(True).alias("open"))

    def step(a: Column, x: Column) -> Column:
        n = a["n"] + word_count(x)
        fits = a["open"] & (n <= budget)
        return F.struct(F.when(fits, n).otherwise(a["n"]).alias("n"), (a["k"] + F.when(fits, 1).otherwise(0)).alias("k"), fits.alias("open"))

    return F.slice(parts, F.lit(1), F.aggregate(parts, start, step, lambda a: a["k"]))


def repeated_ngram(text: Column, n: int, times: int) -> Column:
    """Whether some word n-gram occurs so often: in sorted order, a gram equals the one times - 1 places on."""

    def of(w: Column) -> Column:
        grams = F.sort_array(F.transform(F.sequence(F.lit(1), F.size(w) - n + 1), lambda i: F.array_join(F.slice(w, i, n), " ")))
        hit = let(grams, lambda g: F.exists(F.arrays_zip(g.alias("a"), F.slice(g, times, F.size(g)).alias("b")), lambda x: x["a"].eqNullSafe(x["b"])))
        return F.when(F.size(w) < n, False).otherwise(hit)

    return let(tokens(text), of)
