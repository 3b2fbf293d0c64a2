"""Main text of web pages by two passes of block rules.

A page is cut into blocks at block-level tags. The first pass decides what it can from a block's length, the share of
stop words among its words, the share of its characters in links, and its containers: blocks in boilerplate
containers (menus, headers, footers, sidebars, notices, adverts, forms, comments) and those made of links are bad;
long ones with many stop words are good, in a marked article shorter ones with fewer too; other long ones are bad, but
for paragraphs and what an article holds, which stay open, as do all short ones. Where a page marks its article,
blocks outside of it are bad. The second pass gives each open block the label of its nearest decided neighbours; an
article's ends count as good ones, and furniture set into it as none. Where both differ, the article, a paragraph's
tag or a heading before good text decides.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass
from functools import lru_cache
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import texts_of
from .common import map_batches, table, utf8

# Frequent words of the four languages, tags by their part in a page, words of class and id.
STOP_WORDS = frozenset(
    """
    a an and are as at be by for from has have he in is it its of on or that the this to was were which with not but his they you
    auf aus bei das dem den der des die ein eine einer es für hat ich im ist mit nicht sich sie sind und von war wie zu zum zur auch
    au aux avec ce ces dans de des du elle en est et il je la le les mais ne nous ou par pas pour que qui se sur un une sont
    al como con del el ella en entre es esta este la las lo los más no o para pero por que se sin su sus un una y
    """.split()
)
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset "
    "h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol option p pre section select summary table tbody td tfoot th thead tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
UNREAD = frozenset("script style noscript template svg math iframe object canvas audio video textarea title head".split())
BOILERPLATE = frozenset("nav header footer aside form menu dialog button select option label fieldset".split())
ROLES = frozenset("navigation banner contentinfo complementary search form alert dialog menu menubar toolbar".split())
SHUTS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
HINTS = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner menu nav navbar navigation breadcrumb breadcrumbs header "
    "masthead footer sidebar aside widget cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription signup login "
    "comment comments disqus reply replies respond share sharing social related recommended recommendations pagination pager toolbar copyright disclaimer skip".split()
)
HOLDERS = frozenset("ul ol dl table tbody thead tfoot select div article section nav".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())

_TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>?|<(/?)([a-zA-Z][^\s/>]*)((?:[^"'>]|"[^"]*"|'[^']*')*+|[^>]*)>""", re.S)
_CUT_OFF = re.compile(r"<[/a-zA-Z!?][^<>]*\Z")
_MARKS = re.compile(r"""(?:^|[\s"'])(class|id|role|style|hidden|aria-hidden)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.I)
_PARTS = re.compile(r"[A-Za-z][a-z]*|[A-Z]+(?![a-z])")


@dataclass(frozen=True)
class Rules:
    """Thresholds: characters, share of characters in links, share of stop words among words."""

    short: int = 70
    long: int = 200
    links: float = 0.5
    few: float = 0.15
    many: float = 0.3


@dataclass
class Block:
    text: str
    link_chars: int
    tag: str
    boilerplate: bool
    article: bool


def _hinted(tag: str, attributes: str) -> bool:
    """Whether an element's attributes mark it as boilerplate or hidden."""
    if not attributes or tag in ("html", "body", "main"):
        return False
    for name, value in _MARKS.findall(attributes):
        name, value = name.lower(), value.strip("\"'")
        if name == "hidden" or (name == "aria-hidden" and value == "true"):
            return True
        if name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value):
            return True
        if name == "role" and value.lower() in ROLES:
            return True
        if name in ("class", "id"):
            for one in value.split():
                words = [w.lower() for w in _PARTS.findall(one)]
                if HINTS.intersection(words) and not {"has", "with", "no", "without"}.intersection(words):
                    return True
    return False


class _Open:
    """The open elements: (tag, in boilerplate, in the article), and what of them is asked at every tag or text."""

    def __init__(self):
        self.stack: list[tuple[str, bool, bool]] = []
        self.blocks: list[int] = []  # places of block-level tags
        self.counts: Counter = Counter()
        self.inline: list[Counter] = [Counter()]  # since each open block

    def push(self, tag: str, bad: bool, article: bool) -> None:
        self.counts[tag] += 1
        if tag in BLOCKS:
            self.blocks.append(len(self.stack))
            self.inline.append(Counter())
        else:
            self.inline[-1][tag] += 1
        self.stack.append((tag, bad, article))

    def cut(self, k: int) -> None:
        """Closes element k and all inside it."""
        while len(self.stack) > k:
            tag = self.stack.pop()[0]
            self.counts[tag] -= 1
            if tag in BLOCKS:
                self.blocks.pop()
                self.inline.pop()
            else:
                self.inline[-1][tag] -= 1

    def last(self) -> tuple[str, bool, bool]:
        return self.stack[-1] if self.stack else ("", False, False)

    def block(self) -> tuple[str, bool, bool]:
        """The innermost open block."""
        return self.stack[self.blocks[-1]] if self.blocks else ("", False, False)

    def end(self, tag: str) -> None:
        """An end tag; those that fit no open element do nothing, inline ones close none beyond their block."""
        if tag in BLOCKS:
            if self.counts[tag]:
                self.cut(next(k for k in reversed(self.blocks) if self.stack[k][0] == tag))
        elif self.inline[-1][tag]:
            k = len(self.stack) - 1
            while self.stack[k][0] != tag:
                k -= 1
            self.cut(k)

    def begin(self, tag: str) -> None:
        """What a block-level start tag closes by itself: a paragraph, and items of the same list or table."""
        if tag != "option" and self.block()[0] == "p":
            self.cut(self.blocks[-1])
        if not any(self.counts[t] for t in SHUTS.get(tag, ())):
            return
        for k in reversed(self.blocks):
            other = self.stack[k][0]
            if other in SHUTS[tag]:
                self.cut(k)
                break
            if other in HOLDERS or (tag in ("td", "th") and other == "tr"):
                break


def blocks(html: str) -> list[Block]:
    """The page's blocks with text, in order. Tags may be unclosed or closed out of order."""
    out: list[Block] = []
    tags = _Open()
    run: list[str] = []
    linked = 0
    at, end = 0, len(html)

    def flush() -> None:
        nonlocal linked
        if text := " ".join("".join(run).split()):
            tag, boilerplate, _ = tags.block()
            out.append(Block(text, min(linked, len(text)), tag, boilerplate, tags.last()[2]))
        run.clear()
        linked = 0

    def say(raw: str) -> None:
        nonlocal linked
        if not raw or (tags.last()[1] and not tags.block()[1]):
            return  # nothing, or an advert or hidden part inside a line
        text = unescape(raw) if "&" in raw else raw
        run.append(text)
        if tags.counts["a"]:
            linked += len(" ".join(text.split()))

    for m in _TOKEN.finditer(html):
        if m.start() < at:
            continue
        say(html[at : m.start()])
        at = m.end()
        if m[2] is None:
            continue
        tag = m[2].lower()
        if m[1]:
            if tag in BLOCKS and tags.counts[tag]:
                flush()
            tags.end(tag)
            continue
        if tag in UNREAD and tag != "head":
            shut = _shut(tag).search(html, at)
            at = shut.end() if shut else end
            continue
        if tag == "br":
            run.append(" ")
        if tag in BLOCKS:
            flush()
            tags.begin(tag)
        if tag in VOID:
            continue
        _, bad, art = tags.last()
        own = tag in BOILERPLATE or _hinted(tag, m[3])
        tags.push(tag, bad or own, art or (tag in ("article", "main") and not own and not bad))
    say(_CUT_OFF.sub("", html[at:]))
    flush()
    return out


@lru_cache(maxsize=64)
def _shut(tag: str) -> re.Pattern:
    return re.compile(rf"</{re.escape(tag)}\b[^>]*>?", re.I)


def _density(text: str) -> float:
    words = text.lower().split()
    return sum(w.strip(".,;:!?()\"'«»„“”") in STOP_WORDS for w in words) / len(words)


def first_pass(b: Block, marked: bool, rules: Rules = Rules()) -> str:
    """good, bad, near (middling density), or open; marked: whether the page marks its article."""
    text_tag = b.tag in HEADINGS or b.tag == "p"
    if (b.boilerplate and not (b.article and b.tag in HEADINGS)) or (marked and not b.article):
        return "bad"
    if b.link_chars > rules.links * len(b.text) and not (b.article and text_tag):
        return "bad"
    if len(b.text) < rules.short:
        return "bad" if b.link_chars and not b.article else "open"
    share = _density(b.text)
    if share >= (rules.few if b.article else rules.many) and (b.article or len(b.text) >= rules.long):
        return "good"
    if share >= rules.few:
        return "near"
    return "open" if b.article or text_tag else "bad"


def classify(found: list[Block], rules: Rules = Rules()) -> list[bool]:
    """Whether each block is main text."""
    marked = any(b.article and not b.boilerplate for b in found)
    labels = [first_pass(b, marked, rules) for b in found]
    if "good" not in labels and not marked:
        labels = ["good" if x == "near" else x for x in labels]

    def nearest(places: range) -> list[str | None]:
        """The decided neighbour's label on one side; beyond an article's end it is good, beyond the page's there is none."""
        out: list[str | None] = [None] * len(found)
        last: str | None = None
        inside = False
        for k in places:
            if found[k].article != inside:
                inside = found[k].article
                last = "good" if inside else last
            out[k] = last
            if labels[k] in ("good", "bad") and not (inside and found[k].boilerplate):
                last = labels[k]
        return out

    before, after = nearest(range(len(found))), nearest(range(len(found) - 1, -1, -1))
    out = []
    for b, x, p, q in zip(found, labels, before, after):
        if x in ("good", "bad"):
            out.append(x == "good")
        elif p is None or q is None or p == q:
            out.append((p or q) == "good")
        else:
            out.append(b.article or x == "near" or b.tag == "p" or (b.tag in HEADINGS and q == "good"))
    return out


def main_text(html: str | None, rules: Rules = Rules()) -> str:
    """The main blocks, joined by line ends; null, empty or text-free html gives an empty text."""
    found = blocks(html or "")
    return "\n".join(b.text for b, good in zip(found, classify(found, rules)) if good)


def extract(pages: DataFrame, html_col: str = "html", text_col: str = "text", keep: tuple[str, ...] = ("page_id", "url"), rules: Rules = Rules()) -> DataFrame:
    """keep columns of pages, text_col and n_chars (its code points) of every row, repeated ones too; no shuffle. Null html is empty."""
    kinds = [(c, pages.schema[c].dataType.simpleString()) for c in keep]

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = [main_text(h, rules) for h in texts_of(batch.column(len(kinds)))]
        columns = [*batch.columns[:-1], pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())]
        return pa.RecordBatch.from_arrays(columns, [*keep, text_col, "n_chars"])

    schema = ", ".join(f"`{c}` {k}" for c, k in [*kinds, (text_col, "string"), ("n_chars", "bigint")])
    return map_batches(pages.select(*keep, utf8(html_col).alias("__html")), run, schema)


def op3_html(spark, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    return extract(table(spark, sf_dir, "pages"))
