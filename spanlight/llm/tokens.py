"""Cutting texts into pieces whose tokens do not depend on their neighbours.

The byte-level pattern joins at most one space to what follows and never joins other words, so a text can
be cut before every space that follows a word, and around a line end that stands between words; NumPy does so for a
whole batch. Where spaces meet other white space that cut is wrong, and a pattern cuts between words and runs of
white space instead. Both cuts give the tokens of the whole text.

Each piece is tokenized once and kept. A piece of up to 15 bytes is two integers, its bytes and their number, and is
looked up in a hash table of NumPy arrays, a batch at a time; longer ones, and words, lie in dictionaries.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex

#: The pattern of byte-level vocabularies, and Unicode's white space, which it means by \s.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
WHITE = "\t\n\x0b\x0c\r \x85\xa0                　"

_WORDS = regex.compile(PATTERN)
_PIECE = re.compile(f" ?[^{WHITE}]+|[{WHITE}]+(?![^{WHITE}])|[{WHITE}]+")
_UNUSUAL = re.compile(f"[{WHITE.replace(' ', '').replace(chr(10), '')}]")
#: What the quick cut does not hold for, as a pattern of Arrow's.
_ODD = "  |\n |[" + "".join(f"\\x{{{ord(c):x}}}" for c in WHITE if c not in " \n") + "]"
#: Bytes of either half of a worker's dictionaries, about; code points of the longest piece that they keep; bytes of an
#: entry besides its own; ids put together at once, about.
MEMORY, LONGEST, _ENTRY, _AT_ONCE = 12_000_000, 64, 200, 1 << 20
#: Slots of either half of a worker's hash table, a power of two; with its ids a half has some 26 bytes a slot.
SLOTS = 1 << 19
#: Texts that count() cuts at once, and unknown pieces that encode_spaced() gets at once.
COUNTED, GROUP = 128, 512

#: Words, their ids one after the other, and the number of ids of each.
Encoded = tuple[list[str], np.ndarray, np.ndarray]


def pieces(text: str) -> list[str]:
    """The text's pieces, in order; joined they are the text."""
    if "  " in text or "\n " in text or _UNUSUAL.search(text):
        return _PIECE.findall(text)
    first, *rest = text.split(" ")
    return [first, *[" " + p for p in rest]] if first else [" " + p for p in rest]


def _runs(first: np.ndarray, size: np.ndarray, flat: np.ndarray) -> np.ndarray:
    """flat's runs of given beginnings and sizes, one after the other."""
    ends = np.cumsum(size)
    total = int(ends[-1]) if len(ends) else 0
    out = np.empty(total, flat.dtype)
    cuts = np.searchsorted(ends, np.arange(_AT_ONCE, total, _AT_ONCE)) + 1
    for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(size)]):
        x, y = (int(ends[k - 1]) if k else 0 for k in (a, b))
        at = np.repeat(first[a:b] - (ends[a:b] - size[a:b]), size[a:b])
        at += np.arange(x, y)
        out[x:y] = flat[at]
    return out


_HELD: dict = {}


def held(make: Callable, path: str):
    """make(path), kept by the process until another is asked for: workers outlive a stage, and its coder goes with the next one."""
    if (make, path) not in _HELD:
        _HELD.clear()
        _HELD[make, path] = make(path)
    return _HELD[make, path]


class _Known:
    """Names and the ids of each, in arrays that grow."""

    def __init__(self, kind: np.dtype):
        self.at: dict[str, int] = {}
        self.ids, self.first, self.size = np.empty(1 << 16, kind), np.empty(1 << 14, np.int64), np.empty(1 << 14, np.int64)
        self.n = self.n_ids = self.held = 0

    def add(self, names: list[str], ids: np.ndarray, size: np.ndarray) -> np.ndarray:
        """The new numbers of names."""
        n, n_ids = self.n + len(names), self.n_ids + len(ids)
        if n_ids > len(self.ids):
            self.ids = np.concatenate([self.ids[: self.n_ids], np.empty(n_ids, self.ids.dtype)])
        if n > len(self.first):
            self.first, self.size = (np.concatenate([x[: self.n], np.empty(n, np.int64)]) for x in (self.first, self.size))
        self.ids[self.n_ids : n_ids] = ids
        self.size[self.n : n] = size
        self.first[self.n : n] = self.n_ids + np.cumsum(size) - size
        numbers = range(self.n, n)
        self.at.update(zip(names, numbers))
        self.held += _ENTRY * len(names) + len("".join(names)) + ids.nbytes
        self.n, self.n_ids = n, n_ids
        return np.arange(numbers.start, n)

    def runs(self, numbers: np.ndarray) -> np.ndarray:
        return _runs(self.first[numbers], self.size[numbers], self.ids)


#: Masks of the first n bytes of a little-endian integer, and the bytes of the longest piece of the hash table.
_FIRST = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)
SHORT = 15


def _packed(data: np.ndarray, first: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pieces of up to SHORT bytes as two integers each, the second never 0; 16 bytes must follow the last piece."""
    at = np.ndarray((len(data) - 7,), "<u8", data, strides=(1,))
    low, high = at[first] & _FIRST[np.minimum(size, 8)], at[first + 8] & _FIRST[np.maximum(size - 8, 0)]
    return low, high | ((size + 1).astype(np.uint64) << np.uint64(56))


class _Table:
    """Ids of packed pieces, by open addressing."""

    def __init__(self, slots: int, kind: np.dtype):
        self.mask, self.low, self.high = slots - 1, np.zeros(slots, np.uint64), np.zeros(slots, np.uint64)
        self.first, self.size = np.zeros(slots, np.int32), np.zeros(slots, np.uint8)
        self.ids, self.n, self.n_ids = np.empty(slots, kind), 0, 0

    def find(self, low: np.ndarray, high: np.ndarray, insert: bool) -> tuple[np.ndarray, np.ndarray]:
        """The slot of each piece, -1 where there is none; if insert, none lacks one, and one piece of each new slot."""
        mixed = (low ^ (high * np.uint64(0xC2B2AE3D27D4EB4F))) * np.uint64(0x9E3779B97F4A7C15)
        slot = ((mixed ^ (mixed >> np.uint64(32))) & np.uint64(self.mask)).astype(np.int64)
        left, new = np.arange(len(low)), []
        while len(left):
            at = slot[left]
            high_at = self.high[at]
            free = high_at == 0
            other = ~free & ((high_at != high[left]) | (self.low[at] != low[left]))
            slot[left[other]] = (at[other] + 1) & self.mask
            if not insert:
                slot[left[free]] = -1
                left = left[other]
                continue
            asking = left[free]
            at = slot[asking]
            self.first[at] = asking
            won = asking[self.first[at] == asking]
            self.low[slot[won]], self.high[slot[won]] = low[won], high[won]
            new.append(won)
            left = left[free | other]
        new = np.concatenate([np.zeros(0, np.int64), *new])
        self.n += len(new)
        return slot, new

    def put(self, slots: np.ndarray, ids: np.ndarray, size: np.ndarray) -> None:
        """The ids of new slots."""
        n = self.n_ids + len(ids)
        if n > len(self.ids):
            self.ids = np.concatenate([self.ids[: self.n_ids], np.empty(max(n, 2 * self.n_ids) - self.n_ids, self.ids.dtype)])
        self.ids[self.n_ids : n] = ids
        self.first[slots], self.size[slots] = self.n_ids + np.cumsum(size) - size, size
        self.n_ids = n


def _bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of large strings without nulls, and where each begins, and the end."""
    _, offsets, data = texts.buffers()
    bounds = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(data, np.uint8)[bounds[0] : bounds[-1]] if data else np.zeros(0, np.uint8)
    return data, bounds - bounds[0]


class PieceCodes:
    """Ids of texts, by way of encode_words(unknown words of the pattern), which may put them in another order.

    encode_spaced(pieces, their number), if there is one, takes pieces of a space and what has no white space, joined,
    and gives their ids one after the other and the number of ids of each, or None where it can't tell them apart.

    What is known, pieces and words, lies in two halves, bounded in bytes: a full new half becomes the old one, and
    what is met again moves to the new half, so frequent pieces stay and rare ones go.
    """

    def __init__(self, encode_words: Callable[[list[str]], Iterable[Encoded]], special: dict[str, int], kind=np.uint32, encode_spaced: Callable | None = None):
        self.encode_words, self.special, self.kind, self.encode_spaced = encode_words, special, np.dtype(kind), encode_spaced
        self.new, self.old = _Known(self.kind), _Known(self.kind)
        self.table = self.former = _Table(SLOTS, self.kind)
        self.split = re.compile("(" + "|".join(map(re.escape, sorted(special, key=len, reverse=True))) + ")") if special else None

    def cut(self, text: str) -> list[str]:
        if self.split is None or not any(s in text for s in self.special):
            return pieces(text)
        out: list[str] = []
        for part in self.split.split(text):
            out += [part] if part in self.special else pieces(part)
        return out

    def _words(self, names: list[str]) -> list[str]:
        """What of names is not known, after what the old half knows has moved."""
        lost = [x for x in names if x not in self.new.at]
        if self.old.n and lost:
            again = [x for x in lost if x in self.old.at]
            numbers = np.array([self.old.at[x] for x in again], np.int64)
            self.new.add(again, self.old.runs(numbers), self.old.size[numbers])
            lost = [x for x in lost if x not in self.old.at]
        return lost

    def _learn(self, fresh: list[str]) -> None:
        """Makes unknown pieces known."""
        spaced, others = [], []
        for p in fresh:
            (spaced if p[:1] == " " and len(p) > 1 and not p[1].isspace() else others).append(p)
        # Pieces of a space and a word, cut together: each begins at a space.
        words = _WORDS.findall("".join(spaced))
        starts = [k for k, w in enumerate(words) if w[0] == " "]
        if len(starts) != len(spaced):
            spaced, others, words, starts = [], fresh, [], []
        chosen, ends = spaced + others, starts[1:] + [len(words)][: len(starts)]
        for p in others:
            words += [p] if p in self.special else _WORDS.findall(p)
            ends.append(len(words))
        unknown = self._words(list(dict.fromkeys(words)))
        if own := [w for w in unknown if w in self.special]:
            self.new.add(own, np.array([self.special[w] for w in own], self.kind), np.ones(len(own), np.int64))
            unknown = [w for w in unknown if w not in self.special]
        for names, ids, size in self.encode_words(unknown) if unknown else ():
            self.new.add(names, ids, size)
        ends = np.array(ends)
        count = np.diff(ends, prepend=0)
        several = np.flatnonzero(count != 1)
        if len(several):
            inner = _runs((ends - count)[several], count[several], np.array([self.new.at[w] for w in words], np.int64))
            size = np.concatenate([[0], np.cumsum(self.new.size[inner])])
            edge = np.concatenate([[0], np.cumsum(count[several])])
            self.new.add([chosen[k] for k in several.tolist()], self.new.runs(inner), np.diff(size[edge]))

    def numbers(self, distinct: list[str]) -> np.ndarray:
        """The number of each piece in the new half."""
        out = np.fromiter(map(self.new.at.get, distinct, repeat(-1)), np.int64, len(distinct))
        lost = np.flatnonzero(out < 0)
        names = [distinct[k] for k in lost.tolist()]
        if fresh := self._words(names):
            self._learn(fresh)
        out[lost] = np.fromiter(map(self.new.at.__getitem__, names), np.int64, len(names))
        return out

    def _bounded(self, distinct: list[str]) -> None:
        for p in distinct:
            if len(p) > LONGEST:
                self.new.at.pop(p, None)
        if self.new.held > MEMORY:
            self.old, self.new = self.new, _Known(self.kind)

    def _named(self, names: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of pieces by way of the dictionaries, and the number of ids of each."""
        at = {p: k for k, p in enumerate(dict.fromkeys(names))}
        distinct = list(at)
        numbers = self.numbers(distinct)[np.fromiter(map(at.__getitem__, names), np.int64, len(names))]
        out = self.new.runs(numbers), self.new.size[numbers]
        self._bounded(distinct)
        return out

    def _fresh(self, data: np.ndarray, first: np.ndarray, size: np.ndarray, plain: bool) -> list[tuple]:
        """For pieces that the table has no ids of, (which, ids, number of ids of each)."""
        spaced = np.zeros(len(first), bool)
        if plain and self.encode_spaced:
            # A text's own line ends stay in pieces where they meet, and a space may end a text.
            ends = first + size
            lines = np.flatnonzero(data == 10)
            spaced = (data[first] == 32) & (size > 1) & (np.searchsorted(lines, first) == np.searchsorted(lines, ends))
        out, rest = [], [np.flatnonzero(~spaced)]
        which = np.flatnonzero(spaced)
        for k in range(0, len(which), GROUP):
            some = which[k : k + GROUP]
            joined = _runs(first[some], size[some], data).tobytes().decode()
            found = self.encode_spaced(joined, len(some))
            if found is None:
                rest.append(some)
            else:
                out.append((some, *found))
        if len(rest := np.concatenate(rest)):
            raw = data.tobytes()
            out.append((rest, *self._named([raw[a : a + n].decode() for a, n in zip(first[rest].tolist(), size[rest].tolist())])))
        return out

    def _sliced(self, data: np.ndarray, first: np.ndarray, size: np.ndarray, plain: bool, counted: bool) -> tuple[np.ndarray, np.ndarray | None]:
        """The number of ids of each piece, and the ids of all unless counted; pieces are fewer than a quarter of the slots."""
        if self.table.n * 2 > self.table.mask:
            self.former, self.table = self.table, _Table(self.table.mask + 1, self.kind)
        table, former = self.table, self.former
        short = size <= SHORT
        within, beyond = np.flatnonzero(short), np.flatnonzero(~short)
        low, high = _packed(data, first[within], size[within])
        slot, new = table.find(low, high, True)
        if len(new) and former is not table:
            known, _ = former.find(low[new], high[new], False)
            has = known >= 0
            again = known[has]
            table.put(slot[new[has]], _runs(former.first[again].astype(np.int64), former.size[again].astype(np.int64), former.ids), former.size[again].astype(np.int64))
            new = new[~has]
        for which, ids, n in self._fresh(data, first[within[new]], size[within[new]], plain) if len(new) else ():
            table.put(slot[new[which]], ids, n)
        n_ids = np.empty(len(first), np.int64)
        n_ids[within] = table.size[slot]
        begin, flat = np.empty(0 if counted else len(first), np.int64), table.ids
        if not counted:
            begin[within] = table.first[slot]
        if len(beyond):
            raw = data.tobytes()
            ids, n_ids[beyond] = self._named([raw[a : a + n].decode() for a, n in zip(first[beyond].tolist(), size[beyond].tolist())])
            if not counted:
                begin[beyond] = table.n_ids + np.cumsum(n_ids[beyond]) - n_ids[beyond]
                flat = np.concatenate([table.ids[: table.n_ids], ids])
        return n_ids, None if counted else _runs(begin, n_ids, flat)

    def _lined(self, data: np.ndarray, first: np.ndarray, size: np.ndarray, ends: np.ndarray, plain: bool, counted: bool) -> list:
        """The ids, or if counted their numbers, of texts of the pieces of data that begin at first, text k's up to ends[k + 1]."""
        data = np.concatenate([data, np.zeros(SHORT + 1, np.uint8)])
        step = max(1, (self.table.mask + 1) // 4)
        done = [self._sliced(data, first[k : k + step], size[k : k + step], plain, counted) for k in range(0, len(first), step)]
        edges = np.concatenate([[0], np.cumsum(np.concatenate([np.zeros(0, np.int64), *(n for n, _ in done)]))])[ends]
        if counted:
            return np.diff(edges).tolist()
        out = np.concatenate([np.zeros(0, self.kind), *(ids for _, ids in done)])
        return [out[a:b] for a, b in zip(edges.tolist(), edges[1:].tolist())]

    def _plain(self, texts: pa.Array, counted: bool) -> list:
        """_lined() of texts that the quick cut holds for."""
        data, bounds = _bytes(texts)
        space, line = data == 32, data == 10
        cut = space.copy()
        if line.any():
            at = np.flatnonzero(line)
            white = space | line
            alone = at[~white[np.maximum(at - 1, 0)] & ~white[np.minimum(at + 1, len(data) - 1)] & (at > 0) & (at < len(data) - 1)]
            cut[alone] = cut[alone + 1] = True
        cut[bounds[:-1][np.diff(bounds) > 0]] = True
        first = np.flatnonzero(cut)
        return self._lined(data, first, np.diff(first, append=len(data)), np.searchsorted(first, bounds), True, counted)

    def encode(self, texts: pa.Array | list[str]) -> list[np.ndarray]:
        """The ids of each text; texts hold no null."""
        return self._each(texts, False)

    def count(self, texts: pa.Array | list[str]) -> list[int]:
        """How many ids each text has; texts hold no null. Some texts at a time, for only counts are kept."""
        return [n for k in range(0, len(texts), COUNTED) for n in self._each(texts[k : k + COUNTED], True)]

    def _each(self, texts: pa.Array | list[str], counted: bool) -> list:
        texts = pa.array(texts, pa.large_string())
        if not len(texts):
            return []
        odd = pc.match_substring_regex(texts, _ODD)
        for s in self.special:
            odd = pc.or_(odd, pc.match_substring(texts, s))
        where = np.flatnonzero(odd.to_numpy(zero_copy_only=False))
        if not len(where):
            return self._plain(texts, counted)
        out = self._plain(pc.if_else(odd, "", texts), counted)
        lists = [self.cut(texts[k].as_py()) for k in where.tolist()]
        data, bounds = _bytes(pa.array([p for x in lists for p in x], pa.large_string()))
        ends = np.concatenate([[0], np.cumsum(list(map(len, lists)))])
        for k, ids in zip(where.tolist(), self._lined(data, bounds[:-1], np.diff(bounds), ends, False, counted)):
            out[k] = ids
        return out
