"""What links of Jaccard similarity need beside fingerprints: sets of word shingles, and keys at which every similar pair meets.

Two sets of similarity 0.8 or more, the larger of n shingles, differ in at most 2n / 9 of them. Sizes are cut into
intervals so that such a pair lies in one or in two neighbouring ones. Each interval deals shingles by hash to more
parts than members of such a pair can differ in, so the pair has equal parts; a set's keys are the hashes of its
parts that are not empty, for its own interval and the next one. A set with too few of those to be sure of an equal
one puts out its empty parts also. So every pair meets at a key; the sets themselves then decide.
"""

from __future__ import annotations

from bisect import bisect_left

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import map_batches, schema_ddl, utf8

#: Words of a shingle, and the least similarity of a link, as a fraction.
SHINGLE, NUMERATOR, DENOMINATOR = 5, 4, 5
SEED = 42
#: Words whose hashes a worker remembers, lanes of counts(), and lanes of coarse(), 64 to an integer.
WORDS, LANES, PARITIES = 100_000, 256, 512
#: Rows of one batch of keys, about; a text's own are never split.
KEY_ROWS = 200_000
#: Bits of a key: fewer make a smaller shuffle, and more sets that meet by chance.
KEY_BITS = 48
_LAST = [0]


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) > WORDS:
            self.clear()
        out = self[word] = xxhash.xxh64_intdigest(word, SEED)
        return out


_hashes = _Hashes()


def shingles(text: bytes, shingle: int = SHINGLE) -> np.ndarray:
    """The sorted hashes of the text's distinct shingles; all its words are one if they are fewer. No words: none."""
    words = text.lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    each = np.fromiter(map(_hashes.__getitem__, words), np.uint64, len(words))
    k = min(shingle, len(words))
    n = len(words) - k + 1
    total = each[:n].copy()
    for i in range(1, k):
        total *= np.uint64(0x9E3779B97F4A7C15)
        total += each[i : i + n]
    return np.unique(_mix(total))


def digest(members: np.ndarray) -> int:
    """The signed 64-bit name of a set."""
    return int(np.uint64(xxhash.xxh64_intdigest(members.tobytes(), SEED)).astype(np.int64))


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _interval(n: int) -> int:
    """The number of the interval of sizes that holds n, from 1 up; _LAST has each one's largest size."""
    while _LAST[-1] < n * 2:
        _LAST.append((_LAST[-1] + 1) * DENOMINATOR // NUMERATOR)
    return bisect_left(_LAST, n)


def keys(members: np.ndarray) -> np.ndarray:
    """The keys of a set; two sets of similarity 0.8 or more have one in common. An empty set has none."""
    if not len(members):
        return np.zeros(0, np.int64)
    out, mixed = [], _mix(members + np.uint64(0x9E3779B97F4A7C15))
    own = _interval(len(members))
    for i in (own, own + 1):
        differ = _LAST[i] * 2 * (DENOMINATOR - NUMERATOR) // (DENOMINATOR + NUMERATOR)
        parts = differ + 1 + -(-differ // 10) + min(differ, 6)
        part = members % np.uint64(parts)
        order = np.argsort(part, kind="stable")
        part = part[order]
        first = np.flatnonzero(np.r_[True, part[1:] != part[:-1]])
        sums = np.add.reduceat(mixed[order], first)
        used = part[first]
        if len(used) <= differ:
            empty = np.setdiff1d(np.arange(parts, dtype=np.uint64), used)
            used, sums = np.r_[used, empty], np.r_[sums, np.zeros(len(empty), np.uint64)]
        out.append(_mix(sums + _mix(used + np.uint64(i << 32))))
    return (np.concatenate(out) >> np.uint64(64 - KEY_BITS)).view(np.int64)


def alike(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether the similarity is 0.8 or more, in whole numbers."""
    if min(len(a), len(b)) * DENOMINATOR < max(len(a), len(b)) * NUMERATOR:
        return False
    both = np.sort(np.concatenate([a, b]), kind="stable")
    shared = int((both[1:] == both[:-1]).sum())
    return shared * DENOMINATOR >= (len(both) - shared) * NUMERATOR


def counts(members: np.ndarray) -> np.ndarray:
    """How many members fall to each of LANES lanes, up to 127: counts of two sets differ by no more in sum than the sets do."""
    return np.minimum(np.bincount((members % np.uint64(LANES)).astype(np.int64), minlength=LANES), 127).astype(np.int8)


def coarse(members: np.ndarray) -> np.ndarray:
    """Whether the members in each of PARITIES lanes are odd in number: integers that travel with a set's keys.

    A member that only one of two sets has changes one lane, so no more lanes differ than members do.
    """
    n = np.bincount((members % np.uint64(PARITIES)).astype(np.int64), minlength=PARITIES)
    return np.packbits(n % 2 == 1, bitorder="little").view("<i8")


def may_be_alike_coarsely(a: list[Column], b: list[Column], size_a: Column, size_b: Column) -> Column:
    """may_be_alike() by those integers and the sizes, as a join's own condition; false for no similar pair.

    Segments of differing lanes are added up, and no sum may pass what all of them may have.
    """
    differ = sum((F.bit_count(x.bitwiseXOR(y)) for x, y in zip(a, b)), F.lit(0))
    fits = (size_a * NUMERATOR <= size_b * DENOMINATOR) & (size_b * NUMERATOR <= size_a * DENOMINATOR)
    return fits & (differ * (DENOMINATOR + NUMERATOR) <= (size_a + size_b) * (DENOMINATOR - NUMERATOR))


def may_be_alike(a: Column, b: Column, total: Column) -> Column:
    """Whether the counts of two sets of so many members leave room for a similarity of 0.8; false for no similar pair.

    Sets of that similarity differ in no more than a ninth of their members, all lanes together, so their chain of
    lanes may never have more differences.
    """
    differ = F.aggregate(F.zip_with(a, b, lambda x, y: F.abs(x.cast("int") - y)), F.lit(0), lambda s, x: s + x)
    return differ * (DENOMINATOR + NUMERATOR) <= total * (DENOMINATOR - NUMERATOR)


def named(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs and __set bigint, the name of the row's set; a null text is empty."""
    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        names = pa.array([digest(shingles(t)) for t in batch.column(batch.num_columns - 1).to_pylist()], pa.int64())
        return pa.RecordBatch.from_arrays([*batch.columns[:-1], names], [*batch.schema.names[:-1], "__set"])

    return map_batches(docs.select("*", utf8(text_col).alias("__t")), run, f"{schema_ddl(docs)}, __set bigint")


def keyed(docs: DataFrame, text_col: str) -> DataFrame:
    """(key, node): every key of every row's set; once a batch where rows are copies."""

    def run(batch: pa.RecordBatch):
        left: list[np.ndarray] = []
        nodes: list[np.ndarray] = []
        seen, rows = set(), 0

        def out() -> pa.RecordBatch:
            k, n = (np.concatenate([np.zeros(0, np.int64), *x]) for x in (left, nodes))
            return pa.RecordBatch.from_arrays([pa.array(k), pa.array(n)], ["key", "node"])

        for text in batch.column(0).to_pylist():
            members = shingles(text)
            name = digest(members)
            if name in seen:
                continue
            seen.add(name)
            some = keys(members)
            left.append(some)
            nodes.append(np.full(len(some), name, np.int64))
            rows += len(some)
            if rows > KEY_ROWS:
                yield out()
                left, nodes, rows = [], [], 0
        yield out()

    return map_batches(docs.select(utf8(text_col).alias("text")), run, "key bigint, node bigint")


def sets(docs: DataFrame, text_col: str) -> DataFrame:
    """(node, members binary) of every row."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = [shingles(t) for t in batch.column(0).to_pylist()]
        return pa.RecordBatch.from_arrays([pa.array(map(digest, found), pa.int64()), pa.array([x.tobytes() for x in found], pa.binary())], ["node", "members"])

    return map_batches(docs.select(utf8(text_col).alias("text")), run, "node bigint, members binary")


def verified(pairs: DataFrame, members: DataFrame) -> DataFrame:
    """The pairs (u, v) whose sets are alike."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        a, b = (batch.column(k).to_pylist() for k in (2, 3))
        good = pa.array([alike(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)) for x, y in zip(a, b)], pa.bool_())
        return pa.RecordBatch.from_arrays([batch.column(0).filter(good), batch.column(1).filter(good)], ["u", "v"])

    for end, name in (("u", "a"), ("v", "b")):
        pairs = pairs.join(members.select(F.col("node").alias(end), F.col("members").alias(name)), end)
    return map_batches(pairs.select("u", "v", "a", "b"), run, "u bigint, v bigint")
