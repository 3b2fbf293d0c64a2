"""SimHash near-duplicates by pigeonring filtering.

A fingerprint's 64 bits form a ring of four 16-bit segments. If two fingerprints differ in at most
three bits, some segment starts a chain whose first l segments differ in at most 3 * l / 4 bits, for
each l: 0, 1, 2, 3. The first two links give join keys: that segment, and one half of the next one (with
one differing bit, the other half is equal). The join's own condition then checks the rest of the chain
and the full Hamming distance, and keeps a pair at its first key only, so a bucket of b fingerprints
puts out its links and not its pairs.

Only distinct fingerprints take part, so copies cost nothing; hot buckets are split by the adaptive join.

deduplicate() links by similarity: fingerprints of five-word shingles are linked as above, and each link is checked
exactly. Most texts of similarity 0.8 differ in more bits than fingerprints can be searched for (each bit differs with
a chance of 0.15, so ten of 64 do), so what the ring cannot reach is found by the exact keys of jaccard.py.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import jaccard
from .common import by_ids, cut, map_batches, utf8
from .components import components

SEED = 42
SEGMENTS, SEGMENT_BITS = 4, 16
#: Lesser keys that travel with a key, so that a pair is put out at few of its common ones.
BEFORE = 16
COARSE = tuple(f"c{k}" for k in range(jaccard.PARITIES // 64))
_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)


def fingerprint(text: bytes, shingle: int = 3, seed: int = SEED) -> int:
    """The fingerprint of one text, as a signed 64-bit integer. No words: 0."""
    words = text.lower().split()
    if not words:
        return 0
    if len(words) <= shingle:
        hashes = np.array([xxhash.xxh64_intdigest(b" ".join(words), seed)], dtype=np.uint64)
    else:
        line = b" ".join(words)
        size = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
        end = np.cumsum(size + 1) - 1
        start = (end - size)[: 1 - shingle].tolist()
        digest = xxhash.xxh64_intdigest
        hashes = np.fromiter((digest(line[a:b], seed) for a, b in zip(start, end[shingle - 1 :].tolist())), dtype=np.uint64, count=len(start))
    return majority(hashes)


def majority(hashes: np.ndarray) -> int:
    """The bits that over half the hashes have, as a signed 64-bit integer."""
    lanes = hashes.astype("<u8").view(np.uint8).reshape(-1, 8)
    counts = np.concatenate([np.bincount(lanes[:, k], minlength=256) @ _BITS for k in range(8)])
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """(id, fp bigint) of every row; null text is empty."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        fps = pa.array([fingerprint(t, shingle) for t in batch.column(1).to_pylist()], pa.int64())
        return pa.RecordBatch.from_arrays([batch.column(0), fps], ["id", "fp"])

    kind = docs.schema[id_col].dataType.simpleString()
    return map_batches(docs.select(F.col(id_col).alias("id"), utf8(text_col).alias("text")), run, f"id {kind}, fp bigint")


def _segment(fp: Column, i: int) -> Column:
    return F.shiftrightunsigned(fp, SEGMENT_BITS * (i % SEGMENTS)).bitwiseAND(F.lit(0xFFFF))


def _half(segment: Column, h: int) -> Column:
    return F.shiftrightunsigned(segment, 8 * h).bitwiseAND(F.lit(0xFF))


def _keys(fp: Column) -> Column:
    """Eight keys: chain start, its segment, half of the next segment."""
    return F.array(
        *(
            (F.lit((2 * i + h) << 24).cast("bigint") + _segment(fp, i) * 256 + _half(_segment(fp, i + 1), h))
            for i in range(SEGMENTS)
            for h in range(2)
        )
    )


def _ring(nodes: DataFrame, max_bits: int) -> tuple[DataFrame, DataFrame, Column, Column, Column]:
    """Both sides of the join, and its conditions: a common key; the chain, at the first key where it holds; the Hamming distance."""
    if not 0 <= max_bits < SEGMENTS:
        raise ValueError(f"max_bits must be 0 to {SEGMENTS - 1}")
    keyed = nodes.select("node", "fp", F.explode(_keys(F.col("fp"))).alias("key"))
    a, b = (keyed.select(*(F.col(c).alias(f"{c}_{s}") for c in ("node", "fp", "key"))) for s in "ab")
    x = F.col("fp_a").bitwiseXOR(F.col("fp_b"))
    off = [F.bit_count(_segment(x, i)) for i in range(SEGMENTS)]

    def chain(i: int) -> Column:
        total, held = F.lit(0), F.lit(True)
        for l in range(1, SEGMENTS + 1):
            total = total + off[(i + l - 1) % SEGMENTS]
            held = held & (total <= (l * max_bits) // SEGMENTS)
        return held

    first = None
    for i in range(SEGMENTS):
        for h in range(2):
            hit = (_half(_segment(x, i + 1), h) == 0) & chain(i)
            first = F.when(hit, 2 * i + h) if first is None else first.when(hit, 2 * i + h)
    met = (F.col("key_a") == F.col("key_b")) & (F.col("fp_a") < F.col("fp_b"))
    owned = first == F.shiftright("key_a", 24)
    return a, b, met, owned, F.bit_count(x) <= max_bits


def links(nodes: DataFrame, max_bits: int = 3) -> DataFrame:
    """(u, v) of nodes (node, fp; distinct fps) whose fingerprints differ in at most max_bits (0 to 3) bits, each pair once."""
    a, b, met, owned, near = _ring(nodes, max_bits)
    return a.join(b, met & owned & near).select(F.col("node_a").alias("u"), F.col("node_b").alias("v"))


def candidates(nodes: DataFrame, max_bits: int = 3) -> dict[str, int]:
    """How many pairs meet at a key, how many of them the chain leaves at the key that owns them, and how many are links."""
    a, b, met, owned, near = _ring(nodes, max_bits)
    row = a.join(b, met).agg(F.count("*").alias("met"), F.count_if(owned).alias("chain"), F.count_if(owned & near).alias("links")).first()
    return row.asDict()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, max_bits: int = 3) -> DataFrame:
    """(id, fp bigint, component_id) of every row of docs; component_id is the smallest id reachable by links.

    Rows with equal fingerprints are one node. A null text is an empty one (fingerprint 0). A row with a null
    id keeps its fingerprint, has a null component and links nothing. Repeated rows give repeated results.
    """
    fps = cut(fingerprints(docs, id_col, text_col, shingle))
    nodes = cut(fps.filter("id is not null").groupBy("fp").agg(F.min("id").alias("node")))
    roots = components(links(nodes, max_bits), "u", "v")
    classes = nodes.join(roots, "node", "left").select("fp", F.coalesce("root", "node").alias("component_id"))
    return fps.join(classes, "fp", "left").select("id", "fp", F.when(F.col("id").isNotNull(), F.col("component_id")).alias("component_id"))


def _read(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, node, fp, size, c0 to c7, counts) of every row: the name of its set, the set's fingerprint, size, coarse and fine counts."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = [jaccard.shingles(t) for t in batch.column(1).to_pylist()]
        packed = [jaccard.coarse(m) for m in found]
        columns = [
            batch.column(0),
            pa.array([jaccard.digest(m) for m in found], pa.int64()),
            pa.array([majority(m) if len(m) else 0 for m in found], pa.int64()),
            pa.array(map(len, found), pa.int32()),
            *(pa.array([int(c[k]) for c in packed], pa.int64()) for k in range(len(COARSE))),
            pa.array([jaccard.counts(m) for m in found], pa.list_(pa.int8())),
        ]
        return pa.RecordBatch.from_arrays(columns, ["id", "node", "fp", "size", *COARSE, "counts"])

    kind = docs.schema[id_col].dataType.simpleString()
    lanes = ", ".join(f"{c} bigint" for c in COARSE)
    return map_batches(docs.select(F.col(id_col).alias("id"), utf8(text_col).alias("text")), run, f"id {kind}, node bigint, fp bigint, size int, {lanes}, counts array<tinyint>")


def _with_before(met: DataFrame) -> DataFrame:
    """met (key, node; distinct rows) and before array<bigint>, the node's BEFORE next lesser keys."""
    lesser = Window.partitionBy("node").orderBy("key").rowsBetween(-BEFORE, -1)
    return met.withColumn("before", F.collect_list("key").over(lesser))


def _meeting(held: DataFrame) -> DataFrame:
    """(u, v) of nodes of different roots that meet at a key and whose parities leave room for a link, at few of their common keys.

    Of held (key, before, node, root, size, c0 to c7). A pair is left out at a key where both have a common key right before
    it: it meets there too, and at its least common key it is never left out.
    """
    a, b = (held.select(*(F.col(c).alias(f"{c}_{s}") for c in held.columns)) for s in "ab")
    packed = ([F.col(f"{c}_{s}") for c in COARSE] for s in "ab")
    room = jaccard.may_be_alike_coarsely(*packed, F.col("size_a"), F.col("size_b"))
    met = (F.col("key_a") == F.col("key_b")) & (F.col("node_a") < F.col("node_b")) & (F.col("root_a") != F.col("root_b"))
    pairs = a.join(b, met & room & ~F.arrays_overlap("before_a", "before_b"))
    return pairs.select(F.col("node_a").alias("u"), F.col("node_b").alias("v"))


def _left(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """The distinct pairs (u, v) of nodes whose counts leave room for a link."""
    pairs = pairs.distinct()
    for end, name in (("u", "a"), ("v", "b")):
        pairs = pairs.join(nodes.select(F.col("node").alias(end), F.col("size").alias(f"n{name}"), F.col("counts").alias(name)), end)
        pairs = pairs if end == "u" else pairs.filter("4 * na <= 5 * nb and 4 * nb <= 5 * na")
    return pairs.filter(jaccard.may_be_alike(F.col("a"), F.col("b"), F.col("na") + F.col("nb"))).select("u", "v")


def _linked(pairs: DataFrame, docs: DataFrame, rows: DataFrame, id_col: str, text_col: str, repeated: bool) -> DataFrame:
    """The pairs whose sets are alike; only the texts of their nodes are read again. repeated: whether ids are."""
    nodes = cut(pairs.select(F.explode(F.array("u", "v")).alias("node")).distinct())
    ids = cut(rows.select("id", "node").join(nodes, "node").groupBy("node").agg(F.min("id").alias(id_col)).select(id_col).distinct())
    texts = docs.select(id_col, text_col)
    members = jaccard.sets(by_ids(texts, ids, id_col).union(texts.filter(F.col(id_col).isNull())), text_col)
    members = by_ids(members, nodes, "node")
    members = cut(members.dropDuplicates(["node"]) if repeated else members)
    return cut(jaccard.verified(pairs, members))


def _roots(docs: DataFrame, rows: DataFrame, id_col: str, text_col: str, max_bits: int, repeated: bool) -> DataFrame:
    """(node, root) of sets that a link joins to a lesser one, rows being _read() of docs.

    The ring's links come first. Sets that meet at an exact key are then compared with the least of them, and only those
    that are not yet in one component with each other, so a group of many near copies costs rows in proportion to its size.
    """
    nodes = cut(rows.drop("id").dropDuplicates(["node"]))
    prints = nodes.groupBy("fp").agg(F.min("node").alias("node"))
    same = nodes.select("fp", "node").join(prints.withColumnRenamed("node", "least"), "fp").filter("node > least")
    near = links(prints, max_bits).union(same.select(F.col("least").alias("u"), F.col("node").alias("v")))
    least = Window.partitionBy("key").orderBy("node")
    met = cut(jaccard.keyed(docs, text_col).withColumn("least", F.first("node").over(least)).filter("node > least").distinct())
    first = cut(_left(met.select(F.col("least").alias("u"), F.col("node").alias("v")).union(near), nodes))
    roots = cut(components(_linked(first, docs, rows, id_col, text_col, repeated), "u", "v"))
    held = _with_before(met.select("key", "node")).join(nodes, "node").join(roots, "node", "left")
    rest = cut(_left(_meeting(held.select("key", "before", "node", F.coalesce("root", "node").alias("root"), "size", *COARSE)), nodes))
    more = _linked(rest, docs, rows, id_col, text_col, repeated)
    return components(roots.select(F.col("node").alias("u"), F.col("root").alias("v")).union(more), "u", "v")


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_bits: int = 3) -> DataFrame:
    """One row of docs for each group that links of similarity join, all columns: that of the smallest id.

    A link is a Jaccard similarity of jaccard.NUMERATOR / jaccard.DENOMINATOR or more over shingles of jaccard.SHINGLE
    words; none is lost. Texts of equal sets are one, those without words too. A null id is the largest; rows that share
    an id, or have none, are told apart by their sets.
    """
    rows = cut(_read(docs, id_col, text_col))
    several = cut(rows.groupBy("id").agg(F.count("*").alias("n")).filter("n > 1 or id is null").select("id"))
    repeated = not several.isEmpty()
    grouped = rows.select("id", "node").join(_roots(docs, rows, id_col, text_col, max_bits, repeated), "node", "left").select("id", "node", F.coalesce("root", "node").alias("root"))
    best = cut(grouped.groupBy("root").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "node")).alias("best")).select("best.id", "best.node"))
    # Most rows stay: those that go, and the ids that one row alone can't decide, are the shorter list.
    gone = cut(rows.select("id").join(best, "id", "left_anti").filter("id is not null").union(several.filter("id is not null")).distinct().withColumnRenamed("id", id_col))
    out = by_ids(docs.filter(F.col(id_col).isNotNull()), gone, id_col, "left_anti").select(docs.columns)
    if not repeated:
        return out
    more = best.join(several.select(F.col("id").alias("__k")), F.col("id").eqNullSafe(F.col("__k")), "left_semi")
    odd = docs.withColumn("__id", F.col(id_col)).join(several.select(F.col("id").alias("__k")), F.col("__id").eqNullSafe(F.col("__k")), "left_semi")
    odd = jaccard.named(odd, text_col).join(more.select(F.col("id").alias("__k"), "node"), F.col("__id").eqNullSafe(F.col("__k")) & (F.col("__set") == F.col("node")), "left_semi")
    return out.union(odd.dropDuplicates(["__id", "__set"]).select(docs.columns))


def op10_simhash(spark, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document: three-word shingles, links of three bits at most."""
    from .common import table

    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
