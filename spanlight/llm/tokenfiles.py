"""Token ids in Arrow files: fixed-size-list batches of equal-length sequences and masks.

Documents in ascending id order are dealt to shards by range. A shard's ids run on through its sequences of
`length` ids, whose last one is filled up with zeros that its mask marks; beside it lies a table of its
documents (id, offset in the shard, number of ids). Sequence k lies in batch k // BATCH, so any sequence and its mask is
a slice of the mapped file without a copy. Ids take 16 bits if the vocabulary allows, else 32.

A shard's name holds its number only and its contents follow from its rows: a task that runs again writes the
same file under a passing name and renames it.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import text_column, vocabulary_path
from .common import cut, file_system, scratch, small_batches, table, utf8
from .tokens import Encoded, PieceCodes, held

#: Sequences of one Arrow batch.
BATCH = 64
LENGTH = 2048
END_ID = 2
#: Unknown pieces that the library encodes as one text.
GROUP = 512


def library_codes(path: str) -> PieceCodes:
    """The tokenizers library's ids of 16 or 32 bits; one for each worker process."""
    return held(_library_codes, path)


def _library_codes(path: str) -> PieceCodes:
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(path)
    library.no_truncation()
    library.no_padding()
    special = {t.content: k for k, t in library.get_added_tokens_decoder().items()}
    kind = np.uint16 if library.get_vocab_size() <= 1 << 16 else np.uint32

    # Tokens that begin with a space: each piece of a space and a word has one, its first.
    opens = np.zeros(library.get_vocab_size(), bool)
    opens[[k for t, k in library.get_vocab().items() if t.startswith("Ġ")]] = True
    line_end = library.token_to_id("Ċ")

    def ids_of(texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, kind) for e in library.encode_batch_fast(texts, add_special_tokens=False)]

    def spaced(words: list[str]) -> Encoded | None:
        """Words that follow a space, as one text whose ids are cut before each token that begins with a space."""
        ids = ids_of(["".join(words)])[0]
        at = np.flatnonzero(opens[ids])
        return (words, ids, np.diff(at, append=len(ids))) if len(at) == len(words) and not at[0] else None

    def lined(words: list[str]) -> Encoded | None:
        """Other words, as the lines of one text whose ids are cut at line ends."""
        ids = ids_of(["\n".join(words)])[0]
        end = ids == line_end
        at = np.flatnonzero(np.append(end, True))
        return (words, ids[~end], np.diff(at, prepend=-1) - 1) if len(at) == len(words) else None

    def encode(words: list[str]) -> Iterator[Encoded]:
        kinds: dict = {spaced: [], lined: [], None: []}
        for w in words:
            bare = w.split()
            kinds[None if len(bare) != 1 else lined if w == bare[0] else spaced if w == " " + bare[0] else None].append(w)
        for way, all_words in kinds.items():
            for k in range(0, len(all_words), GROUP):
                some = all_words[k : k + GROUP]
                if (found := way and way(some)) is None:
                    each = ids_of(some)
                    found = some, np.concatenate(each), np.array(list(map(len, each)))
                yield found

    def joined(text: str, n: int) -> tuple[np.ndarray, np.ndarray] | None:
        """Pieces of a space and others that follow it, cut like spaced()."""
        ids = ids_of([text])[0]
        at = np.flatnonzero(opens[ids])
        return (ids, np.diff(at, append=len(ids))) if len(at) == n and not at[0] else None

    return PieceCodes(encode, special, kind, joined)


def _schema(width: int, length: int) -> pa.Schema:
    return pa.schema([("tokens", pa.list_(pa.uint16() if width == 2 else pa.uint32(), length)), ("mask", pa.list_(pa.bool_(), length))])


class _Shard:
    """Writes one shard as its documents come; holds at most a batch and a document."""

    def __init__(self, uri: str, number: int, width: int, length: int):
        self.fs, at = file_system(uri)
        self.fs.create_dir(at)
        self.final, self.part = f"{at}/shard-{number:06d}.arrow", f"{at}/.{uuid.uuid4().hex}"
        self.kind = np.uint16 if width == 2 else np.uint32
        self.length, self.schema = length, _schema(width, length)
        self.stream = self.fs.open_output_stream(self.part)
        self.out = pa.ipc.new_file(self.stream, self.schema)
        self.waiting, self.n_waiting, self.total = [], 0, 0

    def add(self, ids: np.ndarray) -> None:
        self.waiting.append(ids)
        self.n_waiting += len(ids)
        self.total += len(ids)
        if self.n_waiting >= self.length * BATCH:
            ids = np.concatenate(self.waiting)
            full = len(ids) // (self.length * BATCH) * self.length * BATCH
            for k in range(0, full, self.length * BATCH):
                self._write(ids[k : k + self.length * BATCH])
            self.waiting, self.n_waiting = [ids[full:]], len(ids) - full

    def _write(self, ids: np.ndarray) -> None:
        n = -(-len(ids) // self.length) * self.length
        tokens, mask = np.zeros(n, self.kind), np.zeros(n, bool)
        tokens[: len(ids)], mask[: len(ids)] = ids, True
        lists = [pa.FixedSizeListArray.from_arrays(pa.array(x), self.length) for x in (tokens, mask)]
        self.out.write_batch(pa.RecordBatch.from_arrays(lists, schema=self.schema))

    def close(self) -> None:
        if self.n_waiting:
            self._write(np.concatenate(self.waiting))
        self.out.close()
        self.stream.close()
        self.fs.move(self.part, self.final)


def write_shards(docs: DataFrame, uri: str, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, length: int = LENGTH, end_id: int = END_ID) -> DataFrame:
    """Writes the shards to the folder uri and returns the table of documents: (id, shard, offset, n_tokens, start).

    Ascending ids, nulls first, ties by text; start counts the ids of all documents before. A null text is an
    empty one and has its end id alone. The table is written to the shared folder too, so the shards are made
    once. Only shards and their totals reach the driver.
    """
    path = path or vocabulary_path()
    spark = docs.sparkSession
    small_batches(spark)
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), utf8(text_col).alias("text"))
    rows = rows.repartitionByRange("id").sortWithinPartitions("id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number, shard = TaskContext.get().partitionId(), None
        codes = library_codes(path)
        width = codes.kind.itemsize
        for batch in batches:
            if not batch.num_rows:
                continue
            shard = shard or _Shard(uri, number, width, length)
            found, end = codes.encode(text_column(batch.column(1))), np.array([end_id], codes.kind)
            sizes = np.fromiter((len(ids) + 1 for ids in found), np.int64, len(found))
            offsets = shard.total + np.cumsum(sizes) - sizes
            shard.add(np.concatenate([x for ids in found for x in (ids, end)]))
            columns = [batch.column(0), pa.array([number] * len(sizes), pa.int32()), pa.array(offsets, pa.int64()), pa.array(sizes, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, ["id", "shard", "offset", "n_tokens"])
        if shard:
            shard.close()

    index = cut(rows.mapInArrow(run, f"id {kind}, shard int, offset bigint, n_tokens bigint"))
    totals = {r.shard: r.n for r in index.groupBy("shard").agg(F.sum("n_tokens").alias("n")).collect()}
    before, first = 0, []
    for shard in sorted(totals):
        first.append((shard, before))
        before += totals[shard]
    starts = spark.createDataFrame(first, "shard int, first bigint")
    return index.join(F.broadcast(starts), "shard").select("id", "shard", "offset", "n_tokens", (F.col("first") + F.col("offset")).alias("start"))


class Sequences:
    """One shard, opened for random access. A local file is mapped: sequence() and mask() are views of it."""

    def __init__(self, uri: str, number: int):
        fs, at = file_system(uri)
        name = f"{at}/shard-{number:06d}.arrow"
        local = fs.type_name == "local"
        self.file = pa.ipc.open_file(pa.memory_map(name) if local else fs.open_input_file(name))
        self.length = self.file.schema.field("tokens").type.list_size
        self._at, self._batch = -1, None

    def _in(self, batch: int) -> pa.RecordBatch:
        if batch != self._at:
            self._at, self._batch = batch, self.file.get_batch(batch)
        return self._batch

    def sequence(self, k: int) -> np.ndarray:
        tokens = self._in(k // BATCH).column(0).values
        return tokens.slice(k % BATCH * self.length, self.length).to_numpy(zero_copy_only=True)

    def mask(self, k: int) -> pa.BooleanArray:
        return self._in(k // BATCH).column(1).values.slice(k % BATCH * self.length, self.length)

    def ids(self, offset: int, n: int) -> np.ndarray:
        """n ids from an offset on, across batches."""
        parts, size = [], BATCH * self.length
        while n > 0:
            tokens = self._in(offset // size).column(0).values
            parts.append(tokens.slice(offset % size, n).to_numpy(zero_copy_only=True))
            offset, n = offset + len(parts[-1]), n - len(parts[-1])
        return np.concatenate(parts) if parts else np.zeros(0, np.uint16)


def read_documents(index: DataFrame, uri: str) -> DataFrame:
    """(id, start, n_tokens, ids_crc32) of every document of write_shards' table, from the files; repeated ids have a row each."""
    kind = index.schema["id"].dataType.simpleString()
    small_batches(index.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, opened = None, None
        for batch in batches:
            shards, offsets, sizes = (batch.column(k).to_pylist() for k in (1, 2, 3))
            sums = []
            for shard, offset, n in zip(shards, offsets, sizes):
                if shard != at:
                    at, opened = shard, Sequences(uri, shard)
                sums.append(crc32(opened.ids(offset, n).astype("<u4").tobytes()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(4), batch.column(3), pa.array(sums, pa.int64())], ["id", "start", "n_tokens", "ids_crc32"])

    return index.select("id", "shard", "offset", "n_tokens", "start").mapInArrow(run, f"id {kind}, start bigint, n_tokens bigint, ids_crc32 bigint")


def op6_arrow_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Writes the ids of every document to Arrow files in the shared folder, and reads each document back from them."""
    uri = scratch(spark, "sequences")
    index = write_shards(table(spark, sf_dir, "documents"), uri)
    return read_documents(index, uri).withColumnRenamed("id", "doc_id")
