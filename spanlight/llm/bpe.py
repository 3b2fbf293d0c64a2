"""Byte-pair encoding: a priority queue of merge ranks over a doubly linked list of symbols.

The queue holds (rank, position) of each adjacent pair that has a merge. The least is popped; it is stale, and
skipped, if its left symbol is gone or its pair has changed since. Else the right symbol is taken out of the
list and the new pairs on both sides are pushed. Decoding concatenates the vocabulary's byte strings.
"""

from __future__ import annotations

import json
from heapq import heapify, heappop, heappush
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_batches, table, utf8
from .tokens import Encoded, PieceCodes, held

#: The vocabulary of the queries; a parameter of the operators.
VOCABULARY = "byte_bpe_50k.json"


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def byte_letters() -> list[str]:
    """The letter that stands for each byte in vocabulary files: printable ones themselves, the others from 256 up."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(other)) for b in range(256)]


class BytePairs:
    """Encoder and decoder of one vocabulary file (the tokenizers library's JSON)."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab, letters = spec["model"]["vocab"], byte_letters()
        byte_of = {c: b for b, c in enumerate(letters)}
        self.first = [vocab[c] for c in letters]
        merges = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        self.merged = [vocab[a + b] for a, b in merges]
        self.rank = {vocab[a] << 32 | vocab[b]: k for k, (a, b) in reversed(list(enumerate(merges)))}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.strings = [b""] * (1 + max([*vocab.values(), *self.special.values()]))
        for token, k in [*vocab.items(), *self.special.items()]:
            self.strings[k] = bytes(byte_of[c] for c in token) if all(c in byte_of for c in token) else token.encode()
        self.codes = PieceCodes(self._words, self.special, "<u4")

    def merge(self, data: bytes) -> list[int]:
        """The ids of one word of the pattern."""
        symbol, rank, merged, n = [self.first[b] for b in data], self.rank.get, self.merged, len(data)
        if n < 2:
            return symbol
        shift = n.bit_length()
        at = (1 << shift) - 1
        #: pair[i]: the rank of symbol i and the next one, -1 if they don't merge or i is gone
        pair = [rank(a << 32 | b, -1) for a, b in zip(symbol, symbol[1:])]
        pair.append(-1)
        queue = [r << shift | i for i, r in enumerate(pair) if r >= 0]
        heapify(queue)
        before, after = list(range(-1, n - 1)), [*range(1, n), -1]
        while queue:
            entry = heappop(queue)
            r, i = entry >> shift, entry & at
            if pair[i] != r:
                continue
            j = after[i]
            symbol[i] = new = merged[r]
            symbol[j] = pair[j] = -1
            after[i] = k = after[j]
            if k >= 0:
                before[k] = i
                pair[i] = r = rank(new << 32 | symbol[k], -1)
                if r >= 0:
                    heappush(queue, r << shift | i)
            else:
                pair[i] = -1
            if (h := before[i]) >= 0:
                pair[h] = r = rank(symbol[h] << 32 | new, -1)
                if r >= 0:
                    heappush(queue, r << shift | h)
        return [s for s in symbol if s >= 0]

    def _words(self, words: list[str]) -> list[Encoded]:
        ids = [self.merge(w.encode()) for w in words]
        size = np.fromiter(map(len, ids), np.int64, len(ids))
        return [(words, np.fromiter(chain.from_iterable(ids), "<u4", int(size.sum())), size)]

    def encode_all(self, texts: pa.Array | list[str]) -> list[np.ndarray]:
        """Each text's ids as little-endian unsigned 32-bit integers."""
        return self.codes.encode(texts)

    def encode(self, text: str) -> list[int]:
        return self.encode_all([text])[0].tolist()

    def decode_bytes(self, ids: np.ndarray) -> bytes:
        """The decoded text in UTF-8; byte sequences that are none become U+FFFD."""
        joined = b"".join(map(self.strings.__getitem__, ids.tolist()))
        try:
            joined.decode()
            return joined
        except UnicodeDecodeError:
            return joined.decode(errors="replace").encode()

    def decode(self, ids: np.ndarray | list[int]) -> str:
        return b"".join(map(self.strings.__getitem__, np.asarray(ids).tolist())).decode(errors="replace")


def byte_pairs(path: str) -> BytePairs:
    """One for each worker process."""
    return held(BytePairs, path)


def texts_of(column: pa.Array) -> list[str]:
    """UTF-8 bytes as texts; what is no UTF-8 becomes U+FFFD."""
    return [b.decode(errors="replace") for b in column.to_pylist()]


def text_column(column: pa.Array) -> pa.Array:
    """UTF-8 bytes as an Arrow column of texts; what is no UTF-8 becomes U+FFFD."""
    try:
        return column.cast(pa.large_string())
    except pa.ArrowInvalid:
        return pa.array(texts_of(column), pa.large_string())


def encode(docs: DataFrame, text_col: str = "text", ids_col: str = "token_ids", path: str | None = None, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """keep columns of docs and ids_col array<int> of every row, in one pass without a shuffle.

    A null text is an empty one and has no ids. Texts of any length are encoded whole. Repeated rows give repeated results.
    """
    path = path or vocabulary_path()
    kinds = [(c, docs.schema[c].dataType.simpleString()) for c in keep]

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        codes = byte_pairs(path).encode_all(text_column(batch.column(len(kinds))))
        flat = np.concatenate([np.zeros(0, "<u4"), *codes]).view("<i4")
        ends = np.concatenate([[0], np.cumsum(list(map(len, codes)))]).astype("<i4")
        ids = pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))
        return pa.RecordBatch.from_arrays([*batch.columns[:-1], ids], [*keep, ids_col])

    schema = ", ".join(f"`{c}` {k}" for c, k in [*kinds, (ids_col, "array<int>")])
    return map_batches(docs.select(*keep, utf8(text_col).alias("__text")), run, schema)


def decode(coded: DataFrame, ids_col: str = "token_ids", text_col: str = "text", path: str | None = None, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """keep columns of coded and text_col, the text of ids_col, for every row, repeated ones too; null ids are none and give an empty text."""
    path = path or vocabulary_path()
    kinds = [(c, coded.schema[c].dataType.simpleString()) for c in keep]

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        pairs = byte_pairs(path)
        texts = [pairs.decode(ids) for ids in batch.column(len(kinds)).to_pylist()]
        return pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(texts, pa.string())], [*keep, text_col])

    schema = ", ".join(f"`{c}` {k}" for c, k in [*kinds, (text_col, "string")])
    return map_batches(coded.select(*keep, F.coalesce(F.col(ids_col), F.array().cast("array<int>")).alias("__ids")), run, schema)


def op2_bpe(spark, sf_dir: str) -> DataFrame:
    """Digests of the ids and of the text decoded from them, for every document."""
    from hashlib import sha256

    path = vocabulary_path()

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        pairs = byte_pairs(path)
        codes = pairs.encode_all(text_column(batch.column(1)))
        columns = [
            batch.column(0),
            pa.array(map(len, codes), pa.int64()),
            pa.array([sha256(c).hexdigest() for c in codes], pa.string()),
            pa.array([sha256(pairs.decode_bytes(c)).hexdigest() for c in codes], pa.string()),
        ]
        return pa.RecordBatch.from_arrays(columns, ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    docs = table(spark, sf_dir, "documents").select("doc_id", utf8("text").alias("text"))
    return map_batches(docs, run, "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string")
