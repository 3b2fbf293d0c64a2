import struct
import zlib

import numpy as np
from tokenizers import Tokenizer

from spanlight.llm import bpe, tokenfiles


def library_ids(text):
    return Tokenizer.from_file(bpe.vocabulary_path()).encode(text or "", add_special_tokens=False).ids + [2]


def test_round_trip(spark, tmp_path):
    texts = ["", None, "word " * 9000, "a  b\n c", "<|endoftext|> x", "é😀"]
    rows = [(k * 7 % 41, texts[k % 6], k) for k in range(41)] + [(None, "no id", 1), (5, "twice", 1), (5, "twice", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, start int").repartition(6)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(tokenfiles.op6_arrow_sequences(spark, str(tmp_path)).collect(), key=lambda r: r.start)
    order = sorted(((r[0], r[1]) for r in rows), key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    start = 0
    for r, (doc, text) in zip(got, order, strict=True):
        ids = library_ids(text)
        assert (r.doc_id, r.start, r.n_tokens) == (doc, start, len(ids))
        assert r.ids_crc32 == zlib.crc32(struct.pack(f"<{len(ids)}I", *ids))
        start += len(ids)


def test_sequences_are_views_of_equal_length(spark, tmp_path):
    docs = spark.createDataFrame([(k, f"number {k} " * 50) for k in range(40)], "doc_id long, text string").coalesce(1)
    uri = f"file://{tmp_path}/out"
    index = tokenfiles.write_shards(docs, uri, length=16)
    whole = [t for k in range(40) for t in library_ids(f"number {k} " * 50)]
    at = 0
    for shard in sorted({r.shard for r in index.collect()}):
        n = sum(r.n_tokens for r in index.filter(f"shard = {shard}").collect())
        s = tokenfiles.Sequences(uri, shard)
        count = -(-n // 16)
        joined = np.concatenate([s.sequence(k) for k in range(count)])
        masks = [m for k in range(count) for m in s.mask(k).to_pylist()]
        assert all(len(s.sequence(k)) == 16 and s.sequence(k).base is not None for k in range(count))
        assert masks == [True] * n + [False] * (count * 16 - n)
        assert joined[:n].tolist() == whole[at : at + n]
        at += n
    assert at == len(whole)


def test_empty(spark, tmp_path):
    docs = spark.createDataFrame([], "doc_id long, text string")
    uri = f"file://{tmp_path}/none"
    assert tokenfiles.read_documents(tokenfiles.write_shards(docs, uri), uri).count() == 0


def test_counts_are_those_of_the_ids():
    texts = ["", " ", "a  b", "one\n two\tthree", "ein Wort, ein anderes", "</s><s> x", "\0 y", "語 " * 40, "long" * 90, "one\n two\tthree"]
    codes = tokenfiles.library_codes(bpe.vocabulary_path())
    want = [len(library_ids(t)) - 1 for t in texts]
    assert codes.count(texts) == list(map(len, codes.encode(texts))) == want
    assert codes.count([]) == []


def test_pieces_of_the_table_are_those_of_the_library(monkeypatch):
    """Lengths about the table's bound, line ends, bytes 0, non-ASCII letters; halves that turn over within a text."""
    words = ["a", "a\0", "\0", "a\0\0", "x" * 13, "x" * 14, "x" * 15, "x" * 16, "é" * 7, "é" * 8, "foo,", "foo.\nBar", "\n", "\n\n", "don't", "'s", "12½", *(f"w{k}" for k in range(90))]
    rng = np.random.default_rng(4)
    texts = [" ".join(words[k] for k in rng.integers(0, len(words), n)) + end for n in (0, 1, 2, 9, 400) * 6 for end in ("", " ", "\n", "\n\n")]
    texts += ["\nfoo", "foo\nbar baz", "foo \nbar", "foo\n\nbar", " ", "\n"]
    want = [library_ids(t)[:-1] for t in texts]
    for slots in (16, 64, 1 << 12):
        monkeypatch.setattr("spanlight.llm.tokens.SLOTS", slots)
        codes = tokenfiles._library_codes(bpe.vocabulary_path())
        for _ in range(2):
            assert [x.tolist() for x in codes.encode(texts)] == want
            assert codes.count(texts) == list(map(len, want))
        assert len(codes.table.low) == slots and codes.table.n <= 0.75 * slots + 1


def test_known_pieces_reach_neither_the_library_nor_a_dictionary():
    texts = ["One text, some words of which are short. " * 3 + f"w{k}\nLine" for k in range(50)]
    codes = tokenfiles._library_codes(bpe.vocabulary_path())
    want = [x.tolist() for x in codes.encode(texts)]
    codes.numbers = codes.encode_words = codes.encode_spaced = None
    assert [x.tolist() for x in codes.encode(texts)] == want == [library_ids(t)[:-1] for t in texts]
