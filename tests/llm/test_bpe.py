import hashlib
import random
import struct

from tokenizers import Tokenizer

from spanlight.llm import bpe, tokens

ODD = [*tokens.WHITE, "  ", "\n ", "\x1c", "a", "b", "the", " hello", "don't", "'s", "été", "²", "½", "五", "12", "<|endoftext|>", "<|end", "!!", "...", "😀", "é", "_", "\x00", "ﬁ", "़"]


def texts(n=1500):
    rng = random.Random(7)
    return ["".join(rng.choice(ODD) for _ in range(rng.randint(0, 14))) for _ in range(n)] + ["", "x" * 70_000, "ab " * 50_000, "  " * 4000]


def test_equals_the_library():
    path = bpe.vocabulary_path()
    library, own = Tokenizer.from_file(path), bpe.byte_pairs(path)
    for t in texts():
        ids = library.encode(t, add_special_tokens=False).ids
        assert own.encode(t) == ids
        assert own.decode(ids) == library.decode(ids, skip_special_tokens=False)
    for ids in ([220, 108], [50256, 50256], [127, 128, 200], []):
        assert own.decode(ids) == library.decode(ids, skip_special_tokens=False)


def test_pieces_join_to_the_text():
    assert all("".join(tokens.pieces(t)) == t for t in texts())


def test_operator_and_query(spark, tmp_path):
    rows = [(1, "Hello world", 5), (2, None, 6), (None, "a  b\n c", 7), (1, "Hello world", 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, token_ids int")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    coded = bpe.encode(docs)
    back = {(r.doc_id, r.text) for r in bpe.decode(coded).collect()}
    assert back == {(1, "Hello world"), (2, ""), (None, "a  b\n c")}
    library = Tokenizer.from_file(bpe.vocabulary_path())
    for r in bpe.op2_bpe(spark, str(tmp_path)).collect():
        text = {1: "Hello world", 2: "", None: "a  b\n c"}[r.doc_id]
        ids = library.encode(text, add_special_tokens=False).ids
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()
    assert bpe.encode(docs.limit(0)).count() == 0


def test_memory_is_bounded_in_bytes(monkeypatch):
    """Halves that turn over within a text, and pieces too long to keep, change no id."""
    path = bpe.vocabulary_path()
    library, own = Tokenizer.from_file(path), bpe.BytePairs(path)
    monkeypatch.setattr(tokens, "MEMORY", 2_000)
    monkeypatch.setattr(tokens, "_AT_ONCE", 16)
    batch = [t for t in texts(400) if len(t) < 60_000] + ["y" * 500 + " z" * 40]
    for k in range(0, len(batch), 50):
        some = batch[k : k + 50] * 2
        for t, ids in zip(some, own.encode_all(some), strict=True):
            assert ids.tolist() == library.encode(t, add_special_tokens=False).ids
        assert own.codes.new.held < 2_000 and max(map(len, own.codes.new.at), default=0) <= tokens.LONGEST
