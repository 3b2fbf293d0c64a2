import hashlib
import zlib
from fractions import Fraction
from time import process_time

import numpy as np

from spanlight.llm import mpeg


def frame(second, third, fourth, crc_ok=True):
    head = bytes([0xFF, second, third, fourth])
    h = mpeg.header(head, 0)
    out = bytearray(h.size)
    out[:4] = head
    if h.protected and h.covered is not None:
        crc = int(mpeg.crc16(np.frombuffer(bytes(out[2:4]) + bytes(out[6 : 6 + h.covered]), np.uint8)[None, :])[0])
        out[4:6] = (crc ^ (0 if crc_ok else 1)).to_bytes(2, "big")
    return bytes(out)


def test_crc_against_bitwise():
    data = bytes(range(7, 40))
    reg = 0xFFFF
    for byte in data:
        for bit in range(7, -1, -1):
            top = (reg >> 15 & 1) ^ (byte >> bit & 1)
            reg = (reg << 1 & 0xFFFF) ^ (0x8005 if top else 0)
    assert int(mpeg.crc16(np.frombuffer(data, np.uint8)[None, :])[0]) == reg


def test_variable_bitrate_junk_and_tags():
    cbr = [frame(0xFA, 0x90, 0x00) for _ in range(3)]
    more = [frame(0xFA, 0xB2, 0x00), frame(0xFA, 0x90, 0x00, crc_ok=False)]
    tag = b"ID3\x04\0\0" + bytes([0, 0, 0, 15]) + b"TIT2" + bytes([0, 0, 0, 5, 0, 0]) + b"\x03Name"
    old = b"TAG" + b"Other".ljust(30, b"\0") + b"Band".ljust(30, b"\0") + bytes(65)
    junk = b"xx\xff\xfbzz"
    data = tag + b"".join(cbr) + junk + b"".join(more) + old
    t = mpeg.read(data)
    assert t.tags == {"TIT2": "Name", "TPE1": "Band"}
    sizes = [len(f) for f in cbr]
    start = len(tag)
    want = [start, start + sizes[0], start + 2 * sizes[0], start + sum(sizes) + len(junk), start + sum(sizes) + len(junk) + len(more[0])]
    assert t.offsets.tolist() == want
    assert (t.crc_good, t.crc_bad, t.junk) == (4, 1, len(junk))
    assert t.duration == Fraction(5 * 1152, 44100)
    assert t.seek(Fraction(1152 * 3, 44100)) == want[3] and t.seek(10) is None
    assert t.kbps == {128, 192}


def test_other_layers_and_generations():
    for second in (0xFF, 0xFD, 0xFB, 0xF7, 0xF5, 0xF3, 0xE3):
        one = frame(second, 0x50, 0xC0)
        t = mpeg.read(one * 4)
        assert len(t.offsets) == 4 and t.samples == 4 * t.first.samples
    assert mpeg.read(frame(0xFE, 0x50, 0x40) * 3).crc_good == 3


def test_nothing_to_read():
    for data in (None, b"", b"\xff", b"\xff" * 500, b"plain text" * 30, b"ID3", b"TAG"):
        t = mpeg.read(data)
        assert len(t.offsets) == 0 and t.duration == 0 and t.seek(0) is None


def test_round_trip_and_query(spark, tmp_path):
    texts = ["", None, "a" * 192, "ÿéß😀" * 400, " " * 10, "x" * 100_000]
    rows = [(k, t, 1) for k, t in enumerate(texts)] + [(None, "a" * 192, 2), (3, texts[3], 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, media int")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    for r in mpeg.op7_mpeg(spark, str(tmp_path)).collect():
        raw = (("a" * 192 if r.doc_id is None else texts[r.doc_id]) or "").encode()
        full = raw + b" " * (-len(raw) % 192 or (0 if raw else 192))
        assert r.n_bytes == len(raw) and r.payload_bytes == len(full)
        assert r.payload_sha256 == hashlib.sha256(full).hexdigest()
        assert r.tail_crc32 == zlib.crc32(full[-16:])
        assert f"frames {len(full) // 192};" in r.feature and " 0 bad" in r.feature
    facts = mpeg.probe(mpeg.store_media(docs)).collect()
    assert len(facts) == len(rows)
    assert all(f.n_frames == f.vbr_frames == len(f.frame_offsets) and f.crc_bad == 0 and f.tags == {"TSSE": "ancillary"} for f in facts)
    none = mpeg.probe(spark.createDataFrame([(1, None), (2, bytearray(b"zz"))], "id long, media binary")).collect()
    assert [(r.n_frames, r.version, r.duration_s) for r in none] == [(0, None, 0.0)] * 2
    assert mpeg.store_media(docs.limit(0)).count() == 0


def test_texts_that_look_like_a_closing_tag(spark, tmp_path):
    look = ("a" * 64 + "TAG").ljust(192, "b")
    texts = [("x" * 192 * blocks) + "".join(block) for blocks in (0, 1, 5) for block in ((look,), (look[:100],))] + [("q" * k + "TAG").ljust(192, "b") for k in range(56, 76)]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    rows = mpeg.op7_mpeg(spark, str(tmp_path)).collect()
    assert len(rows) == len(texts)
    for r in rows:
        full = mpeg.padded(texts[r.doc_id].encode())
        assert (r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(full), hashlib.sha256(full).hexdigest(), zlib.crc32(full[-16:]))
        assert f"frames {len(full) // 192};" in r.feature and "junk 0" in r.feature
    media = mpeg.store(mpeg.padded(look.encode()))
    closing = b"TAG" + b"Other".ljust(125, b"\0")
    assert mpeg.read(media + closing).tags == {"TSSE": "ancillary", "TIT2": "Other"}
    assert mpeg.payload(media, mpeg.read(media + closing)) == look.encode()


def test_long_variable_bitrate_takes_linear_time():
    frames = [frame(0xFB, 0x90 | 2 * (k % 2), 0x00) for k in range(2)]
    data = b"".join(frames) * 50_000
    began = process_time()
    t = mpeg.read(data)
    assert process_time() - began < 30
    assert len(t.offsets) == 100_000 and t.junk == 0 and t.duration == Fraction(100_000 * 1152, 44100)


def test_old_tags():
    body = b"TT2" + (5).to_bytes(3, "big") + b"\0Name"
    t = mpeg.read(b"ID3\x02\0\0" + bytes([0, 0, 0, len(body)]) + body + frame(0xFB, 0x90, 0x00) * 2)
    assert t.tags == {"TT2": "Name"} and len(t.offsets) == 2
