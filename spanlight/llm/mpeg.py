"""MPEG audio columns: frames, tags, variable-bitrate tables, checksums, exact durations and seek offsets.

read() walks the frames of any MPEG-1, 2 or 2.5 stream: it skips tags, resynchronises at the next header that
another one follows, takes runs of equal frames at once, reads the Xing, Info or VBRI table and verifies the
CRC-16 of layers I and III (layer II checksums are counted as unchecked; free format is not read).

store() keeps bytes losslessly: each 192 bytes are the ancillary data of one silent layer III frame
(mono, 32 kHz, 48 kbit/s: 4 bytes of header, 2 of checksum, 17 of zero side information, 193 of main data).
"""

from __future__ import annotations

import struct
from dataclasses import dataclass, field
from fractions import Fraction
from hashlib import sha256
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_batches, table, utf8

# kbit/s by bitrate index 1 to 14, Hz by rate index, samples and slot bytes of a frame.
BITRATES = {
    (1, 1): (32, 64, 96, 128, 160, 192, 224, 256, 288, 320, 352, 384, 416, 448),
    (1, 2): (32, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320, 384),
    (1, 3): (32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320),
    (2, 1): (32, 48, 56, 64, 80, 96, 112, 128, 144, 160, 176, 192, 224, 256),
    (2, 2): (8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
    (2, 3): (8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
}
RATES = {"1": (44100, 48000, 32000), "2": (22050, 24000, 16000), "2.5": (11025, 12000, 8000)}
SAMPLES = {(1, 1): 384, (1, 2): 1152, (1, 3): 1152, (2, 1): 384, (2, 2): 1152, (2, 3): 576}

BLOCK = 192
_HEADER = bytes([0xFF, 0xFA, 0x38, 0xC4])
_FRAME = 216
_SIDE = 17


def _crc_table() -> np.ndarray:
    table = np.arange(256, dtype=np.uint32) << 8
    for _ in range(8):
        table = np.where(table & 0x8000, (table << 1) ^ 0x8005, table << 1) & 0xFFFF
    return table


_CRC = _crc_table()


def crc16(rows: np.ndarray) -> np.ndarray:
    """CRC-16 (polynomial 0x8005, start 0xFFFF) of each row of bytes."""
    out = np.full(len(rows), 0xFFFF, dtype=np.uint32)
    for column in rows.T:
        out = ((out << 8) & 0xFFFF) ^ _CRC[(out >> 8) ^ column]
    return out


@dataclass(frozen=True)
class Header:
    version: str
    layer: int
    protected: bool
    kbps: int
    rate: int
    padding: int
    mode: int
    mode_extension: int

    @property
    def generation(self) -> int:
        return 1 if self.version == "1" else 2

    @property
    def channels(self) -> int:
        return 1 if self.mode == 3 else 2

    @property
    def samples(self) -> int:
        return SAMPLES[self.generation, self.layer]

    @property
    def size(self) -> int:
        if self.layer == 1:
            return (12_000 * self.kbps // self.rate + self.padding) * 4
        return self.samples // 8 * 1000 * self.kbps // self.rate + self.padding

    @property
    def side(self) -> int:
        """Bytes of layer III side information."""
        return (17, 32)[self.channels - 1] if self.generation == 1 else (9, 17)[self.channels - 1]

    @property
    def covered(self) -> int | None:
        """Bytes after the checksum that it covers; None where that depends on tables not held here."""
        if self.layer == 3:
            return self.side
        if self.layer == 1:
            bound = 4 * (self.mode_extension + 1) if self.mode == 1 else 32
            return (self.channels * bound + (32 - bound)) * 4 // 8
        return None


def header(data: bytes, at: int) -> Header | None:
    if at + 4 > len(data) or data[at] != 0xFF or data[at + 1] < 0xE0:
        return None
    b, c, d = data[at + 1 : at + 4]
    version = {0: "2.5", 2: "2", 3: "1"}.get(b >> 3 & 3)
    layer = 4 - (b >> 1 & 3)
    bits, rate = c >> 4, c >> 2 & 3
    if version is None or layer == 4 or bits in (0, 15) or rate == 3 or d & 3 == 2:
        return None
    kbps = BITRATES[1 if version == "1" else 2, layer][bits - 1]
    return Header(version, layer, not b & 1, kbps, RATES[version][rate], c >> 1 & 1, d >> 6, d >> 4 & 3)


@dataclass
class Track:
    """What read() found. offsets: byte offset of every audio frame; the table's own frame is none."""

    first: Header | None = None
    offsets: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    samples: int = 0
    kbps: set = field(default_factory=set)
    tags: dict = field(default_factory=dict)
    vbr: dict = field(default_factory=dict)
    crc_good: int = 0
    crc_bad: int = 0
    crc_unchecked: int = 0
    junk: int = 0

    @property
    def duration(self) -> Fraction:
        """Exact seconds."""
        return Fraction(self.samples, self.first.rate) if self.first else Fraction(0)

    def seek(self, seconds) -> int | None:
        """Byte offset of the frame that plays at a time; None before the start or past the end."""
        k = int(Fraction(seconds) * self.first.rate // self.first.samples) if self.first else -1
        return int(self.offsets[k]) if 0 <= k < len(self.offsets) else None


def _syncsafe(b: bytes) -> int:
    return b[0] << 21 | b[1] << 14 | b[2] << 7 | b[3]


def _text(b: bytes) -> str:
    code = {0: "latin-1", 1: "utf-16", 2: "utf-16-be", 3: "utf-8"}.get(b[0] if b else 0, "latin-1")
    return b[1:].decode(code, "replace").rstrip("\0")


def _id3v2(data: bytes, at: int, tags: dict) -> int:
    """Reads one tag at a place; returns the place after it, or the same."""
    if data[at : at + 3] != b"ID3" or len(data) < at + 10:
        return at
    major, flags, size = data[at + 3], data[at + 5], _syncsafe(data[at + 6 : at + 10])
    end = min(len(data), at + 10 + size)
    p = at + 10
    if flags & 0x40 and major >= 3 and p + 4 <= end:
        p += _syncsafe(data[p : p + 4]) if major == 4 else 4 + int.from_bytes(data[p : p + 4], "big")
    letters, head = (3, 6) if major == 2 else (4, 10)
    while major >= 2 and p + head <= end and data[p]:
        name, raw = data[p : p + letters].decode("latin-1"), data[p + letters : p + 2 * letters]
        n = _syncsafe(raw) if major == 4 else int.from_bytes(raw, "big")
        body = data[p + head : min(end, p + head + n)]
        if name[0] == "T" and not name.startswith("TXX"):
            tags[name] = _text(body)
        p += head + n
    return min(len(data), at + 10 + size + (10 if flags & 0x10 else 0))


def _vbr(data: bytes, at: int, h: Header, n: int) -> dict:
    """The table in a frame, empty if it has none."""
    p = at + 4 + (2 if h.protected else 0) + h.side
    if h.layer == 3 and data[p : p + 4] in (b"Xing", b"Info") and p + 8 <= at + n:
        out: dict = {"kind": data[p : p + 4].decode()}
        flags, p = int.from_bytes(data[p + 4 : p + 8], "big"), p + 8
        for bit, name in ((1, "frames"), (2, "bytes"), (4, "toc"), (8, "quality")):
            if flags & bit:
                k = 100 if name == "toc" else 4
                out[name] = list(data[p : p + k]) if name == "toc" else int.from_bytes(data[p : p + k], "big")
                p += k
        if p + 24 <= at + n and data[p : p + 4] in (b"LAME", b"Lavc", b"Lavf"):
            out["encoder"] = data[p : p + 9].decode("latin-1").rstrip("\0 ")
            out["delay"], out["padding"] = data[p + 21] << 4 | data[p + 22] >> 4, (data[p + 22] & 15) << 8 | data[p + 23]
        return out
    p = at + 36
    if data[p : p + 4] == b"VBRI" and p + 26 <= at + n:
        _, delay, quality, size, frames, entries, scale, width, per = struct.unpack(">HHHIIHHHH", data[p + 4 : p + 26])
        raw = data[p + 26 : p + 26 + entries * width]
        sizes = [int.from_bytes(raw[k : k + width], "big") * scale for k in range(0, len(raw), width)] if width else []
        return {"kind": "VBRI", "frames": frames, "bytes": size, "quality": quality, "delay": delay, "per_entry": per, "sizes": sizes}
    return {}


def read(data: bytes | None) -> Track:
    """Everything about a stream. Null, empty or other bytes give no frames; bytes that belong to none are junk."""
    track, data = Track(), data or b""
    at = 0
    while (then := _id3v2(data, at, track.tags)) > at:
        at = then
    end = len(data)
    if end - at >= 128 and data[end - 128 : end - 125] == b"TAG" and not _straddled(data, at, end - 128):
        end -= 128
        for name, a, b in (("TIT2", 3, 33), ("TPE1", 33, 63), ("TALB", 63, 93), ("TYER", 93, 97)):
            if value := data[end + a : end + b].split(b"\0")[0].decode("latin-1").strip():
                track.tags.setdefault(name, value)
    _walk(data, at, end, track)
    return track


def _straddled(data: bytes, at: int, tag: int) -> bool:
    """Whether the last frame begins before a place and ends with the stream, so that what is there is its content."""
    return _walk(data, at, len(data), Track()) < tag


def _walk(data: bytes, at: int, end: int, track: Track) -> int:
    """Adds the frames between two places to track; returns where the frame begins that ends at the end, or the end."""
    last = end
    view = np.frombuffer(data, np.uint8, count=end)
    offsets: list[np.ndarray] = []
    synced = False
    while at < end:
        h = header(data, at) if data[at] == 0xFF else None
        n = h.size if h else 0
        if h and at + n <= end and (synced or at + n == end or _follows(data, at + n, end, h)) and (not track.first or _alike(h, track.first)):
            synced = True
            if not track.first:
                track.first = h
                if table := _vbr(data, at, h, n):
                    track.vbr = table
                    _check(view, np.array([at]), h, track)
                    at += n
                    last = at - n if at == end else end
                    continue
            run = at + n * np.arange(_equal_frames(view[at:end], n))
            offsets.append(run)
            track.samples += h.samples * len(run)
            track.kbps.add(h.kbps)
            _check(view, run, h, track)
            at += n * len(run)
            last = at - n if at == end else end
        else:
            synced = False
            then = data.find(b"\xff", at + 1, end)
            then = end if then < 0 else then
            track.junk += then - at
            at = then
    if offsets:
        track.offsets = np.concatenate(offsets)
    return last


def _equal_frames(view: np.ndarray, n: int) -> int:
    """How many frames of n bytes the stream begins with that have the first one's header; looks at no more than twice as many."""
    count, whole, some = 1, len(view) // n, 4
    while count < whole:
        heads = view[count * n : min(whole, count + some) * n].reshape(-1, n)[:, :4]
        other = np.flatnonzero((heads != view[:4]).any(axis=1))
        if len(other):
            return count + int(other[0])
        count, some = count + len(heads), some * 2
    return count


def _alike(a: Header, b: Header) -> bool:
    return (a.version, a.layer, a.rate) == (b.version, b.layer, b.rate)


def _follows(data: bytes, at: int, end: int, h: Header) -> bool:
    then = header(data, at) if at + 4 <= end else None
    return then is not None and _alike(then, h)


def _check(view: np.ndarray, run: np.ndarray, h: Header, track: Track) -> None:
    if not h.protected:
        return
    if h.covered is None or 6 + h.covered > h.size:
        track.crc_unchecked += len(run)
        return
    at = run[:, None] + np.r_[2, 3, 6 : 6 + h.covered][None, :]
    stored = view[run + 4].astype(np.uint32) << 8 | view[run + 5]
    good = int((crc16(view[at]) == stored).sum())
    track.crc_good += good
    track.crc_bad += len(run) - good


_CHECKED = _HEADER + int(crc16(np.frombuffer(_HEADER[2:] + bytes(_SIDE), np.uint8)[None, :])[0]).to_bytes(2, "big") + bytes(_SIDE)


def store(payload: bytes) -> bytes:
    """A stream that holds payload, a positive multiple of 192 bytes: a tag, an Info table, a frame for each 192 bytes."""
    n, rest = divmod(len(payload), BLOCK)
    if rest or not n:
        raise ValueError(f"the payload must be a positive multiple of {BLOCK} bytes")
    name = b"TSSE" + struct.pack(">IH", 11, 0) + b"\0ancillary\0"
    tag = b"ID3\x03\0\0" + bytes([0, 0, 0, len(name)]) + name
    toc = bytes((256 * k // 100 for k in range(100)))
    info = (_CHECKED + b"Info" + struct.pack(">III", 7, n, (n + 1) * _FRAME) + toc).ljust(_FRAME, b"\0")
    frames = np.zeros((n, _FRAME), np.uint8)
    frames[:, : len(_CHECKED)] = np.frombuffer(_CHECKED, np.uint8)
    frames[:, len(_CHECKED) : len(_CHECKED) + BLOCK] = np.frombuffer(payload, np.uint8).reshape(n, BLOCK)
    return b"".join((tag, info, frames.tobytes()))


def payload(data: bytes, track: Track) -> bytes:
    """The bytes that store() kept, from the frames that read() found."""
    view = np.frombuffer(data, np.uint8)
    skip, at = len(_CHECKED), track.offsets
    if len(at) and at[-1] - at[0] == _FRAME * (len(at) - 1):
        return view[at[0] : at[0] + _FRAME * len(at)].reshape(-1, _FRAME)[:, skip : skip + BLOCK].tobytes()
    return view[at[:, None] + np.arange(skip, skip + BLOCK)].tobytes()


def padded(data: bytes, block: int = BLOCK) -> bytes:
    """data and spaces up to a positive multiple of block."""
    return data.ljust(max(1, -(-len(data) // block)) * block)


def store_media(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_bytes, media binary) of every row, repeated ones too; a null text is an empty one. No shuffle."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = batch.column(1).to_pylist()
        columns = [batch.column(0), pa.array(map(len, texts), pa.int64()), pa.array([store(padded(t)) for t in texts], pa.binary())]
        return pa.RecordBatch.from_arrays(columns, ["id", "n_bytes", "media"])

    return map_batches(docs.select(F.col(id_col).alias("id"), utf8(text_col).alias("text")), run, f"id {kind}, n_bytes bigint, media binary")


PROBE = (
    "version string, layer int, sample_rate int, channels int, n_frames bigint, n_samples bigint, duration string, duration_s double, min_kbps int, max_kbps int, "
    "vbr_kind string, vbr_frames bigint, crc_good bigint, crc_bad bigint, crc_unchecked bigint, junk_bytes bigint, tags map<string,string>, frame_offsets array<bigint>"
)


def _facts(data: bytes | None) -> dict:
    t = read(data)
    h = t.first
    return {
        "version": h and h.version, "layer": h and h.layer, "sample_rate": h and h.rate, "channels": h and h.channels,
        "n_frames": len(t.offsets), "n_samples": t.samples, "duration": str(t.duration), "duration_s": float(t.duration),
        "min_kbps": min(t.kbps, default=None), "max_kbps": max(t.kbps, default=None),
        "vbr_kind": t.vbr.get("kind"), "vbr_frames": t.vbr.get("frames"),
        "crc_good": t.crc_good, "crc_bad": t.crc_bad, "crc_unchecked": t.crc_unchecked, "junk_bytes": t.junk,
        "tags": list(t.tags.items()), "frame_offsets": t.offsets.tolist(),
    }


def probe(df: DataFrame, media_col: str = "media", keep: tuple[str, ...] = ("id",)) -> DataFrame:
    """keep columns of df and PROBE's of every row's stream; duration is exact, as a fraction of seconds.

    Null or foreign bytes have 0 frames and null properties. Each row stands for itself, repeated ones too.
    """
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    kinds = "".join(f"`{c}` {df.schema[c].dataType.simpleString()}, " for c in keep)
    arrow = to_arrow_schema(_parse_datatype_string(PROBE))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        facts = [_facts(m) for m in batch.column(len(keep)).to_pylist()]
        columns = [pa.array([f[x.name] for f in facts], x.type) for x in arrow]
        return pa.RecordBatch.from_arrays([*batch.columns[:-1], *columns], [*keep, *arrow.names])

    return map_batches(df.select(*keep, F.col(media_col).alias("__media")), run, kinds + PROBE)


def _feature(t: Track) -> str:
    ms = t.duration * 1000
    return (
        f"mpeg-{t.first.version} layer {t.first.layer}; {t.first.rate} Hz; {t.first.channels} ch; {min(t.kbps)} kbps; frames {len(t.offsets)}"
        f"; table {t.vbr.get('kind')} {t.vbr.get('frames')}; ms {ms.numerator}/{ms.denominator}; crc {t.crc_good} good {t.crc_bad} bad"
        f"; junk {t.junk}; seek {crc32(t.offsets.astype('<i8').tobytes()):08x}"
    )


def op7_mpeg(spark, sf_dir: str) -> DataFrame:
    """Stores every text, reads the stored bytes back, and digests what came back."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = []
        for media in batch.column(2).to_pylist():
            track = read(media)
            back = payload(media, track)
            rows.append((len(back), sha256(back).hexdigest(), crc32(back[-16:]), len(media), sha256(media).hexdigest(), _feature(track)))
        kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
        columns = [pa.array(c, k) for c, k in zip(zip(*rows), kinds)] if rows else [pa.array([], k) for k in kinds]
        names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
        return pa.RecordBatch.from_arrays([*batch.columns[:2], *columns], names)

    schema = "doc_id bigint, n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string"
    return map_batches(store_media(table(spark, sf_dir, "documents")), run, schema)
