"""Language identification by a byte convolutional network, written and trained in numpy.

A text's UTF-8 bytes (A-Z folded) are cut into windows of fixed length, the last one filled up with zeros. In each
window filters of several widths slide over byte embeddings; the largest response of each filter goes, rectified,
to a softmax over the languages. A text's probabilities are the mean of its windows', weighted by their bytes.

To predict, embedding and filter weights are multiplied out into tables of byte pairs and single bytes, so a response is
a sum of looked-up rows.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_crc32, map_batches, table, utf8

WINDOW = 128
WIDTHS = (2, 3, 4)
FILTERS, EMBEDDING = 8, 8
#: The bounds of the sample that the driver learns from: documents, by the hash of their ids, and windows of each.
SAMPLE, SAMPLE_WINDOWS = 3000, 4
UNKNOWN = "und"

_FOLD = bytes(b + 32 if 65 <= b <= 90 else 32 if 9 <= b <= 13 else b for b in range(256))
_LETTER = regex.compile(r"\p{L}")


@dataclass
class Network:
    languages: list[str]
    embedding: np.ndarray  # 256 x E
    filters: list[np.ndarray]  # of each width: width x E x filters
    biases: list[np.ndarray]
    dense: np.ndarray
    dense_bias: np.ndarray

    def tables(self) -> list[tuple[list[tuple[int, bool, np.ndarray]], np.ndarray]]:
        """Of each width: (offset, whether of a byte pair, table) and the bias."""
        out = []
        for w, b in zip(self.filters, self.biases):
            single = [self.embedding @ part for part in w]
            rows = []
            for k in range(0, len(w) - 1, 2):
                rows.append((k, True, (single[k][:, None, :] + single[k + 1][None, :, :]).reshape(65536, -1).astype(np.float32)))
            if len(w) % 2:
                rows.append((len(w) - 1, False, single[-1].astype(np.float32)))
            out.append((rows, b.astype(np.float32)))
        return out


def windows(data: bytes, size: int = WINDOW) -> np.ndarray:
    """Rows of size bytes, folded; an empty text has one row of zeros."""
    folded = data.translate(_FOLD)
    return np.frombuffer(folded.ljust(max(1, -(-len(data) // size)) * size, b"\0"), np.uint8).reshape(-1, size)


class Predictor:
    def __init__(self, net: Network):
        self.net, self.tables = net, net.tables()

    def probabilities(self, rows: np.ndarray) -> np.ndarray:
        """Softmax of each window."""
        return np.concatenate([self._some(rows[k : k + 256]) for k in range(0, len(rows), 256)]) if len(rows) else np.zeros((0, len(self.net.languages)))

    def _some(self, rows: np.ndarray) -> np.ndarray:
        pairs = rows[:, :-1].astype(np.int32) * 256 + rows[:, 1:]
        hidden = []
        for (parts, bias), width in zip(self.tables, WIDTHS):
            n = rows.shape[1] - width + 1
            total = None
            for offset, is_pair, lookup in parts:
                at = pairs[:, offset : offset + n] if is_pair else rows[:, offset : offset + n]
                got = lookup.take(at, axis=0)
                total = got if total is None else np.add(total, got, out=total)
            hidden.append(np.maximum(total.max(axis=1) + bias, 0))
        return _softmax(np.concatenate(hidden, 1) @ self.net.dense + self.net.dense_bias)

    def predict(self, texts: list[bytes]) -> list[tuple[str, float]]:
        """(language, its probability) of each text; texts without a letter are unknown, with 0."""
        if not self.net.languages:
            return [(UNKNOWN, 0.0)] * len(texts)
        cut = [windows(t) for t in texts]
        p = self.probabilities(np.concatenate(cut)) if cut else np.zeros((0, 1))
        out, at = [], 0
        for text, rows in zip(texts, cut):
            own = p[at : at + len(rows)]
            at += len(rows)
            if not _LETTER.search(text.decode(errors="replace")):
                out.append((UNKNOWN, 0.0))
                continue
            weight = np.full(len(rows), float(rows.shape[1]))
            weight[-1] = len(text) - (len(rows) - 1) * rows.shape[1]
            mean = weight @ own / weight.sum()
            k = int(mean.argmax())
            out.append((self.net.languages[k], float(min(1.0, mean[k]))))
        return out


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def train(rows: np.ndarray, y: np.ndarray, languages: list[str], epochs: int = 12, batch: int = 128, rate: float = 0.01, seed: int = 0) -> Network:
    """A network from windows and the indices of their languages; each language weighs the same."""
    rng = np.random.default_rng(seed)
    shapes = [(256, EMBEDDING), *((w, EMBEDDING, FILTERS) for w in WIDTHS), *((FILTERS,) for _ in WIDTHS), (FILTERS * len(WIDTHS), len(languages)), (len(languages),)]
    theta = [rng.normal(0, 0.3, s) if len(s) > 1 else np.zeros(s) for s in shapes]
    if not len(rows):
        return _network(theta, languages)
    weight = 1 / np.maximum(np.bincount(y, minlength=len(languages)), 1)
    weight = weight[y] / weight[y].mean()
    mean, square, step = [np.zeros_like(t) for t in theta], [np.zeros_like(t) for t in theta], 0
    for _ in range(epochs):
        order = rng.permutation(len(rows))
        for k in range(0, len(rows), batch):
            at = order[k : k + batch]
            gradient = _gradient(theta, rows[at], y[at], weight[at])
            step += 1
            for i, g in enumerate(gradient):
                mean[i] = 0.9 * mean[i] + 0.1 * g
                square[i] = 0.999 * square[i] + 0.001 * g * g
                theta[i] = theta[i] - rate * (mean[i] / (1 - 0.9**step)) / (np.sqrt(square[i] / (1 - 0.999**step)) + 1e-8)
    return _network(theta, languages)


def _network(theta: list[np.ndarray], languages: list[str]) -> Network:
    n = len(WIDTHS)
    return Network(languages, theta[0], theta[1 : 1 + n], theta[1 + n : 1 + 2 * n], theta[-2], theta[-1])


def _gradient(theta: list[np.ndarray], rows: np.ndarray, y: np.ndarray, weight: np.ndarray) -> list[np.ndarray]:
    n, widths = len(rows), len(WIDTHS)
    embedding, filters, biases, dense, dense_bias = theta[0], theta[1 : 1 + widths], theta[1 + widths : 1 + 2 * widths], theta[-2], theta[-1]
    x = embedding[rows]
    hidden, best = [], []
    for w, b in zip(filters, biases):
        m = rows.shape[1] - len(w) + 1
        response = sum(x[:, j : j + m] @ part for j, part in enumerate(w))
        top = response.argmax(axis=1)
        best.append(top)
        hidden.append(np.take_along_axis(response, top[:, None, :], 1)[:, 0] + b)
    h = np.maximum(np.concatenate(hidden, 1), 0)
    off = _softmax(h @ dense + dense_bias)
    off[np.arange(n), y] -= 1
    off *= weight[:, None] / n
    back = (off @ dense.T) * (h > 0)
    g_embedding, g_filters, g_biases = np.zeros_like(embedding), [], []
    for k, (w, top) in enumerate(zip(filters, best)):
        g = back[:, k * FILTERS : (k + 1) * FILTERS]
        g_w = np.zeros_like(w)
        for j in range(len(w)):
            at = rows[np.arange(n)[:, None], top + j]  # n x filters: the byte under offset j of each best place
            g_w[j] = np.einsum("nf,nfe->ef", g, embedding[at])
            np.add.at(g_embedding, at.ravel(), (g[:, :, None] * w[j].T[None]).reshape(-1, embedding.shape[1]))
        g_filters.append(g_w)
        g_biases.append(g.sum(0))
    return [g_embedding, *g_filters, *g_biases, h.T @ off, off.sum(0)]


def sample_windows(text: bytes, count: int = SAMPLE_WINDOWS) -> np.ndarray:
    """count windows of a text, evenly spread; all of them if it has no more."""
    rows = windows(text)
    return rows if len(rows) <= count else rows[np.linspace(0, len(rows) - 1, count).astype(int)]


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "lang", sample: int = SAMPLE, sample_windows_each: int = SAMPLE_WINDOWS) -> Network:
    """A network from at most sample labelled documents and sample_windows_each windows of each (null texts and labels are none)."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(label_col).alias("label")).filter("text is not null and label is not null")
    picked = rows.select("id", "label").orderBy(F.xxhash64("id"), "id", "label").limit(sample).distinct()
    found = rows.join(F.broadcast(picked), ["id", "label"]).select(utf8("text").alias("text"), "label", "id").orderBy("id").limit(2 * sample).toArrow()
    texts, labels = found.column("text").to_pylist(), found.column("label").to_pylist()
    languages = sorted(set(labels))
    cut = [(sample_windows(t, sample_windows_each), languages.index(x)) for t, x in zip(texts, labels) if _LETTER.search(t.decode(errors="replace"))]
    if not cut:
        return train(np.zeros((0, WINDOW), np.uint8), np.zeros(0, int), languages)
    return train(np.concatenate([w for w, _ in cut]), np.concatenate([np.full(len(w), k) for w, k in cut]), languages)


def identify(docs: DataFrame, net: Network, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, lang_pred, score) of every row, repeated ones too, in one pass without a shuffle.

    Null texts and texts without a letter are `und` with 0; of languages equally likely, the first by name is it.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    held: list[Predictor] = []

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        if not held:
            held.append(Predictor(net))
        found = held[0].predict(batch.column(1).to_pylist())
        columns = [batch.column(0), pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())]
        return pa.RecordBatch.from_arrays(columns, ["id", "lang_pred", "score"])

    return map_batches(docs.select(F.col(id_col).alias("id"), utf8(text_col).alias("text")), run, f"id {kind}, lang_pred string, score double")


def op5_language(spark, sf_dir: str) -> DataFrame:
    """The language of every document; the network learns from three documents in four."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    net = fit(docs.filter(id_crc32() % 4 != 2))
    held = F.coalesce(id_crc32("id") % 4 == 2, F.lit(False))
    return identify(docs, net).select(F.col("id").alias("doc_id"), held.alias("held_out"), "lang_pred", "score")
