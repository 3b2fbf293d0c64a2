"""Toxic spans by a linear-chain conditional random field with two states.

Labels are of documents; tokens get theirs from them: a token of a toxic document is toxic if the beginning
of one of its words occurs in enough toxic sample documents and hardly in clean ones (near copies count
once). The field's features are the word and its first three, four and five letters, so unseen words of a family
are found too. It is trained in numpy by the likelihood's gradient over all lines of the clean sample
and those lines of the toxic one that hold a toxic token.

Forward-backward runs exactly over all tokens of a batch at once: a step is a 2x2 matrix, a document's first
token resets it, and the chain is cut into blocks whose products are joined. A document's score is its largest
marginal; the tokens at or above one half are its spans.
"""

from __future__ import annotations

import re
from array import array
from collections import Counter
from dataclasses import dataclass, field
from math import log
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import texts_of
from .common import id_crc32, map_batches, table, utf8

#: The bounds of the sample that the driver learns from: labelled documents of each kind, by the hash of their ids.
TOXIC_SAMPLE, CLEAN_SAMPLE = 1000, 2000
#: Of the toxic sample documents, how many share a toxic word's beginning; and how many clean ones to one toxic.
SHARE, CLEAN_RATIO = 0.015, 0.05
THRESHOLD = 0.7
#: Tokens that a worker remembers.
MEMORY = 200_000
#: Tokens, about, whose marginals training holds at once; lines are never split.
BLOCK = 100_000

_WORD = re.compile(r"[^\W\d_]+")


def features(word: str) -> tuple[str, ...]:
    return (f"w{word}", f"3{word[:3]}", f"4{word[:4]}", f"5{word[:5]}")


def token_features(token: str) -> set[str]:
    """The features of all words of a token, each once."""
    return {f for w in _WORD.findall(token) for f in features(w)}


@dataclass
class Field:
    """weights: of features towards state 1, against which state 0 has 0; log potentials of pairs and of the start."""

    weights: dict[str, float] = field(default_factory=dict)
    bias: float = -12.0
    pairs: np.ndarray = field(default_factory=lambda: np.zeros((2, 2)))
    start: float = 0.0

    def emission(self, token: str) -> float:
        """The bias and the weights of the token's features, as training sums them."""
        return self.bias + sum(self.weights.get(f, 0.0) for f in token_features(token))


class _Emissions(dict):
    def __init__(self, model: Field):
        self.model = model

    def __missing__(self, token: str) -> float:
        if len(self) > MEMORY:
            self.clear()
        out = self[token] = self.model.emission(token)
        return out


def marginals(emissions: np.ndarray, lengths: np.ndarray, pairs: np.ndarray, start: float) -> tuple[np.ndarray, np.ndarray]:
    """P(state 1) of every token, and of each neighbouring pair (n x 2 x 2, row t for tokens t - 1 and t; zero at a start).

    emissions: of all sequences, one after the other; lengths: theirs, all positive.
    """
    n = len(emissions)
    if not n:
        return np.zeros(0), np.zeros((0, 2, 2))
    e = np.exp(np.clip(emissions, -40, 40))
    a = np.exp(pairs)
    first = np.zeros(n, bool)
    ends = np.cumsum(lengths)
    first[np.concatenate([[0], ends[:-1]])] = True
    last = np.zeros(n, bool)
    last[ends - 1] = True
    # forward: r_t = (m00 r + m01) / (m10 r + m11), r the ratio of state 1 to state 0
    forward = np.empty((n, 4))
    forward[:, 0], forward[:, 1], forward[:, 2], forward[:, 3] = e * a[1, 1], e * a[0, 1], a[1, 0], a[0, 0]
    forward[first] = np.stack([0 * e[first], e[first] * np.exp(start), 0 * e[first], np.ones(first.sum())], 1)
    r = _scan(forward)
    # backward: b_(t-1) from b_t; a last token's is 1
    up = np.concatenate([e[1:], [1.0]])
    backward = np.empty((n, 4))
    backward[:, 0], backward[:, 1], backward[:, 2], backward[:, 3] = a[1, 1] * up, a[1, 0], a[0, 1] * up, a[0, 0]
    backward[last] = (0, 1, 0, 1)
    b = _scan(backward[::-1])[::-1]
    p = r * b / (1 + r * b)
    joint = np.zeros((n, 2, 2))
    if n > 1:
        before = np.concatenate([[0.0], r[:-1]])
        for i, x in ((0, np.ones(n)), (1, before)):
            for j, y in ((0, np.ones(n)), (1, e * b)):
                joint[:, i, j] = x * a[i, j] * y
        joint /= joint.sum((1, 2))[:, None, None]
    joint[first] = 0
    return p, joint


def _scan(steps: np.ndarray) -> np.ndarray:
    """The ratios after each step r -> (m0 r + m1) / (m2 r + m3), from the ratio 1."""
    n = len(steps)
    size = max(1, int(n**0.5))
    blocks = -(-n // size)
    padded = np.concatenate([steps, np.tile([1.0, 0, 0, 1], (blocks * size - n, 1))]).reshape(blocks, size, 4)
    cols = padded.transpose(1, 2, 0)
    p0, p1, p2, p3 = (np.ones(blocks), np.zeros(blocks), np.zeros(blocks), np.ones(blocks))
    for m0, m1, m2, m3 in cols:
        p0, p1, p2, p3 = m0 * p0 + m1 * p2, m0 * p1 + m1 * p3, m2 * p0 + m3 * p2, m2 * p1 + m3 * p3
        scale = 1 / (p0 + p1 + p2 + p3)
        p0, p1, p2, p3 = p0 * scale, p1 * scale, p2 * scale, p3 * scale
    r, into = 1.0, np.empty(blocks)
    for k, (m0, m1, m2, m3) in enumerate(zip(p0.tolist(), p1.tolist(), p2.tolist(), p3.tolist())):
        into[k] = r
        r = (m0 * r + m1) / (m2 * r + m3)
    out, r = np.empty((size, blocks)), into
    for k, (m0, m1, m2, m3) in enumerate(cols):
        r = (m0 * r + m1) / (m2 * r + m3)
        out[k] = r
    return out.T.reshape(-1)[:n]


def _once(texts: list[str]) -> list[str]:
    """One text of those that share the least hash of their 3-word shingles: near copies mostly do."""
    kept: dict[int, str] = {}
    for t in texts:
        words = t.split()
        key = min((crc32(" ".join(words[i : i + 3]).encode()) for i in range(max(1, len(words) - 2))), default=0)
        kept.setdefault(key, t)
    return list(kept.values())


def label_tokens(toxic: list[str], clean: list[str]) -> set[str]:
    """The beginnings (features) that mark tokens of toxic documents."""
    toxic, clean = _once(toxic), _once(clean)

    def counted(texts: list[str]) -> Counter:
        out: Counter = Counter()
        for t in texts:
            out.update({f for w in set(_WORD.findall(t.lower())) for f in features(w)[2:]})
        return out

    bad, good = counted(toxic), counted(clean)
    least = max(3, SHARE * len(toxic))
    scale = len(toxic) / max(1, len(clean))
    return {f for f, n in bad.items() if n >= least and good[f] * scale <= CLEAN_RATIO * n}


def train(toxic: list[str], clean: list[str], steps: int = 60, rate: float = 0.4, decay: float = 1e-4) -> Field:
    """The field of a sample of texts. Without toxic texts, nothing is toxic.

    Lines of toxic texts without a marked token tell nothing of where their text is toxic and are left out.
    """
    marks = label_tokens(toxic, clean)
    if not marks:
        return Field()
    lines: list[tuple[list[str], bool]] = [(x.split(), True) for t in toxic for x in t.lower().split("\n")]
    lines += [(x.split(), False) for t in clean for x in t.lower().split("\n")]
    index: dict[str, int] = {}
    words: dict[str, int] = {}
    gold, rows, lengths, seen = bytearray(), array("I"), [], []
    for tokens, is_toxic in lines:
        labels = [is_toxic and any(f in marks for w in _WORD.findall(x) for f in features(w)[2:]) for x in tokens]
        if not tokens or (is_toxic and not any(labels)):
            continue
        lengths.append(len(tokens))
        gold += bytes(labels)
        rows.extend(words.setdefault(x, len(words)) for x in tokens)
    del lines
    gold, names = np.frombuffer(gold, np.uint8).astype(float), list(words)
    for x, y in zip(rows, gold):
        if y:
            for w in _WORD.findall(names[x]):
                for f in features(w):
                    index.setdefault(f, len(index))
    held = [[at for f in token_features(x) if (at := index.get(f)) is not None] for x in names]
    token_of, feature_of = array("I"), array("I")
    for k, x in enumerate(rows):
        for at in held[x]:
            token_of.append(k)
            feature_of.append(at)
    seen = (np.array(token_of, int), np.array(feature_of, int))
    lengths = np.array(lengths)
    ends = np.cumsum(lengths)
    first = np.concatenate([[0], ends[:-1]])
    #: blocks of whole lines: (first line, line after the last, first token, token after the last)
    at = [0, *np.flatnonzero(np.diff(ends // BLOCK)) + 1, len(ends)]
    blocks = [(a, b, first[a], ends[b - 1]) for a, b in zip(at, at[1:])]
    size = len(index)
    theta = np.zeros(size + 6)  # weights, bias, pairs, start
    theta[size] = log((gold.sum() + 0.5) / (len(gold) - gold.sum() + 0.5))
    wanted = np.zeros((2, 2))
    y = gold.astype(int)
    inner = np.setdiff1d(np.arange(len(y)), first)
    np.add.at(wanted, (y[inner - 1], y[inner]), 1)
    mean, square = np.zeros_like(theta), np.zeros_like(theta)
    for step in range(1, steps + 1):
        emission = np.bincount(seen[0], theta[seen[1]], len(gold)) + theta[size]
        p, joint = np.empty(len(gold)), np.zeros((2, 2))
        for a, b, i, j in blocks:
            p[i:j], some = marginals(emission[i:j], lengths[a:b], theta[size + 1 : size + 5].reshape(2, 2), theta[size + 5])
            joint += some.sum(0)
        off = gold - p
        gradient = np.concatenate([np.bincount(seen[1], off[seen[0]], size), [off.sum()], (wanted - joint).ravel(), [off[first].sum()]])
        gradient = gradient / len(lengths) - decay * theta * (np.arange(len(theta)) < size)
        mean = 0.9 * mean + 0.1 * gradient
        square = 0.99 * square + 0.01 * gradient**2
        theta += rate * (mean / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.99**step)) + 1e-8)
    weights = {f: float(theta[k]) for f, k in index.items()}
    return Field(weights, float(theta[size]), theta[size + 1 : size + 5].reshape(2, 2).copy(), float(theta[size + 5]))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Field:
    """A field from labelled documents (label 1 or 0; null is none). Ids that repeat count as toxic if any label is.

    At most TOXIC_SAMPLE and CLEAN_SAMPLE documents reach the driver.
    """
    known = labels.select(F.col(id_col).alias("id"), F.col(label_col).alias("y")).filter("id is not null and y is not null")
    known = known.groupBy("id").agg(F.max("y").alias("y"))
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).filter("text is not null")
    out = []
    for y, bound in ((1, TOXIC_SAMPLE), (0, CLEAN_SAMPLE)):
        ids = known.filter(F.col("y") == y).orderBy(F.xxhash64("id"), "id").limit(bound)
        found = dict(texts.join(F.broadcast(ids.select("id")), "id").select("id", "text").toArrow().to_pandas().itertuples(index=False))
        out.append([found[k] for k in sorted(found)])
    return train(*out)


def score_texts(texts: list[str], emissions: _Emissions) -> list[tuple[float, list[dict]]]:
    """(score, spans) of each text; a span has its first and last character's offset (end excluded) and its marginal."""
    tokens = [t.lower().split() for t in texts]
    lengths = np.array([len(x) for x in tokens])
    flat = np.fromiter((emissions[x] for doc in tokens for x in doc), float, count=int(lengths.sum()))
    model = emissions.model
    p, _ = marginals(flat, lengths[lengths > 0], model.pairs, model.start) if len(flat) else (flat, None)
    out, at = [], 0
    for text, n in zip(texts, lengths.tolist()):
        own = p[at : at + n]
        at += n
        top = float(own.max()) if n else 0.0
        spans = []
        if top >= 0.5:
            places = [m.span() for m in re.finditer(r"\S+", text)]
            spans = [{"start": places[k][0], "end": places[k][1], "p": float(own[k])} for k in np.flatnonzero(own >= 0.5)]
        out.append((top, spans))
    return out


def tag(docs: DataFrame, model: Field, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score, spans) of every row, in one pass without a shuffle; a span has its characters' offsets and its marginal.

    Null and empty texts score 0 and have no spans. Each row stands for itself: repeated rows give repeated results.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    span = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("p", pa.float64())]))
    held: list[_Emissions] = []

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        if not held:
            held.append(_Emissions(model))
        found = score_texts(texts_of(batch.column(1)), held[0])
        columns = [batch.column(0), pa.array([f[0] for f in found], pa.float64()), pa.array([f[1] for f in found], span)]
        return pa.RecordBatch.from_arrays(columns, ["id", "score", "spans"])

    rows = docs.select(F.col(id_col).alias("id"), utf8(text_col).alias("text"))
    return map_batches(rows, run, f"id {kind}, score double, spans array<struct<start:int,end:int,p:double>>")


def train_split(labels: DataFrame, id_col: str = "doc_id") -> DataFrame:
    return labels.filter(id_crc32(id_col) % 3 != 1)


def reject_toxic(docs: DataFrame, model: Field, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs that score below threshold, all columns, repeated ones too; null and empty texts stay.

    The text passes once, beside its row.
    """
    kept = [c for c in docs.columns]
    held: list[_Emissions] = []

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        if not held:
            held.append(_Emissions(model))
        found = score_texts(texts_of(batch.column(batch.num_columns - 1)), held[0])
        mask = pa.array([s < threshold for s, _ in found], pa.bool_())
        return pa.RecordBatch.from_arrays(batch.columns[:-1], names=kept).filter(mask)

    from .common import schema_ddl

    return map_batches(docs.select("*", utf8(text_col).alias("__text")), run, schema_ddl(docs))


def op9_toxicity(spark, sf_dir: str) -> DataFrame:
    """Scores of every document, and its toxic spans; the field learns from the labels of two documents in three."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit(docs, train_split(table(spark, sf_dir, "labels")))
    held = F.coalesce(id_crc32("id") % 3 == 1, F.lit(False))
    return tag(docs, model).select(
        F.col("id").alias("doc_id"), held.alias("held_out"), "score", F.when(F.col("score") >= THRESHOLD, 1).otherwise(0).alias("predicted"), F.size("spans").alias("n_spans"), "spans"
    )
