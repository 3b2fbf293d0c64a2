"""Mixing to target weights with soft membership.

A softmax classifier on hashed byte pairs, learned from a table of (id, domain), gives each document its domain
posteriors p. Nonnegative rates r are fitted so that the expected token totals sum_d r_d n_d p_dk meet the
targets T_k in least squares, each domain's residual scaled by c_k = 1 / sum_d n_d p_dk^2, by projected gradient from
r = 1 in the token-weighted metric:

    a_k = sum_d r_d n_d p_dk        s_k = eta c_k (a_k - T_k)        r_d <- max(floor, r_d - sum_k p_dk s_k)

Each iteration is one distributed sum of K numbers; eta is one over the largest eigenvalue of the K x K matrix of
the problem. A rate follows from the document's posteriors and the list of steps s alone, so rates need no join.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .bpe import text_column, vocabulary_path
from .common import cut, id_crc32, map_batches, schema_ddl, table, utf8
from .tokenfiles import library_codes

BINS = 2048
#: The bound of the labelled sample that the driver learns from, in documents, by the hash of their ids.
SAMPLE = 2000
#: The queries' target weights by language, the domain of their labelled table.
TARGETS = {"en": 0.5, "de": 0.18, "fr": 0.18, "es": 0.14}
#: Rounds of the fit, and the share of all tokens that a domain may be off when it ends earlier; Plan.met tells.
ROUNDS, TOLERANCE = 40, 1e-5
DRAWS = 1 << 20


def histogram(data: bytes) -> np.ndarray:
    """Shares of hashed byte pairs, in square roots."""
    b = np.frombuffer(data, np.uint8)
    if len(b) < 2:
        return np.zeros(BINS, np.float32)
    code = (b[:-1].astype(np.uint16) * np.uint16(31) + b[1:]) & np.uint16(BINS - 1)
    return np.sqrt(np.bincount(code, minlength=BINS) / len(code)).astype(np.float32)


@dataclass
class Classifier:
    domains: list[str]
    weights: np.ndarray
    bias: np.ndarray

    def posteriors(self, texts: list[bytes]) -> np.ndarray:
        x = np.stack([histogram(t) for t in texts]) if texts else np.zeros((0, BINS), np.float32)
        z = x @ self.weights + self.bias
        e = np.exp(z - z.max(1, keepdims=True)) if len(self.domains) else z
        return (e / e.sum(1, keepdims=True)).astype(float) if len(self.domains) else e.astype(float)


def train(texts: list[bytes], labels: list[str], steps: int = 150, rate: float = 0.1, decay: float = 1e-3) -> Classifier:
    """Softmax regression by Adam; without texts there are no domains."""
    domains = sorted(set(labels))
    w, b = np.zeros((BINS, len(domains)), np.float32), np.zeros(len(domains), np.float32)
    if not texts:
        return Classifier(domains, w, b)
    x = np.stack([histogram(t) for t in texts])
    y = np.eye(len(domains), dtype=np.float32)[[domains.index(k) for k in labels]]
    means, squares = [np.zeros_like(w), np.zeros_like(b)], [np.zeros_like(w), np.zeros_like(b)]
    for step in range(1, steps + 1):
        z = x @ w + b
        p = np.exp(z - z.max(1, keepdims=True))
        off = (p / p.sum(1, keepdims=True) - y) / len(x)
        for i, (t, g) in enumerate(((w, x.T @ off + decay * w / len(x)), (b, off.sum(0)))):
            means[i] = 0.9 * means[i] + 0.1 * g
            squares[i] = 0.99 * squares[i] + 0.01 * g * g
            t -= rate * (means[i] / (1 - 0.9**step)) / (np.sqrt(squares[i] / (1 - 0.99**step)) + 1e-8)
    return Classifier(domains, w, b)


def fit_classifier(docs: DataFrame, labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", domain_col: str = "domain", sample: int = SAMPLE) -> Classifier:
    """From at most sample rows of labelled (id, domain); null ids, domains and texts are none."""
    picked = labelled.select(F.col(id_col).alias("id"), F.col(domain_col).alias("domain")).filter("id is not null and domain is not null")
    picked = picked.orderBy(F.xxhash64("id"), "id", "domain").limit(sample).distinct()
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).filter("text is not null")
    rows = texts.join(F.broadcast(picked), "id").select("id", utf8("text").alias("text"), "domain").orderBy("id", "domain").limit(2 * sample).toArrow()
    return train(rows.column("text").to_pylist(), rows.column("domain").to_pylist())


def with_tokens(docs: DataFrame, model: Classifier, text_col: str = "text", path: str | None = None) -> DataFrame:
    """docs without text_col, with __p array<double> and __n bigint, the number of the text's ids in a vocabulary (bpe.VOCABULARY
    unless path names one); null texts are empty. One pass, no shuffle."""
    rest, path = docs.drop(text_col), path or vocabulary_path()
    names = rest.columns

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = batch.column(len(names))
        counts = pa.array(library_codes(path).count(text_column(texts)), pa.int64())
        posteriors = pa.array(model.posteriors(texts.to_pylist()).tolist(), pa.list_(pa.float64()))
        return pa.RecordBatch.from_arrays([*batch.columns[:-1], counts, posteriors], [*names, "__n", "__p"])

    given = docs.select(*(F.col(f"`{c}`") for c in names), utf8(text_col).alias("__t"))
    return map_batches(given, run, ", ".join(x for x in (schema_ddl(rest), "__n bigint", "__p array<double>") if x))


@dataclass
class Plan:
    """The steps of the fit; targets and reached are token totals by domain."""

    domains: list[str]
    floor: float
    steps: list[list[float]] = field(default_factory=list)
    targets: list[float] = field(default_factory=list)
    reached: list[float] = field(default_factory=list)

    @property
    def met(self) -> bool:
        """Whether the fit reached its targets within the tolerance before its rounds were over."""
        off = np.abs(np.array(self.reached) - np.array(self.targets))
        return bool(off.max(initial=0.0) <= TOLERANCE * max(1.0, sum(self.targets)))

    def rates(self, p: np.ndarray) -> np.ndarray:
        """The rate of each row of posteriors."""
        r = np.ones(len(p))
        for s in self.steps:
            r = np.maximum(self.floor, r - p @ np.array(s))
        return r


def _matrix(column: pa.Array, size: int) -> np.ndarray:
    return np.asarray(column.flatten(), float).reshape(-1, size) if size else np.zeros((len(column), 0))


def with_rates(scored: DataFrame, plan: Plan) -> DataFrame:
    """scored (with __p) and __r double, its rate."""
    names, size = scored.columns, len(plan.domains)
    at = names.index("__p")

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([*batch.columns, pa.array(plan.rates(_matrix(batch.column(at), size)))], [*names, "__r"])

    return map_batches(scored, run, f"{schema_ddl(scored)}, __r double")


def with_text_rates(docs: DataFrame, model: Classifier, plan: Plan, text_col: str = "text") -> DataFrame:
    """docs and __r double, each text's rate; null texts are empty. One pass of one worker a task, no shuffle."""
    names = docs.columns

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        rates = plan.rates(model.posteriors(batch.column(len(names)).to_pylist()))
        return pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(rates, pa.float64())], [*names, "__r"])

    return map_batches(docs.select("*", utf8(text_col).alias("__t")), run, f"{schema_ddl(docs)}, __r double")


def _totals(scored: DataFrame, plan: Plan) -> np.ndarray:
    """Expected token totals by domain under the plan so far: one row from each partition."""
    size = len(plan.domains)

    def run(batches):
        total = np.zeros(size)
        for batch in batches:
            p = _matrix(batch.column(1), size)
            total += (plan.rates(p) * np.asarray(batch.column(0), float)) @ p
        yield pa.RecordBatch.from_arrays([pa.array([x]) for x in total], [f"s{k}" for k in range(size)])

    parts = scored.select("__n", "__p").mapInArrow(run, ", ".join(f"s{k} double" for k in range(size)))
    return np.array([x or 0.0 for x in parts.agg(*(F.sum(f"s{k}") for k in range(size))).first()])


def solve(scored: DataFrame, domains: list[str], weights: dict[str, float], lossless: bool = False) -> Plan:
    """Fits rates for scored (__n, __p). Domains without a weight keep their tokens.

    The weighted domains share their present total; if lossless, a total so large that none of them shrinks, and
    rates are at least one. A domain without tokens can reach no target and is left out.
    """
    plan = Plan(domains, 1.0 if lossless else 0.0)
    n, p, size = F.col("__n").cast("double"), F.col("__p"), len(domains)
    if not size:
        return plan
    pairs = [(i, j) for i in range(size) for j in range(i, size)]
    sums = [F.sum(n * p[k]) for k in range(size)] + [F.sum(n * p[i] * p[j]) for i, j in pairs]
    row = [x or 0.0 for x in scored.agg(*(s.alias(f"s{k}") for k, s in enumerate(sums))).first()]
    have, gram = np.array(row[:size]), np.zeros((size, size))
    for (i, j), x in zip(pairs, row[size:]):
        gram[i, j] = gram[j, i] = x
    share = np.array([max(0.0, weights.get(d, 0.0)) for d in domains])
    listed = (share > 0) & (have > 0)
    targets = have.copy()
    if listed.any():
        share = np.where(listed, share, 0) / share[listed].sum()
        total = (have[listed] / share[listed]).max() if lossless else have[listed].sum()
        targets = np.where(listed, share * total, have)
    c = np.where(np.diag(gram) > 0, 1 / np.maximum(np.diag(gram), 1e-300), 0.0)
    root = np.sqrt(c)
    top = np.linalg.eigvalsh(gram * root[:, None] * root[None, :]).max()
    eta = 1 / top if top > 0 else 0.0
    reached = have
    for _ in range(ROUNDS):
        off = reached - targets
        if np.abs(off).max() <= TOLERANCE * max(1.0, targets.sum()):
            break
        plan.steps.append((eta * c * off).tolist())
        reached = _totals(scored, plan)
    plan.targets, plan.reached = targets.tolist(), reached.tolist()
    return plan


def copies(rate: Column, id_col: Column, seed: int = 7) -> Column:
    """A whole number whose mean over ids is the rate: its floor, and one more by a hash of the id."""
    draw = F.pmod(F.xxhash64(id_col, F.lit(seed)), F.lit(DRAWS)) / F.lit(float(DRAWS))
    return (F.floor(rate) + F.when(draw < rate - F.floor(rate), 1).otherwise(0)).cast("int")


def mix(docs: DataFrame, labelled: DataFrame, weights: dict[str, float], id_col: str = "doc_id", text_col: str = "text", domain_col: str = "domain", lossless: bool = True) -> DataFrame:
    """The rows of docs, each as many times as its copies, all columns; with lossless (its default) at least once.

    Null texts are empty. Rows that share an id have the same draw; rows without one too.
    """
    model = fit_classifier(docs, labelled, id_col, text_col, domain_col)
    scored = cut(with_tokens(docs.select(text_col), model, text_col))
    plan = solve(scored, model.domains, weights, lossless)
    counted = with_text_rates(docs, model, plan, text_col).withColumn("__c", copies(F.col("__r"), F.col(id_col))).filter("__c > 0")
    return counted.select(*docs.columns, F.explode(F.array_repeat(F.lit(0), F.col("__c")))).select(docs.columns)


def fit_rates(docs: DataFrame, labelled: DataFrame, weights: dict[str, float], id_col: str = "doc_id", text_col: str = "text", domain_col: str = "domain", lossless: bool = False) -> tuple[DataFrame, Plan]:
    """(id, n_tokens, domain, posterior, rate, copies) of every row of docs, and the plan.

    domain is that of the largest posterior (null where no domain is known), posterior is in the plan's order.
    n_tokens counts ids of bpe.VOCABULARY. A null text is empty: no tokens, the classifier's prior. Repeated rows count each.
    """
    model = fit_classifier(docs, labelled, id_col, text_col, domain_col)
    scored = cut(with_tokens(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), model))
    plan = solve(scored, model.domains, weights, lossless)
    names = F.array(*map(F.lit, model.domains)).cast("array<string>")
    best = F.try_element_at(names, F.array_position("__p", F.array_max("__p")).cast("int")) if model.domains else F.lit(None).cast("string")
    rated = with_rates(scored, plan)
    return rated.select("id", F.col("__n").alias("n_tokens"), best.alias("domain"), F.col("__p").alias("posterior"), F.col("__r").alias("rate"), copies(F.col("__r"), F.col("id")).alias("copies")), plan


def by_language(docs: DataFrame) -> DataFrame:
    """The queries' labelled table: the languages of three documents in four."""
    return docs.filter(id_crc32() % 4 != 2).select("doc_id", F.col("lang").alias("domain"))


def op4_mixing(spark, sf_dir: str) -> DataFrame:
    """Tokens, domain posteriors, rate and copies of every document for the target weights, and whether the fit met them."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    rates, plan = fit_rates(docs, by_language(docs), TARGETS)
    return rates.withColumnRenamed("id", "doc_id").withColumn("targets_met", F.lit(plan.met))
