import numpy as np
from pyspark.sql import functions as F

from spanlight.llm import mixing as M


def scored(spark, n=300, seed=0):
    rng = np.random.default_rng(seed)
    p = rng.dirichlet([0.3, 0.3, 0.3], n)
    tokens = rng.integers(0, 500, n)
    rows = [(k, int(t), [float(x) for x in q]) for k, (t, q) in enumerate(zip(tokens, p))]
    return spark.createDataFrame(rows, "id long, __n long, __p array<double>"), tokens, p


def plain(tokens, p, targets, floor, rounds=4000):
    """The same least squares, by plain projected gradient on the rates."""
    r = np.ones(len(tokens))
    a = tokens[:, None] * p
    c = 1 / (a * p).sum(0)
    eta = 0.3
    for _ in range(rounds):
        r = np.maximum(floor, r - eta * p @ (c * (r @ a - targets)))
    return r @ a


def test_targets_are_met(spark):
    df, tokens, p = scored(spark)
    plan = M.solve(df, ["a", "b", "c"], {"a": 0.6, "b": 0.3, "c": 0.1})
    total = float((tokens[:, None] * p).sum())
    assert np.allclose(plan.targets, np.array([0.6, 0.3, 0.1]) * total)
    assert np.allclose(plan.reached, plain(tokens, p, np.array(plan.targets), 0.0), rtol=5e-3)
    assert np.allclose(plan.reached, plan.targets, rtol=5e-3)
    rates = np.array([r["__r"] for r in M.with_rates(df, plan).orderBy("id").collect()])
    assert (rates >= 0).all() and np.allclose(rates @ (tokens[:, None] * p), plan.reached)


def test_lossless_and_unweighted_domains(spark):
    df, tokens, p = scored(spark, seed=1)
    have = tokens @ p
    plan = M.solve(df, ["a", "b", "c"], {"a": 0.8, "b": 0.2}, lossless=True)
    assert np.isclose(plan.targets[2], have[2]) and np.isclose(plan.targets[0], 4 * plan.targets[1])
    rates = [r["__r"] for r in M.with_rates(df, plan).collect()]
    assert min(rates) >= 1.0
    assert M.solve(df.limit(0), ["a"], {"a": 1.0}).steps == [] and M.solve(df, [], {}).steps == []


def test_copies_have_the_mean_of_the_rate(spark):
    n = spark.range(20_000).select(M.copies(F.lit(2.3), F.col("id")).alias("c")).agg(F.avg("c"), F.min("c"), F.max("c")).first()
    assert abs(n[0] - 2.3) < 0.02 and (n[1], n[2]) == (2, 3)


def test_query_and_odd_rows(spark):
    rows = M.op4_mixing(spark, "/root/testdata/sf0.01").collect()
    assert len(rows) == 1000 and all(r.rate >= 0 and abs(sum(r.posterior) - 1) < 1e-6 for r in rows)
    got = np.array([r.rate * r.n_tokens * np.array(r.posterior) for r in rows]).sum(0)
    want = np.array([0.18, 0.5, 0.14, 0.18]) * sum(r.n_tokens for r in rows)
    assert np.allclose(got, want, rtol=0.01)
    docs = spark.createDataFrame([(k, t, x, 1) for k, (t, x) in enumerate([("aaa bbb " * 30, "p"), ("zzz yyy " * 30, "q"), (None, "p"), ("", None), ("aaa bbb " * 9, "p")])] + [(None, "zzz", "q", 2)], "doc_id long, text string, domain string, rate int")
    mixed = M.mix(docs, docs, {"p": 0.2, "q": 0.8})
    assert mixed.columns == docs.columns
    ids = [r.doc_id for r in mixed.collect()]
    assert set(ids) == {0, 1, 2, 3, 4, None} and ids.count(1) > 1
    assert M.mix(docs.limit(0), docs, {"p": 1.0}).count() == 0
    assert sorted(str(r.doc_id) for r in M.mix(docs, docs.limit(0), {"p": 1.0}).collect()) == sorted(map(str, [0, 1, 2, 3, 4, None]))


def test_tokens_are_ids_of_the_vocabulary(spark):
    from tokenizers import Tokenizer

    from spanlight.llm import bpe

    texts = ["Unbelievably long-winded words", "x" * 900, "a  b\n\n c\t", "", None, "Straße 12'3, été"]
    docs = spark.createDataFrame([(k, t, "p") for k, t in enumerate(texts)], "doc_id long, text string, domain string")
    library = Tokenizer.from_file(bpe.vocabulary_path())
    rates, _ = M.fit_rates(docs, docs, {"p": 1.0})
    got = {r.id: r.n_tokens for r in rates.collect()}
    assert got == {k: len(library.encode(t or "", add_special_tokens=False).ids) for k, t in enumerate(texts)}


def test_mixing_takes_one_worker_a_task(spark):
    docs = spark.createDataFrame([(k, "aaa bbb " * k, "pq"[k % 2]) for k in range(1, 9)], "doc_id long, text string, domain string")
    mixed = M.mix(docs, docs, {"p": 0.5, "q": 0.5})
    assert mixed._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 1
    assert {r.doc_id for r in mixed.collect()} == set(range(1, 9))
