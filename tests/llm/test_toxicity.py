import itertools

import numpy as np
from pyspark.sql import functions as F

from spanlight.llm import toxicity as T


def enumerated(e, pairs, start):
    total, on, joint = 0.0, np.zeros(len(e)), np.zeros((len(e), 2, 2))
    for path in itertools.product((0, 1), repeat=len(e)):
        w = np.exp(start * path[0] + sum(x * y for x, y in zip(e, path)) + sum(pairs[a, b] for a, b in zip(path, path[1:])))
        total += w
        on += w * np.array(path)
        for t in range(1, len(e)):
            joint[t, path[t - 1], path[t]] += w
    return on / total, joint / total


def test_marginals_against_enumeration():
    rng = np.random.default_rng(0)
    lengths = np.array([1, 7, 2, 9, 1, 5])
    e, pairs, start = rng.normal(0, 2, lengths.sum()), rng.normal(0, 1, (2, 2)), 0.7
    p, joint = T.marginals(e, lengths, pairs, start)
    at = 0
    for n in lengths:
        own, both = enumerated(e[at : at + n], pairs, start)
        assert np.allclose(p[at : at + n], own) and np.allclose(joint[at : at + n], both)
        at += n
    long = T.marginals(np.full(200_000, -3.0), np.array([200_000]), pairs, start)[0]
    assert np.isfinite(long).all()


def corpus(n=240):
    rng = np.random.default_rng(1)
    words = [f"{a}{b}{c}" for a in ("ka", "lo", "mi", "nu") for b in ("ra", "se", "ti") for c in ("on", "al", "er", "is")]
    rows, labels = [], []
    for k in range(n):
        text = [str(w) for w in rng.choice(words, rng.integers(5, 60))]
        bad = k % 4 == 0
        if bad:
            text[rng.integers(len(text))] = "grumx" + str(rng.choice(list("abcdefgh"))) + "!"
        rows.append((k, " ".join(text), 1))
        labels.append((k, int(bad)))
    return rows, labels


def test_held_out_accuracy_spans_and_odd_rows(spark):
    rows, labels = corpus()
    docs = spark.createDataFrame(rows, "doc_id long, text string, score int")
    model = T.fit(docs, T.train_split(spark.createDataFrame(labels + [(None, 1), (5, None)], "doc_id long, toxic int")))
    more = docs.union(spark.createDataFrame([(900, None, 1), (901, "", 1), (902, " \n", 1), (None, "kaseon grumxzz", 1), (903, "İstanbul grumxq " * 9000, 1)], docs.schema))
    got = {r.id: r for r in T.tag(more, model).collect()}
    for k, y in labels:
        assert (got[k].score >= T.THRESHOLD) == bool(y)
        text = rows[k][1]
        assert [text[s.start : s.end].startswith("grumx") for s in got[k].spans] == [True] * y
    assert [got[k].score for k in (900, 901, 902)] == [0.0] * 3 and got[903].score > 0.7 and got[None].score > 0.7
    kept = T.reject_toxic(more, model)
    assert kept.columns == more.columns
    assert {r.doc_id for r in kept.collect()} == {k for k, y in labels if not y} | {900, 901, 902}


def test_nothing_to_learn(spark):
    docs = spark.createDataFrame([(1, "some text"), (2, None)], "doc_id long, text string")
    model = T.fit(docs, spark.createDataFrame([], "doc_id long, toxic int"))
    assert [r.score < 0.01 for r in T.tag(docs, model).collect()] == [True, True]
    assert T.tag(docs.limit(0), model).count() == 0


def test_query_on_held_out_documents(spark):
    at = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{at}/labels.parquet").select("doc_id", "toxic")
    rows = T.op9_toxicity(spark, at).join(labels, "doc_id").filter("held_out").collect()
    right = sum(r.predicted == r.toxic for r in rows)
    assert right >= 0.95 * len(rows) and all(0 <= r.score <= 1 for r in rows)
    assert spark.read.parquet(f"{at}/labels.parquet").filter(F.col("toxic") == 1).count() > 0


def test_every_line_of_clean_texts_counts(monkeypatch):
    toxic = [f"you grubling fool {k} stop" for k in range(60)]
    clean = [f"a{k} quiet\nb{k} day\nc{k} again\nthe fool {k} of the play speaks\ngrub{k} is a name" for k in range(60)]
    seen = []
    real = T.marginals
    monkeypatch.setattr(T, "marginals", lambda e, n, *rest: (seen.append(int(n.sum())), real(e, n, *rest))[1])
    whole = T.train(toxic, clean, steps=3)
    words = sum(len(x.split()) for t in clean for x in t.split("\n")) + sum(len(t.split()) for t in toxic)
    assert seen == [words] * 3
    monkeypatch.setattr(T, "BLOCK", 50)
    parts = T.train(toxic, clean, steps=3)
    assert len(seen) > 6 and whole.weights.keys() == parts.weights.keys()
    assert all(abs(whole.weights[f] - parts.weights[f]) < 1e-9 for f in whole.weights)


def test_emission_is_what_training_sums():
    field = T.Field(weights={"wbad": 3.0, "3bad": -1.0, "wgood": -5.0, "3goo": 0.5}, bias=-1.0)
    assert field.emission("bad") == 1.0
    assert field.emission("good") == -5.5
    assert field.emission("bad,good;bad") == -3.5
    assert field.emission("...") == -1.0


def test_short_words_can_be_marked():
    toxic = [f"you zoq {k} stop" for k in range(60)]
    clean = [f"a{k} quiet day\nthe fool {k} of the play" for k in range(60)]
    field = T.train(toxic, clean)
    scores = [s for s, _ in T.score_texts(["what a zoq is it", "a quiet day of the fool"], T._Emissions(field))]
    assert scores[0] > 0.7 > 0.3 > scores[1]
