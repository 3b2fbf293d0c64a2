import random

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline
from spanlight.llm import jaccard, simhash
from tests.llm.test_simhash import plain_components


def plain_set(text):
    words = (text or "").encode().lower().split()
    return {b" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def similar(a, b):
    return a == b or 5 * len(a & b) >= 4 * len(a | b)


def corpus():
    rng = random.Random(5)
    vocab, line = [f"w{i}" for i in range(400)], " one line that all of these texts have in common"
    texts = [None, "", " \n", "One", "oNE", "a b", "a b c d e f", "a b c d e f g h", "a b c d e f g"]
    for size in [9, 14, 30, 60, 150, 400, 900] * 3:
        base = [rng.choice(vocab) for _ in range(size)]
        for edits in (0, 1, 2, 4, size // 60, size // 50, size // 45, size // 40):
            words = list(base)
            for _ in range(edits):
                words[rng.randrange(size)] = rng.choice(vocab)
            texts.append(" ".join(words) + rng.choice(["", "", line]))
    rng.shuffle(texts)
    return texts


def test_against_brute_force(spark):
    texts = corpus()
    docs = spark.createDataFrame([(k, t, -k) for k, t in enumerate(texts)], "doc_id long, text string, node int")
    sets = [plain_set(t) for t in texts]
    linked = [(i, j) for j in range(len(sets)) for i in range(j) if similar(sets[i], sets[j])]
    root = plain_components(range(len(sets)), linked)
    got = simhash.deduplicate(docs)
    assert got.columns == docs.columns
    assert sorted(r.doc_id for r in got.collect()) == sorted(k for k in root if root[k] == k)
    assert len(linked) > 50


def test_similar_sets_always_share_a_key():
    rng = np.random.default_rng(1)
    for n in [*range(1, 60), 100, 333, 1000, 5000] * 5:
        a = np.unique(rng.integers(0, 2**64, n, dtype=np.uint64))
        gone = int(rng.integers(0, n // 9 + 1))
        new = int(rng.integers(0, n // 4 + 1))
        b = np.unique(np.r_[rng.permutation(a)[gone:], rng.integers(0, 2**64, new, dtype=np.uint64)])
        shared = len(np.intersect1d(a, b))
        assert jaccard.alike(a, b) == (5 * shared >= 4 * (len(a) + len(b) - shared))
        if jaccard.alike(a, b):
            assert np.intersect1d(jaccard.keys(a), jaccard.keys(b)).size


def test_stage_finds_copies_of_many_bits(spark):
    rng = random.Random(2)
    base = [f"w{rng.randrange(500)}" for _ in range(300)]
    copy = list(base)
    for k in range(7, 300, 60):
        copy[k] = "new"
    docs = spark.createDataFrame([(1, " ".join(base)), (2, " ".join(copy)), (3, "other words are in this text here")], "doc_id long, text string")
    stage = dict(corpus_pipeline.STAGES)["near-duplicates"]
    assert sorted(r.doc_id for r in stage(spark, docs, "").collect()) == [1, 3]




def test_counts_never_part_similar_sets(spark):
    rng = np.random.default_rng(3)
    rows, want = [], []
    for n in [1, 4, 5, 9, 40, 300, 2000] * 6:
        a = np.unique(rng.integers(0, 2**64, n, dtype=np.uint64))
        gone = int(rng.integers(0, n // 6 + 1))
        b = np.unique(np.r_[rng.permutation(a)[gone:], rng.integers(0, 2**64, int(rng.integers(0, n // 6 + 1)), dtype=np.uint64)])
        rows.append((jaccard.counts(a).tolist(), jaccard.counts(b).tolist(), len(a) + len(b), *jaccard.coarse(a).tolist(), *jaccard.coarse(b).tolist(), len(a), len(b)))
        want.append(jaccard.alike(a, b))
    lanes = ", ".join(f"{s}{k} long" for s in "ab" for k in range(jaccard.PARITIES // 64))
    df = spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], f"k int, a array<tinyint>, b array<tinyint>, n int, {lanes}, na int, nb int")
    left = {r.k for r in df.filter(jaccard.may_be_alike(F.col("a"), F.col("b"), F.col("n"))).collect()}
    assert {k for k, w in enumerate(want) if w} <= left and 0 < len(left) < len(rows)
    c = F.col
    room = jaccard.may_be_alike_coarsely(*([c(f"{s}{k}") for k in range(jaccard.PARITIES // 64)] for s in "ab"), c("na"), c("nb"))
    coarsely = {r.k for r in df.filter(room).collect()}
    assert {k for k, w in enumerate(want) if w} <= coarsely and 0 < len(coarsely) < len(rows)


def test_rows_without_or_with_the_same_id(spark):
    """(5, A) goes, for (3, A) stays; of rows of one id and text one stays; a null id goes only behind another row."""
    a, b, c = (" ".join(f"{x}{k}" for k in range(40)) for x in "abc")
    rows = [(3, a), (5, b), (5, a), (7, c), (7, c), (None, b), (None, "some other words"), (None, "some other words"), (8, a + " a40")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(((r.doc_id or 0), r.text) for r in simhash.deduplicate(docs).collect())
    assert got == [(0, "some other words"), (3, a), (5, b), (7, c)]


def test_pairs_meet_at_few_of_their_keys_and_none_is_lost(spark):
    """Near copies share many keys; each pair is put out about once."""
    rng = random.Random(8)
    base = [f"w{rng.randrange(900)}" for _ in range(400)]
    texts = []
    for _ in range(30):
        words = list(base)
        for k in rng.sample(range(400), 4):
            words[k] = f"v{rng.randrange(900)}"
        texts.append(" ".join(words))
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string")
    met = jaccard.keyed(docs, "text").distinct()
    nodes = simhash._read(docs, "doc_id", "text").withColumn("root", F.col("node"))
    held = simhash._with_before(met).join(nodes, "node").select("key", "before", "node", "root", "size", *simhash.COARSE)
    got = [tuple(r) for r in simhash._meeting(held).collect()]
    plain = [tuple(r) for r in simhash._meeting(held.withColumn("before", F.array().cast("array<bigint>"))).collect()]
    assert set(got) == set(plain) and len(plain) > 8 * len(set(plain)) > 800
    assert len(got) < 2 * len(set(got))
