import random

import pytest
import xxhash

from spanlight.llm import simhash
from spanlight.llm.components import components


def plain_fingerprint(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    parts = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(p, 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(nodes, linked):
    root = {n: n for n in nodes}

    def find(n):
        while root[n] != n:
            n = root[n]
        return n

    for a, b in linked:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    return {n: find(n) for n in nodes}


def corpus():
    rng = random.Random(3)
    vocab = [f"w{i}" for i in range(300)]
    rows, k = [], 0
    for _ in range(25):
        base = [rng.choice(vocab) for _ in range(rng.randint(60, 400))]
        for _ in range(rng.randint(1, 5)):
            words = list(base)
            for _ in range(rng.randint(0, 2)):
                words[rng.randrange(len(words))] = rng.choice(vocab)
            rows.append((k, " ".join(words), "x"))
            k += 1
    rows += [(k, None, "x"), (k + 1, "", "y"), (k + 2, " \t\n", "y"), (k + 3, "One", None), (k + 4, "oNE", None), (k + 5, "a b", None), (3, "again three", "x"), (None, "no id", "x")]
    return rows


def test_against_brute_force(spark):
    rows = corpus()
    docs = spark.createDataFrame(rows, "doc_id long, text string, fp string")
    got = [(r.id, r.fp & (2**64 - 1), r.component_id) for r in simhash.near_duplicates(docs).collect()]
    pairs = [(i, plain_fingerprint(t)) for i, t, _ in rows]
    assert sorted((i, f) for i, f, _ in got if i is not None) == sorted(x for x in pairs if x[0] is not None)
    least = {}
    for i, f in pairs:
        if i is not None:
            least[f] = min(i, least.get(f, i))
    fps = list(least)
    linked = [(least[a], least[b]) for a in fps for b in fps if a < b and (a ^ b).bit_count() <= 3]
    assert len(linked) > 5
    root = plain_components(least.values(), linked)
    assert all(c == root[least[f]] for i, f, c in got if i is not None)
    assert [c for i, _, c in got if i is None] == [None]


@pytest.mark.parametrize("bits", [0, 1, 2, 3])
def test_links_lose_nothing(spark, bits):
    rng = random.Random(bits)
    seeds = [rng.getrandbits(64) for _ in range(12)] + [0, 2**64 - 1]
    fps = set(seeds)
    for s in seeds:
        for _ in range(25):
            x = s
            for b in rng.sample(range(64), rng.randint(1, 4)):
                x ^= 1 << b
            fps.add(x)
    fps = sorted(fps)
    nodes = spark.createDataFrame([(k, f - 2**64 if f >= 2**63 else f) for k, f in enumerate(fps)], "node long, fp long")
    got = [tuple(sorted((r.u, r.v))) for r in simhash.links(nodes, bits).collect()]
    want = {(i, j) for i in range(len(fps)) for j in range(i + 1, len(fps)) if (fps[i] ^ fps[j]).bit_count() <= bits}
    assert len(got) == len(set(got)) and set(got) == want
    counts = simhash.candidates(nodes, bits)
    assert counts["links"] == len(want) <= counts["chain"] < counts["met"]


def test_components_of_long_paths_and_stars(spark):
    edges = [(i, i + 1) for i in range(60)] + [(200, k) for k in range(201, 230)] + [(300, 300), (None, 4), (200, 201)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long"), "a", "b").collect()}
    assert got == {**{k: 0 for k in range(1, 61)}, **{k: 200 for k in range(201, 230)}}


def test_empty_and_deduplicate(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert simhash.near_duplicates(empty).count() == 0
    assert simhash.deduplicate(empty).count() == 0
    docs = spark.createDataFrame([(4, "a b c d", 1), (2, "a b  c D", 2), (2, "a b  c D", 3), (9, "else where is it", 4)], "doc_id long, text string, id int")
    kept = simhash.deduplicate(docs)
    assert kept.columns == ["doc_id", "text", "id"]
    assert sorted(r.doc_id for r in kept.collect()) == [2, 9]
