import random
import re
from collections import defaultdict

import duckdb

from spanlight.llm import quality

WORD = re.compile("[^\x20\x09-\x0d]+")


def plain(text):
    text = text or ""
    words = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    places = defaultdict(list)
    for i in range(len(words) - 4):
        places[tuple(words[i : i + 5])].append(i)
    covered = {p for at in places.values() if len(at) > 1 for i in at for p in range(i, i + 5)}
    failed = len(words) < 10 or 100 * len(covered) > 20 * len(words)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered), failed


def texts():
    rng = random.Random(2)
    bits = ["a", "b", "cd", "é", "😀", "x.", "|", "#", "!!", "\n", "\n", "\t", "\x0b", "\x0c", "\r", " ", "  ", "\x85", "\xa0", "The end."]
    out = ["".join(rng.choice(bits) + rng.choice(["", " "]) for _ in range(rng.randint(0, 60))) for _ in range(400)]
    return out + [None, "", " \n ", "word " * 30_000, " ".join(f"w{k}" for k in range(40_000)), ("same line here.\n" * 500)]


def test_against_brute_force_and_sql(spark, tmp_path):
    rows = [(k, t, 1, "z") for k, t in enumerate(texts())] + [(None, "no id", 2, "z"), (3, texts()[3], 1, "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, kept int, __quality_ string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    got = quality.op1_quality(spark, str(tmp_path)).collect()
    assert len(got) == len(rows)
    byid = {k: t for k, t, _, _ in rows}
    for r in got:
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == plain(byid[r.doc_id])
        assert not (r.base_failed and r.kept)
    duckdb.sql(f"CREATE OR REPLACE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet') WHERE length(text) < 9000")
    want = duckdb.sql(quality.ORACLE_SQL).fetchall()
    assert sorted(map(str, want)) == sorted(str(tuple(r)) for r in got if len(byid[r.doc_id] or "") < 9000 and byid[r.doc_id] is not None)


GOOD = "The boat was in the shed on the hill that day. It was not to be used by any of the men who came."

MORE = "Some came from the town and others by train; all were late, and none had an umbrella."


def test_lines_and_verdict(spark):
    nav = "Home | News | Sport | Contact | About | Help | Shop"
    cases = {
        "keep": (GOOD, True, GOOD),
        "furniture": (f"{GOOD}\nPlease accept all cookies now.\n{MORE}", True, f"{GOOD}\n{MORE}"),
        "menu": (f"{GOOD}\n{nav}\n{MORE}", True, f"{GOOD}\n{MORE}"),
        "mostly menu": (f"One two three four five six.\n{nav}\n{nav} x\n{nav} y", False, "One two three four five six."),
        "shout": ("BUY!! NOW!! AND!! HERE!! THE!! BEST!! OF!! ALL!! THE!! MANY!! THINGS!!", False, ""),
        "symbols": (" ".join(f"word{k}***" for k in range(30)), False, ""),
        "no sentence": ("one two three four five six seven eight nine ten eleven twelve", False, ""),
    }
    docs = spark.createDataFrame([(k, v[0], len(v[0])) for k, v in cases.items()], "doc_id string, text string, n_chars long")
    got = {r["doc_id"]: r["__quality"] for r in quality.measure(docs).collect()}
    for k, (_, kept, text) in cases.items():
        assert (got[k]["kept"], got[k]["clean_text"]) == (kept, text), k
    cleaned = {r.doc_id: r for r in quality.clean(docs).collect()}
    assert cleaned.keys() == {k for k, v in cases.items() if v[1]}
    assert all(r.text == cases[k][2] and r.n_chars == len(r.text) for k, r in cleaned.items())
    assert quality.clean(docs).columns == docs.columns
    assert quality.clean(docs.limit(0)).count() == 0
