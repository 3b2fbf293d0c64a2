"""The whole pipeline against a plain version that shares only the trained models."""

import re
from collections import Counter

import numpy as np
from tokenizers import Tokenizer

import corpus_pipeline
from spanlight.llm import bpe, mixing, quality, toxicity
from tests.llm.test_jaccard import plain_set, similar
from tests.llm.test_quality import plain as base_counts
from tests.llm.test_simhash import plain_components

AT = "/root/testdata/sf0.001"
SPACES = " \t\n\x0b\x0c\r"


def removed(line):
    n = len(re.findall("[^\x20\x09-\x0d]+", line))
    seps, marks, runs = (len(re.findall(p, line)) for p in (quality.SEPARATORS, quality.MARKS, quality.RUNS))
    return (
        (n >= 8 and not re.search(r"[.!?…:;][\"»”’')]*([\x20\x09-\x0d]|$)", line))
        or (seps >= 3 and 5 * seps >= n)
        or (marks >= 3 and 10 * marks >= 3 * n)
        or (runs >= 3 and 5 * runs >= n)
        or re.search(quality.PHRASES, line.lower()) is not None
    )


def test_run(spark):
    rows = {r.doc_id: r.text for r in spark.read.parquet(f"{AT}/documents.parquet").collect()}
    lang = {r.doc_id: r.lang for r in spark.read.parquet(f"{AT}/documents.parquet").collect()}
    kept = {}
    for k, text in rows.items():
        lines = [x for x in text.split("\n") if x.strip(SPACES)]
        bad = [x for x in lines if removed(x)]
        if not base_counts(text)[-1] and sum(map(len, bad)) <= quality.MAX_LOSS * sum(map(len, lines)):
            kept[k] = "\n".join(x for x in lines if not removed(x)) if bad else text
    docs = spark.createDataFrame([(k, t, lang[k]) for k, t in kept.items()], "doc_id long, text string, lang string")
    labels = spark.read.parquet(f"{AT}/labels.parquet")
    field = toxicity.fit(docs, toxicity.train_split(labels))
    scores = toxicity.score_texts(list(kept.values()), toxicity._Emissions(field))
    kept = {k: t for (k, t), (s, _) in zip(kept.items(), scores) if s < toxicity.THRESHOLD}
    sets = {k: plain_set(t) for k, t in kept.items()}
    near = [(a, b) for a in sets for b in sets if a < b and similar(sets[a], sets[b])]
    root = plain_components(sets, near)
    kept = {k: t for k, t in kept.items() if root[k] == k}
    docs = spark.createDataFrame([(k, t, lang[k]) for k, t in kept.items()], "doc_id long, text string, lang string")
    rates, plan = mixing.fit_rates(docs, mixing.by_language(docs), mixing.TARGETS, lossless=True)
    assert np.allclose(plan.reached, plan.targets, rtol=0.02)
    copies = {r.id: r.copies for r in rates.collect()}
    got = corpus_pipeline.run(spark, AT).collect()
    assert Counter(r.doc_id for r in got) == copies
    library = Tokenizer.from_file(bpe.vocabulary_path())
    for r in got:
        assert r.token_ids == library.encode(kept[r.doc_id], add_special_tokens=False).ids and r.n_tokens == len(r.token_ids)


def test_stages_keep_the_columns_of_documents_and_take_odd_rows(spark):
    rows = [(1, None, None, None, None), (2, "", "en", "s", 0), (None, "The boat was in the shed on the hill that day and it rained.", "en", "s", 60), (None, None, None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for some in (docs, docs.limit(0)):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            assert stage(spark, some, AT).columns == docs.columns
            stage(spark, some, AT).count()
        assert "token_ids" in corpus_pipeline.STAGES[-1][1](spark, some, AT).columns
