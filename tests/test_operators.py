"""Operators against plain versions, and their behaviour on odd rows."""

import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from spanlight.functions import stats as S
from spanlight.functions import text as T
from spanlight.operators import evaluation, fuzzy, learning, names, quotes, resampling, segment
from spanlight.sources import files


def one(spark, column, **values):
    df = spark.range(1).select(*(F.lit(v).alias(k) for k, v in values.items())) if values else spark.range(1)
    return df.select(column.alias("x")).first().x


@pytest.mark.parametrize(
    "text, parts",
    [
        ("One. Two! Three? Four", ["One.", "Two!", "Three?", "Four"]),
        ("He said (...) nothing. (Applause.) Then left.", ["He said (...) nothing.", "(Applause.)", "Then left."]),
        ("", []),
        ("a.b c", ["a.b c"]),
        ("One. Two", ["One.", "Two"]),
    ],
)
def test_sentence_parts(spark, text, parts):
    assert one(spark, T.sentence_parts(F.col("t")), t=text) == parts


def test_text_scalars(spark):
    c = F.col("t")
    assert one(spark, T.normalize_name(c), t="  São  João ") == "SAO JOAO"
    assert one(spark, T.tokens(c), t="Não, É 2x_y!") == ["nao", "e", "2x_y"]
    assert one(spark, T.is_stage_direction(c), t="(Applause) (Laughter)") is True
    assert one(spark, T.sentences(c), t="Too short. This one has four words.") == ["This one has four words."]
    assert one(spark, T.quoted_spans(c), t='He said "this is long enough" and "short" and “curly  quotes \'or another in\' here”.') == ["this is long enough", "curly quotes 'or another in' here", "or another in"]
    assert one(spark, T.mask_quotes(c), t='a "quoted" b') == "a b"
    assert one(spark, T.actor_slug(c), t="Élan & Co.") == "elan-co" and one(spark, T.actor_slug(c), t="!!") == "ator"
    assert one(spark, T.clean_role(c), t="Deputy (PT-SP) of the house") == "Deputy of the house"
    assert one(spark, T.normalize_label(c), t=" Não-Inferível  x") == "nao_inferivel_x"
    assert one(spark, T.trim_passage(c, 12), t="alpha beta, gamma delta") == "alpha beta […]"
    assert one(spark, T.trim_passage(c, 12), t="alphabetagammadelta x") == "alphabetagam […]" and one(spark, T.trim_passage(c, 12), t="a bcdefghijklmno") == "a bcdefghijk […]"
    assert one(spark, T.strip_accents(c), t="Łódź Ā Ệ e\u0301") == "Łodz A E e" and one(spark, T.name_tokens(c), t=" José  d'Ávila José") == ["JOSE", "D'AVILA"]
    assert one(spark, T.sentence_parts(c), t="five.\x01six. seven") == ["five.\x01six.", "seven"]
    nothing = F.lit(None).cast("string")
    assert len({one(spark, T.cache_key(F.lit("m"), *k), t="a") for k in ((c, nothing, c), (c, c), (c, F.lit(""), c))}) == 3
    assert one(spark, T.display_title(c, F.lit("subject")), t="\n \n First line\nsecond") == "First line"
    assert one(spark, T.repeated_ngram(c, 2, 3), t="a b a b a b") is True and one(spark, T.repeated_ngram(c, 2, 4), t="a b a b a b") is False
    assert one(spark, T.leading_sentences(T.sentence_parts(c), 5), t="One two three. Four five. Six.") == ["One two three.", "Four five."]
    assert one(spark, T.jaccard(F.array().cast("array<string>"), F.array().cast("array<string>"))) == 0.0


def test_scalar_statistics(spark):
    v = F.array(F.lit(0.2), F.lit(0.5), F.lit(0.1))
    assert math.isclose(one(spark, S.noisy_or(v)), 1 - 0.8 * 0.5 * 0.9)
    assert math.isclose(one(spark, S.top2_mean(v)), 0.35)
    assert math.isclose(sum(one(spark, S.softmax(v))), 1)
    assert math.isclose(one(spark, S.chance_mrr(F.lit(3))), (1 + 1 / 2 + 1 / 3) / 3)
    assert one(spark, S.wilson(F.lit(0), F.lit(0))) is None
    assert one(spark, S.unit_row(F.array(F.lit(0.0), F.lit(0.0)))) == [0.0, 0.0]
    assert one(spark, S.coverage_count(0.5, F.lit(1))) == 1
    assert [one(spark, S.score_band(F.lit(x), [0.2, 0.5])) for x in (0.1, 0.2, 0.5)] == [0, 1, 2]
    assert one(spark, S.kappa(F.lit(3), F.lit(0), F.lit(0), F.lit(0))) is None


def test_turns_and_spans(spark):
    t = "Opening.\nO SR. JOÃO SILVA (PT) - Bom dia. Tudo bem?\n\nA SRA. ANA - \U0001f600 Sim.\nO SR. X -  "
    rows = segment.turns(spark.createDataFrame([(1, t), (2, None), (3, "no header")], "id long, t string"), "id", "t").orderBy("turn").collect()
    assert [(r.turn, r.raw_name, r.info) for r in rows][:2] == [(0, "JOÃO SILVA", "PT"), (1, "ANA", None)]
    assert all(t[r.start_char : r.end_char] == r.speech for r in rows)
    assert rows[0].speech == "Bom dia. Tudo bem?"
    spans = segment.part_spans(spark.createDataFrame([(1, "One.  One.\nOne. (...) x. y")], "id long, t string"), ["id"], "t").orderBy("position").collect()
    assert ["One.  One.\nOne. (...) x. y"[r.start_char : r.end_char] for r in spans] == [r.part for r in spans]


def test_windows_of_short_groups(spark):
    rows = spark.createDataFrame([(1, 0, "a"), (1, 1, "b"), (1, 2, "c"), (2, 0, "x")], "g long, position int, sentence string")
    got = sorted((r.g, r.first, r["last"], r.text) for r in segment.windows(rows, ["g"], 2).collect())
    assert got == [(1, 0, 1, "a b"), (1, 1, 2, "b c"), (2, 0, 0, "x")]


def test_quote_match_in_speech(spark):
    pairs = spark.createDataFrame([("\U0001f600 And then\n the (big) dog ran home.", "the (big) DOG ran away"), ("nothing", "the big dog ran"), (None, "x")], "s string, q string")
    got = [r.match for r in quotes.match_in_speech(pairs, "s", "q").collect()]
    s = "\U0001f600 And then\n the (big) dog ran home."
    assert got[0].words == 4 and s[got[0].start_char : got[0].end_char] == "the (big) dog ran" and got[0].n == 1
    assert got[1:] == [None, None]
    rows = [("He said we will not go there today. And more. End.", "we will not go anywhere today. And"), ("xThe old house is on the hill by the sea, he said. No.", "The old house is on the hill by the sea")]
    more = quotes.extend_match(quotes.match_in_speech(spark.createDataFrame(rows, "s string, q string"), "s", "q"), "s", "q").collect()
    assert [(r.match.words, r.rule) for r in more] == [(4, "sentence_count"), (9, "suffix")] or [(r.match.words, r.rule) for r in more] == [(4, "sentence_count"), (10, "suffix")]
    assert rows[0][0][more[0].match.start_char : more[0].end_char] == "we will not go there today. And more."
    assert rows[1][0][more[1].match.start_char : more[1].end_char] == rows[1][1]


def test_longest_common_run(spark):
    rng = random.Random(0)
    pairs = [(" ".join(rng.choices("abcd", k=rng.randint(0, 14))), " ".join(rng.choices("abcd", k=rng.randint(0, 14)))) for _ in range(40)]

    def plain(a, b):
        a, b = a.split(), b.split()
        return max((n for n in range(1, len(a) + 1) for i in range(len(a) - n + 1) if any(a[i : i + n] == b[j : j + n] for j in range(len(b)))), default=0)

    got = quotes.longest_common_run(spark.createDataFrame(pairs, "a string, b string"), "a", "b").collect()
    assert all(r.run == plain(r.a, r.b) for r in got)


def test_names(spark):
    rows = spark.createDataFrame([(1, "Ana Maria Silva"), (2, "ANA SILVA"), (3, "Ana"), (4, "Bob Ray"), (5, None)], "id long, name string")
    t = names.with_tokens(rows, "id", "name")
    assert sorted(map(tuple, names.ambiguous_pairs(t).collect())) == [(1, 2), (1, 3), (2, 3)]
    assert sorted((r.a, r.b) for r in names.containing(t, t).collect() if r.a < r.b) == [(1, 2)]
    assert names.resolve_single_tokens(t.filter("id = 3"), t.filter("id = 4")).count() == 0


def test_evaluation_against_plain(spark):
    rng = random.Random(1)
    data = [(float(rng.randint(0, 9)), rng.randint(0, 1)) for _ in range(60)]
    df = spark.createDataFrame(data, "score double, label int")
    pos, neg = [s for s, y in data if y], [s for s, y in data if not y]
    auc = sum((p > n) + 0.5 * (p == n) for p, n in itertools.product(pos, neg)) / (len(pos) * len(neg))
    assert math.isclose(evaluation.roc_auc(df, "score", "label").first().auc, auc)
    assert evaluation.roc_auc(df.filter("label = 1"), "score", "label").first().auc is None
    shuffled = []
    for _ in range(4000):
        rng.shuffle(data)
        errors = np.cumsum([1 - y for _, y in sorted(data, key=lambda r: -r[0])])
        shuffled.append(np.mean(errors / np.arange(1, len(data) + 1)))
    assert abs(evaluation.aurc(df, "score", "label").first().aurc - np.mean(shuffled)) < 0.005
    assert math.isclose(one(spark, evaluation.mcnemar_exact(F.lit(1), F.lit(5))), 2 * (1 + 6) / 64)
    assert one(spark, evaluation.mcnemar_exact(F.lit(0), F.lit(0))) == 1.0 and one(spark, evaluation.mcnemar_exact(F.lit(900), F.lit(1200))) < 1e-9
    p = spark.createDataFrame([("a", 0.01), ("b", 0.04), ("c", 0.03), ("d", None)], "k string, p double")
    got = {r.k: round(r.p_holm, 6) for r in evaluation.holm(p, "p", [], "k").collect()}
    assert got == {"a": 0.04, "c": 0.09, "b": 0.09, "d": 1.0}


def test_resampling(spark):
    df = spark.createDataFrame([(k % 7, float(k)) for k in range(70)] + [(None, 1.0)], "c int, v double")
    reps = resampling.cluster_bootstrap(df, "c", "v", 50)
    assert reps.count() == 50 and reps.distinct().count() > 5
    assert resampling.cluster_bootstrap(df.limit(0), "c", "v", 50).count() == 0
    neg = resampling.hard_negatives(spark.range(30).withColumn("g", F.col("id") % 4), "id", "g").collect()
    assert len(neg) == 30 and all(r.key != r.negative and r.key % 4 == r.negative % 4 for r in neg)


def test_fuzzy(spark):
    def lcs(a, b):
        t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                t[i + 1][j + 1] = t[i][j] + 1 if x == y else max(t[i][j + 1], t[i + 1][j])
        return t[-1][-1]

    rng = random.Random(3)
    for _ in range(200):
        a, b = ("".join(rng.choices("abc", k=rng.randint(0, 80))) for _ in range(2))
        assert fuzzy.lcs_length(a, b) == lcs(a, b)
    assert fuzzy.partial_alignment("brown", "the quick bruwn fox")[1:] == (10, 15)
    assert fuzzy.token_set_ratio("a b c", "c a b") == 100.0 and fuzzy.token_set_ratio("", "a") == 0.0
    assert math.isclose(fuzzy.jaro_winkler("MARTHA", "MARHTA"), 0.9611, abs_tol=1e-4) and math.isclose(fuzzy.jaro_winkler("DIXON", "DICKSONX"), 0.8133, abs_tol=1e-4)
    assert fuzzy.json_objects('x {"a": {"b": 1}} {bad {"c": 2}') == (['{"a": {"b": 1}}', '{"c": 2}'], 1)
    claims = fuzzy.parse_profile("- first\n  wrapped\n\n# T ##\ntext\n1. one\n* two\n  - nested\n# Empty\n## T\n-x\n- y ")
    assert claims == [(0, "Sem título", 0, "first wrapped"), (1, "T", 0, "text 1. one"), (1, "T", 1, "two - nested"), (3, "T", 0, "-x"), (3, "T", 1, "y")]
    b = fuzzy.greedy_batches(spark.createDataFrame([(k, k % 13) for k in range(200)] + [(900, 5000)], "id long, n long"), "id", "n", 60, 8).collect()
    sizes = {}
    for r in b:
        sizes.setdefault(r.batch, []).append(r.length)
    assert len(b) == 201 and all(len(s) <= 8 and (max(s) * len(s) <= 60 or len(s) == 1) for s in sizes.values())
    for seed in range(4):
        lengths = [rng.choice([0, 1, 2, 3, 7, 20, 90]) for _ in range(120)]
        want, now = [], []
        for n in sorted(lengths, reverse=True):
            if now and (len(now) >= 5 or (len(now) + 1) * now[0] > 40):
                want.append(now)
                now = []
            now.append(n)
        want.append(now)
        found: dict = {}
        for r in fuzzy.greedy_batches(spark.createDataFrame(list(enumerate(lengths)), "id long, n long"), "id", "n", 40, 5).collect():
            found.setdefault(r.batch, []).append(r.length)
        assert [sorted(found[k], reverse=True) for k in range(len(found))] == want
    assert fuzzy.greedy_batches(spark.createDataFrame([], "id long, n long"), "id", "n", 40, 5).count() == 0


def test_word_alignment(spark):
    assert fuzzy.word_alignment("o gato preto", "Vi O GATO  prêto, ali") == (100.0, 3, 16)
    assert fuzzy.word_alignment("one two three", "two") == (50.0, 0, 3) and fuzzy.word_alignment("", "a") is None and fuzzy.word_alignment("a", "!!") is None
    assert fuzzy.best_alignment(["x y", "a b"], ["q", "a b", "x y"], True) == (100.0, 0, 2, 0, 3)
    assert fuzzy.best_alignment([], ["a"]) is None and fuzzy.best_alignment(["ab"], ["", "zab"]) == (100.0, 0, 1, 1, 3)
    rows = spark.createDataFrame([(1, ["a b"], ["c", "a b c"]), (2, [], ["x"]), (3, None, None)], "k int, n array<string>, t array<string>")
    got = {r.k: r.best and tuple(r.best) for r in fuzzy.align_best(rows, "n", "t", by_words=True).collect()}
    assert got == {1: (100.0, 0, 1, 0, 3), 2: None, 3: None}


def test_people_and_their_turns(spark):
    turns = [(1, 0, "PRESIDENTE", "Ana Maria Silva. Bloco/PT - SP"), (1, 1, "BETO RAY", None), (1, 2, "X", "José Ávila"), (1, 3, "Y", "PT - SP"), (2, 0, "CARLOS LIMA", None), (2, 1, "CARLOS REIS", None)]
    people = [(1, 0, "Ana Silva"), (1, 1, "beto"), (1, 2, "Jose  Avila"), (1, 3, "PT"), (2, 0, "Carlos"), (2, 1, ""), (2, 2, "Carlos Lima Neto"), (3, 0, "Ana")]
    t, p = spark.createDataFrame(turns, "hearing int, turn int, raw_name string, info string"), spark.createDataFrame(people, "hearing int, person int, name string")
    assert sorted(map(tuple, names.resolve_people(p, t).collect())) == [(1, 0, 0), (1, 1, 1), (1, 2, 2), (2, 2, 0)]


def test_best_overlap(spark):
    from spanlight.operators import evidence

    rng = random.Random(4)
    said = [(k, " ".join(rng.choices("abcdefghij", k=rng.randint(0, 9)))) for k in range(30)]
    texts = [(" ".join(rng.choices("abcdefghijkl", k=rng.randint(0, 12))),) for _ in range(40)] + [(None,)]
    want = {k: max(len(set(q.split()) & set((t or "").split())) / max(1, len(set(q.split()) | set((t or "").split()))) for (t,) in texts) for k, q in said}
    q, t = spark.createDataFrame(said, "id long, text string"), spark.createDataFrame(texts, "text string").repartition(3)
    for block in (20_000, 7):
        got = {r.id: r.score for r in evidence.best_overlap(q, "id", "text", t, "text", block).collect()}
        assert got.keys() == want.keys() and all(math.isclose(got[k], want[k]) for k in want)
    assert {r.score for r in evidence.best_overlap(q, "id", "text", t.limit(0), "text").collect()} == {None}
    assert evidence.best_overlap(q.limit(0), "id", "text", t, "text").count() == 0


def test_logistic(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(400, 2))
    y = (x @ [2.0, -1.0] + rng.normal(size=400) > 0).astype(int)
    df = spark.createDataFrame([(float(a), float(b), int(c)) for (a, b), c in zip(x, y)] + [(None, 1.0, 1)], "a double, b double, y int")
    model = learning.fit_logistic(df, ["a", "b"], "y")
    z = (x - x.mean(0)) / x.std(0)
    p = 1 / (1 + np.exp(-(z @ model["weights"] + model["intercept"])))
    gradient = z.T @ (p - y) + np.array(model["weights"])
    assert np.abs(gradient).max() < 1e-4 and abs((p - y).sum()) < 1e-4
    assert learning.predict_logistic(df.filter("a is null"), model).first().probability is None
    assert learning.fit_logistic(df.filter("y = 1"), ["a", "b"], "y") is None


def test_sources(spark, tmp_path):
    good = '{"id": "a", "n": 1}\n\n{"id": "b", "n": "x"}\nnot json\n'
    (tmp_path / "x.jsonl").write_text(good)
    ok, bad = files.read_permissive(spark, str(tmp_path / "x.jsonl"), "id string, n bigint")
    assert [r.id for r in ok.collect()] == ["a"] and sorted(str(r.id) for r in bad.collect()) == ["None", "b"]
    digest = files.sha256_of(spark, str(tmp_path / "x.jsonl")).first().sha256
    with pytest.raises(ValueError):
        files.read_gated_jsonl(spark, str(tmp_path / "x.jsonl"), "id string", "0" * 64)
    assert len(digest) == 64
    rows = spark.createDataFrame([("é;\"q\"", 1)], "a string, b int")
    files.write_review_csv(rows, str(tmp_path / "c"))
    assert [tuple(r) for r in files.read_review_csv(spark, str(tmp_path / "c")).collect()] == [("é;\"q\"", "1")]
    files.write_jsonl(rows.withColumn("c", F.lit(None).cast("int")), str(tmp_path / "j"))
    assert spark.read.text(str(tmp_path / "j")).first().value == '{"a":"é;\\"q\\"","b":1,"c":null}'
    store = files.KeyedStore(spark, str(tmp_path / "s"), "k string, v double", "k")
    store.add(spark.createDataFrame([("a", 1.0), ("a", 1.0)], "k string, v double"))
    store.add(spark.createDataFrame([("a", 9.0), ("b", 2.0)], "k string, v double"))
    assert sorted(map(tuple, store.read().collect())) == [("a", 1.0), ("b", 2.0)]
    assert [r.k for r in store.misses(spark.createDataFrame([("b",), ("c",)], "k string")).collect()] == ["c"]


def test_stream_feeds_a_store(spark, tmp_path):
    from spanlight.streaming import replay

    (tmp_path / "in").mkdir()
    (tmp_path / "in/1.json").write_text('{"k": "a", "v": 1.0}\n{"k": "b", "v": 2.0}\n')
    store = files.KeyedStore(spark, str(tmp_path / "s"), "k string, v double", "k")
    for _ in range(2):
        replay.feed_store(replay.read_json_stream(spark, str(tmp_path / "in"), "k string, v double"), store, str(tmp_path / "cp")).awaitTermination()
    assert store.read().count() == 2


def test_article_dates_and_names(spark):
    from spanlight.functions import speech

    c = F.col("t")
    a = "Atualizado em 02/03/2020 - 10:00 texto 01/03/2020 - 09:30; Nesta TERÇA-feira (3) e sexta-feira (31)."
    assert str(one(spark, speech.published_at(c), t=a)) == "2020-03-01 09:30:00" and str(one(spark, speech.updated_at(c), t=a)) == "2020-03-02 10:00:00"
    assert one(spark, speech.published_at(c), t="31/02/2020 - 10:00") is None and one(spark, speech.updated_at(c), t="none") is None
    assert [tuple(m) for m in one(spark, speech.weekday_mentions(c), t=a)] == [("Nesta TERÇA-feira (3)", True, 1, 3), ("sexta-feira (31)", False, 4, 31)]
    n, i = F.lit("PRESIDENTE"), F.col("t")
    assert [one(spark, speech.is_party_info(c), t=x) for x in ("PT-SP", "PT - SP", "Bloco/PT", "OPTOMETRISTA")] == [False, True, True, False]
    assert [one(spark, speech.turn_name_candidates(n, c), t=x) for x in ("Ana. Rede - SP", "Ana Silva", "PT - SP", "")] == [["PRESIDENTE", "Ana"], ["PRESIDENTE", "Ana Silva"], ["PRESIDENTE"], ["PRESIDENTE"]]
    assert one(spark, speech.resolve_turn_name(n, i), t="Ana Silva. Bloco/PT - SP") == "Ana Silva" and one(spark, speech.turn_party(n, i), t="Ana Silva. Bloco/PT - SP") == "Bloco/PT - SP"
    assert one(spark, speech.resolve_turn_name(n, i), t="Ana Silva") == "PRESIDENTE" and one(spark, speech.turn_party(n, i), t="Ana Silva") is None
    assert one(spark, speech.parse_level(c, ["sim", "nao"]), t=" Não, porque") == "nao" and one(spark, speech.coverage_bucket(F.lit(7), [3, 6, 10])) == 6
    assert [one(spark, speech.citation_problem(c, F.lit("A longa  frase do texto"), 3), t=x) for x in ("", "longa frase", "LONGA frase do", "outra frase aqui")] == ["missing", "too_short", None, "not_found"]


def test_passages(spark):
    from spanlight.operators import passages

    turns = spark.createDataFrame([(1, 0, "A first (one).  Then more", 10), (1, 1, "A first (one).", 90), (2, 0, "other", 0)], "h long, turn long, text string, start long")
    want = spark.createDataFrame([(1, "A first (one). Then"), (1, "A first (one)."), (2, "absent"), (3, "none")], "h long, s string")
    got = {(r.h, r.s): (r.turn, r.start_char, r.end_char) for r in passages.locate_sentences(turns, want, "h", "turn", "text", "start", "s").collect()}
    assert got == {(1, "A first (one). Then"): (0, 10, 30), (1, "A first (one)."): (0, 10, 24), (2, "absent"): (None, None, None), (3, "none"): (None, None, None)}
    assert one(spark, passages.merged_parts(F.col("t"), ["Sr."]), t="Hello. The Sr. Silva spoke for long. Yes. It was very good. End") == ["Hello. The Sr. Silva spoke for long.", "Yes. It was very good. End"]
    assert one(spark, passages.merged_parts(F.col("t"), []), t="") == []
    assert one(spark, passages.concatenated_premise(F.array(F.lit("a"), F.lit(" "), F.lit(None)))) is None
    spans = [(1, k, s, s + n) for k, (s, n) in enumerate([(0, 5), (4, 3000), (2047, 2), (5000, 0), (7000, 1)])]
    df = spark.createDataFrame(spans, "h long, id long, start_char long, end_char long")
    hit = {(r.a_id, r.b_id) for r in passages.overlapping(df, df, "h").collect()}
    assert hit == {(a, b) for _, a, s, e in spans for _, b, t, f in spans if s < e and t < f and s < f and t < e}
    assert passages.overlapping(df, df, "h").count() == len(hit)


def test_comparison(spark):
    from spanlight.operators import comparison

    reps = spark.createDataFrame([(float(x),) for x in (-1, 1, 2, 3)], "mean double")
    assert comparison.bootstrap_p(reps).first().p == 0.5
    rows = spark.createDataFrame([(1, 0.9, 0.1), (2, None, 0.7), (3, None, None)], "k long, a double, b double")
    got = {r.k: (r.votes, r.unanimous) for r in comparison.consensus(rows, ["a", "b"]).collect()}
    assert got == {1: (0.5, False), 2: (1.0, True), 3: (None, None)}
