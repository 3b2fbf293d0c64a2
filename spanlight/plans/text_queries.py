"""Queries on texts: segmentation, quotations, names, retrieval, evidence."""

from __future__ import annotations


from pyspark.sql import functions as F

from ..functions import speech
from ..functions import stats as S
from ..functions import text as T
from ..operators import evidence as E
from ..operators import names, quotes, retrieval, segment
from .registry import query, table

TOKENS = r"list_filter(string_split_regex(lower(strip_accents({})), '[^\p{{L}}\p{{N}}_]+'), lambda x: x <> '')"
WORDS = r"list_filter(string_split_regex({}, '\s+'), lambda x: x <> '')"
PARTS = (
    r"list_transform(list_filter(string_split(regexp_replace(regexp_replace({}, '\(\.\.\.\)\s+', '(...)' || chr(2), 'g'), "
    r"'([.!?]\)?)\s+', '\1' || chr(1), 'g'), chr(1)), lambda x: x <> ''), lambda x: replace(x, chr(2), ' '))"
)
SENTENCES = "list_transform(list_filter(" + PARTS + ", lambda x: len(" + WORDS.format("x") + r") >= 4 AND NOT regexp_matches(trim(x), '^(\([^()]*\)\s*)+$')), lambda x: trim(regexp_replace(x, '\s+', ' ', 'g')))"
ROWS = f"SELECT doc_id, lang, source, unnest(range(0, len(s))) AS position, unnest(s) AS sentence FROM (SELECT doc_id, lang, source, {SENTENCES.format('text')} AS s FROM documents)"


def _sentences(spark, d):
    return segment.sentences(table(spark, d, "documents"), ["doc_id", "lang", "source"], "text")


@query(f"SELECT lang, count(*) AS n, count(DISTINCT sentence) AS n_distinct, sum(length(sentence))::BIGINT AS chars FROM ({ROWS}) GROUP BY lang")
def sentence_stats(spark, d):
    """Sentences, distinct ones and their characters by language."""
    return _sentences(spark, d).groupBy("lang").agg(F.count("*").alias("n"), F.countDistinct("sentence").alias("n_distinct"), F.sum(F.length("sentence")).alias("chars"))


def _window_sql(n: int) -> str:
    return f"""SELECT doc_id, first, last, md5(text) AS text_md5 FROM (
      SELECT doc_id, position::INTEGER AS first, (last_value(position) OVER w)::INTEGER AS last, count(*) OVER w AS n,
        array_to_string(list(sentence) OVER w, ' ') AS text, row_number() OVER (PARTITION BY doc_id ORDER BY position) AS k
      FROM ({ROWS}) WINDOW w AS (PARTITION BY doc_id ORDER BY position ROWS BETWEEN CURRENT ROW AND {n - 1} FOLLOWING)
    ) WHERE n = {n} OR k = 1"""


def _windows(spark, d, n):
    return segment.windows(_sentences(spark, d), ["doc_id"], n).select("doc_id", "first", F.col("last"), F.md5("text").alias("text_md5"))


@query(_window_sql(2))
def sentence_window2(spark, d):
    return _windows(spark, d, 2)


@query(_window_sql(3))
def sentence_window3(spark, d):
    return _windows(spark, d, 3)


@query(f"SELECT doc_id, position::INTEGER AS position, md5(sentence) AS sentence_md5, (sum(length(sentence) + 1) OVER (PARTITION BY doc_id ORDER BY position) - length(sentence) - 1)::BIGINT AS start FROM ({ROWS})")
def joined_sentence_starts(spark, d):
    """Each sentence's place in the joined sentences of its document."""
    return segment.joined_segments(_sentences(spark, d), ["doc_id"], "position", "sentence").select("doc_id", "position", F.md5("sentence").alias("sentence_md5"), "start")


@query(f"""WITH s AS (SELECT conv_id, turn, len({SENTENCES.format('text')}) AS m FROM conversations)
SELECT 'turn' AS kind, count(*)::BIGINT AS n FROM s UNION ALL SELECT 'sentence', sum(m)::BIGINT FROM s
UNION ALL SELECT 'window2', sum(greatest(1, m - 1))::BIGINT FROM s WHERE m > 0 UNION ALL SELECT 'window3', sum(greatest(1, m - 2))::BIGINT FROM s WHERE m > 0""")
def unit_kind_counts(spark, d):
    """How many whole turns, sentences and windows the conversations have."""
    return segment.unit_kinds(table(spark, d, "conversations"), ["conv_id", "turn"], "text").groupBy("kind").agg(F.count("*").alias("n"))


@query(f"SELECT lang, count(*) FILTER (WHERE len(w) < 4) AS n_short, count(*) FILTER (WHERE regexp_matches(trim(p), '^(\\([^()]*\\)\\s*)+$')) AS n_directions, count(*) AS n FROM (SELECT lang, p, {WORDS.format('p')} AS w FROM (SELECT lang, unnest({PARTS.format('text')}) AS p FROM documents)) GROUP BY lang")
def part_filters(spark, d):
    """Parts that are no sentences, by reason."""
    parts = table(spark, d, "documents").select("lang", F.explode(T.sentence_parts(F.col("text"))).alias("p"))
    one = lambda c: F.sum(c.cast("bigint"))
    return parts.groupBy("lang").agg(one(T.word_count(F.col("p")) < 4).alias("n_short"), one(T.is_stage_direction(F.col("p"))).alias("n_directions"), F.count("*").alias("n"))


@query(f"SELECT doc_id, len(list_distinct({TOKENS.format('text')}))::INTEGER AS n_tokens, md5(regexp_replace(trim(regexp_replace(text, '\\s+', ' ', 'g')), ' ', '', 'g')) AS squeezed_md5 FROM documents")
def token_sets(spark, d):
    return table(spark, d, "documents").select("doc_id", F.size(T.token_set(F.col("text"))).alias("n_tokens"), F.md5(T.without_whitespace(T.normalize_whitespace(F.col("text")))).alias("squeezed_md5"))


_PREFIX = f"""t AS (SELECT item_id AS id, {TOKENS.format('text')} AS t FROM benchmark),
want AS (SELECT DISTINCT id, least(n, len(t))::INTEGER AS words, array_to_string(t[1:n], ' ') AS prefix FROM t, (VALUES (10), (6), (4), (3)) v(n) WHERE length(array_to_string(t[1:n], ' ')) >= 6),
docs AS (SELECT doc_id, ' ' || array_to_string({TOKENS.format('text')}, ' ') || ' ' AS flat FROM documents),
found AS (SELECT id, words, doc_id AS text_id FROM want JOIN docs ON contains(flat, ' ' || prefix || ' ')),
best AS (SELECT * FROM (SELECT *, max(words) OVER (PARTITION BY id) AS m FROM found) WHERE words = m)"""


def _found(spark, d):
    return quotes.occurrences(table(spark, d, "benchmark"), "item_id", "text", table(spark, d, "documents"), "doc_id", "text")


@query(f"WITH {_PREFIX} SELECT id, words, count(DISTINCT text_id) AS n_texts, min(text_id) AS first_text FROM best GROUP BY id, words")
def quote_ladder_first_match(spark, d):
    """Of each benchmark passage: its longest prefix found, in how many documents, and the first of them."""
    return quotes.first_match(_found(spark, d)).select("id", "words", "n_texts", "first_text")


@query(f"WITH {_PREFIX} SELECT text_id AS doc_id, count(DISTINCT id) AS n_items FROM found WHERE words >= 6 GROUP BY text_id")
def quote_trusted_docs(spark, d):
    """Documents with a trusted prefix (six words or more)."""
    return _found(spark, d).filter(F.col("words") >= quotes.TRUSTED_WORDS).groupBy(F.col("text_id").alias("doc_id")).agg(F.countDistinct("id").alias("n_items"))


@query(f"""WITH {_PREFIX}, q AS (SELECT item_id AS id, list_distinct({TOKENS.format('text')}) AS q FROM benchmark), d AS (SELECT doc_id AS text_id, list_distinct({TOKENS.format('text')}) AS t FROM documents),
s AS (SELECT DISTINCT b.id, b.words, b.text_id, round(len(list_intersect(q, t)) / len(list_distinct(list_concat(q, t))), 9) AS jaccard FROM best b JOIN q USING (id) JOIN d USING (text_id))
SELECT id, words, text_id, jaccard FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY jaccard DESC, text_id) AS k FROM s) WHERE k = 1""")
def quote_best_occurrence(spark, d):
    """Of each passage the document that shares most words with it, among those with its longest prefix."""
    b, docs = table(spark, d, "benchmark"), table(spark, d, "documents")
    return quotes.best_occurrence(_found(spark, d), b, "item_id", "text", docs, "doc_id", "text")


@query("SELECT doc_id, md5(trim(regexp_replace(regexp_replace(text, '[\"“][^\"“”]+[\"”]', ' ', 'g'), '\\s+', ' ', 'g'))) AS masked_md5, (len(regexp_extract_all(text, '“([^”]{10,})”|\"([^\"]{10,})\"')))::INTEGER AS n_double FROM documents")
def quote_masked_text(spark, d):
    return table(spark, d, "documents").select("doc_id", F.md5(T.mask_quotes(F.col("text"))).alias("masked_md5"), F.regexp_count("text", F.lit(T.DOUBLE_QUOTES)).alias("n_double"))


@query(f"""WITH t AS (SELECT item_id AS id, {TOKENS.format('text')} AS t FROM benchmark), g AS (SELECT id, unnest(list_transform(range(1, len(t) - 3), lambda i: array_to_string(t[i:i+4], ' '))) AS g FROM t),
p AS (SELECT a.id AS a, b.id AS b, count(DISTINCT a.g) AS shared FROM g a JOIN g b ON a.g = b.g AND a.id < b.id GROUP BY 1, 2) SELECT * FROM p""")
def shared_ngrams(spark, d):
    """Pairs of benchmark passages that share word 5-grams."""
    t = table(spark, d, "benchmark").select(F.col("item_id").alias("id"), T.tokens(F.col("text")).alias("t")).filter("size(t) >= 5")
    g = t.select("id", F.explode(F.expr("transform(sequence(1, size(t) - 4), i -> array_join(slice(t, i, 5), ' '))")).alias("g")).distinct()
    return g.select(F.col("id").alias("a"), "g").join(g.select(F.col("id").alias("b"), "g"), "g").filter("a < b").groupBy("a", "b").agg(F.count("*").alias("shared"))


@query(f"""WITH t AS (SELECT conv_id, turn, role, {TOKENS.format('text')} AS t FROM conversations), p AS (SELECT a.conv_id, a.turn, list_distinct(a.t) AS x, list_distinct(b.t) AS y FROM t a JOIN t b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1)
SELECT conv_id, turn, CASE WHEN len(list_distinct(list_concat(x, y))) = 0 THEN 0.0 ELSE round(len(list_intersect(x, y)) / len(list_distinct(list_concat(x, y))), 9) END::DOUBLE AS jaccard FROM p""")
def token_jaccard_pairs(spark, d):
    """Token Jaccard of neighbouring turns."""
    t = table(spark, d, "conversations").select("conv_id", "turn", T.token_set(F.col("text")).alias("t"))
    n = t.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("t").alias("u"))
    return t.join(n, ["conv_id", "turn"]).select("conv_id", "turn", F.round(T.jaccard(F.col("t"), F.col("u")), 9).alias("jaccard"))


@query()
def longest_common_runs(spark, d):
    """Longest run of common words of neighbouring turns; no short SQL says it."""
    t = table(spark, d, "conversations").select("conv_id", "turn", "text")
    n = t.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("next_text"))
    return quotes.longest_common_run(t.join(n, ["conv_id", "turn"]), "text", "next_text").select("conv_id", "turn", "run")


NAME_TOKENS = r"list_filter(string_split_regex(upper(strip_accents({})), '\s+'), lambda x: x <> '')"
_NAMES = f"a AS (SELECT p_partkey AS id, list_distinct({NAME_TOKENS.format('p_name')}) AS t FROM part), b AS (SELECT p_partkey AS id, list_distinct({NAME_TOKENS.format('p_type')}) AS t FROM part)"


@query(f"WITH {_NAMES} SELECT a.id AS a, count(*) AS n FROM a JOIN (SELECT DISTINCT t FROM b) b ON (list_has_all(a.t, b.t) OR list_has_all(b.t, a.t)) AND (len(a.t) = len(b.t) OR least(len(a.t), len(b.t)) >= 2) AND len(a.t) > 0 GROUP BY a.id")
def name_subset_pairs(spark, d):
    """How many kinds of part hold a part's name, or are held by it."""
    p = table(spark, d, "part")
    kinds = p.select(F.sort_array(T.name_tokens(F.col("p_type"))).alias("t")).distinct().select(F.concat_ws(" ", "t").alias("id"), "t").filter("size(t) > 0")
    return names.containing(names.with_tokens(p, "p_partkey", "p_name"), kinds).groupBy("a").agg(F.count("*").alias("n"))


@query(f"""WITH one AS (SELECT n_nationkey AS a, {NAME_TOKENS.format('n_name')}[1] AS token FROM nation WHERE len({NAME_TOKENS.format('n_name')}) = 1),
held AS (SELECT c_custkey AS b, unnest(list_distinct({NAME_TOKENS.format("c_name || ' ' || c_mktsegment")})) AS token FROM customer),
f AS (SELECT a, count(DISTINCT b) AS n, min(b) AS b FROM one JOIN held USING (token) GROUP BY a) SELECT a, b FROM f WHERE n = 1""")
def name_single_token_resolution(spark, d):
    """Nations whose one-word name is held by exactly one customer."""
    one = names.with_tokens(table(spark, d, "nation"), "n_nationkey", "n_name")
    held = table(spark, d, "customer").select("c_custkey", F.concat_ws(" ", "c_name", "c_mktsegment").alias("name"))
    return names.resolve_single_tokens(one, names.with_tokens(held, "c_custkey", "name"))


@query(f"""WITH t AS (SELECT n_nationkey AS id, list_distinct({NAME_TOKENS.format('n_name')}) AS t FROM nation) SELECT a.id AS a, b.id AS b FROM t a JOIN t b ON a.id < b.id AND len(a.t) > 0 AND len(b.t) > 0 AND (list_has_all(a.t, b.t) OR list_has_all(b.t, a.t))""")
def ambiguous_names(spark, d):
    return names.ambiguous_pairs(names.with_tokens(table(spark, d, "nation"), "n_nationkey", "n_name"))


_HEADERS = "SELECT c_custkey, c_name, c_mktsegment, CASE c_custkey % 4 WHEN 0 THEN c_name || '. ' || c_mktsegment || '/SP' WHEN 1 THEN c_mktsegment || ' - SP' WHEN 2 THEN c_name || '. Dr' END AS info FROM customer"


@query(f"""WITH t AS ({_HEADERS}) SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN 'PRESIDENTE|' || c_name WHEN 2 THEN 'PRESIDENTE|' || info ELSE 'PRESIDENTE' END AS names,
CASE c_custkey % 4 WHEN 0 THEN c_mktsegment || '/SP' WHEN 1 THEN info END AS party FROM t""")
def turn_names(spark, d):
    """The names that a chair's header may stand for, and its party, by the parenthesis behind it."""
    kind, name, segment_ = F.col("c_custkey") % 4, F.col("c_name"), F.col("c_mktsegment")
    info = F.when(kind == 0, F.concat(name, F.lit(". "), segment_, F.lit("/SP"))).when(kind == 1, F.concat(segment_, F.lit(" - SP"))).when(kind == 2, F.concat(name, F.lit(". Dr")))
    t = table(spark, d, "customer").select("c_custkey", F.lit("PRESIDENTE").alias("raw_name"), info.alias("info"))
    raw, note = F.col("raw_name"), F.col("info")
    return t.select("c_custkey", F.array_join(speech.turn_name_candidates(raw, note), "|").alias("names"), speech.turn_party(raw, note).alias("party"))


@query(r"""WITH h AS (SELECT s_suppkey, s_nationkey AS hearing, upper(s_name) AS name FROM supplier),
t AS (SELECT s_suppkey AS turn, hearing, name || ' ' || hearing AS speaker FROM h)
SELECT h.hearing, h.s_suppkey AS person, t.turn FROM h JOIN t ON h.hearing = t.hearing AND list_contains(string_split_regex(t.speaker, '\s+'), h.name)""")
def people_turns(spark, d):
    """Turns of people by name: one-part names go to the only speaker who holds the part."""
    s = table(spark, d, "supplier").select(F.col("s_nationkey").alias("hearing"), "s_suppkey", F.col("s_name").alias("name"))
    people = s.select("hearing", F.col("s_suppkey").alias("person"), "name")
    turns = s.select("hearing", F.col("s_suppkey").alias("turn"), F.concat_ws(" ", "name", F.col("hearing").cast("string")).alias("raw_name"), F.lit(None).cast("string").alias("info"))
    return names.resolve_people(people, turns)


@query("""WITH h AS (SELECT doc_id, text, substr(text, 1, 480) AS h FROM documents), b AS (SELECT *, length(h) - length(regexp_extract(h, '[^ ]*$')) - 1 AS b FROM h)
SELECT doc_id, md5(CASE WHEN length(text) <= 480 THEN text ELSE rtrim(CASE WHEN b > 240 THEN substr(h, 1, b) ELSE h END, ' ,;:') || ' […]' END) AS passage_md5 FROM b""")
def trimmed_passages(spark, d):
    return table(spark, d, "documents").select("doc_id", F.md5(T.trim_passage(F.col("text"))).alias("passage_md5"))


# dense retrieval: the stated queries are the vectors whose id is divisible by 50
_DENSE = """s AS (SELECT q.vec_id AS query, q.label AS label, u.vec_id AS unit, u.label AS unit_label,
  list_sum(list_transform(list_zip(q.embedding, u.embedding), lambda x: x[1]::DOUBLE * x[2]::DOUBLE)) AS cosine
  FROM embeddings q JOIN embeddings u ON q.vec_id <> u.vec_id WHERE q.vec_id % 50 = 0)"""


def _dense(spark, d):
    e = table(spark, d, "embeddings")
    scores = retrieval.dense_scores(e.filter("vec_id % 50 = 0"), e, "vec_id", "vec_id", "embedding")
    labels = e.select("vec_id", "label")
    return scores.join(labels.select(F.col("vec_id").alias("query"), "label"), "query").join(labels.select(F.col("vec_id").alias("unit"), F.col("label").alias("unit_label")), "unit")


@query(f"WITH {_DENSE} SELECT query, unit, round(cosine, 6) AS cosine FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY cosine DESC, unit) AS k FROM s) WHERE k = 1")
def cosine_argmax(spark, d):
    best = retrieval.ranked(_dense(spark, d), "query", "unit", "cosine").filter("rank = 1")
    return best.select("query", "unit", F.round("cosine", 6).alias("cosine"))


@query(f"WITH {_DENSE} SELECT query, unit, k::INTEGER AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY cosine DESC, unit) AS k FROM s) WHERE k <= 8")
def cosine_topk(spark, d):
    return retrieval.ranked(_dense(spark, d), "query", "unit", "cosine").filter("rank <= 8").select("query", "unit", "rank")


@query(f"""WITH {_DENSE}, k AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY cosine DESC) AS k FROM s)
SELECT query, round(max(cosine) FILTER (WHERE k = 1) - max(cosine) FILTER (WHERE k = 2), 6) AS margin, round((max(cosine) - avg(cosine)) / stddev_pop(cosine), 6) AS zscore, count(*) AS n_units FROM k GROUP BY query""")
def cosine_margin_zscore(spark, d):
    s = retrieval.ranking_signals(_dense(spark, d), "query", "cosine")
    return s.select("query", F.round("margin", 6).alias("margin"), F.round("zscore", 6).alias("zscore"), "n_units")


@query(f"""WITH {_DENSE}, b AS (SELECT query, max(cosine) AS best FROM s WHERE label = unit_label GROUP BY query)
SELECT query, (1 + count(*) FILTER (WHERE cosine > best))::BIGINT AS rank_optimistic, count(*) FILTER (WHERE cosine >= best) AS rank_pessimistic, count(*) AS n_units FROM s JOIN b USING (query) GROUP BY query""")
def rank_tie_bounds(spark, d):
    return retrieval.rank_bounds(_dense(spark, d), "query", "cosine", F.col("label") == F.col("unit_label"))


@query(f"""WITH {_DENSE}, r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY cosine DESC, unit) AS k FROM s), f AS (SELECT query, label, min(k) AS rank FROM r WHERE label = unit_label GROUP BY ALL)
SELECT label, count(*) AS n, round(avg((rank = 1)::INTEGER), 9) AS acc1, round(avg((rank <= 5)::INTEGER), 9) AS acc5, round(avg(1 / rank), 9) AS mrr FROM f GROUP BY label""")
def class_retrieval_acc_mrr(spark, d):
    r = retrieval.ranked(_dense(spark, d), "query", "unit", "cosine").filter("label = unit_label").groupBy("query", "label").agg(F.min("rank").alias("rank"))
    at = lambda k: F.round(F.avg((F.col("rank") <= k).cast("int")), 9)
    return r.groupBy("label").agg(F.count("*").alias("n"), at(1).alias("acc1"), at(5).alias("acc5"), F.round(F.avg(1 / F.col("rank")), 9).alias("mrr"))


_TFIDF = f"""tf AS (SELECT id, term, count(*) AS tf FROM (SELECT item_id AS id, unnest({TOKENS.format('text')}) AS term FROM benchmark) GROUP BY ALL),
n AS (SELECT count(*) AS n FROM benchmark), w AS (SELECT id, tf.term, tf * (ln((1 + n) / (1 + df)) + 1) AS w FROM tf JOIN (SELECT term, count(*) AS df FROM tf GROUP BY term) USING (term), n),
u AS (SELECT id, term, w / sqrt(sum(w * w) OVER (PARTITION BY id)) AS w FROM w)"""


@query(f"WITH {_TFIDF} SELECT a.id AS a, b.id AS b, round(sum(a.w * b.w), 6) AS cosine FROM u a JOIN u b ON a.term = b.term AND a.id < b.id GROUP BY 1, 2")
def tfidf_cosine(spark, d):
    """TF-IDF cosine of all benchmark passages that share a word."""
    w = retrieval.tfidf(table(spark, d, "benchmark"), "item_id", "text")
    return retrieval.cosine_pairs(w, w).filter("a < b").select("a", "b", F.round("cosine", 6).alias("cosine"))


_BM25 = f"""docs AS (SELECT doc_id AS id, {TOKENS.format('text')} AS t FROM documents), tf AS (SELECT id, term, count(*) AS tf FROM (SELECT id, unnest(t) AS term FROM docs) GROUP BY ALL),
shape AS (SELECT count(*) AS n, avg(len(t)) AS ml FROM docs), i AS (SELECT term, ln((n - df + 0.5) / (df + 0.5)) AS idf FROM (SELECT term, count(*) AS df FROM tf GROUP BY term), shape),
m AS (SELECT avg(idf) AS mi FROM i), j AS (SELECT term, CASE WHEN idf < 0 THEN 0.25 * mi ELSE idf END AS idf FROM i, m),
q AS (SELECT query, term, count(*) AS qtf FROM (SELECT item_id AS query, unnest({TOKENS.format('text')}) AS term FROM benchmark) GROUP BY ALL),
b AS (SELECT query, id, sum(qtf * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len(t) / ml))) AS score FROM q JOIN j USING (term) JOIN tf USING (term) JOIN docs USING (id), shape GROUP BY ALL)"""


def _bm25(spark, d):
    return retrieval.bm25(table(spark, d, "benchmark"), "item_id", "text", table(spark, d, "documents"), "doc_id", "text")


@query(f"WITH {_BM25}, r AS (SELECT *, round(score, 6) AS s FROM b) SELECT query, id, s AS score, k::INTEGER AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY s DESC, id) AS k FROM r) WHERE k <= 10")
def bm25_rank(spark, d):
    s = _bm25(spark, d).withColumn("score", F.round("score", 6))
    return retrieval.ranked(s, "query", "id", "score").filter("rank <= 10")


@query(f"""WITH {_BM25}, ov AS (SELECT query, id, count(*) AS c FROM q JOIN tf USING (term) GROUP BY ALL),
r1 AS (SELECT query, id, row_number() OVER (PARTITION BY query ORDER BY round(score, 6) DESC, id) AS k FROM b), r2 AS (SELECT query, id, row_number() OVER (PARTITION BY query ORDER BY c DESC, id) AS k FROM ov),
f AS (SELECT query, id, round(sum(1 / (60 + k)), 9) AS s FROM (SELECT * FROM r1 UNION ALL SELECT * FROM r2) GROUP BY ALL)
SELECT query, id, s AS score, k::INTEGER AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY s DESC, id) AS k FROM f) WHERE k <= 10""")
def rrf_fusion(spark, d):
    """BM25 and word overlap, fused by reciprocal ranks."""
    s = _bm25(spark, d).withColumn("score", F.round("score", 6))
    q = table(spark, d, "benchmark").select(F.col("item_id").alias("query"), F.explode(T.token_set(F.col("text"))).alias("term"))
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.explode(T.token_set(F.col("text"))).alias("term"))
    overlap = q.join(docs, "term").groupBy("query", "id").agg(F.count("*").alias("score"))
    both = [retrieval.ranked(x, "query", "id", "score") for x in (s, overlap)]
    fused = retrieval.reciprocal_rank_fusion(both, "query", "id").drop("rank").withColumn("score", F.round("score", 9))
    return retrieval.ranked(fused, "query", "id", "score").filter("rank <= 10")


_TIERS = f"""WITH {_PREFIX}, b1 AS (SELECT id, max(words) AS words FROM found GROUP BY id), x AS (SELECT item_id AS id, list_distinct({TOKENS.format('text')}) AS q FROM benchmark),
y AS (SELECT doc_id, list_distinct({TOKENS.format('text')}) AS t FROM documents),
sc AS (SELECT id, max(round(len(list_intersect(q, t)) / len(list_distinct(list_concat(q, t))), 9)) AS score FROM x, y GROUP BY id)
SELECT x.id, CASE WHEN x.id % 11 = 0 THEN 'person_not_resolved' WHEN coalesce(words, 0) >= 6 THEN 'quote' WHEN score IS NULL THEN 'no_evidence' WHEN score >= 0.05 THEN 'semantic_high' ELSE 'semantic_weak' END AS tier FROM x LEFT JOIN b1 USING (id) LEFT JOIN sc USING (id)"""


def _tiers(spark, d):
    b = table(spark, d, "benchmark")
    words = _found(spark, d).groupBy("id").agg(F.max("words").alias("words"))
    score = E.best_overlap(b, "item_id", "text", table(spark, d, "documents"), "text").withColumn("score", F.round("score", 9))
    rows = b.select(F.col("item_id").alias("id")).join(words, "id", "left").join(score, "id", "left")
    return rows.select("id", E.tier(F.col("id") % 11 != 0, F.col("score").isNotNull(), F.col("words"), F.col("score"), 0.05).alias("tier"))


@query(_TIERS)
def evidence_tiers(spark, d):
    """Each passage's tier: a trusted prefix in any document, else its best word overlap with one."""
    return _tiers(spark, d)


@query(f"SELECT v AS tier, count(t.id) AS n FROM (VALUES ('quote'), ('semantic_high'), ('semantic_weak'), ('no_evidence'), ('person_not_resolved')) x(v) LEFT JOIN ({_TIERS}) t ON t.tier = v GROUP BY v")
def evidence_coverage(spark, d):
    return E.domain_counts(_tiers(spark, d), "tier", E.TIERS)


@query("""SELECT doc_id, CASE WHEN b.n2 IS NULL THEN 'missing' WHEN a.n_chars IS NULL THEN 'extra' ELSE 'changed' END AS state
FROM (SELECT doc_id, lang, n_chars FROM documents) a
FULL JOIN (SELECT CASE WHEN doc_id % 9 = 0 THEN -1 - doc_id ELSE doc_id END AS doc_id, CASE WHEN doc_id % 5 <> 0 THEN lang END AS lang2, n_chars AS n2 FROM documents) b USING (doc_id)
WHERE lang IS DISTINCT FROM lang2 OR n_chars IS DISTINCT FROM n2""")
def evidence_run_diff(spark, d):
    """Rows missing, extra or changed between the documents and a run of all of them, with some renamed and some changed."""
    docs = table(spark, d, "documents").select("doc_id", "lang", "n_chars")
    new = docs.withColumn("lang", F.when(F.col("doc_id") % 5 != 0, F.col("lang")))
    new = new.withColumn("doc_id", F.when(F.col("doc_id") % 9 == 0, -1 - F.col("doc_id")).otherwise(F.col("doc_id")))
    return E.run_diff(docs, new, "doc_id", ["lang", "n_chars"])


@query(f"""WITH s AS ({ROWS}), x AS (SELECT doc_id, position, sentence, coalesce(sum(length(sentence) + 1) OVER (PARTITION BY doc_id ORDER BY position ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM s),
j AS (SELECT doc_id, string_agg(sentence, ' ' ORDER BY position) AS whole FROM s GROUP BY doc_id) SELECT lang, count(*) AS n, count(*) FILTER (WHERE substr(whole, start::BIGINT + 1, length(sentence)) <> sentence) AS n_wrong FROM x JOIN j USING (doc_id) JOIN documents USING (doc_id) GROUP BY lang""")
def evidence_problems(spark, d):
    """Offsets of sentences in the joined text, held against its slices."""
    from ..operators import integrity

    s = segment.joined_segments(_sentences(spark, d), ["doc_id"], "position", "sentence")
    whole = s.groupBy("doc_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("position", "sentence"))), lambda x: x["sentence"]), " ").alias("whole"))
    rows = s.join(whole, "doc_id").withColumn("end", F.col("start") + F.length("sentence"))
    wrong = integrity.wrong_slices(rows, "whole", "start", "end", "sentence").groupBy("lang").agg(F.count("*").alias("n_wrong"))
    return rows.groupBy("lang").agg(F.count("*").alias("n")).join(wrong, "lang", "left").select("lang", "n", F.coalesce("n_wrong", F.lit(0)).alias("n_wrong"))


@query("SELECT doc_id, sha256(lang || chr(31) || source) AS digest, regexp_replace(regexp_replace(lower(strip_accents(source || ' ' || lang)), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') AS slug, CASE WHEN regexp_matches(substr(text, 1, 1), '^\\p{Lu}') THEN 'upper' WHEN regexp_matches(substr(text, 1, 1), '^\\p{Ll}') THEN 'lower' ELSE 'other' END AS kind FROM documents")
def scalar_keys(spark, d):
    c = F.col
    docs = table(spark, d, "documents")
    return docs.select("doc_id", T.pair_digest(c("lang"), c("source")).alias("digest"), T.actor_slug(F.concat_ws(" ", "source", "lang")).alias("slug"), T.character_class(c("text")).alias("kind"))


@query("SELECT vec_id, round(1 - (1 - abs(embedding[1]::DOUBLE)) * (1 - abs(embedding[2]::DOUBLE)) * (1 - abs(embedding[3]::DOUBLE)), 6)::DOUBLE AS noisy_or, round(exp(embedding[1]::DOUBLE) / (exp(embedding[1]::DOUBLE) + exp(embedding[2]::DOUBLE) + exp(embedding[3]::DOUBLE)), 6) AS p1 FROM embeddings")
def pool_values_noisy_or(spark, d):
    e = table(spark, d, "embeddings").select("vec_id", F.expr("transform(slice(embedding, 1, 3), x -> cast(x as double))").alias("v"))
    return e.select("vec_id", F.round(S.noisy_or(F.transform("v", lambda x: F.abs(x))), 6).alias("noisy_or"), F.round(S.softmax(F.col("v"))[0], 6).alias("p1"))


@query("SELECT source, lang, n FROM (SELECT source, lang, n, row_number() OVER (PARTITION BY source ORDER BY n DESC, lang) AS k FROM (SELECT source, lang, count(*) AS n FROM documents GROUP BY ALL)) WHERE k = 1")
def source_majority_language(spark, d):
    from ..operators import actors

    return actors.majority(table(spark, d, "documents"), "source", "lang").select("source", "lang", "n")


@query("SELECT page_id, md5(trim(regexp_replace(regexp_replace(html, '<[^>]*>', ' ', 'g'), '\\s+', ' ', 'g'))) AS text_md5 FROM pages")
def page_text_normalised(spark, d):
    return table(spark, d, "pages").select("page_id", F.md5(T.normalize_whitespace(F.regexp_replace("html", "<[^>]*>", " "))).alias("text_md5"))


