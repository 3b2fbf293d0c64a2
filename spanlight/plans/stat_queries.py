"""Queries on scores, labels, dates, speakers and samples."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import stats as S
from ..operators import actors, evaluation, integrity, resampling, splits
from .registry import query, table

# Scored rows: a document's length against its labels, by language.
_SCORED = "s AS (SELECT d.doc_id, lang, source, round(ln(1 + n_chars), 6) AS score, quality AS label, toxic FROM documents d JOIN labels l USING (doc_id))"
_CUTS = """c AS (SELECT {g} score, sum(label) AS pos, sum(1 - label) AS neg FROM s GROUP BY ALL),
k AS (SELECT *, sum(pos) OVER d AS tp, sum(neg) OVER d AS fp, sum(pos) OVER (PARTITION BY {p}) AS n_pos, sum(neg) OVER (PARTITION BY {p}) AS n_neg, lead(score) OVER (PARTITION BY {p} ORDER BY score DESC) AS nxt
  FROM c WINDOW d AS (PARTITION BY {p} ORDER BY score DESC ROWS UNBOUNDED PRECEDING))"""
_LANG = f"WITH {_SCORED}, " + _CUTS.format(g="lang,", p="lang")
_ALL = f"WITH {_SCORED}, " + _CUTS.format(g="", p="1")


def _scored(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "lang", "source", F.round(F.log(1 + F.col("n_chars")), 6).alias("score"))
    return docs.join(table(spark, d, "labels").select("doc_id", F.col("quality").alias("label"), "toxic"), "doc_id")


def _r(df, *columns, digits=9):
    for c in columns:
        df = df.withColumn(c, F.round(c, digits))
    return df


@query(_LANG + " SELECT lang, round(CASE WHEN max(n_pos) > 0 AND max(n_neg) > 0 THEN sum(neg * (tp - pos + 0.5 * pos)) / (max(n_pos) * max(n_neg)) END, 9) AS auc FROM k GROUP BY lang")
def roc_auc_by_group(spark, d):
    return _r(evaluation.roc_auc(_scored(spark, d), "score", "label", ["lang"]), "auc")


@query(_LANG + " SELECT lang, round(CASE WHEN max(n_pos) > 0 THEN sum(pos * tp / (tp + fp)) / max(n_pos) END, 9) AS ap FROM k GROUP BY lang")
def average_precision(spark, d):
    return _r(evaluation.average_precision(_scored(spark, d), "score", "label", ["lang"]), "ap")


@query(_LANG + """ , b AS (SELECT *, pos + neg AS m, tp + fp - pos - neg AS n0, fp - neg AS e0 FROM k),
e AS (SELECT lang, (e0 + neg * i / m) / (n0 + i) AS risk FROM (SELECT *, unnest(range(1, (m + 1)::BIGINT)) AS i FROM b)) SELECT lang, round(avg(risk), 9) AS aurc FROM e GROUP BY lang""")
def aurc(spark, d):
    return _r(evaluation.aurc(_scored(spark, d), "score", "label", ["lang"]), "aurc")


@query(_ALL + " SELECT score, round((tp + fp) / (n_pos + n_neg), 9) AS coverage, round(fp / (tp + fp), 9) AS risk FROM k")
def risk_coverage_curve(spark, d):
    return _r(evaluation.risk_coverage(_scored(spark, d), "score", "label"), "coverage", "risk")


@query(_LANG + """ , j AS (SELECT *, round(tp / n_pos - fp / n_neg, 12) AS j FROM k WHERE n_pos > 0 AND n_neg > 0)
SELECT lang, round(j, 9) AS j, round(CASE WHEN nxt IS NULL THEN score ELSE (score + nxt) / 2 END, 9) AS threshold FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY j DESC, score) AS r FROM j) WHERE r = 1""")
def youden_cut(spark, d):
    return _r(evaluation.youden(_scored(spark, d), "score", "label", ["lang"]), "j", "threshold")


@query(f"WITH {_SCORED} SELECT round((quantile_cont(score, 0.25) FILTER (WHERE label = 1) + quantile_cont(score, 0.75) FILTER (WHERE label = 0)) / 2, 9) AS threshold FROM s")
def pair_threshold(spark, d):
    q = lambda y, p: F.percentile(F.when(F.col("label") == y, F.col("score")), F.lit(p))
    return _scored(spark, d).agg(F.round((q(1, 0.25) + q(0, 0.75)) / 2, 9).alias("threshold"))


@query(f"""WITH {_SCORED} SELECT cut::DOUBLE AS cut, count(*) FILTER (WHERE score >= cut) AS kept, round(count(*) FILTER (WHERE score >= cut) / count(*), 9) AS coverage,
round(sum(label) FILTER (WHERE score >= cut) / nullif(count(*) FILTER (WHERE score >= cut), 0), 9) AS precision, round(coalesce(sum(label) FILTER (WHERE score >= cut), 0) / sum(label), 9) AS tpr,
round(coalesce(sum(1 - label) FILTER (WHERE score >= cut), 0) / sum(1 - label), 9) AS fpr FROM s, (VALUES (5.0), (6.0), (7.0), (8.0), (99.0)) v(cut) GROUP BY cut""")
def operating_points(spark, d):
    return evaluation.operating_points(_scored(spark, d), "score", "label", [5.0, 6.0, 7.0, 8.0, 99.0])


@query(_ALL + " SELECT score, f1 FROM (SELECT score, round(2 * tp / (tp + fp + n_pos), 12) AS f1 FROM k) ORDER BY f1 DESC, score DESC LIMIT 1")
def max_f1_cut(spark, d):
    return evaluation.max_f1(_scored(spark, d), "score", "label")


_CONF = f"WITH {_SCORED}, m AS (SELECT lang, count(*) FILTER (WHERE label = 1 AND toxic = 1) AS a, count(*) FILTER (WHERE label = 1 AND toxic = 0) AS b, count(*) FILTER (WHERE label = 0 AND toxic = 1) AS c, count(*) FILTER (WHERE label = 0 AND toxic = 0) AS d FROM s GROUP BY lang)"


def _confusion(spark, d):
    return evaluation.confusion(_scored(spark, d), "label", "toxic", ["lang"])


@query(_CONF + " SELECT lang, a AS both, b AS only_a, c AS only_b, d AS neither FROM m")
def judge_confusion(spark, d):
    return _confusion(spark, d)


@query(_CONF + " , n AS (SELECT *, a + b + c + d AS n, ((a + b) * (a + c) + (c + d) * (b + d)) / ((a + b + c + d) * (a + b + c + d)) AS e FROM m) SELECT lang, round(CASE WHEN n = 0 OR e = 1 THEN NULL ELSE ((a + d) / n - e) / (1 - e) END, 9) AS kappa FROM n")
def judge_kappa(spark, d):
    k = S.kappa(*(F.col(c) for c in ("both", "only_a", "only_b", "neither")))
    return _confusion(spark, d).select("lang", F.round(k, 9).alias("kappa"))


@query(_CONF + " SELECT lang, round(a / nullif(a + c, 0), 9) AS precision, round(a / nullif(a + b, 0), 9) AS recall, round(2 * a / nullif(2 * a + b + c, 0), 9) AS f1, a + b AS support FROM m")
def judge_prf(spark, d):
    ratio = lambda x, y: F.when(y > 0, F.round(x / y, 9))
    a, b, c = (F.col(x) for x in ("both", "only_a", "only_b"))
    return _confusion(spark, d).select("lang", ratio(a, a + c).alias("precision"), ratio(a, a + b).alias("recall"), ratio(2 * a, 2 * a + b + c).alias("f1"), (a + b).alias("support"))


@query(_CONF + """ , x AS (SELECT lang, b + c AS n, least(b, c) AS k FROM m),
t AS (SELECT lang, n, sum(exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) - n * ln(2))) AS tail FROM (SELECT *, unnest(range(0, k + 1)) AS i FROM x) GROUP BY ALL) SELECT lang, round(CASE WHEN n = 0 THEN 1.0 ELSE least(1.0, 2 * tail) END, 6) AS p FROM t""")
def mcnemar(spark, d):
    return _confusion(spark, d).select("lang", F.round(evaluation.mcnemar_exact(F.col("only_a"), F.col("only_b")), 6).alias("p"))


@query(_CONF.replace("FROM s GROUP BY lang", "FROM s GROUP BY lang") + """ , p AS (SELECT lang, round(1 / (1 + a + b), 9) AS p FROM m), r AS (SELECT *, row_number() OVER (ORDER BY p, lang) AS k, count(*) OVER () AS n FROM p)
SELECT lang, p, round(max(least(1.0, (n - k + 1) * p)) OVER (ORDER BY p, lang ROWS UNBOUNDED PRECEDING), 9) AS p_holm FROM r""")
def holm_adjust(spark, d):
    rows = _confusion(spark, d).select("lang", F.round(1 / (1 + F.col("both") + F.col("only_a")), 9).alias("p"))
    return _r(evaluation.holm(rows, "p", [], "lang"), "p_holm")


@query(f"""WITH {_SCORED}, g AS (SELECT source, count(*) AS n, sum(label) AS x FROM s GROUP BY source), w AS (SELECT *, x / n AS p, 1.959963984540054 AS z FROM g)
SELECT source, n, round((p + z * z / (2 * n) - z * sqrt(p * (1 - p) / n + z * z / (4 * n * n))) / (1 + z * z / n), 9) AS low, round((p + z * z / (2 * n) + z * sqrt(p * (1 - p) / n + z * z / (4 * n * n))) / (1 + z * z / n), 9) AS high FROM w""")
def wilson_by_group(spark, d):
    g = _scored(spark, d).groupBy("source").agg(F.count("*").alias("n"), F.sum("label").alias("x")).withColumn("w", S.wilson(F.col("x"), F.col("n")))
    return g.select("source", "n", F.round("w.low", 9).alias("low"), F.round("w.high", 9).alias("high"))


@query("""WITH n AS (SELECT lang, count(*)::DOUBLE AS n FROM documents GROUP BY lang), m AS (SELECT lang, count(*)::DOUBLE AS m, sum(quality)::DOUBLE AS x FROM documents JOIN labels USING (doc_id) GROUP BY lang)
SELECT round(sum(n * x / m) / sum(n), 9) AS share, round(sqrt(sum(CASE WHEN m >= n OR m < 2 THEN 0 ELSE n * n * (1 - m / n) * (x / m) * (1 - x / m) / (m - 1) END)) / sum(n), 9) AS se FROM n JOIN m USING (lang)""")
def stratified_estimate(spark, d):
    """The share of good documents, by language strata of which only some are labelled."""
    n = table(spark, d, "documents").groupBy("lang").agg(F.count("*").alias("n"))
    m = _scored(spark, d).groupBy("lang").agg(F.count("*").alias("m"), F.sum("label").alias("x"))
    return _r(evaluation.stratified_estimate(n.join(m, "lang"), "n", "m", "x"), "share", "se")


@query(f"WITH {_SCORED}, r AS (SELECT score, row_number() OVER (ORDER BY score) AS k, count(*) OVER () AS n FROM s WHERE label = 1) SELECT max(score) FILTER (WHERE k = floor(0.1 * (n + 1))) AS threshold FROM r")
def conformal_cut(spark, d):
    return evaluation.conformal_threshold(_scored(spark, d), "score", "label", 0.1)


@query("""WITH r AS (SELECT event_type, rank() OVER (PARTITION BY event_type ORDER BY value) + (count(*) OVER (PARTITION BY event_type, value) - 1) / 2 AS a,
rank() OVER (PARTITION BY event_type ORDER BY user_id) + (count(*) OVER (PARTITION BY event_type, user_id) - 1) / 2 AS b FROM events) SELECT event_type, round(corr(a, b), 6) AS rho, count(*) AS n FROM r GROUP BY event_type""")
def spearman_corr(spark, d):
    return _r(evaluation.spearman(table(spark, d, "events"), "value", "user_id", ["event_type"]), "rho", digits=6)


# dates and splits
_DAYS = """p AS (SELECT o_orderdate::DATE AS day, count(*) AS n FROM orders GROUP BY 1), c AS (SELECT day, n, sum(n) OVER (ORDER BY day) AS upto, lead(day) OVER (ORDER BY day) AS next_day, sum(n) OVER () AS total FROM p),
k AS (SELECT day, n, upto::BIGINT AS upto, upto / total AS fraction, next_day, (next_day - day)::INTEGER AS gap_days FROM c)"""


def _orders(spark, d):
    return table(spark, d, "orders").withColumn("day", F.col("o_orderdate").cast("date"))


@query(f"WITH {_DAYS} SELECT strftime(day, '%Y-%m-%d') AS day, n, upto, round(fraction, 9) AS fraction, coalesce(gap_days, -1) AS gap_days FROM k")
def temporal_cut_candidates(spark, d):
    c = splits.cut_candidates(_orders(spark, d), "day")
    return c.select(F.date_format("day", "yyyy-MM-dd").alias("day"), "n", "upto", F.round("fraction", 9).alias("fraction"), F.coalesce("gap_days", F.lit(-1)).alias("gap_days"))


_ASSIGN = f"""WITH {_DAYS}, t AS (SELECT day AS td FROM k WHERE gap_days >= 1 ORDER BY round(abs(fraction - 0.7), 12), gap_days DESC, day LIMIT 1), v AS (SELECT day AS vd FROM k WHERE gap_days >= 1 ORDER BY round(abs(fraction - 0.8), 12), gap_days DESC, day LIMIT 1),
a AS (SELECT o_orderkey, o_custkey, o_orderdate::DATE AS day, CASE WHEN o_orderdate::DATE <= td THEN 'train' WHEN o_orderdate::DATE <= vd THEN 'validation' ELSE 'test' END AS split FROM orders, t, v)"""


def _assigned(spark, d):
    rows = _orders(spark, d)
    c = splits.cut_candidates(rows, "day")
    return splits.assign(rows, "day", splits.choose_cut(c, 0.7), splits.choose_cut(c, 0.8))


@query(_ASSIGN + " SELECT o_orderkey, split FROM a")
def temporal_split_assign(spark, d):
    return _assigned(spark, d).select("o_orderkey", "split")


@query(_ASSIGN + " , q AS (SELECT split, day, count(*) AS n FROM a GROUP BY ALL) SELECT split, strftime(min(day), '%Y-%m-%d') AS first_day, strftime(max(day), '%Y-%m-%d') AS last_day, count(*) AS days, max(n) AS max_per_day, sum(n)::BIGINT AS n FROM q GROUP BY split")
def split_calendar(spark, d):
    c = splits.calendar(_assigned(spark, d), "day", ["split"])
    return c.withColumn("first_day", F.date_format("first_day", "yyyy-MM-dd")).withColumn("last_day", F.date_format("last_day", "yyyy-MM-dd"))


@query(_ASSIGN + " SELECT splits, count(*) AS n FROM (SELECT o_custkey, string_agg(DISTINCT split, '+' ORDER BY split) AS splits FROM a GROUP BY o_custkey) GROUP BY splits")
def split_actor_overlap(spark, d):
    return splits.key_overlap(_assigned(spark, d), "o_custkey", "split")


@query(_ASSIGN + " SELECT strftime(day, '%Y-%m-%d') AS day, count(DISTINCT split) AS n_splits FROM a GROUP BY a.day HAVING count(DISTINCT split) > 1")
def split_straddle_check(spark, d):
    return splits.straddling_days(_assigned(spark, d), "day", "split").select(F.date_format("day", "yyyy-MM-dd").alias("day"), "n_splits")


@query("SELECT o_orderkey, strftime(o_orderdate, '%d/%m/%Y - %H:%M') AS stamp, (isodow(o_orderdate) = 1 + o_orderkey % 7) AS agrees, strftime(o_orderdate::DATE - 3, '%Y-%m-%d') AS mentioned FROM orders")
def weekday_mention_check(spark, d):
    """Each order's date printed, parsed back, held against a weekday; and the latest date with the day of three days before."""
    o = table(spark, d, "orders").select("o_orderkey", F.date_format("o_orderdate", "dd/MM/yyyy - HH:mm").alias("stamp"))
    date = F.to_date(F.substring("stamp", 1, 10), "dd/MM/yyyy")
    name = F.get(F.array(*map(F.lit, splits.WEEKDAYS)), (F.col("o_orderkey") % 7).cast("int"))
    mentioned = splits.mention_date(date, F.dayofmonth(F.date_sub(date, 3)))
    return o.select("o_orderkey", "stamp", splits.weekday_agrees(date, name).alias("agrees"), F.date_format(mentioned, "yyyy-MM-dd").alias("mentioned"))


# speakers
_W = r"len(list_filter(string_split_regex(text, '\s+'), lambda x: x <> ''))"


@query(f"SELECT conv_id, role, sum({_W})::BIGINT AS words, count(*) AS turns FROM conversations GROUP BY ALL")
def actor_speeches(spark, d):
    return actors.words_by(table(spark, d, "conversations"), ["conv_id", "role"], "text")


@query(f"SELECT role, sum({_W})::BIGINT AS words, count(*) AS turns, round(sum({_W}) / (SELECT sum({_W}) FROM conversations), 9) AS share FROM conversations GROUP BY role")
def role_word_shares(spark, d):
    return _r(actors.shares(actors.words_by(table(spark, d, "conversations"), ["role"], "text"), "words"), "share")


@query(f"SELECT cut, count(*) FILTER (WHERE w >= cut) AS kept, coalesce(sum(w) FILTER (WHERE w >= cut), 0)::BIGINT AS total FROM (SELECT {_W} AS w FROM conversations WHERE role = 'system'), (VALUES (0), (5), (10), (20)) v(cut) GROUP BY cut")
def chair_cut_sweep(spark, d):
    """Chair turns left, and their words, at several least lengths."""
    turns = actors.drop_reason(table(spark, d, "conversations").filter("role = 'system'"), "role", "text", "system")
    return actors.cut_sweep(turns, "n_words", [0, 5, 10, 20])


@query(f"SELECT role, CASE WHEN {_W} = 0 THEN 'empty' WHEN regexp_matches(trim(text), '^(\\([^()]*\\)\\s*)+$') THEN 'stage_direction' WHEN role = 'system' AND {_W} < 10 THEN 'short_chair' ELSE 'kept' END AS reason, count(*) AS n FROM conversations GROUP BY ALL")
def drop_reason_counts(spark, d):
    turns = actors.drop_reason(table(spark, d, "conversations"), "role", "text", "system")
    return turns.groupBy("role", F.coalesce("reason", F.lit("kept")).alias("reason")).agg(F.count("*").alias("n"))


@query("WITH g AS (SELECT user_id, count(DISTINCT event_type) AS groups FROM events GROUP BY user_id), h AS (SELECT groups, count(*) AS keys FROM g GROUP BY groups) SELECT groups, keys, (sum(keys) OVER (ORDER BY groups DESC))::BIGINT AS keys_at_least FROM h")
def actor_hearing_histogram(spark, d):
    return actors.at_least(actors.group_histogram(table(spark, d, "events"), "user_id", "event_type"))


@query("SELECT user_id, event_type, n FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY n DESC, event_type) AS k FROM (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY ALL)) WHERE k = 1")
def actor_majority_link(spark, d):
    return actors.majority(table(spark, d, "events"), "user_id", "event_type").select("user_id", "event_type", "n")


@query("SELECT lang, count(*) AS n, min(n_chars)::DOUBLE AS low, quantile_cont(n_chars::DOUBLE, 0.25) AS q25, quantile_cont(n_chars::DOUBLE, 0.5) AS median, quantile_cont(n_chars::DOUBLE, 0.75) AS q75, max(n_chars)::DOUBLE AS high, round(avg(n_chars), 6) AS mean FROM documents GROUP BY lang")
def length_distribution(spark, d):
    return _r(actors.distribution(table(spark, d, "documents"), "n_chars", ["lang"]), "mean", digits=6)


@query("WITH r AS (SELECT n_chars AS v, row_number() OVER (ORDER BY n_chars) - 1 AS k, count(*) OVER () AS n FROM documents) SELECT q::DOUBLE AS q, min(v) FILTER (WHERE k = least(floor(n * q::DOUBLE), n - 1)) AS value FROM r, (VALUES (0.1), (0.5), (0.9), (1.0)) x(q) GROUP BY q")
def lower_quantiles(spark, d):
    return actors.lower_quantile(table(spark, d, "documents"), "n_chars", [0.1, 0.5, 0.9, 1.0])


@query("SELECT floor(value / 25)::BIGINT AS bin, count(*) AS n FROM events WHERE value IS NOT NULL GROUP BY 1")
def score_histogram(spark, d):
    return actors.fixed_histogram(table(spark, d, "events"), "value", 25)


@query("SELECT CASE WHEN grouping(lang) = 1 THEN 'all' ELSE lang END AS lang, count(*) AS n, sum(n_chars)::BIGINT AS chars FROM documents GROUP BY CUBE (lang)")
def grouped_summaries(spark, d):
    return actors.with_all(table(spark, d, "documents"), "lang", [F.count("*").alias("n"), F.sum("n_chars").alias("chars")])


@query("SELECT o_orderpriority, count(*) FILTER (WHERE o_orderstatus = 'F') AS f, count(*) FILTER (WHERE o_orderstatus = 'O') AS o, count(*) FILTER (WHERE o_orderstatus = 'P') AS p FROM orders GROUP BY o_orderpriority")
def split_tier_counts(spark, d):
    """A contingency table."""
    one = lambda s: F.sum((F.col("o_orderstatus") == s).cast("bigint"))
    return table(spark, d, "orders").groupBy("o_orderpriority").agg(one("F").alias("f"), one("O").alias("o"), one("P").alias("p"))


# resampling
_DRAW = "(('0x' || substr(md5({t}), 1, 8))::BIGINT % {of})"
_BOOT = f"""c AS (SELECT source, sum(n_chars)::DOUBLE AS s, count(*) AS n, row_number() OVER (ORDER BY source) - 1 AS k FROM documents GROUP BY source), m AS (SELECT count(*) AS m FROM c),
d AS (SELECT r, {_DRAW.format(t="'42|' || r || '|' || i", of="m")} AS k FROM m, range(0, 200) x(r), range(0, (SELECT m FROM m)) y(i)), b AS (SELECT r, sum(s) / sum(n) AS mean FROM d JOIN c USING (k) GROUP BY r)"""


@query(f"WITH {_BOOT} SELECT round(quantile_cont(mean, 0.025), 6) AS low, round(quantile_cont(mean, 0.5), 6) AS median, round(quantile_cont(mean, 0.975), 6) AS high, round(stddev_samp(mean), 6) AS std, count(*) AS n FROM b")
def cluster_bootstrap_mean(spark, d):
    reps = resampling.cluster_bootstrap(table(spark, d, "documents"), "source", "n_chars")
    return _r(resampling.interval(reps), "low", "median", "high", "std", digits=6)


@query(f"""WITH c AS (SELECT source, sum(quality - toxic)::DOUBLE AS s, count(*) AS n, row_number() OVER (ORDER BY source) - 1 AS k FROM documents JOIN labels USING (doc_id) GROUP BY source), o AS (SELECT sum(s) / sum(n) AS o FROM c),
f AS (SELECT r, sum((1 - 2 * {_DRAW.format(t="'7|' || r || '|' || k", of="2")}) * s) / sum(n) AS mean FROM c, range(0, 200) x(r) GROUP BY r) SELECT round(o, 9) AS observed, round((count(*) FILTER (WHERE abs(mean) >= abs(o) - 1e-12) + 1) / 201, 9) AS p FROM f, o GROUP BY o""")
def sign_flip(spark, d):
    diff = _scored(spark, d).withColumn("diff", F.col("label") - F.col("toxic"))
    return _r(resampling.sign_flip(diff, "source", "diff"), "observed", "p")


@query("SELECT doc_id, lang, k::INTEGER AS draw FROM (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY md5('42|' || doc_id), doc_id) AS k FROM documents) WHERE k <= 25")
def stratified_sample(spark, d):
    return resampling.stratified_sample(table(spark, d, "documents"), "doc_id", "lang", 25).select("doc_id", "lang", "draw")


@query(f"""WITH p AS (SELECT vec_id, label, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS k, count(*) OVER (PARTITION BY label) AS m FROM embeddings),
w AS (SELECT vec_id AS key, label, (k + 1 + {_DRAW.format(t="'11|' || vec_id", of="greatest(m - 1, 1)")}) % m AS k FROM p WHERE m > 1) SELECT key, p.vec_id AS negative FROM w JOIN p ON p.label = w.label AND p.k = w.k""")
def hard_negatives(spark, d):
    return resampling.hard_negatives(table(spark, d, "embeddings"), "vec_id", "label")


@query("WITH g AS (SELECT source, ((row_number() OVER (ORDER BY md5('5|' || source)) - 1) % 4)::INTEGER AS fold FROM (SELECT DISTINCT source FROM documents)) SELECT fold, count(*) AS n, count(DISTINCT source) AS sources FROM documents JOIN g USING (source) GROUP BY fold")
def cv_folds(spark, d):
    f = resampling.grouped_folds(table(spark, d, "documents"), "source", 4)
    return f.groupBy("fold").agg(F.count("*").alias("n"), F.countDistinct("source").alias("sources"))


# integrity
@query("SELECT lang, source, count(*) AS n FROM documents GROUP BY ALL HAVING count(*) > 1")
def duplicate_keys(spark, d):
    return integrity.duplicates(table(spark, d, "documents"), ["lang", "source"])


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def unlabelled_documents(spark, d):
    return integrity.missing_keys(table(spark, d, "documents"), table(spark, d, "labels"), ["doc_id"])


@query("SELECT DISTINCT user_id AS c_custkey FROM events WHERE user_id IN (SELECT c_custkey FROM customer)")
def leak_check(spark, d):
    users = table(spark, d, "events").select(F.col("user_id").alias("c_custkey"))
    return integrity.leaks(users, "c_custkey", table(spark, d, "customer"))


@query("SELECT doc_id, c AS \"column\", t AS token FROM (SELECT doc_id, unnest(['text', 'source']) AS c, unnest([lower(text), lower(source)]) AS x FROM documents), (VALUES ('idiot'), ('license'), ('src1')) v(t) WHERE contains(x, t)")
def forbidden_token_hits(spark, d):
    return integrity.forbidden_tokens(table(spark, d, "documents"), "doc_id", ["text", "source"], ["idiot", "license", "src1"])


@query("SELECT lang, reported, recomputed FROM (SELECT lang, count(*) AS reported FROM documents GROUP BY lang) a FULL JOIN (SELECT lang, count(*) AS recomputed FROM (SELECT CASE WHEN doc_id % 3 = 0 THEN 'none' ELSE lang END AS lang FROM documents) GROUP BY lang) b USING (lang) WHERE reported IS DISTINCT FROM recomputed")
def counter_check(spark, d):
    docs = table(spark, d, "documents")
    other = docs.withColumn("lang", F.when(F.col("doc_id") % 3 == 0, "none").otherwise(F.col("lang")))
    one, two = (x.groupBy("lang").agg(F.count("*").alias("n")) for x in (docs, other))
    return integrity.counter_differences(one, two, "lang", "n")


@query("SELECT c_custkey, 'c_acctbal' AS \"column\" FROM customer WHERE c_custkey % 10 = 0")
def row_differences(spark, d):
    """Balances of every tenth customer, moved by more than the tolerance; the others by less."""
    a = table(spark, d, "customer").select("c_custkey", "c_name", "c_acctbal")
    b = a.withColumn("c_acctbal", F.col("c_acctbal") + F.when(F.col("c_custkey") % 10 == 0, 1.0).otherwise(1e-12))
    return integrity.value_differences(a, b, "c_custkey", ["c_name", "c_acctbal"], 1e-6)


@query("SELECT time_bucket(INTERVAL 1 DAY, ts) AS start, event_type, count(*) AS n FROM events GROUP BY ALL")
def windowed_event_counts(spark, d):
    from ..streaming import replay

    return replay.windowed_counts(table(spark, d, "events"), "ts", "event_type").withColumn("start", F.col("start").cast("timestamp_ntz"))
