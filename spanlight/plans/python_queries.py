"""Queries whose operators need Python, or a fit: no SQL says them; tests hold them against plain versions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import stats as S
from ..functions import text as T
from ..operators import fuzzy, learning, segment
from .registry import query, table


@query()
def fuzzy_alignment(spark, d):
    """Where a part's name is most like its type's and its brand's words, by letters."""
    p = table(spark, d, "part").withColumn("text", F.concat_ws(" ", "p_type", "p_brand"))
    return fuzzy.align(p, "p_name", "text").select("p_partkey", "alignment.*")


@query()
def best_word_alignment(spark, d):
    """Of each conversation: which sentence of a user is most like a turn of the assistant, by whole words."""
    c = table(spark, d, "conversations")
    said = lambda role: F.transform(F.sort_array(F.collect_list(F.when(F.col("role") == role, F.struct("turn", "text")))), lambda x: x["text"])
    both = c.groupBy("conv_id").agg(F.flatten(F.transform(said("user"), T.sentences)).alias("needles"), said("assistant").alias("texts"))
    return fuzzy.align_best(both, "needles", "texts", by_words=True).select("conv_id", "best.*")


@query()
def token_set_ratio(spark, d):
    """Name scores of part names and types."""
    return fuzzy.name_scores(table(spark, d, "part"), "p_name", "p_type").select("p_partkey", "token_set", "jaro_winkler")


@query()
def json_objects_scan(spark, d):
    return fuzzy.scan_json(table(spark, d, "events"), "event_id", "props")


@query("""WITH l AS (SELECT conv_id, turn, role, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS claim FROM conversations)
SELECT conv_id, (row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1)::INTEGER AS number, role AS section, 0 AS position, md5(claim) AS claim_md5 FROM l""")
def profile_claims(spark, d):
    """Claims of Markdown profiles that are put together from the conversations: a section a turn, a wrapped bullet in it."""
    line = F.concat(F.lit("# "), "role", F.lit("\n- "), F.regexp_replace("text", r"\n", "\n  "))
    c = table(spark, d, "conversations").withColumn("line", line)
    whole = c.groupBy("conv_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("turn", "line"))), lambda x: x["line"]), "\n").alias("profile"))
    claims = fuzzy.profile_claims(whole, "conv_id", "profile")
    return claims.select("conv_id", "number", "section", "position", F.md5(T.normalize_whitespace(F.col("claim"))).alias("claim_md5"))


@query()
def turn_header_split(spark, d):
    """Turns of transcripts that are put together from the conversations."""
    c = table(spark, d, "conversations").withColumn("line", F.concat(F.lit("O SR. "), F.upper("role"), F.lit(" - "), "text"))
    whole = c.groupBy("conv_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("turn", "line"))), lambda x: x["line"]), "\n").alias("transcript"))
    return segment.turns(whole, "conv_id", "transcript")


@query()
def length_batches(spark, d):
    """Documents dealt into batches of at most 20,000 padded characters."""
    return fuzzy.greedy_batches(table(spark, d, "documents"), "doc_id", "n_chars", 20_000, 64)


@query()
def stacked_signals(spark, d):
    """A logistic combination of two signals of labelled documents, its probability, and their rank fusion."""
    docs = table(spark, d, "documents").select("doc_id", F.log(1 + F.col("n_chars")).alias("size"), F.length(F.regexp_replace("text", "[^.!?]", "")).alias("ends"))
    rows = docs.join(table(spark, d, "labels"), "doc_id").withColumn("share", F.col("ends") / F.exp("size"))
    model = learning.fit_logistic(rows, ["size", "share"], "quality")
    fused = learning.rank_fusion(rows, ["size", "share"])
    out = learning.predict_logistic(fused, model) if model else fused.withColumn("probability", F.lit(None).cast("double"))
    return out.select("doc_id", F.round("probability", 6).alias("probability"), F.round("rank_mean", 9).alias("rank_mean"), F.round("rank_max", 9).alias("rank_max"))


@query("""WITH g AS (SELECT lang, count(*) AS n FROM documents GROUP BY lang), k AS (SELECT lang, n, unnest(range(0, n + 1)) AS k FROM g),
w AS (SELECT *, k / n AS p, 1.959963984540054 AS z FROM k), l AS (SELECT lang, n, k, (p + z * z / (2 * n) - z * sqrt(p * (1 - p) / n + z * z / (4 * n * n))) / (1 + z * z / n) AS low FROM w)
SELECT lang, n, min(k)::INTEGER AS least FROM l WHERE low >= 0.7 GROUP BY lang, n""")
def min_successes_to_pass(spark, d):
    g = table(spark, d, "documents").groupBy("lang").agg(F.count("*").alias("n"))
    return g.select("lang", "n", S.min_successes(F.col("n"), 0.7).alias("least")).filter("least is not null")
