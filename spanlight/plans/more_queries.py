"""Queries on passages, dates in articles, and comparisons of systems."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import speech
from ..operators import comparison, passages
from .registry import query, table
from .text_queries import PARTS, WORDS


@query("SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d %H:%M') AS published, strftime(o_orderdate + INTERVAL 1 DAY, '%Y-%m-%d %H:%M') AS updated, CASE WHEN o_orderkey % 5 = 0 THEN 1 ELSE 0 END AS n_mentions FROM orders")
def br_timestamp_parse(spark, d):
    """Articles put together from the orders: an update stamp first, then the publication's, and a weekday mention in some."""
    o = table(spark, d, "orders")
    stamp = lambda c: F.date_format(c, "dd/MM/yyyy - HH:mm")
    mention = F.when(F.col("o_orderkey") % 5 == 0, " nesta terça-feira (12)").otherwise("")
    a = o.select("o_orderkey", F.concat(F.lit("Atualizado em "), stamp(F.expr("o_orderdate + interval 1 day")), F.lit(" texto "), stamp("o_orderdate"), mention).alias("a"))
    show = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm")
    c = F.col("a")
    return a.select("o_orderkey", show(speech.published_at(c)).alias("published"), show(speech.updated_at(c)).alias("updated"), F.size(speech.weekday_mentions(c)).alias("n_mentions"))


@query("""WITH s AS (SELECT doc_id, text, length(text) // 3 AS a, 2 * (length(text) // 3) AS b FROM documents)
SELECT doc_id, md5(CASE WHEN length(text) - b <= 20 THEN substr(text, b + 1) ELSE regexp_replace(substr(text, b + 1, 20), '\\s+\\S*$', '') || '…' END) AS after_md5,
  md5(CASE WHEN a <= 20 THEN substr(text, 1, a) ELSE '…' || regexp_replace(substr(text, a - 19, 20), '^\\S*\\s+', '') END) AS before_md5 FROM s""")
def context_windows(spark, d):
    """Twenty characters on each side of every text's middle third."""
    docs = table(spark, d, "documents")
    third = F.floor(F.length("text") / 3).cast("int")
    w = passages.context_window(F.col("text"), third, 2 * third, 20)
    return docs.select("doc_id", w.alias("w")).select("doc_id", F.md5("w.after").alias("after_md5"), F.md5("w.before").alias("before_md5"))


@query("""WITH s AS (SELECT conv_id, turn AS id, sum(length(text) + 1) OVER (PARTITION BY conv_id ORDER BY turn) - length(text) - 1 AS s, sum(length(text) + 1) OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS e FROM conversations),
f AS (SELECT conv_id, id, s + 100 AS s, e + 150 AS e FROM s) SELECT a.conv_id, a.id AS a_id, b.id AS b_id FROM s a JOIN f b ON a.conv_id = b.conv_id AND a.s < b.e AND b.s < a.e AND a.s < a.e AND b.s < b.e""")
def span_overlaps(spark, d):
    """Spans of turns against the same spans moved and widened."""
    from ..operators import segment

    s = segment.joined_segments(table(spark, d, "conversations"), ["conv_id"], "turn", "text")
    a = s.select("conv_id", F.col("turn").alias("id"), F.col("start").alias("start_char"), (F.col("start") + F.length("text")).alias("end_char"))
    b = a.withColumn("start_char", F.col("start_char") + 100).withColumn("end_char", F.col("end_char") + 150)
    return passages.overlapping(a, b, "conv_id")


@query()
def merged_segments(spark, d):
    """Parts joined over abbreviations and short tails: their number and characters."""
    p = table(spark, d, "documents").select("doc_id", passages.merged_parts(F.col("text"), ["the.", "and."]).alias("p"))
    return p.select("doc_id", F.size("p").alias("n"), F.md5(F.array_join("p", "\n")).alias("parts_md5"))


@query(f"SELECT doc_id, len({PARTS.format('text')})::INTEGER AS n_parts, md5(array_to_string({WORDS.format('text')}, ' ')) AS words_md5 FROM documents")
def part_counts(spark, d):
    from ..functions import text as T

    c = F.col("text")
    return table(spark, d, "documents").select("doc_id", F.size(T.sentence_parts(c)).alias("n_parts"), F.md5(F.array_join(T.words(c), " ")).alias("words_md5"))


@query("""WITH p AS (SELECT d.doc_id, quality AS x, toxic AS y, ln(1 + n_chars) AS s FROM documents d JOIN labels USING (doc_id))
SELECT count(*) AS n, round(avg(y - x), 9) AS delta, count(*) FILTER (WHERE y > x) AS gained, count(*) FILTER (WHERE y < x) AS lost FROM p""")
def compare_judges(spark, d):
    """Two judges of the same documents: wins, losses and the mean difference."""
    labels = table(spark, d, "labels").join(table(spark, d, "documents").select("doc_id"), "doc_id")
    a, b = (labels.select("doc_id", F.col(c).alias("hit")) for c in ("quality", "toxic"))
    s = comparison.summary(comparison.paired(a, b, "doc_id", ["hit"]), "hit", "hit")
    return s.select("n", F.round("delta", 9).alias("delta"), "gained", "lost")


@query("SELECT doc_id, (quality + toxic) / 2 AS votes, quality = toxic AS unanimous FROM labels")
def consensus_votes(spark, d):
    return comparison.consensus(table(spark, d, "labels"), ["quality", "toxic"]).select("doc_id", "votes", "unanimous")


@query("""WITH p AS (SELECT n_chars AS s, quality AS x FROM documents JOIN labels USING (doc_id)), b AS (SELECT s, count(*) AS m, sum(x) AS x FROM p GROUP BY s), u AS (SELECT *, sum(m) OVER (ORDER BY s DESC ROWS UNBOUNDED PRECEDING) AS upto FROM b),
w AS (SELECT share::DOUBLE AS share, greatest(1, least(n, ceil(share::DOUBLE * n - 1e-9)))::BIGINT AS kept FROM (SELECT count(*) AS n FROM p), (VALUES (0.1), (0.25), (0.5), (1.0)) v(share))
SELECT share, kept, round(sum(x * greatest(0, least(m, kept - (upto - m))) / m) / kept, 9) AS precision FROM u, w GROUP BY share, kept""")
def precision_at_coverage(spark, d):
    rows = table(spark, d, "documents").select("doc_id", "n_chars").join(table(spark, d, "labels"), "doc_id")
    out = comparison.top_fraction_risk(rows, "n_chars", "quality", [0.1, 0.25, 0.5, 1.0])
    return out.select("share", "kept", F.round("precision", 9).alias("precision"))


@query("WITH p AS (SELECT supp.s_suppkey, row_number() OVER (ORDER BY supp.s_suppkey) - 1 AS k, count(*) OVER () AS n FROM supplier supp), d AS (SELECT i AS draw, (('0x' || substr(md5('9|' || i), 1, 8))::BIGINT % (SELECT count(*) FROM supplier)) AS k FROM range(0, 100) r(i)) SELECT draw::INTEGER AS draw, s_suppkey FROM d JOIN p USING (k)")
def null_draws(spark, d):
    return comparison.null_draws(table(spark, d, "supplier"), "s_suppkey", 100, 9)


@query("SELECT item_id AS doc_item, row_number() OVER (ORDER BY md5('3|' || item_id), item_id)::INTEGER AS item_id FROM benchmark")
def blind_sheet(spark, d):
    rows = table(spark, d, "benchmark").select(F.col("item_id").alias("doc_item"))
    return comparison.anonymous_order(rows, "doc_item", 3)
