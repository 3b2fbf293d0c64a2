"""Metrics of scored rows (score double, label 0/1), whole or by group. Ties count as the definitions say."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _by(groups: list[str]) -> list:
    return [F.col(g) for g in groups] or [F.lit(1)]


def cut_table(rows: DataFrame, score: str, label: str, groups: list[str] | None = None) -> DataFrame:
    """One row a distinct score: positives, negatives, and those at or above it; totals beside them.

    Rows are summed by score first, so the running sums see distinct scores only.
    """
    groups = groups or []
    at = rows.groupBy(*groups, score).agg(F.sum(F.col(label).cast("bigint")).alias("pos"), F.sum(1 - F.col(label).cast("bigint")).alias("neg"))
    down = Window.partitionBy(*_by(groups)).orderBy(F.desc(score)).rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy(*_by(groups))
    return at.select(
        *groups,
        F.col(score).alias("score"),
        "pos",
        "neg",
        F.sum("pos").over(down).alias("tp"),
        F.sum("neg").over(down).alias("fp"),
        F.sum("pos").over(whole).alias("n_pos"),
        F.sum("neg").over(whole).alias("n_neg"),
        F.lead(score).over(Window.partitionBy(*_by(groups)).orderBy(F.desc(score))).alias("next_score"),
    )


def roc_auc(rows: DataFrame, score: str, label: str, groups: list[str] | None = None) -> DataFrame:
    """P(positive above negative) plus half of ties; null with one class."""
    cuts = cut_table(rows, score, label, groups)
    area = F.sum(F.col("neg") * (F.col("tp") - F.col("pos") + 0.5 * F.col("pos")))
    auc = F.when((F.max("n_pos") > 0) & (F.max("n_neg") > 0), area / (F.max("n_pos") * F.max("n_neg")))
    return cuts.groupBy(*(groups or [])).agg(auc.alias("auc"))


def average_precision(rows: DataFrame, score: str, label: str, groups: list[str] | None = None) -> DataFrame:
    """Sum over distinct scores of recall's step times precision."""
    cuts = cut_table(rows, score, label, groups)
    return cuts.groupBy(*(groups or [])).agg(F.when(F.max("n_pos") > 0, F.sum(F.col("pos") * F.col("tp") / (F.col("tp") + F.col("fp"))) / F.max("n_pos")).alias("ap"))


def youden(rows: DataFrame, score: str, label: str, groups: list[str] | None = None) -> DataFrame:
    """The cut of largest TPR - FPR, lowest score on ties within 1e-12; the threshold is the midpoint to the next lower score."""
    groups = groups or []
    cuts = cut_table(rows, score, label, groups).filter("n_pos > 0 and n_neg > 0")
    j = cuts.withColumn("j", F.round(F.col("tp") / F.col("n_pos") - F.col("fp") / F.col("n_neg"), 12))
    w = Window.partitionBy(*_by(groups)).orderBy(F.desc("j"), "score")
    best = j.withColumn("k", F.row_number().over(w)).filter("k = 1")
    threshold = F.when(F.col("next_score").isNull(), F.col("score")).otherwise((F.col("score") + F.col("next_score")) / 2)
    return best.select(*groups, "j", threshold.alias("threshold"))


def risk_coverage(rows: DataFrame, score: str, correct: str, groups: list[str] | None = None) -> DataFrame:
    """(groups, coverage, risk) at each distinct score: the share kept and the share of errors in it."""
    cuts = cut_table(rows, score, correct, groups)
    n = F.col("n_pos") + F.col("n_neg")
    return cuts.select(*(groups or []), "score", ((F.col("tp") + F.col("fp")) / n).alias("coverage"), (F.col("fp") / (F.col("tp") + F.col("fp"))).alias("risk"))


def aurc(rows: DataFrame, score: str, correct: str, groups: list[str] | None = None) -> DataFrame:
    """Mean over k of the error share in the k best rows; rows of equal scores share their errors evenly.

    Within a block of m equal scores after c rows with e errors, of its own f, the k-th row sees e + f k / m errors.
    """
    cuts = cut_table(rows, score, correct, groups)
    m = (F.col("pos") + F.col("neg")).cast("int")
    before, errors = F.col("tp") + F.col("fp") - m, F.col("fp") - F.col("neg")
    block = F.aggregate(F.sequence(F.lit(1), m), F.lit(0.0), lambda a, k: a + (errors + F.col("neg") * k / m) / (before + k))
    return cuts.groupBy(*(groups or [])).agg((F.sum(block) / (F.max("n_pos") + F.max("n_neg"))).alias("aurc"))


def operating_points(rows: DataFrame, score: str, label: str, cuts: list[float]) -> DataFrame:
    """Kept rows, coverage, precision, TPR and FPR at each named cut; nulls over zero."""
    table = rows.select(F.col(score).alias("s"), F.col(label).cast("bigint").alias("y"), F.explode(F.array(*map(F.lit, cuts))).alias("cut"))
    kept = F.col("s") >= F.col("cut")
    n, tp = F.sum(kept.cast("bigint")), F.sum(F.when(kept, F.col("y")).otherwise(0))
    pos, neg = F.sum("y"), F.sum(1 - F.col("y"))
    ratio = lambda a, b: F.when(b > 0, F.round(a / b, 9))
    return table.groupBy("cut").agg(n.alias("kept"), ratio(n, F.count("*")).alias("coverage"), ratio(tp, n).alias("precision"), ratio(tp, pos).alias("tpr"), ratio(n - tp, neg).alias("fpr"))


def max_f1(rows: DataFrame, score: str, label: str) -> DataFrame:
    """The cut of largest F1 of the positives (score at or above), highest score on ties."""
    cuts = cut_table(rows, score, label)
    f1 = F.round(2 * F.col("tp") / (F.col("tp") + F.col("fp") + F.col("n_pos")), 12)
    return cuts.withColumn("f1", f1).orderBy(F.desc("f1"), F.desc("score")).limit(1).select("score", "f1")


def confusion(rows: DataFrame, a: str, b: str, groups: list[str] | None = None) -> DataFrame:
    """both, only_a, only_b, neither of two 0/1 columns."""
    x, y = F.col(a) == 1, F.col(b) == 1
    one = lambda c: F.sum(c.cast("bigint"))
    return rows.groupBy(*(groups or [])).agg(one(x & y).alias("both"), one(x & ~y).alias("only_a"), one(~x & y).alias("only_b"), one(~x & ~y).alias("neither"))


def mcnemar_exact(only_a: Column, only_b: Column) -> Column:
    """Two-sided exact binomial p of the discordant pairs; 1 without any. Sums in logarithms, so large counts hold."""
    n, k = (only_a + only_b).cast("int"), F.least(only_a, only_b).cast("int")
    start = F.struct(F.lit(0.0).alias("logc"), F.lit(0.0).alias("sum"))

    def add(s, i):
        logc = F.when(i == 0, 0.0).otherwise(s["logc"] + F.log((n - i + 1) / i))
        return F.struct(logc.alias("logc"), (s["sum"] + F.exp(logc - n * F.log(F.lit(2.0)))).alias("sum"))

    tail = F.aggregate(F.sequence(F.lit(0), k), start, add, lambda s: s["sum"])
    return F.when(n == 0, 1.0).otherwise(F.least(F.lit(1.0), 2 * tail))


def holm(rows: DataFrame, p: str, families: list[str], tie: str) -> DataFrame:
    """rows with p_holm: step-down adjusted within a family; a missing p counts as 1."""
    value = F.coalesce(F.col(p), F.lit(1.0))
    w = Window.partitionBy(*_by(families)).orderBy(value, tie)
    m = F.count("*").over(Window.partitionBy(*_by(families)))
    step = rows.withColumn("__s", F.least(F.lit(1.0), (m - F.row_number().over(w) + 1) * value))
    return step.withColumn("p_holm", F.max("__s").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("__s")


def spearman(rows: DataFrame, a: str, b: str, groups: list[str]) -> DataFrame:
    """Correlation of average ranks by group, null under three rows."""

    def rank(c: str) -> Column:
        return F.rank().over(Window.partitionBy(*groups).orderBy(c)) + (F.count("*").over(Window.partitionBy(*groups, c)) - 1) / 2

    both = rows.select(*groups, rank(a).alias("ra"), rank(b).alias("rb"))
    return both.groupBy(*groups).agg(F.when(F.count("*") >= 3, F.corr("ra", "rb")).alias("rho"), F.count("*").alias("n"))


def stratified_estimate(strata: DataFrame, size: str, drawn: str, hits: str) -> DataFrame:
    """Weighted share and its standard error with the finite-population correction; a census adds no variance."""
    n, m, x = F.col(size).cast("double"), F.col(drawn).cast("double"), F.col(hits).cast("double")
    share = x / m
    var = F.when((m >= n) | (m < 2), 0.0).otherwise(n * n * (1 - m / n) * share * (1 - share) / (m - 1))
    ok = strata.filter(m > 0)
    total = F.sum(n)
    return ok.agg((F.sum(n * share) / total).alias("share"), (F.sqrt(F.sum(var)) / total).alias("se"))


def conformal_threshold(rows: DataFrame, score: str, correct: str, alpha: float) -> DataFrame:
    """The floor(alpha (n + 1))-th smallest score of correct rows; null (accept all) if that is none."""
    right = rows.filter(F.col(correct) == 1).select(F.col(score).alias("s"))
    k = right.agg(F.floor(alpha * (F.count("*") + 1)).alias("k"))
    at = right.groupBy("s").agg(F.count("*").alias("m")).withColumn("upto", F.sum("m").over(Window.orderBy("s").rowsBetween(Window.unboundedPreceding, 0)))
    return k.crossJoin(at).filter("k > 0 and upto >= k").agg(F.min("s").alias("threshold"))
