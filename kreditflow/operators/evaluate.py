"""Model evaluation (AGG-13..26, WIN-01, SRT-01, WIN-04).

Everything starts from the score histogram: one row per distinct score with
positive and negative counts.  It is a map-side-combined aggregate whose size
is bounded by the score precision (4 places: at most 10,001 rows), so the
global cumulative windows below run over a small relation, never over the
data.  Ranking metrics (AUC, AP, KS, curves) are exact for the rounded score.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kreditflow.functions.numeric import pround

from kreditflow import constants as K

DECILES = [i / 10 for i in range(11)]


def score_histogram(scored: DataFrame, label: str = "target", score: str = "repay_prob", places: int = 4) -> DataFrame:
    """``score, n, pos, neg``; scores are rounded to ``places``, which bounds the histogram."""
    return scored.groupBy(pround(F.col(score), places).alias("score")).agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(F.col(label)).cast("long").alias("pos"),
        F.sum(1 - F.col(label)).cast("long").alias("neg"),
    )


def cumulative(hist: DataFrame) -> DataFrame:
    """WIN-01 / SRT-01: inclusive cumulative counts by score descending."""
    w = Window.orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, 0)
    tot = Window.partitionBy(F.lit(1))
    return hist.select(
        "*",
        F.sum("pos").over(w).alias("cum_pos"),
        F.sum("neg").over(w).alias("cum_neg"),
        F.sum("n").over(w).alias("cum_n"),
        F.sum("pos").over(tot).alias("tot_pos"),
        F.sum("neg").over(tot).alias("tot_neg"),
    )


def cumulative_shares(scored: DataFrame, **kw) -> DataFrame:
    """WIN-01: cum_repaid and cum_default shares per distinct score."""
    c = cumulative(score_histogram(scored, **kw))
    return c.select(
        "score",
        pround(F.col("cum_pos") / F.col("tot_pos"), 6).alias("cum_repaid"),
        pround(F.col("cum_neg") / F.col("tot_neg"), 6).alias("cum_default"),
    )


def ranking_metrics(scored: DataFrame, **kw) -> DataFrame:
    """AGG-20/21/22: ROC-AUC (ties count one half), average precision (step
    sum over distinct thresholds) and KS, in one row."""
    c = cumulative(score_histogram(scored, **kw))
    above = F.col("cum_pos") - F.col("pos")
    return c.agg(
        pround(F.sum(F.col("neg") * (above + F.col("pos") / 2.0)) / (F.first("tot_pos") * F.first("tot_neg")), 6).alias("roc_auc"),
        pround(F.sum(F.col("pos") / F.col("tot_pos") * (F.col("cum_pos") / F.col("cum_n"))), 6).alias("average_precision"),
        pround(F.max(F.abs(F.col("cum_pos") / F.col("tot_pos") - F.col("cum_neg") / F.col("tot_neg"))), 6).alias("ks_stat"),
    )


def roc_curve(scored: DataFrame, **kw) -> DataFrame:
    """AGG-23: one point per distinct threshold."""
    c = cumulative(score_histogram(scored, **kw))
    return c.select(
        F.col("score").alias("threshold"),
        pround(F.col("cum_neg") / F.col("tot_neg"), 6).alias("fpr"),
        pround(F.col("cum_pos") / F.col("tot_pos"), 6).alias("tpr"),
    )


def pr_curve(scored: DataFrame, **kw) -> DataFrame:
    """AGG-24."""
    c = cumulative(score_histogram(scored, **kw))
    return c.select(
        F.col("score").alias("threshold"),
        pround(F.col("cum_pos") / F.col("cum_n"), 6).alias("precision"),
        pround(F.col("cum_pos") / F.col("tot_pos"), 6).alias("recall"),
    )


def quantile_edges(hist: DataFrame, qs: list[float] = DECILES) -> Column:
    """Exact interpolated quantiles of the scores (as pandas/numpy), computed
    from the histogram with counts as frequencies; used as a scalar subquery."""
    return hist.agg(F.percentile(F.col("score"), F.array(*[F.lit(q) for q in qs]), F.col("n"))).scalar()


def calibration_table(scored: DataFrame, **kw) -> DataFrame:
    """AGG-13 / WIN-04: decile buckets with duplicate edges dropped, right-closed
    with the lowest value in bucket 1; count, mean score, actual rate, gap."""
    hist = score_histogram(scored, **kw)
    # the edges subquery is projected first: a higher-order function cannot hold a subquery
    hist = hist.withColumn("_edges", F.array_distinct(quantile_edges(hist)))
    b = F.greatest(F.lit(1), F.size(F.filter(F.col("_edges"), lambda e: e < F.col("score"))))
    g = hist.groupBy(b.alias("bucket")).agg(
        F.sum("n").alias("count"),
        (F.sum(F.col("score") * F.col("n")) / F.sum("n")).alias("pred"),
        (F.sum("pos") / F.sum("n")).alias("actual"),
    )
    return g.select(
        "bucket", "count", pround("pred", 6).alias("pred_prob"), pround("actual", 6).alias("actual_rate"),
        pround(F.col("actual") - F.col("pred"), 6).alias("gap"),
    )


def calibration_gap(scored: DataFrame, **kw) -> DataFrame:
    """AGG-14: unweighted mean absolute gap and the 0.05 verdict."""
    t = calibration_table(scored, **kw)
    m = F.avg(F.abs("gap"))
    return t.agg(pround(m, 6).alias("mean_abs_gap"), F.when(m < 0.05, F.lit("Well calibrated")).otherwise(F.lit("Needs calibration")).alias("verdict"))


def brier(scored: DataFrame, label: str = "target", score: str = "repay_prob") -> DataFrame:
    """AGG-15."""
    return scored.agg(pround(F.avg(F.pow(F.col(score) - F.col(label), 2)), 6).alias("brier"))


def reliability_curve(scored: DataFrame, bins: int = 10, **kw) -> DataFrame:
    """AGG-16: quantile strategy; bin = number of interior edges below the score
    (a score equal to an edge is in the lower bin; duplicates kept); empty bins are absent."""
    hist = score_histogram(scored, **kw)
    qs = [i / bins for i in range(bins + 1)]
    hist = hist.withColumn("_edges", F.slice(quantile_edges(hist, qs), 2, bins - 1))
    b = F.size(F.filter(F.col("_edges"), lambda e: e < F.col("score")))
    g = hist.groupBy(b.alias("bin")).agg((F.sum("pos") / F.sum("n")).alias("fp"), (F.sum(F.col("score") * F.col("n")) / F.sum("n")).alias("mp"))
    return g.select("bin", pround("fp", 6).alias("fraction_pos"), pround("mp", 6).alias("mean_pred"))


def confusion(scored: DataFrame, threshold: float = K.REPAID_MODEL_THRESHOLD, label: str = "target", score: str = "repay_prob") -> DataFrame:
    """AGG-17/18: tn, fp, fn, tp (positive = repaid, predicted when score > threshold)
    and the expected cost 3*fp + fn, one pass."""
    y, pred = F.col(label) == 1, F.col(score) > threshold
    c = scored.agg(
        F.count_if(~y & ~pred).alias("tn"), F.count_if(~y & pred).alias("fp"),
        F.count_if(y & ~pred).alias("fn"), F.count_if(y & pred).alias("tp"),
    )
    return c.withColumn("expected_cost", F.col("fp") * K.COST_FALSE_POSITIVE + F.col("fn") * K.COST_FALSE_NEGATIVE)


def classification_report(scored: DataFrame, **kw) -> DataFrame:
    """AGG-19: per-class precision, recall, F1, support; accuracy; averages."""
    c = confusion(scored, **kw)

    def div(a, b):
        return F.coalesce(F.try_divide(a, b), F.lit(0.0))

    tn, fp, fn, tp = (F.col(x).cast("double") for x in ("tn", "fp", "fn", "tp"))
    p0, r0, p1, r1 = div(tn, tn + fn), div(tn, tn + fp), div(tp, tp + fp), div(tp, tp + fn)
    f0, f1 = div(2 * p0 * r0, p0 + r0), div(2 * p1 * r1, p1 + r1)
    s0, s1 = tn + fp, tp + fn
    tot = s0 + s1
    rows = [
        ("Defaulted", p0, r0, f0, s0),
        ("Repaid", p1, r1, f1, s1),
        ("accuracy", F.lit(None).cast("double"), F.lit(None).cast("double"), div(tp + tn, tot), tot),
        ("macro avg", (p0 + p1) / 2, (r0 + r1) / 2, (f0 + f1) / 2, tot),
        ("weighted avg", div(p0 * s0 + p1 * s1, tot), div(r0 * s0 + r1 * s1, tot), div(f0 * s0 + f1 * s1, tot), tot),
    ]
    arr = F.array(*[F.struct(F.lit(n).alias("label"), pround(p, 6).alias("precision"), pround(r, 6).alias("recall"), pround(f, 6).alias("f1"), s.cast("long").alias("support")) for n, p, r, f, s in rows])
    return c.select(F.explode(arr).alias("r")).select("r.*")


def coverage(scored: DataFrame, threshold: float = K.REPAID_MODEL_THRESHOLD, label: str = "target", score: str = "repay_prob") -> DataFrame:
    """AGG-25/26: approve/decline counts and shares at the threshold plus the
    actual repay rate on each side, one pass."""
    ap = F.col(score) >= threshold
    n = F.count(F.lit(1))
    return scored.agg(
        n.alias("total"),
        F.count_if(ap).alias("approve"),
        F.count_if(~ap).alias("decline"),
        pround(F.count_if(ap) / n, 6).alias("approve_share"),
        pround(F.count_if(~ap) / n, 6).alias("decline_share"),
        pround(F.avg(F.when(ap, F.col(label))), 6).alias("repay_rate_approved"),
        pround(F.avg(F.when(~ap, F.col(label))), 6).alias("repay_rate_declined"),
    )
