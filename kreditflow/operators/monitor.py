"""Monitoring: rates by external grade (AGG-11/12), approval-rate drift
(AGG-29), stress scoreboard (AGG-31), model comparison (AGG-32)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kreditflow.functions.numeric import pround

from kreditflow import constants as K


def grade_rates(scored: DataFrame, threshold: float = K.APPROVAL_THRESHOLD, score: str = "repay_prob") -> DataFrame:
    """AGG-11: one ``groupBy(grade)`` instead of one pass per grade."""
    ap = (F.col(score) >= threshold).cast("int")
    g = scored.groupBy("grade").agg(
        F.count(F.lit(1)).alias("total"), F.sum(ap).cast("long").alias("approved"), F.avg("target").alias("_r")
    )
    return g.select(
        "grade", "total", "approved",
        pround(F.col("approved") / F.col("total") * 100, 4).alias("approval_pct"),
        pround(F.col("_r") * 100, 4).alias("repay_pct"),
        pround(F.lit(100) - F.col("_r") * 100, 4).alias("default_pct"),
    )


def declined_by_grade(scored: DataFrame, threshold: float = K.APPROVAL_THRESHOLD, score: str = "repay_prob") -> DataFrame:
    """AGG-12: repay rate among the declined, per grade."""
    d = scored.filter(F.col(score) < threshold)
    return d.groupBy("grade").agg(
        F.count(F.lit(1)).alias("declined"),
        F.sum("target").cast("long").alias("actually_repaid"),
        pround(F.avg("target") * 100, 4).alias("repay_rate"),
    )


def approval_drift(log: DataFrame, window_days: int = 7, as_of: str | None = None) -> DataFrame:
    """AGG-29: recent vs all-time approval rate in one pass over two columns.

    ``as_of`` replaces the wall clock (default: the newest decision), so the
    result is reproducible.  A recent rate of 0 and a zero drift are reported
    as numbers (not as missing).
    """
    ts = F.try_to_timestamp(F.col("decided_at"))
    d = log.select(ts.alias("ts"), (F.col("decision") == "APPROVED").cast("int").alias("ok"))
    # newest decision as a scalar subquery (one aggregate, no global window)
    ref = F.lit(as_of).cast("timestamp_ntz") if as_of else d.agg(F.max("ts")).scalar()
    recent = F.col("ts") >= ref - F.make_dt_interval(F.lit(window_days))
    agg = d.agg(F.avg("ok").alias("base"), F.avg(F.when(recent, F.col("ok"))).alias("recent"))
    drift = F.abs(F.col("recent") - F.col("base"))
    return agg.select(
        pround("base", 3).alias("baseline_approval_rate"),
        pround("recent", 3).alias("recent_approval_rate"),
        pround(drift, 3).alias("drift"),
        F.coalesce(drift > K.DRIFT_ALERT, F.lit(False)).alias("alert"),
    )


def stress_scoreboard(results: DataFrame) -> DataFrame:
    """AGG-31: per-profile outcome label and per-group summary.

    ``results``: label, expected, decision, repay_prob."""
    outcome = F.when(F.col("expected") == "AMBIGUOUS", F.lit("—")).when(
        F.col("decision") == F.col("expected"), F.lit("✓ CORRECT")
    ).otherwise(F.lit("✗ WRONG"))
    r = results.withColumn("outcome", outcome)
    clear = F.col("expected") != "AMBIGUOUS"
    return r.groupBy("expected").agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(clear & (F.col("outcome") == "✓ CORRECT")).alias("correct"),
        pround(F.avg("repay_prob"), 3).alias("mean_repay_prob"),
    )


def compare_models(candidate: DataFrame, versions: DataFrame) -> DataFrame:
    """AGG-32: candidate metrics against the active model (latest ACTIVE row)."""
    active = versions.filter(F.col("status") == "ACTIVE").agg(
        F.max_by("version", "deployed_at").alias("active_version"), F.max_by("roc_auc", "deployed_at").alias("active_roc_auc")
    )
    both = candidate.withColumn("_one", F.lit(1)).join(F.broadcast(active.withColumn("_one", F.lit(1))), "_one", "left").drop("_one")  # one row
    delta = F.col("roc_auc") - F.col("active_roc_auc")
    return both.withColumns({"improvement": pround(delta, 4), "verdict": F.when(delta > 0, F.lit("retrain")).otherwise(F.lit("keep"))})
