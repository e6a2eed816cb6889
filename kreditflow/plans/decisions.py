"""Batch decision plans over the loan applications."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kreditflow.functions.numeric import pround

from kreditflow import constants as K
from kreditflow.operators import clean as C
from kreditflow.operators import decide as D

SURROGATE_VERSION = "surrogate-linear-1"


def surrogate_inputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applicants with the surrogate score."""
    return C.applicants(spark, sf_dir).withColumn("repay_prob", C.surrogate_prob())


def surrogate_decision_rows(spark: SparkSession, sf_dir: str, model_version: str | None = SURROGATE_VERSION) -> DataFrame:
    """DEC-10 without the budget step (tier-3 rows PENDING); the score's exact attributions are derived from the stored columns."""
    mv = F.lit(model_version) if model_version else F.lit(None).cast("string")
    return D.decide_rows(surrogate_inputs(spark, sf_dir), "repay_prob", C.surrogate_attributions(), F.lit(C.surrogate_base_logit()), mv)


def surrogate_decisions(spark: SparkSession, sf_dir: str, budget: float = K.DEFAULT_POOL_BUDGET) -> DataFrame:
    """DEC-10: full decisions including the pool budget."""
    return D.apply_budget(surrogate_decision_rows(spark, sf_dir), budget)


def decision_summary(dec: DataFrame) -> DataFrame:
    """Flagship report: count, approved amount and mean score per tier, decision and offer."""
    approved = F.col("decision") == "APPROVED"
    amount = F.when(F.col("tier") == 3, F.col("trial_amount")).otherwise(F.col("offer_amount"))
    return dec.groupBy("tier", "decision", "offer_tier").agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(F.when(approved, amount).otherwise(F.lit(0.0))).alias("approved_amount"),
        # scores have four places: their sum in units of the last one is exact in any order
        pround(F.sum(F.floor(F.col("repay_probability") * 10000 + 0.5)) / (F.count("repay_probability") * 10000.0), 6).alias("mean_repay_prob"),
    )
