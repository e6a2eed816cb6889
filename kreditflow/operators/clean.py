"""Clean feature table, surrogate score and its exact attributions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kreditflow.functions.numeric import pround

from kreditflow import constants as K
from kreditflow.functions import features as FE
from kreditflow.sources.loans import loans

KEYS = ["loan_id", "pool_id", "decided_at"]


def applicants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every loan application with engineered features; ``target`` is NULL
    while the outcome is unknown.  Also keeps ``grade`` and ``loan_status``."""
    raw = loans(spark, sf_dir)
    raw = raw.withColumn(
        "target",
        F.when(F.col("loan_status").isin(*K.KNOWN_STATUSES), (F.col("loan_status") == K.REPAID_STATUS).cast("int")),
    )
    return FE.engineer(raw, keep=KEYS + ["grade", "loan_status"])


def clean_loans(spark: SparkSession, sf_dir: str, reference_date: str | None = None) -> DataFrame:
    """The clean table: FLT-01, PRJ-01..03, SCL-01..09.

    Leakage columns (grade among them) are dropped; keys are kept.
    """
    raw = FE.drop_leaky(loans(spark, sf_dir))
    return FE.engineer(FE.known_outcomes(raw), reference_date=reference_date, keep=KEYS)


def surrogate_logit(df_cols: dict[str, Column] | None = None) -> Column:
    """Linear stand-in for a trained model (exact oracle for ranking and texts)."""
    c = df_cols or {f: F.col(f) for f in ("dti", "revol_util", "pub_rec", "annual_inc")}
    return (
        F.lit(K.SURROGATE_INTERCEPT)
        - F.lit(0.12) * F.coalesce(c["dti"], F.lit(22.5))
        - F.lit(0.015) * F.coalesce(c["revol_util"], F.lit(50.0))
        - F.lit(0.5) * c["pub_rec"]
        + c["annual_inc"] / F.lit(60000.0)
    )


def surrogate_prob() -> Column:
    return pround(F.lit(1.0) / (F.lit(1.0) + F.exp(-surrogate_logit())), 4)


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``loan_id, target, repay_prob`` over the clean table."""
    return clean_loans(spark, sf_dir).select("loan_id", "target", surrogate_prob().alias("repay_prob"))


def surrogate_base_logit() -> float:
    """Log-odds of the baseline applicant (the attribution base value)."""
    base = {t[0]: t[3] for t in K.SURROGATE_TERMS}
    return K.SURROGATE_INTERCEPT - 0.12 * base["dti"] - 0.015 * base["revol_util"] - 0.5 * base["pub_rec"] + base["annual_inc"] / 60000.0


def surrogate_attributions() -> Column:
    """Exact Shapley values of the linear surrogate, one per model feature in
    model order: ``array<struct<idx int, feature string, shap double, value double>>``.

    Features outside the score get 0.  ``value`` is the value the model saw
    (NULL filled as the score fills it).
    """
    seen = {
        "dti": F.coalesce(F.col("dti"), F.lit(22.5)),
        "revol_util": F.coalesce(F.col("revol_util"), F.lit(50.0)),
    }
    phi = {
        "dti": F.lit(-0.12) * (seen["dti"] - F.lit(22.5)),
        "revol_util": F.lit(-0.015) * (seen["revol_util"] - F.lit(50.0)),
        "pub_rec": F.lit(-0.5) * (F.col("pub_rec") - F.lit(0.0)),
        "annual_inc": (F.col("annual_inc") - F.lit(70000.0)) / F.lit(60000.0),
    }
    items = []
    for i, f in enumerate(K.ALL_FEATURES):
        value = seen.get(f, F.col(f).cast("double") if f != "home_ownership" else F.lit(None).cast("double"))
        items.append(
            F.struct(
                F.lit(i).alias("idx"),
                F.lit(f).alias("feature"),
                phi.get(f, F.lit(0.0)).cast("double").alias("shap"),
                value.alias("value"),
            )
        )
    return F.array(*items)


def text_attributions() -> Column:
    """Terms of a second linear surrogate in which all features count; its signs turn round for odd loans,
    so that every template is met on both sides."""
    way = F.when(F.col("loan_id") % 2 == 0, F.lit(1.0)).otherwise(F.lit(-1.0))
    linear = {f: (c, b) for f, c, b in K.TEXT_TERMS}
    items = []
    for i, f in enumerate(K.ALL_FEATURES):
        if f == "home_ownership":
            shap, value = F.when(F.col(f).isin("OWN", "MORTGAGE"), F.lit(K.TEXT_HOME)).otherwise(F.lit(-K.TEXT_HOME)), F.lit(None).cast("double")
        else:
            value = F.col(f).cast("double")
            shap = F.coalesce(F.lit(linear[f][0]) * (value - F.lit(linear[f][1])), F.lit(K.TEXT_MISSING))
        items.append(F.struct(F.lit(i).alias("idx"), F.lit(f).alias("feature"), (way * shap).alias("shap"), value.alias("value")))
    return F.array(*items)
