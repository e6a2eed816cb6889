"""Tiered decisions (DEC-01, DEC-02, DEC-10, DEC-11, SCL-22/23) and the
47-column decision record.

The core columns are one narrow plan per row, stored once.  The trial-loan
budget needs arrival order per pool: tier-3 rows are split off, budgeted, and
unioned back (a union is narrow; no join of the full table).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kreditflow.functions.numeric import pround

from kreditflow import constants as K
from kreditflow.functions import offers as OF
from kreditflow.functions.distance import distance_of, distance_total
from kreditflow.functions.text import min_plan, selected_reason
from kreditflow.functions.validation import is_valid, validation_errors
from kreditflow.operators import budget as B
from kreditflow.operators.narrative import add_narrative, decline_reasons, final_confidence
from kreditflow.session import scratch_path


def tier(repay_prob: Column, distance: Column) -> Column:
    """DEC-01."""
    return (
        F.when(repay_prob >= K.APPROVAL_THRESHOLD, F.lit(1))
        .when(distance >= K.DISTANCE_TIER2_THRESHOLD, F.lit(2))
        .when(distance >= K.DISTANCE_TIER3_THRESHOLD, F.lit(3))
        .otherwise(F.lit(4))
    )


def tier_label(t: Column) -> Column:
    expr = F.when(F.lit(False), F.lit(None))
    for k, v in K.TIER_LABELS.items():
        expr = expr.when(t == k, F.lit(v))
    return expr


#: Number of a row, given when the core is stored: ids may be missing or repeated.
ROW = "_row"
#: Order in which requests meet the budget.
ARRIVAL = ("decided_at", "loan_id", ROW)
CORE = ["model_version", "valid", "distance_score", "tier", "repay_probability", "offer_tier", "trial_amount", "decision"]


def core_columns(df: DataFrame, prob_col: str, model_version: Column) -> DataFrame:
    """The columns that every later filter, text and report reads (``CORE``).

    ``prob_col`` is the score used for the decision (calibrated when present).
    """
    p, tcol = F.col(prob_col), F.col("tier")
    out = df.withColumn("model_version", model_version)
    out = out.withColumn("valid", F.col("model_version").isNotNull() & is_valid(df))
    out = out.withColumn("_total", distance_total())  # a column of its own, so that it is compiled
    out = out.withColumn("distance_score", F.when(F.col("valid") & (p < K.APPROVAL_THRESHOLD), distance_of("_total"))).drop("_total")
    out = out.withColumn("tier", F.when(~F.col("valid"), F.lit(0)).otherwise(tier(p, F.col("distance_score"))))
    offer = F.when(tcol.isin(1, 2), OF.select_offer(tcol, p, F.col("distance_score"), F.col("annual_inc"), F.col("dti"))).when(tcol == 3, F.lit("A"))
    decision = (
        F.when(F.col("model_version").isNull(), F.lit("DECLINED"))
        .when(tcol == 0, F.lit("ERROR"))
        .when(tcol.isin(1, 2), F.lit("APPROVED"))
        .when(tcol == 3, F.lit("PENDING"))
        .otherwise(F.lit("DECLINED"))
    )
    return out.withColumns(
        {
            "repay_probability": F.when(F.col("valid"), pround(p, 4)),
            "offer_tier": offer,
            "trial_amount": F.when(tcol == 3, OF.trial_amount(F.col("distance_score"))),
            "decision": decision,
        }
    )


def store(df: DataFrame, name: str, by: str | None = None) -> DataFrame:
    """Write once to the shared folder and read back: later plans hold columns instead of expression trees.

    With ``by``, the last column, a filter on it reads the files of its values only."""
    path = scratch_path(df.sparkSession, name)
    (df.write.partitionBy(by) if by else df.write).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def decide_rows(df: DataFrame, prob_col: str, attr: str | Column, base_logit: Column, model_version: Column) -> DataFrame:
    """Per-row part of DEC-10: validation, tier, offer, narrative, reasons.

    The core columns are stored once; offers' terms, narrative and reasons are
    derived from them, and only for the rows and columns that a query reads.
    ``attr`` holds the attributions on the raw log-odds scale: a column's name, or
    an expression of the stored columns, which then is not stored.  Tier-3 rows
    get ``decision = 'PENDING'`` until the budget runs.
    """
    out = store(core_columns(df, prob_col, model_version).withColumn(ROW, F.monotonically_increasing_id()), "decision_core")
    attr_col = attr if isinstance(attr, str) else "attr"
    if not isinstance(attr, str):
        out = out.withColumn(attr_col, attr)
    has_model, tcol = F.col("model_version").isNotNull(), F.col("tier")
    has_offer = F.col("offer_tier").isNotNull()
    out = add_narrative(out, attr_col, base_logit, when=F.col("valid"))
    reasons = (
        F.when(~has_model, F.array(*[F.lit(r) for r in K.FAILSAFE_REASONS]))
        .when(tcol == 4, decline_reasons(F.col(attr_col)))
    )
    out = out.withColumns(
        {
            "applicant_id": F.col("loan_id").cast("string"),
            "validation_errors": validation_errors(df),
            "tier_label": F.when(~has_model, F.lit(K.SYSTEM_ERROR_LABEL)).otherwise(tier_label(tcol)),
            "offer_amount": F.when(has_offer, OF.amount_of(F.col("offer_tier"))),
            "offer_term": F.when(has_offer, OF.term_text(F.col("offer_tier"))),
            "offer_apr": F.when(has_offer, OF.apr_text(F.col("offer_tier"))),
            "monthly_payment": F.when(has_offer, OF.payment_of(F.col("offer_tier"))),
            "final_confidence": F.when(F.col("valid"), final_confidence(F.col(attr_col), base_logit)),
            "decline_reasons": reasons,
        }
    )
    return out.withColumn("model_version", F.coalesce(F.col("model_version"), F.lit("UNKNOWN"))).drop("valid")


def apply_budget(decided: DataFrame, budget: float = K.DEFAULT_POOL_BUDGET) -> DataFrame:
    """Resolve PENDING tier-3 rows through the pool budget (DEC-05).

    Only key columns go through the budget rounds (their checkpoints stay
    narrow and column pruning keeps working upstream); the result is joined back
    by row number to the tier-3 rows only, and unioned with the rest.
    """
    pending = F.col("decision") == "PENDING"
    rest = decided.filter(~pending).withColumns(
        {"budget_remaining": F.lit(None).cast("double"), "message": F.lit(None).cast("string")}
    )
    t3 = decided.filter(pending)
    res = B.approve_in_order(t3.select("pool_id", *ARRIVAL, "trial_amount"), budget=budget, order_cols=ARRIVAL)
    t3 = t3.join(res.select(ROW, "budget_status", "budget_remaining"), ROW).withColumns(
        {
            "decision": F.col("budget_status"),
            "message": B.budget_message(F.col("budget_status"), F.col("trial_amount"), F.col("budget_remaining")),
        }
    ).drop("budget_status")
    return rest.unionByName(t3).drop(ROW)


def decide(df: DataFrame, prob_col: str, attr: str | Column, base_logit: Column, model_version: Column, budget: float = K.DEFAULT_POOL_BUDGET) -> DataFrame:
    """DEC-10: the full decision for a batch of applicants."""
    return apply_budget(decide_rows(df, prob_col, attr, base_logit, model_version), budget)


LOG_FLOAT_PROFILE = ["dti", "revol_util", "pub_rec", "annual_inc", "emp_length", "open_acc", "mort_acc", "credit_history_years", "revol_bal"]


def decision_record(dec: DataFrame, extra: list[str] | None = None) -> DataFrame:
    """SCL-22/23 + JN-01 + DEC-08/09: the 47-column log record.

    Only model decisions are logged: validation errors are returned to the
    caller but never written.
    """
    plans = OF.plans_struct(F.coalesce(F.col("annual_inc"), F.lit(0.0)), F.coalesce(F.col("dti"), F.lit(0.0)))
    fits = {lab: plans[f"plan_{lab.lower()}_fits"] for lab, *_ in K.OFFERS}
    mp = min_plan(F.col("decision"), F.col("repay_probability"))
    cols = [
        F.coalesce(F.col("applicant_id"), F.lit("")).alias("applicant_id"),
        F.coalesce(F.date_format("decided_at", "yyyy-MM-dd'T'HH:mm:ss"), F.lit("")).alias("decided_at"),
        F.coalesce(F.col("decision"), F.lit("")).alias("decision"),
        F.coalesce(F.col("tier"), F.lit(0)).cast("int").alias("tier"),
        F.coalesce(F.col("tier_label"), F.lit("")).alias("tier_label"),
        F.coalesce(F.col("repay_probability"), F.lit(0.0)).alias("repay_probability"),
        F.col("distance_score").cast("double").alias("distance_score"),
        F.coalesce(F.col("model_version"), F.lit("")).alias("model_version"),
        F.col("offer_tier"),
        F.col("offer_amount").cast("double").alias("offer_amount"),
        F.col("offer_term"),
        F.col("offer_apr"),
        F.col("monthly_payment").cast("double").alias("monthly_payment"),
    ]
    for lab, *_ in K.OFFERS:
        p = lab.lower()
        cols += [plans[f"plan_{p}_amount"].alias(f"plan_{p}_amount"), plans[f"plan_{p}_monthly"].alias(f"plan_{p}_monthly"), plans[f"plan_{p}_fits"].alias(f"plan_{p}_fits")]
    cols += [
        plans["dti_headroom"].alias("dti_headroom"),
        selected_reason(F.col("decision"), F.col("offer_tier"), fits).alias("selected_reason"),
        mp["possible"].alias("min_plan_possible"),
        mp["amount"].alias("min_plan_amount"),
        mp["condition"].alias("min_plan_condition"),
        F.get(F.col("decline_reasons"), 0).alias("decline_reason_1"),
        F.get(F.col("decline_reasons"), 1).alias("decline_reason_2"),
        F.get(F.col("decline_reasons"), 2).alias("decline_reason_3"),
    ]
    cols += [F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in LOG_FLOAT_PROFILE]
    cols += [
        F.coalesce(F.col("home_ownership"), F.lit("")).alias("home_ownership"),
        F.coalesce(F.col("debt_burden"), F.lit(0.0)).alias("debt_burden"),
        F.coalesce(F.col("credit_utilization_pressure"), F.lit(0.0)).alias("credit_utilization_pressure"),
        F.coalesce(F.col("has_public_record"), F.lit(0)).cast("int").alias("has_public_record"),
        F.coalesce(F.col("high_dti_low_income"), F.lit(0)).cast("int").alias("high_dti_low_income"),
    ]
    cols += [F.col(c) for c in (extra or [])]
    return dec.filter(F.col("tier") > 0).select(*cols)


DECISION_LOG_COLUMNS = [
    "applicant_id", "decided_at", "decision", "tier", "tier_label", "repay_probability", "distance_score",
    "model_version", "offer_tier", "offer_amount", "offer_term", "offer_apr", "monthly_payment",
    "plan_a_amount", "plan_a_monthly", "plan_a_fits", "plan_b_amount", "plan_b_monthly", "plan_b_fits",
    "plan_c_amount", "plan_c_monthly", "plan_c_fits", "plan_d_amount", "plan_d_monthly", "plan_d_fits",
    "dti_headroom", "selected_reason", "min_plan_possible", "min_plan_amount", "min_plan_condition",
    "decline_reason_1", "decline_reason_2", "decline_reason_3",
    "dti", "revol_util", "pub_rec", "annual_inc", "emp_length", "open_acc", "mort_acc", "credit_history_years",
    "revol_bal", "home_ownership", "debt_burden", "credit_utilization_pressure", "has_public_record", "high_dti_low_income",
]
