"""Decision texts: narrative notes, minimum-plan path, selection reason.

Numbers are rounded first, by their exact value, and formatted second, so the
printed digit does not depend on how a formatter breaks ties.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from kreditflow.functions.numeric import double, pround, pround_sql, text

from kreditflow import constants as K


def fmt_1f(v: Column) -> Column:
    return F.format_string("%.1f", pround(v, 1))


def fmt_0f(v: Column) -> Column:
    return F.format_string("%.0f", pround(v, 0))


def fmt_comma(v: Column) -> Column:
    return F.format_number(pround(v, 0), 0)


def fmt_pct(v: Column) -> Column:
    return F.format_string("%.1f", pround(v * F.lit(100), 1))


FORMATS = {
    "1f": lambda v: f"format_string('%.1f', {pround_sql(v, 1)})",
    "0f": lambda v: f"format_string('%.0f', {pround_sql(v, 0)})",
    "comma": lambda v: f"format_number({pround_sql(v, 0)}, 0)",
    "pct": lambda v: f"format_string('%.1f', {pround_sql(f'{v} * 100D', 1)})",
}


def _filled(template: str, kind: str, value: str) -> str:
    """A template with its number; templates without one are plain text."""
    if "{v}" not in template:
        return text(template)
    before, after = template.split("{v}", 1)
    return f"concat({text(before)}, {FORMATS[kind](value)}, {text(after)})"


def note_sql(feature: str, shap: str, value: str) -> str:
    """SCL-21: note of one feature as SQL text; its templates and number format are known while the plan is built.

    Special cases: employment of zero years, utilisation pressure below 0.30 on
    the negative side, a neutral note for zero attribution, and a generic note
    when a value that the template needs is missing.
    """
    if feature not in K.NOTE_FORMATS:
        pos, neg = text(f"{feature} contributed positively"), text(f"{feature} raised concern")
    else:
        kind = K.NOTE_FORMATS[feature]
        pos = _filled(K.POSITIVE_TEMPLATES[feature], kind, value)
        neg = _filled(K.NEGATIVE_TEMPLATES[feature], kind, value)
        special = feature in ("emp_length", "credit_utilization_pressure")
        if feature == "emp_length":
            pos = f"CASE WHEN {value} = 0 THEN {text(K.EMP_ZERO_POSITIVE)} ELSE {pos} END"
            neg = f"CASE WHEN {value} = 0 THEN {text(K.EMP_ZERO_NEGATIVE)} ELSE {neg} END"
        if feature == "credit_utilization_pressure":
            neg = f"CASE WHEN {value} < {double(K.PRESSURE_SPLIT)} THEN {_filled(K.PRESSURE_MANAGEABLE, kind, value)} ELSE {neg} END"
        if special or "{v}" in K.POSITIVE_TEMPLATES[feature]:
            pos = f"CASE WHEN {value} IS NULL THEN {text(f'{feature} contributed positively')} ELSE {pos} END"
        if special or "{v}" in K.NEGATIVE_TEMPLATES[feature]:
            neg = f"CASE WHEN {value} IS NULL THEN {text(f'{feature} contributed negatively')} ELSE {neg} END"
    return f"CASE WHEN {shap} > 0 THEN {pos} WHEN {shap} < 0 THEN {neg} ELSE {text(f'{feature} had negligible impact')} END"


def min_plan(decision: Column, repay_prob: Column) -> Column:
    """DEC-08: minimum-plan path for declined applicants.

    Returns ``struct<possible boolean, amount double, condition string>``;
    all NULL unless the decision is DECLINED.
    """
    dti = F.coalesce(F.col("dti"), F.lit(100.0))
    ru = F.coalesce(F.col("revol_util"), F.lit(100.0))
    pub = F.coalesce(F.col("pub_rec"), F.lit(0.0))
    inc = F.coalesce(F.col("annual_inc"), F.lit(0.0))
    p = F.coalesce(repay_prob, F.lit(0.0))
    conds = F.array_compact(
        F.array(
            F.when(dti > K.MIN_PLAN_DTI, F.concat(F.lit(f"reduce debt-to-income ratio below {K.MIN_PLAN_DTI}% (currently "), fmt_1f(dti), F.lit("%)"))),
            F.when(ru > K.MIN_PLAN_REVOL_UTIL, F.concat(F.lit(f"reduce credit utilisation below {K.MIN_PLAN_REVOL_UTIL}% (currently "), fmt_1f(ru), F.lit("%)"))),
            F.when(p < K.MIN_PLAN_PROB, F.lit("improve overall credit profile")),
        )
    )
    amt = f"${K.MIN_PLAN_AMOUNT:.0f}"
    declined = decision == "DECLINED"
    blocked_pub = pub >= K.MIN_PLAN_BLOCK_PUB_REC
    blocked_inc = inc < K.MIN_PLAN_BLOCK_INCOME
    possible = F.when(~declined, F.lit(None).cast("boolean")).when(blocked_pub | blocked_inc, F.lit(False)).otherwise(F.lit(True))
    amount = F.when(declined & ~blocked_pub & ~blocked_inc, F.lit(K.MIN_PLAN_AMOUNT))
    condition = (
        F.when(~declined, F.lit(None).cast("string"))
        .when(blocked_pub, F.lit("Multiple derogatory public records prevent approval at any amount"))
        .when(blocked_inc, F.lit("Income is too low to support any loan repayment"))
        .when(F.size(conds) == 0, F.lit(f"A minimum trial loan of {amt} may be possible once repayment probability improves above 75%"))
        .otherwise(F.concat(F.lit(f"A minimum loan of {amt} may be possible if you: "), F.array_join(conds, " and ")))
    )
    return F.struct(possible.alias("possible"), amount.alias("amount"), condition.alias("condition"))


def selected_reason(decision: Column, offer_tier: Column, fits: dict[str, Column]) -> Column:
    """DEC-09: why the offer was chosen (WAITLISTED counts as declined)."""
    not_fit = F.array_compact(F.array(*[F.when(~c, F.lit(lab)) for lab, c in fits.items()]))
    return (
        F.when(
            (decision == "APPROVED") & (F.size(not_fit) > 0),
            F.concat(F.lit("Offer "), F.coalesce(offer_tier, F.lit("None")), F.lit(" selected — Offer(s) "), F.array_join(not_fit, ", "), F.lit(" exceeded monthly affordability")),
        )
        .when(decision == "APPROVED", F.concat(F.lit("Offer "), F.coalesce(offer_tier, F.lit("None")), F.lit(" selected based on repay probability tier")))
        .otherwise(F.lit("No offer — application declined"))
    )
