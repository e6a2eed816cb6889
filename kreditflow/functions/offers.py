"""Offer arithmetic: payments, affordability headroom, ladders, offer texts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from kreditflow.functions.numeric import double, pround, pround_plain

from kreditflow import constants as K

OFFER_LABELS = [o[0] for o in K.OFFERS]
OFFER_BY_LABEL = {o[0]: o for o in K.OFFERS}


def monthly_payment(amount: Column, apr: Column, term_months: Column) -> Column:
    """SCL-15: annuity payment rounded to cents."""
    r = apr / F.lit(12)
    return pround(amount * r / (F.lit(1) - F.pow(F.lit(1) + r, -term_months)), 2)


def offer_payment(label: str) -> Column:
    """Payment of a fixed offer (constant-folded by Catalyst, which folds no lambda)."""
    _, amount, term, apr = OFFER_BY_LABEL[label]
    r = f"{double(apr)} / 12"
    return F.expr(pround_plain(f"({double(amount)} * ({r}) / (1 - pow(1 + {r}, -{double(term)})))", 2))


def _by_label(label: Column, value_of) -> Column:
    return reduce(lambda acc, lab: acc.when(label == lab, value_of(lab)), OFFER_LABELS[1:],
                  F.when(label == OFFER_LABELS[0], value_of(OFFER_LABELS[0])))


def payment_of(label: Column) -> Column:
    return _by_label(label, offer_payment)


def amount_of(label: Column) -> Column:
    return _by_label(label, lambda lab: F.lit(float(OFFER_BY_LABEL[lab][1])))


def term_text(label: Column) -> Column:
    """SCL-20: '36 months'."""
    return _by_label(label, lambda lab: F.lit(f"{OFFER_BY_LABEL[lab][2]} months"))


def apr_text(label: Column) -> Column:
    """SCL-20: '19%'."""
    return _by_label(label, lambda lab: F.format_string("%.0f%%", F.lit(OFFER_BY_LABEL[lab][3]) * F.lit(100)))


def headroom(annual_inc: Column, dti: Column) -> Column:
    """SCL-16: max(0, 40 % of monthly income minus existing monthly debt)."""
    monthly_inc = annual_inc / F.lit(12)
    existing = monthly_inc * (dti / F.lit(100))
    return F.greatest(F.lit(0.0), monthly_inc * F.lit(K.AFFORDABILITY_SHARE) - existing)


def trial_amount(distance_score: Column) -> Column:
    """SCL-19: trial-loan amount ladder by distance score."""
    (t1, a1), (t2, a2), (t3, a3) = K.TRIAL_LADDER
    return (
        F.when(distance_score >= t1, F.lit(a1))
        .when(distance_score >= t2, F.lit(a2))
        .when(distance_score >= t3, F.lit(a3))
        .otherwise(F.lit(K.TRIAL_FLOOR))
    )


def candidate_ladder(tier: Column, repay_prob: Column, distance_score: Column) -> Column:
    """Ordered candidate offers by tier and confidence (DEC-02)."""
    arr = lambda *xs: F.array(*[F.lit(x) for x in xs])
    return (
        F.when((tier == 1) & (repay_prob >= 0.85), arr("D", "C", "B", "A"))
        .when((tier == 1) & (repay_prob >= 0.75), arr("C", "B", "A"))
        .when((tier == 1) & (repay_prob >= 0.65), arr("B", "A"))
        .when(tier == 1, arr("A"))
        .when((tier == 2) & (distance_score >= 0.85), arr("C", "B"))
        .when(tier == 2, arr("B", "A"))
        .otherwise(arr("A"))
    )


def select_offer(tier: Column, repay_prob: Column, distance_score: Column, annual_inc: Column, dti: Column) -> Column:
    """DEC-02 / JN-05: first affordable candidate, else the smallest offer.

    A higher-order ``filter`` over at most four labels: no join, no shuffle.
    """
    room = headroom(annual_inc, dti)
    fits = F.filter(candidate_ladder(tier, repay_prob, distance_score), lambda lab: payment_of(lab) <= room)
    return F.coalesce(F.try_element_at(fits, F.lit(1)), F.lit("A"))


def plans_struct(annual_inc: Column, dti: Column) -> dict[str, Column]:
    """JN-01 wide form: amount, payment and fit per offer plus rounded headroom."""
    room = headroom(annual_inc, dti)
    out: dict[str, Column] = {}
    for lab, amount, _term, _apr in K.OFFERS:
        p = lab.lower()
        out[f"plan_{p}_amount"] = F.lit(float(amount))
        out[f"plan_{p}_monthly"] = offer_payment(lab)
        out[f"plan_{p}_fits"] = offer_payment(lab) <= room
    out["dti_headroom"] = pround(room, 2)
    return out


def offers_array() -> Column:
    """The offer ladder as an array of structs (for exploding to the long form)."""
    return F.array(
        *[
            F.struct(
                F.lit(lab).alias("offer"),
                F.lit(i + 1).alias("rank"),
                F.lit(float(amount)).alias("amount"),
                F.lit(term).alias("term_months"),
                F.lit(apr).alias("apr"),
            )
            for i, (lab, amount, term, apr) in enumerate(K.OFFERS)
        ]
    )
