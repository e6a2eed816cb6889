"""SCL-17: weighted distance from the average defaulter."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from kreditflow.functions.numeric import double, pround_plain, pround_sql, text

from kreditflow import constants as K


def _value(feature: str) -> str:
    return f"coalesce(CAST({feature} AS DOUBLE), {double(K.DEFAULTER_PROFILE[feature])})"


def _clamped(feature: str) -> tuple[str, float]:
    """A feature's distance in -1..1 as SQL text, and its weight."""
    d, v, raw = K.DEFAULTER_PROFILE[feature], _value(feature), "0D"
    if d > 0:
        raw = f"({double(d)} - {v}) / {double(d)}" if feature in K.LOWER_IS_BETTER else f"({v} - {double(d)}) / {double(d)}"
    return f"greatest(-1D, least(1D, {raw}))", K.FEATURE_WEIGHTS.get(feature, 0.04)


def _term(feature: str) -> dict[str, str]:
    """Columns of a feature's term as SQL text."""
    d, v = K.DEFAULTER_PROFILE[feature], _value(feature)
    clamped, w = _clamped(feature)
    return {
        "feature": text(feature),
        "applicant_val": v,
        "defaulter_avg": double(d),
        "raw_distance": pround_sql(clamped, 4),
        "weighted": pround_sql(f"{clamped} * {double(w)}", 4),
        "better": f"{clamped} > 0",
    }


def distance_terms() -> Column:
    """Per-feature terms as ``array<struct<feature, applicant_val, defaulter_avg,
    raw_distance, weighted, better>>`` in profile order."""
    structs = ["named_struct(" + ", ".join(f"'{n}', {c}" for n, c in _term(f).items()) + ")" for f in K.DEFAULTER_PROFILE]
    return F.expr(f"array({', '.join(structs)})")


def distance_score() -> Column:
    """Sum of the 4-place rounded weighted terms, mapped to 0..1 and rounded."""
    total = " + ".join(_term(f)["weighted"] for f in K.DEFAULTER_PROFILE)
    return F.expr(pround_sql(f"(({total}) + 1D) / 2D", 4))


def distance_total() -> Column:
    """The same sum mapped to 0..1, not rounded: compiled where it is a column of its own (``distance_of``)."""
    terms = [pround_plain(f"({clamped} * {double(w)})", 4) for clamped, w in map(_clamped, K.DEFAULTER_PROFILE)]
    return F.expr(f"(({' + '.join(terms)}) + 1D) / 2D")


def distance_of(total: str) -> Column:
    """The distance score of a column that holds ``distance_total``."""
    return F.expr(pround_plain(f"`{total}`", 4))
