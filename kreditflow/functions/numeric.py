"""Rounding by the exact value of a double.

Spark's ``round`` and number formats round the shortest decimal text of a
double (``12.35`` -> ``12.4``); the decision rules round the binary value
(12.3499999... -> 12.3) and break exact ties to the even digit.  ``pround``
does so with plain IEEE arithmetic: it scales the value, recovers the error of
that product (a two-product by splitting the factors), and lets the error
decide where the scaled value lies exactly between two digits.
"""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Splits a double into two halves of 26 bits.
_SPLIT = 134217729.0


def computed_once(value: Column) -> Column:
    """The same value, which filters and generators above it read instead of repeating its expression.

    The optimizer moves conditions below a projection by copying the columns'
    expressions into them, but never copies what is not deterministic.
    """
    return F.when(F.monotonically_increasing_id() >= 0, value)


def double(x: float) -> str:
    """A double as SQL text."""
    return f"{float(x)!r}D"


def text(s: str) -> str:
    """A string as SQL text."""
    return "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"


@lru_cache(maxsize=None)
def _rounding(places: int) -> str:
    """The rounding of one value as a lambda.

    Where the scaled value does not end in exactly a half, the nearest whole number is right as it is.
    """
    m = 10.0**places
    m_hi = (_SPLIT * m) - ((_SPLIT * m) - m)
    m_lo = m - m_hi
    y, t = f"(v * {double(m)})", f"(v * {double(_SPLIT)})"
    high = f"({t} - ({t} - v))"
    low = f"(v - {high})"
    error = f"(({high} * {double(m_hi)} - {y}) + {low} * {double(m_hi)})"
    if m_lo:
        error = f"((({high} * {double(m_hi)} - {y}) + {high} * {double(m_lo)} + {low} * {double(m_hi)}) + {low} * {double(m_lo)})"
    whole = f"CAST(floor({y}) AS DOUBLE)"
    odd = f"({whole} - floor({whole} / 2D) * 2D <> 0D)"
    up = f"{error} > 0D OR ({error} = 0D AND {odd})"
    # beyond 2^52 / m a double has no such digits
    return (
        f"v -> CASE WHEN v IS NULL THEN CAST(NULL AS DOUBLE) WHEN isnan(v) OR abs({y}) >= {double(2.0**52)} THEN v "
        f"WHEN {y} - floor({y}) <> 0.5D THEN (rint({y}) + 0D) / {double(m)} ELSE ({whole} + CASE WHEN {up} THEN 1D ELSE 0D END) / {double(m)} END"
    )


def given(value: Column, body: str) -> Column:
    """``body``, a lambda in SQL text, of ``value``, which appears in the plan once.

    Text is parsed by the JVM in one call; the same tree built from Python columns takes a call for every node.
    """
    return F.call_function("transform", F.array(value), F.expr(body))[0]


def pround(x: Column | str, places: int = 0) -> Column:
    return given((F.col(x) if isinstance(x, str) else x).cast("double"), _rounding(places))


def pround_sql(x: str, places: int = 0) -> str:
    """``pround`` of SQL text as SQL text."""
    return f"get(transform(array(CAST({x} AS DOUBLE)), {_rounding(places)}), 0)"


def pround_plain(x: str, places: int = 0) -> str:
    """``pround_sql`` of a short double ``x``, which is repeated in the text: compiled with its projection, and folded where ``x``
    is constant.  Only halves, missing values and those beyond all digits take the lambda."""
    m = double(10.0**places)
    return (
        f"CASE WHEN {x} * {m} - floor({x} * {m}) <> 0.5D AND abs({x} * {m}) < {double(2.0**52)} "
        f"THEN (rint({x} * {m}) + 0D) / {m} ELSE {pround_sql(x, places)} END"
    )
