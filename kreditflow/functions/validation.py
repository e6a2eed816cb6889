"""SCL-11..14: applicant validation as array-of-messages columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kreditflow import constants as K
from kreditflow.functions.numeric import text


def py_float_text(v: str) -> str:
    """Text of a double the way Python prints a float (``250.0``, ``12.5``)."""
    return f"CASE WHEN {v} = floor({v}) AND abs({v}) < 1E16D THEN concat(CAST(CAST(floor({v}) AS BIGINT) AS STRING), '.0') ELSE CAST({v} AS STRING) END"


def _numeric(df: DataFrame, field: str) -> tuple[str, str | None]:
    """(value as double, bad-number flag) for a numeric or text column; a number is never bad."""
    if isinstance(df.schema[field].dataType, T.StringType):
        v = f"try_cast(trim(`{field}`) AS DOUBLE)"
        return v, f"(`{field}` IS NOT NULL AND {v} IS NULL)"
    return f"CAST(`{field}` AS DOUBLE)", None


def validation_errors(df: DataFrame) -> Column:
    """All rule violations in rule order: presence, ranges, categories."""
    msgs: list[str] = []
    for f in K.REQUIRED_FIELDS:
        missing = text(f"Missing required field: {f}")
        msgs.append(f"CASE WHEN `{f}` IS NULL THEN {missing} END" if f in df.columns else missing)
    for f, (lo, hi) in K.VALID_RANGES.items():
        if f not in df.columns:
            continue
        v, bad = _numeric(df, f)
        not_number = f"WHEN {bad} THEN concat({text(f'{f} must be a number, got: ')}, CAST(`{f}` AS STRING)) " if bad else ""
        msgs.append(f"CASE {not_number}WHEN {v} < {lo} OR {v} > {hi} THEN concat({text(f'{f} value ')}, {py_float_text(v)}, {text(f' is outside valid range [{lo}, {hi}]')}) END")
    for f, allowed in K.VALID_CATEGORIES.items():
        if f not in df.columns:
            continue
        listing = "[" + ", ".join(f"'{a}'" for a in allowed) + "]"
        known = ", ".join(text(a) for a in allowed)
        msgs.append(f"CASE WHEN `{f}` IS NOT NULL AND upper(CAST(`{f}` AS STRING)) NOT IN ({known}) THEN concat({text(f'{f} must be one of {listing}, got: ')}, CAST(`{f}` AS STRING)) END")
    return F.expr(f"array_compact(array({', '.join(msgs)}))")


def is_valid(df: DataFrame) -> Column:
    """Same rules as ``validation_errors`` as one boolean (no message text),
    cheap enough to sit in pushed-down filters."""
    conds: list[str] = []
    for f in K.REQUIRED_FIELDS:
        if f not in df.columns:
            return F.lit(False)
        conds.append(f"`{f}` IS NOT NULL")
    for f, (lo, hi) in K.VALID_RANGES.items():
        v, bad = _numeric(df, f)
        conds.append((f"NOT {bad} AND " if bad else "") + f"{v} >= {lo} AND {v} <= {hi}")
    for f, allowed in K.VALID_CATEGORIES.items():
        conds.append(f"upper(CAST(`{f}` AS STRING)) IN ({', '.join(text(a) for a in allowed)})")
    return F.expr(f"coalesce({' AND '.join(conds)}, false)")


def with_validation(df: DataFrame) -> DataFrame:
    """SCL-14: attach ``validation_errors`` and ``is_valid``."""
    return df.withColumn("validation_errors", validation_errors(df)).withColumn(
        "is_valid", F.size("validation_errors") == 0
    )
