"""Scalar feature expressions (cleaning and engineering).

All are native column expressions, so they stay inside whole-stage codegen.
NULL rules: a comparison on NULL is treated as False for flags (coalesce to
False), arithmetic on NULL stays NULL, unmapped text becomes NULL.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kreditflow.functions.numeric import pround

from kreditflow import constants as K


def flag(cond: Column) -> Column:
    """Null-safe 0/1 flag: a NULL comparison counts as False."""
    return F.coalesce(cond, F.lit(False)).cast("int")


def parse_month_year(c: Column) -> Column:
    """SCL-01: tolerant 'Mon-YYYY' parse; unparsable text gives NULL."""
    return F.try_to_date(c, "MMM-yyyy")


def years_between(later: Column, earlier: Column) -> Column:
    """SCL-02: whole days between two dates divided by 365."""
    return F.datediff(later, earlier) / F.lit(365)


def credit_history_years(issue_d: Column, earliest_cr_line: Column, reference_date: str | None = None) -> Column:
    """SCL-02 / SCL-03: credit history in years.

    Default measures to the issue date; ``reference_date`` gives the fixed-date
    variant (e.g. '2020-01-01').
    """
    earliest = parse_month_year(earliest_cr_line)
    later = F.to_date(F.lit(reference_date)) if reference_date else parse_month_year(issue_d)
    return years_between(later, earliest)


def emp_length_years(c: Column) -> Column:
    """SCL-04: employment text to 0..10; anything unmapped is NULL."""
    m = F.create_map(*[x for k, v in K.EMP_LENGTH_MAP.items() for x in (F.lit(k), F.lit(v))])
    return F.try_element_at(m, c).cast("double")


def debt_burden(dti: Column, annual_inc: Column) -> Column:
    """SCL-05: monthly debt payments in money."""
    return dti / F.lit(100) * annual_inc / F.lit(12)


def utilization_pressure(revol_bal: Column, annual_inc: Column, plus_one: bool = True) -> Column:
    """SCL-06: revolving balance over income (+1 guard by default)."""
    return revol_bal / (annual_inc + F.lit(1)) if plus_one else revol_bal / annual_inc


def has_public_record(pub_rec: Column) -> Column:
    """SCL-07."""
    return flag(pub_rec > 0)


def thin_file(history_years: Column, open_acc: Column) -> Column:
    """SCL-08."""
    return flag((history_years < 5) & (open_acc < 4))


def high_dti_low_income(dti: Column, annual_inc: Column) -> Column:
    """SCL-09."""
    return flag((dti > 30) & (annual_inc < 50000))


def drop_leaky(df: DataFrame) -> DataFrame:
    """PRJ-01: drop leakage columns that are present (absent names ignored)."""
    return df.drop(*K.LEAKY_COLUMNS)


def known_outcomes(df: DataFrame, status_col: str = "loan_status") -> DataFrame:
    """FLT-01 + PRJ-03: keep resolved loans and add ``target``."""
    return df.filter(F.col(status_col).isin(*K.KNOWN_STATUSES)).withColumn(
        "target", (F.col(status_col) == K.REPAID_STATUS).cast("int")
    )


def engineer(df: DataFrame, reference_date: str | None = None, keep: list[str] | None = None) -> DataFrame:
    """SCL-01..09 + PRJ-02 over a raw loan frame with target already set.

    Returns the features plus ``thin_file``; raw date and status columns are
    dropped once used.  ``keep`` lists extra pass-through columns.
    """
    chy = credit_history_years(F.col("issue_d"), F.col("earliest_cr_line"), reference_date)
    out = (
        df.withColumn("credit_history_years", chy)
        .withColumn("emp_length", emp_length_years(F.col("emp_length")))
        .withColumn("debt_burden", debt_burden(F.col("dti"), F.col("annual_inc")))
        .withColumn("credit_utilization_pressure", utilization_pressure(F.col("revol_bal"), F.col("annual_inc")))
        .withColumn("has_public_record", has_public_record(F.col("pub_rec")))
        .withColumn("thin_file", thin_file(F.col("credit_history_years"), F.col("open_acc")))
        .withColumn("high_dti_low_income", high_dti_low_income(F.col("dti"), F.col("annual_inc")))
    )
    cols = (keep or []) + K.ALL_FEATURES + ["thin_file", "target"]
    return out.select(*cols)


def add_engineered_rounded(df: DataFrame) -> DataFrame:
    """SCL-10: engineered columns for hand-entered profiles, rounded to 2 and 3 places."""
    return df.withColumns(
        {
            "debt_burden": pround(debt_burden(F.col("dti"), F.col("annual_inc")), 2),
            "credit_utilization_pressure": pround(utilization_pressure(F.col("revol_bal"), F.col("annual_inc")), 3),
            "has_public_record": has_public_record(F.col("pub_rec")),
            "high_dti_low_income": high_dti_low_income(F.col("dti"), F.col("annual_inc")),
        }
    )


def nan_to_null(df: DataFrame, cols: list[str]) -> DataFrame:
    """NaN read from text counts as missing (Spark aggregates skip NULL, not NaN)."""
    return df.withColumns({c: F.nanvl(F.col(c), F.lit(None).cast("double")) for c in cols})
