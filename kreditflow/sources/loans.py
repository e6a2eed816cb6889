"""The loan table derived from orders and customers.

One row per order joined to its customer.  Every column is an integer or a
single IEEE operation on the order key ``k`` so that any SQL engine computes
the same values.  The expressions are FIXED VALUES of the fixture definition.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kreditflow.session import input_state
from kreditflow.sources.tables import read_table

# FIXED VALUES: fixture derivation (k = o_orderkey)
LOAN_COLUMNS = {
    "loan_id": "k",
    "pool_id": "c_nationkey",
    "decided_at": "o_orderdate",
    "loan_status": (
        "CASE WHEN o_orderstatus = 'P' THEN 'Current' "
        "WHEN (k*7919)%4500 + (k*3571)%3000 < 4600 THEN 'Fully Paid' ELSE 'Charged Off' END"
    ),
    "grade": "substr('ABCDEFG', CAST(1 + k%7 AS INT), 1)",
    "dti": "CASE WHEN k%101 = 0 THEN NULL ELSE CAST((k*7919)%4500 AS DOUBLE)/100 END",
    "revol_util": "CASE WHEN k%97 = 0 THEN NULL ELSE CAST((k*104729)%10000 AS DOUBLE)/100 END",
    "pub_rec": "CAST(CASE WHEN (k*31)%20 < 16 THEN 0 ELSE (k*31)%20 - 15 END AS DOUBLE)",
    "annual_inc": "CAST(8000 + floor(o_totalprice/4) AS DOUBLE)",
    "open_acc": "CAST(1 + (k*17)%25 AS DOUBLE)",
    "mort_acc": "CASE WHEN k%11 = 0 THEN NULL ELSE CAST((k*13)%6 AS DOUBLE) END",
    "revol_bal": "CAST((k*613)%40000 AS DOUBLE)",
    "emp_length": (
        "CASE k%13 WHEN 0 THEN '< 1 year' WHEN 1 THEN '1 year' WHEN 10 THEN '10+ years' "
        "WHEN 11 THEN NULL WHEN 12 THEN 'n/a' ELSE concat(CAST(k%13 AS STRING), ' years') END"
    ),
    "home_ownership": (
        "CASE WHEN k%211 = 0 THEN NULL ELSE CASE k%8 WHEN 0 THEN 'OWN' WHEN 1 THEN 'OTHER' "
        "WHEN 2 THEN 'RENT' WHEN 3 THEN 'RENT' WHEN 4 THEN 'RENT' WHEN 5 THEN 'NONE' ELSE 'MORTGAGE' END END"
    ),
    "issue_d": "date_format(o_orderdate, 'MMM-yyyy')",
    "earliest_cr_line": (
        "CASE WHEN k%89 = 0 THEN 'unknown' "
        "ELSE date_format(add_months(o_orderdate, -CAST(12 + k%400 AS INT)), 'MMM-yyyy') END"
    ),
}


def loans_state(spark: SparkSession, sf_dir: str) -> tuple:
    """The session and the state of the files that ``loans`` reads: a key for what is derived from them once."""
    return (spark.sparkContext.applicationId, *input_state(spark, *(f"{sf_dir.rstrip('/')}/{t}.parquet" for t in ("orders", "customer"))))


def loans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw loan applications: ``orders JOIN customer`` plus the fixture columns.

    Only five order columns and two customer columns are scanned.  The join is
    an equi-join on the customer key; Catalyst broadcasts the customer side only
    when its measured size is under ``autoBroadcastJoinThreshold`` and otherwise
    sort-merges, and AQE splits a skewed customer key at runtime.
    """
    o = read_table(spark, sf_dir, "orders", ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate"])
    c = read_table(spark, sf_dir, "customer", ["c_custkey", "c_nationkey"])
    j = o.join(c, o.o_custkey == c.c_custkey, "inner").withColumn("k", F.col("o_orderkey"))
    return j.select(*[F.expr(e).alias(n) for n, e in LOAN_COLUMNS.items()])
