"""Golden values and scalar rules."""
import pytest
from pyspark.sql import functions as F

from kreditflow.functions import text as TX

from kreditflow import constants as K
from kreditflow.functions import offers as OF
from kreditflow.functions.distance import distance_score
from kreditflow.functions.numeric import pround
from kreditflow.functions.text import min_plan
from kreditflow.functions.validation import validation_errors

TIER4 = {"dti": 38.0, "revol_util": 82.0, "pub_rec": 2.0, "annual_inc": 32000.0, "emp_length": 1.0, "open_acc": 14.0,
         "mort_acc": 0.0, "credit_history_years": 3.0, "revol_bal": 18000.0}


def one(spark, **cols):
    return spark.createDataFrame([tuple(cols.values())], list(cols.keys()))


def test_offer_payments_golden(spark):
    row = spark.range(1).select(*[OF.offer_payment(l).alias(l) for l in "ABCD"]).first()
    assert (row.A, row.B, row.C, row.D) == (85.53, 88.85, 121.22, 183.28)


@pytest.mark.parametrize("inc,dti,room", [(85000, 12.5, 1947.92), (78000, 13.0, 1755.00), (55000, 19.0, 962.50), (32000, 38.0, 53.33)])
def test_headroom_golden(spark, inc, dti, room):
    r = one(spark, inc=float(inc), dti=dti).select(pround(OF.headroom(F.col("inc"), F.col("dti")), 2).alias("h")).first()
    assert r.h == room


def test_distance_golden(spark):
    assert one(spark, **TIER4).select(distance_score().alias("d")).first().d == 0.2146


@pytest.mark.parametrize("p,inc,dti,expected", [(0.8664, 85000.0, 12.5, "D"), (0.9341, 78000.0, 13.0, "D"), (0.8353, 55000.0, 19.0, "C")])
def test_offer_choice_golden(spark, p, inc, dti, expected):
    df = one(spark, p=p, inc=inc, dti=dti)
    r = df.select(OF.select_offer(F.lit(1), F.col("p"), F.lit(None).cast("double"), F.col("inc"), F.col("dti")).alias("o")).first()
    assert r.o == expected


def test_min_plan_tier4_text(spark):
    df = one(spark, **{**TIER4, "decision": "DECLINED", "p": 0.52})
    r = df.select(min_plan(F.col("decision"), F.col("p")).alias("m")).first().m
    assert r.possible is True and r.amount == 300.0
    assert r.condition == ("A minimum loan of $300 may be possible if you: reduce debt-to-income ratio below 35% (currently 38.0%) "
                           "and reduce credit utilisation below 80% (currently 82.0%) and improve overall credit profile")


def test_validation_messages(spark):
    cols = {f: 1.0 for f in K.REQUIRED_FIELDS if f != "home_ownership"}
    cols.update(dti=250.0, annual_inc=500.0, home_ownership="rent", mort_acc=None)
    df = spark.createDataFrame([tuple(cols.values())], "dti double, revol_util double, pub_rec double, annual_inc double, debt_burden double, "
                               "credit_utilization_pressure double, has_public_record double, high_dti_low_income double, emp_length double, "
                               "open_acc double, mort_acc double, credit_history_years double, revol_bal double, home_ownership string")
    errs = df.select(validation_errors(df).alias("e")).first().e
    assert errs == [
        "Missing required field: mort_acc",
        "dti value 250.0 is outside valid range [0, 200]",
        "annual_inc value 500.0 is outside valid range [1000, 10000000]",
    ]


def test_pround_and_formats_equal_python(spark):
    """Both fixture grids, ties, and values between two digits, as Python rounds and prints them."""
    values = [i / 100 for i in range(10_000)] + [i / 8 for i in range(-80, 80)] + [i / 1000 for i in range(3000)] + [1254.715, -0.125, 12.25, 12.35, 1.115, 1e300]
    df = spark.createDataFrame([(v,) for v in values], "v double").repartition(4)
    for places in (0, 1, 2, 4, 6):
        assert all(r.r == round(r.v, places) for r in df.select("v", pround("v", places).alias("r")).collect())
    small = df.filter("v >= 0 AND v < 1e15")
    for r in small.select("v", TX.fmt_1f(F.col("v")).alias("a"), TX.fmt_0f(F.col("v")).alias("b"), TX.fmt_comma(F.col("v")).alias("c"), TX.fmt_pct(F.col("v")).alias("d")).collect():
        assert (r.a, r.b, r.c, r.d) == (f"{r.v:.1f}", f"{r.v:.0f}", f"{r.v:,.0f}", f"{r.v * 100:.1f}")
    odd = spark.createDataFrame([(None,), (float("nan"),)], "v double").select(pround("v", 2).alias("r")).collect()
    assert odd[0].r is None and odd[1].r != odd[1].r


def test_correlations_with_missing_and_constant_columns(spark):
    """Pairwise-complete correlations against numpy; NULL where a column does not vary or has no pair."""
    import random

    import numpy as np

    from kreditflow.operators import profile as P

    rnd = random.Random(1)
    rows = [(rnd.gauss(1e6, 3.0), None if rnd.random() < 0.3 else rnd.random(), 0.1, None, float(i % 2)) for i in range(500)]
    cols = ["dti", "b", "c", "d", "e"]
    df = spark.createDataFrame(rows, ", ".join(f"{c} double" for c in cols)).repartition(3)
    got = {(r.f1, r.f2): r["corr"] for r in P.correlation_matrix(df, cols).collect()}
    assert len(got) == 25
    x = np.array([[np.nan if v is None else v for v in r] for r in rows])
    for i, a in enumerate(cols):
        for j, b in enumerate(cols):
            both = ~np.isnan(x[:, i]) & ~np.isnan(x[:, j])
            if {a, b} & {"c", "d"}:
                assert got[a, b] is None
            else:
                assert abs(got[a, b] - np.corrcoef(x[both, i], x[both, j])[0, 1]) < 2e-6
