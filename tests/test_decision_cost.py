"""What a decided row costs: nothing is stored that can be derived, and constants and plain roundings hold no lambda."""
import math
import random
from decimal import ROUND_HALF_EVEN, Decimal

from pyspark.sql import functions as F

from kreditflow import constants as K
from kreditflow.functions import offers as OF
from kreditflow.functions.distance import distance_of, distance_score, distance_total
from kreditflow.functions.numeric import pround, pround_plain
from kreditflow.operators import clean as C
from kreditflow.operators import decide as D


def optimized(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_plain_rounding_follows_the_exact_value(spark):
    rnd = random.Random(5)
    xs = [rnd.uniform(-2, 2) for _ in range(2000)] + [rnd.uniform(-1e6, 1e6) for _ in range(500)] + [i / 8 for i in range(-40, 41)]
    xs += [i / 100 + 0.005 for i in range(-300, 300)] + [-0.0, -1e-20, 0.49999999999999994, -0.49999999999999994, 2.0**52, 1e300, math.inf, -math.inf]
    df = spark.createDataFrame([(x,) for x in xs] + [(math.nan,), (None,)], "x double").coalesce(1)
    for places in (0, 2, 4):
        got = df.select("x", pround("x", places).alias("a"), F.expr(pround_plain("x", places)).alias("b")).collect()
        for x, a, b in got:
            if x is None or math.isnan(x):
                assert (a is None and b is None) if x is None else (math.isnan(a) and math.isnan(b))
                continue
            want = x if abs(x) >= 2.0**52 / 10**places else float(Decimal(x).quantize(Decimal(1).scaleb(-places), ROUND_HALF_EVEN))
            assert a == b == want and math.copysign(1, a) == math.copysign(1, b), (x, places, a, b, want)


def test_payments_of_fixed_offers_are_constants(spark):
    plan = optimized(spark.range(5).select(*[OF.offer_payment(x).alias(x) for x in OF.OFFER_LABELS]))
    assert "lambda" not in plan and "POWER" not in plan.upper()


def test_distance_of_the_total_is_the_distance_score(spark):
    rnd = random.Random(6)
    rows = [tuple(None if rnd.random() < 0.1 else rnd.uniform(0, 2) * d for d in K.DEFAULTER_PROFILE.values()) for _ in range(500)]
    df = spark.createDataFrame(rows, ", ".join(f"{f} double" for f in K.DEFAULTER_PROFILE))
    got = df.withColumn("t", distance_total()).select(distance_score().alias("a"), distance_of("t").alias("b")).collect()
    assert all(r.a == r.b for r in got) and len({r.a for r in got}) > 100


def test_decisions_store_no_attributions_that_columns_give(spark, monkeypatch):
    stored = []
    keep = D.store
    monkeypatch.setattr(D, "store", lambda df, name: stored.append(df.columns) or keep(df, name))
    apps = C.applicants(spark, "/root/testdata/sf0.001").withColumn("repay_prob", C.surrogate_prob())
    args = (F.lit(C.surrogate_base_logit()), F.lit("m"))
    lean = D.decide_rows(apps, "repay_prob", C.surrogate_attributions(), *args)
    wide = D.decide_rows(apps.withColumn("attr", C.surrogate_attributions()), "repay_prob", "attr", *args)
    assert "attr" not in stored[0] and "attr" in stored[1]
    cols = ["loan_id", "tier", "distance_score", "offer_tier", "attr", "narrative", "decline_reasons", "final_confidence", "monthly_payment"]
    assert sorted(map(str, lean.select(*cols).collect())) == sorted(map(str, wide.select(*cols).collect()))
