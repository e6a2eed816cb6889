"""Model registry (SRC-13..15), stress profiles (DEC-12, AGG-31), model comparison (AGG-32)."""
import datetime as dt

from pyspark.sql import functions as F

from kreditflow import constants as K
from kreditflow.functions import features as FE
from kreditflow.operators import clean as C
from kreditflow.operators import decide as D
from kreditflow.operators import monitor as M
from kreditflow.session import scratch_path
from kreditflow.sources.decision_log import ModelRegistry

# FIXED VALUES: the twelve labelled stress profiles (label, expected, dti, revol_util, pub_rec,
# annual_inc, emp_length, open_acc, mort_acc, credit_history_years, revol_bal, home_ownership)
PROFILES = [
    ("Strong #1", "APPROVED", 10, 15, 0, 120000, 10, 7, 2, 18, 4000, "MORTGAGE"),
    ("Strong #2", "APPROVED", 8, 10, 0, 75000, 8, 6, 1, 14, 2000, "MORTGAGE"),
    ("Strong #3", "APPROVED", 12, 22, 0, 95000, 10, 9, 1, 20, 5000, "OWN"),
    ("Strong #4", "APPROVED", 18, 25, 0, 200000, 10, 12, 3, 22, 8000, "MORTGAGE"),
    ("Risky #1", "DECLINED", 42, 90, 3, 28000, 0, 16, 0, 2, 22000, "RENT"),
    ("Risky #2", "DECLINED", 38, 85, 2, 22000, 1, 14, 0, 3, 18000, "RENT"),
    ("Risky #3", "DECLINED", 35, 92, 1, 35000, 2, 18, 0, 4, 25000, "RENT"),
    ("Risky #4", "DECLINED", 45, 78, 2, 30000, 0, 20, 0, 1.5, 30000, "RENT"),
    ("Ambiguous #1", "AMBIGUOUS", 22, 68, 0, 80000, 6, 8, 1, 10, 12000, "MORTGAGE"),
    ("Ambiguous #2", "AMBIGUOUS", 25, 40, 0, 38000, 4, 5, 0, 7, 5000, "RENT"),
    ("Ambiguous #3", "AMBIGUOUS", 20, 45, 1, 70000, 7, 7, 1, 12, 7000, "MORTGAGE"),
    ("Ambiguous #4", "AMBIGUOUS", 28, 55, 0, 110000, 1, 10, 0, 8, 9000, "RENT"),
]
COLS = "label string, expected string, dti double, revol_util double, pub_rec double, annual_inc double, emp_length double, open_acc double, mort_acc double, credit_history_years double, revol_bal double, home_ownership string"


def test_stress_profiles_with_surrogate(spark):
    df = FE.add_engineered_rounded(spark.createDataFrame([tuple(float(v) if isinstance(v, int) else v for v in p) for p in PROFILES], COLS))
    df = df.withColumns({"loan_id": F.monotonically_increasing_id(), "pool_id": F.lit(0), "decided_at": F.lit(dt.datetime(2020, 1, 1)).cast("timestamp_ntz")})
    df = df.withColumns({"repay_prob": C.surrogate_prob(), "attr": C.surrogate_attributions()})
    dec = D.decide(df, "repay_prob", "attr", F.lit(C.surrogate_base_logit()), F.lit("surrogate-linear-1"))
    res = dec.select("label", "expected", F.when(F.col("decision") == "WAITLISTED", "APPROVED").otherwise(F.col("decision")).alias("decision"),
                     F.col("repay_probability").alias("repay_prob"))
    board = {r.expected: r for r in M.stress_scoreboard(res).collect()}
    assert board["APPROVED"].correct == 4 and board["DECLINED"].correct == 4
    assert board["AMBIGUOUS"].n == 4


def test_registry_active_and_rollback(spark):
    reg = ModelRegistry(spark, scratch_path(spark, "model_versions"))
    for v, auc, pr, ks, at, _ in K.REGISTRY_VERSIONS:
        reg.log_version(v, auc, pr, ks, dt.datetime.fromisoformat(at))
    assert reg.active().first()["version"] == "20260308_171525"
    reg.rollback("20260305_222037", dt.datetime(2026, 3, 9))
    assert reg.active().first()["version"] == "20260305_222037"
    cand = spark.createDataFrame([("cand", 0.9800)], "version string, roc_auc double")
    r = M.compare_models(cand, reg.table.read()).first()
    assert r.active_version == "20260305_222037" and r.verdict == "retrain" and r.improvement == 0.0059
