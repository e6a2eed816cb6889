"""Registered queries: one Spark plan per operator of the inventory, each with
an independent SQL statement for the value check where SQL can express it.

Every query reads the driver's tables (or data Spark derives from them) in
full; nothing is capped or sampled unless sampling is the operator.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kreditflow.functions.numeric import pround

from kreditflow import constants as K
from kreditflow import oracle as O
from kreditflow.functions import features as FE
from kreditflow.functions import offers as OF
from kreditflow.functions.distance import distance_score
from kreditflow.operators import budget as B
from kreditflow.operators import clean as C
from kreditflow.operators import decide as D
from kreditflow.operators import evaluate as E
from kreditflow.operators import monitor as M
from kreditflow.operators import profile as P
from kreditflow.operators import sampling as S
from kreditflow.plans import decisions as PD
from kreditflow.session import scratch_path
from kreditflow.sources import decision_log as L
from kreditflow.sources.loans import loans, loans_state
from kreditflow.sources.tables import write_clean

Q = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, tuple[Q, str | None]] = {}


def register(name: str, sql: str | None):
    def deco(fn: Q) -> Q:
        REGISTRY[name] = (fn, sql)
        return fn

    return deco


def _r6(c):
    return pround(c, 6)


# ============================================================ sources, projections
@register("src_01_loans", O.with_(O.LOANS) + "SELECT * FROM loans")
def src_01_loans(spark, sf):
    return loans(spark, sf)


@register("flt_01_known_outcomes", O.with_(O.LOANS) + "SELECT loan_id, loan_status, CAST(loan_status = 'Fully Paid' AS INTEGER) AS target FROM loans WHERE loan_status IN ('Fully Paid', 'Charged Off')")
def flt_01_known_outcomes(spark, sf):
    return FE.known_outcomes(loans(spark, sf)).select("loan_id", "loan_status", "target")


@register("src_02_clean_roundtrip", O.BASE + "SELECT * FROM clean")
def src_02_clean_roundtrip(spark, sf):
    """PRJ-01/02/04 + SCL-01..09 + SRC-03 sink + SRC-02 scan."""
    path = scratch_path(spark, "clean_loans")
    write_clean(C.clean_loans(spark, sf), path)
    return spark.read.parquet(path)


@register("scl_01_parse_dates", O.with_(O.LOANS) + "SELECT loan_id, CAST(try_strptime(issue_d, '%b-%Y') AS DATE) AS issue_date, CAST(try_strptime(earliest_cr_line, '%b-%Y') AS DATE) AS earliest_date FROM loans")
def scl_01_parse_dates(spark, sf):
    return loans(spark, sf).select("loan_id", FE.parse_month_year(F.col("issue_d")).alias("issue_date"), FE.parse_month_year(F.col("earliest_cr_line")).alias("earliest_date"))


@register("scl_02_credit_history", O.BASE + "SELECT loan_id, round(credit_history_years, 6) AS credit_history_years, thin_file FROM clean")
def scl_02_credit_history(spark, sf):
    return C.clean_loans(spark, sf).select("loan_id", _r6(F.col("credit_history_years")).alias("credit_history_years"), "thin_file")


@register("scl_03_credit_history_fixed_date", O.BASE_FIXED + "SELECT loan_id, round(credit_history_years, 6) AS credit_history_years FROM clean")
def scl_03_credit_history_fixed_date(spark, sf):
    return C.clean_loans(spark, sf, reference_date="2020-01-01").select("loan_id", _r6(F.col("credit_history_years")).alias("credit_history_years"))


@register("scl_04_emp_length", O.with_(O.LOANS) + f"SELECT loan_id, emp_length AS emp_text, CAST({O.EMP_CASE} AS DOUBLE) AS emp_years FROM loans")
def scl_04_emp_length(spark, sf):
    return loans(spark, sf).select("loan_id", F.col("emp_length").alias("emp_text"), FE.emp_length_years(F.col("emp_length")).alias("emp_years"))


ENG_SQL = "SELECT loan_id, round(debt_burden, 6) AS debt_burden, round(credit_utilization_pressure, 8) AS credit_utilization_pressure, has_public_record, thin_file, high_dti_low_income FROM clean"


@register("scl_05_09_engineered", O.BASE + ENG_SQL)
def scl_05_09_engineered(spark, sf):
    c = C.clean_loans(spark, sf)
    return c.select("loan_id", _r6(F.col("debt_burden")).alias("debt_burden"), pround("credit_utilization_pressure", 8).alias("credit_utilization_pressure"), "has_public_record", "thin_file", "high_dti_low_income")


@register("scl_10_rounded_profile_features", O.with_(O.LOANS) + "SELECT loan_id, round(dti/100*annual_inc/12, 2) AS debt_burden, round(revol_bal/(annual_inc+1), 3) AS credit_utilization_pressure, CAST(coalesce(pub_rec > 0, false) AS INTEGER) AS has_public_record, CAST(coalesce(dti > 30 AND annual_inc < 50000, false) AS INTEGER) AS high_dti_low_income FROM loans")
def scl_10_rounded_profile_features(spark, sf):
    return FE.add_engineered_rounded(loans(spark, sf)).select("loan_id", "debt_burden", "credit_utilization_pressure", "has_public_record", "high_dti_low_income")


# ============================================================ validation, offers, distance
@register("scl_11_14_validation", O.DEC + "SELECT loan_id, n_errors, n_errors = 0 AS is_valid FROM scored_all")
def scl_11_14_validation(spark, sf):
    from kreditflow.functions.validation import with_validation

    a = C.applicants(spark, sf)
    v = with_validation(a)
    return v.select("loan_id", F.size("validation_errors").alias("n_errors"), "is_valid")


def _validation_texts_sql() -> str:
    """Messages of the text form of the applications, in rule order."""
    num = {"dti": "TRY_CAST(dti_text AS DOUBLE)", "annual_inc": "inc"}
    parts = []
    for f in K.REQUIRED_FIELDS:
        col = {"dti": "dti_text", "annual_inc": "inc", "home_ownership": "home"}.get(f, f)
        parts.append(f"CASE WHEN {col} IS NULL THEN 'Missing required field: {f}' END")
    for f, (lo, hi) in K.VALID_RANGES.items():
        v = num.get(f, f"CAST({f} AS DOUBLE)")
        text = f"CASE WHEN {v} = floor({v}) THEN concat(CAST(CAST({v} AS BIGINT) AS VARCHAR), '.0') ELSE CAST({v} AS VARCHAR) END"
        bad = "WHEN dti_text IS NOT NULL AND TRY_CAST(dti_text AS DOUBLE) IS NULL THEN concat('dti must be a number, got: ', dti_text) " if f == "dti" else ""
        parts.append(f"CASE {bad}WHEN {v} < {lo} OR {v} > {hi} THEN concat('{f} value ', {text}, ' is outside valid range [{lo}, {hi}]') END")
    allowed = K.VALID_CATEGORIES["home_ownership"]
    listing = "[" + ", ".join(f"''{a}''" for a in allowed) + "]"
    parts.append(f"CASE WHEN home IS NOT NULL AND upper(home) NOT IN ({', '.join(repr(a) for a in allowed)}) THEN concat('home_ownership must be one of {listing}, got: ', home) END")
    return O.with_(O.LOANS, O.feats_cte()) + f""", x AS (SELECT *, CASE WHEN loan_id % 53 = 0 THEN 'n/a' WHEN loan_id % 59 = 0 THEN '250.5' ELSE CAST(dti AS VARCHAR) END AS dti_text,
  CASE WHEN loan_id % 61 = 0 THEN 500e0 ELSE annual_inc END AS inc, CASE WHEN loan_id % 67 = 0 THEN 'CASTLE' WHEN loan_id % 71 = 0 THEN 'rent' ELSE home_ownership END AS home FROM feats)
SELECT loan_id, concat_ws(' | ', {', '.join(parts)}) AS errors FROM x"""


@register("scl_11_13_validation_texts", _validation_texts_sql())
def scl_11_13_validation_texts(spark, sf):
    """Messages themselves, over applications as text: no numbers, values out of range, unknown categories."""
    from kreditflow.functions.validation import validation_errors

    k = F.col("loan_id")
    a = C.applicants(spark, sf).withColumns({
        "dti": F.when(k % 53 == 0, F.lit("n/a")).when(k % 59 == 0, F.lit("250.5")).otherwise(F.col("dti").cast("string")),
        "annual_inc": F.when(k % 61 == 0, F.lit(500.0)).otherwise(F.col("annual_inc")),
        "home_ownership": F.when(k % 67 == 0, F.lit("CASTLE")).when(k % 71 == 0, F.lit("rent")).otherwise(F.col("home_ownership")),
    })
    return a.select("loan_id", F.concat_ws(" | ", validation_errors(a)).alias("errors"))


@register("jn_01_plans_long", O.with_(O.LOANS, O.feats_cte()) + "SELECT loan_id, o.offer, o.amount, round(o.amount*(o.apr/12)/(1e0-pow(1e0+o.apr/12, -o.term_months)), 2) AS monthly, round(o.amount*(o.apr/12)/(1e0-pow(1e0+o.apr/12, -o.term_months)), 2) <= " + O.ROOM0 + " AS fits FROM feats CROSS JOIN (VALUES ('A', 500e0, 6e0, 0.09e0), ('B', 1000e0, 12e0, 0.12e0), ('C', 2500e0, 24e0, 0.15e0), ('D', 5000e0, 36e0, 0.19e0)) o(offer, amount, term_months, apr)")
def jn_01_plans_long(spark, sf):
    """JN-01 / SCL-15 / SCL-16: every applicant against every offer, as an
    ``explode`` of the four-offer array (a generator, no join)."""
    a = C.applicants(spark, sf)
    room = OF.headroom(F.coalesce("annual_inc", F.lit(0.0)), F.coalesce("dti", F.lit(0.0)))
    x = a.select("loan_id", room.alias("room"), F.explode(OF.offers_array()).alias("o"))
    pmt = OF.monthly_payment(F.col("o.amount"), F.col("o.apr"), F.col("o.term_months").cast("double"))
    return x.select("loan_id", F.col("o.offer").alias("offer"), F.col("o.amount").alias("amount"), pmt.alias("monthly"), (pmt <= F.col("room")).alias("fits"))


@register("scl_16_headroom", O.with_(O.LOANS, O.feats_cte()) + f"SELECT loan_id, round({O.ROOM0}, 2) AS dti_headroom FROM feats")
def scl_16_headroom(spark, sf):
    a = C.applicants(spark, sf)
    return a.select("loan_id", pround(OF.headroom(F.coalesce("annual_inc", F.lit(0.0)), F.coalesce("dti", F.lit(0.0))), 2).alias("dti_headroom"))


@register("scl_17_distance", O.DEC + "SELECT loan_id, dist AS distance_score FROM scored_all")
def scl_17_distance(spark, sf):
    return C.applicants(spark, sf).select("loan_id", distance_score().alias("distance_score"))


def _distance_terms_sql() -> str:
    parts = []
    for f, d in K.DEFAULTER_PROFILE.items():
        v = f"coalesce(CAST({f} AS DOUBLE), CAST('{d!r}' AS DOUBLE))"
        raw = f"(({d!r}e0 - {v})/{d!r}e0)" if f in K.LOWER_IS_BETTER else f"(({v} - {d!r}e0)/{d!r}e0)"
        c = f"greatest(-1e0, least(1e0, {raw}))"
        parts.append(f"SELECT loan_id, '{f}' AS feature, {v} AS applicant_val, {d!r}e0 AS defaulter_avg, round({c}, 4) AS raw_distance, round({c} * {K.FEATURE_WEIGHTS[f]!r}e0, 4) AS weighted, {c} > 0 AS better FROM feats")
    return "\nUNION ALL ".join(parts)


@register("scl_17_distance_terms", O.with_(O.LOANS, O.feats_cte()) + _distance_terms_sql())
def scl_17_distance_terms(spark, sf):
    from kreditflow.functions.distance import distance_terms

    return C.applicants(spark, sf).select("loan_id", F.explode(distance_terms()).alias("t")).select("loan_id", "t.*")


@register("scl_18_surrogate_score", O.DEC + "SELECT loan_id, repay_prob FROM scored_all")
def scl_18_surrogate_score(spark, sf):
    return C.applicants(spark, sf).select("loan_id", C.surrogate_prob().alias("repay_prob"))


# ============================================================ decisions
DEC_ROW_SQL = O.DEC + f"SELECT loan_id, tier, CASE WHEN tier > 0 THEN repay_prob END AS repay_probability, distance_score, offer_tier, {O.offer_cols_sql()}, trial_amount FROM dec1"


@register("dec_01_02_tier_offer", DEC_ROW_SQL)
def dec_01_02_tier_offer(spark, sf):
    d = PD.surrogate_decision_rows(spark, sf)
    return d.select("loan_id", "tier", "repay_probability", "distance_score", "offer_tier", "offer_amount", "offer_term", "offer_apr", "monthly_payment", "trial_amount")


@register("dec_03_narrative", O.NARR + "SELECT * FROM steps")
def dec_03_narrative(spark, sf):
    d = PD.surrogate_decision_rows(spark, sf).filter(F.col("tier") > 0)
    s = d.select("loan_id", F.explode("narrative").alias("s"))
    return s.select("loan_id", "s.step", "s.feature", "s.shap", "s.impact_pct", "s.running_prob", "s.value", "s.direction", "s.note")


@register("dec_03_narrative_all_terms", O.TEXTS + "SELECT * FROM steps")
def dec_03_narrative_all_terms(spark, sf):
    """WIN-02 / SCL-21 over all applications with a surrogate in which all 14 features count: every template and special case."""
    from kreditflow.operators.narrative import add_narrative

    a = C.applicants(spark, sf).withColumn("attr", C.text_attributions())
    s = add_narrative(a, "attr", F.lit(C.surrogate_base_logit())).select("loan_id", F.explode("narrative").alias("s"))
    return s.select("loan_id", "s.step", "s.feature", "s.shap", "s.impact_pct", "s.running_prob", "s.value", "s.direction", "s.note")


@register("dec_04_decline_reasons", O.NARR + "SELECT * FROM reasons")
def dec_04_decline_reasons(spark, sf):
    d = PD.surrogate_decision_rows(spark, sf).filter(F.col("tier") == 4)
    return d.select("loan_id", *[F.get("decline_reasons", i).alias(f"decline_reason_{i + 1}") for i in range(3)])


@register("dec_05_budget", O.DEC + "SELECT t.loan_id, t.pool_id, t.trial_amount, b.budget_status, b.budget_remaining FROM t3 t JOIN budget b ON t.loan_id = b.loan_id")
def dec_05_budget(spark, sf):
    rows = PD.surrogate_decision_rows(spark, sf).filter(F.col("tier") == 3)
    out = B.approve_in_order(rows.select("pool_id", *D.ARRIVAL, "trial_amount"), order_cols=D.ARRIVAL)
    return out.select("loan_id", "pool_id", "trial_amount", "budget_status", "budget_remaining")


@register("dec_05_budget_messages", O.DEC + """SELECT t.loan_id, CASE WHEN b.budget_status = 'APPROVED'
  THEN concat('Approved as Tier 3 trial loan — $', printf('%.0f', t.trial_amount), ' at 9% APR over 6 months. Budget remaining: $', format('{:,.2f}', b.budget_remaining))
  ELSE concat('Tier 3 budget currently exhausted ($', printf('%.2f', b.budget_remaining), ' remaining, need $', printf('%.0f', t.trial_amount), '). You have been added to the waitlist and will be reconsidered as repayments come in.') END AS message
FROM t3 t JOIN budget b ON t.loan_id = b.loan_id""")
def dec_05_budget_messages(spark, sf):
    return PD.surrogate_decisions(spark, sf).filter(F.col("tier") == 3).select("loan_id", "message")


@register("agg_30_budget_status", O.DEC + "SELECT t.pool_id, 10000e0 AS total_budget, round(sum(CASE WHEN b.budget_status = 'APPROVED' THEN t.trial_amount ELSE 0e0 END), 2) AS amount_deployed, round(10000e0 - sum(CASE WHEN b.budget_status = 'APPROVED' THEN t.trial_amount ELSE 0e0 END), 2) AS remaining, count(*) FILTER (WHERE b.budget_status = 'APPROVED') AS approved, count(*) FILTER (WHERE b.budget_status <> 'APPROVED') AS waitlisted FROM t3 t JOIN budget b ON t.loan_id = b.loan_id GROUP BY t.pool_id")
def agg_30_budget_status(spark, sf):
    rows = PD.surrogate_decision_rows(spark, sf).filter(F.col("tier") == 3)
    out = B.approve_in_order(rows.select("pool_id", *D.ARRIVAL, "trial_amount"), order_cols=D.ARRIVAL)
    return B.status_from_requests(out)


@register("dec_10_decision_summary", O.DEC + "SELECT tier, decision, offer_tier, count(*) AS n, sum(CASE WHEN decision = 'APPROVED' THEN (CASE WHEN tier = 3 THEN trial_amount ELSE " + "(CASE offer_tier WHEN 'A' THEN 500e0 WHEN 'B' THEN 1000e0 WHEN 'C' THEN 2500e0 WHEN 'D' THEN 5000e0 END) END) ELSE 0e0 END) AS approved_amount, round(sum(CASE WHEN tier > 0 THEN CAST(floor(repay_prob * 10000 + 0.5e0) AS BIGINT) END) / (count(CASE WHEN tier > 0 THEN 1 END) * 10000e0), 6) AS mean_repay_prob FROM dec GROUP BY tier, decision, offer_tier")
def dec_10_decision_summary(spark, sf):
    return PD.decision_summary(PD.surrogate_decisions(spark, sf))


@register("dec_11_failsafe", O.with_(O.LOANS) + "SELECT 'DECLINED' AS decision, 0 AS tier, 'System Error' AS tier_label, 'UNKNOWN' AS model_version, count(*) AS n FROM loans")
def dec_11_failsafe(spark, sf):
    d = PD.surrogate_decision_rows(spark, sf, model_version=None)
    return d.groupBy("decision", "tier", "tier_label", "model_version").agg(F.count(F.lit(1)).alias("n"))


@register("scl_22_decision_record", O.RECORD + "SELECT * FROM rec")
def scl_22_decision_record(spark, sf):
    """SCL-20..23, DEC-08/09, JN-01 wide form: the 47-column log record."""
    return D.decision_record(PD.surrogate_decisions(spark, sf))


# ============================================================ decision log
def _with_batch(rec: DataFrame) -> DataFrame:
    """Decision years numbered 0, 1, 2, ... in order, whichever they are."""
    rec = rec.withColumn("_year", F.year(F.to_timestamp("decided_at")))
    years = rec.select("_year").distinct().withColumn("_batch", F.row_number().over(Window.orderBy("_year")) - 1)  # a row per year
    return rec.join(F.broadcast(years), "_year").drop("_year")


_LOGS: dict = {}


def _logged(spark, sf) -> L.VersionedTable:
    """Decisions committed one version per decision year, once for each session and input."""
    key = loans_state(spark, sf)
    if key not in _LOGS:
        rec = _with_batch(D.decision_record(PD.surrogate_decisions(spark, sf), extra=["pool_id"]))
        t = L.VersionedTable(spark, scratch_path(spark, "decision_log"))
        t.append_batches(rec, "_batch", operation="WRITE", time_col="decided_at")
        _LOGS[key] = t
    return _LOGS[key]


LOG_COLS = ["applicant_id", "decided_at", "decision", "tier", "repay_probability", "offer_tier", "pool_id"]
LOG_SQL = O.RECORD + ", logged AS (SELECT r.*, f.pool_id, CAST(year(CAST(r.decided_at AS TIMESTAMP)) - 1995 AS INTEGER) AS commit_version FROM rec r JOIN feats f ON r.applicant_id = CAST(f.loan_id AS VARCHAR))\n"


@register("src_08_log_scan", LOG_SQL + f"SELECT {', '.join(LOG_COLS)}, commit_version FROM logged")
def src_08_log_scan(spark, sf):
    return _logged(spark, sf).read().select(*LOG_COLS, "commit_version")


@register("src_09_approved_only", LOG_SQL + f"SELECT {', '.join(LOG_COLS)} FROM logged WHERE decision = 'APPROVED'")
def src_09_approved_only(spark, sf):
    return L.approved_only(_logged(spark, sf).read()).select(*LOG_COLS)


@register("src_10_version_as_of", LOG_SQL + f"SELECT {', '.join(LOG_COLS)}, commit_version FROM logged WHERE commit_version <= 3")
def src_10_version_as_of(spark, sf):
    return _logged(spark, sf).read(version=3).select(*LOG_COLS, "commit_version")


@register("src_11_timestamp_as_of", LOG_SQL + f"SELECT {', '.join(LOG_COLS)} FROM logged WHERE commit_version <= (SELECT max(commit_version) FROM (SELECT commit_version, max(CAST(decided_at AS TIMESTAMP)) AS t FROM logged GROUP BY commit_version) c WHERE t <= TIMESTAMP '1998-06-30 00:00:00')")
def src_11_timestamp_as_of(spark, sf):
    return _logged(spark, sf).read_at_timestamp("1998-06-30 00:00:00").select(*LOG_COLS)


@register("src_12_history", LOG_SQL + "SELECT commit_version AS version, 'WRITE' AS operation, count(*) AS num_rows FROM logged GROUP BY commit_version")
def src_12_history(spark, sf):
    return _logged(spark, sf).history().select("version", "operation", "num_rows")


@register("src_05_schema_merge", LOG_SQL + "SELECT applicant_id, decision, commit_version, CASE WHEN commit_version >= 4 THEN pool_id END AS pool_id FROM logged")
def src_05_schema_merge(spark, sf):
    """SRC-05: versions 0..3 written without ``pool_id``, 4.. with it; the
    merged read has NULL where a commit lacked the column."""
    rec = _logged(spark, sf).read().withColumn("_batch", F.col("commit_version")).drop("commit_version")
    t = L.VersionedTable(spark, scratch_path(spark, "decision_log_merge"))
    t.append_batches(rec.filter(F.col("_batch") <= 3).drop("pool_id"), "_batch", time_col="decided_at")
    t.append_batches(rec.filter(F.col("_batch") > 3).withColumn("_batch", F.col("_batch") - 4), "_batch", time_col="decided_at")
    return t.read().select("applicant_id", "decision", "commit_version", "pool_id")


OUTCOME_SQL = LOG_SQL + ", oc AS (SELECT l.applicant_id, CASE WHEN f.loan_status = 'Fully Paid' THEN 'REPAID' ELSE 'DEFAULTED' END AS outcome, CASE WHEN l.tier = 3 THEN (CASE WHEN l.distance_score >= 0.70e0 THEN 500e0 WHEN l.distance_score >= 0.60e0 THEN 400e0 WHEN l.distance_score >= 0.50e0 THEN 350e0 ELSE 300e0 END) ELSE l.offer_amount END AS amount FROM logged l JOIN feats f ON l.applicant_id = CAST(f.loan_id AS VARCHAR) WHERE l.decision = 'APPROVED' AND f.loan_status IN ('Fully Paid', 'Charged Off'))\n"


def outcomes_frame(spark, sf) -> DataFrame:
    """Resolved approved loans: REPAID / DEFAULTED with the lent amount."""
    dec = PD.surrogate_decisions(spark, sf).filter(F.col("decision") == "APPROVED").filter(F.col("loan_status").isin(*K.KNOWN_STATUSES))
    amount = F.when(F.col("tier") == 3, F.col("trial_amount")).otherwise(F.col("offer_amount"))
    term = F.when(F.col("tier") == 3, F.lit(6)).otherwise(F.regexp_extract("offer_term", r"(\d+)", 1).cast("int"))
    return dec.select(
        "applicant_id", "pool_id", "tier",
        F.when(F.col("loan_status") == K.REPAID_STATUS, F.lit("REPAID")).otherwise(F.lit("DEFAULTED")).alias("outcome"),
        amount.alias("amount"),
        F.add_months(F.col("decided_at"), term).cast("timestamp_ntz").alias("resolved_at"),
    )


@register("src_06_outcomes", OUTCOME_SQL + "SELECT outcome, count(*) AS n, sum(amount) AS amount FROM oc GROUP BY outcome")
def src_06_outcomes(spark, sf):
    t = L.VersionedTable(spark, scratch_path(spark, "loan_outcomes"), L.OUTCOME_SCHEMA)
    t.append(outcomes_frame(spark, sf), operation="RECORD_OUTCOME")
    return t.read().groupBy("outcome").agg(F.count(F.lit(1)).alias("n"), F.sum("amount").alias("amount"))


@register("agg_29_approval_drift", LOG_SQL + """, d AS (SELECT CAST(decided_at AS TIMESTAMP) AS ts, CAST(decision = 'APPROVED' AS INTEGER) AS ok FROM logged),
m AS (SELECT avg(ok) AS base, avg(CASE WHEN ts >= (SELECT max(ts) FROM d) - INTERVAL 7 DAY THEN ok END) AS recent FROM d)
SELECT round(base, 3) AS baseline_approval_rate, round(recent, 3) AS recent_approval_rate, round(abs(recent - base), 3) AS drift, coalesce(abs(recent - base) > 0.10e0, false) AS alert FROM m""")
def agg_29_approval_drift(spark, sf):
    return M.approval_drift(_logged(spark, sf).read(), window_days=7)


# ============================================================ profiling
@register("agg_01_class_balance", O.BASE + "SELECT target, count(*) AS n FROM clean GROUP BY target")
def agg_01_class_balance(spark, sf):
    return P.class_balance(C.clean_loans(spark, sf))


@register("agg_02_default_rate", O.BASE + "SELECT round(avg(CAST(target = 0 AS INTEGER)), 6) AS default_rate FROM clean")
def agg_02_default_rate(spark, sf):
    return P.default_rate(C.clean_loans(spark, sf))


def _long_sql(features: list[str], select: str, src: str = "clean", where: str = "") -> str:
    return "\nUNION ALL ".join(select.format(f=f) + f" FROM {src} {where}" for f in features)


AGG03_FEATS = ["debt_burden", "credit_utilization_pressure"]


@register("agg_03_mean_median", O.BASE + _long_sql(AGG03_FEATS, "SELECT '{f}' AS feature, round(avg({f}), 6) AS mean, round(quantile_cont({f}, 0.5), 6) AS median"))
def agg_03_mean_median(spark, sf):
    return P.feature_mean_median(C.clean_loans(spark, sf), AGG03_FEATS)


FLAGS = ["has_public_record", "thin_file", "high_dti_low_income"]


@register("agg_04_flag_prevalence", O.BASE + _long_sql(FLAGS, "SELECT '{f}' AS feature, round(avg({f}), 6) AS share"))
def agg_04_flag_prevalence(spark, sf):
    return P.flag_prevalence(C.clean_loans(spark, sf), FLAGS)


MISS_FEATS = K.STRONG_NUM + K.PROFILE_ENGINEERED + K.PROFILE_SUPPORTING


@register("agg_05_missing_values", O.BASE + _long_sql(MISS_FEATS, "SELECT '{f}' AS feature, count(*) FILTER (WHERE {f} IS NULL) AS missing_count, round(count(*) FILTER (WHERE {f} IS NULL) / count(*) * 100, 2) AS missing_pct"))
def agg_05_missing_values(spark, sf):
    return P.missing_values(C.clean_loans(spark, sf), MISS_FEATS)


HIST_FEATS = K.PROFILE_NUM
def _hist_sql() -> str:
    lv = "\nUNION ALL ".join(f"SELECT target, '{f}' AS feature, CAST({f} AS DOUBLE) AS value FROM clean WHERE {f} IS NOT NULL" for f in HIST_FEATS)
    return O.BASE + f""", lv AS ({lv}),
rng AS (SELECT feature, target, count(*) AS n_class,
   CASE WHEN min(value) = max(value) THEN min(value) - 0.5e0 ELSE min(value) END AS lo,
   CASE WHEN min(value) = max(value) THEN max(value) + 0.5e0 ELSE max(value) END AS hi FROM lv GROUP BY feature, target),
b AS (SELECT lv.feature, lv.target, CAST(least(49, floor((value - lo) * 50 / (hi - lo))) AS INTEGER) AS bin, n_class, lo, hi
      FROM lv JOIN rng ON lv.feature = rng.feature AND lv.target = rng.target)
SELECT feature, target, bin, count(*) AS n, round(any_value(lo) + bin * ((any_value(hi) - any_value(lo)) / 50), 6) AS bin_start,
  round(count(*) / (any_value(n_class) * ((any_value(hi) - any_value(lo)) / 50)), 6) AS density FROM b GROUP BY feature, target, bin"""


@register("agg_06_density_histogram", _hist_sql())
def agg_06_density_histogram(spark, sf):
    return P.density_histogram(C.clean_loans(spark, sf), HIST_FEATS)


@register("agg_07_home_crosstab", O.BASE + "SELECT home_ownership, count(*) FILTER (WHERE target = 0) AS n_defaulted, count(*) FILTER (WHERE target = 1) AS n_repaid, round(count(*) FILTER (WHERE target = 0) / count(*), 6) AS share_defaulted, round(count(*) FILTER (WHERE target = 1) / count(*), 6) AS share_repaid FROM clean WHERE home_ownership IS NOT NULL GROUP BY home_ownership")
def agg_07_home_crosstab(spark, sf):
    return P.crosstab_share(C.clean_loans(spark, sf))


CORR_COLS = K.PROFILE_NUM + ["target"]


def _corr_sql() -> str:
    parts = []
    for i, a in enumerate(CORR_COLS):
        for b in CORR_COLS[i:]:
            v = f"round(corr(CAST({a} AS DOUBLE), CAST({b} AS DOUBLE)), 6)"
            parts.append(f"SELECT '{a}' AS f1, '{b}' AS f2, {v} AS corr FROM clean")
            if a != b:
                parts.append(f"SELECT '{b}' AS f1, '{a}' AS f2, {v} AS corr FROM clean")
    return O.BASE + "\nUNION ALL ".join(parts)


@register("agg_08_correlation", _corr_sql())
def agg_08_correlation(spark, sf):
    return P.correlation_matrix(C.clean_loans(spark, sf), CORR_COLS)


MEAN_FEATS = K.PROFILE_NUM


@register("agg_09_class_means", O.BASE + _long_sql(MEAN_FEATS, "SELECT '{f}' AS feature, round(avg({f}) FILTER (WHERE target = 0), 6) AS mean_defaulted, round(avg({f}) FILTER (WHERE target = 1), 6) AS mean_repaid"))
def agg_09_class_means(spark, sf):
    return P.class_means(C.clean_loans(spark, sf), MEAN_FEATS)


@register("agg_10_grade_counts", O.with_(O.LOANS) + "SELECT grade, count(*) AS n FROM loans WHERE loan_status IN ('Fully Paid', 'Charged Off') GROUP BY grade")
def agg_10_grade_counts(spark, sf):
    return P.grade_counts(FE.known_outcomes(loans(spark, sf)))


@register("agg_33_medians", O.BASE + _long_sql(K.ALL_NUM, "SELECT '{f}' AS feature, quantile_cont({f}, 0.5) AS median"))
def agg_33_medians(spark, sf):
    return P.medians(C.clean_loans(spark, sf), K.ALL_NUM)


@register("agg_34_most_frequent", O.BASE + "SELECT home_ownership, count(*) AS n FROM clean WHERE home_ownership IS NOT NULL GROUP BY home_ownership ORDER BY n DESC, home_ownership LIMIT 1")
def agg_34_most_frequent(spark, sf):
    return P.most_frequent(C.clean_loans(spark, sf))


@register("agg_35_row_counts", O.with_(O.LOANS) + "SELECT count(*) AS raw_rows, count(*) FILTER (WHERE loan_status IN ('Fully Paid', 'Charged Off')) AS known_rows, count(*) FILTER (WHERE loan_status = 'Fully Paid') AS repaid, count(*) FILTER (WHERE loan_status = 'Charged Off') AS defaulted FROM loans")
def agg_35_row_counts(spark, sf):
    return P.row_counts(loans(spark, sf))


# ============================================================ evaluation
HIST = O.BASE + ", hist AS (SELECT repay_prob AS score, count(*) AS n, sum(target) AS pos, sum(1 - target) AS neg FROM scored GROUP BY repay_prob), cum AS (SELECT *, sum(pos) OVER w AS cum_pos, sum(neg) OVER w AS cum_neg, sum(n) OVER w AS cum_n, sum(pos) OVER () AS tot_pos, sum(neg) OVER () AS tot_neg FROM hist WINDOW w AS (ORDER BY score DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))\n"


@register("win_01_cumulative_shares", HIST + "SELECT score, round(cum_pos / tot_pos, 6) AS cum_repaid, round(cum_neg / tot_neg, 6) AS cum_default FROM cum")
def win_01_cumulative_shares(spark, sf):
    return E.cumulative_shares(C.scored(spark, sf))


@register("agg_20_22_ranking_metrics", HIST + "SELECT round(sum(neg * ((cum_pos - pos) + pos / 2e0)) / (any_value(tot_pos) * any_value(tot_neg)), 6) AS roc_auc, round(sum(pos / tot_pos * (cum_pos / cum_n)), 6) AS average_precision, round(max(abs(cum_pos / tot_pos - cum_neg / tot_neg)), 6) AS ks_stat FROM cum")
def agg_20_22_ranking_metrics(spark, sf):
    return E.ranking_metrics(C.scored(spark, sf))


@register("agg_23_roc_curve", HIST + "SELECT score AS threshold, round(cum_neg / tot_neg, 6) AS fpr, round(cum_pos / tot_pos, 6) AS tpr FROM cum")
def agg_23_roc_curve(spark, sf):
    return E.roc_curve(C.scored(spark, sf))


@register("agg_24_pr_curve", HIST + "SELECT score AS threshold, round(cum_pos / cum_n, 6) AS precision, round(cum_pos / tot_pos, 6) AS recall FROM cum")
def agg_24_pr_curve(spark, sf):
    return E.pr_curve(C.scored(spark, sf))


CAL = O.BASE + """, edges AS (SELECT list_distinct(list_sort(quantile_cont(repay_prob, [0.0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0]))) AS e FROM scored),
bk AS (SELECT s.*, greatest(1, len(list_filter(e, lambda x: x < s.repay_prob))) AS bucket FROM scored s, edges),
tab AS (SELECT bucket, count(*) AS count, avg(repay_prob) AS pred, avg(target) AS actual FROM bk GROUP BY bucket)
"""


@register("agg_13_calibration_table", CAL + "SELECT bucket, count, round(pred, 6) AS pred_prob, round(actual, 6) AS actual_rate, round(actual - pred, 6) AS gap FROM tab")
def agg_13_calibration_table(spark, sf):
    return E.calibration_table(C.scored(spark, sf))


@register("agg_14_calibration_gap", CAL + "SELECT round(avg(abs(round(actual - pred, 6))), 6) AS mean_abs_gap, CASE WHEN avg(abs(round(actual - pred, 6))) < 0.05 THEN 'Well calibrated' ELSE 'Needs calibration' END AS verdict FROM tab")
def agg_14_calibration_gap(spark, sf):
    return E.calibration_gap(C.scored(spark, sf))


@register("agg_15_brier", O.BASE + "SELECT round(avg(pow(repay_prob - target, 2)), 6) AS brier FROM scored")
def agg_15_brier(spark, sf):
    return E.brier(C.scored(spark, sf))


@register("agg_16_reliability_curve", O.BASE + """, edges AS (SELECT quantile_cont(repay_prob, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]) AS e FROM scored),
bk AS (SELECT s.*, len(list_filter(e, lambda x: x < s.repay_prob)) AS bin FROM scored s, edges)
SELECT bin, round(avg(target), 6) AS fraction_pos, round(avg(repay_prob), 6) AS mean_pred FROM bk GROUP BY bin""")
def agg_16_reliability_curve(spark, sf):
    return E.reliability_curve(C.scored(spark, sf))


CONF_SQL = "count(*) FILTER (WHERE target = 0 AND NOT repay_prob > 0.5e0) AS tn, count(*) FILTER (WHERE target = 0 AND repay_prob > 0.5e0) AS fp, count(*) FILTER (WHERE target = 1 AND NOT repay_prob > 0.5e0) AS fn, count(*) FILTER (WHERE target = 1 AND repay_prob > 0.5e0) AS tp"


@register("agg_17_18_confusion_cost", O.BASE + f"SELECT *, fp * 3 + fn * 1 AS expected_cost FROM (SELECT {CONF_SQL} FROM scored)")
def agg_17_18_confusion_cost(spark, sf):
    return E.confusion(C.scored(spark, sf))


@register("agg_19_classification_report", O.BASE + f""", c AS (SELECT CAST(tn AS DOUBLE) tn, CAST(fp AS DOUBLE) fp, CAST(fn AS DOUBLE) fn, CAST(tp AS DOUBLE) tp FROM (SELECT {CONF_SQL} FROM scored)),
m AS (SELECT *, coalesce(tn / nullif(tn + fn, 0), 0e0) p0, coalesce(tn / nullif(tn + fp, 0), 0e0) r0, coalesce(tp / nullif(tp + fp, 0), 0e0) p1, coalesce(tp / nullif(tp + fn, 0), 0e0) r1, tn + fp s0, tp + fn s1 FROM c),
f AS (SELECT *, coalesce(2 * p0 * r0 / nullif(p0 + r0, 0), 0e0) f0, coalesce(2 * p1 * r1 / nullif(p1 + r1, 0), 0e0) f1, s0 + s1 tot FROM m)
SELECT 'Defaulted' AS label, round(p0, 6) AS precision, round(r0, 6) AS recall, round(f0, 6) AS f1, CAST(s0 AS BIGINT) AS support FROM f
UNION ALL SELECT 'Repaid', round(p1, 6), round(r1, 6), round(f1, 6), CAST(s1 AS BIGINT) FROM f
UNION ALL SELECT 'accuracy', NULL, NULL, round(coalesce((tp + tn) / nullif(tot, 0), 0e0), 6), CAST(tot AS BIGINT) FROM f
UNION ALL SELECT 'macro avg', round((p0 + p1) / 2, 6), round((r0 + r1) / 2, 6), round((f0 + f1) / 2, 6), CAST(tot AS BIGINT) FROM f
UNION ALL SELECT 'weighted avg', round(coalesce((p0 * s0 + p1 * s1) / nullif(tot, 0), 0e0), 6), round(coalesce((r0 * s0 + r1 * s1) / nullif(tot, 0), 0e0), 6), round(coalesce((f0 * s0 + f1 * s1) / nullif(tot, 0), 0e0), 6), CAST(tot AS BIGINT) FROM f""")
def agg_19_classification_report(spark, sf):
    return E.classification_report(C.scored(spark, sf))


@register("agg_25_26_coverage", O.BASE + "SELECT count(*) AS total, count(*) FILTER (WHERE repay_prob >= 0.5e0) AS approve, count(*) FILTER (WHERE NOT repay_prob >= 0.5e0) AS decline, round(count(*) FILTER (WHERE repay_prob >= 0.5e0) / count(*), 6) AS approve_share, round(count(*) FILTER (WHERE NOT repay_prob >= 0.5e0) / count(*), 6) AS decline_share, round(avg(target) FILTER (WHERE repay_prob >= 0.5e0), 6) AS repay_rate_approved, round(avg(target) FILTER (WHERE NOT repay_prob >= 0.5e0), 6) AS repay_rate_declined FROM scored")
def agg_25_26_coverage(spark, sf):
    return E.coverage(C.scored(spark, sf))


GRADE_BASE = O.with_(O.LOANS, O.feats_cte("2020-01-01")) + f", gs AS (SELECT grade, target, {O.PROB} AS repay_prob FROM feats WHERE target IS NOT NULL)\n"


def _grade_scored(spark, sf) -> DataFrame:
    raw = FE.known_outcomes(loans(spark, sf))
    return FE.engineer(raw, reference_date="2020-01-01", keep=["loan_id", "grade"]).withColumn("repay_prob", C.surrogate_prob())


@register("agg_11_grade_rates", GRADE_BASE + "SELECT grade, count(*) AS total, CAST(sum(CAST(repay_prob >= 0.75e0 AS INTEGER)) AS BIGINT) AS approved, round(sum(CAST(repay_prob >= 0.75e0 AS INTEGER)) / count(*) * 100, 4) AS approval_pct, round(avg(target) * 100, 4) AS repay_pct, round(100 - avg(target) * 100, 4) AS default_pct FROM gs GROUP BY grade")
def agg_11_grade_rates(spark, sf):
    return M.grade_rates(_grade_scored(spark, sf))


@register("agg_12_declined_by_grade", GRADE_BASE + "SELECT grade, count(*) AS declined, CAST(sum(target) AS BIGINT) AS actually_repaid, round(avg(target) * 100, 4) AS repay_rate FROM gs WHERE repay_prob < 0.75e0 GROUP BY grade")
def agg_12_declined_by_grade(spark, sf):
    return M.declined_by_grade(_grade_scored(spark, sf))


# ============================================================ sampling, splits, sets
def _scored_with_prob(spark, sf) -> DataFrame:
    """The bootstrap score for building the training set: the surrogate."""
    return C.scored(spark, sf).withColumnRenamed("repay_prob", "prob")


SAMPLE_BASE = O.BASE + f""", defs AS (SELECT loan_id, target FROM clean WHERE target = 0),
rep AS (SELECT loan_id, target FROM (SELECT loan_id, target, row_number() OVER (ORDER BY {O.h('loan_id', 42)}, loan_id) AS rn FROM clean WHERE target = 1) x WHERE rn <= (SELECT count(*) FROM defs)),
conf AS (SELECT loan_id FROM scored WHERE target = 0 AND repay_prob < 0.35e0),
rs AS (SELECT loan_id FROM (SELECT loan_id, row_number() OVER (ORDER BY {O.h('loan_id', 4242)}, loan_id) AS rn FROM clean WHERE target = 1) x WHERE rn <= (SELECT count(*) FROM conf)),
tset AS (SELECT c.*, 'defaulter' AS side FROM clean c JOIN conf USING (loan_id) UNION ALL SELECT c.*, 'repaid' AS side FROM clean c JOIN rs USING (loan_id))
"""


@register("spl_01_balanced_sample", SAMPLE_BASE + "SELECT * FROM defs UNION ALL SELECT * FROM rep")
def spl_01_balanced_sample(spark, sf):
    return S.balanced_sample(C.clean_loans(spark, sf).select("loan_id", "target"), salt=42)


@register("spl_02_confident_defaulters", SAMPLE_BASE + "SELECT s.loan_id, s.repay_prob AS prob FROM scored s JOIN conf USING (loan_id)")
def spl_02_confident_defaulters(spark, sf):
    return S.confident_defaulters(_scored_with_prob(spark, sf)).select("loan_id", "prob")


@register("set_01_training_set", SAMPLE_BASE + "SELECT loan_id, target, side FROM tset")
def set_01_training_set(spark, sf):
    return S.training_set(C.clean_loans(spark, sf), _scored_with_prob(spark, sf)).select("loan_id", "target", "side")


def _split_sql(src: str, salt: int, cuts: list[tuple[str, float]]) -> str:
    """Rows of ``src`` with their split: exact sizes within each class, in order of the key's hash."""
    whens = " ".join(f"WHEN rn <= floor({c!r}e0 * n + 0.5e0) THEN '{n}'" for n, c in cuts)
    return f"(SELECT *, CASE {whens} END AS split FROM (SELECT *, row_number() OVER (PARTITION BY target ORDER BY {O.h('loan_id', salt)}, loan_id) AS rn, count(*) OVER (PARTITION BY target) AS n FROM {src}) ranked) parts"


def _tset(spark, sf) -> DataFrame:
    return S.training_set(C.clean_loans(spark, sf), _scored_with_prob(spark, sf))


@register("spl_04_train_test_split", SAMPLE_BASE + f"SELECT split, target, count(*) AS n FROM {_split_sql('tset', 42, S.TRAIN_TEST)} GROUP BY split, target")
def spl_04_train_test_split(spark, sf):
    return S.stratified_split(_tset(spark, sf), S.TRAIN_TEST, salt=42).groupBy("split", "target").agg(F.count(F.lit(1)).alias("n"))


@register("spl_05_three_way_split", SAMPLE_BASE + f"SELECT split, target, count(*) AS n FROM {_split_sql('tset', 7, S.TRAIN_VAL_TEST)} GROUP BY split, target")
def spl_05_three_way_split(spark, sf):
    return S.stratified_split(_tset(spark, sf), S.TRAIN_VAL_TEST, salt=7).groupBy("split", "target").agg(F.count(F.lit(1)).alias("n"))


@register("spl_04_06_split_shares", O.BASE + ", r AS (" + " UNION ALL ".join(f"SELECT '{n}' AS plan, split, target, count(*) AS c FROM {_split_sql('clean', salt, cuts)} GROUP BY split, target" for n, salt, cuts in (("80/20", 42, S.TRAIN_TEST), ("70/15/15", 7, S.TRAIN_VAL_TEST), ("70/30", 99, S.CAL_SPLIT))) + ") SELECT plan, split, target, c AS n, round(c / sum(c) OVER (PARTITION BY plan, target), 4) AS share FROM r")
def spl_04_06_split_shares(spark, sf):
    """Shares of every split in each class over the clean table."""
    c, out = C.clean_loans(spark, sf).select("loan_id", "target"), None
    for name, salt, cuts in (("80/20", 42, S.TRAIN_TEST), ("70/15/15", 7, S.TRAIN_VAL_TEST), ("70/30", 99, S.CAL_SPLIT)):
        g = S.stratified_split(c, cuts, salt=salt).groupBy("split", "target").agg(F.count(F.lit(1)).alias("n"))
        g = g.select(F.lit(name).alias("plan"), "split", "target", "n")
        out = g if out is None else out.unionByName(g)
    total = F.sum("n").over(Window.partitionBy("plan", "target"))  # a handful of rows
    return out.withColumn("share", pround(F.col("n") / total, 4))


@register("set_02_train_plus_validation", SAMPLE_BASE + f"SELECT target, count(*) AS n FROM {_split_sql('tset', 7, S.TRAIN_VAL_TEST)} WHERE split IN ('train', 'validation') GROUP BY target")
def set_02_train_plus_validation(spark, sf):
    t = S.stratified_split(_tset(spark, sf), S.TRAIN_VAL_TEST, salt=7)
    tv = t.filter(F.col("split") == "train").unionByName(t.filter(F.col("split") == "validation"))
    return tv.groupBy("target").agg(F.count(F.lit(1)).alias("n"))


@register("spl_06_calibration_split", O.BASE + f"SELECT split, target, count(*) AS n FROM {_split_sql('clean', 99, S.CAL_SPLIT)} GROUP BY split, target")
def spl_06_calibration_split(spark, sf):
    return S.stratified_split(C.clean_loans(spark, sf), S.CAL_SPLIT, salt=99).groupBy("split", "target").agg(F.count(F.lit(1)).alias("n"))


@register("jn_02_semi_join", SAMPLE_BASE + "SELECT c.loan_id, c.annual_inc FROM clean c WHERE c.loan_id IN (SELECT loan_id FROM rep)")
def jn_02_semi_join(spark, sf):
    c = C.clean_loans(spark, sf)
    keys = S.balanced_sample(c.select("loan_id", "target"), salt=42).filter(F.col("target") == 1)
    return S.semi_join_keys(c, keys).select("loan_id", "annual_inc")


@register("lim_01_first_rows", O.BASE + f"SELECT loan_id, target FROM {_split_sql('clean', 42, S.TRAIN_TEST)} WHERE split = 'test' ORDER BY loan_id LIMIT 500")
def lim_01_first_rows(spark, sf):
    """The first 500 rows of the clean table's test split, which holds more."""
    t = S.stratified_split(C.clean_loans(spark, sf).select("loan_id", "target"), S.TRAIN_TEST, salt=42)
    return S.first_rows(t.filter(F.col("split") == "test").select("loan_id", "target"), 500)


@register("agg_36_training_summary", SAMPLE_BASE + "SELECT side, count(*) AS n, round(avg(s.repay_prob), 6) AS mean_prob FROM tset JOIN scored s USING (loan_id) GROUP BY side")
def agg_36_training_summary(spark, sf):
    t = S.training_set(C.clean_loans(spark, sf), _scored_with_prob(spark, sf))
    sc = C.scored(spark, sf).select("loan_id", "repay_prob")
    return t.join(sc, "loan_id").groupBy("side").agg(F.count(F.lit(1)).alias("n"), pround(F.avg("repay_prob"), 6).alias("mean_prob"))


def queries() -> dict[str, Q]:
    return {k: v[0] for k, v in REGISTRY.items()}


def oracle_sql() -> dict[str, str]:
    return {k: O.exact_rounds(v[1]) for k, v in REGISTRY.items() if v[1]}


# ============================================================ model (MLlib; rows-only checks)
_TRAINED: dict = {}


def _trained(spark, sf):
    from kreditflow.plans import training as TR

    key = loans_state(spark, sf)
    if key not in _TRAINED:
        _TRAINED[key] = TR.train(spark, sf)
    return _TRAINED[key]


def _preprocessed_sql() -> str:
    num = [f"coalesce(CAST({f} AS DOUBLE), (SELECT quantile_cont(CAST({f} AS DOUBLE), 0.5) FROM clean)) AS f_{f}" for f in K.ALL_NUM]
    return O.BASE + f""", cats AS (SELECT home_ownership AS c, count(*) AS n, row_number() OVER (ORDER BY home_ownership) - 1 AS code FROM clean WHERE home_ownership IS NOT NULL GROUP BY home_ownership)
SELECT loan_id, {', '.join(num)}, coalesce((SELECT CAST(code AS DOUBLE) FROM cats WHERE c = coalesce(home_ownership, (SELECT c FROM cats ORDER BY n DESC, c LIMIT 1))), -1e0) AS f_home_ownership FROM clean"""


@register("ml_01_03_preprocessed", _preprocessed_sql())
def ml_01_03_preprocessed(spark, sf):
    """ML-01/02/03, JN-03: median and mode imputation and category codes, fitted on the clean table."""
    from kreditflow.plans import model as MM

    clean = C.clean_loans(spark, sf)
    return MM.fit_preprocessor(clean).transformer().transform(clean).select("loan_id", *MM.MODEL_COLS)


@register("ml_05_07_bootstrap_scores", None)
def ml_05_07_bootstrap_scores(spark, sf):
    """ML-01..05, ML-07: balanced bootstrap GBT scored over every clean row."""
    from kreditflow.plans import training as TR

    return TR.bootstrap_scores(spark, sf)


@register("ml_06_09_test_scores", None)
def ml_06_09_test_scores(spark, sf):
    """ML-06..09: final model on the test split, raw and calibrated probability."""
    from kreditflow.plans import model as MM

    t = _trained(spark, sf)
    return MM.calibrate(t.calibration, MM.score(t.model, t.test)).select("loan_id", "target", "raw_prob", "cal_prob", "pred_label")


@register("ml_06_early_stopping", None)
def ml_06_early_stopping(spark, sf):
    """ML-06: the validation loss after every tree of the final model, and the trees that the patience rule keeps."""
    from kreditflow.plans import model as MM

    return MM.loss_curve(spark, _trained(spark, sf).boosted)


def _isotonic_sql() -> str:
    """Isotonic regression by its min-max form: the largest over starts of the least over ends of block means; then
    linear between points and flat beyond them."""
    return O.BASE + f""", parts_ AS (SELECT * FROM {_split_sql('scored', 99, S.CAL_SPLIT)}),
pts AS (SELECT repay_prob AS x, sum(target) AS s, count(*) AS w, row_number() OVER (ORDER BY repay_prob) AS i FROM parts_ WHERE split = 'cal_train' GROUP BY repay_prob),
pre AS (SELECT *, sum(s) OVER (ORDER BY i) AS cs, sum(w) OVER (ORDER BY i) AS cw FROM pts),
means AS (SELECT a.i AS first, b.i AS last, (b.cs - a.cs + a.s) / CAST(b.cw - a.cw + a.w AS DOUBLE) AS m FROM pre a JOIN pre b ON b.i >= a.i),
least_ AS (SELECT first, last AS i, min(m) OVER (PARTITION BY first ORDER BY last DESC) AS m FROM means),
iso AS (SELECT i, max(m) AS y FROM least_ GROUP BY i),
fitted AS (SELECT p.x, iso.y FROM pts p JOIN iso USING (i)),
cal AS (SELECT t.loan_id, t.target, t.repay_prob, round(CASE WHEN lo.x IS NULL THEN hi.y WHEN hi.x IS NULL THEN lo.y WHEN hi.x = lo.x THEN lo.y
    ELSE lo.y + (hi.y - lo.y) * (t.repay_prob - lo.x) / (hi.x - lo.x) END, 6) AS cal_prob
  FROM (SELECT * FROM parts_ WHERE split = 'cal_test') t ASOF LEFT JOIN fitted lo ON t.repay_prob >= lo.x ASOF LEFT JOIN fitted hi ON t.repay_prob <= hi.x)
"""


def _surrogate_calibrated(spark, sf) -> DataFrame:
    """ML-08/09 on the surrogate score: an isotonic map fitted on 70 % of the clean rows, applied to the others."""
    from kreditflow.plans import model as MM

    parts = D.store(S.stratified_split(C.scored(spark, sf), S.CAL_SPLIT, salt=99), "surrogate_calibration")
    iso = MM.fit_calibration(parts.filter(F.col("split") == "cal_train"), prob="repay_prob")
    out = MM.calibrate(iso, parts.filter(F.col("split") == "cal_test"))
    return out.select("loan_id", "target", "repay_prob", pround("cal_prob", 6).alias("cal_prob"))


@register("ml_08_09_surrogate_calibration", _isotonic_sql() + "SELECT loan_id, target, repay_prob, cal_prob FROM cal")
def ml_08_09_surrogate_calibration(spark, sf):
    """ML-08/09 by value: calibrated surrogate scores of the calibration test part."""
    return _surrogate_calibrated(spark, sf)


def _report_sql(score: str) -> str:
    edges = ", ".join(str(i / 10) for i in range(11))
    return f"""(WITH e1 AS (SELECT list_distinct(list_sort(quantile_cont({score}, [{edges}]))) AS e, quantile_cont({score}, [{edges}])[2:10] AS inner_ FROM cal),
bk AS (SELECT c.*, greatest(1, len(list_filter(e, lambda x: x < {score}))) AS bucket, len(list_filter(inner_, lambda x: x < {score})) + 1 AS bin FROM cal c, e1),
tab AS (SELECT bucket, count(*) AS count, avg({score}) AS pred, avg(target) AS actual FROM bk GROUP BY bucket),
rel AS (SELECT bin, avg(target) AS fp, avg({score}) AS mp FROM bk GROUP BY bin),
all_ AS (SELECT avg(abs(round(actual - pred, 6))) AS gap FROM tab)
SELECT '{score}' AS score, bucket, count, round(pred, 6) AS pred_prob, round(actual, 6) AS actual_rate, round(actual - pred, 6) AS gap, round(fp, 6) AS fraction_pos, round(mp, 6) AS mean_pred,
  round((SELECT gap FROM all_), 6) AS mean_abs_gap, CASE WHEN (SELECT gap FROM all_) < 0.05 THEN 'Well calibrated' ELSE 'Needs calibration' END AS verdict,
  (SELECT round(avg(pow({score} - target, 2)), 6) FROM cal) AS brier FROM tab LEFT JOIN rel ON rel.bin = tab.bucket)"""


def _calibration_report(scored: DataFrame, names: tuple[str, ...]) -> DataFrame:
    """AGG-13..16 of several scores: buckets, gap, verdict, Brier score, and the reliability bin of the bucket's number."""
    out = None
    for name in names:
        rows = E.calibration_table(scored, score=name, places=6).join(E.reliability_curve(scored, score=name, places=6).withColumnRenamed("bin", "_bin"), F.col("bucket") == F.col("_bin") + 1, "left").drop("_bin")
        gap, brier = E.calibration_gap(scored, score=name, places=6), E.brier(scored, score=name)
        rows = rows.select(F.lit(name).alias("score"), "*", gap.select("mean_abs_gap").scalar().alias("mean_abs_gap"), gap.select("verdict").scalar().alias("verdict"), brier.scalar().alias("brier"))
        out = rows if out is None else out.unionByName(rows)
    return out


@register("ml_08_surrogate_report", _isotonic_sql() + f"SELECT * FROM {_report_sql('repay_prob')} UNION ALL SELECT * FROM {_report_sql('cal_prob')}")
def ml_08_surrogate_report(spark, sf):
    """AGG-13..16 before and after calibration, by value, on the surrogate score."""
    return _calibration_report(D.store(_surrogate_calibrated(spark, sf), "surrogate_calibrated"), ("repay_prob", "cal_prob"))


@register("ml_08_calibration_report", None)
def ml_08_calibration_report(spark, sf):
    """AGG-13..16 before and after calibration: buckets, gap, Brier score and reliability of raw and calibrated scores."""
    from kreditflow.plans import model as MM

    t = _trained(spark, sf)
    scored = D.store(MM.calibrate(t.calibration, MM.score(t.model, t.test)).select("loan_id", "target", "raw_prob", "cal_prob"), "calibration_report")
    return _calibration_report(scored, ("raw_prob", "cal_prob"))


@register("ml_agg_20_22_test_metrics", None)
def ml_agg_20_22_test_metrics(spark, sf):
    """AGG-20/21/22 on the fitted model's test scores (scores rounded to 6 places)."""
    from kreditflow.plans import model as MM

    t = _trained(spark, sf)
    return E.ranking_metrics(MM.score(t.model, t.test), score="raw_prob", places=6)


@register("agg_27_feature_importance", None)
def agg_27_feature_importance(spark, sf):
    from kreditflow.plans import model as MM

    return MM.feature_importance(_trained(spark, sf).model)


@register("agg_27_importance_checks", "SELECT 1e0 AS importance_sum, true AS in_order, true AS agrees")
def agg_27_importance_checks(spark, sf):
    """AGG-27 / SRT-02: the importances add up to 1, come in order, and agree with the gains of the stored nodes.

    A feature's importance is the sum of gain x weighted rows over all splits on it, as a share of the sum of all.
    """
    from kreditflow.plans import model as MM

    t = _trained(spark, sf)
    path = scratch_path(spark, "importance_nodes")
    t.model.stages[-1].write().overwrite().save(path)
    nodes = spark.read.parquet(f"{path}/data").select("treeID", "nodeData.*").filter("leftChild >= 0")
    share = nodes.groupBy(F.col("split.featureIndex").alias("f")).agg(F.sum(F.col("gain") * F.col("impurityStats")[0]).alias("g"))
    share = share.withColumn("own", F.col("g") / F.sum("g").over(Window.partitionBy()))  # a row for each feature
    names = F.array(*[F.lit(x) for x in K.ALL_FEATURES])
    share = share.select(F.get(names, F.col("f")).alias("feature"), "own")
    table = MM.feature_importance(t.model).withColumn("_at", F.monotonically_increasing_id()).join(share, "feature", "left")
    table = table.withColumn("_next", F.lead("importance").over(Window.orderBy("_at")))  # fourteen rows
    close = F.abs(F.col("importance") - F.coalesce("own", F.lit(0.0))) < 1e-6
    return table.agg(F.round(F.sum("importance"), 9).alias("importance_sum"), F.every(F.coalesce(F.col("_next") <= F.col("importance"), F.lit(True))).alias("in_order"), F.every(close).alias("agrees"))


@register("ml_10_agg_28_attribution_summary", None)
def ml_10_agg_28_attribution_summary(spark, sf):
    """ML-10 + AGG-28: tree attributions of every row of the clean table, summarised per feature."""
    from kreditflow.plans import model as MM
    from kreditflow.plans import treeshap as TS

    t = _trained(spark, sf)
    trees, weights = TS.tree_nodes(spark, t.model.stages[-1], scratch_path(spark, "gbt_nodes"))
    return TS.attribution_summary(TS.attribute(MM.score(t.model, C.clean_loans(spark, sf)), MM.MODEL_COLS, trees, weights))


STRESS_SQL = O.DEC + """, board AS (SELECT CASE WHEN grade IN ('A', 'B') THEN 'APPROVED' WHEN grade IN ('F', 'G') THEN 'DECLINED' ELSE 'AMBIGUOUS' END AS expected,
  CASE WHEN decision = 'WAITLISTED' THEN 'APPROVED' ELSE decision END AS decision, CASE WHEN tier > 0 THEN repay_prob END AS p FROM dec)
SELECT expected, count(*) AS n, count(*) FILTER (WHERE expected <> 'AMBIGUOUS' AND decision = expected) AS correct, round(avg(p), 3) AS mean_repay_prob FROM board GROUP BY expected"""


@register("agg_31_stress_scoreboard", STRESS_SQL)
def agg_31_stress_scoreboard(spark, sf):
    """AGG-31 / DEC-12: all applications decided again and scored against what their grade leads one to expect."""
    dec = PD.surrogate_decisions(spark, sf)
    expected = F.when(F.col("grade").isin("A", "B"), "APPROVED").when(F.col("grade").isin("F", "G"), "DECLINED").otherwise("AMBIGUOUS")
    decision = F.when(F.col("decision") == "WAITLISTED", "APPROVED").otherwise(F.col("decision"))
    return M.stress_scoreboard(dec.select(expected.alias("expected"), decision.alias("decision"), F.col("repay_probability").alias("repay_prob")))


@register("dec_10_model_decision_summary", None)
def dec_10_model_decision_summary(spark, sf):
    """DEC-10 with the fitted and calibrated model over every application."""
    from kreditflow.plans import training as TR

    return PD.decision_summary(TR.model_decisions(spark, sf, _trained(spark, sf)))


# ============================================================ streaming
@register("str_01_stream_decisions", LOG_SQL + f"SELECT {', '.join(LOG_COLS)}, commit_version FROM logged")
def str_01_stream_decisions(spark, sf):
    """STR-01: applications streamed one decision year per micro-batch; each
    batch is committed as log version = batch id, budget carried across batches."""
    from kreditflow.streaming import decisions as SD

    src, out, ckpt = (scratch_path(spark, f"stream_{n}") for n in ("applications", "log", "checkpoint"))
    apps = SD.applications_by_year(C.applicants(spark, sf))
    schema, log = apps.drop(SD.YEAR).schema, None
    for r in apps.select(F.col(SD.YEAR).alias("y")).distinct().orderBy("y").collect():  # a handful of years
        SD.stage_applications(apps, src, r["y"])
        log = SD.stream_decisions(spark, src, schema, out, ckpt)
    return log.read().select(*LOG_COLS, "commit_version")


def budget_events(spark, sf) -> DataFrame:
    """Tier-3 requests, and repayments and defaults of the trial loans that were approved, at the end of their term."""
    dec = PD.surrogate_decisions(spark, sf).filter(F.col("tier") == 3)
    dec = D.store(dec.select("pool_id", "loan_id", "decided_at", "applicant_id", "trial_amount", "decision", "loan_status"), "trial_loans")
    own = [F.col("loan_id").alias("seq"), "applicant_id", F.col("trial_amount").alias("amount")]
    req = dec.select("pool_id", F.col("decided_at").alias("ts"), F.lit("REQUEST").alias("event_type"), *own)
    settled = dec.filter((F.col("decision") == "APPROVED") & F.col("loan_status").isin(*K.KNOWN_STATUSES)).select(
        "pool_id", F.add_months("decided_at", 6).cast("timestamp_ntz").alias("ts"),
        F.when(F.col("loan_status") == K.REPAID_STATUS, F.lit("REPAYMENT")).otherwise(F.lit("DEFAULT")).alias("event_type"), *own)
    return req.unionByName(settled).select(*[f.name for f in B.EVENT_SCHEMA.fields])


def reset_events(events: DataFrame) -> DataFrame:
    """DEC-13: at the start of each year of requests a pool's budget is set anew, to 100 for every request of that year."""
    asked = events.filter(F.col("event_type") == "REQUEST").groupBy("pool_id", F.year("ts").cast("long").alias("_y")).agg((F.count("*") * 100.0).alias("amount"))
    start = F.make_date(F.col("_y").cast("int"), F.lit(1), F.lit(1)).cast("timestamp_ntz")
    return asked.select("pool_id", (-F.col("_y")).alias("seq"), start.alias("ts"), F.lit("RESET").alias("event_type"), F.lit(None).cast("string").alias("applicant_id"), "amount")


@register("dec_06_07_budget_fold", O.fold_sql(False) + O.FOLDED)
def dec_06_07_budget_fold(spark, sf):
    """DEC-06/07: ordered fold of requests, repayments (waitlist sweeps) and defaults per pool."""
    return B.fold_events(budget_events(spark, sf))


@register("dec_13_budget_resets", O.fold_sql(True) + O.FOLDED)
def dec_13_budget_resets(spark, sf):
    """DEC-06/07/13: the same with yearly resets to tight budgets, so that requests wait and sweeps approve them."""
    events = D.store(budget_events(spark, sf), "budget_events")
    return B.fold_events(events.unionByName(reset_events(events)))


@register("agg_30_budget_status_fold", O.fold_sql(True) + O.FOLD_STATUS)
def agg_30_budget_status_fold(spark, sf):
    events = D.store(budget_events(spark, sf), "budget_events")
    return B.status_from_fold(B.fold_events(events.unionByName(reset_events(events))))


@register("str_02_stream_budget", O.fold_sql(True) + O.FOLDED)
def str_02_stream_budget(spark, sf):
    """STR-02: the same fold as a stateful stream, triggered for each year of events as it is staged."""
    from kreditflow.streaming import decisions as SD

    src, out, ckpt = (scratch_path(spark, f"budget_{n}") for n in ("source", "out", "checkpoint"))
    events = D.store(budget_events(spark, sf), "budget_events")
    events = D.store(events.unionByName(reset_events(events)).withColumn("_y", F.year("ts")), "budget_staged")
    for (y,) in events.select("_y").distinct().orderBy("_y").collect():  # a handful of years
        events.filter(F.col("_y") == y).drop("_y").write.mode("append").parquet(src)
        folded = SD.run_budget_stream(spark, src, out, ckpt)
    return folded


@register("str_03_windowed_approval", LOG_SQL + """, d AS (SELECT CAST(decided_at AS TIMESTAMP) AS ts, CAST(decision = 'APPROVED' AS INTEGER) AS ok FROM logged),
w AS (SELECT to_timestamp((CAST(floor(epoch(ts) / 86400) AS BIGINT) - k) * 86400)::TIMESTAMP AS window_start, ok FROM d, range(7) r(k))
SELECT window_start, count(*) AS n, CAST(sum(ok) AS BIGINT) AS approved, round(sum(ok) / count(*), 6) AS approval_rate FROM w GROUP BY window_start""")
def str_03_windowed_approval(spark, sf):
    """STR-03 (batch form of the watermarked stream): approval rate per sliding 7-day window."""
    from kreditflow.streaming import decisions as SD

    return SD.windowed_approval(_logged(spark, sf).read())


@register("str_03_stream_windows", LOG_SQL + """, d AS (SELECT CAST(decided_at AS TIMESTAMP) AS ts, CAST(decision = 'APPROVED' AS INTEGER) AS ok FROM logged),
w AS (SELECT to_timestamp((CAST(floor(epoch(ts) / 86400) AS BIGINT) - k) * 86400)::TIMESTAMP AS window_start, ok FROM d, range(7) r(k))
SELECT window_start, count(*) AS n, CAST(sum(ok) AS BIGINT) AS approved, round(sum(ok) / count(*), 6) AS approval_rate FROM w
GROUP BY window_start HAVING window_start + INTERVAL 7 DAY <= (SELECT max(ts) FROM d) - INTERVAL 1 DAY""")
def str_03_stream_windows(spark, sf):
    """STR-03 as a stream with a watermark: the windows that the watermark has closed."""
    from kreditflow.streaming import decisions as SD

    src = scratch_path(spark, "windows_source")
    log = _logged(spark, sf).read().select("decided_at", "decision")
    log.write.parquet(src)
    out = scratch_path(spark, "windows_out")
    q = (SD.windowed_approval(spark.readStream.schema(log.schema).parquet(src)).writeStream.format("parquet").option("path", out)
         .option("checkpointLocation", scratch_path(spark, "windows_ckpt")).outputMode("append").trigger(availableNow=True).start())
    q.awaitTermination()
    return spark.read.schema("window_start timestamp_ntz, n long, approved long, approval_rate double").parquet(out)


@register("src_01_raw_csv_roundtrip", O.with_(O.LOANS) + "SELECT * FROM loans")
def src_01_raw_csv_roundtrip(spark, sf):
    """SRC-01/SRC-03: the loan table written as CSV with a header and read back
    with an explicit schema (no inference pass)."""
    from kreditflow.sources.tables import LOAN_CSV_SCHEMA

    path = scratch_path(spark, "loans_csv")
    loans(spark, sf).write.mode("overwrite").option("header", True).option("timestampNTZFormat", "yyyy-MM-dd HH:mm:ss").csv(path)
    return (spark.read.schema(LOAN_CSV_SCHEMA).option("header", True).option("timestampNTZFormat", "yyyy-MM-dd HH:mm:ss")
            .option("mode", "FAILFAST").csv(path))


NAN_COLS = ["dti", "revol_util", "revol_bal"]


@register("src_01_nan_is_missing", O.with_(O.LOANS) + "SELECT loan_id, " + ", ".join(f"CASE WHEN loan_id % 17 = 0 THEN NULL ELSE {c} END AS {c}" for c in NAN_COLS) + " FROM loans")
def src_01_nan_is_missing(spark, sf):
    """SRC-01: NaN in the file counts as missing from the scan on."""
    from kreditflow.sources.tables import LOAN_CSV_SCHEMA, read_raw_csv

    path = scratch_path(spark, "loans_nan_csv")
    raw = loans(spark, sf)
    raw = raw.withColumns({c: F.when(F.col("loan_id") % 17 == 0, F.lit(float("nan"))).otherwise(F.col(c)) for c in NAN_COLS})
    raw.write.option("header", True).option("timestampNTZFormat", "yyyy-MM-dd HH:mm:ss").csv(path)
    return read_raw_csv(spark, path, LOAN_CSV_SCHEMA).select("loan_id", *NAN_COLS)


@register("ml_11_12_tuning", None)
def ml_11_12_tuning(spark, sf):
    """ML-11/12/13: parameter search on the 70/15/15 parts, a row of tuning_runs for each trial, best first; the best is
    refitted on train and validation and tested once (``test_auc`` of its row)."""
    from kreditflow.plans import model as MM
    from kreditflow.plans import training as TR

    _, tr, va, te = TR.training_parts(spark, sf, salt=7)
    best = MM.tune(tr, va, scratch_path(spark, "tuning_runs"))
    test = E.ranking_metrics(MM.score(best.model, te), score="raw_prob", places=6).first()
    place = F.row_number().over(Window.orderBy(F.desc("validation_auc"), "trial"))  # a row for each trial
    return best.runs.withColumn("place", place).withColumn("test_auc", F.when(F.col("place") == 1, F.lit(float(test["roc_auc"])))).orderBy("place")


@register("ml_14_saved_model", None)
def ml_14_saved_model(spark, sf):
    """ML-14 / SRC-07 / SRC-14: save, log the version, resolve the active one, load it, and score as the fitted model does."""
    from kreditflow.plans import model as MM

    t = _trained(spark, sf)
    path = scratch_path(spark, "models")
    MM.save(t.model, f"{path}/{t.version}")
    m = E.ranking_metrics(MM.score(t.model, t.test), score="raw_prob", places=6).first()
    reg = L.ModelRegistry(spark, scratch_path(spark, "model_versions"))
    reg.log_version(t.version, float(m["roc_auc"]), float(m["average_precision"]), float(m["ks_stat"]))
    active = reg.active().first()["version"]
    again = MM.score(MM.load(f"{path}/{active}"), t.test).select("loan_id", F.col("raw_prob").alias("loaded_prob"))
    return MM.score(t.model, t.test).select("loan_id", "raw_prob").join(again, "loan_id")


def _grade_auc_sql() -> str:
    return GRADE_BASE + """, hist AS (SELECT grade, repay_prob AS score, count(*) AS n, sum(target) AS pos, sum(1 - target) AS neg FROM gs GROUP BY grade, repay_prob),
cum AS (SELECT *, sum(pos) OVER (PARTITION BY grade ORDER BY score DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cum_pos, sum(pos) OVER (PARTITION BY grade) AS tot_pos, sum(neg) OVER (PARTITION BY grade) AS tot_neg FROM hist),
auc AS (SELECT grade, round(sum(neg * ((cum_pos - pos) + pos / 2e0)) / (any_value(tot_pos) * any_value(tot_neg)), 6) AS roc_auc FROM cum GROUP BY grade),
best AS (SELECT grade, roc_auc FROM auc ORDER BY roc_auc DESC, grade LIMIT 1)
SELECT grade AS version, roc_auc, (SELECT max(grade) FROM auc) AS active_first, (SELECT grade FROM best) AS active_after_rollback,
  round(roc_auc - (SELECT roc_auc FROM best), 4) AS improvement, CASE WHEN roc_auc > (SELECT roc_auc FROM best) THEN 'retrain' ELSE 'keep' END AS verdict FROM auc"""


@register("src_13_15_registry", _grade_auc_sql())
def src_13_15_registry(spark, sf):
    """SRC-07/13/15, AGG-32: the score's ROC-AUC on each grade logged as a version; active pointer, rollback to the best, comparison."""
    import datetime as dt

    scored = D.store(_grade_scored(spark, sf).select("grade", "target", "repay_prob"), "grade_scored")
    reg = L.ModelRegistry(spark, scratch_path(spark, "grade_versions"))
    auc = {r["grade"]: E.ranking_metrics(scored.filter(F.col("grade") == r["grade"])).first()["roc_auc"] for r in scored.select("grade").distinct().collect()}  # seven grades
    for i, g in enumerate(sorted(auc)):
        reg.log_version(g, auc[g], None, None, dt.datetime(2020, 1, 1 + i))
    first = reg.active().first()["version"]
    reg.rollback(min(auc, key=lambda g: (-auc[g], g)), dt.datetime(2020, 2, 1))
    versions = reg.table.read()
    logged = versions.filter(F.col("deployed_at") < F.lit(dt.datetime(2020, 2, 1))).select("version", "roc_auc")
    out = M.compare_models(logged, versions)
    return out.select("version", "roc_auc", F.lit(first).alias("active_first"), F.col("active_version").alias("active_after_rollback"), "improvement", "verdict")
