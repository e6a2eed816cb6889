"""Independent SQL statements of the operators, for the DuckDB value check.

Each query is plain ANSI SQL over the driver's tables (``orders``,
``customer`` ...) written with common table expressions.  Doubles are
written as ``1e0`` literals so both engines use IEEE arithmetic.
"""

from __future__ import annotations

import re

from kreditflow import constants as K

EMP_CASE = "CASE emp_length " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in K.EMP_LENGTH_MAP.items()) + " END"

LOANS = """loans AS (
  SELECT k AS loan_id, c_nationkey AS pool_id, o_orderdate AS decided_at,
    CASE WHEN o_orderstatus = 'P' THEN 'Current' WHEN (k*7919)%4500 + (k*3571)%3000 < 4600 THEN 'Fully Paid' ELSE 'Charged Off' END AS loan_status,
    substr('ABCDEFG', CAST(1 + k%7 AS INT), 1) AS grade,
    CASE WHEN k%101 = 0 THEN NULL ELSE CAST((k*7919)%4500 AS DOUBLE)/100 END AS dti,
    CASE WHEN k%97 = 0 THEN NULL ELSE CAST((k*104729)%10000 AS DOUBLE)/100 END AS revol_util,
    CAST(CASE WHEN (k*31)%20 < 16 THEN 0 ELSE (k*31)%20 - 15 END AS DOUBLE) AS pub_rec,
    CAST(8000 + floor(o_totalprice/4) AS DOUBLE) AS annual_inc,
    CAST(1 + (k*17)%25 AS DOUBLE) AS open_acc,
    CASE WHEN k%11 = 0 THEN NULL ELSE CAST((k*13)%6 AS DOUBLE) END AS mort_acc,
    CAST((k*613)%40000 AS DOUBLE) AS revol_bal,
    CASE k%13 WHEN 0 THEN '< 1 year' WHEN 1 THEN '1 year' WHEN 10 THEN '10+ years' WHEN 11 THEN NULL WHEN 12 THEN 'n/a' ELSE concat(CAST(k%13 AS VARCHAR), ' years') END AS emp_length,
    CASE WHEN k%211 = 0 THEN NULL ELSE CASE k%8 WHEN 0 THEN 'OWN' WHEN 1 THEN 'OTHER' WHEN 2 THEN 'RENT' WHEN 3 THEN 'RENT' WHEN 4 THEN 'RENT' WHEN 5 THEN 'NONE' ELSE 'MORTGAGE' END END AS home_ownership,
    strftime(o_orderdate, '%b-%Y') AS issue_d,
    CASE WHEN k%89 = 0 THEN 'unknown' ELSE strftime(o_orderdate - to_months(CAST(12 + k%400 AS INT)), '%b-%Y') END AS earliest_cr_line
  FROM (SELECT o.o_orderkey AS k, o.o_orderstatus, o.o_totalprice, o.o_orderdate, c.c_nationkey
        FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey) j
)"""


def feats_cte(ref_date: str | None = None) -> str:
    later = f"DATE '{ref_date}'" if ref_date else "CAST(try_strptime(issue_d, '%b-%Y') AS DATE)"
    return f"""feats AS (
  SELECT loan_id, pool_id, decided_at, grade, loan_status,
    CASE WHEN loan_status IN ('Fully Paid', 'Charged Off') THEN CAST(loan_status = 'Fully Paid' AS INTEGER) END AS target,
    dti, revol_util, pub_rec, annual_inc,
    dti/100*annual_inc/12 AS debt_burden,
    revol_bal/(annual_inc+1) AS credit_utilization_pressure,
    CAST(coalesce(pub_rec > 0, false) AS INTEGER) AS has_public_record,
    CAST(coalesce(dti > 30 AND annual_inc < 50000, false) AS INTEGER) AS high_dti_low_income,
    CAST({EMP_CASE} AS DOUBLE) AS emp_length,
    open_acc, mort_acc, chy AS credit_history_years, revol_bal, home_ownership,
    CAST(coalesce(chy < 5 AND open_acc < 4, false) AS INTEGER) AS thin_file
  FROM (SELECT *, date_diff('day', CAST(try_strptime(earliest_cr_line, '%b-%Y') AS DATE), {later}) / 365 AS chy FROM loans) x
)"""


def exact_rounds(sql: str) -> str:
    """Every ``round(x, n)`` as the printed digits of x, which follow its exact value and break ties to even."""
    out, at = [], 0
    for m in re.finditer(r"(?<![\w])round\(", sql):
        if m.start() < at:
            continue
        depth, i, comma = 1, m.end(), None
        while depth:
            ch = sql[i]
            depth += (ch in "([") - (ch in ")]")
            comma = i if ch == "," and depth == 1 else comma
            i += 1
        places = sql[comma + 1 : i - 1].strip()
        inner = exact_rounds(sql[m.end() : comma])
        out += [sql[at : m.start()], f"CAST(printf('%.{places}f', CAST({inner} AS DOUBLE)) AS DOUBLE)"]
        at = i
    return "".join(out) + sql[at:]


FEATURES = ", ".join(K.ALL_FEATURES)
CLEAN = f"clean AS (SELECT loan_id, pool_id, decided_at, {FEATURES}, thin_file, target FROM feats WHERE target IS NOT NULL)"
PROB = "round(1e0/(1e0+exp(-(4.4e0 - 0.12e0*coalesce(dti, 22.5e0) - 0.015e0*coalesce(revol_util, 50e0) - 0.5e0*pub_rec + annual_inc/60000e0))), 4)"
SCORED = f"scored AS (SELECT loan_id, target, {PROB} AS repay_prob FROM clean)"


def with_(*ctes: str) -> str:
    return "WITH RECURSIVE " + ",\n".join(ctes) + "\n"


BASE = with_(LOANS, feats_cte(), CLEAN, SCORED)
BASE_FIXED = with_(LOANS, feats_cte("2020-01-01"), CLEAN, SCORED)


def h(key: str, salt: int) -> str:
    return f"CAST(concat('0x', substr(md5(concat('{salt}:', CAST({key} AS VARCHAR))), 1, 8)) AS BIGINT)"


# --------------------------------------------------------------------- decisions
def _valid_expr() -> str:
    req = " AND ".join(f"{f} IS NOT NULL" for f in K.REQUIRED_FIELDS)
    rng = " AND ".join(f"({f} BETWEEN {lo} AND {hi})" for f, (lo, hi) in K.VALID_RANGES.items())
    cats = ", ".join(f"'{c}'" for c in K.VALID_CATEGORIES["home_ownership"])
    return f"({req}) AND {rng} AND upper(home_ownership) IN ({cats})"


def _n_errors_expr() -> str:
    parts = [f"CASE WHEN {f} IS NULL THEN 1 ELSE 0 END" for f in K.REQUIRED_FIELDS]
    parts += [f"CASE WHEN {f} IS NOT NULL AND ({f} < {lo} OR {f} > {hi}) THEN 1 ELSE 0 END" for f, (lo, hi) in K.VALID_RANGES.items()]
    cats = ", ".join(f"'{c}'" for c in K.VALID_CATEGORIES["home_ownership"])
    parts.append(f"CASE WHEN home_ownership IS NOT NULL AND upper(home_ownership) NOT IN ({cats}) THEN 1 ELSE 0 END")
    return " + ".join(parts)


def _distance_expr() -> str:
    terms = []
    for f, d in K.DEFAULTER_PROFILE.items():
        w = K.FEATURE_WEIGHTS[f]
        v = f"coalesce({f}, {d!r}e0)" if "e" not in repr(d) else f"coalesce({f}, {d!r})"
        raw = f"({d!r}e0 - {v})/{d!r}e0" if f in K.LOWER_IS_BETTER else f"({v} - {d!r}e0)/{d!r}e0"
        terms.append(f"round(greatest(-1e0, least(1e0, {raw})) * {w!r}e0, 4)")
    return "round((" + " + ".join(terms) + " + 1e0)/2e0, 4)"


def _pmt(label: str) -> str:
    _, amount, term, apr = next(o for o in K.OFFERS if o[0] == label)
    return f"round({amount}e0*({apr!r}e0/12)/(1e0-pow(1e0+{apr!r}e0/12, -{term}e0)), 2)"


ROOM = "greatest(0e0, annual_inc/12*0.40e0 - annual_inc/12*(dti/100))"


#: As the log record computes it: missing values count as 0.
ROOM0 = "greatest(0e0, coalesce(annual_inc, 0e0)/12*0.40e0 - coalesce(annual_inc, 0e0)/12*(coalesce(dti, 0e0)/100))"


def _first_fit(labels: list[str], room: str = "room") -> str:
    whens = " ".join(f"WHEN {_pmt(l)} <= {room} THEN '{l}'" for l in labels)
    return f"CASE {whens} ELSE 'A' END"


OFFER_CASE = f"""CASE WHEN tier = 1 AND repay_prob >= 0.85e0 THEN {_first_fit(['D', 'C', 'B', 'A'])}
  WHEN tier = 1 AND repay_prob >= 0.75e0 THEN {_first_fit(['C', 'B', 'A'])}
  WHEN tier = 1 AND repay_prob >= 0.65e0 THEN {_first_fit(['B', 'A'])}
  WHEN tier = 1 THEN 'A'
  WHEN tier = 2 AND distance_score >= 0.85e0 THEN {_first_fit(['C', 'B'])}
  WHEN tier = 2 THEN {_first_fit(['B', 'A'])}
  WHEN tier = 3 THEN 'A' END"""

DEC_CTES = [
    f"scored_all AS (SELECT f.*, {PROB} AS repay_prob, {_n_errors_expr()} AS n_errors, {_distance_expr()} AS dist, {ROOM} AS room FROM feats f)",
    """dec0 AS (SELECT *, CASE WHEN n_errors = 0 AND repay_prob < 0.75e0 THEN dist END AS distance_score,
       CASE WHEN n_errors > 0 THEN 0 WHEN repay_prob >= 0.75e0 THEN 1 WHEN dist >= 0.75e0 THEN 2 WHEN dist >= 0.40e0 THEN 3 ELSE 4 END AS tier
     FROM scored_all)""",
    f"""dec1 AS (SELECT *, {OFFER_CASE} AS offer_tier,
       CASE WHEN tier = 3 THEN (CASE WHEN distance_score >= 0.70e0 THEN 500e0 WHEN distance_score >= 0.60e0 THEN 400e0 WHEN distance_score >= 0.50e0 THEN 350e0 ELSE 300e0 END) END AS trial_amount
     FROM dec0)""",
    """t3 AS (SELECT loan_id, pool_id, trial_amount, row_number() OVER (PARTITION BY pool_id ORDER BY decided_at, loan_id) AS seq FROM dec1 WHERE tier = 3)""",
    """walk AS (
     SELECT pool_id, seq, loan_id, trial_amount, CASE WHEN 10000e0 >= trial_amount THEN trial_amount ELSE 0e0 END AS deployed, 10000e0 >= trial_amount AS ok FROM t3 WHERE seq = 1
     UNION ALL
     SELECT t.pool_id, t.seq, t.loan_id, t.trial_amount,
            w.deployed + CASE WHEN 10000e0 - w.deployed >= t.trial_amount THEN t.trial_amount ELSE 0e0 END,
            10000e0 - w.deployed >= t.trial_amount
     FROM walk w JOIN t3 t ON t.pool_id = w.pool_id AND t.seq = w.seq + 1)""",
    """budget AS (SELECT loan_id, CASE WHEN ok THEN 'APPROVED' ELSE 'WAITLISTED' END AS budget_status, round(10000e0 - deployed, 2) AS budget_remaining FROM walk)""",
    """dec AS (SELECT d.*, b.budget_status, b.budget_remaining,
       CASE WHEN tier = 0 THEN 'ERROR' WHEN tier IN (1, 2) THEN 'APPROVED' WHEN tier = 3 THEN b.budget_status ELSE 'DECLINED' END AS decision
     FROM dec1 d LEFT JOIN budget b ON d.loan_id = b.loan_id)""",
]

DEC = with_(LOANS, feats_cte(), *DEC_CTES)


# --------------------------------------------------------------------- narrative
def _fmt(kind: str, v: str) -> str:
    return {
        "1f": f"printf('%.1f', {v})",
        "0f": f"printf('%.0f', {v})",
        "comma": f"format('{{:,.0f}}', CAST(printf('%.0f', {v}) AS DOUBLE))",
        "pct": f"printf('%.1f', {v}*100)",
    }[kind]


def _sql_str(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _fill(tpl: str, kind: str, v: str) -> str:
    if "{v}" not in tpl:
        return _sql_str(tpl)
    pre, post = tpl.split("{v}", 1)
    return f"concat({_sql_str(pre)}, {_fmt(kind, v)}, {_sql_str(post)})"


def _note_case(feature: str = "feature", shap: str = "shap", v: str = "value") -> str:
    pos, neg = [], []
    for f in K.ALL_FEATURES:
        kind = K.NOTE_FORMATS[f]
        p_tpl, n_tpl = K.POSITIVE_TEMPLATES[f], K.NEGATIVE_TEMPLATES[f]
        if f == "emp_length":
            p = f"CASE WHEN {v} IS NULL THEN '{f} contributed positively' WHEN {v} = 0 THEN {_sql_str(K.EMP_ZERO_POSITIVE)} ELSE {_fill(p_tpl, kind, v)} END"
            n = f"CASE WHEN {v} IS NULL THEN '{f} contributed negatively' WHEN {v} = 0 THEN {_sql_str(K.EMP_ZERO_NEGATIVE)} ELSE {_fill(n_tpl, kind, v)} END"
        elif f == "credit_utilization_pressure":
            p = f"CASE WHEN {v} IS NULL THEN '{f} contributed positively' ELSE {_fill(p_tpl, kind, v)} END"
            n = (f"CASE WHEN {v} IS NULL THEN '{f} contributed negatively' WHEN {v} < 0.30e0 THEN {_fill(K.PRESSURE_MANAGEABLE, kind, v)} "
                 f"ELSE {_fill(n_tpl, kind, v)} END")
        else:
            p = _fill(p_tpl, kind, v)
            n = _fill(n_tpl, kind, v)
            if "{v}" in p_tpl:
                p = f"CASE WHEN {v} IS NULL THEN '{f} contributed positively' ELSE {p} END"
            if "{v}" in n_tpl:
                n = f"CASE WHEN {v} IS NULL THEN '{f} contributed negatively' ELSE {n} END"
        pos.append(f"WHEN '{f}' THEN {p}")
        neg.append(f"WHEN '{f}' THEN {n}")
    return (f"CASE WHEN {shap} > 0 THEN (CASE {feature} {' '.join(pos)} END) "
            f"WHEN {shap} < 0 THEN (CASE {feature} {' '.join(neg)} END) "
            f"ELSE concat({feature}, ' had negligible impact') END")


def _terms_sql(src: str) -> str:
    parts = []
    special = {
        "dti": ("-0.12e0*(coalesce(dti, 22.5e0) - 22.5e0)", "coalesce(dti, 22.5e0)"),
        "revol_util": ("-0.015e0*(coalesce(revol_util, 50e0) - 50e0)", "coalesce(revol_util, 50e0)"),
        "pub_rec": ("-0.5e0*(pub_rec - 0e0)", "pub_rec"),
        "annual_inc": ("(annual_inc - 70000e0)/60000e0", "annual_inc"),
    }
    for i, f in enumerate(K.ALL_FEATURES):
        shap, val = special.get(f, ("0e0", f"CAST({f} AS DOUBLE)" if f != "home_ownership" else "CAST(NULL AS DOUBLE)"))
        parts.append(f"SELECT loan_id, {i} AS idx, '{f}' AS feature, {shap} AS shap, {val} AS value FROM {src}")
    return "\nUNION ALL ".join(parts)


BASE_LOGIT = f"(4.4e0 - 0.12e0*22.5e0 - 0.015e0*50e0 - 0.5e0*0e0 + 70000e0/60000e0)"
PCT = "(least(1e0, greatest(0e0, 1e0/(1e0+exp(-({x}))))) * 100e0)"

NARR_CTES = [
    f"terms AS ({_terms_sql('dec WHERE tier > 0')})",
    """ranked AS (SELECT *, row_number() OVER (PARTITION BY loan_id ORDER BY abs(shap) DESC, idx) AS step FROM terms)""",
    f"""running AS (SELECT *, {BASE_LOGIT} + sum(shap) OVER (PARTITION BY loan_id ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS run_new FROM ranked)""",
    f"""steps AS (SELECT loan_id, step, feature, round(shap, 4) AS shap,
        round({PCT.format(x='run_new')} - {PCT.format(x='run_new - shap')}, 2) AS impact_pct,
        round({PCT.format(x='run_new')}, 2) AS running_prob, round(value, 4) AS value,
        CASE WHEN shap > 0 THEN 'positive' WHEN shap < 0 THEN 'negative' ELSE 'neutral' END AS direction,
        {_note_case()} AS note
      FROM running)""",
    f"""reasons AS (SELECT loan_id,
        coalesce(max(CASE WHEN rn = 1 THEN note END), {_sql_str(K.DEFAULT_DECLINE_REASON)}) AS decline_reason_1,
        coalesce(max(CASE WHEN rn = 2 THEN note END), {_sql_str(K.DEFAULT_DECLINE_REASON)}) AS decline_reason_2,
        coalesce(max(CASE WHEN rn = 3 THEN note END), {_sql_str(K.DEFAULT_DECLINE_REASON)}) AS decline_reason_3
      FROM (SELECT s.loan_id, s.note, row_number() OVER (PARTITION BY s.loan_id ORDER BY s.step) AS rn
            FROM steps s JOIN dec d ON s.loan_id = d.loan_id WHERE d.tier = 4 AND s.direction = 'negative') n
      GROUP BY loan_id)""",
]

NARR = with_(LOANS, feats_cte(), *DEC_CTES, *NARR_CTES)


def _text_terms_sql() -> str:
    parts = []
    linear = {f: (c, b) for f, c, b in K.TEXT_TERMS}
    way = "(CASE WHEN loan_id % 2 = 0 THEN 1e0 ELSE -1e0 END)"
    for i, f in enumerate(K.ALL_FEATURES):
        if f == "home_ownership":
            shap, value = f"CASE WHEN home_ownership IN ('OWN', 'MORTGAGE') THEN {K.TEXT_HOME!r}e0 ELSE -{K.TEXT_HOME!r}e0 END", "CAST(NULL AS DOUBLE)"
        else:
            value = f"CAST({f} AS DOUBLE)"
            shap = f"coalesce(CAST('{linear[f][0]!r}' AS DOUBLE) * ({value} - CAST('{linear[f][1]!r}' AS DOUBLE)), {K.TEXT_MISSING!r}e0)"
        parts.append(f"SELECT loan_id, {i} AS idx, '{f}' AS feature, {way} * ({shap}) AS shap, {value} AS value FROM feats")
    return "\nUNION ALL ".join(parts)


TEXTS = with_(LOANS, feats_cte(), f"terms AS ({_text_terms_sql()})", *NARR_CTES[1:4])


def _min_plan_sql() -> str:
    dti, ru, pub, inc = "coalesce(dti, 100e0)", "coalesce(revol_util, 100e0)", "coalesce(pub_rec, 0e0)", "coalesce(annual_inc, 0e0)"
    c1 = f"CASE WHEN {dti} > 35 THEN concat('reduce debt-to-income ratio below 35% (currently ', printf('%.1f', {dti}), '%)') END"
    c2 = f"CASE WHEN {ru} > 80 THEN concat('reduce credit utilisation below 80% (currently ', printf('%.1f', {ru}), '%)') END"
    c3 = "CASE WHEN coalesce(repay_prob, 0e0) < 0.60e0 THEN 'improve overall credit profile' END"
    conds = f"concat_ws(' and ', {c1}, {c2}, {c3})"
    blocked_pub, blocked_inc = f"{pub} >= 3", f"{inc} < 15000"
    possible = f"CASE WHEN decision <> 'DECLINED' THEN NULL WHEN {blocked_pub} OR {blocked_inc} THEN false ELSE true END"
    amount = f"CASE WHEN decision = 'DECLINED' AND NOT ({blocked_pub}) AND NOT ({blocked_inc}) THEN 300e0 END"
    cond = (f"CASE WHEN decision <> 'DECLINED' THEN NULL "
            f"WHEN {blocked_pub} THEN 'Multiple derogatory public records prevent approval at any amount' "
            f"WHEN {blocked_inc} THEN 'Income is too low to support any loan repayment' "
            f"WHEN {conds} = '' THEN 'A minimum trial loan of $300 may be possible once repayment probability improves above 75%' "
            f"ELSE concat('A minimum loan of $300 may be possible if you: ', {conds}) END")
    return f"{possible} AS min_plan_possible, {amount} AS min_plan_amount, {cond} AS min_plan_condition"


def _selected_reason_sql(room: str) -> str:
    nf = ", ".join(f"CASE WHEN NOT ({_pmt(l)} <= {room}) THEN '{l}' END" for l, *_ in K.OFFERS)
    nfs = f"concat_ws(', ', {nf})"
    return (f"CASE WHEN decision = 'APPROVED' AND {nfs} <> '' THEN concat('Offer ', coalesce(offer_tier, 'None'), ' selected — Offer(s) ', {nfs}, ' exceeded monthly affordability') "
            f"WHEN decision = 'APPROVED' THEN concat('Offer ', coalesce(offer_tier, 'None'), ' selected based on repay probability tier') "
            f"ELSE 'No offer — application declined' END")


def offer_cols_sql() -> str:
    terms = {l: t for l, _, t, _ in K.OFFERS}
    amounts = {l: a for l, a, _, _ in K.OFFERS}
    aprs = {l: a for l, _, _, a in K.OFFERS}
    amt = "CASE offer_tier " + " ".join(f"WHEN '{l}' THEN {amounts[l]}e0" for l in amounts) + " END"
    term = "CASE offer_tier " + " ".join(f"WHEN '{l}' THEN '{terms[l]} months'" for l in terms) + " END"
    apr = "CASE offer_tier " + " ".join(f"WHEN '{l}' THEN '{round(aprs[l] * 100):d}%'" for l in aprs) + " END"
    pmt = "CASE offer_tier " + " ".join(f"WHEN '{l}' THEN {_pmt(l)}" for l in amounts) + " END"
    return f"{amt} AS offer_amount, {term} AS offer_term, {apr} AS offer_apr, {pmt} AS monthly_payment"


def record_sql() -> str:
    room0 = ROOM0
    plan_cols = []
    for l, amount, _t, _a in K.OFFERS:
        p = l.lower()
        plan_cols += [f"{amount}e0 AS plan_{p}_amount", f"{_pmt(l)} AS plan_{p}_monthly", f"{_pmt(l)} <= {room0} AS plan_{p}_fits"]
    prof = ", ".join(f"coalesce(CAST({c} AS DOUBLE), 0e0) AS {c}" for c in ["dti", "revol_util", "pub_rec", "annual_inc", "emp_length", "open_acc", "mort_acc", "credit_history_years", "revol_bal"])
    labels = "CASE tier " + " ".join(f"WHEN {k} THEN '{v}'" for k, v in K.TIER_LABELS.items()) + " END"
    return f"""SELECT CAST(d.loan_id AS VARCHAR) AS applicant_id, strftime(decided_at, '%Y-%m-%dT%H:%M:%S') AS decided_at,
  decision, CAST(tier AS INTEGER) AS tier, {labels} AS tier_label, coalesce(round(repay_prob, 4), 0e0) AS repay_probability,
  distance_score, 'surrogate-linear-1' AS model_version, offer_tier, {offer_cols_sql()},
  {', '.join(plan_cols)}, round({room0}, 2) AS dti_headroom,
  {_selected_reason_sql(room0)} AS selected_reason,
  {_min_plan_sql()},
  r.decline_reason_1, r.decline_reason_2, r.decline_reason_3,
  {prof}, coalesce(home_ownership, '') AS home_ownership, coalesce(debt_burden, 0e0) AS debt_burden,
  coalesce(credit_utilization_pressure, 0e0) AS credit_utilization_pressure,
  CAST(coalesce(has_public_record, 0) AS INTEGER) AS has_public_record, CAST(coalesce(high_dti_low_income, 0) AS INTEGER) AS high_dti_low_income
FROM dec d LEFT JOIN reasons r ON d.loan_id = r.loan_id
WHERE d.tier > 0"""


RECORD = NARR + ", rec AS (" + record_sql() + ")\n"

# ---------------------------------------------------------------- budget events (DEC-06/07/13)
_TRIAL = "SELECT pool_id, loan_id AS seq, CAST(decided_at AS TIMESTAMP) AS ts, 'REQUEST' AS event_type, CAST(loan_id AS VARCHAR) AS applicant_id, trial_amount AS amount FROM dec WHERE tier = 3"
_SETTLED = """SELECT pool_id, loan_id, CAST(CAST(decided_at AS DATE) + INTERVAL 6 MONTH AS TIMESTAMP), CASE WHEN loan_status = 'Fully Paid' THEN 'REPAYMENT' ELSE 'DEFAULT' END, CAST(loan_id AS VARCHAR), trial_amount
  FROM dec WHERE tier = 3 AND decision = 'APPROVED' AND loan_status IN ('Fully Paid', 'Charged Off')"""
_RESETS = """SELECT pool_id, -CAST(year(decided_at) AS BIGINT), make_timestamp(CAST(year(decided_at) AS BIGINT), 1, 1, 0, 0, 0), 'RESET', NULL, 100e0 * count(*)
  FROM dec WHERE tier = 3 GROUP BY pool_id, year(decided_at)"""


def fold_sql(resets: bool) -> str:
    """The rule told event by event: a row is an event or one approval of a sweep, and carries the waitlist in order of arrival."""
    events = " UNION ALL ".join([_TRIAL, _SETTLED, *([_RESETS] if resets else [])])
    return DEC + f""", ev AS ({events}),
ne AS (SELECT *, row_number() OVER (PARTITION BY pool_id ORDER BY ts, seq) AS n FROM ev),
told AS (
  SELECT pool_id, CAST(0 AS BIGINT) AS n, 0 AS step, CAST(NULL AS BIGINT) AS seq, CAST(NULL AS TIMESTAMP) AS ts, CAST(NULL AS VARCHAR) AS event_type, CAST(NULL AS VARCHAR) AS applicant_id,
    CAST(NULL AS DOUBLE) AS amount, CAST(NULL AS VARCHAR) AS status, 10000e0 AS total, 0e0 AS deployed, 0e0 AS repaid, 0e0 AS defaulted, CAST([] AS STRUCT(n BIGINT, amount DOUBLE, who VARCHAR)[]) AS waiting
  FROM (SELECT DISTINCT pool_id FROM ne)
  UNION ALL
  SELECT pool_id, CASE WHEN pops THEN n ELSE n + 1 END, CASE WHEN pops THEN step + 1 ELSE 0 END, CASE WHEN pops THEN seq ELSE e_seq END, CASE WHEN pops THEN ts ELSE e_ts END,
    CASE WHEN pops THEN 'WAITLIST_APPROVAL' ELSE e_type END, CASE WHEN pops THEN fit.who ELSE e_who END, CASE WHEN pops THEN fit.amount ELSE e_amount END,
    CASE WHEN pops THEN 'APPROVED' WHEN e_type = 'REQUEST' THEN (CASE WHEN total - deployed >= e_amount THEN 'APPROVED' ELSE 'WAITLISTED' END) WHEN e_type = 'RESET' THEN 'RESET' ELSE 'RECORDED' END,
    CASE WHEN pops THEN total WHEN e_type = 'RESET' THEN e_amount WHEN e_type = 'REPAYMENT' THEN total + e_amount ELSE total END,
    CASE WHEN pops THEN deployed + fit.amount WHEN e_type = 'RESET' THEN 0e0 WHEN e_type = 'REQUEST' AND total - deployed >= e_amount THEN deployed + e_amount ELSE deployed END,
    CASE WHEN pops THEN repaid WHEN e_type = 'RESET' THEN 0e0 WHEN e_type = 'REPAYMENT' THEN repaid + e_amount ELSE repaid END,
    CASE WHEN pops THEN defaulted WHEN e_type = 'RESET' THEN 0e0 WHEN e_type = 'DEFAULT' THEN defaulted + e_amount ELSE defaulted END,
    CASE WHEN pops THEN list_filter(waiting, lambda w : w.n <> fit.n) WHEN e_type = 'RESET' THEN []
      WHEN e_type = 'REQUEST' AND total - deployed < e_amount THEN list_append(waiting, struct_pack(n := n + 1, amount := e_amount, who := e_who)) ELSE waiting END
  FROM (SELECT t.*, e.seq AS e_seq, e.ts AS e_ts, e.event_type AS e_type, e.applicant_id AS e_who, e.amount AS e_amount, e.n AS e_n, t.fit IS NOT NULL AS pops
        FROM (SELECT *, CASE WHEN event_type IN ('REPAYMENT', 'WAITLIST_APPROVAL') THEN list_filter(waiting, lambda w : w.amount <= total - deployed)[1] END AS fit FROM told) t
        LEFT JOIN ne e ON e.pool_id = t.pool_id AND e.n = t.n + 1) x
  WHERE pops OR e_n IS NOT NULL),
folded AS (SELECT pool_id, seq, ts, event_type, applicant_id, amount, status, total AS total_budget, deployed AS amount_deployed, repaid AS amount_repaid, defaulted AS amount_defaulted,
  total - deployed AS remaining, CAST(len(waiting) AS BIGINT) AS waitlist_size, step, n FROM told WHERE n > 0)
"""


FOLDED = "SELECT * EXCLUDE (n) FROM folded"
FOLD_STATUS = """, closing AS (SELECT *, row_number() OVER (PARTITION BY pool_id ORDER BY n DESC, step DESC) AS back FROM folded),
won AS (SELECT pool_id, count(*) FILTER (WHERE status = 'APPROVED') AS approved FROM folded GROUP BY pool_id)
SELECT pool_id, total_budget, amount_deployed, remaining, amount_repaid, CASE WHEN amount_repaid + amount_defaulted > 0 THEN round(amount_repaid / (amount_repaid + amount_defaulted), 4) END AS repay_rate,
  amount_defaulted, approved, waitlist_size AS waitlisted FROM closing JOIN won USING (pool_id) WHERE back = 1"""
