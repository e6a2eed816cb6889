"""Fixed values of the credit-decision rules.

Everything in this module is a FIXED VALUE that must equal the decision
rules being reproduced (feature lists, thresholds, offers, profile averages,
weights, validation ranges and message templates).  They are stated plainly,
in their natural order, and are not derived.
"""

# ---------------------------------------------------------------------------
# FIXED VALUES: columns dropped before modelling (leakage / free text / geography)
LEAKY_COLUMNS = [
    "grade", "sub_grade", "int_rate", "installment", "loan_amnt",
    "initial_list_status", "application_type", "emp_title", "title",
    "zip_code", "addr_state",
]

# FIXED VALUES: outcome labels
KNOWN_STATUSES = ["Fully Paid", "Charged Off"]
REPAID_STATUS = "Fully Paid"

# FIXED VALUES: employment text -> years
EMP_LENGTH_MAP = {
    "< 1 year": 0, "1 year": 1, "2 years": 2, "3 years": 3,
    "4 years": 4, "5 years": 5, "6 years": 6, "7 years": 7,
    "8 years": 8, "9 years": 9, "10+ years": 10,
}

# FIXED VALUES: feature sets, in model order
STRONG_NUM = ["dti", "revol_util", "pub_rec", "annual_inc"]
ENGINEERED = ["debt_burden", "credit_utilization_pressure", "has_public_record", "high_dti_low_income"]
SUPPORT_NUM = ["emp_length", "open_acc", "mort_acc", "credit_history_years", "revol_bal"]
CAT_FEATURES = ["home_ownership"]
ALL_NUM = STRONG_NUM + ENGINEERED + SUPPORT_NUM
ALL_FEATURES = ALL_NUM + CAT_FEATURES
# profiling lists (the profile also carries thin_file)
PROFILE_ENGINEERED = ["debt_burden", "credit_utilization_pressure", "has_public_record", "thin_file", "high_dti_low_income"]
PROFILE_SUPPORTING = ["emp_length", "home_ownership", "open_acc", "mort_acc", "credit_history_years", "revol_bal"]
PROFILE_NUM = [f for f in STRONG_NUM + PROFILE_ENGINEERED + PROFILE_SUPPORTING if f not in CAT_FEATURES]

# FIXED VALUES: decision thresholds
APPROVAL_THRESHOLD = 0.75
REPAID_MODEL_THRESHOLD = 0.50
DISTANCE_TIER2_THRESHOLD = 0.75
DISTANCE_TIER3_THRESHOLD = 0.40
CONFIDENT_DEFAULTER_PROB = 0.35

# FIXED VALUES: validation (required fields, inclusive ranges, categories)
REQUIRED_FIELDS = [
    "dti", "revol_util", "pub_rec", "annual_inc", "debt_burden",
    "credit_utilization_pressure", "has_public_record", "high_dti_low_income",
    "emp_length", "open_acc", "mort_acc", "credit_history_years",
    "revol_bal", "home_ownership",
]
VALID_RANGES = {
    "dti": (0, 200),
    "revol_util": (0, 200),
    "pub_rec": (0, 50),
    "annual_inc": (1000, 10000000),
    "emp_length": (0, 10),
    "open_acc": (0, 100),
    "mort_acc": (0, 50),
    "credit_history_years": (0, 100),
    "revol_bal": (0, 10000000),
    "debt_burden": (0, 1000000),
    "credit_utilization_pressure": (0, 100),
    "has_public_record": (0, 1),
    "high_dti_low_income": (0, 1),
}
VALID_CATEGORIES = {"home_ownership": ["RENT", "OWN", "MORTGAGE", "OTHER", "NONE", "ANY"]}

# FIXED VALUES: average confirmed defaulter and distance weights
DEFAULTER_PROFILE = {
    "dti": 21.74,
    "revol_util": 63.30,
    "pub_rec": 0.28,
    "annual_inc": 57000.00,
    "emp_length": 5.68,
    "open_acc": 11.53,
    "mort_acc": 1.19,
    "credit_history_years": 20.50,
    "revol_bal": 14917.00,
}
FEATURE_WEIGHTS = {
    "dti": 0.25,
    "revol_util": 0.25,
    "annual_inc": 0.20,
    "pub_rec": 0.08,
    "emp_length": 0.05,
    "open_acc": 0.04,
    "mort_acc": 0.05,
    "credit_history_years": 0.04,
    "revol_bal": 0.04,
}
LOWER_IS_BETTER = ["dti", "revol_util", "pub_rec", "open_acc", "revol_bal"]

# FIXED VALUES: offers (label, amount, term in months, APR)
OFFERS = [
    ("A", 500, 6, 0.09),
    ("B", 1000, 12, 0.12),
    ("C", 2500, 24, 0.15),
    ("D", 5000, 36, 0.19),
]
AFFORDABILITY_SHARE = 0.40

# FIXED VALUES: tier labels
TIER_LABELS = {0: "Validation Error", 1: "Clear Good", 2: "Medium Good", 3: "Medium Okay", 4: "Clear Bad"}
SYSTEM_ERROR_LABEL = "System Error"

# FIXED VALUES: trial-loan budget
DEFAULT_POOL_BUDGET = 10000.00
TRIAL_LADDER = [(0.70, 500.0), (0.60, 400.0), (0.50, 350.0)]
TRIAL_FLOOR = 300.0

# FIXED VALUES: minimum-plan rules for declined applicants
MIN_PLAN_AMOUNT = 300.0
MIN_PLAN_BLOCK_PUB_REC = 3
MIN_PLAN_BLOCK_INCOME = 15000
MIN_PLAN_DTI = 35
MIN_PLAN_REVOL_UTIL = 80
MIN_PLAN_PROB = 0.60

# FIXED VALUES: texts
DEFAULT_DECLINE_REASON = "Overall credit profile did not meet lending criteria."
FAILSAFE_REASONS = [
    "Our loan assessment system is temporarily unavailable.",
    "Please try again shortly.",
    "If this persists, contact support.",
]
DRIFT_ALERT = 0.10
COST_FALSE_POSITIVE = 3
COST_FALSE_NEGATIVE = 1

# FIXED VALUES: narrative templates ({v} is the formatted value)
POSITIVE_TEMPLATES = {
    "dti": "Low debt-to-income ratio of {v}% — manageable existing debt load",
    "revol_util": "Low credit utilisation of {v}% — not over-relying on available credit",
    "pub_rec": "No derogatory public records — clean financial track record",
    "annual_inc": "Strong annual income of ${v} — good repayment capacity",
    "emp_length": "Stable employment of {v} year(s) — consistent income source",
    "open_acc": "Healthy number of open accounts ({v}) — manageable credit obligations",
    "mort_acc": "You have {v} mortgage account(s) — demonstrates prior lending trust",
    "credit_history_years": "Long credit history of {v} years — established track record",
    "revol_bal": "Low revolving balance of ${v} — limited outstanding credit card debt",
    "home_ownership": "Home ownership status suggests financial stability",
    "debt_burden": "Monthly debt burden of ${v} is manageable relative to income",
    "credit_utilization_pressure": "Revolving debt is {v}% of annual income — not over-extended",
    "has_public_record": "No derogatory public records on file — clean financial history",
    "high_dti_low_income": "Debt load is reasonable given income level",
}
NEGATIVE_TEMPLATES = {
    "dti": "High debt-to-income ratio of {v}% — too much income already committed",
    "revol_util": "High credit utilisation of {v}% — over-relying on available credit",
    "pub_rec": "{v} derogatory public record(s) — negative financial history",
    "annual_inc": "Annual income of ${v} may be insufficient given existing obligations",
    "emp_length": "Short employment history of {v} year(s) — limited income stability",
    "open_acc": "High number of open accounts ({v}) — many active credit obligations",
    "mort_acc": "No mortgage accounts — limited evidence of prior lending trust",
    "credit_history_years": "Short credit history of {v} years — limited track record",
    "revol_bal": "High revolving balance of ${v} — significant outstanding credit card debt",
    "home_ownership": "Home ownership status raises some concern",
    "debt_burden": "Monthly debt burden of ${v} is high relative to income",
    "credit_utilization_pressure": "Revolving debt is {v}% of annual income — over-extended on credit",
    "has_public_record": "Has at least one derogatory public record — negative financial history",
    "high_dti_low_income": "Combination of high debt load and low income is a risk signal",
}
# number format per feature: "1f" one decimal, "0f" integer, "comma" thousands, "pct" percent one decimal
NOTE_FORMATS = {
    "dti": "1f", "revol_util": "1f", "pub_rec": "0f", "annual_inc": "comma",
    "emp_length": "0f", "open_acc": "0f", "mort_acc": "0f", "credit_history_years": "1f",
    "revol_bal": "comma", "home_ownership": "none", "debt_burden": "comma",
    "credit_utilization_pressure": "pct", "has_public_record": "none", "high_dti_low_income": "none",
}
EMP_ZERO_POSITIVE = "No recorded employment history — income stability unknown"
EMP_ZERO_NEGATIVE = "No recorded employment history — income stability is a concern"
PRESSURE_MANAGEABLE = "Revolving debt is {v}% of annual income — manageable but noted"
PRESSURE_SPLIT = 0.30

# FIXED VALUES: surrogate linear score used where no trained model is available
SURROGATE_INTERCEPT = 4.4
SURROGATE_TERMS = [  # feature, coefficient, value used when NULL, baseline value
    ("dti", -0.12, 22.5, 22.5),
    ("revol_util", -0.015, 50.0, 50.0),
    ("pub_rec", -0.5, None, 0.0),
    ("annual_inc", 1.0 / 60000.0, None, 70000.0),
]

# FIXED VALUES: a second surrogate in which every feature counts, for the texts (feature, coefficient, baseline)
TEXT_TERMS = [
    ("dti", -0.02, 22.5), ("revol_util", -0.01, 50.0), ("pub_rec", -0.3, 0.5), ("annual_inc", 0.00001, 70000.0),
    ("debt_burden", -0.0004, 1300.0), ("credit_utilization_pressure", -0.9, 0.35), ("has_public_record", -0.15, 0.5), ("high_dti_low_income", -0.25, 0.5),
    ("emp_length", 0.03, 5.5), ("open_acc", -0.013, 12.5), ("mort_acc", 0.07, 2.5), ("credit_history_years", 0.011, 18.5), ("revol_bal", -0.00002, 20000.0),
]
TEXT_HOME = 0.12  # owners and mortgagors; minus this for the others
TEXT_MISSING = 0.03  # for a missing value

# FIXED VALUES: the registered model (registry literals)
REGISTRY_VERSIONS = [
    # version, roc_auc, pr_auc, ks_stat, deployed_at, status
    ("20260305_222037", 0.9741, None, None, "2026-03-05T22:20:37.680522", "ACTIVE"),
    ("20260308_171525", 0.9741, 0.9825, 0.8994, "2026-03-08T17:15:25.953800", "ACTIVE"),
]
BEST_PARAMS = {
    "max_depth": 6,
    "learning_rate": 0.08472091917654598,
    "n_estimators": 350,
    "gamma": 0.05303134188192615,
    "subsample": 0.9719839105119004,
    "colsample_bytree": 0.9522817551122009,
    "min_child_weight": 7,
    "reg_lambda": 6.085810362807613,
    "reg_alpha": 3.1990956669173825,
}
