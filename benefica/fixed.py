"""Names, defaults and limits that results depend on."""

# Accounts that are never beneficiaries.
SYSTEM_NAMES = ["My Company", "Administrator", "Public user", "Default User Template", "OdooBot"]

# The 25 model features, in model order.
ML_FEATURES = [
    "age", "income", "income_per_person", "household_size", "nb_children", "nb_elderly", "dependency_ratio",
    "has_disabled", "single_head", "nb_programs", "nb_active_programs", "pmt_score", "pmt_score_min",
    "avg_enrollment_days", "payment_count", "payment_gap_ratio", "payment_success_rate", "amount_variance",
    "cycle_count", "shared_phone_count", "shared_account_count", "network_risk", "group_membership_count",
    "high_amount_flag", "income_program_inconsistency",
]

# Defaults used when single rows are scored; training uses the same numbers.
SCORING_DEFAULTS = {
    "age": 35, "income": 0, "income_per_person": 0, "household_size": 1, "nb_children": 0, "nb_elderly": 0,
    "dependency_ratio": 0, "has_disabled": 0, "single_head": 0, "nb_programs": 1, "nb_active_programs": 1,
    "pmt_score": 0.5, "pmt_score_min": 0.5, "avg_enrollment_days": 365, "payment_count": 1, "payment_gap_ratio": 0,
    "payment_success_rate": 1, "amount_variance": 0, "cycle_count": 1, "shared_phone_count": 0,
    "shared_account_count": 0, "network_risk": 0, "group_membership_count": 0, "high_amount_flag": 0,
    "income_program_inconsistency": 0,
}
TRAINING_DEFAULTS = dict(SCORING_DEFAULTS)

# Defaults of the feature query.
FEATURE_DEFAULTS = {
    "nb_programs": 0, "nb_active_programs": 0, "avg_enrollment_days": 0, "pmt_score": 0.5, "pmt_score_min": 0.5,
    "payment_count": 0, "total_issued": 0, "total_paid": 0, "payment_gap_ratio": 0, "payment_success_rate": 0,
    "amount_variance": 0, "cycle_count": 0, "avg_entitlement_amount": 0, "shared_phone_count": 0,
    "shared_account_count": 0, "group_membership_count": 0,
}

# Defaults of the rule scorer.
RULE_DEFAULTS = {
    "age": 35, "income": 0, "household_size": 1, "nb_children": 0, "nb_elderly": 0, "nb_programs": 0,
    "nb_active_programs": 0, "pmt_score": 1, "pmt_score_min": 1, "payment_gap_ratio": 0, "gap_ratio": 0,
    "shared_phone_count": 0, "shared_account_count": 0, "network_risk_score": 0, "network_risk": 0,
    "high_amount_flag": 0, "dependency_ratio": 0, "income_per_person": 999999, "single_head": 0,
    "has_disabled": 0, "income_program_inconsistency": 0,
}

# Upload limits.
REQUIRED_UPLOAD_COLUMNS = ["income", "nb_programs", "payment_gap_ratio", "pmt_score"]
MAX_UPLOAD_ROWS = 5000

# Graph attributes and edge weights.
EDGE_WEIGHTS = {"phone": 0.9, "address_hash": 0.7, "agent_id": 0.4, "bank_account": 1.0}

# Midpoints of income classes, weights of vehicle classes, yes-words.
INCOME_CLASSES = {
    "0_5000": 2500, "5001_10000": 7500, "10001_15000": 12500, "15001_20000": 17500, "20001_25000": 22500,
    "25001_50000": 37500, "50001_100000": 75000,
}
VEHICLE_CLASSES = {"none": 0, "bicycle": 1, "two_wheeler": 2, "four_wheeler": 4}
YES_WORDS = {
    "disability": ["yes", "true", "1", "disabled", "has_disability"],
    "immigration": ["yes", "true", "1", "immigrant", "migrant"],
    "own_home": ["yes", "true", "1", "owned", "own_home"],
}
FAKE_MISSING = ["nan", "None", ""]

# Account text patterns by kind.
ACCOUNT_PATTERNS = {
    "BANK_ACCOUNT": r"^account_number:(?<account_number>.*)\.branch_code:(?<branch_code>.*)"
                    r"\.bank_code:(?<bank_code>.*)\.mobile_number:(?<mobile_number>.*)"
                    r"\.email_address:(?<email_address>.*)\.fa_type:(?<fa_type>.*)$",
    "MOBILE_WALLET": r"^mobile_number:(?<mobile_number>.*)\.wallet_provider_name:(?<wallet_provider_name>.*)"
                     r"\.wallet_provider_code:(?<wallet_provider_code>.*)\.fa_type:(?<fa_type>.*)$",
    "EMAIL_WALLET": r"^email_address:(?<email_address>.*)\.wallet_provider_name:(?<wallet_provider_name>.*)"
                    r"\.wallet_provider_code:(?<wallet_provider_code>.*)\.fa_type:(?<fa_type>.*)$",
}

# Trigram match threshold, stage attempts, stale limit.
TRIGRAM_THRESHOLD = 0.3
MAX_ATTEMPTS = 3
STALE_MINUTES = 60
