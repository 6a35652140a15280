"""Default settings.  Each dict can be replaced by one read from YAML or JSON."""

from __future__ import annotations

# Key columns per table.
KEY_COLUMNS = {
    "customers": ["customer_id"],
    "loan_applications": ["loan_id"],
    "financial_profiles": ["customer_id", "as_of_date"],
    "credit_history": ["customer_id", "as_of_date"],
    "loan_outcomes": ["loan_id"],
}

# Validation rules and their thresholds.
RULES = {
    "missing_value": [
        {"table": "financial_profiles", "column": "total_assets", "threshold": 0.0, "severity": "WARNING"},
        {"table": "customers", "column": "annual_income", "threshold": 0.0, "severity": "ERROR"},
        {"table": "customers", "column": "monthly_income", "threshold": 0.0, "severity": "ERROR"},
        {"table": "customers", "column": "age", "threshold": 0.0, "severity": "ERROR"},
    ],
    "duplicate_record": [
        {"table": "customers", "keys": ["customer_id"], "severity": "ERROR"},
        {"table": "loan_applications", "keys": ["loan_id"], "severity": "ERROR"},
        {"table": "customers", "exact": True, "severity": "WARNING"},
        {"table": "loan_applications", "exact": True, "severity": "WARNING"},
    ],
    "numeric_range": [
        {"table": "customers", "column": "dependents", "min": 0, "max": 10, "severity": "WARNING"},
        {"table": "customers", "column": "city_tier", "min": 1, "max": 3, "severity": "WARNING"},
        {"table": "loan_applications", "column": "loan_tenure_months", "min": 1, "max": 600, "severity": "WARNING"},
        {"table": "loan_applications", "column": "interest_rate", "min": 0, "max": 40, "severity": "WARNING"},
        {"table": "credit_history", "column": "credit_history_months", "min": 0, "max": 600, "severity": "WARNING"},
        {"table": "credit_history", "column": "num_credit_accounts", "min": 0, "max": 50, "severity": "WARNING"},
    ],
    "negative_financial": [
        {"table": "customers", "columns": ["annual_income", "monthly_income"], "severity": "ERROR"},
        {
            "table": "financial_profiles",
            "columns": [
                "monthly_income", "monthly_expenses", "existing_loan_amount", "monthly_emi",
                "savings_balance", "total_assets", "total_liabilities",
            ],
            "severity": "ERROR",
        },
        {"table": "credit_history", "columns": ["total_credit_limit", "total_outstanding"], "severity": "ERROR"},
    ],
    "impossible_age": {"table": "customers", "column": "age", "min": 18, "max": 100, "severity": "ERROR"},
    "invalid_date": [
        {
            "table": "loan_applications",
            "columns": ["application_date", "decision_date"],
            "order_pairs": [["application_date", "decision_date"]],
            "severity": "ERROR",
        },
        {"table": "loan_outcomes", "columns": ["outcome_observed_date"], "severity": "WARNING"},
        {"table": "financial_profiles", "columns": ["as_of_date"], "severity": "WARNING"},
        {"table": "credit_history", "columns": ["as_of_date"], "severity": "WARNING"},
    ],
    "credit_utilization": {
        "table": "credit_history", "min": 0.0, "max": 1.5,
        "outstanding_over_limit_margin": 1.5, "severity": "ERROR",
    },
    "income_consistency": {"table": "customers", "tolerance_fraction": 0.1, "severity": "ERROR"},
    "expense_consistency": {"table": "financial_profiles", "income_multiple": 1.5, "severity": "WARNING"},
    "orphan_record": [
        {"child_table": "loan_applications", "parent_table": "customers", "key": "customer_id", "severity": "ERROR"},
        {"child_table": "financial_profiles", "parent_table": "customers", "key": "customer_id", "severity": "ERROR"},
        {"child_table": "credit_history", "parent_table": "customers", "key": "customer_id", "severity": "ERROR"},
        {"child_table": "loan_outcomes", "parent_table": "loan_applications", "key": "loan_id", "severity": "ERROR"},
    ],
    "employment_plausibility": {"table": "customers", "min_working_age": 16, "severity": "WARNING"},
    "temporal_leakage": [
        {"snapshot_table": "financial_profiles", "loan_table": "loan_applications", "severity": "ERROR"},
        {"snapshot_table": "credit_history", "loan_table": "loan_applications", "severity": "ERROR"},
    ],
}

# Cleaning steps (table -> columns).
CLEANING = {
    "dedup": {"customers": ["customer_id"], "loan_applications": ["loan_id"]},
    "clip": {
        "customers": {"age": (18, 100), "annual_income": (0, None), "monthly_income": (0, None)},
        "financial_profiles": {
            "monthly_income": (0, None), "monthly_expenses": (0, None), "existing_loan_amount": (0, None),
            "monthly_emi": (0, None), "savings_balance": (0, None), "total_assets": (0, None),
            "total_liabilities": (0, None),
        },
        "credit_history": {
            "total_credit_limit": (0, None), "total_outstanding": (0, None), "credit_utilization": (0, 1.5),
        },
    },
    "winsorize": {
        "lower": 0.01,
        "upper": 0.99,
        "columns": {
            "customers": ["annual_income", "monthly_income"],
            "financial_profiles": [
                "monthly_income", "monthly_expenses", "savings_balance", "total_assets", "total_liabilities",
            ],
            "credit_history": ["total_credit_limit", "total_outstanding"],
            "loan_applications": ["loan_amount"],
        },
    },
    "impute_numeric": {
        "financial_profiles": ["total_assets"],
        "customers": ["annual_income", "monthly_income", "employment_years"],
    },
    "impute_categorical": {
        "customers": ["gender", "marital_status", "education", "employment_type"],
        "loan_applications": ["loan_type", "loan_purpose", "status"],
    },
}

# Columns of each source table that reach the per-loan frame.
LOAN_COLUMNS = [
    "loan_id", "customer_id", "loan_type", "loan_amount", "loan_tenure_months",
    "interest_rate", "loan_purpose", "application_date",
]
CUSTOMER_COLUMNS = [
    "customer_id", "age", "gender", "marital_status", "dependents", "education",
    "employment_type", "employment_years", "annual_income", "city_tier",
]
FINANCIAL_COLUMNS = [
    "customer_id", "as_of_date", "monthly_income", "monthly_expenses", "existing_loan_count",
    "existing_loan_amount", "monthly_emi", "savings_balance", "total_assets", "total_liabilities",
]
CREDIT_COLUMNS = [
    "customer_id", "as_of_date", "credit_history_months", "num_credit_accounts", "total_credit_limit",
    "total_outstanding", "previous_defaults", "late_payments_12m", "missed_payments_12m",
    "active_loans", "closed_loans",
]

# Order of the 36 columns of the per-loan frame.
MERGED_COLUMNS = [
    "loan_id", "customer_id", "application_date", "age", "gender", "marital_status", "dependents",
    "education", "employment_type", "employment_years", "annual_income", "city_tier", "loan_type",
    "loan_amount", "loan_tenure_months", "interest_rate", "loan_purpose", "financial_as_of_date",
    "monthly_income", "monthly_expenses", "existing_loan_count", "existing_loan_amount", "monthly_emi",
    "savings_balance", "total_assets", "total_liabilities", "credit_as_of_date",
    "credit_history_months", "num_credit_accounts", "total_credit_limit", "total_outstanding",
    "previous_defaults", "late_payments_12m", "missed_payments_12m", "active_loans", "closed_loans",
]

# Names and name patterns that only exist after the lending decision.
FORBIDDEN_FEATURES = [
    "default_12m", "outcome_observed_date", "days_past_due", "recovery_amount", "collection_status",
    "write_off_amount", "future_missed_payments", "decision_date", "status",
]
FORBIDDEN_PATTERNS = [
    r"^future_", r"_after_decision$", r"^post_disbursement_", r"^outcome_", r"^actual_",
    r"^repayment_", r"^charge_off_",
]

# Model input columns by role.
NUMERIC_FEATURES = [
    "age", "dependents", "employment_years", "annual_income", "city_tier", "loan_amount",
    "loan_tenure_months", "interest_rate", "monthly_income", "monthly_expenses",
    "existing_loan_count", "existing_loan_amount", "monthly_emi", "savings_balance", "total_assets",
    "total_liabilities", "credit_history_months", "num_credit_accounts", "total_credit_limit",
    "total_outstanding", "previous_defaults", "late_payments_12m", "missed_payments_12m",
    "active_loans", "closed_loans", "dti", "emi_to_income", "credit_utilization", "loan_to_income",
    "proposed_emi", "post_loan_dti", "savings_to_income", "net_worth", "leverage_ratio",
    "disposable_income", "months_of_runway", "delinquency_rate", "has_prior_default",
    "credit_history_years", "accounts_per_year", "active_loan_ratio", "employment_stability",
    "income_per_dependent",
]
CATEGORICAL_FEATURES = [
    "gender", "marital_status", "education", "employment_type", "loan_type", "loan_purpose",
]
ORDINAL_FEATURES = ["utilization_band", "age_band", "tenure_band", "income_band"]
QUANTILE_LABELS = ["Q1", "Q2", "Q3", "Q4", "Q5"]
UTILIZATION_LABELS = ["0-30", "30-50", "50-70", "70-90", "90+"]
UTILIZATION_CUTS = [0.30, 0.50, 0.70, 0.90]
ORDINAL_ORDER = {
    "utilization_band": UTILIZATION_LABELS,
    "age_band": QUANTILE_LABELS,
    "tenure_band": QUANTILE_LABELS,
    "income_band": QUANTILE_LABELS,
}
ONE_HOT_MIN_FREQUENCY = 0.01

# Display bands, cut points left-closed.
AGE_DISPLAY_CUTS = [26, 36, 46, 56, 66]
AGE_DISPLAY_LABELS = ["18-25", "26-35", "36-45", "46-55", "56-65", "66+"]
INCOME_DISPLAY_CUTS = [300000, 600000, 1000000, 2000000]
INCOME_DISPLAY_LABELS = ["<3L", "3-6L", "6-10L", "10-20L", "20L+"]

# Information-value bands (upper bound, label).
IV_BANDS = [
    (0.02, "useless"),
    (0.1, "weak"),
    (0.3, "medium"),
    (0.5, "strong"),
    (None, "suspiciously strong - investigate for leakage"),
]
LOW_CARDINALITY = 40

# Accepted values and bounds of a scoring request.
REQUEST_ENUMS = {
    "gender": ["MALE", "FEMALE", "OTHER"],
    "marital_status": ["SINGLE", "MARRIED", "DIVORCED", "WIDOWED"],
    "education": ["HIGH_SCHOOL", "GRADUATE", "POSTGRADUATE", "DOCTORATE"],
    "employment_type": ["SALARIED", "SELF_EMPLOYED", "BUSINESS_OWNER", "UNEMPLOYED"],
    "loan_type": ["PERSONAL", "HOME", "AUTO", "EDUCATION", "BUSINESS", "CREDIT_CARD"],
}
# column -> (ge, gt, le); None means no bound.
REQUEST_BOUNDS = {
    "age": (18, None, 100),
    "dependents": (0, None, 20),
    "employment_years": (0, None, 60),
    "annual_income": (None, 0, None),
    "monthly_income": (None, 0, None),
    "city_tier": (1, None, 3),
    "monthly_expenses": (0, None, None),
    "existing_loan_count": (0, None, None),
    "existing_loan_amount": (0, None, None),
    "monthly_emi": (0, None, None),
    "savings_balance": (0, None, None),
    "total_assets": (0, None, None),
    "total_liabilities": (0, None, None),
    "credit_history_months": (0, None, None),
    "num_credit_accounts": (0, None, None),
    "total_credit_limit": (0, None, None),
    "total_outstanding": (0, None, None),
    "credit_utilization": (0, None, 2),
    "previous_defaults": (0, None, None),
    "late_payments_12m": (0, None, None),
    "missed_payments_12m": (0, None, None),
    "active_loans": (0, None, None),
    "closed_loans": (0, None, None),
    "loan_amount": (None, 0, None),
    "loan_tenure_months": (None, 0, None),
    "interest_rate": (0, None, 100),
}
# column -> (min length, max length)
REQUEST_LENGTHS = {"customer_id": (0, 64), "loan_id": (0, 64), "loan_purpose": (1, 64)}
# The looser bounds of the batch scoring input.
SCORING_BOUNDS = {
    "age": (18, None, 100),
    "dependents": (0, None, None),
    "employment_years": (0, None, None),
    "annual_income": (0, None, None),
    "loan_amount": (None, 0, None),
    "loan_tenure_months": (None, 0, None),
    "interest_rate": (0, None, None),
    "monthly_income": (0, None, None),
    "monthly_expenses": (0, None, None),
    "existing_loan_count": (0, None, None),
    "existing_loan_amount": (0, None, None),
    "monthly_emi": (0, None, None),
    "savings_balance": (0, None, None),
    "total_assets": (0, None, None),
    "total_liabilities": (0, None, None),
    "credit_history_months": (0, None, None),
    "num_credit_accounts": (0, None, None),
    "total_credit_limit": (0, None, None),
    "total_outstanding": (0, None, None),
    "previous_defaults": (0, None, None),
    "late_payments_12m": (0, None, None),
    "missed_payments_12m": (0, None, None),
    "active_loans": (0, None, None),
    "closed_loans": (0, None, None),
}
SCORING_ENUMS = {"loan_type": REQUEST_ENUMS["loan_type"]}

# Scorecard, risk bands and decision policy.
SCORECARD = {"base_score": 600.0, "base_odds": 20.0, "pdo": 40.0, "min_score": 300, "max_score": 900}
RISK_BANDS = [
    ("VERY_LOW", 750, 900),
    ("LOW", 700, 749),
    ("MODERATE", 650, 699),
    ("HIGH", 550, 649),
    ("VERY_HIGH", 300, 549),
]
HIGH_RISK = ["HIGH", "VERY_HIGH"]
POLICY = {
    "approve_score_min": 700,
    "reject_score_max": 549,
    "reject_probability_multiplier": 3.0,
    "previous_defaults_min": 2,
    "post_loan_dti_max": 0.60,
    "credit_utilization_max": 0.95,
    "thin_file_employment_years_max": 0.5,
    "thin_file_loan_to_income_min": 5.0,
    "thin_credit_file_months": 12,
    "post_loan_dti_soft_min": 0.45,
    "post_loan_dti_soft_max": 0.60,
    "disposable_income_floor": 5000.0,
}
TOP_K_FACTORS = 5
BACKGROUND_ROWS = 200

# Monitoring thresholds.
MONITORING = {
    "n_deciles": 10,
    "reference_sample_size": 5000,
    "psi_warning": 0.10,
    "psi_drift": 0.25,
    "epsilon": 1e-6,
    "significance_level": 0.05,
    "window_days": 30,
    "concept_drift_confidence": 0.95,
    "degradation_tolerance": 0.10,
    "degradation_metrics": [
        "roc_auc", "pr_auc", "ks_statistic", "brier_score", "precision", "recall", "calibration_slope",
    ],
    "min_matured_loans": 30,
    "violation_rate_warning": 0.02,
    "violation_rate_alert": 0.05,
    "min_new_labeled_loans": 500,
    "promotion_pr_auc_margin": 0.01,
    "calibration_slope_tolerance": 0.15,
}

# Model training.
COSTS = {"fn": 10.0, "fp": 1.0, "tp": 0.0, "tn": 0.0}
TRAIN_FRACTION = 0.70
VAL_FRACTION = 0.15
SEARCH = {"n_iter": 20, "cv_folds": 5}
LOGISTIC_GRID = {
    "C": [0.001, 0.01, 0.1, 1.0, 10.0, 100.0],
    "penalty": ["l2", "elasticnet"],
    "l1_ratio": [0.0, 0.3, 0.5, 0.7, 1.0],
}
FOREST_GRID = {
    "n_estimators": [100, 200, 400, 600],
    "max_depth": [4, 6, 8, 12, None],
    "min_samples_leaf": [1, 5, 10, 20],
    "max_features": ["sqrt", "log2", 0.5],
}
BOOSTED_GRID = {
    "n_estimators": [100, 200, 400],
    "max_depth": [3, 4, 6, 8],
    "learning_rate": [0.01, 0.05, 0.1, 0.2],
    "subsample": [0.6, 0.8, 1.0],
}
IMBALANCE_STRATEGIES = ["none", "class_weight", "smote", "random_undersampling", "smote_tomek"]
SEGMENT_COLUMNS = ["loan_type", "income_band", "age_band"]
