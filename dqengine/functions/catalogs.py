"""The word lists, patterns, weights and catalogs that the rules are defined by, in their natural order."""

NULL_TOKENS = [
    "n/a", "na", "null", "none", "nil", "missing", "unknown", "--", "-", ".", "..", "...", "?", "??", "???", "not available", "not applicable", "no data",
    "no value", "empty", "blank", "undefined", "void", "nan", "n.a.", "#n/a", "#null!", "#value!", "#ref!", "#div/0!", "#num!", "<null>", "<na>", "<none>", "<missing>", "<blank>",
]
CLAIM_NULL_TOKENS = ["n/a", "na", "null", "none", "nan", "missing", "--", "?", "not available", "not applicable", "unknown", "nil", "empty"]
SAMPLE_NULL_PARTS = ["nan", " nan ", "null", "n/a", "#n/a", "na"]
BOOLEAN_TOKENS = "true false yes no y n 1 0 on off active inactive enabled disabled valid invalid success failure pass fail".split()
NUMBER_WORDS = (
    "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty "
    "thirty forty fifty sixty seventy eighty ninety hundred thousand million"
).split()
ORDINAL = r"(first|second|third|\d+(st|nd|rd|th))"
NUMERIC = r"[+-]?((\d+(_\d+)*)(\.(\d+(_\d+)*)?)?|\.\d+(_\d+)*)([eE][+-]?\d+(_\d+)*)?"
NUMERIC_WORDS = ["nan", "inf", "infinity", "+nan", "-nan", "+inf", "-inf", "+infinity", "-infinity"]
DATETIME_STARTS = [r"\d{1,2}/\d{1,2}/\d{4}", r"\d{4}-\d{2}-\d{2}", r"\w+\s+\d{1,2},\s+\d{4}", r"\d{1,2}-\w+-\d{4}"]
ABBREVIATIONS = {"m": ["male", "man"], "f": ["female", "woman"], "y": ["yes", "true"], "n": ["no", "false"], "st": ["street"], "ave": ["avenue"], "dr": ["doctor", "drive"]}
PLACEHOLDERS = [r"test\d*", r"dummy\d*", r"placeholder\d*", r"temp\d*", r"sample\d*", r"example\d*", r"default\d*", "tbd", "todo", "fixme", "xxx+", "aaa+", "zzz+"]
ENTITY = r"&[a-zA-Z]+;|&#\d+;"
UNITS = {
    "currency": [r"\$\d+", r"\d+\s*dollars?", r"\d+\s*usd", r"\d+k", r"\d+m"],
    "percentage": [r"\d+%", r"\d+\s*percent", r"0\.\d+", r"\d+\s*pct"],
    "phone": [r"\d{3}-\d{3}-\d{4}", r"\(\d{3}\)\s*\d{3}-\d{4}", r"\d{10}", r"\+1-\d{3}-\d{3}-\d{4}"],
    "date": [r"\d{2}/\d{2}/\d{4}", r"\d{4}-\d{2}-\d{2}", r"\w+\s+\d{1,2},\s+\d{4}"],
}
DATE_FORMATS = {
    "MM/DD/YYYY": r"\d{1,2}/\d{1,2}/\d{4}",
    "YYYY-MM-DD": r"\d{4}-\d{2}-\d{2}",
    "DD-MM-YYYY": r"\d{2}-\d{2}-\d{4}",
    "Month DD, YYYY": r"\w+\s+\d{1,2},\s+\d{4}",
    "DD Month YYYY": r"\d{1,2}\s+\w+\s+\d{4}",
}
PHONE_FORMATS = {"dashed": r"\d{3}-\d{3}-\d{4}", "parenthesised": r"\(\d{3}\)\s*\d{3}-\d{4}", "digits": r"\d{10}", "country": r"\+1-\d{3}-\d{3}-\d{4}", "dotted": r"\d{3}\.\d{3}\.\d{4}"}
LEAK_NAMES = {
    "temporal": (
        "exit_date termination_date left_date churn_date departure_date resignation_date quit_date purchase_date conversion_date transaction_date "
        "completion_date success_date failure_date end_date finish_date final_date"
    ).split(),
    "outcome": (
        "is_churned did_churn churned will_churn did_buy purchased converted will_buy is_fraud fraud_flag fraudulent outcome result target label success failure won lost "
        "approved rejected accepted denied"
    ).split(),
    "identifier": "customer_id user_id account_id session_id transaction_id order_id ticket_id case_id employee_id patient_id student_id".split(),
    "aggregation": "total_purchases lifetime_value total_spent num_transactions avg_rating final_score cumulative_ total_ sum_ count_ avg_".split(),
}
LEAK_RISK = {"temporal": "high", "outcome": "high", "identifier": "medium", "aggregation": "medium"}
DATE_PAIRS = [("hire_date", "termination_date"), ("start_date", "end_date"), ("birth_date", "death_date"), ("created_date", "modified_date"), ("order_date", "ship_date")]
TARGET_NAMES = "target label y class output outcome result prediction churn fraud default".split()
TEMPORAL_HINTS = ["date", "time", "created", "updated"]
DATE_PARSE_FORMATS = ["yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd", "M/d/yyyy", "dd-MM-yyyy", "d MMM yyyy", "MMMM d, yyyy"]
"""Formats that a string is read as a date by, in this order; no others are guessed."""

SCORE_WEIGHTS = {"data_quantity": 0.20, "data_completeness": 0.20, "data_consistency_validity": 0.20, "signal_to_noise_ratio": 0.25, "target_suitability": 0.15}
GRADES = [(90, "A"), (80, "B"), (70, "C"), (60, "D")]
IMPACT = {
    "mixed_data_types": 0.95, "semantic_nulls": 0.85, "inconsistent_formats": 0.75, "high_missing_percentage": 0.80, "correlated_missing": 0.70,
    "outliers_extreme": 0.65, "duplicates": 0.60, "low_cardinality": 0.50, "encoding_issues": 0.40, "minor_inconsistencies": 0.30,
}
SEVERITY = {"CRITICAL": 1.0, "HIGH": 0.8, "MEDIUM": 0.6, "LOW": 0.4, "MINOR": 0.2}
COMBINATIONS = [(("mixed_data_types", "semantic_nulls"), 8.0), (("mixed_data_types", "inconsistent_formats"), 6.0), (("high_missing_percentage", "correlated_missing"), 5.0)]

# name, handles missing values, handles categories, interpretable; the order breaks ties.
CLASSIFIERS = [
    ("XGBoost Classifier", True, True, False),
    ("Random Forest Classifier", False, True, True),
    ("LightGBM Classifier", True, True, False),
    ("Logistic Regression", False, False, True),
    ("Support Vector Machine (SVM)", False, False, False),
]
REGRESSORS = [
    ("XGBoost Regressor", True, True, False),
    ("Random Forest Regressor", False, True, True),
    ("Linear Regression", False, False, True),
    ("LightGBM Regressor", True, True, False),
    ("ElasticNet Regression", False, False, True),
]
