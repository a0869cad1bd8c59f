"""Wording of the reports. Callers and stored reports rely on these lines."""

# Description of each issue type; the fields are filled per issue.
ISSUE_TEXT = {
    "EMPTY_DATASET": "Dataset has no rows",
    "NO_COLUMNS": "Dataset has no columns",
    "DUPLICATE_COLUMNS": "Duplicate column names found: {names}",
    "UNNAMED_COLUMNS": "Found {n} unnamed columns (possible CSV parsing issue)",
    "INSUFFICIENT_ROWS": "Dataset has only {n} rows (minimum recommended: {limit})",
    "DUPLICATE_ROWS": "Found {n} duplicate rows",
    "DUPLICATE_IDS": "Column '{column}' has {n} duplicate values (should be unique)",
    "EMPTY_COLUMN": "Column '{column}' is completely empty (100% null)",
    "HIGH_NULL_RATE": "Column '{column}' has {percent} missing values",
    "MODERATE_NULL_RATE": "Column '{column}' has {percent} missing values",
    "LOW_NULL_RATE": "Column '{column}' has {percent} missing values ({n} rows)",
    "TYPE_INCONSISTENCY": "Column '{column}' appears numeric but has {n} non-numeric values",
    "VALUE_BELOW_RANGE": "Column '{column}' has {n} values below minimum ({limit})",
    "VALUE_ABOVE_RANGE": "Column '{column}' has {n} values above maximum ({limit})",
    "STATISTICAL_OUTLIER": "Column '{column}' has {n} statistical outliers (|z-score| > {limit})",
    "ML_ANOMALY_DETECTION_SKIPPED": (
        "ML anomaly detection (Isolation Forest + LOF) disabled for performance. Dataset has "
        "{n:,} data points (limit: {limit:,}). Use statistical outlier detection instead."
    ),
    "MULTIVARIATE_ANOMALY": "Found {n} high-confidence anomalies (both IF and LOF agree)",
    "POTENTIAL_ANOMALY": "Found {n} potential anomalies (one algorithm flagged)",
}

# Recommendation lines in order, each with the issue types that call for it.
QUALITY_ADVICE = (
    (("DUPLICATE_IDS",),
     "🚨 CRITICAL: Duplicate patient IDs detected. Deduplicate before proceeding."),
    (("VALUE_BELOW_RANGE", "VALUE_ABOVE_RANGE"),
     "🚨 CRITICAL: Impossible clinical values detected. Review data entry or unit conversions."),
    (("HIGH_NULL_RATE", "EMPTY_COLUMN"),
     "🚨 CRITICAL: Columns with >50% missing. Consider removing or investigating data collection."),
    (("TYPE_INCONSISTENCY",),
     "⚠️ WARNING: Mixed types found. Clean or convert before model training."),
    (("DUPLICATE_ROWS",),
     "⚠️ WARNING: Duplicate rows found. Verify if legitimate or errors."),
    (("STATISTICAL_OUTLIER",),
     "⚠️ WARNING: Statistical outliers detected. Review for validity."),
    (("MULTIVARIATE_ANOMALY",),
     "⚠️ WARNING: ML detected unusual row patterns. Manual review recommended."),
)
QUALITY_ADVICE_NONE = "✅ No major issues. Data appears suitable for ML pipeline."

# Fairness recommendation lines.
FAIRNESS_ADVICE_NONE = "No bias violations detected. Continue monitoring with new data."
FAIRNESS_ADVICE_HIGH = (
    "⚠️ HIGH SEVERITY: Flag all predictions for manual clinical review until bias is addressed"
)
FAIRNESS_ADVICE_DATA = "Review training data for {attribute}-based representation imbalance"
FAIRNESS_ADVICE_GROUP = "Consider threshold adjustment for {group} patient predictions"
FAIRNESS_ADVICE_METRIC = (
    ("equal_opportunity_difference",
     "Sensitivity differs across groups — investigate features correlated "
     "with protected attributes"),
    ("equalized_odds_difference",
     "Consider fairness-aware training methods (e.g., reweighting, adversarial debiasing)"),
)
FAIRNESS_ADVICE_LAST = "Document bias findings for regulatory compliance (FDA AI/ML guidelines)"
