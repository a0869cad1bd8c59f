"""Settings and fixed values shared by every check."""

from __future__ import annotations

from dataclasses import dataclass, field

# Text markers read as missing, on top of the reader's own list.
MISSING_INDICATORS = ("?", "", " ", "NA", "N/A", "null", "NULL", "None")

# The markers a pandas CSV reader treats as missing by default.
DEFAULT_NA_TEXT = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan",
    "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a",
    "nan", "null",
)

# Plausible range of each clinical measurement, both ends allowed.
CLINICAL_RANGES = {
    "age": (0.0, 120.0),
    "blood_pressure_systolic": (50.0, 250.0),
    "blood_pressure_diastolic": (30.0, 150.0),
    "heart_rate": (20.0, 250.0),
    "temperature": (90.0, 110.0),
    "temperature_c": (32.0, 43.0),
    "oxygen_saturation": (0.0, 100.0),
    "respiratory_rate": (5.0, 60.0),
    "bmi": (10.0, 70.0),
    "weight_kg": (20.0, 300.0),
    "height_cm": (50.0, 250.0),
    "ECOG": (0.0, 4.0),
    "anxiety_score": (0.0, 10.0),
    "pain_score": (0.0, 10.0),
}

# Names of identifier columns; the first one present is checked.
ID_COLUMNS = ("patient_id", "id", "ID", "PatientID", "patient_ID", "record_id")


@dataclass(frozen=True)
class QualityConfig:
    """Thresholds of a data-quality run."""

    null_threshold_warning: float = 0.10
    null_threshold_critical: float = 0.50
    outlier_zscore_threshold: float = 3.0
    min_rows: int = 10
    max_examples: int = 20
    anomaly_contamination: float = 0.1
    # Above this many rows x numeric columns only Isolation Forest runs; None: no limit.
    max_data_points_for_ml: int | None = None
    missing_indicators: tuple[str, ...] = MISSING_INDICATORS

    ranges: dict[str, tuple[float, float]] = field(default_factory=lambda: dict(CLINICAL_RANGES))
    id_columns: tuple[str, ...] = ID_COLUMNS
    type_check_min_unique_fraction: float = 0.05
    type_check_examples: int = 10
    outlier_min_values: int = 10
    anomaly_min_rows: int = 50
    anomaly_min_columns: int = 2
    anomaly_neighbours: int = 20
    # "exact", or "forest" for many columns: neighbours from random trees, of which a few are missed.
    anomaly_neighbour_search: str = "exact"
    anomaly_trees: int = 100
    anomaly_tree_rows: int = 256
    anomaly_seed: int = 42
    # Rows flagged by one method are reported only up to this many; None: always.
    potential_anomaly_max_rows: int | None = None
    potential_anomaly_examples: int = 10
    sample_values: int = 5
    top_categories: int = 5
    approximate_distinct: bool = False
    run_anomaly_checks: bool = True


@dataclass(frozen=True)
class FairnessConfig:
    """Thresholds of a fairness audit."""

    demographic_parity_ratio_min: float = 0.8
    demographic_parity_ratio_max: float = 1.25
    demographic_parity_diff_threshold: float = 0.1
    equalized_odds_threshold: float = 0.1
    equal_opportunity_threshold: float = 0.1
    severity_high: float = 0.2
    severity_medium: float = 0.1
    positive_outcome_label: str = "high-risk"
    negative_outcome_label: str = "low-risk"
    clinical_context: str = "disease_prediction"
    min_group_size: int = 30
    max_intersection_depth: int = 3
    # Leave out intersections that change no rate by more than this beyond what the smaller ones
    # show, and what would come of them; None: keep all.
    intersection_tolerance: float | None = None
    # "as_coded": small groups stay in the parity and odds figures;
    # "strict": they are left out of every figure.
    small_groups: str = "as_coded"
