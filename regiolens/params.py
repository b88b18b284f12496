"""Analysis parameters (driver-side, frozen).

The defaults are the fixed thresholds the outputs must agree on; they are kept
together here as plain values.
"""

from __future__ import annotations

from dataclasses import dataclass, field

# ---------------------------------------------------------------------------
# Fixed values (must stay equal for matching results)
# ---------------------------------------------------------------------------

# Reference list of valid state / union territory names, in natural order.
VALID_STATES: tuple[str, ...] = (
    "Andhra Pradesh",
    "Arunachal Pradesh",
    "Assam",
    "Bihar",
    "Chhattisgarh",
    "Goa",
    "Gujarat",
    "Haryana",
    "Himachal Pradesh",
    "Jharkhand",
    "Karnataka",
    "Kerala",
    "Madhya Pradesh",
    "Maharashtra",
    "Manipur",
    "Meghalaya",
    "Mizoram",
    "Nagaland",
    "Odisha",
    "Punjab",
    "Rajasthan",
    "Sikkim",
    "Tamil Nadu",
    "Telangana",
    "Tripura",
    "Uttar Pradesh",
    "Uttarakhand",
    "West Bengal",
    "Andaman and Nicobar Islands",
    "Chandigarh",
    "Dadra and Nagar Haveli and Daman and Diu",
    "Delhi",
    "Jammu and Kashmir",
    "Ladakh",
    "Lakshadweep",
    "Puducherry",
)

# Calendar month -> context text of a forecast surge; other months are routine.
SURGE_CONTEXT: dict[int, str] = {
    3: "End of Financial Year - Resource Alignment",
    4: "New School Session - Child Enrollment Drive",
    5: "New School Session - Child Enrollment Drive",
    6: "New School Session - Late Enrollments",
    7: "Monsoon Session - Operational Constraints",
    10: "Festive Season - Administrative Lull",
    11: "Post-Harvest - Rural Enrollment Spike",
}
SURGE_CONTEXT_DEFAULT = "Routine Enrollment Cycle"

# Severity level -> label.
SEVERITY_LABELS: tuple[str, ...] = ("NORMAL", "LOW", "MEDIUM", "HIGH", "CRITICAL")

# Priority tiers: upper bounds of (0,25], (25,50], (50,75], (75,100].
PRIORITY_TIERS: tuple[tuple[str, float], ...] = (
    ("Low", 25.0),
    ("Medium", 50.0),
    ("High", 75.0),
    ("Critical", 100.0),
)


@dataclass(frozen=True)
class Scenario:
    name: str
    enrollment_increase_pct: float = 10.0
    target_districts: tuple[str, ...] | None = None  # None = all districts


@dataclass(frozen=True)
class Params:
    # data governance
    extreme_percentile: float = 99.0
    governance_iqr_multiplier: float = 1.5
    governance_z_threshold: float = 3.0
    dri_weights: tuple[float, float, float] = (0.4, 0.3, 0.3)  # completeness, consistency, validity
    min_acceptable_dri: float = 0.7
    pincode_min: int = 100000
    pincode_max: int = 999999
    measure_min: int = 0
    measure_max: int = 100000
    min_valid_date: str = "2010-01-01"
    pin_daily_typical: tuple[int, int, int] = (0, 1000, 5000)  # typical min, typical max, extreme max
    district_monthly_typical: tuple[int, int, int] = (100, 50000, 200000)
    # descriptive
    top_n_states: int = 10
    top_n_districts: int = 20
    n_clusters: int = 5
    cluster_restarts: int = 10
    seed: int = 42
    child_adult_ratio_threshold: float = 2.0
    underserved_fraction: float = 0.5
    # anomaly
    z_threshold: float = 3.0
    iqr_multiplier: float = 1.5
    quantile_lower: float = 0.01
    quantile_upper: float = 0.99
    change_threshold: float = 0.5
    contamination: float = 0.04
    forest_trees: int = 300
    forest_subsample: int = 256
    severity_levels: tuple[int, int, int, int] = (1, 2, 3, 4)
    # forecasting
    horizon_short: int = 3
    horizon_long: int = 6
    seasonal_period: int = 12
    sarima_order: tuple[int, int, int] = (2, 1, 2)
    seasonal_order: tuple[int, int, int, int] = (1, 1, 1, 12)
    gbt_trees: int = 300
    gbt_depth: int = 6
    gbt_rate: float = 0.1
    confidence_levels: tuple[float, ...] = (0.80, 0.95)
    surge_percentile: float = 95.0
    # policy
    priority_weights: tuple[float, float, float, float] = (0.3, 0.25, 0.25, 0.2)
    enrollment_per_center: int = 500
    enrollment_per_staff: int = 100
    low_enrollment_fraction: float = 0.6
    inequity_high: float = 0.7
    default_dri: float = 0.7
    # privacy
    k_anonymity: int = 5
    min_group_size: int = 10
    # exact percentiles by default; approx only behind this flag
    approx_percentiles: bool = False
    approx_accuracy: int = 10000
    scenarios: tuple[Scenario, ...] = field(
        default_factory=lambda: (Scenario("Universal Outreach Campaign", 15.0, None),)
    )


DEFAULT_PARAMS = Params()


# Recommendation texts
INEQUITY_TEXTS = (
    "CRITICAL: %d districts identified as underserved. Prioritize resource allocation and outreach programs.",
    "ATTENTION: %d districts show low enrollment. Consider targeted interventions.",
    "High enrollment inequality detected (CV=%.2f). Geographic disparities require policy intervention.",
)
INEQUITY_FINE = "Enrollment distribution is relatively equitable."
ANOMALY_TEXTS = (
    "URGENT: %d critical anomalies detected. Immediate investigation required.",
    "ATTENTION: %d high-severity anomalies. Review data quality and enrollment processes.",
    "Frequent temporal anomalies detected (%d days). Investigate enrollment system stability.",
    "Widespread geographic anomalies (%d districts). Review regional data collection processes.",
)
ANOMALY_FINE = "No significant anomalies detected. Data quality is acceptable."
QUALITY_TEXTS = (
    "CRITICAL: Fix schema validation issues before analysis",
    "Improve data completeness: investigate missing values",
    "Fix data consistency: verify total enrollment calculations",
    "Validate data ranges: check for invalid values",
)
QUALITY_FINE = "Data quality is satisfactory for analysis"
POLICY_TEXTS = (
    "URGENT: %d districts require immediate attention. Deploy rapid response teams for enrollment acceleration.",
    "Large-scale infrastructure needed: %d enrollment centers. Consider phased rollout strategy.",
    "%d districts need critical interventions. Establish dedicated task force.",
    "Implement continuous monitoring system to track policy impact and adjust strategies.",
)
