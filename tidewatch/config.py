"""Every tunable of the engine, in one frozen object."""

from __future__ import annotations

from dataclasses import dataclass, field

# Enumerations and limits that results must agree on.
ANOMALY_CLASSES = (
    "normal",
    "credential_misuse",
    "lateral_movement",
    "brute_force",
    "impossible_travel",
    "credential_stuffing",
    "device_spoofing",
    "low_and_slow_exfil",
    "insider_drift",
)
ENTITY_TYPES = ("user", "service_account", "edge_device")
AUTH_METHODS = ("password", "token", "certificate", "biometric", "mfa")
TOP_VALUES = {
    "country": 20,
    "ip_prefix": 40,
    "resource": 40,
    "device_mac": 12,
    "device_os": 12,
    "token": 80,
    "ngram": 160,
}
MAX_CATEGORIES = {
    "resource_accessed": 200,
    "device_os": 60,
    "geo_country": 60,
    "entity_type": 10,
    "auth_method": 10,
    "device_protocol": 20,
    "cohort": 64,
}
SCHEMA_VERSION = 1


#: Groups that a table may be cut into; what is broadcast about them is bounded by this.
MAX_GROUPS = 100_000


@dataclass(frozen=True)
class Settings:
    # trailing window and live profile
    window_minutes: int = 60
    window_cap: int = 400
    refresh_every: int = 20
    geo_points: int = 250
    top_values: dict = field(default_factory=lambda: dict(TOP_VALUES))
    # cold start
    min_sessions: int = 15
    prior_sessions: int = 12
    prior_stat_floor: int = 8
    cold_uncertainty: float = 2.0
    # sequences
    sequence_len: int = 20
    ngram_n: int = 2
    min_token_count: int = 3
    # cohorts
    cohort_count: int = 6
    cohort_min_events: int = 10
    seed: int = 42
    # rules
    travel_kmh: float = 900.0
    travel_min_km: float = 2000.0
    brute_force_failures: int = 5
    override_confidence: float = 0.75
    keep_type_confidence: float = 0.5
    # risk
    alert_budget: float = 0.01
    alert_threshold: float = 60.0
    fusion: tuple = (0.35, 0.30, 0.35)
    uncertainty_scale: float = 0.8
    max_uncertainty: float = 50.0
    rule_floor: float = 90.0
    # drift
    drift_window: int = 200
    drift_min_samples: int = 50
    drift_bootstrap: int = 50
    drift_threshold: float = 0.2
    drift_bins: int = 10
    drift_alpha: float = 0.05
    drift_adapt_after: int = 3
    # campaigns and feedback
    campaign_gap_hours: float = 72.0
    feedback_step: float = 10.0
    feedback_bound: float = 40.0
    # physical: no group of rows larger than this is handed to one task. ``None`` means
    # max(1M rows, 1/10,000 of the table), which also bounds the number of oversized
    # entities (and of the slices they are cut into) by about 10,000.
    max_group_rows: int | None = None

    def group_limit(self, total_rows: int) -> int:
        if self.max_group_rows is not None:
            if self.max_group_rows < 1 or total_rows > self.max_group_rows * MAX_GROUPS:
                raise ValueError(f"max_group_rows={self.max_group_rows} would cut {total_rows} rows into more than {MAX_GROUPS} groups")
            return self.max_group_rows
        return max(1_000_000, total_rows // 10_000)


DEFAULTS = Settings()
