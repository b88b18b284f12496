"""All registered queries and oracles (import side effect fills the registry)."""

from __future__ import annotations

from regiolens.plans import q_anomaly, q_describe, q_forecast, q_policy, q_quality, q_report, q_storage  # noqa: F401
from regiolens.plans import q_summary  # noqa: F401,E402  (uses the oracles registered above)
from regiolens.plans.registry import ORACLES, QUERIES

__all__ = ["QUERIES", "ORACLES"]
