"""All queries by name."""

from __future__ import annotations

from plumbline.catalog import anomaly, drift, fairness, models, quality, repairs
from plumbline.catalog.views import Query

REGISTRY: dict[str, tuple[Query, str | None]] = {
    **quality.QUERIES,
    **fairness.QUERIES,
    **models.QUERIES,
    **repairs.QUERIES,
    **anomaly.QUERIES,
    **drift.QUERIES,
}
