"""All queries of the package but those of the corpus operators."""

from __future__ import annotations

from tidewatch.plans import drifting, extraction, learning, projections, rasters, screening, streams, vessels, views  # noqa: F401
from tidewatch.plans.registry import ORACLES, QUERIES, Query


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracles() -> dict[str, str]:
    return dict(ORACLES)
