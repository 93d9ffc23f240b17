"""All registered queries in one place."""

from __future__ import annotations

from stampline.plans import (  # noqa: F401
    source_queries, cohort_queries, feature_queries, matching_queries, discrimination_queries,
    inference_queries, calibration_queries, arm_queries, signal_queries,
)
from stampline.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "flagship"]


def flagship(spark, sf):
    return QUERIES["e11_clustered_auroc_ci"](spark, sf)
