"""Importing this module registers every query."""

from routelens.plans import (  # noqa: F401
    arm_queries,
    cascade_queries,
    data_queries,
    io_queries,
    metric_queries,
    model_queries,
    policy_queries,
    report_queries,
    resampling_queries,
    study_queries,
    text_queries,
)
from routelens.plans.registry import COVERS, ORACLES, QUERIES  # noqa: F401
