"""Importing this module fills the registry."""

from fleetdrift.plans import (  # noqa: F401
    catalog_queries,
    drift_queries,
    function_queries,
    order_queries,
    report_queries,
    row_queries,
    run_queries,
    rule_queries,
)
from fleetdrift.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
