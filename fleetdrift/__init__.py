"""Schema drift analysis for a fleet of relational databases, on Spark.

Catalogs of many databases are tables keyed by ``db_id`` (one capture) or
``pair_id`` (one source/target comparison).  Every operator takes DataFrames
and returns a DataFrame; scalar functions map Columns to Columns.
"""

from fleetdrift.session import build_session, configure

__all__ = ["build_session", "configure"]
