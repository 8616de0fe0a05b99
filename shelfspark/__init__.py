"""shelfspark: retail stock and sales analytics as Spark DataFrame operators.

Every public operator is a function from DataFrames to DataFrames. Nothing
runs until an action is called, so Catalyst sees the whole plan: filters
reach the Parquet scans, only used columns are read, and joins and
aggregates are planned (and re-planned by AQE) by Spark itself.
"""

from shelfspark.session import build_session, checkpoint_dir, configure

__all__ = ["build_session", "checkpoint_dir", "configure"]
