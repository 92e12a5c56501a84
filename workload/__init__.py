"""The registered queries and the SQL each is checked against."""

from workload import analytics, charts, features, io, prep, profile, series, stats, streams, text  # noqa: F401
from workload.base import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES"]
