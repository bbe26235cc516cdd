"""The queries of the benchmark tables, each with the SQL that checks it."""

from workload import detection, exploring, folders, parsing, streams  # noqa: F401  registers the queries
from workload.base import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
