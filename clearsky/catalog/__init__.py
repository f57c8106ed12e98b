"""The operators on the driver's tables, each with the SQL that checks it."""

from clearsky.catalog import evaluation, features, joins, live, oversampling, prep, recordings, reports, storage  # noqa: F401
from clearsky.catalog.base import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
