"""Importing the query modules fills the registry."""

from tidemark.plans import ledger, models, news, portfolio, prices, series, streams  # noqa: F401
from tidemark.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
