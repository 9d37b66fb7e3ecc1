"""Queries over the driver's tables with their SQL counterparts."""

from checks import catalogue, dashboard, extraction, jobs, texts
from checks.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "catalogue", "dashboard", "extraction", "jobs", "texts"]
