"""Queries over the driver's tables, one module for each family of operators."""

from turnloom.plans import audits, base, distributions, histories, rule_queries, scoring, statistics, streams
from turnloom.plans.base import QUERIES, SQL

__all__ = ["QUERIES", "SQL", "audits", "base", "distributions", "histories", "rule_queries", "scoring", "statistics", "streams"]
