"""Registered queries and their SQL."""

from beamlake.plans import pipelines
from beamlake.plans.catalog import QUERIES, SQL

__all__ = ["QUERIES", "SQL", "pipelines"]
