"""All core queries and their SQL, gathered from the operator modules."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from sievewright.functions import canonical
from sievewright.operators import candidates, checks, dedup, evidence, identity, pages, policies, records, relational, review
from sievewright.streaming import events

MODULES = (canonical, candidates, policies, checks, evidence, identity, dedup, review, records, relational, pages, events)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for m in MODULES for name, (f, _) in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in MODULES for name, (_, sql) in m.QUERIES.items() if sql}
