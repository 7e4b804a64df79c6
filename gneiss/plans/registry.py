"""Collects the queries and their SQL from the plan modules."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from gneiss.plans import answers, corpus, lifecycle, retrieval, stored, streams, tables

MODULES = [retrieval, corpus, tables, answers, lifecycle, stored, streams]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
    for module in MODULES:
        found.update(module.QUERIES)
    return found


def oracle_sql() -> dict[str, str]:
    found: dict[str, str] = {}
    for module in MODULES:
        found.update(module.ORACLE)
    return found
