"""Named query plans, and the SQL that each is held against.

A plan module has ``QUERIES`` (name to a function of session and folder) and ``SQL`` (name to a
statement over the same tables; left out where SQL can't express the plan).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import answers, checks, corpus, evaluation, frame, measures, memory, reports, retrieval, rules

_MODULES = (corpus, retrieval, frame, measures, checks, memory, reports, answers, rules, evaluation)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: plan for module in _MODULES for name, plan in module.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for module in _MODULES for name, sql in module.SQL.items()}
