"""Registry of queries and their SQL counterparts."""

from __future__ import annotations

import importlib
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from ..fixtures import Views, with_views

MODULES = ["scoring", "cohort", "distribution", "projections", "intervals", "quality", "clinical", "reads", "ancestry", "mart", "sources"]


@dataclass(frozen=True)
class Check:
    build: Callable[[Views], DataFrame]
    sql: str | None


CHECKS: dict[str, Check] = {}


def check(name: str, sql: str | None = None):
    """Register a query; ``sql`` may name the ``v_`` views."""

    def add(build: Callable[[Views], DataFrame]):
        if name in CHECKS:
            raise ValueError(f"query {name} is registered twice")
        CHECKS[name] = Check(build, sql)
        return build

    return add


def load() -> dict[str, Check]:
    for module in MODULES:
        importlib.import_module(f"{__package__}.{module}")
    return CHECKS


def query_callables() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    def bind(build):
        return lambda spark, sf_dir: build(Views(spark, sf_dir))

    return {name: bind(c.build) for name, c in load().items()}


def oracle_texts() -> dict[str, str]:
    return {name: with_views(c.sql) for name, c in load().items() if c.sql}
