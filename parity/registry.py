"""Where queries and their checks are collected."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from parity.views import Views


@dataclass(frozen=True)
class Case:
    build: Callable[[Views], DataFrame]
    check: str | Callable[[], str] | None

    @property
    def sql(self) -> str | None:
        return self.check() if callable(self.check) else self.check


CASES: dict[str, Case] = {}


def case(name: str, sql: str | Callable[[], str] | None):
    """Register a function of the views under a name, with its check."""
    def register(build: Callable[[Views], DataFrame]):
        if name in CASES:
            raise ValueError(f"two cases are named {name}")
        CASES[name] = Case(build, sql)
        return build

    return register


def run(name: str, spark: SparkSession, sf_dir: str) -> DataFrame:
    return CASES[name].build(Views(spark, sf_dir))
