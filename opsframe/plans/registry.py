"""Registered queries, each with the text that gives the same rows on plain SQL where one exists."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from opsframe.plans import views


class Inputs:
    """The given tables and the views on them."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir

    def __getitem__(self, name: str) -> DataFrame:
        if name in views.VIEWS:
            return views.view(self.spark, self.sf_dir, name)
        return views.table(self.spark, self.sf_dir, name)

    def sql(self, text: str, **bound: DataFrame) -> DataFrame:
        return views.select(self.spark, self.sf_dir, text, **bound)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, check: str | None = None, using: str = "") -> Callable:
    """Register a function of ``Inputs``; ``check`` is its plain SQL over the views named in ``using``."""

    def register(build: Callable[[Inputs], DataFrame]) -> Callable[[Inputs], DataFrame]:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return build(Inputs(spark, sf_dir))

        run.__name__ = name
        QUERIES[name] = run
        if check is not None:
            ORACLES[name] = views.with_views(using, check) if using else check
        return build

    return register
