"""The registry of queries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from workweave.sources.fixtures import Plan

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(name: str, regions: list[str] | None = None):
    """Register a function of a ``Plan``; dates leave as ISO text."""

    def register(build: Callable[[Plan], DataFrame]):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return _iso_dates(build(Plan(spark, sf_dir, regions)))

        run.__name__ = name
        QUERIES[name] = run
        return build

    return register


def _iso_dates(df: DataFrame) -> DataFrame:
    dates = {c: F.col(f"`{c}`").cast("string") for c, t in df.dtypes if t == "date"}
    return df.withColumns(dates) if dates else df
