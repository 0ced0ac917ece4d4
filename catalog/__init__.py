"""The registered queries: each operator applied to the driver tables, with its oracle SQL."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

SECTIONS = (
    "sources", "manifests", "scalars", "geometry", "series", "features",
    "classes", "joins", "ranking", "vectors", "warping",
)


def query(name: str, sql: str | None = None):
    """Register ``fn(tables) -> DataFrame`` under a name; ``tables(name)`` reads a table."""

    def register(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return fn(Tables(spark, sf_dir))

        QUERIES[name] = run
        if sql is not None:
            ORACLE[name] = sql
        return fn

    return register


class Tables:
    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __call__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")


def r6(c: Column | str, digits: int = 6) -> Column:
    """Round for comparison; the small shift keeps exact halves on one side everywhere."""
    x = F.col(c) if isinstance(c, str) else c
    return F.round(x.cast("double") + 1e-9, digits)


def R(x: str, digits: int = 6) -> str:
    """The same rounding as SQL text."""
    return f"round(CAST({x} AS DOUBLE) + 1e-9, {digits}) + 0.0"


def rounded(df: DataFrame, *columns: str, digits: int = 6) -> DataFrame:
    """Round the named columns, or every double column."""
    names = columns or [c for c, t in df.dtypes if t in ("double", "float")]
    return df.withColumns({c: r6(c, digits) for c in names})


def load() -> None:
    for section in SECTIONS:
        import_module(f"catalog.{section}")
