"""Checks on the shape of inputs, made before any data is read."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F


class InputError(ValueError):
    """An input table or file does not have what an operator needs."""


def require_columns(df: DataFrame, columns: Sequence[str], what: str = "table") -> DataFrame:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise InputError(f"{what} lacks columns: {', '.join(missing)}")
    return df


def require_any_numeric(columns: Sequence[str], what: str = "table") -> None:
    if not columns:
        raise InputError(f"{what} has no usable numeric feature column")


def must_hold(condition: Column, message: str) -> Column:
    """True where the condition holds; the job fails with the message elsewhere."""
    return F.when(condition, F.lit(True)).otherwise(F.raise_error(F.lit(message)).cast("boolean"))


def single_corpus(df: DataFrame, dataset: str = "dataset") -> DataFrame:
    """Fail at run time when more than one corpus is present.

    One row (the smallest and largest corpus name) travels to the check, so the
    rows themselves are neither shuffled nor counted twice.
    """
    require_columns(df, [dataset])
    span = df.agg(F.min(dataset).alias("_first"), F.max(dataset).alias("_last"))
    ok = span.select(must_hold(F.col("_first").eqNullSafe(F.col("_last")), "more than one corpus in one source"))
    return df.filter(ok.scalar())
