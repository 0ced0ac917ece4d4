"""What is in a table or in stored arrays, and what a merge did."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F, types as T


def profile_table(df: DataFrame) -> DataFrame:
    """One row per column: type, kind, rows, missing and NaN values, from one pass."""
    fields = df.schema.fields
    floating = (T.DoubleType, T.FloatType)
    aggs = [F.count(F.lit(1)).alias("_rows")]
    for i, f in enumerate(fields):
        c = F.col(f"`{f.name}`")
        aggs.append(F.count(F.when(c.isNull(), 1)).alias(f"_null_{i}"))
        if isinstance(f.dataType, floating):
            aggs.append(F.count(F.when(F.isnan(c), 1)).alias(f"_nan_{i}"))
    one = df.agg(*aggs)
    rows = [
        F.struct(
            F.lit(f.name).alias("column"),
            F.lit(f.dataType.simpleString()).alias("dtype"),
            F.lit("numeric" if isinstance(f.dataType, T.NumericType) else "categorical").alias("kind"),
            F.col("_rows").alias("rows"),
            F.col(f"_null_{i}").alias("nulls"),
            (F.col(f"_nan_{i}") if isinstance(f.dataType, floating) else F.lit(0).cast("long")).alias("nans"),
        )
        for i, f in enumerate(fields)
    ]
    return one.select(F.explode(F.array(*rows)).alias("_r")).select("_r.*")


def profile_arrays(df: DataFrame, keys: Sequence[str], array: str) -> DataFrame:
    """Per key and array length: how many, how many with NaN, Inf or no value, and whether
    the key has one length only."""
    a = F.col(array)
    has = lambda test: F.count(F.when(F.exists(a, test), 1))
    shapes = df.groupBy(*keys, F.size(a).alias("length")).agg(
        F.count(F.lit(1)).alias("arrays"),
        has(lambda v: F.isnan(v)).alias("with_nan"),
        has(lambda v: F.abs(v) == F.lit(float("inf"))).alias("with_inf"),
        F.count(F.when(F.size(a) == 0, 1)).alias("empty"),
    )
    verdict = shapes.groupBy(*keys).agg((F.count(F.lit(1)) == 1).alias("consistent"))
    return shapes.join(verdict, list(keys))


def facts(df: DataFrame, named: dict[str, Column]) -> DataFrame:
    """Named whole-table aggregates as (fact, value) rows."""
    one = df.agg(*[c.cast("double").alias(n) for n, c in named.items()])
    return one.unpivot([], list(named), "fact", "value")


def merge_facts(before: DataFrame, after: DataFrame, *, video: Sequence[str], label: Sequence[str]) -> DataFrame:
    """Rows before and after collapsing to one row per video, with distinct videos and labels."""
    distinct = lambda cols: F.count_distinct(F.struct(*cols))
    left = facts(before, {"rows_before": F.count(F.lit(1)), "unique_videos": distinct(video), "unique_labels": distinct(label)})
    return left.unionByName(facts(after, {"rows_after": F.count(F.lit(1))}))


def mapping_facts(mapping: DataFrame, left_labels: DataFrame, right_labels: DataFrame, left: str, right: str) -> DataFrame:
    """Rows, distinct pairs, duplicates, and pairs matched or missing on either side."""
    from seqatlas.operators.joins import mapping_status

    status = mapping_status(mapping, left_labels, right_labels, left, right)
    count = lambda s: F.count(F.when(F.col("status") == s, 1))
    pairs = facts(
        status,
        {
            "mapping_pairs_unique": F.count(F.lit(1)),
            "mapping_pairs_matched": count("matched"),
            "missing_left": count("missing_left"),
            "missing_right": count("missing_right"),
            "duplicate_pairs_removed": F.sum(F.col("copies") - 1),
        },
    )
    return facts(mapping, {"mapping_rows": F.count(F.lit(1))}).unionByName(pairs)
