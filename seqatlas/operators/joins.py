"""Merges of feature tables, mapped pairs and pairs inside groups."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from seqatlas.distribution import number_rows, salted_join, tile_pairs
from seqatlas.guards import InputError, must_hold


def merge_outer(tables: Sequence[DataFrame], keys: Sequence[str]) -> DataFrame:
    """Full outer merge of tables that have one row per key; keys are coalesced."""
    return reduce(lambda a, b: a.join(b, list(keys), "full"), tables)


def merge_inner(tables: Sequence[DataFrame], keys: Sequence[str]) -> DataFrame:
    """Inner merge; a job that finds no common key fails."""
    merged = reduce(lambda a, b: a.join(b, list(keys), "inner"), tables)
    some = merged.limit(1).agg(must_hold(F.count(F.lit(1)) > 0, "the tables have no key in common").alias("_ok"))
    return merged.filter(some.scalar())


def distinct_pairs(df: DataFrame, left: str, right: str) -> DataFrame:
    """Each pair once, with the number of its copies."""
    trimmed = df.select(F.trim(F.col(left).cast("string")).alias(left), F.trim(F.col(right).cast("string")).alias(right))
    usable = trimmed.filter(
        (F.col(left) != "") & (F.col(right) != "") & (F.lower(left) != "nan") & (F.lower(right) != "nan")
    )
    return usable.groupBy(left, right).agg(F.count(F.lit(1)).alias("copies"))


def mapping_status(
    mapping: DataFrame, left_labels: DataFrame, right_labels: DataFrame, left: str, right: str
) -> DataFrame:
    """Distinct mapped pairs as matched, missing_left or missing_right (left is checked first)."""
    pairs = distinct_pairs(mapping, left, right)
    l = left_labels.select(F.col(left)).distinct().withColumn("_l", F.lit(True))
    r = right_labels.select(F.col(right)).distinct().withColumn("_r", F.lit(True))
    status = F.when(F.col("_l").isNull(), "missing_left").when(F.col("_r").isNull(), "missing_right").otherwise("matched")
    return pairs.join(l, left, "left").join(r, right, "left").select(left, right, "copies", status.alias("status"))


def mapped_pairs(
    mapping: DataFrame, left_rows: DataFrame, right_rows: DataFrame, left: str, right: str
) -> DataFrame:
    """Distinct mapped pairs with the columns of both sides (one row per label on each)."""
    pairs = distinct_pairs(mapping, left, right).drop("copies")
    return pairs.join(left_rows, left).join(right_rows, right)


def region_pairs(df: DataFrame, base: str, region: str, values: Sequence[str], dataset: Sequence[str] = ()) -> DataFrame:
    """Pairs of regional variants of one base label, in region order.

    A base has one row per region, at most a handful, so the self join stays small per key.
    """
    keys = [*dataset, base]
    side = lambda s: df.select(
        *keys, F.col(region).alias(f"{region}_{s}"), *[F.col(v).alias(f"{v}_{s}") for v in values]
    )
    return side("a").join(side("b"), keys).filter(F.col(f"{region}_a") < F.col(f"{region}_b"))


def pairs_within(df: DataFrame, ident: str, groups: Sequence[str] = (), *, block_rows: int = 1_024) -> DataFrame:
    """Unordered pairs inside each group (or the whole table), spread over tiles."""
    return tile_pairs(df, ident, groups, block_rows=block_rows)


def attach_small(rows: DataFrame, labels: DataFrame, key: str | Sequence[str]) -> DataFrame:
    """Left join of a label table of any size; adaptive execution broadcasts it when its measured size allows."""
    return rows.join(labels, key, "left")


def attach_salted(rows: DataFrame, labels: DataFrame, keys: Sequence[str], salt_on: Sequence[str]) -> DataFrame:
    """Left join of a table with one row per key to rows whose keys may be very unequal."""
    return salted_join(rows, labels, keys, salt_on=salt_on, how="left")
