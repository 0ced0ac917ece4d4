"""Similarity of mapped labels of two corpora and of regional variants."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window, functions as F

from seqatlas.distribution import attach_row, exact_quantiles
from seqatlas.functions.numbers import similarity_score
from seqatlas.functions.text import feature_group
from seqatlas.operators.joins import mapped_pairs, region_pairs
from seqatlas.operators.scaling import cosine


def cosine_pairs(
    mapping: DataFrame, left_rows: DataFrame, right_rows: DataFrame, left: str, right: str
) -> DataFrame:
    """Score of each distinct mapped pair; the label rows have ``vector`` and ``samples``."""
    side = lambda df, key, s: df.select(key, F.col("vector").alias(f"vector_{s}"), F.col("samples").alias(f"samples_{s}"))
    pairs = mapped_pairs(mapping, side(left_rows, left, "left"), side(right_rows, right, "right"), left, right)
    cos = cosine("vector_left", "vector_right")
    return pairs.withColumn("cosine_similarity", cos).withColumn("similarity_score", similarity_score(F.col("cosine_similarity")))


def contributions(pairs: DataFrame, keys: Sequence[str], names: Sequence[str], left: str = "vector_left", right: str = "vector_right") -> DataFrame:
    """Absolute feature differences of a pair summed by feature group, with their share."""
    diffs = F.zip_with(left, right, lambda x, y: F.abs(x - y))
    named = F.zip_with(F.array(*[F.lit(n) for n in names]), diffs, lambda n, d: F.struct(n.alias("n"), d.alias("d")))
    by_group = (
        pairs.select(*keys, F.explode(named).alias("_x"))
        .groupBy(*keys, feature_group(F.col("_x.n")).alias("feature_group"))
        .agg(F.sum("_x.d").alias("difference"))
    )
    total = F.sum("difference").over(Window.partitionBy(*keys))
    return by_group.withColumn("share", F.when(total > 0, F.col("difference") / total).otherwise(F.lit(0.0)))


def contribution_summary(pairs: DataFrame, keys: Sequence[str], names: Sequence[str], count: int = 3, **sides) -> DataFrame:
    """The leading feature groups of each pair as one text. There are six groups at most."""
    rows = contributions(pairs, keys, names, **sides)
    w = Window.partitionBy(*keys).orderBy(F.col("difference").desc(), F.col("feature_group"))
    top = rows.withColumn("_nth", F.row_number().over(w)).filter(F.col("_nth") <= count)
    text = F.concat(F.col("feature_group"), F.lit(" ("), F.format_string("%.1f", F.col("share") * 100), F.lit("%)"))
    ordered = F.array_sort(F.collect_list(F.struct("_nth", text.alias("t"))))
    return top.groupBy(*keys).agg(F.array_join(F.transform(ordered, lambda x: x["t"]), "; ").alias("top_difference_features"))


def score_statistics(scores: DataFrame, value: str, groups: Sequence[str] = ()) -> DataFrame:
    """Mean, median, population deviation, extremes and quartiles as (metric, value) rows."""
    keys = list(groups)
    one = scores.groupBy(*keys).agg(
        F.avg(value).alias("Mean Similarity"),
        F.stddev_pop(value).alias("Standard Deviation"),
        F.min(value).alias("Minimum"),
        F.max(value).alias("Maximum"),
    )
    q = exact_quantiles(scores, keys, value, {"Median": 0.5, "Percentile 25": 0.25, "Percentile 75": 0.75}, few_groups=True)
    wide = one.join(q, keys) if keys else attach_row(one, q)
    return wide.unpivot(keys, [c for c in wide.columns if c not in keys], "metric", "value")


def regional(labels: DataFrame, *, base: str = "base", region: str = "region", vector: str = "vector") -> DataFrame:
    pairs = region_pairs(labels, base, region, [vector])
    cos = cosine(f"{vector}_a", f"{vector}_b")
    return pairs.select(
        base, f"{region}_a", f"{region}_b", cos.alias("cosine_similarity"), similarity_score(cos).alias("similarity_score")
    ).withColumn("region_pair", F.concat_ws("-", f"{region}_a", f"{region}_b"))


def regional_statistics(pairs: DataFrame) -> DataFrame:
    return pairs.groupBy("region_pair").agg(F.avg("similarity_score").alias("mean_similarity"), F.count(F.lit(1)).alias("pair_count"))


def regional_matrix(pairs: DataFrame, region_pair_values: Sequence[str], base: str = "base") -> DataFrame:
    pick = lambda p: F.avg(F.when(F.col("region_pair") == p, F.col("similarity_score"))).alias(p)
    return pairs.groupBy(base).agg(*[pick(p) for p in region_pair_values])
