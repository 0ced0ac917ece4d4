"""How much samples of one label differ, and rankings of label difficulty."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from seqatlas.distribution import exact_quantiles, salted_join
from seqatlas.guards import require_columns
from seqatlas.operators.features import mean_by
from seqatlas.operators.ranking import ranked
from seqatlas.operators.scaling import centroids, cosine, distance
from seqatlas.session import cut_lineage


def centroid_distance(
    df: DataFrame, keys: Sequence[str], features: str, ident: str, *, metric: str = "euclidean", into: str = "distance"
) -> DataFrame:
    """Distance of each row to the mean vector of its key; hot keys are salted."""
    centers = centroids(df, keys, features).drop("num_samples")
    joined = salted_join(df, centers, keys, salt_on=[ident])
    value = distance(features, "centroid") if metric == "euclidean" else 1 - cosine(features, "centroid")
    return joined.select(*keys, ident, value.alias(into))


def distance_statistics(distances: DataFrame, keys: Sequence[str], value: str = "distance", suffix: str = "distance") -> DataFrame:
    """n, mean, median, population deviation and variance, and maximum per key."""
    base = distances.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("num_samples"),
        F.avg(value).alias(f"mean_{suffix}"),
        F.stddev_pop(value).alias(f"std_{suffix}"),
        F.var_pop(value).alias("within_class_variance"),
        F.max(value).alias(f"max_{suffix}"),
    )
    return base.join(exact_quantiles(distances, keys, value, {f"median_{suffix}": 0.5}), list(keys))


def signer_variation(
    scaled: DataFrame, features: str, ident: str, keys: Sequence[str] = ("dataset", "gloss"), *, metric: str = "euclidean"
) -> DataFrame:
    """Spread of the samples of each label around their centroid in scaled space.

    The scaled vectors and the distances are written once, as several passes use them.
    """
    distances = cut_lineage(centroid_distance(cut_lineage(scaled), keys, features, ident, metric=metric))
    return distance_statistics(distances, keys)


def metric_ranking(df: DataFrame, metric: str, order: Sequence[str], extra: Sequence[str] = (), label: str = "gloss") -> DataFrame:
    """Labels by a required metric, duplicates collapsed by mean first."""
    require_columns(df, ["dataset", label, metric, *extra], "label metrics")
    return ranked(mean_by(df, ["dataset", label], [metric, *extra]), order, metric, label)


def difficulty_summary(tables: dict[str, tuple[DataFrame, str]]) -> DataFrame:
    """n, mean, population deviation, median and extremes per corpus and analysis."""
    long = None
    for name, (df, metric) in tables.items():
        part = df.select("dataset", F.lit(name).alias("analysis"), F.col(metric).cast("double").alias("value"))
        long = part if long is None else long.unionByName(part)
    keys = ["dataset", "analysis"]
    base = long.filter("value is not null").groupBy(*keys).agg(
        F.count(F.lit(1)).alias("num_labels"),
        F.avg("value").alias("mean"),
        F.stddev_pop("value").alias("std"),
        F.min("value").alias("min"),
        F.max("value").alias("max"),
    )
    return base.join(exact_quantiles(long, keys, "value", {"median": 0.5}, few_groups=True), keys)
