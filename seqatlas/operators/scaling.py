"""Feature vectors, imputation and z-scores, centroids.

A feature vector is ``array<double>``. Statistics per position are aggregated from exploded
values (combined before any shuffle); distances are array expressions inside the row.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from seqatlas.distribution import attach_row, exact_quantiles
from seqatlas.functions.numbers import finite

EPS = 2.220446049250313e-16


def feature_vector(df: DataFrame, columns: Sequence[str], into: str = "features") -> DataFrame:
    return df.withColumn(into, F.array(*[finite(F.col(c)) for c in columns]))


def item(vector: str | Column, i: int) -> Column:
    return F.get(_col(vector), F.lit(i))


def _col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda total, v: total + v)


def dot(a: str | Column, b: str | Column) -> Column:
    return _sum(F.zip_with(_col(a), _col(b), lambda x, y: x * y))


def squared_distance(a: str | Column, b: str | Column) -> Column:
    return _sum(F.zip_with(_col(a), _col(b), lambda x, y: (x - y) * (x - y)))


def distance(a: str | Column, b: str | Column) -> Column:
    return F.sqrt(squared_distance(a, b))


def cosine(a: str | Column, b: str | Column) -> Column:
    """Cosine similarity; 0 when a vector has no length."""
    lengths = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(lengths == 0, F.lit(0.0)).otherwise(dot(a, b) / lengths)


def keep_covered(df: DataFrame, features: str, share: float = 0.8) -> DataFrame:
    """Rows with at least ``share`` of their features present."""
    present = F.size(F.filter(features, lambda v: v.isNotNull() & ~F.isnan(v)))
    return df.filter(present / F.size(features) >= share)


def coverage(features: str) -> Column:
    """Share of features that are present, to be shown beside imputed results."""
    return F.size(F.filter(F.col(features), lambda v: v.isNotNull() & ~F.isnan(v))) / F.size(features)


def pack(long: DataFrame, keys: Sequence[str], at: str, columns: Sequence[str]) -> DataFrame:
    """One row per key with each column as an array in the order of ``at``. A key has one
    row per vector position, so the arrays are as long as a vector."""
    rows = F.array_sort(F.collect_list(F.struct(at, *columns)))
    packed = long.groupBy(*keys).agg(rows.alias("_packed"))
    return packed.select(*keys, *[F.col(f"_packed.{c}").alias(c) for c in columns])


def _stats(df: DataFrame, features: str, by: list[str], fill: str, sample: bool) -> DataFrame:
    """One row per corpus: arrays of fill value, mean and deviation after filling."""
    long = df.select(*by, F.posexplode(features).alias("_i", "_x")).withColumn("_x", finite(F.col("_x")))
    keys = [*by, "_i"]
    cells = long.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("_rows"), F.count("_x").alias("_n"), F.avg("_x").alias("_m"), F.var_pop("_x").alias("_v")
    )
    if fill == "median":
        cells = cells.join(exact_quantiles(long, keys, "_x", {"_q": 0.5}, few_groups=True), keys, "left")
    else:
        cells = cells.withColumn("_q", F.col("_m"))
    total, n = F.col("_rows"), F.col("_n")
    f, m, v = (F.coalesce(c, F.lit(0.0)) for c in ("_q", "_m", "_v"))
    mean = F.when(n == total, m).otherwise((n * m + (total - n) * f) / total)
    cells = cells.withColumns({"_fill": f, "_mean": mean})
    off = lambda x: (x - F.col("_mean")) * (x - F.col("_mean"))
    var = F.when(n == total, v).otherwise((n * (v + off(m)) + (total - n) * off(f)) / total)
    cells = cells.withColumn("_var", var)
    noise = total * F.abs("_mean") * EPS
    flat = F.col("_var") <= total * EPS * F.col("_var") + noise * noise
    scaled = F.col("_var") * total / (total - 1) if sample else F.col("_var")
    std = F.when(flat | scaled.isNull(), F.lit(1.0)).otherwise(F.sqrt(scaled))
    return pack(cells.withColumn("_std", std), by, "_i", ["_fill", "_mean", "_std"])


def scale(
    df: DataFrame,
    features: str,
    *,
    by: Sequence[str] = (),
    fill: str = "median",
    sample: bool = False,
    into: str = "scaled",
) -> DataFrame:
    """Fill missing values with the column mean or median, then z-score with the population
    (or sample) deviation; a constant column is only centred. ``by`` scales each corpus alone.

    Only the statistics, one row per corpus, are sent to every task.
    """
    if fill not in ("mean", "median"):
        raise ValueError("fill is mean or median")
    stats = _stats(df, features, list(by), fill, sample)
    joined = df.join(stats, list(by)) if by else attach_row(df, stats)
    filled = F.zip_with(F.col(features), F.col("_fill"), lambda x, f: F.coalesce(finite(x), f))
    centred = F.zip_with(filled, F.col("_mean"), lambda x, m: x - m)
    return joined.withColumn(into, F.zip_with(centred, F.col("_std"), lambda x, s: x / s)).select(*df.columns, into)


def centroids(df: DataFrame, keys: Sequence[str], features: str, into: str = "centroid") -> DataFrame:
    """Mean vector and row count per key, combined before the shuffle."""
    cells = df.select(*keys, F.posexplode(features).alias("_i", "_x")).groupBy(*keys, "_i").agg(
        F.avg(F.col("_x").cast("double")).alias(into), F.count(F.lit(1)).alias("num_samples")
    )
    packed = pack(cells, keys, "_i", [into, "num_samples"])
    return packed.select(*keys, F.get("num_samples", F.lit(0)).alias("num_samples"), into)
