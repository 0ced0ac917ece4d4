"""Clusters and principal components of feature vectors."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from seqatlas.distribution import attach_row
from seqatlas.operators.classes import shares
from seqatlas.operators.scaling import dot, squared_distance
from seqatlas.session import cut_lineage

# Names for hand-shape clusters, tried in this order.
OPEN_MIN, OPEN_SPREAD_MIN, CLOSED_MAX, CURVED_MAX, COMPACT_MAX = 2.1, 1.2, 1.35, 120.0, 0.75


def _nearest_center(features: str, centers: np.ndarray) -> Column:
    """Number of the nearest center (ties: the smaller)."""
    apart = F.array(*[squared_distance(features, F.array(*[F.lit(float(v)) for v in c])) for c in centers])
    return (F.array_position(apart, F.array_min(apart)) - 1).cast("int")


def kmeans(
    df: DataFrame, features: str, k: int = 8, seed: int = 42, into: str = "cluster", *, ident: str = "vec_id", rounds: int = 100, tolerance: float = 1e-5
) -> DataFrame:
    """Lloyd's algorithm; min(k, n) rows with the smallest MD5 of ``<seed>|<ident>`` start it.

    A round is one scan with partial means: one row per center comes to the driver. A center without
    members stays. Rounds end when no row changes its center or no center moves by more than the tolerance (absolute
    and relative), after ``rounds`` at most. Scanned again each round, ``df`` should be a stage table.
    """
    order = F.md5(F.concat_ws("|", F.lit(str(seed)), F.col(ident).cast("string")).cast("binary"))
    start = df.orderBy(order, ident).limit(k).select(features).collect()
    centers = np.array([r[0] for r in start], float)
    members = None
    for _ in range(rounds if len(centers) else 0):
        near = df.select(F.col(features).alias("_x"), _nearest_center(features, centers).alias("_c"), F.xxhash64(ident).alias("_h"))
        means = near.groupBy("_c").agg(
            F.count(F.lit(1)).alias("_n"), F.bit_xor("_h").alias("_h"), *[F.avg(F.get("_x", F.lit(i))).alias(f"_{i}") for i in range(centers.shape[1])]
        )
        moved, were, members = centers.copy(), members, {}
        for row in means.collect():
            moved[row["_c"]], members[row["_c"]] = row[3:], row[1:3]
        if members == were or np.allclose(centers, moved, rtol=tolerance, atol=tolerance):
            break
        centers = moved
    return df.withColumn(into, _nearest_center(features, centers) if len(centers) else F.lit(None).cast("int"))


def proxy_name(openness: Column, spread: Column, curvature: Column) -> Column:
    return (
        F.when((openness >= OPEN_MIN) & (spread >= OPEN_SPREAD_MIN), "open_spread_proxy")
        .when(openness <= CLOSED_MAX, "closed_proxy")
        .when(curvature <= CURVED_MAX, "curved_proxy")
        .when(spread <= COMPACT_MAX, "compact_proxy")
        .otherwise("neutral_proxy")
    )


def cluster_profile(
    df: DataFrame,
    cluster: str,
    openness: str = "openness_mean",
    spread: str = "index_pinky_distance_ratio_mean",
    curvature: str = "curvature_proxy_mean",
) -> DataFrame:
    """Mean hand shape per cluster and the name it suggests."""
    means = df.groupBy(cluster).agg(*[F.avg(c).alias(c) for c in (openness, spread, curvature)])
    return means.withColumn("cluster_label_proxy", proxy_name(F.col(openness), F.col(spread), F.col(curvature)))


def cluster_shares(df: DataFrame, cluster: str, profile: DataFrame) -> DataFrame:
    """Count and percentage of the clusters per corpus. The few counted rows are joined
    with the names, not the samples."""
    counted = shares(df, [cluster])
    return counted.join(profile.select(cluster, "cluster_label_proxy"), cluster, "left")


def gram(df: DataFrame, features: str, by: Sequence[str] = ()) -> DataFrame:
    """(by, n, sums, products) of all vectors in one pass: products are the flat matrix of cross products.

    A task hands on one row per group, whatever its rows; cells are then added by position.
    """
    by = list(by)

    def run(batches):
        held: dict = {}
        for batch in batches:
            for key, part in batch.groupby(by, dropna=False) if by else [((), batch)]:
                if len(part):
                    x = np.stack(part["_x"].tolist()).astype(float)
                    new = [len(x), x.sum(0), x.T @ x]
                    key = key if isinstance(key, tuple) else (key,)
                    held[key] = [a + b for a, b in zip(held[key], new)] if key in held else new
        for key, (n, sums, products) in held.items():
            yield pd.DataFrame({**{g: [v] for g, v in zip(by, key)}, "_n": [n], "_cells": [np.concatenate((sums, products.ravel()))]})

    types = dict(df.dtypes)
    schema = ", ".join([*[f"{g} {types[g]}" for g in by], "_n long", "_cells array<double>"])
    kept = df.select(*by, F.col(features).alias("_x")).filter(F.col("_x").isNotNull())
    cells = kept.mapInPandas(run, schema).select(*by, "_n", F.posexplode("_cells").alias("_i", "_v"))
    added = cells.groupBy(*by, "_i").agg(F.sum("_v").alias("_v"), F.sum("_n").alias("_n"))
    # As many rows per group as a matrix has cells.
    whole = added.groupBy(*by).agg(F.max("_n").alias("n"), F.array_sort(F.collect_list(F.struct("_i", "_v"))).alias("_all"))
    flat = F.transform("_all", lambda c: c["_v"])
    width = F.round((F.sqrt(F.lit(1.0) + F.lit(4.0) * F.size("_all")) - 1) / 2).cast("int")
    out = whole.select(*by, "n", flat.alias("_flat"), width.alias("_w"))
    return out.select(*by, "n", F.slice("_flat", 1, F.col("_w")).alias("sums"), F.slice("_flat", F.col("_w") + 1, F.col("_w") * F.col("_w")).alias("products"))


def components(df: DataFrame, features: str, by: Sequence[str] = (), count: int = 2) -> DataFrame:
    """(by, component, loadings, center, explained_variance_ratio, cumulative_explained_variance).

    The sign of a component is fixed so that its largest loading is positive. Values far from
    zero lose digits in the cross products: give scaled ones.
    """
    by = list(by)

    def solve(batches):
        for batch in batches:
            rows = []
            for r in batch.to_dict("records"):
                n, center = r["n"], np.asarray(r["sums"], float) / r["n"]
                spread = np.asarray(r["products"], float).reshape(len(center), -1) / n - np.outer(center, center)
                values, vectors = np.linalg.eigh((spread + spread.T) / 2)
                total, so_far = max(np.trace(spread), 0.0), 0.0
                for i in range(min(count, len(values))):
                    loading, value = vectors[:, -1 - i], max(values[-1 - i], 0.0)
                    loading = loading if loading[np.abs(loading).argmax()] >= 0 else -loading
                    share = value / total if total > 0 else 0.0
                    so_far += share
                    rows.append([*[r[g] for g in by], f"PC{i + 1}", loading.tolist(), center.tolist(), share, so_far])
            yield pd.DataFrame(rows, columns=[*by, "component", "loadings", "center", "explained_variance_ratio", "cumulative_explained_variance"])

    types = dict(df.dtypes)
    schema = ", ".join([*[f"{g} {types[g]}" for g in by], "component string, loadings array<double>, center array<double>, explained_variance_ratio double, cumulative_explained_variance double"])
    return gram(df, features, by).mapInPandas(solve, schema)


def pca2(df: DataFrame, features: str, by: Sequence[str] = ()) -> tuple[DataFrame, DataFrame]:
    """(rows with coordinates pc1 and pc2, explained and cumulative variance per component), for all rows
    or each group. The components, two rows per group, are written once."""
    by = list(by)
    found = cut_lineage(components(df, features, by))
    pick = lambda n, c: F.max(F.when(F.col("component") == n, F.col(c)))
    axes = found.groupBy(*by).agg(pick("PC1", "loadings").alias("_a1"), pick("PC2", "loadings").alias("_a2"), pick("PC1", "center").alias("_center"))
    joined = df.join(axes, by) if by else attach_row(df, axes)
    centred = F.zip_with(F.col(features), F.col("_center"), lambda x, c: x - c)
    rows = joined.withColumn("_x", centred).withColumns({"pc1": dot("_x", "_a1"), "pc2": dot("_x", "_a2")})
    return rows.select(*df.columns, "pc1", "pc2"), found.drop("loadings", "center")
