"""Time warping between trajectories (equal or unequal length, banded)."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from seqatlas.distribution import exact_quantiles, salted_join, tiled
from seqatlas.operators.ranking import draw_pairs, pair_count, sample_per_group
from seqatlas.operators.scaling import centroids, pack
from seqatlas.operators.separability import nearest_candidates

WINDOW = 8
CANDIDATES = 20
EXHAUSTIVE_LABELS = 600  # fixed value: above it, label pairs are searched, not enumerated
MOST_PAIRS = 20_000  # pairs of one label whose distances are all taken; of more, so many are drawn


def warp(a: np.ndarray, b: np.ndarray, window: int | None = WINDOW) -> np.ndarray:
    """Distances of many pairs at once: a is (pairs, n, d), b is (pairs, m, d).

    Euclidean cost, Sakoe-Chiba band of max(window, |n - m|), divided by n + m.
    """
    pairs, n, m = a.shape[0], a.shape[1], b.shape[1]
    if n == 0 or m == 0:
        return np.full(pairs, np.nan)
    band = max(window if window is not None else max(n, m), abs(n - m))
    above = np.full((m + 1, pairs), np.inf)
    above[0] = 0.0
    for i in range(1, n + 1):
        row = np.full((m + 1, pairs), np.inf)
        lo, hi = max(1, i - band), min(m, i + band)
        cost = np.sqrt(((a[:, i - 1, None, :] - b[:, lo - 1 : hi, :]) ** 2).sum(-1)).T
        reach = np.minimum(above[lo : hi + 1], above[lo - 1 : hi])
        for j in range(lo, hi + 1):
            row[j] = cost[j - lo] + np.minimum(reach[j - lo], row[j - 1])
        above = row
    return above[m] / (n + m)


def _matrix(flat: np.ndarray, channels: int) -> np.ndarray:
    return np.asarray(flat, dtype=float).reshape(-1, channels)


def _warp_mixed(a: list[np.ndarray], b: list[np.ndarray], window: int | None) -> np.ndarray:
    """Group the pairs by their two lengths, so that each group is one array."""
    out = np.full(len(a), np.nan)
    shapes = pd.Series([(len(x), len(y)) for x, y in zip(a, b)])
    for _, where in shapes.groupby(shapes).groups.items():
        idx = np.asarray(where)
        out[idx] = warp(np.stack([a[i] for i in idx]), np.stack([b[i] for i in idx]), window)
    return out


def warp_pairs(left: Column, right: Column, channels: int, window: int | None = WINDOW) -> Column:
    """Distance of two flat trajectories (frames x channels) per row, in Arrow batches."""

    @F.pandas_udf("double")
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series(_warp_mixed([_matrix(x, channels) for x in a], [_matrix(x, channels) for x in b], window))

    return run(left, right)


def warp_within(
    df: DataFrame, ident: str, trajectory: str, channels: int, groups: Sequence[str], *, window: int | None = WINDOW, block_rows: int = 256,
    finite_only: bool = True,
) -> DataFrame:
    """Distances of all unordered pairs inside each group.

    A tile carries two blocks of trajectories once and returns only ids and distances; a
    large group is many tiles. Pairs without a distance (an empty trajectory, values that are not
    finite) are left out or, without ``finite_only``, returned with NULL.
    """
    groups = list(groups)
    columns = [*groups, f"{ident}_a", f"{ident}_b", "dtw_distance"]

    def per_tile(key, pdf):
        ti, tj = key[-2], key[-1]
        rows = pdf.sort_values(ident, kind="stable")
        ids = rows[ident].to_numpy()
        series = [_matrix(x, channels) for x in rows[trajectory]]
        block = rows["_block"].to_numpy()
        if ti == tj:
            left, right = np.triu_indices(len(ids), k=1)
        else:
            l, r = np.flatnonzero(block == ti), np.flatnonzero(block == tj)
            left, right = np.repeat(l, len(r)), np.tile(r, len(l))
            swap = ids[left] > ids[right]
            left, right = np.where(swap, right, left), np.where(swap, left, right)
        if not len(left):
            return pd.DataFrame(columns=columns)
        parts = []
        for start in range(0, len(left), 4096):
            l, r = left[start : start + 4096], right[start : start + 4096]
            parts.append(_warp_mixed([series[i] for i in l], [series[i] for i in r], window))
        out = pd.DataFrame({f"{ident}_a": ids[left], f"{ident}_b": ids[right], "dtw_distance": np.concatenate(parts)})
        for g, v in zip(groups, key):
            out[g] = v
        good = np.isfinite(out["dtw_distance"].to_numpy(dtype=float))
        if finite_only:
            return out[good][columns]
        out["dtw_distance"] = [float(d) if ok else None for d, ok in zip(out["dtw_distance"], good)]
        return out[columns]

    types = dict(df.dtypes)
    schema = ", ".join(
        [*[f"{g} {types[g]}" for g in groups], f"{ident}_a {types[ident]}", f"{ident}_b {types[ident]}", "dtw_distance double"]
    )
    cut = tiled(df.select(*groups, ident, trajectory), ident, groups, block_rows=block_rows)
    return cut.groupBy(*groups, "_ti", "_tj").applyInPandas(per_tile, schema)


def pairs_of_labels(
    df: DataFrame, ident: str, trajectory: str, channels: int, groups: Sequence[str], *, most: int = MOST_PAIRS, seed: int = 42, window: int | None = WINDOW
) -> DataFrame:
    """Distances of pairs inside each label: all of them where there are at most ``most``, else so many
    drawn by ``draw_pairs``. Work and output grow with the labels, not with the squares of their sizes.

    Pairs without a finite distance have NULL.
    """
    groups = list(groups)
    sizes = df.groupBy(*groups).agg(pair_count(F.count(F.lit(1))).alias("_pairs"))
    sized = salted_join(df.select(*groups, ident, trajectory), sizes, groups, salt_on=[ident])
    whole = sized.filter(F.col("_pairs") <= most).drop("_pairs")
    every = warp_within(whole, ident, trajectory, channels, groups, window=window, finite_only=False)
    large = sized.filter(F.col("_pairs") > most).drop("_pairs")
    drawn = draw_pairs(large, ident, groups, most, seed)
    side = lambda s: large.select(*groups, F.col(ident).alias(f"{ident}_{s}"), F.col(trajectory).alias(f"_t{s}"))
    both = drawn.join(side("a"), [*groups, f"{ident}_a"]).join(side("b"), [*groups, f"{ident}_b"])
    distance = warp_pairs(F.col("_ta"), F.col("_tb"), channels, window)
    found = both.select(*groups, f"{ident}_a", f"{ident}_b", distance.alias("_d"))
    finite = F.when(F.col("_d").isNotNull() & ~F.isnan("_d") & (F.abs("_d") < float("inf")), F.col("_d"))
    return every.unionByName(found.select(*groups, f"{ident}_a", f"{ident}_b", finite.alias("dtw_distance")))


def intra_class(pairs: DataFrame, keys: Sequence[str] = ("dataset", "label"), samples: DataFrame | None = None) -> DataFrame:
    """Number of pairs with a distance, mean, population deviation, extremes and median per label.

    With ``samples`` also ``num_samples``, ``num_pairs_all`` (pairs the label has) and
    ``num_pairs_failed`` (taken pairs without a finite distance).
    """
    d, keys = "dtw_distance", list(keys)
    base = pairs.groupBy(*keys).agg(
        F.count(d).alias("num_pairs"),
        F.count(F.when(F.col(d).isNull(), 1)).alias("num_pairs_failed"),
        F.avg(d).alias("intra_class_dtw_mean"),
        F.stddev_pop(d).alias("intra_class_dtw_std"),
        F.min(d).alias("intra_class_dtw_min"),
        F.max(d).alias("intra_class_dtw_max"),
    ).filter("num_pairs > 0")
    out = base.join(exact_quantiles(pairs, keys, d, {"intra_class_dtw_median": 0.5}), keys)
    if samples is None:
        return out.drop("num_pairs_failed")
    sizes = samples.groupBy(*keys).agg(F.count(F.lit(1)).alias("num_samples"), pair_count(F.count(F.lit(1))).alias("num_pairs_all"))
    return out.join(sizes, keys)


def sampled_pairs(pairs: DataFrame, keys: Sequence[str], ident: str, count: int, seed: int = 42) -> DataFrame:
    """At most ``count`` pairs per label, the same in every run."""
    return sample_per_group(pairs, keys, [f"{ident}_a", f"{ident}_b"], count, seed)


def prototypes(df: DataFrame, keys: Sequence[str], trajectory: str) -> DataFrame:
    """Element-wise mean of the flat trajectories of each label, with their number."""
    return centroids(df, keys, trajectory, into="prototype")


def _z_scored(protos: DataFrame, groups: Sequence[str]) -> DataFrame:
    """Prototype values z-scored per corpus (deviation plus 1e-6), for the candidate search."""
    groups = list(groups)
    cells = protos.select(*groups, F.posexplode("prototype").alias("_i", "_x"))
    stats = cells.groupBy(*groups, "_i").agg(F.avg("_x").alias("_m"), (F.stddev_pop("_x") + 1e-6).alias("_s"))
    joined = protos.join(pack(stats, groups, "_i", ["_m", "_s"]), groups)
    centred = F.zip_with("prototype", "_m", lambda x, m: x - m)
    return joined.select(*protos.columns, F.zip_with(centred, F.col("_s"), lambda x, s: x / s).alias("_z"))


def inter_class(
    protos: DataFrame,
    label: str,
    channels: int,
    groups: Sequence[str] = ("dataset",),
    *,
    exhaustive: bool = False,
    most_labels: int = EXHAUSTIVE_LABELS,
    candidates: int = CANDIDATES,
    window: int | None = WINDOW,
) -> DataFrame:
    """Warping distance of label prototypes, with the mode that found the pair.

    ``exhaustive`` takes all pairs of corpora with at most ``most_labels`` labels. Of larger ones, and without
    it of all, those pairs that a z-scored Euclidean search finds among the nearest of either label.
    """
    groups = list(groups)
    if exhaustive:
        counts = protos.groupBy(*groups).agg(F.count(F.lit(1)).alias("_labels"))
        sized = salted_join(protos, counts, groups, salt_on=[label])
        small = sized.filter(F.col("_labels") <= most_labels).drop("_labels")
        every = warp_within(small, label, "prototype", channels, groups, window=window).withColumn("mode", F.lit("exhaustive"))
        large = sized.filter(F.col("_labels") > most_labels).drop("_labels")
        return every.unionByName(inter_class(large, label, channels, groups, candidates=candidates, window=window))
    found = nearest_candidates(_z_scored(protos, groups), label, "_z", candidates, groups)
    side = lambda s: protos.select(*groups, F.col(label).alias(f"{label}_{s}"), F.col("prototype").alias(f"_p{s}"))
    both = found.join(side("a"), [*groups, f"{label}_a"]).join(side("b"), [*groups, f"{label}_b"])
    distance = warp_pairs(F.col("_pa"), F.col("_pb"), channels, window)
    return both.select(*groups, f"{label}_a", f"{label}_b", distance.alias("dtw_distance")).filter(
        ~F.isnan("dtw_distance")
    ).withColumn("mode", F.lit("nearest_candidates_then_dtw"))
