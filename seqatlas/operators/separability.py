"""How well labels separate in feature space."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from seqatlas.distribution import exact_quantiles, rank_rows, salted_join, tile_pairs
from seqatlas.guards import must_hold
from seqatlas.operators import blocks
from seqatlas.operators.clusters import components
from seqatlas.operators.scaling import centroids, cosine, distance, scale, squared_distance
from seqatlas.operators.variation import centroid_distance, distance_statistics
from seqatlas.session import cut_lineage

DATASET = ["dataset"]
LABEL = ["dataset", "gloss"]


def label_distances(scaled: DataFrame, features: str, ident: str) -> DataFrame:
    """Distance of each sample to its label centroid, written once for the measures below."""
    return cut_lineage(centroid_distance(scaled, LABEL, features, ident))


def compactness(distances: DataFrame) -> DataFrame:
    """Mean, median, deviation and maximum distance to the centroid per label."""
    stats = distance_statistics(distances, LABEL)
    return stats.drop("within_class_variance").withColumnRenamed("mean_distance", "compactness")


def overall(df: DataFrame, value: str, prefix: str, extremes: bool = False) -> DataFrame:
    """Mean, median and population deviation of a per-label or per-pair value per corpus."""
    aggs = [F.avg(value).alias(f"{prefix}_mean"), F.stddev_pop(value).alias(f"{prefix}_std")]
    if extremes:
        aggs += [F.min(value).alias(f"{prefix}_min"), F.max(value).alias(f"{prefix}_max")]
    return df.groupBy(*DATASET).agg(*aggs).join(
        exact_quantiles(df, DATASET, value, {f"{prefix}_median": 0.5}, few_groups=True), DATASET
    )


def centroid_pairs(centers: DataFrame, *, extra: Sequence[str] = (), block_rows: int = 1_024) -> DataFrame:
    """Euclidean and cosine distance of all label centroids of a corpus, each pair once.

    Every pair is part of the result, so the pairs are spread over tiles of bounded size.
    """
    pairs = tile_pairs(centers.select(*LABEL, "centroid", *extra), "gloss", DATASET, block_rows=block_rows)
    return pairs.select(
        "dataset",
        "gloss_a",
        "gloss_b",
        *[f"{e}_{s}" for e in extra for s in "ab"],
        distance("centroid_a", "centroid_b").alias("euclidean_distance"),
        (1 - cosine("centroid_a", "centroid_b")).alias("cosine_distance"),
    )


def distance_matrix(pairs: DataFrame, value: str, labels: Sequence[str]) -> DataFrame:
    """Square form of a pair table for a short list of labels."""
    both = pairs.select(F.col("gloss_a").alias("gloss"), F.col("gloss_b").alias("other"), value).unionByName(
        pairs.select(F.col("gloss_b").alias("gloss"), F.col("gloss_a").alias("other"), value)
    )
    pick = lambda l: F.coalesce(F.max(F.when(F.col("other") == l, F.col(value))), F.lit(0.0)).alias(str(l))
    return both.groupBy("gloss").agg(*[pick(l) for l in labels])


# --- silhouette -----------------------------------------------------------------


def _block_sums(ident: str, features: str):
    """What each row of a tile keeps of its other block: the least mean distance to a label that lies wholly in it
    (``_b``), and sums for its own label and those at the block's ends (``_other``, ``_sum``, ``_n``)."""
    names = ["dataset", ident, "gloss", "_other", "_sum", "_n", "_b"]

    def sums(rows: pd.DataFrame, others: pd.DataFrame) -> pd.DataFrame:
        codes, labels = pd.factorize(others["gloss"])
        others, codes = others.iloc[np.argsort(codes, kind="stable")], np.sort(codes)
        labels = np.asarray(labels, dtype=object)
        starts = np.searchsorted(codes, np.arange(len(labels)))
        counts, sizes = np.diff(np.append(starts, len(codes))), others["_size"].to_numpy()[starts]
        a = np.stack(rows[features].to_numpy()).astype(float)
        b = np.stack(others[features].to_numpy()).astype(float)
        na, nb = (a * a).sum(1), (b * b).sum(1)
        ids, names_ = rows[ident].to_numpy(), others[ident].to_numpy()
        shared = np.isin(ids, names_)
        glosses = rows["gloss"].to_numpy()
        found, nearest = [], []
        for at in blocks.slabs(len(a), len(b)):
            dist = a[at] @ b.T
            dist *= -2.0
            dist += na[at, None]
            dist += nb[None, :]
            np.sqrt(np.maximum(dist, 0.0, out=dist), out=dist)
            if shared[at].any():
                dist[ids[at, None] == names_[None, :]] = 0.0
            totals = np.add.reduceat(dist, starts, axis=1)
            whole = (counts == sizes)[None, :] & (glosses[at, None] != labels[None, :])
            means = np.where(whole, totals / counts, np.inf).min(1)
            row, label = np.nonzero(~whole)
            found.append((row + at.start, label, totals[row, label]))
            nearest.append(means)
        row, label, total = (np.concatenate(x) for x in zip(*found))
        means = np.concatenate(nearest)
        near = np.flatnonzero(np.isfinite(means))
        data = rows["dataset"].to_numpy(), ids, glosses
        parts = pd.DataFrame({n: d[row] for n, d in zip(names, data)})
        parts["_other"], parts["_sum"], parts["_n"], parts["_b"] = labels[label], total, counts[label].astype("int64"), np.nan
        least = pd.DataFrame({n: d[near] for n, d in zip(names, data)})
        least["_other"], least["_sum"], least["_n"], least["_b"] = None, np.nan, 0, means[near]
        return pd.concat([p for p in (parts, least) if len(p)] or [parts])

    def per_tile(key, pdf):
        ti, tj = key[-2], key[-1]
        if ti == tj:
            out = sums(pdf, pdf)
        else:
            left, right = pdf[pdf["_block"] == ti], pdf[pdf["_block"] == tj]
            if left.empty or right.empty:
                return pd.DataFrame(columns=names)
            out = pd.concat([sums(left, right), sums(right, left)])
        for c in ("_sum", "_b"):
            out[c] = out[c].astype(object).where(out[c].notna(), None)
        return out[names]

    return per_tile


def silhouette_tiles(scaled: DataFrame, features: str, ident: str, *, block_rows: int = 2_048) -> DataFrame:
    """What leaves the tiles of ``silhouette_samples``: for each sample and block one least mean, and sums for its own label and
    the at most two labels that go on in another block.

    Blocks are runs of samples in label order, so a label lies in one block or in neighbouring ones. Large corpora
    have larger blocks (``blocks.tile_rows``), so that a sample is not sent to ever more tiles.
    """
    shape = scaled.groupBy(*DATASET).agg(F.count(F.lit(1)).alias("_rows"), F.count_distinct("gloss").alias("_k"))
    usable = shape.filter((F.col("_rows") >= 3) & F.col("_k").between(2, F.col("_rows") - 1)).select(*DATASET, "_rows")
    kept = scaled.select(*LABEL, ident, F.col(features).alias("_x"))
    ranked = rank_rows(kept.select(*LABEL, ident), DATASET, ["gloss", ident], into="_rank")
    sizes = ranked.groupBy(*LABEL).agg(F.count(F.lit(1)).alias("_size"))
    placed = salted_join(ranked, sizes, LABEL, salt_on=[ident]).join(usable, DATASET)
    wide = F.least(F.greatest(F.ceil(F.col("_rows") / blocks.TILES), F.lit(block_rows)), F.lit(max(block_rows, blocks.MOST_ROWS)))
    cut = kept.join(placed, [*LABEL, ident]).withColumns({"_block": F.floor(F.col("_rank") / wide), "_last": F.floor((F.col("_rows") - 1) / wide)})
    cut = (
        cut.withColumn("_with", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_last"))))
        .withColumns({"_ti": F.least("_block", "_with"), "_tj": F.greatest("_block", "_with")})
        .drop("_with", "_last", "_rank", "_rows")
    )
    types = dict(scaled.dtypes)
    schema = f"dataset {types['dataset']}, {ident} {types[ident]}, gloss {types['gloss']}, _other {types['gloss']}, _sum double, _n long, _b double"
    return cut.groupBy("dataset", "_ti", "_tj").applyInPandas(_block_sums(ident, "_x"), schema)


def silhouette_samples(scaled: DataFrame, features: str, ident: str, *, block_rows: int = 2_048) -> DataFrame:
    """Exact Euclidean silhouette of every sample inside its corpus.

    Distances are reduced by label inside tiles of two blocks; no pair leaves a tile. The
    result is written once for the summaries. A sample alone in its label has silhouette 0. Corpora need 2 to n-1 labels.
    """
    sums = silhouette_tiles(scaled, features, ident, block_rows=block_rows)
    by_label = sums.groupBy("dataset", ident, "gloss", "_other").agg(F.sum("_sum").alias("_sum"), F.sum("_n").alias("_n"), F.min("_b").alias("_least"))
    own = F.col("gloss") == F.col("_other")
    scores = by_label.groupBy("dataset", ident, "gloss").agg(
        F.max(F.when(own, F.col("_n"))).alias("_size"),
        F.max(F.when(own & (F.col("_n") > 1), F.col("_sum") / (F.col("_n") - 1))).alias("_a"),
        F.min(F.least(F.when(~own, F.col("_sum") / F.col("_n")), F.col("_least"))).alias("_b"),
    )
    a, b = F.col("_a"), F.col("_b")
    widest = F.greatest(a, b)
    value = F.when(F.col("_size") == 1, F.lit(0.0)).when(widest > 0, (b - a) / widest).otherwise(F.lit(0.0))
    return cut_lineage(scores.select("dataset", ident, "gloss", value.alias("silhouette")))


def silhouette_by_label(samples: DataFrame) -> DataFrame:
    base = samples.groupBy(*LABEL).agg(F.avg("silhouette").alias("silhouette_mean"), F.count(F.lit(1)).alias("num_samples"))
    return base.join(exact_quantiles(samples, LABEL, "silhouette", {"silhouette_median": 0.5}), LABEL)


def silhouette_score(samples: DataFrame) -> DataFrame:
    return samples.groupBy(*DATASET).agg(F.avg("silhouette").alias("silhouette_score"))


# --- indices --------------------------------------------------------------------


def worst_ratios(centers: DataFrame, *, block_rows: int = 2_048, most_pivots: int = blocks.MOST_PIVOTS) -> DataFrame:
    """(dataset, gloss, ratio, pairs): the largest (spread + spread) / distance of each label to another one of
    its corpus, and how many labels it was compared with.

    ``centers`` has dataset, gloss, centroid and spread. A block of labels is opened for a label only if its largest
    spread over the least distance its members can have beats the ratio found so far. Labels at one place
    count as ratio 0, labels without another one in their corpus have no row.
    """
    types = dict(centers.dtypes)
    schema = f"dataset {types['dataset']}, gloss {types['gloss']}, ratio double, pairs long"

    def meet(rows: pd.DataFrame, others: pd.DataFrame) -> pd.DataFrame:
        a, b, widths = blocks._stack(rows["centroid"]), blocks._stack(others["centroid"]), others["spread"].to_numpy(float)
        names, mine, spread = others["gloss"].to_numpy(), rows["gloss"].to_numpy(), rows["spread"].to_numpy(float)
        most, pairs = np.empty(len(a)), np.empty(len(a), dtype="int64")
        for at in blocks.slabs(len(a), len(b)):
            apart = np.sqrt(blocks._apart(a[at], b))
            sums = spread[at, None] + widths[None, :]
            ratio = np.divide(sums, apart, out=np.zeros_like(sums), where=apart > 0)
            same = mine[at, None] == names[None, :]
            most[at], pairs[at] = np.where(same, -1.0, ratio).max(1), (~same).sum(1)
        out = pd.DataFrame({"dataset": rows["dataset"].to_numpy(), "gloss": mine, "ratio": most, "pairs": pairs})
        return out[pairs > 0]

    def wants(rows: pd.DataFrame, away: np.ndarray, figures: dict) -> np.ndarray:
        least = away - figures["radius"][None, :]
        sums = rows["spread"].to_numpy(float)[:, None] + figures["weight"][None, :]
        known = rows["_known"].to_numpy(float)[:, None]
        return sums * (1 + blocks.SLACK) >= known * np.maximum(least, 0.0) * (1 - blocks.SLACK)

    dealt = blocks.deal(centers, "gloss", "centroid", DATASET, weight="spread", block_rows=block_rows, most_pivots=most_pivots)
    if dealt.single:
        return blocks.own_tile(dealt, meet, schema)
    first = cut_lineage(blocks.own_tile(dealt, meet, schema))
    known = first.select(*LABEL, F.col("ratio").alias("_known"))
    rows = dealt.rows.join(known, LABEL, "left").fillna({"_known": -1.0})
    more = blocks.visit(dealt, blocks.opened(dealt, rows, wants), meet, schema)
    return first.unionByName(more).groupBy(*LABEL).agg(F.max("ratio").alias("ratio"), F.sum("pairs").alias("pairs"))


def davies_bouldin(scaled: DataFrame, features: str, distances: DataFrame) -> DataFrame:
    """Mean over labels of the worst ratio of summed spreads to centroid distance."""
    spread = distances.groupBy(*LABEL).agg(F.avg("distance").alias("spread"))
    centers = cut_lineage(centroids(scaled, LABEL, features).join(spread, LABEL))
    return worst_ratios(centers).groupBy(*DATASET).agg(F.avg("ratio").alias("davies_bouldin_index"))


def calinski_harabasz(scaled: DataFrame, features: str, distances: DataFrame) -> DataFrame:
    """Between-label over within-label dispersion, each by its degrees of freedom."""
    within = distances.groupBy(*DATASET).agg(
        F.sum(F.col("distance") * F.col("distance")).alias("_within"), F.count(F.lit(1)).alias("_n")
    )
    whole = centroids(scaled, DATASET, features, into="_center").drop("num_samples")
    between = (
        centroids(scaled, LABEL, features)
        .join(whole, DATASET)
        .groupBy(*DATASET)
        .agg(
            F.sum(F.col("num_samples") * squared_distance("centroid", "_center")).alias("_between"),
            F.count(F.lit(1)).alias("_k"),
        )
    )
    b, w, n, k = F.col("_between"), F.col("_within"), F.col("_n"), F.col("_k")
    index = F.when(w == 0, F.lit(1.0)).otherwise((b / (k - 1)) / (w / (n - k)))
    return within.join(between, DATASET).select(*DATASET, index.alias("calinski_harabasz_index"))


def metrics_row(df: DataFrame, features: str, ident: str) -> DataFrame:
    """All 22 separability metrics of each corpus in one row."""
    scaled = cut_lineage(scale(df.select(*LABEL, ident, features), features, by=DATASET, fill="median"))
    distances = label_distances(scaled, "scaled", ident)
    size = df.groupBy(*DATASET).agg(
        F.count(F.lit(1)).alias("num_samples"),
        F.count_distinct("gloss").alias("num_glosses"),
        F.max(F.size(features)).cast("long").alias("feature_dimension"),
    )
    pairs = cut_lineage(centroid_pairs(centroids(scaled, LABEL, "scaled")))
    share = lambda n, c: F.max(F.when(F.col("component") == n, F.col(c)))
    variance = components(scaled, "scaled", DATASET).groupBy(*DATASET).agg(
        share("PC1", "explained_variance_ratio").alias("pca_explained_variance_pc1"),
        share("PC2", "cumulative_explained_variance").alias("pca_explained_variance_cumulative"),
    )
    parts = [
        variance,
        silhouette_score(silhouette_samples(scaled, "scaled", ident)),
        davies_bouldin(scaled, "scaled", distances),
        calinski_harabasz(scaled, "scaled", distances),
        overall(compactness(distances), "compactness", "compactness"),
        overall(pairs, "euclidean_distance", "euclidean", extremes=True),
        overall(pairs, "cosine_distance", "cosine", extremes=True),
    ]
    for part in parts:
        size = size.join(part, DATASET, "left")
    return size


# --- nearest labels --------------------------------------------------------------


def nearest_candidates(
    df: DataFrame, ident: str, vector: str, k: int = 20, groups: Sequence[str] = ("dataset",), *, block_rows: int = 2_048,
    most_pivots: int = blocks.MOST_PIVOTS,
) -> DataFrame:
    """Unordered pairs in which one label is among the ``k`` nearest of the other (exact).

    The k nearest in its own tile give each label a distance to beat; only blocks that may hold a nearer one
    are opened. A tile keeps the k nearest of its rows; only those leave it and are merged.
    """
    best = nearest_rows(df, ident, vector, k, groups, block_rows=block_rows, most_pivots=most_pivots)
    return best.select(
        *groups, F.least(ident, "_near").alias(f"{ident}_a"), F.greatest(ident, "_near").alias(f"{ident}_b")
    ).distinct()


def nearest_rows(
    df: DataFrame, ident: str, vector: str, k: int, groups: Sequence[str], *, block_rows: int = 2_048, most_pivots: int = blocks.MOST_PIVOTS
) -> DataFrame:
    """(groups, ident, _near, _d2): the k nearest others of each row, equal ones (to nine digits) by id."""
    from seqatlas.operators.ranking import top_per_group

    groups = list(groups)
    columns = [*groups, ident, "_near", "_d2"]

    def meet(rows: pd.DataFrame, others: pd.DataFrame) -> pd.DataFrame:
        others = others.iloc[np.argsort(others[ident].to_numpy(), kind="stable")]
        a, b = blocks._stack(rows[vector]), blocks._stack(others[vector])
        ids, names = rows[ident].to_numpy(), others[ident].to_numpy()
        known = rows["_known"].to_numpy(float) if "_known" in rows else np.full(len(a), np.inf)
        shared = np.isin(ids, names)
        middle = b.mean(0)
        ca, cb = a - middle, b - middle
        na, nb = (ca * ca).sum(1), (cb * cb).sum(1)
        found = []
        for at in blocks.slabs(len(a), len(b)):
            # Products find who may be among the nearest; only these are measured.
            near = na[at, None] + nb[None, :] - 2.0 * (ca[at] @ cb.T)
            if shared[at].any():
                near[ids[at, None] == names[None, :]] = np.inf
            error = 2e-9 + 1e-12 * (na[at] + nb.max())
            beat = known[at]
            if not np.isfinite(beat).all():
                beat = np.minimum(beat, np.partition(near, min(k, len(b)) - 1, axis=1)[:, min(k, len(b)) - 1] + error)
            row, other = np.nonzero((near <= (beat + error)[:, None]) & np.isfinite(near))
            row = row + at.start
            # Summed by differences and rounded as in the merge, so that ties don't depend on the tile.
            d2 = np.zeros(len(row))
            for i in range(a.shape[1]):
                d2 += np.square(a[row, i] - b[other, i])
            d2 = np.round(d2, 9)
            order = np.lexsort((other, d2, row))
            row, other, d2 = row[order], other[order], d2[order]
            nth = np.arange(len(row)) - np.searchsorted(row, row)
            found.append((row[nth < k], other[nth < k], d2[nth < k]))
        row, other, d2 = (np.concatenate(x) for x in zip(*found))
        out = pd.DataFrame({g: rows[g].to_numpy()[row] for g in groups})
        out[ident], out["_near"], out["_d2"] = ids[row], names[other], d2
        return out[columns]

    def wants(rows: pd.DataFrame, away: np.ndarray, figures: dict) -> np.ndarray:
        least = np.maximum(away - figures["radius"][None, :], 0.0)
        return least * least * (1 - blocks.SLACK) <= rows["_known"].to_numpy(float)[:, None] + 2e-9

    types = dict(df.dtypes)
    schema = ", ".join([*[f"{g} {types[g]}" for g in groups], f"{ident} {types[ident]}", f"_near {types[ident]}", "_d2 double"])
    dealt = blocks.deal(df, ident, vector, groups, block_rows=block_rows, most_pivots=most_pivots)
    if dealt.single:
        # A tile already keeps the k nearest of its rows.
        return blocks.own_tile(dealt, meet, schema)
    first = cut_lineage(blocks.own_tile(dealt, meet, schema))
    enough = F.when(F.count(F.lit(1)) >= k, F.max("_d2"))
    known = first.groupBy(*groups, ident).agg(enough.alias("_known"))
    same = F.col(f"_r.{ident}").eqNullSafe(F.col(f"_k.{ident}"))
    for g in groups:
        same = same & F.col(f"_r.{g}").eqNullSafe(F.col(f"_k.{g}"))
    rows = dealt.rows.alias("_r").join(known.alias("_k"), same, "left")
    rows = rows.select(*[F.col(f"_r.{c}").alias(c) for c in dealt.rows.columns], F.coalesce(F.col("_k._known"), F.lit(float("inf"))).alias("_known"))
    more = blocks.visit(dealt, blocks.opened(dealt, rows, wants), meet, schema)
    return top_per_group(first.unionByName(more), [*groups, ident], [F.round("_d2", 9), F.col("_near")], k)
