"""Clusters of 64-component vectors by bit planes and population counts.

The integers of a vector are written as planes: plane j holds bit j of all 64 components in one
unsigned 64-bit word, the last plane the sign (two's complement). The product of two vectors is the sum,
over all pairs of planes, of the population count of their AND, weighted by the planes' places; with
the squared lengths it gives exact distances. Rounds scan the packed table and bring back
one row of sums per cluster; vectors themselves never move.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from seqatlas.distribution import attach_row
from seqatlas.llm.common import stage
from seqatlas.llm.vector_codes import floor_mean_sql, integers, usable, usable_sql

COMPONENTS = 64
_PLACE = np.arange(COMPONENTS, dtype=np.uint64)


def weights(planes: int) -> np.ndarray:
    """The value of a set bit in each plane."""
    out = 1 << np.arange(planes, dtype=np.int64)
    out[-1] = -out[-1]
    return out


def pack(values: np.ndarray, planes: int) -> np.ndarray:
    """(rows, 64) integers to (rows, planes) words; component k is bit k of each word."""
    out = np.empty((len(values), planes), np.uint64)
    for j in range(planes):
        bits = (values >> j & 1).astype(np.uint64)
        out[:, j] = np.bitwise_or.reduce(bits << _PLACE, axis=1)
    return out


def unpack(words: np.ndarray) -> np.ndarray:
    """The integers of packed rows."""
    out = np.zeros((len(words), COMPONENTS), np.int64)
    for j, weight in enumerate(weights(words.shape[1])):
        out += weight * (words[:, j, None] >> _PLACE & np.uint64(1)).astype(np.int64)
    return out


def products(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """All scalar products between two packed tables with equal planes, from population counts."""
    weight = weights(left.shape[1])
    out = np.zeros((len(left), len(right)), np.int64)
    for i, wi in enumerate(weight):
        for j, wj in enumerate(weight):
            out += wi * wj * np.bitwise_count(left[:, i, None] & right[None, :, j]).astype(np.int64)
    return out


def squares(words: np.ndarray) -> np.ndarray:
    """Squared length of each packed row."""
    weight = weights(words.shape[1])
    out = np.zeros(len(words), np.int64)
    for i, wi in enumerate(weight):
        for j, wj in enumerate(weight):
            out += wi * wj * np.bitwise_count(words[:, i] & words[:, j]).astype(np.int64)
    return out


def nearest(words: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number of the nearest packed centroid (ties: the smaller) and the squared distance."""
    apart = squares(words)[:, None] - 2 * products(words, centroids) + squares(centroids)
    best = apart.argmin(1)
    return best, apart[np.arange(len(words)), best]


def _words(column: pd.Series) -> np.ndarray:
    return np.stack(column.tolist()).astype(np.int64).view(np.uint64)


def packed_vectors(vectors: DataFrame, scale: int = 64) -> tuple[DataFrame, int]:
    """The usable vectors as planes, written once: (vec_id, planes array<bigint>), and how many planes
    hold every integer of the table (its sign included)."""
    kept = vectors.filter(usable(F.col("embedding")) & (F.size("embedding") == COMPONENTS))
    kept = kept.select("vec_id", integers(F.col("embedding"), scale).alias("whole"))
    low, high = kept.agg(F.min(F.array_min("whole")), F.max(F.array_max("whole"))).first()
    planes = max(int(high or 0).bit_length(), (~int(low or 0)).bit_length() if (low or 0) < 0 else 0) + 1

    def run(batches):
        for batch in batches:
            words = pack(np.stack(batch["whole"].tolist()).astype(np.int64), planes) if len(batch) else np.empty((0, planes), np.uint64)
            yield pd.DataFrame({"vec_id": batch["vec_id"].astype("Int64"), "planes": list(words.view(np.int64))})

    return stage(kept.mapInPandas(run, "vec_id long, planes array<bigint>"), "bit-planes"), planes


def first_centroids(packed: DataFrame, k: int) -> np.ndarray:
    """The vectors whose ids hash lowest under sha256 of ``1:<vec_id>``: at most k rows come to the driver.
    Equal ids stand in the order of their planes; null ids come last."""
    seed = F.sha2(F.concat(F.lit("1:"), F.col("vec_id").cast("string")).cast("binary"), 256)
    rows = packed.orderBy(seed.asc_nulls_last(), "planes").limit(k).select("planes").collect()
    return unpack(np.array([r["planes"] for r in rows], np.int64).view(np.uint64)) if rows else np.zeros((0, COMPONENTS), np.int64)


def cluster_sums(packed: DataFrame, centroids: np.ndarray, planes: int) -> list:
    """(cluster, n, sums) of the members of each cluster; a task hands on one row per cluster."""
    fixed = pack(centroids, planes)

    def run(batches):
        n, sums = np.zeros(len(fixed), np.int64), np.zeros((len(fixed), COMPONENTS), np.int64)
        for batch in batches:
            if len(batch):
                words = _words(batch["planes"])
                best, _ = nearest(words, fixed)
                n += np.bincount(best, minlength=len(fixed))
                np.add.at(sums, best, unpack(words))
        used = np.flatnonzero(n)
        yield pd.DataFrame({"cluster": used.astype(np.int32), "n": n[used], "sums": list(sums[used])})

    partial = packed.select("planes").mapInPandas(run, "cluster int, n long, sums array<bigint>")
    total = [F.sum(F.get("sums", i)).alias(f"s{i}") for i in range(COMPONENTS)]
    return partial.groupBy("cluster").agg(F.sum("n").alias("n"), *total).collect()


def fit_centroids(packed: DataFrame, planes: int, k: int = 16, rounds: int = 3) -> np.ndarray:
    """Integer centroids after the rounds; a centroid without members stays."""
    centroids = first_centroids(packed, k)
    for _ in range(rounds if len(centroids) else 0):
        for row in cluster_sums(packed, centroids, planes):
            centroids[row["cluster"]] = [row[f"s{i}"] // row["n"] for i in range(COMPONENTS)]
    return centroids


def centroid_digests(centroids: Sequence[Sequence[int]]) -> list[str]:
    return [hashlib.sha256(",".join(map(str, np.asarray(c).tolist())).encode()).hexdigest() for c in centroids]


def cluster_vectors(vectors: DataFrame, k: int = 16, rounds: int = 3, scale: int = 64) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256 for every usable vector.

    Left out are vectors without exactly 64 components or with a null, infinite or not-a-number one.
    Repeated rows are clustered each, a null id is kept, other columns are not read, with fewer than k
    vectors there are fewer centroids, an empty table gives an empty result. Means are exact floors.
    """
    packed, planes = packed_vectors(vectors, scale)
    centroids = fit_centroids(packed, planes, k, rounds)
    fixed = pack(centroids, planes)

    def run(batches):
        for batch in batches:
            best, distance = nearest(_words(batch["planes"]), fixed) if len(batch) else (np.zeros(0, int), np.zeros(0, int))
            yield pd.DataFrame({"vec_id": batch["vec_id"].astype("Int64"), "cluster": best.astype(np.int32), "distance": distance})

    found = stage(packed.mapInPandas(run, "vec_id long, cluster int, distance long"), "clusters")
    # One row per centroid, whatever the input: at most k.
    by_cluster = found.groupBy("cluster").agg(F.sum("distance").alias("cluster_inertia"))
    joined = found.join(F.broadcast(by_cluster), "cluster")
    digests = F.array(*[F.lit(d) for d in centroid_digests(centroids)], F.lit(None).cast("string"))
    out = attach_row(joined, found.agg(F.sum("distance").alias("inertia")))
    return out.select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", F.get(digests, F.col("cluster")).alias("centroid_sha256"))


def clusters_sql(k: int = 16, rounds: int = 3, scale: int = 64) -> str:
    """The same rows in DuckDB SQL."""
    steps = [f"""e AS MATERIALIZED (SELECT row_number() OVER (ORDER BY vec_id, embedding) AS r, vec_id, [floor({scale} * CAST(x AS DOUBLE)) FOR x IN embedding] AS v
  FROM embeddings WHERE {usable_sql("embedding")} AND len(embedding) = {COMPONENTS}),
c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('1:' || vec_id), v) - 1 AS cluster, v AS c FROM e QUALIFY cluster < {k})"""]
    for i in range(rounds + 1):
        steps.append(f"""a{i} AS MATERIALIZED (SELECT r, any_value(vec_id) AS vec_id, any_value(v) AS v, arg_min(cluster, (distance, cluster)) AS cluster, min(distance) AS distance
  FROM (SELECT e.*, cluster, CAST(list_dot_product(v, v) - 2 * list_dot_product(v, c) + list_dot_product(c, c) AS BIGINT) AS distance FROM e CROSS JOIN c{i}) GROUP BY r)""")
        if i < rounds:
            steps.append(f"""m{i} AS (SELECT cluster, list(x ORDER BY i) AS c FROM (
    SELECT cluster, i, CAST({floor_mean_sql("CAST(v[i] AS BIGINT)")} AS DOUBLE) AS x FROM a{i}, range(1, {COMPONENTS + 1}) t(i) GROUP BY cluster, i) GROUP BY cluster),
c{i + 1} AS MATERIALIZED (SELECT cluster, coalesce(m{i}.c, c{i}.c) AS c FROM c{i} LEFT JOIN m{i} USING (cluster))""")
    return "WITH " + ",\n".join(steps) + f"""
SELECT vec_id, CAST(cluster AS INTEGER) AS cluster, distance, CAST(sum(distance) OVER (PARTITION BY cluster) AS BIGINT) AS cluster_inertia, CAST(sum(distance) OVER () AS BIGINT) AS inertia,
  sha256(array_to_string([CAST(x AS BIGINT) FOR x IN c], ',')) AS centroid_sha256
FROM a{rounds} JOIN c{rounds} USING (cluster)"""
