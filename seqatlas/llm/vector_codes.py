"""Product codes of vectors: rounds of nearest entry and mean, with members that stay where they are.

A vector is cut into parts; a part row carries its position and its integers. Each part belongs to
the owner (position, entry, salt) of its nearest codebook entry, and the state is a table bucketed by
owner: a task reads the members of its owners from their buckets without a shuffle, sums them and
gives each its nearest entry under the next codebook. Who keeps the entry stays in the bucket; only
parts whose entry changes go through the shuffle, to the buckets of their new owners. The salt spreads the
members of a popular entry over all buckets.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from seqatlas.distribution import salted_join
from seqatlas.guards import must_hold
from seqatlas.llm.common import stage
from seqatlas.session import shared_folder

OWNER = ["position", "entry", "salt"]
LARGEST = 1 << 26  # integers beyond it could leave the 64 bits of a squared distance
_EXACT = 1 << 21  # products and sums of smaller integers are exact in doubles


def integers(vector: Column, scale: int) -> Column:
    """floor(scale * x) of each component; a row with a component beyond 2**26 fails the query."""
    whole = F.transform(vector, lambda x: F.floor(x.cast("double") * F.lit(float(scale))))
    fits = F.forall(whole, lambda x: F.abs(x) < F.lit(LARGEST))
    return F.when(must_hold(fits, "a component is too large for exact distances"), whole)


def usable(vector: Column) -> Column:
    """Neither null nor with a null, infinite or not-a-number component."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return vector.isNotNull() & F.coalesce(finite, F.lit(False))


def nearest(points: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index of the nearest entry (ties: the lower) and its squared distance, exactly."""
    if max(np.abs(points).max(initial=0), np.abs(entries).max(initial=0)) < _EXACT and points.shape[1] < 512:
        points, entries = points.astype(np.float64), entries.astype(np.float64)
    apart = (points * points).sum(1)[:, None] - 2 * (points @ entries.T) + (entries * entries).sum(1)
    best = apart.argmin(1)
    return best, apart[np.arange(len(points)), best].astype(np.int64)


def nearest_entry(position: Column, part: Column, codebooks: np.ndarray) -> Column:
    """(entry, distance) of each part in the codebook of its position, in Arrow batches."""

    @F.pandas_udf("entry int, distance long")
    def run(positions: pd.Series, parts: pd.Series) -> pd.DataFrame:
        at = positions.to_numpy()
        entry, distance = np.zeros(len(at), np.int32), np.zeros(len(at), np.int64)
        for p in np.unique(at):
            mine = np.flatnonzero(at == p)
            for some in np.array_split(mine, len(mine) // 2048 + 1):
                if len(some):
                    entry[some], distance[some] = nearest(np.stack(parts.iloc[some].tolist()).astype(np.int64), codebooks[p])
        return pd.DataFrame({"entry": entry, "distance": distance})

    return run(position, part)


class Buckets:
    """Tables bucketed by owner, in the shared folder, for the time of one fit."""

    def __init__(self, df: DataFrame, count: int):
        self.spark, self.count, self.names = df.sparkSession, count, []

    def write(self, df: DataFrame) -> DataFrame:
        """Rows that already lie in their buckets are written from where they are."""
        name = f"parts_{uuid.uuid4().hex}"
        path = f"{shared_folder(self.spark).rstrip('/')}/llm/{name}"
        df.write.bucketBy(self.count, *OWNER).option("path", path).option("compression", "zstd").format("parquet").saveAsTable(name)
        self.names.append(name)
        return self.spark.table(name)

    def settle(self, df: DataFrame) -> DataFrame:
        """Send rows to the buckets of their owners."""
        return self.write(df.repartition(self.count, *OWNER))

    def forget(self) -> None:
        for name in self.names:
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")
        self.names = []


def owner_sums(layers: Sequence[DataFrame], width: int) -> DataFrame:
    """(position, entry, n, sums) from members where they lie: one row per owner leaves a bucket."""
    sums = [F.sum(F.get("part", i)).alias(f"s{i}") for i in range(width)]
    owned = [x.groupBy(*OWNER).agg(F.count(F.lit(1)).alias("n"), *sums) for x in layers]
    rows = owned[0]
    for more in owned[1:]:
        rows = rows.unionByName(more)
    total = rows.groupBy("position", "entry").agg(F.sum("n").alias("n"), *[F.sum(f"s{i}").alias(f"s{i}") for i in range(width)])
    return total.select("position", "entry", "n", F.array(*[f"s{i}" for i in range(width)]).alias("sums"))


def updated(codebooks: np.ndarray, sums: DataFrame) -> np.ndarray:
    """Entries replaced by the floor of their members' mean; at most one row per entry comes to the driver."""
    out = codebooks.copy()
    for row in sums.collect():
        out[row["position"], row["entry"]] = [s // row["n"] for s in row["sums"]]
    return out


def first_vectors(vectors: DataFrame, entries: int) -> list[list[int]]:
    """The integers of the rows with the smallest ids (equal ids: by their integers; null ids last)."""
    order = [F.col("vec_id").asc_nulls_last(), F.col("whole").asc()]
    return [r["whole"] for r in vectors.orderBy(*order).limit(entries).select("whole").collect()]


def fit_codes(parts: DataFrame, codebooks: np.ndarray, rounds: int, salts: int, buckets: Buckets, moved: list | None = None) -> np.ndarray:
    """Run the rounds over part rows (row, position, part); returns the codebooks. A list ``moved``
    gets the number of migrated parts after each round but the last (one more small scan each)."""
    width = codebooks.shape[2]
    columns = ["row", "position", "part"]
    salt = F.pmod(F.xxhash64("row"), F.lit(salts)).cast("int").alias("salt")
    found = nearest_entry(F.col("position"), F.col("part"), codebooks)["entry"].alias("entry")
    layers = [buckets.settle(parts.select(*columns, salt, found))]
    for turn in range(rounds):
        codebooks = updated(codebooks, owner_sums(layers, width))
        if turn == rounds - 1:
            break
        near = nearest_entry(F.col("position"), F.col("part"), codebooks)["entry"].alias("next")
        # Each layer is judged once, in its buckets; the verdict is written beside the members.
        judged = [buckets.write(x.select(*OWNER, "row", "part", near)) for x in layers]
        leave = [x.filter("next <> entry").select(*columns, "salt", F.col("next").alias("entry")) for x in judged]
        leaving = leave[0]
        for more in leave[1:]:
            leaving = leaving.unionByName(more)
        arrived = buckets.settle(leaving)
        stay = [x.filter("next = entry").select(*OWNER, "row", "part") for x in judged]
        if moved is not None:
            moved.append(arrived.count())
        layers = [*stay, arrived.select(*OWNER, "row", "part")]
    return codebooks


def digest_text(codebooks: np.ndarray) -> str:
    return ",".join(map(str, codebooks.ravel().tolist()))


def compress(vectors: DataFrame, positions: int = 4, entries: int = 256, rounds: int = 4, scale: int = 1024, salts: int | None = None) -> tuple[DataFrame, np.ndarray]:
    """Codes of all usable vectors and the codebooks, an array (position, entry, component).

    ``vectors`` has vec_id, embedding and label. Rows whose vector is null or has a null, infinite or
    not-a-number component are left out. The smallest vec_ids start the codebooks (fewer rows: fewer
    entries). Vectors must be as long as the first one and divide into ``positions``; others keep
    their row, with null code and error. Repeated rows are coded each, null ids are kept, other columns
    are not read, an empty table has no codes. Returns (row, vec_id, label, code, error), written.
    """
    spark = vectors.sparkSession
    kept = vectors.filter(usable(F.col("embedding"))).select("vec_id", "label", integers(F.col("embedding"), scale).alias("whole"))
    # Rows get their number once, in a written table.
    kept = stage(kept.withColumn("row", F.monotonically_increasing_id()), "vectors")
    first = first_vectors(kept, entries)
    length = len(first[0]) if first else 0
    first = [v for v in first if len(v) == length]
    if not length or length % positions:
        none = kept.select("row", "vec_id", "label", F.lit(None).cast("string").alias("code"), F.lit(None).cast("long").alias("error"))
        return none, np.zeros((positions, 0, 0), np.int64)
    width = length // positions
    codebooks = np.array(first, np.int64).reshape(len(first), positions, width).transpose(1, 0, 2).copy()
    cut = F.array(*[F.slice("whole", p * width + 1, width) for p in range(positions)])
    fitting = kept.filter(F.size("whole") == length)
    parts = fitting.select("row", F.posexplode(cut).alias("position", "part"))
    shuffled = int(spark.conf.get("spark.sql.shuffle.partitions"))
    count = max(shuffled, -(-fitting.count() * positions // 1_000_000))
    buckets = Buckets(kept, count)
    try:
        codebooks = fit_codes(parts, codebooks, rounds, salts or count, buckets)
    finally:
        buckets.forget()
    # The last assignment needs no owner: the parts of a vector are judged where the vector is.
    found = [nearest_entry(F.lit(p), F.slice("whole", p * width + 1, width), codebooks) for p in range(positions)]
    judged = fitting.select("row", "vec_id", "label", *[f.alias(f"p{p}") for p, f in enumerate(found)])
    code = F.lower(F.concat(*[F.lpad(F.hex(f"p{p}.entry"), 2, "0") for p in range(positions)]))
    error = sum((F.col(f"p{p}.distance") for p in range(1, positions)), F.col("p0.distance"))
    coded = judged.select("row", "vec_id", "label", code.alias("code"), error.alias("error"))
    others = kept.filter(F.size("whole") != length).select("row", "vec_id", "label", F.lit(None).cast("string").alias("code"), F.lit(None).cast("long").alias("error"))
    return stage(coded.unionByName(others), "vector-codes"), codebooks


def coded_vectors(vectors: DataFrame, **options) -> DataFrame:
    """vec_id, code, error, label_error (summed over equal labels, nulls together), codebooks_sha256."""
    coded, codebooks = compress(vectors, **options)
    # Written, so that its measured size decides how it is joined; a popular label is salted if it is large.
    labels = stage(coded.groupBy("label").agg(F.sum("error").alias("label_error")), "label-errors")
    named = lambda df: df.withColumn("_no_label", F.col("label").isNull()).withColumn("_label", F.coalesce("label", F.lit(0)))
    keys = ["_no_label", "_label"]
    joined = salted_join(named(coded), named(labels).drop("label"), keys, salt_on=["row"], how="left")
    digest = F.sha2(F.lit(digest_text(codebooks)).cast("binary"), 256)
    return joined.select("vec_id", "code", "error", "label_error", digest.alias("codebooks_sha256"))


def usable_sql(vector: str) -> str:
    return f"{vector} IS NOT NULL AND len([x FOR x IN {vector} IF x IS NULL OR NOT isfinite(x)]) = 0"


def floor_mean_sql(value: str) -> str:
    """The floor of a mean of integers as a DuckDB aggregate (its // cuts towards zero)."""
    total, n = f"CAST(sum({value}) AS BIGINT)", "count(*)"
    return f"({total} - (({total} % {n}) + {n}) % {n}) // {n}"


def codes_sql(positions: int = 4, entries: int = 256, rounds: int = 4, scale: int = 1024) -> str:
    """The same rows in DuckDB SQL, for vectors of equal length."""
    steps = [f"""e AS MATERIALIZED (SELECT row_number() OVER (ORDER BY vec_id, v) AS r, * FROM (
    SELECT vec_id, label, [floor({scale} * CAST(x AS DOUBLE)) FOR x IN embedding] AS v FROM embeddings WHERE {usable_sql("embedding")})),
p AS MATERIALIZED (SELECT r, position, v[position * (len(v) // {positions}) + 1 : (position + 1) * (len(v) // {positions})] AS part FROM e, range({positions}) t(position)),
c0 AS MATERIALIZED (SELECT position, r - 1 AS entry, part AS c FROM p WHERE r <= {entries})"""]
    for i in range(rounds + 1):
        steps.append(f"""a{i} AS MATERIALIZED (SELECT r, position, any_value(part) AS part, arg_min(entry, (distance, entry)) AS entry, min(distance) AS distance
  FROM (SELECT p.*, entry, CAST(list_dot_product(part, part) - 2 * list_dot_product(part, c) + list_dot_product(c, c) AS BIGINT) AS distance FROM p JOIN c{i} USING (position)) GROUP BY r, position)""")
        if i < rounds:
            steps.append(f"""m{i} AS (SELECT position, entry, list(x ORDER BY i) AS c FROM (
    SELECT position, entry, i, CAST({floor_mean_sql("CAST(part[i] AS BIGINT)")} AS DOUBLE) AS x
    FROM (SELECT *, unnest(range(1, len(part) + 1)) AS i FROM a{i}) GROUP BY position, entry, i) GROUP BY position, entry),
c{i + 1} AS MATERIALIZED (SELECT position, entry, coalesce(m{i}.c, c{i}.c) AS c FROM c{i} LEFT JOIN m{i} USING (position, entry))""")
    return "WITH " + ",\n".join(steps) + f""",
b AS (SELECT sha256(string_agg(array_to_string([CAST(x AS BIGINT) FOR x IN c], ','), ',' ORDER BY position, entry)) AS codebooks_sha256 FROM c{rounds}),
f AS (SELECT r, string_agg(format('{{:02x}}', entry), '' ORDER BY position) AS code, CAST(sum(distance) AS BIGINT) AS error FROM a{rounds} GROUP BY r)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM e JOIN f USING (r) CROSS JOIN b"""
