"""How work is spread: salted joins, chunked sequences,
exact quantiles without collecting a group, and tiled pairing.

A key may hold a third of all rows, so nothing here gathers the rows of one key
in one task. What does meet in one task is bounded by a block size that the
caller can set.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from seqatlas.guards import must_hold
from seqatlas.session import cut_lineage

# --- joins ----------------------------------------------------------------------


def attach_row(df: DataFrame, one: DataFrame) -> DataFrame:
    """Add the columns of a one-row table (a whole-table aggregate) to every row.

    The row is a scalar subquery: it is computed once and reaches the tasks as a value, so
    nothing is joined.
    """
    value = one.select(F.struct(*one.columns).alias("_one")).scalar()
    return df.withColumn("_one", value).select(*df.columns, *[F.col(f"_one.{c}").alias(c) for c in one.columns])


def salted_join(
    big: DataFrame,
    other: DataFrame,
    keys: Sequence[str],
    *,
    salt_on: Sequence[str],
    how: str = "inner",
    salts: int | None = None,
) -> DataFrame:
    """Equi-join whose hot keys are spread over ``salts`` tasks (as many as the shuffle has partitions).

    The side with one row per key is repeated once per salt; the big side
    picks its salt from a hash of columns that vary inside a key.
    """
    if how not in ("inner", "left"):
        raise ValueError("salted_join keeps the big side whole: use inner or left")
    salts = salts or max(int(big.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    left = big.withColumn("_salt", F.pmod(F.xxhash64(*salt_on), F.lit(salts)).cast("int"))
    right = other.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return left.join(right, [*keys, "_salt"], how).drop("_salt")


# --- sequences ------------------------------------------------------------------


TASK_ROWS = 131_072  # rows of a task that sorts whole frames


def in_small_tasks(df: DataFrame, by: Sequence[str], rows: int | None = None) -> DataFrame:
    """``df`` dealt by ``by`` to so many tasks that each gets about ``TASK_ROWS`` of its rows.

    The number of shuffle partitions is fixed, and small partitions are joined but large ones are not cut, so the sorts
    of a task would otherwise grow with the table. A table that is one such task stays as it is. ``rows`` is counted when
    not given.
    """
    tasks = -(-(df.count() if rows is None else rows) // TASK_ROWS)
    if tasks <= 1:
        return df
    least = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(max(tasks, least), *by)


@dataclass(frozen=True)
class Sequences:
    """Rows that form ordered sequences: one sequence per key, dense frames from 0.

    Long sequences are cut into chunks of ``chunk_rows`` frames. Every window is
    partitioned by key *and* chunk; a per-key window only ever sees one row per chunk.
    """

    keys: tuple[str, ...]
    frame: str = "frame"
    chunk_rows: int = 65_536

    @property
    def chunk(self) -> Column:
        return F.floor(F.col(self.frame) / F.lit(self.chunk_rows)).cast("long")

    @property
    def parts(self) -> list[str]:
        return [*self.keys, "_chunk"]

    def window(self):
        return Window.partitionBy(*self.parts).orderBy(self.frame)

    def backwards(self):
        """The same rows from last to first. A frame that runs to the end of a partition is
        recomputed for every row; looking back from the other side is not."""
        return Window.partitionBy(*self.parts).orderBy(F.col(self.frame).desc())

    def between_chunks(self, backwards: bool = False):
        order = F.col("_chunk").desc() if backwards else F.col("_chunk")
        return Window.partitionBy(*self.keys).orderBy(order)


def number_rows(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    *,
    bucket: Column,
    into: str = "frame",
) -> DataFrame:
    """Dense 0-based position of each row in its sequence.

    ``bucket`` must not decrease along ``order`` (for an integer order column: the
    column divided by a block size). Rows are numbered inside a bucket and shifted by
    the rows of earlier buckets, so a hot key is spread over its buckets.
    """
    marked = df.withColumn("_bucket", bucket)
    counts = marked.groupBy(*keys, "_bucket").agg(F.count(F.lit(1)).alias("_rows"))
    before = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(*keys, "_bucket", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_start"))
    inside = Window.partitionBy(*keys, "_bucket").orderBy(*order)
    return (
        marked.withColumn("_nth", F.row_number().over(inside))
        .join(starts, [*keys, "_bucket"])
        .withColumn(into, (F.col("_start") + F.col("_nth") - 1).cast("long"))
        .drop("_bucket", "_start", "_nth")
    )


def rank_rows(df: DataFrame, keys: Sequence[str], order: Sequence[str], *, into: str = "rank") -> DataFrame:
    """Dense 0-based rank of each row inside its key, for any sortable columns.

    Rows are dealt to ranges of (key, order) whose boundaries Spark samples, so neither a hot key nor a
    common prefix fills one task. The sorted ranges are written once; a row's rank is its
    place in its range less the first place of its key there, plus the rows of earlier ranges.
    """
    keys, columns = list(keys), df.columns
    ranged = df.repartitionByRange(*[F.col(c).asc() for c in [*keys, *order]]).sortWithinPartitions(*keys, *order)
    placed = cut_lineage(ranged.withColumn("_at", F.monotonically_increasing_id()).withColumn("_range", F.shiftright("_at", 33)))
    counts = placed.groupBy(*keys, "_range").agg(F.count(F.lit(1)).alias("_rows"), F.min("_at").alias("_first"))
    before = Window.partitionBy(*(keys or [F.lit(0)])).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    # One row for each key and range.
    starts = counts.select(*keys, "_range", (F.coalesce(F.sum("_rows").over(before), F.lit(0)) - F.col("_first")).alias("_shift"))
    same = F.lit(True)
    for c in [*keys, "_range"]:
        same = same & F.col(f"_s.{c}").eqNullSafe(F.col(f"_p.{c}"))
    joined = placed.alias("_p").join(starts.alias("_s"), same)
    return joined.select(*[F.col(f"_p.{c}").alias(c) for c in columns], (F.col("_p._at") + F.col("_s._shift")).alias(into))


def with_chunks(df: DataFrame, seq: Sequences) -> DataFrame:
    return df.withColumn("_chunk", seq.chunk)


def with_halo(df: DataFrame, seq: Sequences, before: int = 0, after: int = 0) -> DataFrame:
    """Repeat the rows at chunk borders, so windows that look a bounded number of
    frames back or ahead need no data from other chunks. ``_core`` marks the originals."""
    if max(before, after) >= seq.chunk_rows:
        raise ValueError("the look-around must be shorter than a chunk")
    at = lambda shift: F.floor((F.col(seq.frame) + F.lit(shift)) / F.lit(seq.chunk_rows)).cast("long")
    homes = F.array_distinct(F.array(at(-after), at(0), at(before)))
    return (
        df.withColumn("_chunk", F.explode(F.filter(homes, lambda c: c >= 0)))
        .withColumn("_core", F.col("_chunk") == seq.chunk)
    )


def core_only(df: DataFrame) -> DataFrame:
    return df.filter("_core").drop("_core", "_chunk")


def attach_totals(df: DataFrame, seq: Sequences, totals: Mapping[str, tuple[Column, Callable]]) -> DataFrame:
    """Add per-sequence totals to every row of a chunked table.

    ``totals`` maps a name to (aggregate inside a chunk, function that merges the
    chunk values). The join runs on key and chunk, so hot keys stay spread out.
    """
    source = df.filter("_core") if "_core" in df.columns else df
    per_chunk = source.groupBy(*seq.parts).agg(*[part.alias(name) for name, (part, _) in totals.items()])
    whole = Window.partitionBy(*seq.keys)
    merged = per_chunk.select(*seq.parts, *[merge(name).over(whole).alias(name) for name, (_, merge) in totals.items()])
    return df.join(merged, seq.parts, "left")


def attach_neighbours(df: DataFrame, seq: Sequences, points: Mapping[str, tuple[Column, Column]]) -> DataFrame:
    """For each name in ``points`` (value, valid) add ``<name>_prev`` and ``<name>_after``:
    (at, value) of the nearest valid row at or before, and strictly after, each row of
    a chunked table, however far away."""
    names = list(points)
    marked = df.withColumns(
        {
            f"{n}_point": F.when(valid, F.struct(F.col(seq.frame).alias("at"), value.alias("value")))
            for n, (value, valid) in points.items()
        }
    )
    per_chunk = marked.groupBy(*seq.parts).agg(
        *[F.min(f"{n}_point").alias(f"{n}_first") for n in names],
        *[F.max(f"{n}_point").alias(f"{n}_last") for n in names],
    )
    earlier = seq.between_chunks().rowsBetween(Window.unboundedPreceding, -1)
    later = seq.between_chunks(backwards=True).rowsBetween(Window.unboundedPreceding, -1)
    carried = per_chunk.select(
        *seq.parts,
        *[F.last(f"{n}_last", ignorenulls=True).over(earlier).alias(f"{n}_carry_prev") for n in names],
        *[F.last(f"{n}_first", ignorenulls=True).over(later).alias(f"{n}_carry_after") for n in names],
    )
    back = seq.window().rowsBetween(Window.unboundedPreceding, 0)
    ahead = seq.backwards().rowsBetween(Window.unboundedPreceding, -1)
    local = marked.select(
        "*",
        *[F.last(f"{n}_point", ignorenulls=True).over(back).alias(f"{n}_local_prev") for n in names],
        *[F.last(f"{n}_point", ignorenulls=True).over(ahead).alias(f"{n}_local_after") for n in names],
    )
    return local.join(carried, seq.parts).select(
        *df.columns,
        *[F.coalesce(f"{n}_local_{s}", f"{n}_carry_{s}").alias(f"{n}_{s}") for n in names for s in ("prev", "after")],
    )


# --- exact quantiles ------------------------------------------------------------


GRID = 100  # steps into which a pass cuts a bracket that is still too wide
BROADCAST_ROWS = 50_000  # brackets (a few numbers each) sent to every task; more are joined by a shuffle


def exact_quantiles(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    probs: Mapping[str, float],
    *,
    few_groups: bool = False,
    accuracy: int = 10_000,
) -> DataFrame:
    """Exact linear-interpolated quantiles per key, one output column per entry of ``probs``.

    Groups of at most ``2 * accuracy`` rows are one exact aggregate. For larger ones a mergeable sketch first
    brackets the wanted ranks. Values below a bracket are counted inside each task and values above are
    dropped, so only the bracket's distinct values are shuffled. A bracket that would still be larger is cut
    by further passes, each to a few hundredths; none ever brings more than about ``2 * accuracy``
    values to one task. ``few_groups`` says that the large groups are certainly few.
    """
    keys, names = list(keys), list(probs)
    wanted = [float(probs[k]) for k in names]
    limit = 2 * accuracy
    rows = df.select(*keys, F.col(value).cast("double").alias("_v")).filter(F.col("_v").isNotNull())
    counts = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    most, least = counts.agg(F.max("_n"), F.min("_n")).first()
    if (most or 0) <= limit:
        return _quantiles_at_once(rows, keys, names, wanted)
    large = cut_lineage(counts.filter(F.col("_n") > limit))
    sent = few_groups or large.count() <= BROADCAST_ROWS

    def matched(big: DataFrame, state: DataFrame) -> DataFrame:
        if not keys:
            return attach_row(big, state)
        return big.join(F.broadcast(state), keys) if sent else salted_join(big, state, keys, salt_on=["_v"])

    state = cut_lineage(_first_brackets(matched(rows, large), keys, wanted, accuracy))
    share = (2 * 2.0 + 2.0) / accuracy
    # How many values the widest bracket holds, by the sketch's guarantee.
    widest = most * share
    while widest > limit:
        state = cut_lineage(_narrowed(matched(rows, state), keys, wanted))
        widest = widest * (6.0 / GRID)
    found = _ranked_in_brackets(matched(rows, state), keys, names, wanted)
    if not keys or least > limit:
        return found
    small = rows.join(F.broadcast(large.select(*keys)) if sent else large.select(*keys), keys, "left_anti")
    return found.unionByName(_quantiles_at_once(small, keys, names, wanted))


def _quantiles_at_once(rows: DataFrame, keys: list[str], names: list[str], wanted: list[float]) -> DataFrame:
    one = F.percentile("_v", F.array(*[F.lit(p) for p in wanted])).alias("_q")
    out = rows.groupBy(*keys).agg(one)
    return out.select(*keys, *[F.get("_q", F.lit(i)).alias(n) for i, n in enumerate(names)])


def _first_brackets(rows: DataFrame, keys: list[str], wanted: list[float], accuracy: int) -> DataFrame:
    """(keys, _n, _lows, _highs) from a sketch of each group."""
    slack, m = 2.0 / accuracy, len(wanted)
    marks = [max(p - slack, 0.0) for p in wanted] + [min(p + slack, 1.0) for p in wanted]
    sketch = rows.groupBy(*keys).agg(F.max("_n").alias("_n"), F.percentile_approx("_v", marks, accuracy).alias("_marks"))
    return sketch.select(*keys, "_n", F.slice("_marks", 1, m).alias("_lows"), F.slice("_marks", m + 1, m).alias("_highs"))


def _slots(joined: DataFrame, keys: list[str], m: int) -> DataFrame:
    """(keys, _n, _q, _s): every value at or below the top of bracket q; _s is NULL below its bottom."""
    slots = F.array(
        *[
            F.struct(
                F.lit(i).alias("q"),
                (F.col("_v") <= F.col("_highs")[i]).alias("near"),
                F.when(F.col("_v") >= F.col("_lows")[i], F.col("_v")).alias("s"),
            )
            for i in range(m)
        ]
    )
    near = joined.select(*keys, "_n", "_lows", "_highs", F.explode(F.filter(slots, lambda x: x["near"])).alias("_x"))
    return near.select(*keys, "_n", F.col("_x.q").alias("_q"), F.col("_x.s").alias("_s"))


def _rank(wanted: list[float]) -> Column:
    return F.element_at(F.array(*[F.lit(p) for p in wanted]), F.col("_q") + 1) * (F.col("_n") - 1)


def _narrowed(joined: DataFrame, keys: list[str], wanted: list[float]) -> DataFrame:
    """The same brackets, cut to the grid steps around the wanted rank."""
    grid = [i / GRID for i in range(GRID + 1)]
    figures = _slots(joined, keys, len(wanted)).groupBy(*keys, "_n", "_q").agg(
        F.count(F.when(F.col("_s").isNull(), 1)).alias("_below"), F.count("_s").alias("_m"),
        F.percentile_approx("_s", grid, 10 * GRID).alias("_grid"),
    )
    # A step more than the sketch's error on either side.
    at = (_rank(wanted) - F.col("_below")) / F.greatest(F.col("_m"), F.lit(1)) * GRID
    step = lambda i: F.least(F.greatest(i, F.lit(0)), F.lit(GRID)).cast("int")
    low, high = F.get("_grid", step(F.floor(at) - 2)), F.get("_grid", step(F.ceil(at) + 2))
    cut = figures.select(*keys, "_n", "_q", low.alias("_low"), high.alias("_high"))
    ordered = F.array_sort(F.collect_list(F.struct("_q", "_low", "_high")))
    packed = cut.groupBy(*keys).agg(F.max("_n").alias("_n"), ordered.alias("_b"))
    return packed.select(*keys, "_n", F.col("_b._low").alias("_lows"), F.col("_b._high").alias("_highs"))


def _ranked_in_brackets(joined: DataFrame, keys: list[str], names: list[str], wanted: list[float]) -> DataFrame:
    """The quantiles, from the distinct values inside each bracket and the number below it."""
    counted = _slots(joined, keys, len(wanted)).groupBy(*keys, "_n", "_q", "_s").agg(F.count(F.lit(1)).alias("_c"))
    up_to = Window.partitionBy(*keys, "_q").orderBy(F.col("_s").asc_nulls_first())
    ranked = counted.withColumn("_cum", F.sum("_c").over(up_to.rowsBetween(Window.unboundedPreceding, 0))).withColumn("_h", _rank(wanted))
    picked = ranked.groupBy(*keys, "_q", "_h").agg(
        F.max(F.when(F.col("_s").isNull(), F.col("_cum"))).alias("_below"),
        F.min(F.when(F.col("_cum") > F.floor("_h"), F.col("_s"))).alias("_a"),
        F.min(F.when(F.col("_cum") > F.ceil("_h"), F.col("_s"))).alias("_b"),
    )
    inside = (F.coalesce(F.col("_below"), F.lit(0)) <= F.floor("_h")) & F.col("_a").isNotNull() & F.col("_b").isNotNull()
    q = F.col("_a") + (F.col("_b") - F.col("_a")) * (F.col("_h") - F.floor("_h"))
    checked = picked.filter(must_hold(inside, "a quantile fell outside its bracket")).withColumn("_value", q)
    return checked.groupBy(*keys).agg(*[F.max(F.when(F.col("_q") == i, F.col("_value"))).alias(n) for i, n in enumerate(names)])


# --- pairs ----------------------------------------------------------------------


def tiled(df: DataFrame, ident: str, groups: Sequence[str] = (), *, block_rows: int = 1_024) -> DataFrame:
    """Cut each group into blocks and send every row to the tiles its block takes part in.

    Two rows of a group meet in exactly one tile (``_ti``, ``_tj``), and a tile holds two
    blocks at most. A hot group has many tiles instead of one long task.
    """
    groups = list(groups)
    blocks = F.ceil(F.count(F.lit(1)) / F.lit(block_rows)).cast("long").alias("_blocks")
    sizes = df.groupBy(*groups).agg(blocks)
    sized = salted_join(df, sizes, groups, salt_on=[ident]) if groups else attach_row(df, sizes)
    blocked = sized.withColumn("_block", F.pmod(F.xxhash64(ident), F.col("_blocks")))
    return (
        blocked.withColumn("_other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_blocks") - 1)))
        .withColumn("_ti", F.least("_block", "_other"))
        .withColumn("_tj", F.greatest("_block", "_other"))
        .drop("_blocks", "_other")
    )


def tile_pairs(
    df: DataFrame,
    ident: str,
    groups: Sequence[str] = (),
    *,
    block_rows: int = 1_024,
) -> DataFrame:
    """Unordered pairs of rows inside each group as an equi-join on tiles; columns get
    the suffixes ``_a`` and ``_b`` with the smaller ident on side a."""
    by = [*groups, "_ti", "_tj"]
    cut = tiled(df, ident, groups, block_rows=block_rows)
    rest = [c for c in df.columns if c not in groups]
    left = cut.filter(F.col("_block") == F.col("_ti")).select(*by, F.struct(*rest).alias("_l"))
    right = cut.filter(F.col("_block") == F.col("_tj")).select(*by, F.struct(*rest).alias("_r"))
    l, r = F.col(f"_l.{ident}"), F.col(f"_r.{ident}")
    met = left.join(right, by).filter((F.col("_ti") < F.col("_tj")) | (l < r))
    return met.select(
        *groups,
        *[F.when(l < r, F.col(f"_l.{c}")).otherwise(F.col(f"_r.{c}")).alias(f"{c}_a") for c in rest],
        *[F.when(l < r, F.col(f"_r.{c}")).otherwise(F.col(f"_l.{c}")).alias(f"{c}_b") for c in rest],
    )
