"""Operators on frame tables: one row per (sequence, frame).

All of them work on chunks of a sequence (see ``distribution.Sequences``), so one very
long sequence is spread over many tasks. A point is ``struct<x,y,z>``, NULL when
the frame has no detection.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from seqatlas.distribution import (
    Sequences,
    attach_neighbours,
    attach_totals,
    core_only,
    exact_quantiles,
    in_small_tasks,
    salted_join,
    with_chunks,
    with_halo,
)
from seqatlas.functions import arrays as A
from seqatlas.session import cut_lineage
from seqatlas.sources.layout import HAND_LANDMARKS, HANDS, MOUTH_CORNERS, MOUTH_LANDMARKS, POSE_BLOCKS, POSE_STRIDE, flat_hand

# Fixed values of the preprocessing rules.
MAX_GAP = 8
TURN_DEGREES = 45.0
STILL = 1e-8
HAND_ACTIVE = 0.008
POSE_ACTIVE = 0.006
TRIM_MARGIN = 3
TRIM_MIN_KEEP = 12
MINORITY_SHARE = 0.20
SAMPLED_FRAMES = 24
MIN_OUTPUT_FRAMES = 60
MIN_VALID_HAND_FRAMES = 3
UPPER_BODY = 6  # landmarks from the first shoulder on whose motion is scored


# --- steps ----------------------------------------------------------------------


def step_distance(df: DataFrame, seq: Sequences, point: str, into: str = "step") -> DataFrame:
    """Distance to the previous frame; NULL when either frame is missing."""
    h = with_halo(df, seq, before=1)
    moved = h.withColumn(into, A.step(F.col(point), F.lag(point).over(seq.window())))
    return core_only(moved)


def _chunk_steps(df: DataFrame, seq: Sequences, point: str) -> DataFrame:
    """Chunked rows with ``_here`` (at, value) and ``_past``, the last valid point
    before the row inside the same chunk."""
    here = F.when(F.col(point).isNotNull(), F.struct(F.col(seq.frame).alias("at"), F.col(point).alias("value")))
    back = seq.window().rowsBetween(Window.unboundedPreceding, -1)
    return in_small_tasks(with_chunks(df, seq), seq.parts).withColumn("_here", here).withColumn(
        "_past", F.when(F.col("_here").isNotNull(), F.last("_here", ignorenulls=True).over(back))
    )


def valid_step_summary(df: DataFrame, seq: Sequences, point: str) -> DataFrame:
    """Per sequence: share of valid frames, mean step, path length and step deviation over
    consecutive *valid* frames; 0 with fewer than two of them."""
    steps = _chunk_steps(df, seq, point).withColumn("_d", A.step(F.col("_here.value"), F.col("_past.value")))
    per_chunk = steps.groupBy(*seq.parts).agg(
        F.count(F.lit(1)).alias("_rows"),
        F.count("_here").alias("_valid"),
        F.count("_d").alias("_n"),
        F.sum("_d").alias("_sum"),
        F.avg("_d").alias("_mean"),
        (F.var_pop("_d") * F.count("_d")).alias("_m2"),
        F.min("_here").alias("_first"),
        F.max("_here").alias("_last"),
    )
    earlier = seq.between_chunks().rowsBetween(Window.unboundedPreceding, -1)
    bridged = per_chunk.withColumn(
        "_gap", A.step(F.col("_first.value"), F.last("_last", ignorenulls=True).over(earlier)["value"])
    )
    total = lambda name, bridge: F.coalesce(F.sum(name), F.lit(0)) + F.coalesce(F.sum(bridge), F.lit(0))
    sums = bridged.groupBy(*seq.keys).agg(
        F.sum("_rows").alias("_rows"),
        F.sum("_valid").alias("_valid"),
        total("_n", F.when(F.col("_gap").isNotNull(), 1)).alias("_n"),
        total("_sum", F.col("_gap")).alias("_sum"),
        F.collect_list(F.array(F.struct("_n", "_mean", "_m2"), F.struct(F.when(F.col("_gap").isNotNull(), 1).otherwise(0).cast("long").alias("_n"), F.col("_gap").alias("_mean"), F.lit(0.0).alias("_m2")))).alias("_parts"),
    )
    mean = F.when(F.col("_n") > 0, F.col("_sum") / F.col("_n")).otherwise(F.lit(0.0))
    # Deviations of the parts from their own means and of these from the whole mean: no large squares cancel.
    part = lambda p: F.when(p["_n"] > 0, p["_m2"] + p["_n"] * (p["_mean"] - mean) * (p["_mean"] - mean)).otherwise(F.lit(0.0))
    variance = F.aggregate(F.flatten("_parts"), F.lit(0.0), lambda acc, p: acc + part(p)) / F.col("_n")
    return sums.select(
        *seq.keys,
        (F.col("_valid") / F.col("_rows")).alias("valid_frame_ratio"),
        mean.alias("motion_magnitude"),
        F.col("_sum").cast("double").alias("trajectory_length"),
        F.when(F.col("_n") > 0, F.sqrt(variance)).otherwise(F.lit(0.0)).alias("motion_std"),
    )


def sum_if_any(*values: Column) -> Column:
    """Sum that skips missing terms; NULL when all are missing."""
    total = sum((F.coalesce(v, F.lit(0.0)) for v in values[1:]), F.coalesce(values[0], F.lit(0.0)))
    return F.when(F.coalesce(*values).isNotNull(), total)


def mean_if_any(*values: Column) -> Column:
    present = sum((v.isNotNull().cast("int") for v in values[1:]), values[0].isNotNull().cast("int"))
    return sum_if_any(*values) / present


def two_hand_motion(df: DataFrame, seq: Sequences, left: str, right: str) -> DataFrame:
    """Step of both hands per frame: their sum, NULL only when both are missing."""
    h = with_halo(df, seq, before=1)
    w = seq.window()
    steps = [A.step(F.col(p), F.lag(p).over(w)) for p in (left, right)]
    return core_only(h.withColumn("motion", sum_if_any(*steps)))


def velocity_acceleration(df: DataFrame, seq: Sequences, motion: str, fps: Column | None = None) -> DataFrame:
    """Velocity (motion times frame rate where one is known) and its first difference."""
    rate = F.lit(1.0) if fps is None else F.when(fps > 0, fps).otherwise(F.lit(1.0))
    h = with_halo(df, seq, before=1).withColumn("velocity", F.col(motion) * rate)
    return core_only(h.withColumn("acceleration", F.col("velocity") - F.lag("velocity").over(seq.window())))


def kinematics_summary(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Per sequence statistics of velocity and acceleration; deviations are population."""
    return df.groupBy(*keys).agg(
        F.avg("velocity").alias("mean_velocity"),
        F.max("velocity").alias("max_velocity"),
        F.stddev_pop("velocity").alias("velocity_std"),
        F.avg(F.abs("acceleration")).alias("mean_acceleration"),
        F.max(F.abs("acceleration")).alias("max_acceleration"),
        F.stddev_pop("acceleration").alias("acceleration_std"),
    )


# --- trajectory -----------------------------------------------------------------


def _delta(a: Column, b: Column) -> Column:
    return F.struct((a["x"] - b["x"]).alias("x"), (a["y"] - b["y"]).alias("y"), (a["z"] - b["z"]).alias("z"))


def _length(v: Column) -> Column:
    return F.sqrt(v["x"] * v["x"] + v["y"] * v["y"] + v["z"] * v["z"])


def _turns(before: Column, now: Column) -> Column:
    dot = before["x"] * now["x"] + before["y"] * now["y"] + before["z"] * now["z"]
    cosine = dot / F.greatest(_length(before) * _length(now), F.lit(STILL))
    degrees = F.degrees(F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), cosine))))
    return F.when(degrees > TURN_DEGREES, 1).otherwise(0)


def trajectory_stats(df: DataFrame, seq: Sequences, point: str) -> DataFrame:
    """Per sequence: path length over adjacent frames, end-to-end displacement,
    straightness, direction changes above 45 degrees and the area of the xy box.

    Each chunk is reduced to its ends (first and last point, first and last moving
    step); the joints between chunks are then added from those few rows.
    """
    rows = _chunk_steps(df, seq, point)
    delta = _delta(F.col("_here.value"), F.col("_past.value"))
    adjacent = F.col("_past.at") == F.col("_here.at") - 1
    rows = (
        rows.withColumn("_len", F.when(F.col("_past").isNotNull(), _length(delta)))
        .withColumn("_path", F.when(adjacent, F.col("_len")))
        .withColumn("_move", F.when(F.col("_len") > STILL, F.struct(F.col(seq.frame).alias("at"), delta.alias("v"))))
    )
    back = seq.window().rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("_before", F.when(F.col("_move").isNotNull(), F.last("_move", ignorenulls=True).over(back)))
    rows = rows.withColumn("_turn", F.when(F.col("_before").isNotNull(), _turns(F.col("_before.v"), F.col("_move.v"))))
    x, y = F.col("_here.value.x"), F.col("_here.value.y")
    ends = rows.groupBy(*seq.parts).agg(
        F.count("_here").alias("_valid"),
        F.sum("_path").alias("_path"),
        F.sum("_turn").alias("_turns"),
        F.min("_here").alias("_first"),
        F.max("_here").alias("_last"),
        F.min("_move").alias("_first_move"),
        F.max("_move").alias("_last_move"),
        F.min(x).alias("_x0"),
        F.max(x).alias("_x1"),
        F.min(y).alias("_y0"),
        F.max(y).alias("_y1"),
    )
    earlier = seq.between_chunks().rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.withColumn("_left", F.last("_last", ignorenulls=True).over(earlier))
    bridge = _delta(F.col("_first.value"), F.col("_left.value"))
    ends = ends.withColumn("_bridge_len", F.when(F.col("_first").isNotNull() & F.col("_left").isNotNull(), _length(bridge)))
    bridged_path = F.when(F.col("_left.at") == F.col("_first.at") - 1, F.col("_bridge_len"))

    # Up to three moving steps stand for a chunk: the bridge into it, its first, its last.
    none = F.lit(None).cast("struct<x:double,y:double,z:double>")
    row = lambda place, v: F.struct(F.lit(place).alias("place"), v.alias("v"))
    several = F.col("_first_move.at") < F.col("_last_move.at")
    joints = ends.withColumn("_bridge_path", bridged_path).withColumn(
        "_row",
        F.explode(
            F.array(
                row(0, F.when(F.col("_bridge_len") > STILL, bridge).otherwise(none)),
                row(1, F.col("_first_move.v")),
                row(2, F.when(several, F.col("_last_move.v")).otherwise(none)),
            )
        ),
    )
    order = Window.partitionBy(*seq.keys).orderBy("_chunk", "_row.place").rowsBetween(Window.unboundedPreceding, -1)
    here = F.when(F.col("_row.v").isNotNull(), F.struct(F.col("_chunk").alias("chunk"), F.col("_row.place").alias("place"), F.col("_row.v").alias("v")))
    joints = joints.withColumn("_here", here).withColumn("_was", F.last("_here", ignorenulls=True).over(order))
    inside = (F.col("_was.chunk") == F.col("_chunk")) & (F.col("_was.place") == 1) & (F.col("_row.place") == 2)
    joint_turn = F.when(F.col("_here").isNotNull() & F.col("_was").isNotNull() & ~inside, _turns(F.col("_was.v"), F.col("_here.v")))
    once = lambda c: F.when(F.col("_row.place") == 0, c)
    sums = joints.withColumn("_joint_turn", joint_turn).groupBy(*seq.keys).agg(
        F.sum(once(F.col("_valid"))).alias("_n"),
        sum_if_any(F.sum(once(F.col("_path"))), F.sum(once(F.col("_bridge_path")))).alias("path_length"),
        (F.coalesce(F.sum(once(F.col("_turns"))), F.lit(0)) + F.coalesce(F.sum("_joint_turn"), F.lit(0))).alias("_turns"),
        F.min("_first").alias("_first"),
        F.max("_last").alias("_last"),
        ((F.max("_x1") - F.min("_x0")) * (F.max("_y1") - F.min("_y0"))).alias("_area"),
    )
    enough = F.col("_n") >= 2
    displacement = F.when(enough, A.step(F.col("_last.value"), F.col("_first.value")))
    return sums.select(
        *seq.keys,
        "path_length",
        displacement.alias("displacement"),
        F.when(enough & (F.col("path_length") > STILL), displacement / F.col("path_length")).alias("straightness"),
        F.when(enough, F.col("_turns").cast("double")).alias("direction_changes"),
        F.when(enough, F.col("_area")).alias("bbox_area"),
    )


# --- interpolation --------------------------------------------------------------


def _between(prev: Column, nxt: Column, at: Column) -> Column:
    """Linear value at ``at`` between two (at, value) points; the present one at an edge."""
    slope = (nxt["value"] - prev["value"]) / (nxt["at"] - prev["at"])
    return F.coalesce(prev["value"] + slope * (at - prev["at"]), prev["value"], nxt["value"])


def _lerp_point(prev: Column, nxt: Column, at: Column) -> Column:
    axis = lambda i: _between(
        F.struct(prev["at"].alias("at"), prev["value"][i].alias("value")),
        F.struct(nxt["at"].alias("at"), nxt["value"][i].alias("value")),
        at,
    ).alias(i)
    return F.struct(axis("x"), axis("y"), axis("z"))


def _fill_gaps_in_halo(h: DataFrame, seq: Sequences, parts: Sequence[str], max_gap: int) -> DataFrame:
    totals = {"_last_frame": (F.max(seq.frame), F.max)}
    for p in parts:
        totals[f"_{p}_valid"] = (F.count(p), F.sum)
    h = attach_totals(h, seq, totals)
    at = F.col(seq.frame)
    here = lambda p: F.when(F.col(p).isNotNull(), F.struct(at.alias("at"), F.col(p).alias("value")))
    nearest = lambda p, w: F.last(here(p), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    h = h.select(
        "*",
        *[nearest(p, seq.window()).alias(f"_{p}_prev") for p in parts],
        *[nearest(p, seq.backwards()).alias(f"_{p}_next") for p in parts],
    )
    fills = {}
    for p in parts:
        prev, nxt = F.col(f"_{p}_prev"), F.col(f"_{p}_next")
        gap = F.coalesce(nxt["at"], F.col("_last_frame") + 1) - F.coalesce(prev["at"], F.lit(-1)) - 1
        fill = (F.col(f"_{p}_valid") >= 2) & (gap <= max_gap)
        fills[p] = F.when(F.col(p).isNotNull(), F.col(p)).when(fill, _lerp_point(prev, nxt, at))
    return h.withColumns(fills).drop("_last_frame", *[f"_{p}_{s}" for p in parts for s in ("valid", "prev", "next")])


def interpolate_gaps(df: DataFrame, seq: Sequences, parts: Sequence[str], max_gap: int = MAX_GAP) -> DataFrame:
    """Fill runs of at most ``max_gap`` missing frames linearly; an edge run takes the
    nearest value; sequences with fewer than two valid frames stay as they are."""
    h = in_small_tasks(with_halo(df, seq, before=max_gap + 1, after=max_gap + 1), seq.parts, df.count())
    return core_only(_fill_gaps_in_halo(h, seq, parts, max_gap))


def interpolate_interior(df: DataFrame, seq: Sequences, columns: Sequence[str], *, seed_edges: bool = False) -> DataFrame:
    """Fill every gap between the first and last valid frame, whatever its length.

    With ``seed_edges``, a missing first or last frame is first set to the mean of the
    valid ones, so that nothing stays missing.
    """
    chunked = with_chunks(df, seq)
    if seed_edges:
        totals = {"_end": (F.max(seq.frame), F.max)}
        for c in columns:
            totals[f"_{c}_sum"] = (F.sum(c), F.sum)
            totals[f"_{c}_n"] = (F.count(c), F.sum)
        chunked = attach_totals(chunked, seq, totals)
        edge = (F.col(seq.frame) == 0) | (F.col(seq.frame) == F.col("_end"))
        chunked = chunked.withColumns(
            {c: F.when(F.col(c).isNull() & edge, F.col(f"_{c}_sum") / F.col(f"_{c}_n")).otherwise(F.col(c)) for c in columns}
        ).drop(*totals)
    near = attach_neighbours(chunked, seq, {c: (F.col(c), F.col(c).isNotNull()) for c in columns})
    at = F.col(seq.frame)
    fills = {
        c: F.when(F.col(c).isNotNull(), F.col(c)).when(
            F.col(f"{c}_prev").isNotNull() & F.col(f"{c}_after").isNotNull(),
            _between(F.col(f"{c}_prev"), F.col(f"{c}_after"), at),
        )
        for c in columns
    }
    return near.withColumns(fills).select(*df.columns)


# --- resampling -----------------------------------------------------------------


def _with_length(df: DataFrame, seq: Sequences) -> DataFrame:
    return attach_totals(with_chunks(df, seq), seq, {"_length": (F.max(seq.frame) + 1, F.max)})


def resample_linear(df: DataFrame, seq: Sequences, columns: Sequence[str], points: int) -> DataFrame:
    """``points`` equally spaced values per channel, over the valid frames of the
    channel; one valid frame gives a constant, none gives 0.

    Each frame itself yields the targets that fall between it and the next frame.
    """
    spread = in_small_tasks(with_chunks(df, seq), seq.parts, df.count())
    sized = attach_totals(spread, seq, {"_length": (F.max(seq.frame) + 1, F.max)})
    near = attach_neighbours(sized, seq, {c: (F.col(c), F.col(c).isNotNull()) for c in columns})
    f, t, n = F.col(seq.frame), F.col("_length"), F.lit(points).cast("long")
    floor_div = lambda a, b: F.floor(a / b).cast("long")
    first = F.when(t == 1, F.lit(0)).otherwise(floor_div(f * (n - 1) + t - 2, t - 1))
    stop = F.when(t == 1, n).otherwise(F.least(n, floor_div((f + 1) * (n - 1) + t - 2, t - 1)))
    hits = near.withColumn("_i", F.explode(F.filter(F.sequence(first, F.greatest(first, stop - 1)), lambda i: i < stop)))
    shift = F.pmod(F.col("_i") * (t - 1), n - 1) / (n - 1)
    at = f + F.when(t == 1, F.lit(0.0)).otherwise(shift)

    def channel(c: str) -> Column:
        prev, after = F.col(f"{c}_prev"), F.col(f"{c}_after")
        exact = F.when((prev["at"] == f) & (shift == 0), prev["value"])
        moved = F.coalesce(exact, _between(prev, after, at))
        return F.coalesce(F.when(t == n, F.col(c)).otherwise(moved), F.lit(0.0)).alias(c)

    return hits.select(*seq.keys, F.col("_i").alias(seq.frame), *[channel(c) for c in columns])


def output_frames(length: Column, target: int | None = None, least: int | None = MIN_OUTPUT_FRAMES, most: int | None = None) -> Column:
    """Frames wanted for a sequence: the target, else the length kept inside the bounds."""
    if target is not None:
        return F.lit(max(1, int(target))).cast("long")
    frames = length
    if least is not None:
        frames = F.greatest(frames, F.lit(int(least)).cast("long"))
    if most is not None:
        frames = F.least(frames, F.lit(int(most)).cast("long"))
    return F.greatest(F.lit(1).cast("long"), frames)


def resample_nearest(df: DataFrame, seq: Sequences, frames: Callable[[Column], Column]) -> DataFrame:
    """Equally spaced frames, rounding half to even; short sequences repeat frames.

    ``frames`` maps the length of a sequence to the number of frames wanted. Every frame
    finds its own targets, so no grid is joined. ``source_frame`` keeps the origin.
    """
    sized = _with_length(df, seq).withColumn("_wanted", frames(F.col("_length")).cast("long"))
    f, t, n = F.col(seq.frame), F.col("_length"), F.col("_wanted")
    stride = (t - 1) / (n - 1)
    near = F.floor(f / stride).cast("long")
    reach = F.ceil(F.lit(1) / stride).cast("long") + 1
    candidates = F.when((t == 1) | (n == 1), F.sequence(F.lit(0).cast("long"), n - 1)).otherwise(
        F.sequence(F.greatest(F.lit(0).cast("long"), near - reach), F.least(n - 1, near + reach))
    )
    picks = lambda i: F.when((n == 1) | (t == 1), F.lit(0)).when(i == n - 1, t - 1).otherwise(F.bround(i * stride))
    hits = sized.withColumn("_i", F.explode(F.filter(candidates, lambda i: F.when(t == n, i).otherwise(picks(i)) == f)))
    return hits.withColumn("source_frame", f).withColumn(seq.frame, F.col("_i")).drop("_i", "_length", "_wanted", "_chunk")


def sample_frames(df: DataFrame, seq: Sequences, count: int = SAMPLED_FRAMES) -> DataFrame:
    """Up to ``count`` distinct frames at truncated equal spacing, with ``sample_pos``."""
    sized = _with_length(df, seq)
    f, t = F.col(seq.frame), F.col("_length")
    stride = (t - 1) / F.lit(count - 1)
    pick = lambda i: F.when(i == count - 1, t - 1).otherwise(F.floor(i * stride))
    targets = F.sequence(F.lit(0).cast("long"), F.lit(count - 1).cast("long"))
    chosen = (t <= count) | F.exists(targets, lambda i: pick(i) == f)
    kept = sized.filter(chosen).drop("_length", "_chunk")
    inside = Window.partitionBy(*seq.keys).orderBy(seq.frame)
    return kept.withColumn("sample_pos", F.row_number().over(inside) - 1)


# --- activity -------------------------------------------------------------------


def motion_score(
    df: DataFrame,
    seq: Sequences,
    scores: Mapping[str, tuple[str, str]],
    step: Callable[[Column, Column], Column] = A.step,
    rows: int | None = None,
) -> DataFrame:
    """Per frame, the larger step to the frame before or after, 0 unless both are valid.

    ``scores`` maps an output column to its (value, validity flag) columns. ``rows`` is counted when not given.
    """
    w = seq.window()
    h = in_small_tasks(with_halo(df, seq, before=1, after=1), seq.parts, df.count() if rows is None else rows)
    # The step ahead of a frame is the step back of the next one.
    back = {name: F.when(F.col(ok) & F.lag(ok).over(w), step(F.col(v), F.lag(v).over(w))) for name, (v, ok) in scores.items()}
    h = h.withColumns({name: F.coalesce(d, F.lit(0.0)) for name, d in back.items()})
    return core_only(h.withColumns({name: F.greatest(F.col(name), F.coalesce(F.lead(name).over(w), F.lit(0.0))) for name in scores}))


def _trim_bounds(
    first: Column, last: Column, total: Column, margin: int, min_keep: int
) -> tuple[Column, Column]:
    start = F.greatest(F.lit(0), first - margin)
    end = F.least(total, last + margin + 1)
    short = (end - start < min_keep) & (total > end - start)
    lack = F.lit(min_keep) - (end - start)
    left = F.floor(lack / 2).cast("long")
    wide_start = F.greatest(F.lit(0), start - left)
    wide_end = F.least(total, end + lack - left)
    still = wide_end - wide_start < min_keep
    out_start = F.when(~short, start).when(
        still & (wide_start != 0) & (wide_end == total), F.greatest(F.lit(0), total - min_keep)
    ).otherwise(wide_start)
    out_end = F.when(~short, end).when(still & (wide_start == 0), F.least(total, F.lit(min_keep))).otherwise(wide_end)
    return F.when(first.isNull(), F.lit(0)).otherwise(out_start), F.when(first.isNull(), total).otherwise(out_end)


def action_trim(
    df: DataFrame,
    seq: Sequences,
    *,
    left_motion: str = "left_motion",
    right_motion: str = "right_motion",
    pose_motion: str = "pose_motion",
    present: str = "hand_present",
    margin: int = TRIM_MARGIN,
    min_keep: int = TRIM_MIN_KEEP,
) -> DataFrame:
    """Cut each sequence to its active span and renumber the frames.

    A frame is active by hand motion; without any in the sequence, by hand presence;
    without that, by pose motion. Nothing active keeps everything.
    """
    f = F.col(seq.frame)
    moving = (F.col(left_motion) > HAND_ACTIVE) | (F.col(right_motion) > HAND_ACTIVE)
    flags = {"_m": moving, "_h": F.col(present), "_p": F.col(pose_motion) > POSE_ACTIVE}
    totals = {"_total": (F.max(seq.frame) + 1, F.max)}
    for name, on in flags.items():
        totals[f"{name}0"] = (F.min(F.when(on, f)), F.min)
        totals[f"{name}1"] = (F.max(F.when(on, f)), F.max)
    sized = attach_totals(with_chunks(df, seq), seq, totals)
    start, end = _trim_bounds(
        F.coalesce("_m0", "_h0", "_p0"), F.coalesce("_m1", "_h1", "_p1"), F.col("_total"), margin, min_keep
    )
    return (
        sized.withColumn("trim_start", start.cast("long"))
        .withColumn("trim_end", end.cast("long"))
        .filter((f >= F.col("trim_start")) & (f < F.col("trim_end")))
        .withColumn("trimmed_end", F.col("_total") - F.col("trim_end"))
        .withColumn("untrimmed_frame", f)
        .withColumn(seq.frame, f - F.col("trim_start"))
        .drop("_chunk", *totals)
    )


def stabilise_sides(
    df: DataFrame,
    seq: Sequences,
    *,
    left_valid: str,
    right_valid: str,
    moves: Sequence[tuple[str, str]],
    cleared: Column | None = None,
    limit: float = MINORITY_SHARE,
) -> DataFrame:
    """Where one hand side is rare (at most ``limit`` of the other), move its frames
    to the common side unless that side is present, and clear the rare side.

    ``moves`` lists (left column, right column) pairs that travel with the side.
    """
    l, r = F.col(left_valid), F.col(right_valid)
    totals = {"_left": (F.sum(l.cast("long")), F.sum), "_right": (F.sum(r.cast("long")), F.sum)}
    t = attach_totals(with_chunks(df, seq), seq, totals)
    few, many = F.least("_left", "_right"), F.greatest("_left", "_right")
    act = (few > 0) & (few / many <= limit)
    to_left = act & (F.col("_left") >= F.col("_right"))
    to_right = act & (F.col("_left") < F.col("_right"))
    out = {}
    for lc, rc in moves:
        empty = F.lit(None).cast(df.schema[lc].dataType) if cleared is None else cleared
        out[lc] = F.when(to_left & r & ~l, F.col(rc)).when(to_right & l, empty).otherwise(F.col(lc))
        out[rc] = F.when(to_right & l & ~r, F.col(lc)).when(to_left & r, empty).otherwise(F.col(rc))
    out["side_stabilised"] = (to_left & r) | (to_right & l)
    out[left_valid] = F.when(to_left, l | r).when(to_right, F.lit(False)).otherwise(l)
    out[right_valid] = F.when(to_right, l | r).when(to_left, F.lit(False)).otherwise(r)
    return t.withColumns(out).drop("_chunk", *totals)


def interpolate_blocks(df: DataFrame, seq: Sequences, blocks: Mapping[str, str]) -> DataFrame:
    """Interior interpolation of whole landmark rows (arrays); ``blocks`` maps an array
    column to its validity flag. A row without content counts as missing."""
    near = attach_neighbours(
        with_chunks(df, seq), seq, {c: (F.col(c), F.col(ok) & _content(c)) for c, ok in blocks.items()}
    )
    return near.withColumns({c: _filled_block(c, f"{c}_prev", f"{c}_after", F.col(seq.frame)) for c in blocks}).select(*df.columns)


def _content(c: str) -> Column:
    return F.exists(F.col(c), lambda v: F.abs(v) > A.ANGLE_EPS)


def with_sources(plan: DataFrame, seq: Sequences, valid: Sequence[str]) -> DataFrame:
    """Chunked rows, with copies of the rows a chunk needs from others to fill its gaps: for each flag of
    ``valid``, the last row before the chunk and the first row after it that have it. ``_core`` marks the originals.

    The flags decide, so the arrays need not be read for it; a chunk gets two copies per flag at most.
    """
    chunked = with_chunks(plan, seq)
    at = lambda ok: F.when(F.col(ok), F.col(seq.frame))
    ends = chunked.groupBy(*seq.parts).agg(
        *[F.min(at(ok)).alias(f"{ok}_first") for ok in valid], *[F.max(at(ok)).alias(f"{ok}_last") for ok in valid]
    )
    earlier = seq.between_chunks().rowsBetween(Window.unboundedPreceding, -1)
    later = seq.between_chunks(backwards=True).rowsBetween(Window.unboundedPreceding, -1)
    near = [F.last(f"{ok}_last", ignorenulls=True).over(earlier) for ok in valid] + [F.last(f"{ok}_first", ignorenulls=True).over(later) for ok in valid]
    wanted = ends.select(*seq.parts, F.array(*near).alias("_near"))
    wanted = wanted.select(*seq.parts, F.explode(F.array_distinct(F.filter("_near", lambda x: x.isNotNull()))).alias(seq.frame))
    copies = plan.join(wanted, [*seq.keys, seq.frame]).withColumn("_core", F.lit(False))
    return chunked.withColumn("_core", F.lit(True)).unionByName(copies)


def fill_blocks(h: DataFrame, seq: Sequences, blocks: Mapping[str, str]) -> DataFrame:
    """Interior interpolation of landmark rows (arrays) of a table ``with_sources``; ``blocks`` maps an array column to
    the flag of its valid rows. The rows are read once."""
    points = {c: F.when(F.col(ok), F.struct(F.col(seq.frame).alias("at"), F.col(c).alias("value"))) for c, ok in blocks.items()}
    back = seq.window().rowsBetween(Window.unboundedPreceding, 0)
    ahead = seq.backwards().rowsBetween(Window.unboundedPreceding, -1)
    near = h.select(
        "*",
        *[F.last(x, ignorenulls=True).over(back).alias(f"_{c}_prev") for c, x in points.items()],
        *[F.last(x, ignorenulls=True).over(ahead).alias(f"_{c}_after") for c, x in points.items()],
    )
    return core_only(near.withColumns({c: _filled_block(c, f"_{c}_prev", f"_{c}_after", F.col(seq.frame)) for c in blocks})).drop(
        *[f"_{c}_{s}" for c in blocks for s in ("prev", "after")]
    )


def _filled_block(c: str, before: str, behind: str, at: Column) -> Column:
    prev, after = F.col(before), F.col(behind)
    mixed = A.let(
        lambda r: F.zip_with(r["a"], r["b"], lambda a, b: a + (b - a) * r["share"]),
        a=prev["value"], b=after["value"], share=(at - prev["at"]) / (after["at"] - prev["at"]),
    )
    return F.when(prev.isNotNull() & after.isNotNull() & (prev["at"] < at), mixed).otherwise(F.col(c))


# What ``preprocess`` adds to each frame about its whole sequence.
SEQUENCE_COUNTS = (
    "source_total_frames", "trim_start", "trimmed_end", "frames_before_resample", "max_hand_motion", "max_pose_motion",
    "left_source_frames", "right_source_frames",
)


def _frame_plan(f: DataFrame, seq: Sequences, target: int | None, stage: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Which stored frame each output frame shows: a table without landmark arrays.

    Only the arrays of the hands and the upper body are read, and only to score motion. The scores are
    materialised: each total of a sequence reads them twice, so their plan would double with every one.
    """
    upper, rows = POSE_STRIDE * A.SHOULDERS[0], f.count()
    narrow = f.select(
        *seq.keys, seq.frame, "v_pose", "v_left", "v_right", "left_norm", "right_norm", *[_content(h).alias(f"_has_{h}") for h in HANDS],
        F.slice("pose", upper + 1, UPPER_BODY * POSE_STRIDE).alias("_upper"),
    )
    hands = motion_score(
        narrow, seq, {"left_motion": ("left_norm", "v_left"), "right_motion": ("right_norm", "v_right")},
        lambda a, b: A.flat_step(a, b, HAND_LANDMARKS), rows,
    ).drop("left_norm", "right_norm")
    upper_step = lambda a, b: A.flat_step(a, b, UPPER_BODY, POSE_STRIDE)
    scored = motion_score(hands, seq, {"pose_motion": ("_upper", "v_pose")}, upper_step, rows).drop("_upper")
    scored = stage(scored.withColumn("hand_present", F.col("v_left") | F.col("v_right")))
    moving = {
        "max_hand_motion": (F.max(F.greatest("left_motion", "right_motion")), F.max),
        "max_pose_motion": (F.max("pose_motion"), F.max),
        "source_total_frames": (F.count(F.lit(1)), F.sum),
    }
    scored = attach_totals(with_chunks(scored, seq), seq, moving).drop("_chunk")
    trimmed = action_trim(scored, seq).drop("left_motion", "right_motion", "pose_motion", "hand_present")
    length = F.col("source_total_frames") - F.col("trimmed_end") - F.col("trim_start")
    trimmed = stage(trimmed.withColumn("frames_before_resample", length))
    return resample_nearest(trimmed, seq, lambda n: output_frames(n, target)).drop("source_frame")


def preprocess(
    frames: DataFrame,
    seq: Sequences,
    *,
    target: int | None = None,
    stage: Callable[[DataFrame], DataFrame] = cut_lineage,
) -> DataFrame:
    """Trim, resample, stabilise sides, interpolate and anchor a stored frame table.

    ``frames`` has the declared row layout: arrays pose, hands, face, mouth and flags v_pose,
    v_left, v_right, v_face. The plan of output frames, sides and the frames that fill gaps is made
    without the arrays. They meet it in one join on the frame and are never materialised, so a reader who
    needs only some columns moves only those.
    ``stage`` materialises what is read twice. Every frame also carries ``untrimmed_frame``,
    ``side_stabilised`` and the counts of its sequence (``SEQUENCE_COUNTS``).
    """
    numbers = {c: F.col(c).cast("array<double>") for c in ("pose", "hands", "face", "mouth")}
    f = frames.withColumns(numbers)
    f = f.withColumns({name: flat_hand(F.col("hands"), name) for name in HANDS}).drop("hands")
    plan = with_chunks(_frame_plan(f, seq, target, stage), seq)
    sides = {
        "left_source_frames": (F.sum(F.col("v_left").cast("long")), F.sum),
        "right_source_frames": (F.sum(F.col("v_right").cast("long")), F.sum),
    }
    plan = attach_totals(plan, seq, sides).drop("_chunk").withColumns({"_from_left": F.lit("left"), "_from_right": F.lit("right")})
    sided = stabilise_sides(plan, seq, left_valid="v_left", right_valid="v_right", moves=[("_from_left", "_from_right")])
    origin = lambda side, left, right, none: F.when(F.col(f"_from_{side}") == "left", left).when(F.col(f"_from_{side}") == "right", right).otherwise(none)
    blocks = {f"{side}_{kind}": (side, kind) for side in ("left", "right") for kind in ("norm", "world")}
    usable = {
        f"_ok_{c}": F.col(f"v_{side}") & origin(side, F.col(f"_has_left_{kind}"), F.col(f"_has_right_{kind}"), F.lit(False))
        for c, (side, kind) in blocks.items()
    }
    sided = stage(sided.withColumns(usable).drop(*[f"_has_{h}" for h in HANDS]))
    carried = [c for c in frames.columns if c not in (*seq.keys, seq.frame, "hands", "v_pose", "v_left", "v_right")]
    stored = f.select(*seq.keys, F.col(seq.frame).alias("untrimmed_frame"), *carried, *HANDS)
    wide = with_sources(sided, seq, list(usable)).join(stored, [*seq.keys, "untrimmed_frame"])
    none = F.array_repeat(F.lit(0.0), HAND_LANDMARKS * 3)
    wide = wide.withColumns({c: origin(side, F.col(f"left_{kind}"), F.col(f"right_{kind}"), none) for c, (side, kind) in blocks.items()})
    filled = fill_blocks(wide.drop("_from_left", "_from_right"), seq, {c: f"_ok_{c}" for c in blocks}).drop(*usable)
    pose = A.anchor_flat_pose(F.col("pose"), POSE_BLOCKS, POSE_BLOCKS[1] - POSE_BLOCKS[0], POSE_STRIDE)
    mouth = A.anchor_flat_mouth(F.col("mouth"), MOUTH_LANDMARKS * 3, *MOUTH_CORNERS)
    anchored = [A.anchor_flat_hand(F.col(h)) for h in HANDS]
    return filled.withColumns({"pose": pose, "mouth": mouth, "hands": F.concat(*anchored)}).drop(*HANDS)


def preprocess_counts(processed: DataFrame, seq: Sequences) -> DataFrame:
    """Counts before and after, one row per sequence of ``preprocess``: frames, trimmed ends, frames with
    each hand before and after sides were stabilised, stabilised frames, valid shares."""
    share = lambda flag: F.avg(F.col(flag).cast("double"))
    return processed.groupBy(*seq.keys).agg(
        *[F.max(c).alias(c) for c in SEQUENCE_COUNTS],
        F.count(F.lit(1)).alias("frames_after_resample"),
        F.sum(F.col("v_left").cast("long")).alias("left_result_frames"),
        F.sum(F.col("v_right").cast("long")).alias("right_result_frames"),
        F.sum(F.col("side_stabilised").cast("long")).alias("hand_side_stabilised_frames"),
        share("v_pose").alias("valid_pose_ratio"),
        share("v_left").alias("valid_left_hand_ratio"),
        share("v_right").alias("valid_right_hand_ratio"),
        share("v_face").alias("valid_face_ratio"),
    )


# --- body anchor and the full feature row ----------------------------------------


def body_scale(
    df: DataFrame,
    keys: Sequence[str],
    *,
    shoulder_distance: str,
    centers: Sequence[str],
) -> DataFrame:
    """Per sequence: median shoulder distance; without one, the larger xy range of the
    available centers (more than two of them)."""
    keys = list(keys)
    wide = df.select(*keys, F.when(F.col(shoulder_distance) > 1e-6, F.col(shoulder_distance)).alias("_d"))
    median = exact_quantiles(wide, keys, "_d", {"_median": 0.5})
    spots = df.select(*keys, F.explode(F.array(*[F.col(c) for c in centers])).alias("_c")).filter("_c is not null")
    spans = spots.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("_n"),
        F.greatest(F.max("_c.x") - F.min("_c.x"), F.max("_c.y") - F.min("_c.y")).alias("_range"),
    )
    scale = F.coalesce(
        F.when(F.col("_median") > 1e-6, F.col("_median")),
        F.when((F.col("_n") > 2) & (F.col("_range") > 1e-6), F.col("_range")),
    )
    return spans.join(median, keys, "full").select(*keys, scale.alias("scale"))


def anchor_to_body(point: Column, body: Column, scale: Column) -> Column:
    """Point relative to the body center where known, in units of the scale where known."""
    unit = F.when(scale > 1e-6, scale).otherwise(F.lit(1.0))
    axis = lambda i: ((point[i] - F.coalesce(body[i], F.lit(0.0))) / unit).alias(i)
    return F.when(point.isNotNull(), F.struct(axis("x"), axis("y"), axis("z")))


PARTS = ("left", "right", "pose", "face")


def normalised_frames(frames: DataFrame, seq: Sequences, max_gap: int = MAX_GAP) -> DataFrame:
    """Gap-filled, body-anchored centers per frame, with the valid flags of the raw ones.

    The filled centers are written once: the body scale and the result both read them.
    """
    raw = frames.withColumns({f"has_{p}": F.col(p).isNotNull() for p in PARTS}).withColumn("_body_raw", F.col("pose"))
    filled = cut_lineage(interpolate_gaps(raw, seq, PARTS, max_gap))
    scales = body_scale(filled, seq.keys, shoulder_distance="shoulder_distance", centers=["_body_raw", "left", "right"])
    joined = salted_join(filled, scales, seq.keys, salt_on=[seq.frame], how="left")
    body = F.col("pose")
    moved = {p: anchor_to_body(F.col(p), body, F.col("scale")) for p in ("left", "right", "face", "pose")}
    return joined.withColumns(moved).drop("_body_raw")


def sequence_features(
    normalised: DataFrame,
    seq: Sequences,
    *,
    fps: Column | None = None,
    min_valid: int = MIN_VALID_HAND_FRAMES,
) -> DataFrame:
    """The per-sequence motion row from normalised frames.

    Besides the centers (left, right, pose, face) the table has has_<part>, the share of
    invalid points per part in <part>_invalid, and scale.
    """
    keys = list(seq.keys)
    rate = F.lit(1.0) if fps is None else F.when(fps > 0, fps).otherwise(F.lit(1.0))
    w = seq.window()
    h = in_small_tasks(with_halo(normalised, seq, before=2), seq.parts, normalised.count())
    steps = [A.step(F.col(p), F.lag(p).over(w)) for p in ("left", "right")]
    h = h.withColumn("_motion", sum_if_any(*steps)).withColumn("_velocity", F.col("_motion") * rate)
    h = h.withColumn("_acceleration", F.col("_velocity") - F.lag("_velocity").over(w))
    core = core_only(h)
    to = lambda a, b: A.step(F.col(a), F.col(b))
    pairs = {"hand_face": ("face",), "hand_body": ("pose",)}
    core = core.withColumns(
        {
            **{f"_{h_}_{name}": to(h_, other) for name, (other,) in pairs.items() for h_ in ("left", "right")},
            "_lr": to("left", "right"),
        }
    )
    share = lambda p: (1 - F.avg(F.col(f"has_{p}").cast("double"))).alias(f"{p}_frame_missing_ratio")
    valid = lambda p: F.sum(F.col(f"has_{p}").cast("long")).alias(f"{p}_valid_frames")
    pooled = []
    for name in pairs:
        a, b = F.col(f"_left_{name}"), F.col(f"_right_{name}")
        pooled += [
            *[F.count(x).alias(f"_{name}_n{i}") for i, x in enumerate((a, b))],
            *[F.avg(x).alias(f"_{name}_m{i}") for i, x in enumerate((a, b))],
            *[F.var_pop(x).alias(f"_{name}_v{i}") for i, x in enumerate((a, b))],
        ]
    base = core.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("num_frames"),
        F.first("scale").alias("normalization_scale"),
        *[valid(p) for p in ("left", "right")],
        *[share(p) for p in PARTS],
        *[F.avg(f"{p}_invalid").alias(f"{p}_point_missing_ratio") for p in PARTS],
        F.sum("_motion").alias("total_motion"),
        F.avg("_motion").alias("mean_motion"),
        F.max("_motion").alias("max_motion"),
        F.var_pop("_motion").alias("motion_variance"),
        F.avg("_velocity").alias("mean_velocity"),
        F.max("_velocity").alias("max_velocity"),
        F.stddev_pop("_velocity").alias("velocity_std"),
        F.avg(F.abs("_acceleration")).alias("mean_acceleration"),
        F.max(F.abs("_acceleration")).alias("max_acceleration"),
        F.stddev_pop("_acceleration").alias("acceleration_std"),
        F.avg("_lr").alias("left_right_hand_dist_mean"),
        F.stddev_pop("_lr").alias("left_right_hand_dist_std"),
        *pooled,
    )
    spread = {}
    for name in pairs:
        # Two sides are pooled by their moments; sums of squares would lose the digits of far values.
        part = lambda x: [F.coalesce(F.col(f"_{name}_{x}{i}"), F.lit(0.0)) for i in (0, 1)]
        (n0, n1), (m0, m1), (v0, v1) = part("n"), part("m"), part("v")
        n = F.nullif(n0 + n1, F.lit(0.0))
        spread[f"{name}_dist_mean"] = (n0 * m0 + n1 * m1) / n
        spread[f"{name}_dist_std"] = F.sqrt((n0 * v0 + n1 * v1) / n + (n0 / n) * (n1 / n) * (m0 - m1) * (m0 - m1))
    hands = normalised.select(
        *keys,
        seq.frame,
        F.explode(F.array(*[F.struct(F.lit(p).alias("hand"), F.col(p).alias("point")) for p in ("left", "right")])).alias("_h"),
    ).select(*keys, seq.frame, "_h.hand", "_h.point")
    per_hand = trajectory_stats(hands, Sequences((*seq.keys, "hand"), seq.frame, seq.chunk_rows), "point")
    both = per_hand.groupBy(*keys).agg(
        F.sum("path_length").alias("trajectory_length"),
        F.avg("displacement").alias("displacement"),
        F.avg("straightness").alias("straightness_ratio"),
        F.sum("direction_changes").alias("direction_change_count"),
        F.avg("bbox_area").alias("trajectory_bbox_area"),
    )
    enough = (F.col("left_valid_frames") >= min_valid) | (F.col("right_valid_frames") >= min_valid)
    mean2 = lambda what: mean_if_any(F.col(f"left_{what}"), F.col(f"right_{what}"))
    return (
        base.withColumns(
            {
                **spread,
                "usable_motion": enough,
                "hand_frame_missing_ratio": mean2("frame_missing_ratio"),
                "hand_point_missing_ratio": mean2("point_missing_ratio"),
                "has_left_hand": F.col("left_valid_frames").isNotNull(),
                "has_right_hand": F.col("right_valid_frames").isNotNull(),
            }
        )
        .drop(*[f"_{name}_{x}{i}" for name in pairs for x in "nmv" for i in (0, 1)])
        .join(both, keys, "left")
    )


def hand_trajectories(normalised: DataFrame, seq: Sequences, points: int = 30) -> DataFrame:
    """Left and right center resampled to ``points`` frames, as rows (sequence, frame, six
    channels), ready for time warping."""
    axes = {f"{p[0]}{i}": F.col(f"{p}.{i}") for p in ("left", "right") for i in "xyz"}
    return resample_linear(normalised.select(*seq.keys, seq.frame, *[c.alias(n) for n, c in axes.items()]), seq, list(axes), points)


# --- frame detections ------------------------------------------------------------


def assign_hand_slots(df: DataFrame, frame_keys: Sequence[str], *, order: str, side: str, payload: str) -> DataFrame:
    """Left and right slot of a frame from its detections, in detection order.

    A detection takes the slot of its side when free; without a side, or when the slot is
    taken, it takes the first free slot. The first two detections therefore always fill
    both slots, and later ones find none.
    """
    w = Window.partitionBy(*frame_keys).orderBy(order)
    first_two = df.withColumn("_nth", F.row_number().over(w)).filter("_nth <= 2")
    pick = lambda n, c: F.max(F.when(F.col("_nth") == n, F.col(c)))
    two = first_two.groupBy(*frame_keys).agg(
        pick(1, side).alias("_s1"), pick(2, side).alias("_s2"), pick(1, payload).alias("_p1"), pick(2, payload).alias("_p2")
    )
    one_right = F.col("_s1").eqNullSafe("Right")
    return two.select(
        *frame_keys,
        F.when(one_right, F.col("_p2")).otherwise(F.col("_p1")).alias("left"),
        F.when(one_right, F.col("_p1")).otherwise(F.col("_p2")).alias("right"),
    )
