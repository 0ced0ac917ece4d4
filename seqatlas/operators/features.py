"""Frame to sequence to label to corpus: feature rows and their summaries."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from seqatlas.distribution import Sequences, exact_quantiles
from seqatlas.functions import arrays as A
from seqatlas.functions.numbers import finite
from seqatlas.operators.sequences import valid_step_summary

# Thresholds of the rules below.
USABLE_BELOW = 0.3
USABLE_STEPS = (0.1, 0.3, 0.5, 0.7)
SHOULDER_BAND = 0.12
ACTIVE_VALID, ACTIVE_MOTION = 0.25, 0.002
LOCATIONS = ("head", "shoulder", "chest", "waist", "below_waist")
DIRECTIONS = ("right", "left", "down", "up", "forward", "backward")

# Names of the hand-shape features: per finger joint angles and tip ratio, spreads, palm.
JOINTS = {f: (2 if f == "thumb" else 3) for f in A.FINGERS}
SPREADS = {
    "thumb_index": ("thumb", "index"),
    "index_middle": ("index", "middle"),
    "middle_ring": ("middle", "ring"),
    "ring_pinky": ("ring", "pinky"),
    "index_pinky": ("index", "pinky"),
}
# Names of the handshape features, one for each finger and joint.
HANDSHAPE_FEATURES = (
    "valid_frame_ratio",
    "motion_magnitude",
    *(
        name
        for f, joints in JOINTS.items()
        for name in (
            *(f"{f}_angle_{i}_{s}" for i in range(1, joints + 1) for s in ("mean", "std")),
            f"{f}_tip_wrist_ratio_mean",
        )
    ),
    *(f"{p}_distance_ratio_{s}" for p in SPREADS for s in ("mean", "std")),
    "palm_width_ratio_mean",
    "openness_mean",
    "curvature_proxy_mean",
)
# Names of the location and orientation features, one for each place and axis.
LOCATION_FEATURES = tuple(f"{name}_ratio" for name in LOCATIONS)
ORIENTATION_FEATURES = tuple(f"{v}_{axis}_mean" for v in ("finger_dir", "palm_normal") for axis in "xyz")
# Names of the motion features.
MOTION_FEATURES = (
    "total_motion",
    "mean_motion",
    "max_motion",
    "motion_variance",
    "mean_velocity",
    "max_velocity",
    "velocity_std",
    "mean_acceleration",
    "max_acceleration",
    "acceleration_std",
    "trajectory_length",
    "displacement",
    "straightness_ratio",
    "direction_change_count",
    "trajectory_bbox_area",
    "hand_face_dist_mean",
    "hand_face_dist_std",
    "hand_body_dist_mean",
    "hand_body_dist_std",
    "left_right_hand_dist_mean",
    "left_right_hand_dist_std",
)
STAGE_FEATURES = {
    "handshape_features": HANDSHAPE_FEATURES,
    "location_video": LOCATION_FEATURES,
    "orientation_video": ORIENTATION_FEATURES,
    "motion_features_per_video": MOTION_FEATURES,
}


# --- detection quality ------------------------------------------------------------


def hand_missing_rates(df: DataFrame, keys: Sequence[str], left_missing: Column, right_missing: Column) -> DataFrame:
    share = lambda c: F.avg(c.cast("double"))
    return df.groupBy(*keys).agg(
        share(left_missing).alias("left_hand_missing_rate"),
        share(right_missing).alias("right_hand_missing_rate"),
        share(left_missing & right_missing).alias("both_hand_missing_rate"),
        (1 - share(left_missing & right_missing)).alias("hand_detection_rate"),
    )


def keypoint_quality(
    df: DataFrame,
    keys: Sequence[str],
    *,
    missing: Mapping[str, Column],
    left_missing: Column,
    right_missing: Column,
    limit: float = USABLE_BELOW,
) -> DataFrame:
    """Per sequence: frames, mean share of missing points per part (``missing`` holds the
    per-frame shares of pose, hand and face), hand rates, and the usable flag."""
    share = lambda c: F.avg(c.cast("double"))
    both = left_missing & right_missing
    out = df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("frames"),
        *[F.avg(c).alias(f"{part}_missing") for part, c in missing.items()],
        *[(1 - F.avg(c)).alias(f"{part}_detection") for part, c in missing.items() if part != "hand"],
        share(left_missing).alias("left_hand_missing_rate"),
        share(right_missing).alias("right_hand_missing_rate"),
        share(both).alias("both_hand_missing_rate"),
        (1 - share(both)).alias("hand_detection_rate"),
    )
    return out.withColumn("usable", F.col("hand_missing") < limit)


def corpus_means(df: DataFrame, columns: Mapping[str, str], keys: Sequence[str] = ("dataset",)) -> DataFrame:
    """Mean of each column per corpus under a new name; flags count as 0 and 1."""
    return df.groupBy(*keys).agg(*[F.avg(F.col(c).cast("double")).alias(name) for name, c in columns.items()])


def usable_by_threshold(df: DataFrame, missing: str, thresholds: Sequence[float] = USABLE_STEPS) -> DataFrame:
    """Share of sequences below each threshold, from one pass."""
    one = df.groupBy("dataset").agg(
        *[F.avg((F.col(missing) < t).cast("double")).alias(str(i)) for i, t in enumerate(thresholds)]
    )
    rows = F.array(*[F.struct(F.lit(float(t)).alias("threshold"), F.col(str(i)).alias("usable_ratio")) for i, t in enumerate(thresholds)])
    return one.select("dataset", F.explode(rows).alias("_r")).select("dataset", "_r.*")


def frame_quality_rollup(df: DataFrame, keys: Sequence[str], *, checked: str = "checked", detected: str = "hand_detected") -> DataFrame:
    """Per sequence means and population deviations of the frame metrics over sampled
    frames; occlusion is one minus detected over checked frames; nothing measured is 0."""
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    looked = F.count(F.when(F.col(checked), 1))
    seen = F.count(F.when(F.col(checked) & F.col(detected), 1))
    means = {
        "brightness_mean": "brightness_mean", "brightness_std": "brightness_std", "blur_mean": "blur",
        "edge_density_mean": "edge_density", "motion_mean": "motion", "hand_visibility_ratio": "hand_visibility",
        "person_area_ratio_mean": "person_area", "frontality_score": "frontality", "angle_variance": "angle_variance",
        "shoulder_angle_mean": "shoulder_angle",
    }
    stds = {"blur_std": "blur", "edge_density_std": "edge_density", "motion_std": "motion", "person_area_ratio_std": "person_area"}
    have = set(df.columns)
    return df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("processed_frames"),
        looked.alias("checked_frames"),
        seen.alias("hand_detected_frames"),
        *[zero(F.avg(c)).alias(n) for n, c in means.items() if c in have],
        *[zero(F.stddev_pop(c)).alias(n) for n, c in stds.items() if c in have],
        F.when(looked > 0, 1 - seen / looked).otherwise(F.lit(0.0)).alias("occlusion_rate"),
    )


# --- corpus comparison --------------------------------------------------------------


def corpus_statistics(df: DataFrame, metrics: Sequence[str], keys: Sequence[str] = ("dataset",)) -> DataFrame:
    """Long table (corpus, metric): n, mean and sample deviation (missing for one row)."""
    aggs = []
    for i, m in enumerate(metrics):
        x = finite(F.col(m))
        aggs += [F.count(x).alias(f"_n{i}"), F.avg(x).alias(f"_m{i}"), F.stddev_samp(x).alias(f"_s{i}")]
    rows = F.array(
        *[
            F.struct(F.lit(m).alias("metric"), F.col(f"_n{i}").alias("n"), F.col(f"_m{i}").alias("mean"), F.col(f"_s{i}").alias("std"))
            for i, m in enumerate(metrics)
        ]
    )
    return df.groupBy(*keys).agg(*aggs).select(*keys, F.explode(rows).alias("_r")).select(*keys, "_r.*")


def side_by_side(long: DataFrame, datasets: Sequence[str], values: Sequence[str]) -> DataFrame:
    """One row per metric, one column per value and corpus."""
    pick = lambda d, v: F.max(F.when(F.col("dataset") == d, F.col(v))).alias(f"{v}_{d}")
    return long.groupBy("metric").agg(*[pick(d, v) for d in datasets for v in values])


def metric_winners(wide: DataFrame, a: str, b: str, lower_is_better: Sequence[str]) -> DataFrame:
    """Better corpus per metric by its direction; ties go to the second one."""
    x, y = F.col(f"mean_{a}"), F.col(f"mean_{b}")
    low = F.col("metric").isin(*lower_is_better)
    first = F.when(low, x < y).otherwise(x > y)
    return wide.withColumn("winner", F.when(first, F.lit(a)).otherwise(F.lit(b)))


def winner_score(winners: DataFrame) -> DataFrame:
    return winners.groupBy("winner").agg(F.count(F.lit(1)).alias("wins"))


# --- hand shape -----------------------------------------------------------------------


def _at(flat: Column, k: int) -> list[Column]:
    """Landmark k of a flat row, as three double columns (stays in generated code)."""
    return [F.get(flat, F.lit(3 * k + i)).cast("double") for i in range(3)]


def _minus(a: list[Column], b: list[Column]) -> list[Column]:
    return [x - y for x, y in zip(a, b)]


def _dot(a: list[Column], b: list[Column]) -> Column:
    return a[0] * b[0] + a[1] * b[1] + a[2] * b[2]


def _dist(a: list[Column], b: list[Column]) -> Column:
    d = _minus(a, b)
    return F.sqrt(_dot(d, d))


def _bend(a: list[Column], b: list[Column], c: list[Column]) -> Column:
    ba, bc = _minus(a, b), _minus(c, b)
    cosine = _dot(ba, bc) / (F.sqrt(_dot(ba, ba)) * F.sqrt(_dot(bc, bc)) + A.ANGLE_EPS)
    return F.degrees(F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), cosine))))


def handshape_frame(flat: Column) -> dict[str, Column]:
    """Per-frame joint angles and size-free distances of a flat 21x3 hand."""
    p = lambda k: _at(flat, k)
    wrist = p(A.WRIST)
    scale = _dist(wrist, p(A.FINGERS["middle"][0])) + A.ANGLE_EPS
    out = {}
    for finger, ids in A.FINGERS.items():
        chain = [p(k) for k in ids] if finger == "thumb" else [wrist, *[p(k) for k in ids]]
        for i in range(JOINTS[finger]):
            out[f"{finger}_angle_{i + 1}"] = _bend(*chain[i : i + 3])
        out[f"{finger}_tip_wrist_ratio"] = _dist(p(ids[-1]), wrist) / scale
    tip = {f: p(ids[-1]) for f, ids in A.FINGERS.items()}
    for name, (a, b) in SPREADS.items():
        out[f"{name}_distance_ratio"] = _dist(tip[a], tip[b]) / scale
    out["palm_width_ratio"] = _dist(p(A.FINGERS["index"][0]), p(A.FINGERS["pinky"][0])) / scale
    return out


def flat_center(flat: Column, landmarks: int = 21) -> Column:
    """Mean of all landmarks of a flat row as a point."""
    mean = lambda i: sum((F.get(flat, F.lit(3 * k + i)).cast("double") for k in range(1, landmarks)), F.get(flat, F.lit(i)).cast("double")) / landmarks
    return F.struct(mean(0).alias("x"), mean(1).alias("y"), mean(2).alias("z"))


def handshape_features(df: DataFrame, seq: Sequences, hand: str) -> DataFrame:
    """48 features per sequence (the sequence keys include the hand side) from flat hands.

    Frames without a valid hand count only in the valid share. Sequences without any
    valid frame give no row.
    """
    keys = list(seq.keys)
    valid = A.valid_row(F.col(hand))
    rows = df.withColumn("_ok", F.coalesce(valid, F.lit(False)))
    per_frame = handshape_frame(F.col(hand))
    measured = rows.filter("_ok").select(*keys, *[c.alias(n) for n, c in per_frame.items()])
    tips = [f"{f}_tip_wrist_ratio" for f in A.FINGERS]
    aggs = []
    for name in per_frame:
        if "angle" in name or "distance_ratio" in name:
            aggs += [F.avg(name).alias(f"{name}_mean"), F.stddev_pop(name).alias(f"{name}_std")]
        else:
            aggs.append(F.avg(name).alias(f"{name}_mean"))
    shape = measured.groupBy(*keys).agg(*aggs)
    mean_of = lambda names: sum((F.col(n) for n in names[1:]), F.col(names[0])) / len(names)
    shape = shape.withColumn("openness_mean", mean_of([f"{t}_mean" for t in tips])).withColumn(
        "curvature_proxy_mean", mean_of([f"{f}_angle_2_mean" for f in A.FINGERS if f != "thumb"])
    )
    moving = rows.select(*keys, seq.frame, F.when(F.col("_ok"), flat_center(F.col(hand))).alias("_center"))
    motion = valid_step_summary(moving, seq, "_center").select(*keys, "valid_frame_ratio", "motion_magnitude")
    return shape.join(motion, keys).select(*keys, *HANDSHAPE_FEATURES)


# --- location, orientation, activity ---------------------------------------------------


def frame_location(y: Column, nose: Column, shoulder: Column, hip: Column) -> Column:
    """Body zone of a hand by height; y grows downwards."""
    return (
        F.when(y <= (nose + shoulder) / 2, LOCATIONS[0])
        .when(y <= shoulder + SHOULDER_BAND * F.abs(hip - shoulder), LOCATIONS[1])
        .when(y <= (shoulder + hip) / 2, LOCATIONS[2])
        .when(y <= hip, LOCATIONS[3])
        .when(y.isNotNull(), LOCATIONS[4])
    )


def _most_common(names: Sequence[str], prefix: str) -> Column:
    """Name with the largest count column; the earlier name wins ties."""
    best = F.array_max(F.array(*[F.struct(F.col(f"{prefix}{n}").alias("n"), F.lit(-i).alias("place"), F.lit(n).alias("name")) for i, n in enumerate(names)]))
    return best["name"]


def location_summary(df: DataFrame, keys: Sequence[str], zone: str) -> DataFrame:
    """Share of located frames per zone, the leading zone and the share of located frames;
    ``zone`` is NULL for frames that cannot be located."""
    counts = df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("_rows"),
        F.count(zone).alias("_n"),
        *[F.count(F.when(F.col(zone) == z, 1)).alias(f"_c_{z}") for z in LOCATIONS],
    )
    return counts.filter("_n > 0").select(
        *keys,
        (F.col("_n") / F.col("_rows")).alias("valid_frame_ratio"),
        _most_common(LOCATIONS, "_c_").alias("dominant_location"),
        *[(F.col(f"_c_{z}") / F.col("_n")).alias(f"{z}_ratio") for z in LOCATIONS],
    )


def _unit(v: list[Column]) -> list[Column]:
    length = F.sqrt(_dot(v, v)) + A.ANGLE_EPS
    return [x / length for x in v]


def orientation_frame(flat: Column) -> tuple[list[Column], list[Column]]:
    """Finger direction and palm normal of a flat 21x3 hand, as unit vectors."""
    wrist = _at(flat, A.WRIST)
    a = _minus(_at(flat, A.FINGERS["index"][0]), wrist)
    b = _minus(_at(flat, A.FINGERS["pinky"][0]), wrist)
    normal = [a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0]]
    return _unit(_minus(_at(flat, A.FINGERS["middle"][-1]), wrist)), _unit(normal)


def orientation_summary(df: DataFrame, keys: Sequence[str], hand: str) -> DataFrame:
    """Per sequence: leading direction of fingers and palm, and mean vector components."""
    finger, palm = orientation_frame(F.col(hand))
    ok = F.coalesce(A.valid_row(F.col(hand)), F.lit(False))
    vectors = {f"{name}_{axis}": v[i] for name, v in (("finger_dir", finger), ("palm_normal", palm)) for i, axis in enumerate("xyz")}
    rows = df.select(*keys, ok.alias("_ok"), *[F.when(ok, c).alias(n) for n, c in vectors.items()])
    label = lambda name: A.axis_label(F.array(*[F.col(f"{name}_{axis}") for axis in "xyz"]))
    rows = rows.withColumn("_f", F.when(F.col("_ok"), label("finger_dir"))).withColumn("_p", F.when(F.col("_ok"), label("palm_normal")))
    count = lambda c, d: F.count(F.when(F.col(c) == d, 1)).alias(f"{c}_{d}")
    sums = rows.groupBy(*keys).agg(
        F.avg(F.col("_ok").cast("double")).alias("valid_frame_ratio"),
        *[F.avg(n).alias(f"{n}_mean") for n in vectors],
        *[count(c, d) for c in ("_f", "_p") for d in DIRECTIONS],
    )
    return sums.filter("valid_frame_ratio > 0").select(
        *keys,
        "valid_frame_ratio",
        _most_common(DIRECTIONS, "_f_").alias("dominant_finger_direction"),
        _most_common(DIRECTIONS, "_p_").alias("dominant_palm_orientation"),
        *ORIENTATION_FEATURES,
    )


def activity_type(left_valid: Column, left_motion: Column, right_valid: Column, right_motion: Column) -> Column:
    left = (left_valid >= ACTIVE_VALID) & (left_motion >= ACTIVE_MOTION)
    right = (right_valid >= ACTIVE_VALID) & (right_motion >= ACTIVE_MOTION)
    return (
        F.when(left & right, "two_hand").when(left, "left_one_hand").when(right, "right_one_hand").otherwise("low_hand_activity")
    )


def hand_activity(per_hand: DataFrame, keys: Sequence[str], hand: str = "hand") -> DataFrame:
    """Left and right step summaries in one row per sequence, with the activity type."""
    measures = {"valid_frame_ratio": "valid_ratio", "motion_magnitude": "motion_magnitude",
                "trajectory_length": "trajectory_length", "motion_std": "motion_std"}
    pick = lambda side, m: F.coalesce(F.max(F.when(F.col(hand) == side, F.col(m))), F.lit(0.0))
    wide = per_hand.groupBy(*keys).agg(
        *[pick(side, m).alias(f"{side}_{short}") for side in ("left", "right") for m, short in measures.items()]
    )
    kind = activity_type(*[F.col(f"{s}_{m}") for s in ("left", "right") for m in ("valid_ratio", "motion_magnitude")])
    return wide.withColumn("activity_type", kind)


# --- collapsing ----------------------------------------------------------------------


def mean_by(df: DataFrame, keys: Sequence[str], features: Sequence[str]) -> DataFrame:
    """One row per key with the mean of each feature over its finite values."""
    return df.groupBy(*keys).agg(*[F.avg(finite(F.col(f))).alias(f) for f in features])


def label_summary(df: DataFrame, features: Sequence[str], keys: Sequence[str] = ("dataset", "gloss")) -> DataFrame:
    """Samples, means and population deviations (missing as 0) per label."""
    return df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("sample_count"),
        *[F.avg(finite(F.col(f))).alias(f"{f}__mean") for f in features],
        *[F.coalesce(F.stddev_pop(finite(F.col(f))), F.lit(0.0)).alias(f"{f}__std") for f in features],
    )


def sequence_length(df: DataFrame, keys: Sequence[str], frames: str = "num_frames") -> DataFrame:
    return df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("num_samples"),
        F.avg(frames).alias("mean_frames"),
        F.stddev_pop(frames).alias("std_frames"),
        F.min(frames).cast("double").alias("min_frames"),
        F.max(frames).cast("double").alias("max_frames"),
        F.var_pop(frames).alias("sequence_length_variance"),
    )


def label_motion(df: DataFrame, keys: Sequence[str], means: Mapping[str, str], total: str = "total_motion", frames: str = "num_frames") -> DataFrame:
    """Means per label, sample deviation of the total motion and population variance of the
    frames, from one aggregation."""
    return df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("num_samples"),
        *[F.avg(finite(F.col(c))).alias(n) for n, c in means.items()],
        F.stddev_samp(total).alias("std_total_motion"),
        F.var_pop(frames).alias("sequence_length_variance"),
    )


def complexity_score(df: DataFrame, metrics: Sequence[str], into: str = "motion_complexity_score") -> DataFrame:
    """Mean of the metrics after min-max scaling inside each corpus; a missing value counts
    as 0, and only metrics with at least two values and a positive range count."""
    spans = []
    for i, m in enumerate(metrics):
        spans += [F.min(m).alias(f"_lo{i}"), F.max(m).alias(f"_hi{i}"), F.count(m).alias(f"_n{i}")]
    stats = df.groupBy("dataset").agg(*spans)
    joined = df.join(stats, "dataset")
    total, used = F.lit(0.0), F.lit(0)
    for i, m in enumerate(metrics):
        lo, hi = F.col(f"_lo{i}"), F.col(f"_hi{i}")
        ok = (F.col(f"_n{i}") >= 2) & (hi > lo)
        total = total + F.when(ok, F.coalesce((F.col(m) - lo) / (hi - lo), F.lit(0.0))).otherwise(F.lit(0.0))
        used = used + F.when(ok, 1).otherwise(0)
    return joined.withColumn(into, total / F.greatest(used, F.lit(1))).select(*df.columns, into)


def corpus_summary(df: DataFrame, metrics: Sequence[str], quantiles: Mapping[str, float] | None = None) -> DataFrame:
    """Long table (metric, corpus): count, mean, population deviation, median, quartiles, min, max."""
    probs = quantiles or {"median": 0.5, "q1": 0.25, "q3": 0.75}
    cleaned = df.select("dataset", *[finite(F.col(m)).alias(m) for m in metrics])
    long = cleaned.unpivot(["dataset"], list(metrics), "metric", "value").filter("value is not null")
    keys = ["metric", "dataset"]
    base = long.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("count"),
        F.avg("value").alias("mean"),
        F.stddev_pop("value").alias("std"),
        F.min("value").alias("min"),
        F.max("value").alias("max"),
    )
    return base.join(exact_quantiles(long, keys, "value", probs, few_groups=True), keys)

