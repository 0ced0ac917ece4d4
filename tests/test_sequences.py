"""Chunked sequence operators give the same result whatever the chunk size."""

import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from catalog.series import centers, frames
from oracle import rows_of
from seqatlas import distribution
from seqatlas.distribution import Sequences, number_rows
from seqatlas.operators import sequences as S
from seqatlas.session import cut_lineage

WIDE = Sequences(("user_id",))
SMALL = 12


def rounded_rows(df):
    names = [c for c, t in df.dtypes if t == "double"]
    df = df.withColumns({c: F.round(F.col(c) + 1e-9, 7) for c in names})
    return rows_of([tuple(r) for r in df.collect()], df.columns)


@pytest.fixture(scope="module")
def long_frames(tables):
    """All events as a few long sequences."""
    f = frames(tables).withColumn("user_id", F.col("user_id") % 2).drop("frame")
    f = number_rows(f, ["user_id"], ["event_id"], bucket=F.floor(F.col("event_id") / 64))
    p = F.col("frame") % 40
    gone = p.between(3, 9) | p.between(15, 33) | (F.col("frame") < 5)
    return f.withColumn("left", F.when(~gone, F.col("left"))).withColumn("lv", F.col("left").isNotNull()).cache()


OPERATORS = {
    "step_distance": lambda f, s: S.step_distance(f, s, "left").select("user_id", "frame", "step"),
    "valid_steps": lambda f, s: S.valid_step_summary(f, s, "left"),
    "two_hand": lambda f, s: S.two_hand_motion(f, s, "left", "right").select("user_id", "frame", "motion"),
    "velocity": lambda f, s: S.velocity_acceleration(f, s, "x").select("user_id", "frame", "acceleration"),
    "trajectory": lambda f, s: S.trajectory_stats(f, s, "left"),
    "gaps": lambda f, s: S.interpolate_gaps(f, s, ["left"]).select("user_id", "frame", "left.x"),
    "linear": lambda f, s: S.resample_linear(f.select("user_id", "frame", F.when(F.col("lv"), F.col("x")).alias("x"), "y"), s, ["x", "y"], 30),
    "nearest": lambda f, s: S.resample_nearest(f.select("user_id", "frame", "event_id"), s, lambda n: F.lit(101)),
    "sample": lambda f, s: S.sample_frames(f.select("user_id", "frame", "event_id"), s),
    "score": lambda f, s: S.motion_score(f, s, {"m": ("left", "lv")}).select("user_id", "frame", "m"),
    "interior": lambda f, s: S.interpolate_interior(f.select("user_id", "frame", F.when(F.col("lv"), F.col("x")).alias("x")), s, ["x"], seed_edges=True),
}


@pytest.mark.parametrize("name", sorted(OPERATORS))
def test_chunk_size_does_not_matter(long_frames, name):
    run = OPERATORS[name]
    whole = rounded_rows(run(long_frames, WIDE))
    cut = rounded_rows(run(long_frames, Sequences(("user_id",), chunk_rows=SMALL)))
    assert whole == cut and whole


def test_sequence_features_in_chunks(tables):
    seq = lambda n: Sequences(("user_id",), chunk_rows=n)
    run = lambda n: rounded_rows(S.sequence_features(S.normalised_frames(centers(tables), seq(n)), seq(n)))
    assert run(65_536) == run(13)


def test_number_rows_is_dense(tables):
    f = number_rows(tables("events").withColumn("k", F.lit(1)), ["k"], ["event_id"], bucket=F.floor(F.col("event_id") / 10))
    got = [r[0] for r in f.orderBy("event_id").select("frame").collect()]
    assert got == list(range(len(got)))


def line(spark, values):
    rows = [(1, i, None if v is None else float(v)) for i, v in enumerate(values)]
    return spark.createDataFrame(rows, "k int, frame long, v double").withColumn(
        "p", F.when(F.col("v").isNotNull(), F.struct(F.col("v").alias("x"), F.lit(0.0).alias("y"), F.lit(0.0).alias("z")))
    )


def filled(spark, values):
    out = S.interpolate_gaps(line(spark, values), Sequences(("k",)), ["p"]).orderBy("frame")
    return [r[0] for r in out.select("p.x").collect()]


def test_gap_of_eight_is_filled_and_nine_is_not(spark):
    assert filled(spark, [0] + [None] * 8 + [9]) == [float(i) for i in range(10)]
    assert filled(spark, [0] + [None] * 9 + [10]) == [0.0] + [None] * 9 + [10.0]


def test_edges_take_the_nearest_value_and_one_valid_frame_stays(spark):
    assert filled(spark, [None, None, 4, 6, None]) == [4.0, 4.0, 4.0, 6.0, 6.0]
    assert filled(spark, [None, 4, None]) == [None, 4.0, None]


def test_linear_resampling_of_short_sequences(spark):
    one = S.resample_linear(line(spark, [7]).select("k", "frame", "v"), Sequences(("k",)), ["v"], 4).orderBy("frame")
    assert [r.v for r in one.collect()] == [7.0] * 4
    values = [3.0, 5.0, None, 2.0, 8.0]
    got = S.resample_linear(line(spark, values).select("k", "frame", "v"), Sequences(("k",)), ["v"], 9).orderBy("frame")
    x = np.array([0, 1, 3, 4]) / 4
    want = np.interp(np.linspace(0, 1, 9), x, [3.0, 5.0, 2.0, 8.0])
    assert np.allclose([r.v for r in got.collect()], want)


@pytest.mark.parametrize("length,wanted", [(1, 3), (5, 5), (7, 3), (4, 11), (60, 24), (3, 1)])
def test_nearest_resampling_matches_rounded_spacing(spark, length, wanted):
    out = S.resample_nearest(line(spark, [1] * length), Sequences(("k",)), lambda n: F.lit(wanted)).orderBy("frame")
    got = [r.source_frame for r in out.collect()]
    assert got == np.round(np.linspace(0, length - 1, wanted)).astype(int).tolist()


def test_first_two_detections_fill_the_slots(spark):
    rows = [(1, 0, "Right", "a"), (1, 1, "Right", "b"), (2, 0, None, "c"), (2, 1, "Left", "d"), (3, 0, "Left", "e"), (1, 2, "Left", "z")]
    df = spark.createDataFrame(rows, "f int, i int, side string, hand string")
    got = {r.f: (r.left, r.right) for r in S.assign_hand_slots(df, ["f"], order="i", side="side", payload="hand").collect()}
    assert got == {1: ("b", "a"), 2: ("c", "d"), 3: ("e", None)}


@pytest.mark.parametrize("name", ["gaps", "linear", "score", "trajectory", "valid_steps"])
def test_more_rows_are_more_tasks(long_frames, name, monkeypatch):
    run, seq = OPERATORS[name], Sequences(("user_id",), chunk_rows=SMALL)
    whole = rounded_rows(run(long_frames, seq))
    monkeypatch.setattr(distribution, "TASK_ROWS", 20)
    plan = run(long_frames, seq)
    tasks = -(-long_frames.count() // 20)
    assert f"hashpartitioning(user_id, _chunk, {tasks})" in re.sub(r"#\d+L?", "", plan._jdf.queryExecution().sparkPlan().toString())
    assert rounded_rows(plan) == whole


def test_features_and_trajectories_in_small_tasks(tables, monkeypatch):
    seq = Sequences(("user_id",), chunk_rows=13)

    def run():
        normalised = cut_lineage(S.normalised_frames(centers(tables), seq))
        return rounded_rows(S.sequence_features(normalised, seq)), rounded_rows(S.hand_trajectories(normalised, seq))

    whole = run()
    monkeypatch.setattr(distribution, "TASK_ROWS", 50)
    assert run() == whole and whole[1]
