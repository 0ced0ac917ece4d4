"""Ranks, drawn pairs and the preprocessing plan against plain versions, with sizes that spread the work."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from seqatlas.distribution import Sequences, rank_rows
from seqatlas.operators import dtw as D, ranking as RK, sequences as S
from test_operators import plain_dtw


def test_ranks_of_labels_with_a_common_prefix(spark):
    names = [f"class_{i:07d}" for i in range(3000)]
    random.Random(1).shuffle(names)
    df = spark.createDataFrame([("hot" if i % 3 else None, n) for i, n in enumerate(names)], "k string, label string").repartition(5)
    ranked = rank_rows(df, ["k"], ["label"])
    got = {(r.k, r.label): r["rank"] for r in ranked.collect()}
    for k in ("hot", None):
        mine = sorted(n for i, n in enumerate(names) if ("hot" if i % 3 else None) == k)
        assert [got[k, n] for n in mine] == list(range(len(mine)))
    # The hot key lies in several ranges.
    assert ranked.filter("k = 'hot'").select(F.spark_partition_id()).distinct().count() > 1 or spark.conf.get("spark.sql.adaptive.enabled") == "true"
    assert rank_rows(df.limit(0), [], ["label"]).count() == 0


@pytest.mark.parametrize("start", [0, 10**6, 10**12, 4 * 10**17])
def test_pair_numbers_are_decoded(spark, start):
    df = spark.range(start, start + 3000).withColumnRenamed("id", "p")
    i, j = RK.pair_rows(F.col("p"))
    for r in df.select("p", i.alias("i"), j.alias("j")).collect():
        assert 0 <= r.i < r.j and r.j * (r.j - 1) // 2 + r.i == r.p


def test_drawn_pairs_do_not_repeat_and_spread(spark):
    rows = [("big", i) for i in range(400)] + [("small", i) for i in range(5)] + [("one", 1)] + [(None, i) for i in range(30)]
    df = spark.createDataFrame(rows, "g string, id long").repartition(4)
    got = RK.draw_pairs(df, "id", ["g"], 50).collect()
    by = {g: [(r.id_a, r.id_b) for r in got if r.g == g] for g in ("big", "small", "one", None)}
    assert {g: len(p) for g, p in by.items()} == {"big": 50, "small": 10, "one": 0, None: 50}
    assert all(len(set(p)) == len(p) and all(a < b for a, b in p) for p in by.values())
    assert len({x for p in by["big"] for x in p}) > 60
    assert {tuple(r) for r in got} == {tuple(r) for r in RK.draw_pairs(df.repartition(7), "id", ["g"], 50).collect()}
    assert {tuple(r) for r in got} != {tuple(r) for r in RK.draw_pairs(df, "id", ["g"], 50, seed=1).collect()}


def test_no_step_of_a_draw_has_a_row_per_pair(spark):
    df = spark.range(2000).select((F.col("id") % 1).alias("g"), "id")
    drawn = RK.draw_pairs(df, "id", ["g"], 20)
    assert drawn.count() == 20
    plan = drawn._jdf.queryExecution().executedPlan()
    text = plan.toString()
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text


def test_pairs_of_labels_of_both_kinds(spark):
    rng = np.random.default_rng(2)
    rows = [("d", "small" if i < 5 else "large", i, rng.normal(size=10).tolist()) for i in range(25)]
    rows += [("d", "small", 90, []), ("d", "one", 91, rng.normal(size=10).tolist())]
    df = spark.createDataFrame(rows, "dataset string, label string, id long, t array<double>")
    pairs = D.pairs_of_labels(df, "id", "t", 2, ["dataset", "label"], most=20)
    of = {r[2]: np.reshape(r[3], (-1, 2)) for r in rows}
    got = pairs.collect()
    assert sum(r.label == "small" for r in got) == 15 and sum(r.label == "large" for r in got) == 20
    for r in got:
        if 90 in (r.id_a, r.id_b):
            assert r.dtw_distance is None
        else:
            assert r.dtw_distance == pytest.approx(plain_dtw(of[r.id_a], of[r.id_b]))
    stats = {r.label: r for r in D.intra_class(pairs, samples=df).collect()}
    assert set(stats) == {"small", "large"}
    assert (stats["small"].num_samples, stats["small"].num_pairs_all, stats["small"].num_pairs, stats["small"].num_pairs_failed) == (6, 15, 10, 5)
    assert (stats["large"].num_samples, stats["large"].num_pairs_all, stats["large"].num_pairs) == (20, 190, 20)


def test_large_corpora_are_searched_not_enumerated(spark):
    rng = np.random.default_rng(3)
    rows = [("few", i, rng.normal(size=8).tolist()) for i in range(4)] + [("many", i, rng.normal(size=8).tolist()) for i in range(9)]
    protos = spark.createDataFrame(rows, "dataset string, label long, prototype array<double>")
    got = D.inter_class(protos, "label", 2, exhaustive=True, most_labels=5, candidates=2).collect()
    assert {(r.dataset, r["mode"]) for r in got} == {("few", "exhaustive"), ("many", "nearest_candidates_then_dtw")}
    assert sum(r.dataset == "few" for r in got) == 6 and sum(r.dataset == "many" for r in got) < 36


def stored(rng, n, left, right, video=1):
    rows = []
    for f in range(n):
        hand = rng.normal(size=63)
        l, r = (hand if left(f) else np.zeros(63)), (hand if right(f) else np.zeros(63))
        rows.append((video, f, rng.normal(size=330).tolist(), np.concatenate([l, r, l, r]).tolist(), [0.0] * 52, rng.normal(size=36).tolist(), f % 5 > 0, bool(left(f)), bool(right(f)), True))
    return rows


STORED = "v long, frame long, pose array<double>, hands array<double>, face array<double>, mouth array<double>, v_pose boolean, v_left boolean, v_right boolean, v_face boolean"


@pytest.mark.parametrize("chunk_rows", [16, 65_536])
def test_preprocessing_counts_before_and_after(spark, chunk_rows):
    rng = np.random.default_rng(6)
    rows = stored(rng, 70, lambda f: f % 3 > 0, lambda f: f in (21, 30, 31)) + stored(rng, 10, lambda f: False, lambda f: False, video=2)
    seq = Sequences(("v",), chunk_rows=chunk_rows)
    out = S.preprocess(spark.createDataFrame(rows, STORED).repartition(3), seq)
    counts = {r.v: r for r in S.preprocess_counts(out, seq).collect()}
    one, two = counts[1], counts[2]
    assert one.source_total_frames == 70 and one.frames_before_resample + one.trim_start + one.trimmed_end == 70
    assert one.frames_after_resample == max(60, one.frames_before_resample)
    # The rare right hand moves to the left where that is missing; frames 21 and 30 have no left hand.
    assert one.right_source_frames == 3 and one.right_result_frames == 0 and one.hand_side_stabilised_frames == 3
    assert one.left_result_frames == one.left_source_frames + 2
    assert one.valid_left_hand_ratio == pytest.approx(one.left_result_frames / one.frames_after_resample) and one.valid_face_ratio == 1
    assert (two.source_total_frames, two.frames_after_resample, two.left_source_frames, two.max_hand_motion) == (10, 60, 0, 0.0)
    hands = np.array([r.hands for r in out.filter("v = 1").orderBy("frame").collect()])
    assert np.allclose(hands[:, :3], 0) and np.allclose(hands[:, 63:126], 0)
    # Inner gaps are filled; the ends have no frame on their other side.
    assert np.abs(hands[:, 3:63]).sum(1)[1:-1].min() > 0


def test_preprocessing_materialises_no_arrays(spark):
    """Wide rows meet the plan last and are read once; gaps over many chunks take their sources along."""
    rng = np.random.default_rng(8)
    rows = stored(rng, 90, lambda f: f in (2, 80), lambda f: f % 40 != 1)
    df = spark.createDataFrame(rows, STORED)
    staged = []
    stage = lambda table: staged.append(dict(table.dtypes)) or S.cut_lineage(table)
    small = S.preprocess(df, Sequences(("v",), chunk_rows=5), stage=stage).orderBy("frame").collect()
    assert staged and not any(t.startswith("array") for table in staged for t in table.values())
    whole = S.preprocess(df, Sequences(("v",))).orderBy("frame").collect()
    assert len(small) == len(whole) and all(np.allclose(a.hands, b.hands) and np.allclose(a.pose, b.pose) for a, b in zip(small, whole))


def test_preprocessing_counts_move_no_arrays(spark):
    rng = np.random.default_rng(9)
    seq = Sequences(("v",), chunk_rows=16)
    counts = S.preprocess_counts(S.preprocess(spark.createDataFrame(stored(rng, 30, lambda f: f % 3 > 0, lambda f: f % 2 > 0), STORED), seq), seq)
    plan = counts._jdf.queryExecution().optimizedPlan().toString()
    assert "zip_with" not in plan.lower() and "zipwith" not in plan.lower() and "_prev" not in plan
