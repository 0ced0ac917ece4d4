"""Rules, properties and brute-force checks of single operators."""

import io
import itertools
import math
import re

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from seqatlas.distribution import exact_quantiles, salted_join, tile_pairs
from seqatlas.functions import text as X
from seqatlas.guards import InputError, require_columns, single_corpus
from seqatlas.operators import classes as C, clusters as CL, dtw as D, features as FE, joins as J, scaling as SC, separability as SE
from seqatlas.sources import keypoints as KP, layout as L, tables as T


# --- distribution ------------------------------------------------------------------


@pytest.mark.parametrize("accuracy", [10, 50, 10_000])
def test_exact_quantiles_match_numpy(spark, accuracy):
    rng = np.random.default_rng(5)
    rows = [("hot", float(v)) for v in rng.normal(size=3000).round(3)] + [("dup", 1.0)] * 900 + [("few", 2.0), ("few", 5.0), ("few", 9.0)]
    df = spark.createDataFrame(rows, "k string, v double")
    probs = {"p10": 0.1, "p25": 0.25, "p50": 0.5, "p90": 0.9, "p100": 1.0}
    got = {r.k: r for r in exact_quantiles(df, ["k"], "v", probs, accuracy=accuracy).collect()}
    for key, values in pd.DataFrame(rows, columns=["k", "v"]).groupby("k")["v"]:
        for name, p in probs.items():
            assert got[key][name] == pytest.approx(np.quantile(values, p), abs=1e-12)


def test_large_groups_are_cut_by_several_passes(spark):
    """Accuracy 60: groups over 120 rows are bracketed, and the largest brackets are cut again."""
    rng = np.random.default_rng(5)
    data = {"normal": rng.normal(size=9000), "ties": np.repeat([1.0, 2.0, 3.0], 700), "few": rng.normal(size=50), "wide": rng.lognormal(sigma=9, size=4000)}
    df = spark.createDataFrame([(k, float(v)) for k, values in data.items() for v in values], "k string, v double").repartition(4)
    probs = {"a": 0.0, "p1": 0.01, "m": 0.5, "p9": 0.9, "z": 1.0}
    got = {r.k: r for r in exact_quantiles(df, ["k"], "v", probs, accuracy=60).collect()}
    assert set(got) == set(data)
    for key, values in data.items():
        for name, p in probs.items():
            assert got[key][name] == pytest.approx(np.quantile(values, p), rel=1e-12), (key, name)
    # Only the bracket leaves the tasks.
    bracketed = exact_quantiles(df.filter("k = 'normal'"), ["k"], "v", {"m": 0.5}, accuracy=200)
    assert bracketed.collect()[0].m == pytest.approx(np.median(data["normal"]))


def test_exact_quantiles_without_keys(spark):
    df = spark.range(101).select(F.col("id").cast("double").alias("v"))
    assert exact_quantiles(df, [], "v", {"m": 0.5}).collect()[0].m == 50.0


@pytest.mark.parametrize("block_rows", [3, 7, 1000])
def test_tile_pairs_are_complete(spark, block_rows):
    ids = list(range(25))
    df = spark.createDataFrame([(i, "g" if i % 3 else "h") for i in ids], "id long, g string")
    got = sorted((r.g, r.id_a, r.id_b) for r in tile_pairs(df, "id", ["g"], block_rows=block_rows).collect())
    group = {i: ("g" if i % 3 else "h") for i in ids}
    assert got == sorted((group[a], a, b) for a, b in itertools.combinations(ids, 2) if group[a] == group[b])


def test_salted_join_keeps_rows(spark):
    big = spark.range(1000).select("id", F.when(F.col("id") < 900, 0).otherwise(F.col("id") % 7).alias("k"))
    small = spark.createDataFrame([(0, "a"), (1, "b")], "k int, name string")
    assert salted_join(big, small, ["k"], salt_on=["id"], how="left").count() == 1000
    assert salted_join(big, small, ["k"], salt_on=["id"]).count() == big.filter("k < 2").count()


def test_label_tables_have_no_row_cap(spark):
    labels = spark.range(150_000).select(F.col("id").alias("k"), F.concat(F.lit("l"), "id").alias("name"))
    rows = spark.range(0, 200_000, 7).select("id", F.col("id").alias("k"))
    got = J.attach_small(rows, labels, "k")
    assert got.count() == rows.count() and got.filter("name is null").count() == rows.filter("k >= 150000").count()
    samples = spark.range(10).select(F.concat(F.lit(""), F.col("id") * 14_000).alias("raw"), F.lit("a/b.mp4").alias("path"))
    mapping = labels.select(F.col("k").cast("string").alias("key"), F.col("name").alias("label"))
    assert {r.label for r in T.resolve_labels(samples, mapping, raw="raw", path="path").collect()} == {f"l{i * 14_000}" for i in range(10)}


def test_guards(spark):
    with pytest.raises(InputError):
        require_columns(spark.range(1), ["x"])
    two = spark.createDataFrame([("A",), ("B",)], "dataset string")
    with pytest.raises(Exception, match="more than one corpus"):
        single_corpus(two).collect()
    assert single_corpus(two.filter("dataset = 'A'")).count() == 1
    left = spark.createDataFrame([(1, 2)], "k int, a int")
    with pytest.raises(Exception, match="no key in common"):
        J.merge_inner([left, spark.createDataFrame([(2, 2)], "k int, b int")], ["k"]).collect()


# --- class distribution ------------------------------------------------------------


def counts_of(spark, values):
    return spark.createDataFrame([("d", f"c{i:03d}", int(v)) for i, v in enumerate(values)], "dataset string, class_name string, sample_count long")


def test_gini_bounds_and_scale(spark):
    g = lambda v: C.gini(counts_of(spark, v)).collect()[0].gini
    assert g([4, 4, 4]) == pytest.approx(0)
    assert g([1, 2, 7, 9]) == pytest.approx(g([3, 6, 21, 27]))
    assert 0 <= g([1, 1, 1, 100]) < 1


def test_lorenz_runs_from_origin_to_one_and_rises(spark):
    points = C.lorenz(counts_of(spark, [1, 1, 1, 2, 5, 5]), step_rows=2).orderBy("position").collect()
    curve = [(p.class_fraction, p.sample_fraction) for p in points]
    assert curve[0] == (0.0, 0.0) and curve[-1] == (1.0, 1.0) and len(curve) == 7
    assert all(a[0] < b[0] and a[1] <= b[1] for a, b in zip(curve, curve[1:]))


def test_single_class_has_deviation_zero(spark):
    row = C.imbalance(counts_of(spark, [5])).collect()[0]
    assert (row.std_samples, row.imbalance_ratio, row.gini, row.top_share) == (0.0, 1.0, 0.0, 1.0)


def test_percentages_sum_to_hundred(spark, tables):
    rows = tables("orders").select(F.col("o_orderstatus").alias("dataset"), "o_orderpriority")
    sums = C.shares(rows, ["o_orderpriority"]).groupBy("dataset").agg(F.sum("percentage").alias("s")).collect()
    assert all(r.s == pytest.approx(100) for r in sums)


def test_published_ratio_and_variation(spark):
    """A table with the published extremes: ratio is max over min, CV is deviation over mean."""
    row = C.imbalance(counts_of(spark, [1, 2, 3, 6])).collect()[0]
    assert row.imbalance_ratio == 6.0
    assert row.coefficient_of_variation == pytest.approx(np.std([1, 2, 3, 6], ddof=1) / 3)


# --- features ------------------------------------------------------------------------


def test_complexity_ignores_flat_and_single_metrics(spark):
    rows = [("A", "x", 1.0, 5.0, None), ("A", "y", 3.0, 5.0, 2.0), ("A", "z", None, 5.0, None)]
    df = spark.createDataFrame(rows, "dataset string, gloss string, a double, b double, c double")
    got = {r.gloss: r.motion_complexity_score for r in FE.complexity_score(df, ["a", "b", "c"]).collect()}
    assert got == {"x": 0.0, "y": 1.0, "z": 0.0}


def test_location_ties_follow_zone_order(spark):
    rows = [(1, z) for z in ("waist", "head", "waist", "head", None)]
    row = FE.location_summary(spark.createDataFrame(rows, "k int, zone string"), ["k"], "zone").collect()[0]
    assert row.dominant_location == "head" and row.valid_frame_ratio == 0.8 and row.waist_ratio == 0.5


def test_stage_feature_counts():
    assert [len(v) for v in FE.STAGE_FEATURES.values()] == [48, 5, 6, 21]
    report = T.whitelist_report(["head_ratio", "extra"], FE.LOCATION_FEATURES)
    assert report["used"] == ["head_ratio"] and report["ignored"] == ["extra"] and len(report["missing"]) == 4


def test_scaling_uses_the_named_deviation(spark):
    df = spark.createDataFrame([(i, [float(v), 3.0, None if i == 0 else float(i)]) for i, v in enumerate([2, 5, 9])], "id int, features array<double>")
    pop = [r.scaled[0] for r in SC.scale(df, "features").orderBy("id").collect()]
    sam = [r.scaled[0] for r in SC.scale(df, "features", sample=True).orderBy("id").collect()]
    x = np.array([2, 5, 9.0])
    assert np.allclose(pop, (x - x.mean()) / x.std()) and np.allclose(sam, (x - x.mean()) / x.std(ddof=1))
    assert all(r.scaled[1] == 0.0 for r in SC.scale(df, "features").collect())


# --- separability --------------------------------------------------------------------


@pytest.fixture(scope="module")
def points(spark):
    rng = np.random.default_rng(3)
    rows = [("D", f"g{i % 4}", i, rng.normal(size=5).tolist()) for i in range(90)] + [("D", "single", 900, [9.0] * 5)]
    return rows, spark.createDataFrame(rows, "dataset string, gloss string, id long, x array<double>").cache()


def brute_silhouette(rows):
    x, g = np.array([r[3] for r in rows]), np.array([r[1] for r in rows])
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    out = {}
    for i, row in enumerate(rows):
        own = (g == g[i]).sum()
        if own == 1:
            out[row[2]] = 0.0
            continue
        a = d[i, g == g[i]].sum() / (own - 1)
        b = min(d[i, g == o].mean() for o in set(g) - {g[i]})
        out[row[2]] = (b - a) / max(a, b)
    return out


@pytest.mark.parametrize("block_rows", [11, 1000])
def test_silhouette_matches_brute_force(points, block_rows):
    rows, df = points
    got = {r.id: r.silhouette for r in SE.silhouette_samples(df, "x", "id", block_rows=block_rows).collect()}
    want = brute_silhouette(rows)
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k], abs=1e-9) for k in want)
    assert all(-1 <= v <= 1 for v in got.values())


def test_silhouette_tiles_send_few_rows(spark):
    """Labels of two samples: pairs are not sent; a sample leaves a tile with its least mean and the border labels."""
    rng = np.random.default_rng(4)
    df = spark.createDataFrame([("d", f"g{i // 2:03d}", i, rng.normal(size=4).tolist()) for i in range(300)], "dataset string, gloss string, id long, x array<double>")
    sent = SE.silhouette_tiles(df, "x", "id", block_rows=51).count()
    assert sent <= 300 * 6 * 4 < 300 * 150 / 4


def test_silhouettes_send_a_sample_to_few_tiles(spark):
    rng = np.random.default_rng(5)
    rows = [("d", f"g{i % 3}", i, rng.normal(size=4).tolist()) for i in range(400)]
    df = spark.createDataFrame(rows, "dataset string, gloss string, id long, x array<double>")
    assert SE.silhouette_tiles(df, "x", "id", block_rows=5).count() <= 400 * 9 * 4
    got = {r.id: r.silhouette for r in SE.silhouette_samples(df, "x", "id", block_rows=5).collect()}
    want = brute_silhouette(rows)
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k], abs=1e-9) for k in want)


@pytest.mark.parametrize("block_rows", [13, 1000])
def test_nearest_candidates_match_brute_force(points, block_rows):
    rows, df = points
    got = {(r.id_a, r.id_b) for r in SE.nearest_candidates(df, "id", "x", 4, block_rows=block_rows).collect()}
    x, ids = np.array([r[3] for r in rows]), [r[2] for r in rows]
    d = ((x[:, None] - x[None]) ** 2).sum(-1) + np.diag([np.inf] * len(rows))
    want = {tuple(sorted((ids[i], ids[j]))) for i in range(len(rows)) for j in np.argsort(d[i])[:4]}
    assert got == want


@pytest.fixture(scope="module")
def scattered(spark):
    """Labels in well separated places, many at one of them."""
    rng = np.random.default_rng(11)
    places = rng.normal(scale=50, size=(12, 5))
    rows = [("d", i, (places[i % 12 if i % 3 else 0] + rng.normal(size=5)).tolist(), float(rng.uniform(0.5, 1.5))) for i in range(360)]
    rows += [("e", i, rng.normal(size=5).tolist(), 1.0) for i in range(3)] + [("alone", 0, [1.0] * 5, 1.0)]
    return rows, spark.createDataFrame(rows, "dataset string, gloss long, centroid array<double>, spread double").repartition(3)


@pytest.mark.parametrize("block_rows", [16, 300])
def test_worst_ratios_open_few_blocks(scattered, block_rows):
    rows, df = scattered
    got = {(r.dataset, r.gloss): r for r in SE.worst_ratios(df, block_rows=block_rows).collect()}
    x, s = np.array([r[2] for r in rows]), np.array([r[3] for r in rows])
    compared = 0
    for name, want in (("d", 360), ("e", 3)):
        at = [i for i, r in enumerate(rows) if r[0] == name]
        for i in at:
            best = max((s[i] + s[j]) / np.linalg.norm(x[i] - x[j]) for j in at if j != i)
            assert got[name, rows[i][1]].ratio == pytest.approx(best)
        compared += sum(got[name, rows[i][1]].pairs for i in at)
    assert ("alone", 0) not in got and len(got) == 363
    assert compared < 0.35 * 360 * 359


@pytest.mark.parametrize("block_rows", [16, 300])
def test_nearest_rows_open_few_blocks(scattered, block_rows):
    from seqatlas.operators import blocks

    rows, df = scattered
    seen = []
    real = blocks.visit
    try:
        blocks.visit = lambda b, queries, *rest: seen.append(queries.count()) or real(b, queries, *rest)
        got = {(r.dataset, r.gloss, r._near) for r in SE.nearest_rows(df, "gloss", "centroid", 3, ["dataset"], block_rows=block_rows).collect()}
    finally:
        blocks.visit = real
    x = np.array([r[2] for r in rows[:360]])
    d = ((x[:, None] - x[None]) ** 2).sum(-1) + np.diag([np.inf] * 360)
    assert {g for g in got if g[0] == "d"} == {("d", i, int(j)) for i in range(360) for j in np.argsort(d[i])[:3]}
    assert {g for g in got if g[0] == "e"} == {("e", i, j) for i in range(3) for j in range(3) if i != j}
    tiles = 19 + (360 // block_rows if block_rows == 16 else 0)
    assert 0 < seen[0] < 0.6 * 360 * tiles


def test_rows_that_no_bound_tells_apart_go_to_few_tiles(spark):
    """In many dimensions every block has to be opened; a row is then sent to a few tiles, not to each of them."""
    from seqatlas.operators import blocks

    rng = np.random.default_rng(12)
    x = rng.normal(size=(600, 24))
    df = spark.createDataFrame([("d", i, v.tolist()) for i, v in enumerate(x)], "dataset string, id long, x array<double>")
    seen, real = [], blocks.visit
    try:
        blocks.visit = lambda b, queries, *rest: seen.append(queries.count()) or real(b, queries, *rest)
        got = {(r.id, r._near) for r in SE.nearest_rows(df, "id", "x", 3, ["dataset"], block_rows=10).collect()}
    finally:
        blocks.visit = real
    d = ((x[:, None] - x[None]) ** 2).sum(-1) + np.diag([np.inf] * 600)
    assert got == {(i, int(j)) for i in range(600) for j in np.argsort(d[i])[:3]}
    assert seen[0] <= 600 * 2 * blocks.TILES


def test_small_groups_are_one_tile(scattered):
    """Without other blocks to open the results are the same."""
    _, df = scattered
    few = lambda f, **more: {tuple(r) for r in f(**more).collect()}
    near = lambda **more: SE.nearest_rows(df, "gloss", "centroid", 3, ["dataset"], **more).select("dataset", "gloss", "_near")
    assert few(near) == few(near, block_rows=16)
    worst = lambda **more: SE.worst_ratios(df, **more).select("dataset", "gloss", F.round("ratio", 9))
    assert few(worst) == few(worst, block_rows=16)


def test_kmeans_and_components(points):
    rows, df = points
    x = np.array([r[3] for r in rows])
    labels = {r.id: r.cluster for r in CL.kmeans(df, "x", k=4, ident="id").collect()}
    lab = np.array([labels[r[2]] for r in rows])
    inertia = sum(((x[lab == c] - x[lab == c].mean(0)) ** 2).sum() for c in set(lab))
    assert len(set(lab)) <= 4 and inertia < ((x - x.mean(0)) ** 2).sum()
    coords, explained = CL.pca2(df, "x")
    values = np.sort(np.linalg.eigvalsh(np.cov(x.T)))[::-1]
    ratio = [r.explained_variance_ratio for r in explained.orderBy("component").collect()]
    assert np.allclose(ratio, values[:2] / values.sum())
    pc = np.array([[r.pc1, r.pc2] for r in coords.collect()])
    assert np.allclose(pc.var(0, ddof=1), values[:2]) and np.allclose(pc.mean(0), 0)
    # Each group has its own components; a null group is one.
    groups = df.withColumn("g", F.when(F.col("id") % 2 == 0, "even"))
    parts, shares = CL.pca2(groups.filter("g = 'even'"), "x", ["g"])
    even = x[[r[2] % 2 == 0 for r in rows]]
    values = np.sort(np.linalg.eigvalsh(np.cov(even.T)))[::-1]
    got = {r.component: r for r in shares.collect()}
    assert got["PC2"].cumulative_explained_variance == pytest.approx(values[:2].sum() / values.sum()) and parts.count() == len(even)


def test_kmeans_keeps_empty_centers_and_handles_few_rows(spark):
    df = spark.createDataFrame([(i, [float(i // 5), 0.0]) for i in range(10)], "vec_id long, x array<double>")
    got = {r.vec_id: r.cluster for r in CL.kmeans(df, "x", k=8).collect()}
    # Eight starts on two places: of equal centers the first has all members, the others stay empty.
    assert len({got[i] for i in range(5)}) == 1 and len({got[i] for i in range(5, 10)}) == 1
    assert CL.kmeans(df.limit(2), "x", k=8).count() == 2 and CL.kmeans(df.limit(0), "x").count() == 0


# --- time warping -----------------------------------------------------------------------


def plain_dtw(a, b, window=8):
    n, m = len(a), len(b)
    w = max(window, abs(n - m))
    t = np.full((n + 1, m + 1), math.inf)
    t[0, 0] = 0
    for i in range(1, n + 1):
        for j in range(max(1, i - w), min(m, i + w) + 1):
            t[i, j] = np.linalg.norm(a[i - 1] - b[j - 1]) + min(t[i - 1, j], t[i, j - 1], t[i - 1, j - 1])
    return t[n, m] / (n + m)


def test_warp_matches_plain_table():
    rng = np.random.default_rng(1)
    for n, m, w in [(30, 30, 8), (5, 17, 2), (12, 3, 8), (20, 20, 1), (9, 9, None)]:
        a, b = rng.normal(size=(4, n, 3)), rng.normal(size=(4, m, 3))
        want = [plain_dtw(x, y, max(n, m) if w is None else w) for x, y in zip(a, b)]
        assert np.allclose(D.warp(a, b, w), want)
        assert np.allclose(D.warp(a, a, w), 0) and np.allclose(D.warp(a, b, w), D.warp(b, a, w))


@pytest.mark.parametrize("block_rows", [4, 256])
def test_warping_inside_groups_matches_brute_force(spark, block_rows):
    rng = np.random.default_rng(2)
    rows = [("A", f"l{i % 2}", i, rng.normal(size=(6 + i % 3) * 2).tolist()) for i in range(22)]
    df = spark.createDataFrame(rows, "dataset string, label string, id long, t array<double>")
    pairs = D.warp_within(df, "id", "t", 2, ["dataset", "label"], block_rows=block_rows)
    got = {(r.id_a, r.id_b): r.dtw_distance for r in pairs.collect()}
    want = {
        (a[2], b[2]): plain_dtw(np.reshape(a[3], (-1, 2)), np.reshape(b[3], (-1, 2)))
        for a, b in itertools.combinations(rows, 2) if a[1] == b[1]
    }
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k]) for k in want)
    stats = {r.label: r for r in D.intra_class(pairs).collect()}
    label = {r[2]: r[1] for r in rows}
    for l in ("l0", "l1"):
        values = [v for (a, _), v in want.items() if label[a] == l]
        assert stats[l].num_pairs == len(values)
        assert stats[l].intra_class_dtw_std == pytest.approx(np.std(values))
        assert stats[l].intra_class_dtw_median == pytest.approx(np.median(values))


def test_inter_class_candidates_and_exhaustive(spark):
    rng = np.random.default_rng(4)
    rows = [("A", i % 6, i, rng.normal(size=20).tolist()) for i in range(30)]
    df = spark.createDataFrame(rows, "dataset string, label long, id long, t array<double>")
    protos = D.prototypes(df, ["dataset", "label"], "t")
    p = {l: np.mean([r[3] for r in rows if r[1] == l], axis=0).reshape(-1, 2) for l in range(6)}
    full = {(r.label_a, r.label_b): r.dtw_distance for r in D.inter_class(protos, "label", 2, exhaustive=True).collect()}
    assert len(full) == 15 and all(v == pytest.approx(plain_dtw(p[a], p[b])) for (a, b), v in full.items())
    near = D.inter_class(protos, "label", 2, candidates=5).collect()
    assert {(r.label_a, r.label_b): r.dtw_distance for r in near} == pytest.approx(full)
    assert {r.mode for r in near} == {"nearest_candidates_then_dtw"}


def test_sampled_pairs_repeat(spark):
    pairs = spark.createDataFrame([("d", "l", i, j, 1.0) for i in range(12) for j in range(i)], "dataset string, label string, id_a long, id_b long, dtw_distance double")
    pick = lambda: sorted((r.id_a, r.id_b) for r in D.sampled_pairs(pairs, ["dataset", "label"], "id", 10).collect())
    assert len(pick()) == 10 and pick() == pick()


# --- sources ------------------------------------------------------------------------------


def test_csv_encodings_are_found_per_file(spark, tmp_path):
    word = "Đường"
    (tmp_path / "a.csv").write_bytes("﻿ID,VIDEO,LABEL\n1,D1.mp4,".encode() + word.encode() + b"\n")
    (tmp_path / "b.csv").write_bytes("ID,VIDEO,LABEL\n2,D2.mp4,".encode() + "Đ".encode("cp1258") + b"\n")
    (tmp_path / "c.csv").write_bytes("ID,VIDEO,LABEL\n3,\"D,3.mp4\",é".encode("latin1") + b"\x8a\n")
    got = {r.ID: (r.VIDEO, r.LABEL, r._encoding) for r in T.read_csv_any_encoding(spark, str(tmp_path)).collect()}
    assert got["1"] == ("D1.mp4", word, "utf-8")
    assert got["2"] == ("D2.mp4", "Đ", "cp1258")
    assert got["3"] == ("D,3.mp4", "é\x8a", "latin1")


def test_text_key_composes(spark):
    df = spark.createDataFrame([("é ",), ("abc",), (None,)], "s string")
    assert [r[0] for r in df.select(X.text_key(F.col("s"))).collect()] == ["é", "abc", ""]


def archive(**arrays):
    buffer = io.BytesIO()
    np.savez(buffer, **arrays)
    return buffer.getvalue()


def test_declared_archive_and_layout(spark):
    """Values count up, so any wrong offset or stride shows."""
    pose = np.arange(2 * 330, dtype=np.float32).reshape(2, 330)
    hands = np.arange(2 * 252, dtype=np.float32).reshape(2, 252)
    mask = np.array([[1, 0, 1, 1], [1, 1, 1, 0]], dtype=np.uint8)
    files = [("x/lab/a.npz", archive(pose=pose, hands=hands, face=np.zeros((2, 52)), mouth=np.zeros((2, 36)), valid_mask=mask, source_fps=np.array(25.0), video_name=np.array("a.mp4"))),
             ("x/lab/b.npz", b"no archive"), ("x/lab/c.npz", archive(note=np.array(1.0)))]
    frames = KP.decode_frames(spark.createDataFrame(files, "path string, content binary"))
    rows = frames.filter("error is null").orderBy("frame")
    first = rows.collect()[0]
    assert (first.v_pose, first.v_left, first.source_fps, first.video_name, len(first.pose)) == (True, False, 25.0, "a.mp4", 330)
    assert frames.filter("error is not null").count() == 2
    decoded = rows.select(
        L.pose_landmarks(F.col("pose")).alias("norm"), L.pose_landmarks(F.col("pose"), world=True).alias("world"),
        L.split_hands(F.col("hands"))[0].alias("left"), L.split_hands(F.col("hands"))[1].alias("right"),
    ).collect()[0]
    assert decoded.norm[1] == [5.0, 6.0, 7.0] and decoded.world[0] == [165.0, 166.0, 167.0]
    assert decoded.left[20] == [60.0, 61.0, 62.0] and decoded.right[0] == [63.0, 64.0, 65.0]
    both = L.decode_declared(rows).orderBy("frame").collect()
    assert both[0].left_points is None and both[1].left_points[0] == [330 + 75.0, 330 + 76.0, 330 + 77.0]
    info = {r.name: r for r in KP.inspect_arrays(spark.createDataFrame(files[:1], "path string, content binary")).collect()}
    assert info["pose"].shape == "(2, 330)" and info["pose"].has_nan is False


def test_csv_fields_over_several_lines(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes('\ufeffID,Label\r\n1,"one\r\n\r\ntwo, ""three"""\r\n2,é\r\n3,\r\n'.encode())
    (tmp_path / "b.csv").write_bytes("label,id\n\"\xf0\nx\",4\nplain,5\n".encode("latin1"))
    (tmp_path / "c.csv").write_text("id,label\n6,on one line\n")
    got = {r.id: (r.label, r._encoding) for r in T.read_csv_any_encoding(spark, str(tmp_path), columns=["id", "label"]).collect()}
    assert {k: v[0].replace("\r", "") if v[0] else v[0] for k, v in got.items()} == {
        "1": 'one\n\ntwo, "three"', "2": "é", "3": None, "4": "đ\nx", "5": "plain", "6": "on one line",
    }
    assert {k: v[1] for k, v in got.items()} == {"1": "utf-8", "2": "utf-8", "3": "utf-8", "4": "cp1258", "5": "cp1258", "6": "utf-8"}


def test_pooled_distances_far_from_zero(spark):
    """Deviations of distances near a million keep their digits."""
    from seqatlas.distribution import Sequences
    from seqatlas.operators import sequences as S

    rng = np.random.default_rng(7)
    left, right = rng.normal(size=40), rng.normal(size=40)
    point = lambda x: (float(x), 0.0, 0.0)
    rows = [(1, f, point(1e6 + a), point(1e6 + b), point(0), point(0), True, True, True, True, 0.0, 0.0, 0.0, 0.0, 1.0) for f, (a, b) in enumerate(zip(left, right))]
    p = "struct<x:double,y:double,z:double>"
    df = spark.createDataFrame(rows, f"v long, frame long, left {p}, right {p}, pose {p}, face {p}, has_left boolean, has_right boolean, has_pose boolean, has_face boolean, left_invalid double, right_invalid double, pose_invalid double, face_invalid double, scale double")
    got = S.sequence_features(df, Sequences(("v",))).collect()[0]
    both = np.concatenate([1e6 + left, 1e6 + right])
    assert got.hand_face_dist_std == pytest.approx(both.std(), rel=1e-6) and got.hand_body_dist_mean == pytest.approx(both.mean())


def test_the_kmeans_query_runs_the_rounds_of_its_sql(tables, monkeypatch):
    """On 10,256 vectors centers still move after 60 rounds; a tolerance or more rounds give other clusters."""
    from catalog import ORACLE, vectors as V

    asked = {}
    real = CL.kmeans
    monkeypatch.setattr(CL, "kmeans", lambda df, features, **more: asked.update(more) or real(df, features, **{**more, "rounds": 1}))
    V.ml_kmeans(tables)
    assert asked["tolerance"] == 0 and f"n{asked['rounds']} AS" in ORACLE["ml_kmeans"] and f"n{asked['rounds'] + 1} AS" not in ORACLE["ml_kmeans"]


def test_kmeans_ends_when_members_stay(points):
    """A further round changes nothing, however many are allowed."""
    rows, df = points
    runs = [{r.id: r.cluster for r in CL.kmeans(df, "x", k=4, ident="id", rounds=n, tolerance=0.0).collect()} for n in (60, 61)]
    assert runs[0] == runs[1]


def test_label_map_files(spark, tmp_path):
    (tmp_path / "m.json").write_text('{"7": "seven"}')
    (tmp_path / "m.txt").write_text("7 seven\n\n12 a dozen\n")
    for name in ("m.json", "m.txt"):
        got = {r.key: r.label for r in T.read_label_map(spark, str(tmp_path / name)).collect()}
        assert got["7"] == "seven" and got["class_0007"] == "seven"


def test_preprocess_keeps_length_and_anchors_wrists(spark):
    from seqatlas.distribution import Sequences
    from seqatlas.operators import sequences as S

    rng = np.random.default_rng(6)
    rows = []
    for f in range(40):
        left = rng.normal(size=63) if f not in (10, 11, 12) else np.zeros(63)
        hands = np.concatenate([left, np.zeros(63), left, np.zeros(63)]).tolist()
        rows.append((1, f, rng.normal(size=330).tolist(), hands, [0.0] * 52, rng.normal(size=36).tolist(), True, bool(left.any()), False, True))
    df = spark.createDataFrame(rows, "v long, frame long, pose array<double>, hands array<double>, face array<double>, mouth array<double>, v_pose boolean, v_left boolean, v_right boolean, v_face boolean")
    out = S.preprocess(df, Sequences(("v",), chunk_rows=16)).orderBy("frame").collect()
    assert [r.frame for r in out] == list(range(60))
    assert all(len(r.hands) == 252 and len(r.pose) == 330 for r in out)
    hands = np.array([r.hands for r in out])
    assert np.allclose(hands[:, :3], 0) and np.abs(hands[:, 3:63]).sum(1).min() > 0 and np.allclose(hands[:, 63:126], 0)
    pose = np.array([r.pose for r in out])[:, :165].reshape(-1, 33, 5)
    neck = (pose[:, 11, :3] + pose[:, 12, :3]) / 2
    head = (pose[:, 7, :3] + pose[:, 8, :3]) / 2
    assert np.allclose(neck, 0, atol=1e-9) and np.allclose(np.linalg.norm(head - neck, axis=1), 1)


def test_no_join_of_csv_lines_gathers_a_file(spark, tmp_path):
    from seqatlas.sources import tables as T

    (tmp_path / "a.csv").write_text("id,label\n1,x\n2,y\n")
    (tmp_path / "b.csv").write_text('Label,ID\n"two\nlines",3\n')
    df = T.read_csv_any_encoding(spark, str(tmp_path), columns=["id", "label"])
    assert {(r.id, r.label) for r in df.collect()} == {("1", "x"), ("2", "y"), ("3", "two\nlines")}
    plan = re.sub(r"#\d+L?", "", df._jdf.queryExecution().optimizedPlan().toString())
    # Blocks find the row of their file; lines and records are joined by block and salt.
    assert "_block = _block" in plan and "_salt = _salt" in plan and len(re.findall(r"Join \w+, \(_file = _file\)", plan)) <= 1


def test_archives_are_made_in_small_batches():
    import pandas as pd
    from catalog import sources as CS

    rows = pd.DataFrame({"vec_id": range(1, 1201), "embedding": [[0.5] * 64] * 1200})
    sizes = [len(b) for b in CS._extracted([rows])]
    assert sum(sizes) == 1200 and max(sizes) <= 500


def test_codec_tags_of_all_bytes_name_the_code_few_times(spark):
    rng = np.random.default_rng(0)
    codes = [None, -5, 0, 1, 32, 2**31, 2**32 - 1, 2**32, 2**40 + 97, *(b << 8 * i for b in range(256) for i in range(4)), *rng.integers(1, 2**33, 2000).tolist()]
    codes += [int.from_bytes(rng.choice([0, 9, 11, 28, 32, 97, 200], 4).astype(np.uint8).tobytes(), "little") for _ in range(500)]

    def tag(n):
        if n is None or n <= 0:
            return None
        return bytes(b for b in (n % 2**32).to_bytes(4, "little") if b < 128).decode().strip(" \t\n\r\x0b\x0c") or None

    df = spark.createDataFrame([(c,) for c in codes], "c long").withColumn("tag", X.fourcc(F.col("c")))
    assert [r.tag for r in df.collect()] == [tag(c) for c in codes]
    assert df._jdf.queryExecution().analyzed().toString().count("c#") <= 6
