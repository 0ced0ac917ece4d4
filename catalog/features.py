from pyspark.sql import functions as F

from catalog import R, query, r6, rounded
from catalog.geometry import POINTS, hands
from catalog.series import FRAMES, USERS, W, frames
from seqatlas.distribution import Sequences, number_rows
from seqatlas.functions import arrays as A
from seqatlas.operators import classes as C, features as FE, joins as J, report as P, sequences as S

K = "CAST(json_extract(props, '$.k') AS DOUBLE)"
BLOCK = 65_536


@query("agg_keypoint_quality", f"""
WITH v AS (SELECT event_type AS dataset, user_id, value / 500 AS pm, {K} / 100 AS hm, abs(value - {K}) / 1000 AS fm, value < 30 AS l, {K} < 40 AS r FROM events),
q AS (SELECT dataset, user_id, count(*) AS frames, avg(pm) AS pose_missing, avg(hm) AS hand_missing, avg(fm) AS face_missing, avg(CAST(l AS INT)) AS ll, avg(CAST(r AS INT)) AS rr, avg(CAST(l AND r AS INT)) AS bb FROM v GROUP BY ALL)
SELECT dataset, {R('avg(frames)')} AS frames, {R('avg(pose_missing)')} AS pose_missing, {R('avg(hand_missing)')} AS hand_missing, {R('avg(face_missing)')} AS face_missing,
  {R('avg(1 - pose_missing)')} AS pose_detection, {R('avg(1 - face_missing)')} AS face_detection, {R('avg(ll)')} AS left_hand_missing_rate, {R('avg(rr)')} AS right_hand_missing_rate,
  {R('avg(bb)')} AS both_hand_missing_rate, {R('avg(1 - bb)')} AS hand_detection_rate, {R('avg(CAST(hand_missing < 0.3 AS INT))')} AS usable
FROM q GROUP BY dataset""")
def agg_keypoint_quality(t):
    k = F.get_json_object("props", "$.k").cast("double")
    rows = t("events").withColumn("dataset", F.col("event_type"))
    missing = {"pose": F.col("value") / 500, "hand": k / 100, "face": F.abs(F.col("value") - k) / 1000}
    q = FE.keypoint_quality(rows, ["dataset", "user_id"], missing=missing, left_missing=F.col("value") < 30, right_missing=k < 40)
    return rounded(FE.corpus_means(q, {c: c for c in q.columns if c not in ("dataset", "user_id")}))


REPORT = {"missing_pose": "l_discount", "missing_face": "l_tax", "detected_pose": "l_quantity", "detected_face": "l_extendedprice", "usable_share": "late"}


@query("agg_quality_report", f"""
SELECT l_returnflag AS dataset, {R('avg(l_discount)')} AS missing_pose, {R('avg(l_tax)')} AS missing_face, {R('avg(l_quantity)')} AS detected_pose,
       {R('avg(l_extendedprice)', 4)} AS detected_face, {R("avg(CAST(l_linestatus = 'O' AS INT))")} AS usable_share FROM lineitem GROUP BY ALL""")
def agg_quality_report(t):
    rows = t("lineitem").withColumn("dataset", F.col("l_returnflag")).withColumn("late", F.col("l_linestatus") == "O")
    out = FE.corpus_means(rows, REPORT)
    return rounded(rounded(out, "detected_face", digits=4), "missing_pose", "missing_face", "detected_pose", "usable_share")


@query("agg_usable_threshold", f"""
SELECT l_returnflag AS dataset, CAST(t AS DOUBLE) AS threshold, {R('avg(CAST(l_discount * 10 < t AS INT))')} AS usable_ratio
FROM lineitem, (VALUES (0.1), (0.3), (0.5), (0.7)) v(t) GROUP BY ALL""")
def agg_usable_threshold(t):
    rows = t("lineitem").select(F.col("l_returnflag").alias("dataset"), (F.col("l_discount") * 10).alias("missing"))
    return rounded(FE.usable_by_threshold(rows, "missing"), "usable_ratio")


@query("agg_frame_quality_rollup", f"""
WITH {FRAMES}, q AS (SELECT *, frame % 4 = 0 AS checked, x > 40 AS hit, CASE WHEN frame % 2 = 0 AND frame > 0 THEN y END AS motion FROM f)
SELECT user_id, count(*) AS processed_frames, count(*) FILTER (checked) AS checked_frames, count(*) FILTER (checked AND hit) AS hand_detected_frames,
   {R('avg(x)')} AS brightness_mean, {R('avg(y)')} AS blur_mean, {R('stddev_pop(y)')} AS blur_std, {R('coalesce(avg(motion), 0)')} AS motion_mean, {R('coalesce(stddev_pop(motion), 0)')} AS motion_std,
   {R('avg(x / 100)')} AS person_area_ratio_mean, {R('stddev_pop(x / 100)')} AS person_area_ratio_std, {R('1 - count(*) FILTER (checked AND hit) * 1.0 / count(*) FILTER (checked)')} AS occlusion_rate
FROM q GROUP BY user_id""")
def agg_frame_quality_rollup(t):
    f, frame = frames(t), F.col("frame")
    rows = f.select(
        "user_id", F.col("x").alias("brightness_mean"), F.col("y").alias("blur"), (F.col("x") / 100).alias("person_area"),
        F.when((frame % 2 == 0) & (frame > 0), F.col("y")).alias("motion"), (frame % 4 == 0).alias("checked"), (F.col("x") > 40).alias("hand_detected"),
    )
    return rounded(FE.frame_quality_rollup(rows, ["user_id"]))


DOCS = """d AS (SELECT CASE WHEN lang IN ('en', 'de') THEN 'A' ELSE 'B' END AS dataset, CAST(n_chars AS DOUBLE) AS length, CAST(doc_id % 97 AS DOUBLE) AS sharpness, CAST((doc_id * 7) % 31 AS DOUBLE) AS motion FROM documents),
l AS (SELECT dataset, unnest(['length', 'sharpness', 'motion']) AS metric, unnest([length, sharpness, motion]) AS v FROM d)"""
DOC_METRICS = ["length", "sharpness", "motion"]


def doc_rows(t):
    return t("documents").select(
        F.when(F.col("lang").isin("en", "de"), "A").otherwise("B").alias("dataset"),
        F.col("n_chars").cast("double").alias("length"), (F.col("doc_id") % 97).cast("double").alias("sharpness"), ((F.col("doc_id") * 7) % 31).cast("double").alias("motion"),
    )


WIDE = ", ".join(f"{f}(v) FILTER (dataset = '{d}') AS {n}_{d}" for d in "AB" for n, f in (("mean", "avg"), ("std", "stddev_samp")))


@query("agg_dataset_quality", f"""
WITH {DOCS}, w AS (SELECT metric, {WIDE} FROM l GROUP BY metric) SELECT metric, {', '.join(f'{R(c)} AS {c}' for c in ('mean_A', 'std_A', 'mean_B', 'std_B'))} FROM w""")
def agg_dataset_quality(t):
    return rounded(FE.side_by_side(FE.corpus_statistics(doc_rows(t), DOC_METRICS), ["A", "B"], ["mean", "std"]))


@query("agg_metric_winner", f"""
WITH {DOCS}, w AS (SELECT metric, {WIDE} FROM l GROUP BY metric)
SELECT metric, {R('mean_A')} AS mean_A, {R('mean_B')} AS mean_B, CASE WHEN CASE WHEN metric IN ('motion') THEN mean_A < mean_B ELSE mean_A > mean_B END THEN 'A' ELSE 'B' END AS winner,
  count(*) OVER (PARTITION BY CASE WHEN CASE WHEN metric IN ('motion') THEN mean_A < mean_B ELSE mean_A > mean_B END THEN 'A' ELSE 'B' END) AS wins FROM w""")
def agg_metric_winner(t):
    wide = FE.side_by_side(FE.corpus_statistics(doc_rows(t), DOC_METRICS), ["A", "B"], ["mean"])
    won = FE.metric_winners(wide, "A", "B", ["motion"])
    return rounded(won.join(FE.winner_score(won), "winner").select("metric", "mean_A", "mean_B", "winner", "wins"))


HANDS = Sequences(("label", "hand"))


def hand_frames(t):
    """Embeddings as frames of one hand sequence per label and side, some frames empty."""
    rows = hands(t).withColumn("hand", F.when(F.col("vec_id") % 2 == 0, "left").otherwise("right"))
    flat = F.when(F.col("vec_id") % 9 == 0, F.transform("flat", lambda v: v * 0.0)).otherwise(F.col("flat"))
    rows = rows.select("label", "hand", "vec_id", flat.alias("flat"))
    return number_rows(rows, ["label", "hand"], ["vec_id"], bucket=F.floor(F.col("vec_id") / BLOCK))


def _sq(a, b):
    return f"sqrt(({a}x-{b}x)*({a}x-{b}x) + ({a}y-{b}y)*({a}y-{b}y) + ({a}z-{b}z)*({a}z-{b}z))"


def _angle_sql(a, b, c):
    u = [f"({a}{i}-{b}{i})" for i in "xyz"]
    v = [f"({c}{i}-{b}{i})" for i in "xyz"]
    dot = lambda p, q: "+".join(f"{x}*{y}" for x, y in zip(p, q))
    return f"degrees(acos(greatest(-1, least(1, ({dot(u, v)}) / (sqrt({dot(u, u)}) * sqrt({dot(v, v)}) + 1e-6)))))"


def handshape_sql() -> str:
    wide = ", ".join(f"max({i}) FILTER (landmark = {k}) AS p{k}{i}" for k in range(21) for i in "xyz")
    cols, names = [], []
    for finger, ids in A.FINGERS.items():
        chain = list(ids) if finger == "thumb" else [0, *ids]
        for i in range(len(chain) - 2):
            cols.append(f"{_angle_sql(*[f'p{k}' for k in chain[i:i + 3]])} AS {finger}_angle_{i + 1}")
            names.append((f"{finger}_angle_{i + 1}", True))
        cols.append(f"{_sq(f'p{ids[-1]}', 'p0')} / sc AS {finger}_tip_wrist_ratio")
        names.append((f"{finger}_tip_wrist_ratio", False))
    for name, (a, b) in FE.SPREADS.items():
        cols.append(f"{_sq(f'p{A.FINGERS[a][-1]}', f'p{A.FINGERS[b][-1]}')} / sc AS {name}_distance_ratio")
        names.append((f"{name}_distance_ratio", True))
    cols.append(f"{_sq('p5', 'p17')} / sc AS palm_width_ratio")
    names.append(("palm_width_ratio", False))
    aggs = ", ".join(f"avg({n}) AS {n}_mean" + (f", stddev_pop({n}) AS {n}_std" if s else "") for n, s in names)
    tips = " + ".join(f"{f}_tip_wrist_ratio_mean" for f in A.FINGERS)
    bends = " + ".join(f"{f}_angle_2_mean" for f in A.FINGERS if f != "thumb")
    out = ", ".join(f"{R(c, 5)} AS {c}" for c in FE.HANDSHAPE_FEATURES if c not in ("openness_mean", "curvature_proxy_mean"))
    return f"""WITH {POINTS}, h AS (SELECT label, CASE WHEN vec_id % 2 = 0 THEN 'left' ELSE 'right' END AS hand, vec_id, {wide}, avg(x) AS cx, avg(y) AS cy, avg(z) AS cz FROM p WHERE vec_id % 9 <> 0 GROUP BY ALL),
s AS (SELECT *, {_sq('p0', 'p9')} + 1e-6 AS sc FROM h), m AS (SELECT label, hand, vec_id, cx, cy, cz, {', '.join(cols)} FROM s),
a AS (SELECT label, hand, count(*) AS nv, {aggs} FROM m GROUP BY ALL),
st AS (SELECT label, hand, sqrt((cx - lag(cx) OVER w) ** 2 + (cy - lag(cy) OVER w) ** 2 + (cz - lag(cz) OVER w) ** 2) AS d FROM m WINDOW w AS (PARTITION BY label, hand ORDER BY vec_id)),
mo AS (SELECT label, hand, coalesce(avg(d), 0) AS motion_magnitude FROM st GROUP BY ALL),
n AS (SELECT label, CASE WHEN vec_id % 2 = 0 THEN 'left' ELSE 'right' END AS hand, count(*) AS nt FROM embeddings GROUP BY ALL),
al AS (SELECT *, nv / nt AS valid_frame_ratio FROM a JOIN mo USING (label, hand) JOIN n USING (label, hand))
SELECT label, hand, {out}, {R(f'({tips}) / 5', 5)} AS openness_mean, {R(f'({bends}) / 4', 5)} AS curvature_proxy_mean FROM al"""


@query("agg_handshape_features", handshape_sql())
def agg_handshape_features(t):
    return rounded(FE.handshape_features(hand_frames(t), HANDS, "flat"), digits=5)


@query("agg_location", f"""
WITH z AS (SELECT event_type AS dataset, user_id, CASE WHEN event_id % 10 = 0 THEN NULL WHEN y <= (n + s) / 2 THEN 'head' WHEN y <= s + 0.12 * abs(h - s) THEN 'shoulder' WHEN y <= (s + h) / 2 THEN 'chest' WHEN y <= h THEN 'waist' ELSE 'below_waist' END AS zone
  FROM (SELECT *, value AS y, 10 AS n, 30 + {K} / 10 AS s, 80 + {K} / 10 AS h FROM events)),
c AS (SELECT dataset, user_id, count(*) AS r, count(zone) AS n, {', '.join(f"count(*) FILTER (zone = '{z}') AS {z}" for z in FE.LOCATIONS)} FROM z GROUP BY ALL)
SELECT dataset, user_id, {R('n / r')} AS valid_frame_ratio, {', '.join(f'{R(f"{z} / n")} AS {z}_ratio' for z in FE.LOCATIONS)},
   CASE greatest({', '.join(FE.LOCATIONS)}) {' '.join(f"WHEN {z} THEN '{z}'" for z in FE.LOCATIONS)} END AS dominant_location
FROM c WHERE n > 0""")
def agg_location(t):
    k = F.get_json_object("props", "$.k").cast("double")
    zone = F.when(F.col("event_id") % 10 != 0, FE.frame_location(F.col("value"), F.lit(10.0), 30 + k / 10, 80 + k / 10))
    rows = t("events").select(F.col("event_type").alias("dataset"), "user_id", zone.alias("zone"))
    return rounded(FE.location_summary(rows, ["dataset", "user_id"], "zone"))


def _axis_sql(v):
    x, y, z = (f"{v}_{a}" for a in "xyz")
    return f"""CASE WHEN abs({x}) >= abs({y}) AND abs({x}) >= abs({z}) THEN CASE WHEN {x} > 0 THEN 'right' ELSE 'left' END
      WHEN abs({y}) >= abs({z}) THEN CASE WHEN {y} > 0 THEN 'down' ELSE 'up' END ELSE CASE WHEN {z} > 0 THEN 'forward' ELSE 'backward' END END"""


def orientation_sql() -> str:
    pick = ", ".join(f"max({i}) FILTER (landmark = {k}) AS p{k}{i}" for k in (0, 5, 12, 17) for i in "xyz")
    order = "['right', 'left', 'down', 'up', 'forward', 'backward']"
    top = lambda c: f"(SELECT q.{c} FROM o q WHERE q.label = o.label GROUP BY q.{c} ORDER BY count(*) DESC, list_position({order}, q.{c}) LIMIT 1)"
    return f"""WITH {POINTS}, h AS (SELECT label, vec_id, {pick} FROM p WHERE vec_id % 9 <> 0 GROUP BY ALL),
d AS (SELECT label, vec_id, p12x-p0x AS fx, p12y-p0y AS fy, p12z-p0z AS fz, (p5y-p0y)*(p17z-p0z)-(p5z-p0z)*(p17y-p0y) AS nx, (p5z-p0z)*(p17x-p0x)-(p5x-p0x)*(p17z-p0z) AS ny, (p5x-p0x)*(p17y-p0y)-(p5y-p0y)*(p17x-p0x) AS nz FROM h),
u AS (SELECT label, vec_id, {', '.join(f'f{a} / (sqrt(fx*fx+fy*fy+fz*fz) + 1e-6) AS finger_dir_{a}, n{a} / (sqrt(nx*nx+ny*ny+nz*nz) + 1e-6) AS palm_normal_{a}' for a in 'xyz')} FROM d),
o AS (SELECT *, {_axis_sql('finger_dir')} AS fl, {_axis_sql('palm_normal')} AS pl FROM u), n AS (SELECT label, count(*) AS nt FROM embeddings GROUP BY ALL)
SELECT label, {R('count(*) / any_value(nt)')} AS valid_frame_ratio, any_value({top('fl')}) AS dominant_finger_direction, any_value({top('pl')}) AS dominant_palm_orientation,
  {', '.join(f'{R(f"avg({v}_{a})")} AS {v}_{a}_mean' for v in ('finger_dir', 'palm_normal') for a in 'xyz')} FROM o JOIN n USING (label) GROUP BY label"""


@query("agg_orientation", orientation_sql())
def agg_orientation(t):
    return rounded(FE.orientation_summary(hand_frames(t), ["label"], "flat"))


@query("agg_activity_type", f"""
WITH {FRAMES}, h AS (SELECT user_id, frame, x, y, CASE WHEN event_type IN ('click', 'view') THEN 'left' ELSE 'right' END AS hand,
        row_number() OVER (PARTITION BY user_id, event_type IN ('click', 'view') ORDER BY frame) AS i FROM f),
v AS (SELECT *, i % 10 < CASE WHEN hand = 'left' THEN user_id % 5 ELSE user_id % 7 END AS ok FROM h),
s AS (SELECT user_id, hand, sqrt((x - lag(x) OVER w) ** 2 + (y - lag(y) OVER w) ** 2) AS d FROM v WHERE ok WINDOW w AS (PARTITION BY user_id, hand ORDER BY frame)),
m AS (SELECT user_id, hand, avg(d) AS m FROM s GROUP BY ALL), r AS (SELECT user_id, hand, avg(CAST(ok AS INT)) AS r FROM v GROUP BY ALL),
a AS (SELECT user_id, max(r) FILTER (hand = 'left') AS lr, max(r) FILTER (hand = 'right') AS rr, max(m) FILTER (hand = 'left') AS lm, max(m) FILTER (hand = 'right') AS rm FROM r LEFT JOIN m USING (user_id, hand) GROUP BY user_id)
SELECT user_id, {R('coalesce(lr, 0)')} AS left_valid_ratio, {R('coalesce(rr, 0)')} AS right_valid_ratio, {R('coalesce(lm, 0)')} AS left_motion_magnitude, {R('coalesce(rm, 0)')} AS right_motion_magnitude,
  CASE WHEN lr >= 0.25 AND lm >= 0.002 AND rr >= 0.25 AND rm >= 0.002 THEN 'two_hand' WHEN lr >= 0.25 AND lm >= 0.002 THEN 'left_one_hand' WHEN rr >= 0.25 AND rm >= 0.002 THEN 'right_one_hand' ELSE 'low_hand_activity' END AS activity_type FROM a""")
def agg_activity_type(t):
    f = frames(t).withColumn("hand", F.when(F.col("event_type").isin("click", "view"), "left").otherwise("right")).drop("frame")
    f = number_rows(f, ["user_id", "hand"], ["event_id"], bucket=F.floor(F.col("event_id") / BLOCK))
    limit = F.when(F.col("hand") == "left", F.col("user_id") % 5).otherwise(F.col("user_id") % 7)
    point = F.when((F.col("frame") + 1) % 10 < limit, F.struct("x", "y", F.lit(0.0).alias("z")))
    steps = S.valid_step_summary(f.withColumn("point", point), Sequences(("user_id", "hand")), "point")
    out = FE.hand_activity(steps, ["user_id"])
    return rounded(out.select("user_id", "left_valid_ratio", "right_valid_ratio", "left_motion_magnitude", "right_motion_magnitude", "activity_type"))


LINE = "li AS (SELECT l_returnflag AS dataset, l_partkey AS gloss, l_orderkey AS video, l_quantity AS quantity, CASE WHEN l_linenumber = 3 THEN NULL ELSE l_discount END AS discount FROM lineitem)"


def line_rows(t):
    discount = F.when(F.col("l_linenumber") == 3, F.lit(float("nan"))).otherwise(F.col("l_discount"))
    return t("lineitem").select(
        F.col("l_returnflag").alias("dataset"), F.col("l_partkey").alias("gloss"), F.col("l_orderkey").alias("video"), F.col("l_quantity").alias("quantity"), discount.alias("discount")
    )


@query("agg_video_mean", f"WITH {LINE} SELECT dataset, gloss, video, {R('avg(quantity)')} AS quantity, {R('avg(discount)')} AS discount FROM li GROUP BY ALL")
def agg_video_mean(t):
    return rounded(FE.mean_by(line_rows(t), ["dataset", "gloss", "video"], ["quantity", "discount"]))


@query("agg_label_mean", f"WITH {LINE} SELECT dataset, gloss, {R('avg(quantity)')} AS quantity, {R('avg(discount)')} AS discount FROM li GROUP BY ALL")
def agg_label_mean(t):
    return rounded(FE.mean_by(line_rows(t), ["dataset", "gloss"], ["quantity", "discount"]))


@query("agg_gloss_summary", f"""
WITH {LINE} SELECT dataset, gloss, count(*) AS sample_count, {R('avg(quantity)')} AS quantity__mean, {R('avg(discount)')} AS discount__mean,
   {R('coalesce(stddev_pop(quantity), 0)')} AS quantity__std, {R('coalesce(stddev_pop(discount), 0)')} AS discount__std FROM li GROUP BY ALL""")
def agg_gloss_summary(t):
    return rounded(FE.label_summary(line_rows(t), ["quantity", "discount"]))


@query("agg_sequence_length", f"""
WITH n AS (SELECT event_type AS dataset, user_id % 10 AS label, user_id, count(*) AS n FROM events GROUP BY ALL)
SELECT dataset, label, count(*) AS num_samples, {R('avg(n)')} AS mean_frames, {R('stddev_pop(n)')} AS std_frames, CAST(min(n) AS DOUBLE) AS min_frames, CAST(max(n) AS DOUBLE) AS max_frames, {R('var_pop(n)')} AS sequence_length_variance
FROM n GROUP BY ALL""")
def agg_sequence_length(t):
    rows = t("events").groupBy(F.col("event_type").alias("dataset"), (F.col("user_id") % 10).alias("label"), "user_id").agg(F.count(F.lit(1)).alias("num_frames"))
    return rounded(FE.sequence_length(rows, ["dataset", "label"]), "mean_frames", "std_frames", "sequence_length_variance")


MEANS = {"mean_total_motion": "l_quantity", "mean_velocity": "l_discount", "acceleration_mean": "l_tax"}


@query("agg_label_motion", f"""
SELECT l_returnflag AS dataset, l_partkey AS label, count(*) AS num_samples, {', '.join(f'{R(f"avg({c})")} AS {n}' for n, c in MEANS.items())},
   {R('stddev_samp(l_quantity)')} AS std_total_motion, {R('var_pop(l_linenumber)')} AS sequence_length_variance FROM lineitem GROUP BY ALL""")
def agg_label_motion(t):
    rows = t("lineitem").withColumns({"dataset": F.col("l_returnflag"), "label": F.col("l_partkey")})
    return rounded(FE.label_motion(rows, ["dataset", "label"], MEANS, total="l_quantity", frames="l_linenumber"))


SCORED = ["quantity", "discount", "sd", "flat"]
COMPLEX = f"""{LINE}, m AS (SELECT dataset, gloss, avg(quantity) AS quantity, avg(discount) AS discount, stddev_samp(quantity) AS sd, 1.0 AS flat FROM li GROUP BY ALL),
sp AS (SELECT dataset, {', '.join(f'min({c}) AS lo_{c}, max({c}) AS hi_{c}, count({c}) AS n_{c}' for c in SCORED)} FROM m GROUP BY dataset),
sc AS (SELECT m.*, ({' + '.join(f'CASE WHEN n_{c} >= 2 AND hi_{c} > lo_{c} THEN coalesce((m.{c} - lo_{c}) / (hi_{c} - lo_{c}), 0) ELSE 0 END' for c in SCORED)}) /
   greatest(1, {' + '.join(f'CAST(n_{c} >= 2 AND hi_{c} > lo_{c} AS INT)' for c in SCORED)}) AS score FROM m JOIN sp USING (dataset))"""


def complexity(t):
    rows = line_rows(t)
    means = FE.mean_by(rows, ["dataset", "gloss"], ["quantity", "discount"])
    spread = rows.groupBy("dataset", "gloss").agg(F.stddev_samp("quantity").alias("sd"))
    return FE.complexity_score(means.join(spread, ["dataset", "gloss"]).withColumn("flat", F.lit(1.0)), SCORED, into="score")


@query("agg_complexity_score", f"WITH {COMPLEX} SELECT dataset, gloss, {R('score')} AS score FROM sc")
def agg_complexity_score(t):
    return rounded(complexity(t).select("dataset", "gloss", "score"))


LONG = """l AS (SELECT l_returnflag AS dataset, unnest(['quantity', 'price', 'discount']) AS metric, unnest([l_quantity, l_extendedprice, CASE WHEN l_linenumber = 3 THEN NULL ELSE l_discount END]) AS v FROM lineitem)"""


def metric_rows(t):
    discount = F.when(F.col("l_linenumber") == 3, F.lit(float("nan"))).otherwise(F.col("l_discount"))
    return t("lineitem").select(F.col("l_returnflag").alias("dataset"), F.col("l_quantity").alias("quantity"), F.col("l_extendedprice").alias("price"), discount.alias("discount"))


@query("agg_dataset_summary", f"""
WITH {LONG} SELECT metric, dataset, count(v) AS count, {R('avg(v)', 4)} AS mean, {R('stddev_pop(v)', 4)} AS std, {R('median(v)')} AS median,
   {R('quantile_cont(v, 0.25)')} AS q1, {R('quantile_cont(v, 0.75)')} AS q3, {R('min(v)')} AS min, {R('max(v)')} AS max FROM l GROUP BY ALL""")
def agg_dataset_summary(t):
    out = FE.corpus_summary(metric_rows(t), ["quantity", "price", "discount"])
    return rounded(rounded(out, "mean", "std", digits=4), "median", "q1", "q3", "min", "max")


@query("rpt_length_profile", f"""
SELECT lang AS dataset, count(*) AS videos, count(DISTINCT source) AS labels, {R('avg(n_chars)')} AS mean_frames, {R('median(n_chars)')} AS median_frames,
   {R('quantile_cont(n_chars, 0.95)')} AS p95_frames, {R('max(n_chars)')} AS max_frames FROM documents GROUP BY ALL""")
def rpt_length_profile(t):
    rows = t("documents").select(F.col("lang").alias("dataset"), F.col("source").alias("label"), F.col("n_chars").alias("num_frames"))
    return rounded(P.length_profile(rows))


@query("rpt_metric_ratio", f"""
WITH {DOCS}, w AS (SELECT metric, {WIDE} FROM l GROUP BY metric)
SELECT metric, {R('mean_A')} AS mean_a, {R('mean_B')} AS mean_b, {R('mean_B - mean_A')} AS difference, {R('mean_B / nullif(mean_A, 0)')} AS ratio,
  CASE WHEN mean_A > mean_B THEN 'A' WHEN mean_B > mean_A THEN 'B' ELSE 'equal' END AS higher FROM w""")
def rpt_metric_ratio(t):
    return rounded(P.metric_ratios(FE.corpus_statistics(doc_rows(t), DOC_METRICS), "A", "B"))


@query("rpt_landmark_quality", f"""
SELECT l_returnflag AS dataset, {R('avg(l_discount)')} AS hand_missing, {R('avg(l_tax)')} AS face_missing, {R('avg(CAST(l_quantity >= 3 AS INT))')} AS usable_share FROM lineitem GROUP BY ALL""")
def rpt_landmark_quality(t):
    rows = t("lineitem").withColumns({"dataset": F.col("l_returnflag"), "usable": F.col("l_quantity") >= 3})
    return rounded(FE.corpus_means(rows, {"hand_missing": "l_discount", "face_missing": "l_tax", "usable_share": "usable"}))


@query("rpt_worst_labels", f"""
WITH {COMPLEX}, r AS (SELECT 'missing' AS list, dataset, gloss, discount AS value, row_number() OVER (PARTITION BY dataset ORDER BY round(CAST(discount AS DOUBLE), 9) DESC NULLS LAST, gloss) AS place FROM sc
   UNION ALL SELECT 'complex', dataset, gloss, score, row_number() OVER (PARTITION BY dataset ORDER BY round(CAST(score AS DOUBLE), 9) DESC NULLS LAST, gloss) FROM sc)
SELECT list, dataset, CAST(place AS INTEGER) AS place, gloss, {R('value')} AS value FROM r WHERE place <= CASE list WHEN 'missing' THEN 8 ELSE 10 END""")
def rpt_worst_labels(t):
    return rounded(P.worst_labels(complexity(t), {"missing": ("discount", 8, True), "complex": ("score", 10, True)}, label="gloss"))
