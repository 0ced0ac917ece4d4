from pyspark.sql import functions as F

from catalog import R, query, r6, rounded
from seqatlas.distribution import Sequences, number_rows
from seqatlas.functions import arrays as A
from seqatlas.operators import sequences as S
from seqatlas.session import cut_lineage

# Short chunks, so that sequences of a few dozen frames already cross borders.
USERS = Sequences(("user_id",), chunk_rows=48)
BLOCK = 65_536

K = "CAST(json_extract(props, '$.k') AS DOUBLE)"
FRAMES = f"""f AS (SELECT user_id, event_id, event_type, value AS x, {K} AS y, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS frame FROM events),
g AS (SELECT *, NOT (frame % 25 BETWEEN 3 AND 13 OR frame % 25 IN (18, 19) OR frame < user_id % 4) AS lv, frame % 7 > 1 AS rv FROM f)"""
W = "(PARTITION BY user_id ORDER BY frame)"


def frames(t):
    """Events as frames of one sequence per user, with planted gaps on both hands."""
    k = F.get_json_object("props", "$.k").cast("double")
    rows = t("events").select("user_id", "event_id", "event_type", F.col("value").alias("x"), k.alias("y"))
    f = number_rows(rows, ["user_id"], ["event_id"], bucket=F.floor(F.col("event_id") / BLOCK))
    p = F.col("frame") % 25
    f = f.withColumn("lv", ~(p.between(3, 13) | p.isin(18, 19) | (F.col("frame") < F.col("user_id") % 4)))
    f = f.withColumn("rv", F.col("frame") % 7 > 1)
    point = lambda a, b: F.struct(F.col(a).alias("x"), F.col(b).alias("y"), F.lit(0.0).alias("z"))
    return f.withColumn("left", F.when(F.col("lv"), point("x", "y"))).withColumn("right", F.when(F.col("rv"), point("y", "x")))


def step_sql(ok, x="x", y="y"):
    return f"""CASE WHEN {ok} AND lag({ok}) OVER {W} THEN sqrt(({x} - lag({x}) OVER {W}) ** 2 + ({y} - lag({y}) OVER {W}) ** 2) END"""


@query("ts_step_distance", f"WITH {FRAMES} SELECT user_id, frame, {R(step_sql('lv'))} AS step FROM g")
def ts_step_distance(t):
    return rounded(S.step_distance(frames(t), USERS, "left").select("user_id", "frame", "step"))


@query("ts_step_valid_only", f"""
WITH {FRAMES}, v AS (SELECT user_id, sqrt((x - lag(x) OVER {W}) ** 2 + (y - lag(y) OVER {W}) ** 2) AS d FROM g WHERE lv),
s AS (SELECT user_id, avg(d) AS m, sum(d) AS s, stddev_pop(d) AS sd FROM v GROUP BY user_id), n AS (SELECT user_id, avg(CAST(lv AS INT)) AS r FROM g GROUP BY user_id)
SELECT user_id, {R('r')} AS valid_frame_ratio, {R('coalesce(m, 0)')} AS motion_magnitude, {R('coalesce(s, 0)')} AS trajectory_length, {R('coalesce(sd, 0)')} AS motion_std
FROM n LEFT JOIN s USING (user_id)""")
def ts_step_valid_only(t):
    return rounded(S.valid_step_summary(frames(t), USERS, "left"))


MOTION = f"""m AS (SELECT *, {step_sql('lv')} AS ld, {step_sql('rv', 'y', 'x')} AS rd FROM g),
mm AS (SELECT *, CASE WHEN coalesce(ld, rd) IS NOT NULL THEN coalesce(ld, 0) + coalesce(rd, 0) END AS motion FROM m)"""


@query("ts_two_hand_motion", f"WITH {FRAMES}, {MOTION} SELECT user_id, frame, {R('motion')} AS motion FROM mm")
def ts_two_hand_motion(t):
    return rounded(S.two_hand_motion(frames(t), USERS, "left", "right").select("user_id", "frame", "motion"))


@query("ts_velocity_accel", f"""
WITH {FRAMES}, v AS (SELECT user_id, frame, CASE WHEN lv THEN x END * CASE WHEN user_id % 3 > 0 THEN user_id % 3 * 10 ELSE 1 END AS v FROM g),
a AS (SELECT *, v - lag(v) OVER {W} AS a FROM v)
SELECT user_id, {R('avg(v)')} AS mean_velocity, {R('max(v)')} AS max_velocity, {R('stddev_pop(v)')} AS velocity_std,
       {R('avg(abs(a))')} AS mean_acceleration, {R('max(abs(a))')} AS max_acceleration, {R('stddev_pop(a)')} AS acceleration_std
FROM a GROUP BY user_id""")
def ts_velocity_accel(t):
    f = frames(t).withColumn("motion", F.when(F.col("lv"), F.col("x")))
    v = S.velocity_acceleration(f, USERS, "motion", F.col("user_id") % 3 * 10.0)
    return rounded(S.kinematics_summary(v, ["user_id"]))


def trajectory_sql(source: str, key: str = "user_id", x: str = "px", y: str = "py") -> str:
    """CTEs that end in ``traj`` from rows (key, frame, px, py) with NULL gaps."""
    w = f"(PARTITION BY {key} ORDER BY frame)"
    return f"""t1 AS (SELECT *, CASE WHEN frame - lag(frame) OVER {w} = 1 THEN true ELSE false END AS adj, {x} - lag({x}) OVER {w} AS dx, {y} - lag({y}) OVER {w} AS dy FROM {source} WHERE {x} IS NOT NULL),
t2 AS (SELECT *, sqrt(dx*dx + dy*dy) AS d FROM t1),
t3 AS (SELECT {key}, dx*lag(dx) OVER {w} + dy*lag(dy) OVER {w} AS dot, d * lag(d) OVER {w} AS den FROM t2 WHERE d > 1e-8),
t4 AS (SELECT {key}, count(*) FILTER (degrees(acos(greatest(-1, least(1, dot / greatest(den, 1e-8))))) > 45) AS changes FROM t3 GROUP BY {key}),
t5 AS (SELECT {key}, count(*) AS n, sum(d) FILTER (adj) AS path, sqrt((arg_max({x}, frame) - arg_min({x}, frame)) ** 2 + (arg_max({y}, frame) - arg_min({y}, frame)) ** 2) AS disp,
       (max({x}) - min({x})) * (max({y}) - min({y})) AS area FROM t2 GROUP BY {key}),
traj AS (SELECT {key}, path AS path_length, CASE WHEN n >= 2 THEN disp END AS displacement, CASE WHEN n >= 2 AND path > 1e-8 THEN disp / path END AS straightness,
       CASE WHEN n >= 2 THEN CAST(coalesce(changes, 0) AS DOUBLE) END AS direction_changes, CASE WHEN n >= 2 THEN area END AS bbox_area FROM t5 LEFT JOIN t4 USING ({key}))"""


TRAJ_COLS = ("path_length", "displacement", "straightness", "direction_changes", "bbox_area")


@query("ts_trajectory_stats", f"""
WITH {FRAMES}, p AS (SELECT user_id, frame, CASE WHEN lv THEN x END AS px, CASE WHEN lv THEN y END AS py FROM g), {trajectory_sql('p')}
SELECT user_id, {', '.join(f'{R(c)} AS {c}' for c in TRAJ_COLS)} FROM traj""")
def ts_trajectory_stats(t):
    return rounded(S.trajectory_stats(frames(t), USERS, "left"))


def fill_sql(x: str, ok: str, gap: int | None) -> str:
    """Linear fill of ``x`` from the columns pf, pv, nf, nv (neighbours) and T, n."""
    rule = "pf IS NOT NULL AND nf IS NOT NULL" if gap is None else f"n >= 2 AND coalesce(nf, T) - coalesce(pf, -1) - 1 <= {gap}"
    return f"CASE WHEN {ok} THEN {x} WHEN {rule} THEN CASE WHEN pf IS NULL THEN nv WHEN nf IS NULL THEN pv ELSE pv + (nv - pv) / (nf - pf) * (frame - pf) END END"


def neighbours_sql(source: str, x: str, ok: str) -> str:
    return f"""SELECT *, max(CASE WHEN {ok} THEN frame END) OVER ({W[1:-1]} ROWS UNBOUNDED PRECEDING) AS pf, last_value(CASE WHEN {ok} THEN {x} END IGNORE NULLS) OVER ({W[1:-1]} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS pv,
       min(CASE WHEN {ok} THEN frame END) OVER ({W[1:-1]} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS nf, first_value(CASE WHEN {ok} THEN {x} END IGNORE NULLS) OVER ({W[1:-1]} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS nv,
       count(*) OVER (PARTITION BY user_id) AS T, count(CASE WHEN {ok} THEN 1 END) OVER (PARTITION BY user_id) AS n FROM {source}"""


@query("ts_interpolate_gap", f"""
WITH {FRAMES}, ax AS ({neighbours_sql('g', 'x', 'lv')}), ay AS ({neighbours_sql('g', 'y', 'lv')}),
fx AS (SELECT user_id, frame, {fill_sql('x', 'lv', 8)} AS x FROM ax), fy AS (SELECT user_id, frame, {fill_sql('y', 'lv', 8)} AS y FROM ay)
SELECT user_id, frame, {R('fx.x')} AS x, {R('fy.y')} AS y FROM fx JOIN fy USING (user_id, frame)""")
def ts_interpolate_gap(t):
    out = S.interpolate_gaps(frames(t), USERS, ["left"])
    return rounded(out.select("user_id", "frame", F.col("left.x").alias("x"), F.col("left.y").alias("y")))


@query("ts_interpolate_interior", f"""
WITH {FRAMES}, ax AS ({neighbours_sql('g', 'x', 'lv')}),
e AS (SELECT user_id, max(frame) AS last, avg(y) FILTER (lv) AS mean FROM g GROUP BY user_id),
h AS (SELECT g.user_id, frame, CASE WHEN lv THEN y WHEN frame IN (0, last) THEN mean END AS yy, lv OR frame IN (0, last) AS ok FROM g JOIN e USING (user_id)),
ay AS ({neighbours_sql('h', 'yy', 'ok')})
SELECT user_id, frame, {R(fill_sql('ax.x', 'lv', None).replace('pf', 'ax.pf').replace('pv', 'ax.pv').replace('nf', 'ax.nf').replace('nv', 'ax.nv'))} AS x,
       (SELECT {R(fill_sql('yy', 'ok', None).replace('frame', 'ay.frame'))} FROM ay WHERE ay.user_id = ax.user_id AND ay.frame = ax.frame) AS y FROM ax""")
def ts_interpolate_interior(t):
    f = frames(t).select("user_id", "frame", *[F.when(F.col("lv"), F.col(c)).alias(c) for c in "xy"])
    plain = S.interpolate_interior(f, USERS, ["x"]).select("user_id", "frame", "x")
    seeded = S.interpolate_interior(f, USERS, ["y"], seed_edges=True).select("user_id", "frame", "y")
    return rounded(plain.join(seeded, ["user_id", "frame"]))


@query("ts_resample_linear", f"""
WITH e AS (SELECT vec_id AS user_id, CAST(k AS BIGINT) AS frame, CAST(embedding[k+1] AS DOUBLE) AS x, (vec_id + k) % 6 <> 0 AS lv, CASE WHEN vec_id % 50 = 0 THEN k = 5 ELSE true END AS rv FROM embeddings, range(64) t(k)),
i AS (SELECT CAST(i AS BIGINT) AS i, i * 63 // 29 AS lo, (i * 63 % 29) / 29.0 AS fr FROM range(30) t(i)),
a AS (SELECT *, last_value(CASE WHEN lv THEN frame END IGNORE NULLS) OVER b AS pf, last_value(CASE WHEN lv THEN x END IGNORE NULLS) OVER b AS pv,
        first_value(CASE WHEN lv THEN frame END IGNORE NULLS) OVER c AS nf, first_value(CASE WHEN lv THEN x END IGNORE NULLS) OVER c AS nv,
        last_value(CASE WHEN rv THEN frame END IGNORE NULLS) OVER b AS qf, last_value(CASE WHEN rv THEN x END IGNORE NULLS) OVER b AS qv,
        first_value(CASE WHEN rv THEN frame END IGNORE NULLS) OVER c AS mf, first_value(CASE WHEN rv THEN x END IGNORE NULLS) OVER c AS mv
      FROM e WINDOW b AS (PARTITION BY user_id ORDER BY frame ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), c AS (PARTITION BY user_id ORDER BY frame ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING))
SELECT user_id AS vec_id, i AS frame,
  {R('CASE WHEN pf = lo AND fr = 0 THEN pv WHEN pf IS NULL THEN nv WHEN nf IS NULL THEN pv ELSE pv + (nv - pv) / (nf - pf) * (lo + fr - pf) END')} AS x,
  {R('CASE WHEN qf = lo AND fr = 0 THEN qv WHEN qf IS NULL THEN mv WHEN mf IS NULL THEN qv ELSE qv + (mv - qv) / (mf - qf) * (lo + fr - qf) END')} AS y
FROM a JOIN i ON frame = lo""")
def ts_resample_linear(t):
    rows = t("embeddings").select("vec_id", F.posexplode("embedding").alias("frame", "v")).withColumn("v", F.col("v").cast("double"))
    x = F.when((F.col("vec_id") + F.col("frame")) % 6 != 0, F.col("v"))
    y = F.when((F.col("vec_id") % 50 != 0) | (F.col("frame") == 5), F.col("v"))
    rows = rows.select("vec_id", F.col("frame").cast("long").alias("frame"), x.alias("x"), y.alias("y"))
    return rounded(S.resample_linear(rows, Sequences(("vec_id",)), ["x", "y"], 30))


@query("ts_resample_nearest", f"""
WITH {FRAMES}, n AS (SELECT user_id, count(*) AS t, greatest(60, count(*) - 15) AS n FROM f GROUP BY user_id),
i AS (SELECT user_id, CAST(i AS BIGINT) AS i, CAST(CASE WHEN t = n THEN i WHEN i = n - 1 THEN t - 1 ELSE round_even(i * ((t - 1) / (n - 1)), 0) END AS BIGINT) AS src FROM n, range(500) r(i) WHERE i < n)
SELECT i.user_id, i AS frame, src AS source_frame, event_id FROM i JOIN f ON f.user_id = i.user_id AND f.frame = src""")
def ts_resample_nearest(t):
    wanted = lambda length: F.greatest(F.lit(60), length - 15)
    return S.resample_nearest(frames(t).select("user_id", "frame", "event_id"), USERS, wanted)


@query("ts_sample_frames", f"""
WITH {FRAMES}, n AS (SELECT user_id, count(*) AS t FROM f GROUP BY user_id),
i AS (SELECT DISTINCT user_id, CAST(CASE WHEN i = 23 THEN t - 1 ELSE floor(i * ((t - 1) / 23.0)) END AS BIGINT) AS frame FROM n, range(24) r(i) WHERE t > 24
      UNION SELECT f.user_id, frame FROM f JOIN n USING (user_id) WHERE t <= 24)
SELECT user_id, frame, event_id, CAST(row_number() OVER {W} - 1 AS INTEGER) AS sample_pos, (row_number() OVER {W} - 1) % 4 = 0 AS checked FROM i JOIN f USING (user_id, frame)""")
def ts_sample_frames(t):
    s = S.sample_frames(frames(t).select("user_id", "frame", "event_id"), USERS)
    return s.withColumn("checked", F.col("sample_pos") % 4 == 0)


def score_sql(ok, x="x", y="y"):
    d = lambda f: f"CASE WHEN {ok} AND {f}({ok}) OVER {W} THEN sqrt(({x} - {f}({x}) OVER {W}) ** 2 + ({y} - {f}({y}) OVER {W}) ** 2) ELSE 0 END"
    return f"greatest(coalesce({d('lag')}, 0), coalesce({d('lead')}, 0))"


@query("ts_motion_score", f"WITH {FRAMES} SELECT user_id, frame, {R(score_sql('lv'))} AS left_motion, {R(score_sql('rv', 'y', 'x'))} AS right_motion FROM g")
def ts_motion_score(t):
    out = S.motion_score(frames(t), USERS, {"left_motion": ("left", "lv"), "right_motion": ("right", "rv")})
    return rounded(out.select("user_id", "frame", "left_motion", "right_motion"))


@query("ts_action_trim", f"""
WITH {FRAMES}, a AS (SELECT user_id, frame, event_id,
   CASE WHEN user_id % 4 IN (0, 3) THEN false ELSE x > 60 AND frame BETWEEN 10 + user_id % 30 AND 40 END AS m,
   CASE WHEN user_id % 4 = 3 THEN false ELSE frame BETWEEN 20 AND 22 END AS h, user_id % 8 = 3 AND y > 50 AS p FROM f),
b AS (SELECT user_id, count(*) AS t, coalesce(min(frame) FILTER (m), min(frame) FILTER (h), min(frame) FILTER (p)) AS f0,
   coalesce(max(frame) FILTER (m), max(frame) FILTER (h), max(frame) FILTER (p)) AS f1 FROM a GROUP BY user_id),
s AS (SELECT *, greatest(0, f0 - 3) AS s0, least(t, f1 + 4) AS e0 FROM b),
w AS (SELECT *, 12 - (e0 - s0) AS lack, NOT (e0 - s0 >= 12 OR t <= e0 - s0) AS short FROM s),
v AS (SELECT *, CASE WHEN short THEN greatest(0, s0 - lack // 2) ELSE s0 END AS s1, CASE WHEN short THEN least(t, e0 + lack - lack // 2) ELSE e0 END AS e1 FROM w),
z AS (SELECT user_id, t, CASE WHEN f0 IS NULL THEN 0 WHEN short AND e1 - s1 < 12 AND s1 <> 0 AND e1 = t THEN greatest(0, t - 12) ELSE s1 END AS trim_start,
        CASE WHEN f0 IS NULL THEN t WHEN short AND e1 - s1 < 12 AND s1 = 0 THEN least(t, 12) ELSE e1 END AS trim_end FROM v)
SELECT user_id, event_id, CAST(frame - trim_start AS BIGINT) AS frame, CAST(trim_start AS BIGINT) AS trim_start, CAST(t - trim_end AS BIGINT) AS trimmed_end
FROM a JOIN z USING (user_id) WHERE frame >= trim_start AND frame < trim_end""")
def ts_action_trim(t):
    u, f = F.col("user_id"), F.col("frame")
    moving = ~(u % 4).isin(0, 3) & (F.col("x") > 60) & f.between(10 + u % 30, F.lit(40))
    rows = frames(t).select(
        "user_id", "frame", "event_id",
        F.when(moving, 1.0).otherwise(0.0).alias("left_motion"), F.lit(0.0).alias("right_motion"),
        F.when((u % 8 == 3) & (F.col("y") > 50), 1.0).otherwise(0.0).alias("pose_motion"),
        ((u % 4 != 3) & f.between(20, 22)).alias("hand_present"),
    )
    return S.action_trim(rows, USERS).select("user_id", "event_id", "frame", "trim_start", "trimmed_end")


@query("ts_hand_side_stabilise", f"""
WITH {FRAMES}, s AS (SELECT user_id, frame, event_id, x, y, CASE WHEN user_id % 3 = 0 THEN frame % 3 > 0 ELSE event_type IN ('click', 'view', 'error', 'signup') END AS l,
       CASE WHEN user_id % 2 = 0 THEN event_type = 'purchase' AND frame % 2 = 0 ELSE frame % 9 < 2 END AS r FROM f),
c AS (SELECT user_id, count(*) FILTER (l) AS nl, count(*) FILTER (r) AS nr FROM s GROUP BY user_id),
a AS (SELECT *, least(nl, nr) > 0 AND least(nl, nr) / greatest(nl, nr) <= 0.2 AS act FROM c),
d AS (SELECT *, act AND nl >= nr AS tl, act AND nl < nr AS tr FROM s JOIN a USING (user_id))
SELECT user_id, frame, CASE WHEN tl AND r AND NOT l THEN CASE WHEN r THEN y END WHEN tr AND l THEN NULL WHEN l THEN x END AS left_value,
   CASE WHEN tr AND l AND NOT r THEN CASE WHEN l THEN x END WHEN tl AND r THEN NULL WHEN r THEN y END AS right_value,
   CASE WHEN tl THEN l OR r WHEN tr THEN false ELSE l END AS lv, CASE WHEN tr THEN l OR r WHEN tl THEN false ELSE r END AS rv, (tl AND r) OR (tr AND l) AS side_stabilised
FROM d""")
def ts_hand_side_stabilise(t):
    u, f = F.col("user_id"), F.col("frame")
    l = F.when(u % 3 == 0, f % 3 > 0).otherwise(F.col("event_type").isin("click", "view", "error", "signup"))
    r = F.when(u % 2 == 0, (F.col("event_type") == "purchase") & (f % 2 == 0)).otherwise(f % 9 < 2)
    rows = frames(t).select("user_id", "frame", l.alias("lv"), r.alias("rv"), F.when(l, F.col("x")).alias("left_value"), F.when(r, F.col("y")).alias("right_value"))
    return S.stabilise_sides(rows, USERS, left_valid="lv", right_valid="rv", moves=[("left_value", "right_value")])


def stored_frames(t):
    """Stored frames made of events (order, flags) and embedding values (coordinates)."""
    vectors = t("embeddings").withColumn("e", F.transform("embedding", lambda v: v.cast("double")))
    size = vectors.agg(F.count(F.lit(1)).alias("n")).scalar()
    f = frames(t).withColumn("vec_id", F.col("event_id") % size)
    f = f.withColumn("rv", F.when(F.col("user_id") % 3 == 0, F.col("frame") % 9 == 4).otherwise(F.col("rv")))
    stored = f.join(vectors.select("vec_id", "e"), "vec_id")
    repeat = lambda width: F.slice(F.concat(*["e"] * (width // 64 + 1)), 1, width)
    zero = lambda ok, a: F.when(ok, a).otherwise(F.array_repeat(F.lit(0.0), 63))
    hand = F.slice("e", 1, 63)
    return stored.select(
        "user_id", "frame", repeat(330).alias("pose"),
        F.concat(zero(F.col("lv"), hand), zero(F.col("rv"), hand), zero(F.col("lv"), hand), zero(F.col("rv"), hand)).alias("hands"),
        repeat(52).alias("face"), repeat(36).alias("mouth"),
        (F.col("frame") % 11 != 5).alias("v_pose"), F.col("lv").alias("v_left"), F.col("rv").alias("v_right"), F.lit(True).alias("v_face"),
    )


def _flat_step_sql(ok: str, points: int, stride: int, first: int) -> str:
    """Mean step of points of the repeated vector ``e``, between a frame and the one before."""
    d = lambda i: f"(e[({first} + k * {stride} + {i}) % 64 + 1] - b[({first} + k * {stride} + {i}) % 64 + 1])"
    apart = f"sqrt({d(0)} * {d(0)} + {d(1)} * {d(1)} + {d(2)} * {d(2)})"
    return f"coalesce(CASE WHEN {ok} AND lag({ok}) OVER {W} THEN list_sum([{apart} FOR k IN range({points})]) / {points} END, 0)"


def _anchored_total_sql(width: int, stride: int, start: int, origin: tuple[int, int], reach: tuple[int, int] | None) -> str:
    """Sum of the absolute values of one anchored block of the repeated vector ``e``."""
    at = lambda k, i: f"e[({start} + {k * stride + i}) % 64 + 1]"
    middle = lambda pair, i: f"(({at(pair[0], i)} + {at(pair[1], i)}) * 0.5)"
    gap = [f"({at(origin[1], i)} - {at(origin[0], i)})" if reach is None else f"({middle(reach, i)} - {middle(origin, i)})" for i in range(3)]
    unit = "sqrt(" + " + ".join(f"{g} * {g}" for g in gap) + ")"
    shifts = "[" + ", ".join([middle(origin, i) for i in range(3)] + ["0.0"] * (stride - 3)) + "]"
    value = f"e[({start} + j) % 64 + 1]"
    content = f"list_max([CASE WHEN j % {stride} < 3 THEN abs({value}) ELSE 0 END FOR j IN range({width})]) > 1e-6"
    moved = f"list_sum([abs(({value} - {shifts}[j % {stride} + 1]) / CASE WHEN j % {stride} < 3 THEN {unit} ELSE 1 END) FOR j IN range({width})])"
    return f"CASE WHEN {content} AND {unit} > 1e-6 THEN {moved} ELSE list_sum([abs({value}) FOR j IN range({width})]) END"


def preprocess_sql() -> str:
    """CTEs that end in ``done`` (one row per output frame)."""
    zeros = "[0.0 FOR k IN range(63)]"
    near = lambda side: f"""last_value(CASE WHEN {side}_ok THEN frame END IGNORE NULLS) OVER back AS {side}_pf, last_value(CASE WHEN {side}_ok THEN {side} END IGNORE NULLS) OVER back AS {side}_pv,
   first_value(CASE WHEN {side}_ok THEN frame END IGNORE NULLS) OVER ahead AS {side}_nf, first_value(CASE WHEN {side}_ok THEN {side} END IGNORE NULLS) OVER ahead AS {side}_nv"""
    filled = lambda side: f"""CASE WHEN {side}_pf < frame AND {side}_nf IS NOT NULL THEN [{side}_pv[k + 1] + ({side}_nv[k + 1] - {side}_pv[k + 1]) * ((frame - {side}_pf) / ({side}_nf - {side}_pf)) FOR k IN range(63)] ELSE {side} END"""
    total = lambda side: f"list_sum([abs(h{side}[k + 1] - CASE WHEN list_max([abs(x) FOR x IN h{side}]) > 1e-6 THEN h{side}[k % 3 + 1] ELSE 0 END) FOR k IN range(63)])"
    pose = " + ".join(_anchored_total_sql(165, 5, s, (11, 12), (7, 8)) for s in (0, 165))
    return f"""{FRAMES},
e AS (SELECT vec_id, [CAST(x AS DOUBLE) FOR x IN embedding] AS e FROM embeddings),
h AS MATERIALIZED (SELECT g.user_id, frame, frame % 11 <> 5 AS pok, lv, CASE WHEN user_id % 3 = 0 THEN frame % 9 = 4 ELSE rv END AS rv, e FROM g JOIN e ON vec_id = event_id % (SELECT count(*) FROM embeddings)),
b AS (SELECT *, lag(e) OVER {W} AS b FROM h),
d AS (SELECT *, {_flat_step_sql('lv', 21, 3, 0)} AS ls, {_flat_step_sql('rv', 21, 3, 0)} AS rs, {_flat_step_sql('pok', 6, 5, 55)} AS ps FROM b),
m AS (SELECT *, {', '.join(f"greatest({x}s, coalesce(lead({x}s) OVER {W}, 0)) AS {x}m" for x in 'lrp')} FROM d),
a AS (SELECT user_id, count(*) AS t, max(greatest(lm, rm)) AS max_hand_motion, max(pm) AS max_pose_motion,
   coalesce(min(frame) FILTER (lm > 0.008 OR rm > 0.008), min(frame) FILTER (lv OR rv), min(frame) FILTER (pm > 0.006)) AS f0,
   coalesce(max(frame) FILTER (lm > 0.008 OR rm > 0.008), max(frame) FILTER (lv OR rv), max(frame) FILTER (pm > 0.006)) AS f1 FROM m GROUP BY user_id),
s AS (SELECT *, greatest(0, f0 - 3) AS s0, least(t, f1 + 4) AS e0 FROM a),
w AS (SELECT *, 12 - (e0 - s0) AS lack, NOT (e0 - s0 >= 12 OR t <= e0 - s0) AS short FROM s),
v AS (SELECT *, CASE WHEN short THEN greatest(0, s0 - lack // 2) ELSE s0 END AS s1, CASE WHEN short THEN least(t, e0 + lack - lack // 2) ELSE e0 END AS e1 FROM w),
z AS (SELECT user_id, t, max_hand_motion, max_pose_motion, CASE WHEN f0 IS NULL THEN 0 WHEN short AND e1 - s1 < 12 AND s1 <> 0 AND e1 = t THEN greatest(0, t - 12) ELSE s1 END AS trim_start,
   CASE WHEN f0 IS NULL THEN t WHEN short AND e1 - s1 < 12 AND s1 = 0 THEN least(t, 12) ELSE e1 END AS trim_end FROM v),
n AS (SELECT *, trim_end - trim_start AS len, greatest(60, trim_end - trim_start) AS want FROM z),
i AS (SELECT *, unnest(range(want)) AS i FROM n),
r AS (SELECT i.* EXCLUDE (i), i AS frame, trim_start + CASE WHEN want = len THEN i WHEN want = 1 OR len = 1 THEN 0 WHEN i = want - 1 THEN len - 1 ELSE CAST(round_even(i * ((len - 1) / (want - 1)), 0) AS BIGINT) END AS untrimmed_frame FROM i),
q AS (SELECT r.*, pok, lv, rv, e, count(*) FILTER (lv) OVER u AS nl, count(*) FILTER (rv) OVER u AS nr FROM r JOIN h ON h.user_id = r.user_id AND h.frame = r.untrimmed_frame WINDOW u AS (PARTITION BY r.user_id)),
x AS (SELECT *, least(nl, nr) > 0 AND least(nl, nr) / greatest(nl, nr) <= 0.2 AND nl >= nr AS tl, least(nl, nr) > 0 AND least(nl, nr) / greatest(nl, nr) <= 0.2 AND nl < nr AS tr FROM q),
y AS (SELECT *, CASE WHEN tl THEN lv OR rv WHEN tr THEN false ELSE lv END AS v_left, CASE WHEN tr THEN lv OR rv WHEN tl THEN false ELSE rv END AS v_right, (tl AND rv) OR (tr AND lv) AS side_stabilised,
   CASE WHEN (tl AND rv) OR (lv AND NOT tr) THEN e[1:63] ELSE {zeros} END AS l, CASE WHEN (tr AND lv) OR (rv AND NOT tl) THEN e[1:63] ELSE {zeros} END AS r FROM x),
k AS (SELECT *, v_left AND list_max([abs(x) FOR x IN l]) > 1e-6 AS l_ok, v_right AND list_max([abs(x) FOR x IN r]) > 1e-6 AS r_ok FROM y),
o AS (SELECT *, {near('l')}, {near('r')} FROM k WINDOW back AS (PARTITION BY user_id ORDER BY frame), ahead AS (PARTITION BY user_id ORDER BY frame ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING)),
p AS (SELECT *, {filled('l')} AS hl, {filled('r')} AS hr FROM o),
done AS (SELECT *, 2 * ({total('l')} + {total('r')}) AS hands_total, {pose} AS pose_total, {_anchored_total_sql(36, 3, 0, (2, 3), None)} AS mouth_total FROM p)"""


COUNTS_SQL = """t AS source_total_frames, CAST(trim_start AS BIGINT) AS trim_start, CAST(t - trim_end AS BIGINT) AS trimmed_end, CAST(len AS BIGINT) AS frames_before_resample"""


@query("ts_preprocess_pipeline", f"""
WITH {preprocess_sql()}
SELECT user_id, frame, CAST(untrimmed_frame AS BIGINT) AS untrimmed_frame, v_left, v_right, side_stabilised, {COUNTS_SQL}, nl AS left_source_frames, nr AS right_source_frames,
  {R('hands_total', 3)} AS hands_total, {R('pose_total', 3)} AS pose_total, {R('mouth_total', 3)} AS mouth_total FROM done""")
def ts_preprocess_pipeline(t):
    out = S.preprocess(stored_frames(t), USERS)
    total = lambda c: F.aggregate(c, F.lit(0.0), lambda s, v: s + F.abs(v))
    counts = [c for c in S.SEQUENCE_COUNTS if not c.startswith("max_")]
    return rounded(
        out.select(
            "user_id", "frame", "untrimmed_frame", "v_left", "v_right", "side_stabilised", *counts,
            total("hands").alias("hands_total"), total("pose").alias("pose_total"), total("mouth").alias("mouth_total"),
        ),
        digits=3,
    )


@query("ts_preprocess_counts", f"""
WITH {preprocess_sql()}
SELECT user_id, {COUNTS_SQL}, {R('max_hand_motion')} AS max_hand_motion, {R('max_pose_motion')} AS max_pose_motion, nl AS left_source_frames, nr AS right_source_frames,
  count(*) AS frames_after_resample, count(*) FILTER (v_left) AS left_result_frames, count(*) FILTER (v_right) AS right_result_frames, count(*) FILTER (side_stabilised) AS hand_side_stabilised_frames,
  {R('avg(CAST(pok AS INT))')} AS valid_pose_ratio, {R('avg(CAST(v_left AS INT))')} AS valid_left_hand_ratio, {R('avg(CAST(v_right AS INT))')} AS valid_right_hand_ratio, CAST(1 AS DOUBLE) AS valid_face_ratio
FROM done GROUP BY user_id, t, trim_start, trim_end, len, max_hand_motion, max_pose_motion, nl, nr""")
def ts_preprocess_counts(t):
    return rounded(S.preprocess_counts(S.preprocess(stored_frames(t), USERS), USERS))


def parts_sql() -> str:
    """Raw centers of four parts from one event, each with its own gaps."""
    return f"""{FRAMES}, raw AS (SELECT user_id, frame, lv, rv, frame % 11 <> 5 AS pok, frame % 13 <> 6 AS fok, x AS lx, y AS ly, y AS rx, x AS ry, (x + y) / 4 AS bx, (x + y) / 8 AS byy, y / 3 AS fx, x / 3 AS fy,
       CASE WHEN user_id % 3 = 0 THEN NULL ELSE y / 10 END AS sd FROM g)"""


def _filled(part, ok, x, y):
    return f"""{part}x AS ({neighbours_sql('raw', x, ok)}), {part}y AS ({neighbours_sql('raw', y, ok)}),
{part} AS (SELECT a.user_id, a.frame, a.v AS {part}_x, b.v AS {part}_y FROM (SELECT user_id, frame, {fill_sql(x, ok, 8)} AS v FROM {part}x) a JOIN (SELECT user_id, frame, {fill_sql(y, ok, 8)} AS v FROM {part}y) b USING (user_id, frame))"""


def features_sql() -> str:
    d = lambda a, b: f"sqrt(({a}x - {b}x) ** 2 + ({a}y - {b}y) ** 2)"
    st = lambda p: f"sqrt(({p}x - lag({p}x) OVER {W}) ** 2 + ({p}y - lag({p}y) OVER {W}) ** 2)"
    miss = ", ".join(f"1 - avg(CAST({ok} AS INT)) AS {p}_frame_missing_ratio" for p, ok in (("left", "lv"), ("right", "rv"), ("pose", "pok"), ("face", "fok")))
    pool = lambda n, a, b: f"(coalesce(sum({a}), 0) + coalesce(sum({b}), 0)) / nullif(count({a}) + count({b}), 0) AS {n}_dist_mean"
    return f"""WITH {parts_sql()}, {_filled('l', 'lv', 'lx', 'ly')}, {_filled('r', 'rv', 'rx', 'ry')}, {_filled('q', 'pok', 'bx', 'byy')}, {_filled('c', 'fok', 'fx', 'fy')},
j AS (SELECT raw.user_id, raw.frame, lv, rv, pok, fok, sd, l_x, l_y, r_x, r_y, q_x, q_y, c_x, c_y, CASE WHEN pok THEN bx END AS ox, CASE WHEN pok THEN byy END AS oy
      FROM raw JOIN l USING (user_id, frame) JOIN r USING (user_id, frame) JOIN q USING (user_id, frame) JOIN c USING (user_id, frame)),
sc AS (SELECT user_id, coalesce(median(sd) FILTER (sd > 1e-6), CASE WHEN count(ox) + count(l_x) + count(r_x) > 2 THEN
         greatest(greatest(max(ox), max(l_x), max(r_x)) - least(min(ox), min(l_x), min(r_x)), greatest(max(oy), max(l_y), max(r_y)) - least(min(oy), min(l_y), min(r_y))) END) AS scale FROM j GROUP BY user_id),
nm AS (SELECT user_id, frame, lv, rv, pok, fok, scale, {', '.join(f"({p}_{a} - coalesce(q_{a}, 0)) / scale AS {p}{a}" for p in 'lrqc' for a in 'xy')} FROM j JOIN sc USING (user_id)),
st AS (SELECT *, {st('l')} AS ld, {st('r')} AS rd FROM nm),
mo AS (SELECT *, CASE WHEN coalesce(ld, rd) IS NOT NULL THEN coalesce(ld, 0) + coalesce(rd, 0) END AS m FROM st),
ve AS (SELECT *, m * 25 AS v FROM mo), ac AS (SELECT *, v - lag(v) OVER {W} AS a, {d('l', 'c')} AS lc, {d('r', 'c')} AS rc, {d('l', 'q')} AS lb, {d('r', 'q')} AS rb, {d('l', 'r')} AS lr FROM ve),
base AS (SELECT user_id, count(*) AS num_frames, any_value(scale) AS normalization_scale, count(*) FILTER (lv) AS left_valid_frames, count(*) FILTER (rv) AS right_valid_frames, {miss},
   sum(m) AS total_motion, avg(m) AS mean_motion, max(m) AS max_motion, var_pop(m) AS motion_variance, avg(v) AS mean_velocity, max(v) AS max_velocity, stddev_pop(v) AS velocity_std,
   avg(abs(a)) AS mean_acceleration, max(abs(a)) AS max_acceleration, stddev_pop(a) AS acceleration_std, avg(lr) AS left_right_hand_dist_mean, stddev_pop(lr) AS left_right_hand_dist_std,
   {pool('hand_face', 'lc', 'rc')}, {pool('hand_body', 'lb', 'rb')} FROM ac GROUP BY user_id),
hf AS (SELECT user_id, stddev_pop(d) FILTER (k = 1) AS hand_face_dist_std, stddev_pop(d) FILTER (k = 2) AS hand_body_dist_std FROM (SELECT user_id, unnest([lc, rc, lb, rb]) AS d, unnest([1, 1, 2, 2]) AS k FROM ac) GROUP BY user_id),
hands AS (SELECT user_id * 2 AS hk, frame, lx AS px, ly AS py FROM nm UNION ALL SELECT user_id * 2 + 1, frame, rx, ry FROM nm), {trajectory_sql('hands', 'hk')},
tr AS (SELECT hk // 2 AS user_id, sum(path_length) AS trajectory_length, avg(displacement) AS displacement, avg(straightness) AS straightness_ratio, sum(direction_changes) AS direction_change_count, avg(bbox_area) AS trajectory_bbox_area FROM traj GROUP BY ALL)"""


FEATURES = (
    "normalization_scale", "left_frame_missing_ratio", "right_frame_missing_ratio", "pose_frame_missing_ratio", "face_frame_missing_ratio",
    "total_motion", "mean_motion", "max_motion", "motion_variance", "mean_velocity", "max_velocity", "velocity_std", "mean_acceleration", "max_acceleration",
    "acceleration_std", "left_right_hand_dist_mean", "left_right_hand_dist_std", "hand_face_dist_mean", "hand_body_dist_mean", "hand_face_dist_std", "hand_body_dist_std",
    "trajectory_length", "displacement", "straightness_ratio", "direction_change_count", "trajectory_bbox_area",
)
POINT_MISSING = {"left": 0.25, "right": 0.5, "pose": 0.125, "face": 0.0}


def centers(t):
    f = frames(t)
    x, y = F.col("x"), F.col("y")
    point = lambda a, b: F.struct(a.alias("x"), b.alias("y"), F.lit(0.0).alias("z"))
    return f.select(
        "user_id", "frame", "left", "right",
        F.when(F.col("frame") % 11 != 5, point((x + y) / 4, (x + y) / 8)).alias("pose"),
        F.when(F.col("frame") % 13 != 6, point(y / 3, x / 3)).alias("face"),
        F.when(F.col("user_id") % 3 != 0, y / 10).alias("shoulder_distance"),
        *[F.lit(v).alias(f"{p}_invalid") for p, v in POINT_MISSING.items()],
    )


@query("ts_video_features", f"""
{features_sql()}
SELECT user_id, num_frames, left_valid_frames, right_valid_frames, {', '.join(f'{R(c, 5)} AS {c}' for c in FEATURES)},
  {R('(left_frame_missing_ratio + right_frame_missing_ratio) / 2', 5)} AS hand_frame_missing_ratio, left_valid_frames >= 3 OR right_valid_frames >= 3 AS usable_motion,
  true AS has_left_hand, true AS has_right_hand, {', '.join(f'CAST({v} AS DOUBLE) AS {p}_point_missing_ratio' for p, v in POINT_MISSING.items())}, CAST(0.375 AS DOUBLE) AS hand_point_missing_ratio
FROM base JOIN hf USING (user_id) LEFT JOIN tr USING (user_id)""")
def ts_video_features(t):
    normalised = cut_lineage(S.normalised_frames(centers(t), USERS))
    out = S.sequence_features(normalised, USERS, fps=F.lit(25.0))
    return rounded(out, *FEATURES, "hand_frame_missing_ratio", digits=5)
