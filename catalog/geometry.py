from pyspark.sql import functions as F

from catalog import R, query, r6, rounded
from seqatlas.distribution import exact_quantiles
from seqatlas.functions import arrays as A
from seqatlas.functions.numbers import finite
from seqatlas.operators import features as FE, sequences as S
from seqatlas.sources import layout as L

POINTS = """p AS (SELECT vec_id, label, CAST(k AS INTEGER) AS landmark, CAST(embedding[3*k+1] AS DOUBLE) AS x, CAST(embedding[3*k+2] AS DOUBLE) AS y, CAST(embedding[3*k+3] AS DOUBLE) AS z
      FROM embeddings, range(21) t(k))"""
FLAT = "e AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings)"


def hands(t):
    """Embeddings as 21x3 hands."""
    flat = F.transform(F.slice("embedding", 1, 63), lambda v: v.cast("double"))
    return t("embeddings").select("vec_id", "label", flat.alias("flat")).withColumn("hand", A.reshape(F.col("flat"), 21))


def long(df, points, *keys):
    return df.select(*keys, F.posexplode(points).alias("landmark", "_p")).select(
        *keys, "landmark", *[F.col("_p")[i].alias(a) for i, a in enumerate("xyz")]
    )


@query("arr_reshape", f"WITH {POINTS} SELECT vec_id, landmark, x, y, z FROM p")
def arr_reshape(t):
    return long(hands(t), "hand", "vec_id")


@query("arr_split_hands", """
WITH h AS (SELECT vec_id, list_concat(list_concat(embedding, embedding), list_concat(embedding, embedding))[1:252] AS h FROM embeddings)
SELECT vec_id, part, CAST(k AS INTEGER) AS landmark, CAST(h[o+3*k+1] AS DOUBLE) AS x, CAST(h[o+3*k+2] AS DOUBLE) AS y, CAST(h[o+3*k+3] AS DOUBLE) AS z
FROM h, (VALUES ('left', 0), ('right', 63)) s(part, o), range(21) t(k)""")
def arr_split_hands(t):
    row = F.slice(F.concat(*["embedding"] * 4), 1, L.HANDS_WIDTH)
    left, right = L.split_hands(row)
    return L.part_rows(t("embeddings").select("vec_id", left.alias("left"), right.alias("right")), ["vec_id"], ["left", "right"]).withColumn("landmark", F.col("landmark").cast("int"))


K = "CAST(json_extract(props, '$.k') AS DOUBLE)"


@query("arr_mask", f"""
SELECT event_id, CASE WHEN event_id % 3 <> 0 THEN value END AS x, CASE WHEN event_id % 3 <> 0 THEN {K} END AS y FROM events""")
def arr_mask(t):
    point = F.array("value", F.get_json_object("props", "$.k").cast("double"))
    masked = A.where_valid(point, F.col("event_id") % 3 != 0)
    return t("events").select("event_id", masked[0].alias("x"), masked[1].alias("y"))


@query("arr_valid", f"""
WITH {POINTS}, q AS (SELECT vec_id, landmark, CASE WHEN vec_id % 5 = 0 THEN 0 ELSE x END AS x, CASE WHEN vec_id % 5 = 0 THEN 0 ELSE y END AS y,
       CASE WHEN vec_id % 7 = 0 AND landmark = 4 THEN NULL WHEN vec_id % 5 = 0 THEN 0 ELSE z END AS z FROM p)
SELECT vec_id, count(z) = 21 AND sum(abs(x) + abs(y) + abs(coalesce(z, 0))) > 0 AS row_valid,
       CAST(count(*) FILTER (z IS NOT NULL AND sqrt(x*x + y*y) > 1e-8) AS BIGINT) AS valid_points
FROM q GROUP BY vec_id""")
def arr_valid(t):
    planted = F.transform(
        "flat",
        lambda v, i: F.when((F.col("vec_id") % 7 == 0) & (i == 14), F.lit(float("nan"))).when(F.col("vec_id") % 5 == 0, F.lit(0.0)).otherwise(v),
    )
    rows = hands(t).withColumn("flat", planted)
    points = A.reshape(F.col("flat"), 21)
    return rows.select("vec_id", A.valid_row(F.col("flat")).alias("row_valid"), F.size(F.filter(points, A.valid_point)).cast("long").alias("valid_points"))


@query("arr_missing_ratio", f"""
WITH {POINTS}
SELECT vec_id, {R('avg(CASE WHEN abs(x) < 0.5 THEN 1.0 ELSE 0.0 END)')} AS missing_ratio, {R('avg(CASE WHEN abs(x) < 0.5 THEN 0.0 ELSE 1.0 END)')} AS detection_rate
FROM p GROUP BY vec_id""")
def arr_missing_ratio(t):
    thin = F.transform("hand", lambda p: F.when(F.abs(p[0]) < 0.5, F.array(*[F.lit(0.0)] * 3)).otherwise(p))
    rows = hands(t).withColumn("hand", thin)
    return rounded(rows.select("vec_id", A.missing_share(F.col("hand")).alias("missing_ratio"), A.detected_share(F.col("hand")).alias("detection_rate")))


@query("arr_hand_missing", f"""
SELECT user_id, {R('avg(CAST(value < 30 AS INT))')} AS left_hand_missing_rate, {R(f'avg(CAST({K} < 40 AS INT))')} AS right_hand_missing_rate,
       {R(f'avg(CAST(value < 30 AND {K} < 40 AS INT))')} AS both_hand_missing_rate, {R(f'1 - avg(CAST(value < 30 AND {K} < 40 AS INT))')} AS hand_detection_rate
FROM events GROUP BY user_id""")
def arr_hand_missing(t):
    k = F.get_json_object("props", "$.k").cast("double")
    return rounded(FE.hand_missing_rates(t("events"), ["user_id"], F.col("value") < 30, k < 40))


@query("arr_center", f"""
WITH {POINTS}, q AS (SELECT vec_id, CASE WHEN (vec_id + landmark) % 4 = 0 THEN 0 ELSE x END AS x, CASE WHEN (vec_id + landmark) % 4 = 0 THEN 0 ELSE y END AS y, z FROM p)
SELECT vec_id, {R('avg(x) FILTER (ok)')} AS x, {R('avg(y) FILTER (ok)')} AS y, {R('avg(z) FILTER (ok)')} AS z, {R('1 - avg(CAST(ok AS INT))')} AS point_missing
FROM (SELECT *, sqrt(x*x + y*y) > 1e-8 AS ok FROM q) GROUP BY vec_id""")
def arr_center(t):
    gap = lambda p, i: F.when((F.col("vec_id") + i) % 4 == 0, F.array(F.lit(0.0), F.lit(0.0), p[2])).otherwise(p)
    rows = hands(t).withColumn("hand", F.transform("hand", gap))
    c = A.center(F.col("hand"))
    return rounded(rows.select("vec_id", c["x"].alias("x"), c["y"].alias("y"), c["z"].alias("z"), A.invalid_point_share(F.col("hand")).alias("point_missing")))


@query("arr_l2", f"WITH {FLAT} SELECT vec_id, {R('list_distance(e[1:32], e[33:64])')} AS distance FROM e")
def arr_l2(t):
    e = t("embeddings").withColumn("e", F.transform("embedding", lambda v: v.cast("double")))
    return rounded(e.select("vec_id", A.l2(F.slice("e", 1, 32), F.slice("e", 33, 32)).alias("distance")))


@query("arr_angle", f"""
WITH {FLAT}, v AS (SELECT vec_id, [e[1]-e[4], e[2]-e[5], e[3]-e[6]] AS a, [e[7]-e[4], e[8]-e[5], e[9]-e[6]] AS c FROM e)
SELECT vec_id, {R('degrees(acos(greatest(-1, least(1, list_dot_product(a, c) / (sqrt(list_dot_product(a, a)) * sqrt(list_dot_product(c, c)) + 1e-6)))))')} AS angle FROM v""")
def arr_angle(t):
    p = lambda k: A.point(F.col("hand"), k)
    return rounded(hands(t).select("vec_id", A.angle(p(0), p(1), p(2)).alias("angle")))


@query("arr_unit_vector", f"""
WITH {FLAT}, v AS (SELECT vec_id, e[16]-e[1] AS a1, e[17]-e[2] AS a2, e[18]-e[3] AS a3, e[52]-e[1] AS b1, e[53]-e[2] AS b2, e[54]-e[3] AS b3 FROM e),
c AS (SELECT vec_id, a2*b3-a3*b2 AS x, a3*b1-a1*b3 AS y, a1*b2-a2*b1 AS z FROM v)
SELECT vec_id, {R('x / (sqrt(x*x+y*y+z*z) + 1e-6)')} AS x, {R('y / (sqrt(x*x+y*y+z*z) + 1e-6)')} AS y, {R('z / (sqrt(x*x+y*y+z*z) + 1e-6)')} AS z FROM c""")
def arr_unit_vector(t):
    p = lambda k: A.point(F.col("hand"), k)
    normal = A.unit(A.cross(A.subtract(p(5), p(0)), A.subtract(p(17), p(0))))
    return rounded(hands(t).select("vec_id", normal.alias("n")).select("vec_id", *[F.col("n")[i].alias(a) for i, a in enumerate("xyz")]))


@query("arr_hand_scale", f"WITH {FLAT} SELECT vec_id, {R('list_distance(e[1:3], e[28:30]) + 1e-6')} AS hand_scale FROM e")
def arr_hand_scale(t):
    return rounded(hands(t).select("vec_id", A.hand_scale(F.col("hand")).alias("hand_scale")))


@query("arr_safe_stats", f"""
WITH v AS (SELECT user_id, CASE WHEN event_id % 6 = 0 OR user_id = 3 THEN NULL ELSE value END AS v FROM events)
SELECT user_id, {R('avg(v)')} AS mean, {R('stddev_pop(v)')} AS std, {R('min(v)')} AS min, {R('max(v)')} AS max, {R('median(v)')} AS median, {R('sum(v)', 4)} AS sum
FROM v GROUP BY user_id""")
def arr_safe_stats(t):
    dirty = F.when(F.col("user_id") == 3, F.lit(None)).when(F.col("event_id") % 6 == 0, F.lit(float("nan"))).otherwise(F.col("value"))
    rows = t("events").select("user_id", finite(dirty).alias("v"))
    stats = rows.groupBy("user_id").agg(
        F.avg("v").alias("mean"), F.stddev_pop("v").alias("std"), F.min("v").alias("min"), F.max("v").alias("max"), r6(F.sum("v"), 4).alias("sum")
    )
    return rounded(stats.join(exact_quantiles(rows, ["user_id"], "v", {"median": 0.5}), "user_id", "left"), "mean", "std", "min", "max", "median")


def _anchored_sql(center, scale, valid):
    return f"""SELECT vec_id, landmark, {R(f'CASE WHEN {valid} THEN (x - {center}x) / {scale} ELSE x END')} AS x,
       {R(f'CASE WHEN {valid} THEN (y - {center}y) / {scale} ELSE y END')} AS y, {R(f'CASE WHEN {valid} THEN (z - {center}z) / {scale} ELSE z END')} AS z"""


def _middle_sql(a, b, name):
    return ", ".join(f"(avg({ax}) FILTER (landmark = {a}) + avg({ax}) FILTER (landmark = {b})) * 0.5 AS {name}{ax}" for ax in "xyz")


@query("norm_pose", f"""
WITH {POINTS}, m AS (SELECT vec_id, {_middle_sql(11, 12, 'n')}, {_middle_sql(7, 8, 'h')} FROM p GROUP BY vec_id),
s AS (SELECT *, sqrt((hx-nx)*(hx-nx) + (hy-ny)*(hy-ny) + (hz-nz)*(hz-nz)) AS s FROM m)
{_anchored_sql('n', 's', 's > 1e-6')} FROM p JOIN s USING (vec_id)""")
def norm_pose(t):
    return rounded(long(hands(t), A.anchor_pose(F.col("hand")), "vec_id"))


@query("norm_hand", f"""
WITH {POINTS}, w AS (SELECT vec_id, x AS wx, y AS wy, z AS wz FROM p WHERE landmark = 0)
SELECT vec_id, landmark, {R('x - wx')} AS x, {R('y - wy')} AS y, {R('z - wz')} AS z FROM p JOIN w USING (vec_id)""")
def norm_hand(t):
    return rounded(long(hands(t), A.anchor_hand(F.col("hand")), "vec_id"))


@query("norm_mouth", f"""
WITH p0 AS (SELECT 1), {POINTS}, q AS (SELECT * FROM p WHERE landmark < 12),
m AS (SELECT vec_id, {_middle_sql(2, 3, 'c')}, {', '.join(f'avg({a}) FILTER (landmark = 3) - avg({a}) FILTER (landmark = 2) AS d{a}' for a in 'xyz')} FROM q GROUP BY vec_id),
s AS (SELECT *, sqrt(dx*dx + dy*dy + dz*dz) AS s FROM m)
{_anchored_sql('c', 's', 's > 1e-6')} FROM q JOIN s USING (vec_id)""")
def norm_mouth(t):
    mouth = F.slice("hand", 1, L.MOUTH_LANDMARKS)
    return rounded(long(hands(t), A.anchor_mouth(mouth, *L.MOUTH_CORNERS), "vec_id"))


@query("norm_body_anchor", f"""
WITH e AS (SELECT event_id, user_id, value AS x, {K} AS y, CASE WHEN event_id % 4 = 0 THEN NULL ELSE value / 2 END AS bx, CASE WHEN event_id % 4 = 0 THEN NULL ELSE {K} / 2 END AS byy,
       CASE WHEN user_id % 3 = 0 THEN NULL ELSE {K} / 10 END AS d FROM events),
s AS (SELECT user_id, coalesce(median(d) FILTER (d > 1e-6), greatest(max(greatest(x, coalesce(bx, x))) - min(least(x, coalesce(bx, x))), max(greatest(y, coalesce(byy, y))) - min(least(y, coalesce(byy, y))))) AS s FROM e GROUP BY user_id)
SELECT event_id, {R('(x - coalesce(bx, 0)) / s')} AS x, {R('(y - coalesce(byy, 0)) / s')} AS y FROM e JOIN s USING (user_id)""")
def norm_body_anchor(t):
    from seqatlas.distribution import salted_join

    k = F.get_json_object("props", "$.k").cast("double")
    point = lambda x, y: F.struct(x.alias("x"), y.alias("y"), F.lit(0.0).alias("z"))
    rows = t("events").select(
        "event_id", "user_id", point(F.col("value"), k).alias("hand"),
        F.when(F.col("event_id") % 4 != 0, point(F.col("value") / 2, k / 2)).alias("body"),
        F.when(F.col("user_id") % 3 != 0, k / 10).alias("shoulders"),
    )
    scales = S.body_scale(rows, ["user_id"], shoulder_distance="shoulders", centers=["hand", "body"])
    joined = salted_join(rows, scales, ["user_id"], salt_on=["event_id"])
    p = S.anchor_to_body(F.col("hand"), F.col("body"), F.col("scale"))
    return rounded(joined.select("event_id", p["x"].alias("x"), p["y"].alias("y")))


@query("proxy_parts", f"""
WITH {POINTS}
SELECT p.vec_id, 'hand' AS part, CAST(k AS INTEGER) AS landmark, x, y, z FROM p, range(21) t(k) WHERE p.landmark = 15
UNION ALL SELECT vec_id, 'face', landmark, x, y, z FROM p WHERE landmark <= 10""")
def proxy_parts(t):
    parts = hands(t).select("vec_id", A.wrist_as_hand(F.col("hand"), A.WRISTS[0]).alias("hand"), A.head_as_face(F.col("hand")).alias("face"))
    return L.part_rows(parts, ["vec_id"], ["hand", "face"])


@query("frame_concat", f"""
WITH {FLAT}, w AS (SELECT vec_id, CASE WHEN vec_id % 4 = 0 THEN list_concat(list_concat(e[1:40], e[41:60]), list_concat(e[1:9], e[1:2])) ELSE list_concat(list_concat(e[1:40], e[41:60]), list_concat(e[1:9], e[1:3])) END AS w FROM e)
SELECT vec_id, CAST(CASE WHEN len(w) = 72 THEN 72 END AS INTEGER) AS width, CASE WHEN len(w) = 72 THEN w[41] END AS first_of_hands, CASE WHEN len(w) = 72 THEN w[72] END AS last_value FROM w""")
def frame_concat(t):
    e = t("embeddings").withColumn("e", F.transform("embedding", lambda v: v.cast("double")))
    mouth = F.when(F.col("vec_id") % 4 == 0, F.slice("e", 1, 2)).otherwise(F.slice("e", 1, 3))
    row = L.concat_row(F.slice("e", 1, 40), F.slice("e", 41, 20), F.slice("e", 1, 9), mouth, width=72)
    return e.select("vec_id", row.alias("r")).select("vec_id", F.when(F.col("r").isNotNull(), F.size("r")).alias("width"), F.get("r", F.lit(40)).alias("first_of_hands"), F.get("r", F.lit(71)).alias("last_value"))


@query("hand_slot_assign", """
WITH d AS (SELECT conv_id, md5(text) AS h, CASE role WHEN 'user' THEN 'Left' WHEN 'assistant' THEN 'Right' END AS side, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS i FROM conversations),
f AS (SELECT conv_id, max(h) FILTER (i = 1) AS h1, max(h) FILTER (i = 2) AS h2, max(side) FILTER (i = 1) AS s1 FROM d WHERE i <= 2 GROUP BY conv_id)
SELECT conv_id, CASE WHEN s1 = 'Right' THEN h2 ELSE h1 END AS "left", CASE WHEN s1 = 'Right' THEN h1 ELSE h2 END AS "right" FROM f""")
def hand_slot_assign(t):
    side = F.when(F.col("role") == "user", "Left").when(F.col("role") == "assistant", "Right")
    rows = t("conversations").select("conv_id", "turn", side.alias("side"), F.md5("text").alias("hand"))
    return S.assign_hand_slots(rows, ["conv_id"], order="turn", side="side", payload="hand")


@query("frame_pose_quality", f"""
WITH {FLAT}, p AS (SELECT vec_id, k, e[2*k+1] AS x, e[2*k+2] AS y, abs(e[2*k+1]) * 2 AS c FROM e, range(32) t(k)),
g AS (SELECT vec_id, max(x) FILTER (x > 0) AS x1, min(x) FILTER (x > 0) AS x0, max(y) FILTER (y > 0) AS y1, min(y) FILTER (y > 0) AS y0,
  {', '.join(f'max({a}) FILTER (k = {k}) AS {a}{k}' for k in (11, 12, 23, 24) for a in 'xyc')} FROM p GROUP BY vec_id),
b AS (SELECT *, c11 > 0.5 AND c12 > 0.5 AND x1 IS NOT NULL AND y1 IS NOT NULL AS sh FROM g), f AS (SELECT *, sh AND c23 > 0.5 AND c24 > 0.5 AS al FROM b)
SELECT vec_id, {R('coalesce((x1 - x0) * (y1 - y0), 0)')} AS person_area,
  {R('CASE WHEN al THEN greatest(0, least(1, 1 - (abs(abs(x11 - 0.5) - abs(x12 - 0.5)) + abs(abs(x23 - 0.5) - abs(x24 - 0.5))) / 2)) ELSE 0.5 END')} AS frontality,
  {R('CASE WHEN al THEN abs(y11 - y12) + abs(y23 - y24) ELSE 0 END')} AS tilt, {R('CASE WHEN sh THEN degrees(atan2(y12 - y11, x12 - x11)) ELSE 0 END')} AS shoulder_angle FROM f""")
def frame_pose_quality(t):
    points = A.reshape(F.col("embedding"), 32, stride=2, coords=2)
    seen = F.transform(points, lambda p: F.abs(p[0]) * 2)
    return rounded(t("embeddings").select("vec_id", A.pose_quality(points, seen).alias("q")).select("vec_id", "q.*"))


@query("frame_hand_quality", f"""
WITH {POINTS}, q AS (SELECT vec_id, x, y, CASE WHEN landmark % 2 = 0 THEN 0 ELSE z END AS z FROM p)
SELECT vec_id, true AS detected, {R('avg(CAST(z <> 0 OR abs(x) > 0.5 AS INT))')} AS visibility, {R('(max(x) - min(x)) * (max(y) - min(y))')} AS area FROM q GROUP BY vec_id""")
def frame_hand_quality(t):
    flatten = F.transform("hand", lambda p, i: F.array(p[0], p[1], F.when(i % 2 == 0, F.lit(0.0)).otherwise(p[2])))
    presence = F.transform("hand", lambda p: F.abs(p[0]))
    return rounded(hands(t).select("vec_id", A.hand_quality(flatten, presence).alias("q")).select("vec_id", "q.*"))
