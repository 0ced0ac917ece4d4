from pyspark.sql import functions as F

from catalog import R, query, rounded
from catalog.series import USERS, centers, features_sql
from seqatlas.operators import dtw as D, report as P, sequences as S
from seqatlas.session import cut_lineage

CHANNELS = 2


def series(t):
    """Embeddings as trajectories of 32 points with two channels."""
    return t("embeddings").select(
        (F.col("vec_id") % 2).alias("dataset"), "label", "vec_id", F.transform("embedding", lambda v: v.cast("double")).alias("trajectory")
    )


SERIES = f"""t AS MATERIALIZED (SELECT vec_id % 2 AS dataset, label, vec_id, [CAST(x AS DOUBLE) FOR x IN embedding] AS t FROM embeddings)"""


def warp_sql(pairs: str, window: int = 8, channels: int = CHANNELS) -> str:
    """CTE ``warped`` (id, distance) from ``pairs`` (id, a, b: flat trajectories).

    The banded table is filled one diagonal after the other: cell (i, s - i) of diagonal s needs
    only the two diagonals before it.
    """
    cost = "sqrt(" + " + ".join(f"(a[(i - 1) * {channels} + {c}] - b[(s + 1 - i - 1) * {channels} + {c}]) ** 2" for c in range(1, channels + 1)) + ")"
    inside = f"i BETWEEN 1 AND n AND s + 1 - i BETWEEN 1 AND m AND abs(2 * i - s - 1) <= band"
    return f"""sized AS MATERIALIZED (SELECT id, a, b, len(a) // {channels} AS n, len(b) // {channels} AS m, greatest({window}, abs(len(a) // {channels} - len(b) // {channels})) AS band FROM {pairs}),
filled(id, a, b, n, m, band, s, last, before) AS (
  SELECT id, a, b, n, m, band, 1, [CAST('inf' AS DOUBLE) FOR i IN range(n + 1)], [CASE WHEN i = 0 THEN 0.0 ELSE CAST('inf' AS DOUBLE) END FOR i IN range(n + 1)] FROM sized WHERE n > 0 AND m > 0
  UNION ALL
  SELECT id, a, b, n, m, band, s + 1, [CASE WHEN {inside} THEN {cost} + least(last[i], last[i + 1], before[i]) ELSE CAST('inf' AS DOUBLE) END FOR i IN range(n + 1)], last
  FROM filled WHERE s < n + m),
warped AS (SELECT id, last[n + 1] / (n + m) AS distance FROM filled WHERE s = n + m)"""


@query("dtw_distance", f"""
WITH RECURSIVE {SERIES}, pr AS (SELECT x.vec_id AS id, x.t AS a, CASE WHEN (x.vec_id + 1) % 3 = 0 THEN y.t[1:40] ELSE y.t END AS b FROM t x JOIN t y ON y.vec_id = x.vec_id + 1), {warp_sql('pr')}
SELECT id AS vec_id, {R('distance')} AS distance FROM warped""")
def dtw_distance(t):
    """Each trajectory against the one with the next number, of either half its length or all."""
    a = series(t).select("vec_id", "trajectory")
    b = a.select((F.col("vec_id") - 1).alias("vec_id"), F.when((F.col("vec_id")) % 3 == 0, F.slice("trajectory", 1, 40)).otherwise(F.col("trajectory")).alias("other"))
    joined = a.join(b, "vec_id")
    return rounded(joined.select("vec_id", D.warp_pairs(F.col("trajectory"), F.col("other"), CHANNELS).alias("distance")))


def drawn_sql(source: str, groups: str, most: int, seed: int = 42, ident: str = "vec_id") -> str:
    """CTE ``drawn`` (groups, <ident>_a, <ident>_b, num_pairs_all): the pairs that ``draw_pairs`` takes."""
    keys = groups.split(", ")
    on = lambda x: " AND ".join(f"{x}.{k} = q.{k}" for k in keys)
    text = " || '|' || ".join([f"'{seed}'", *[f"CAST({k} AS VARCHAR)" for k in keys], "CAST(k AS VARCHAR)"])
    return f"""rk AS (SELECT {groups}, {ident}, row_number() OVER (PARTITION BY {groups} ORDER BY {ident}) - 1 AS i FROM {source}),
gz AS (SELECT {groups}, count(*) * (count(*) - 1) // 2 AS p FROM {source} GROUP BY ALL), tn AS (SELECT *, unnest(range(least(p, {most}))) AS k FROM gz WHERE p > 0),
nb AS (SELECT *, CASE WHEN p <= {most} THEN k ELSE k * (p // {most}) + least(k, p % {most}) + CAST('0x' || substr(md5({text}), 1, 15) AS BIGINT) % (p // {most} + CASE WHEN k < p % {most} THEN 1 ELSE 0 END) END AS number FROM tn),
ij AS (SELECT *, CAST(floor((1 + sqrt(1 + 8.0 * number)) / 2) AS BIGINT) AS j FROM nb),
drawn AS (SELECT {', '.join(f'q.{k}' for k in keys)}, x.{ident} AS {ident}_a, y.{ident} AS {ident}_b, p AS num_pairs_all FROM ij q JOIN rk x ON {on('x')} AND x.i = number - j * (j - 1) // 2 JOIN rk y ON {on('y')} AND y.i = j)"""


def intra_sql(most: int) -> str:
    """CTEs ``ip`` (pairs with their distances) and ``ia`` (figures of each label)."""
    return f"""{SERIES}, {drawn_sql('t', 'dataset, label', most)},
pr AS (SELECT row_number() OVER () AS id, d.dataset, d.label, vec_id_a, vec_id_b, x.t AS a, y.t AS b FROM drawn d JOIN t x ON x.vec_id = vec_id_a JOIN t y ON y.vec_id = vec_id_b), {warp_sql('pr')},
ip AS (SELECT dataset, label, vec_id_a, vec_id_b, distance AS d FROM pr JOIN warped USING (id)),
ia AS (SELECT dataset, label, count(*) AS num_pairs, avg(d) AS intra_class_dtw_mean, stddev_pop(d) AS intra_class_dtw_std, min(d) AS intra_class_dtw_min, max(d) AS intra_class_dtw_max, median(d) AS intra_class_dtw_median FROM ip GROUP BY ALL)"""


def label_pairs(t, most=D.MOST_PAIRS):
    """Every pair of a label, or as many as the bound allows."""
    return cut_lineage(D.pairs_of_labels(series(t), "vec_id", "trajectory", CHANNELS, ["dataset", "label"], most=most))


@query("dtw_intra_class", f"""
WITH RECURSIVE {intra_sql(D.MOST_PAIRS)}, sz AS (SELECT dataset, label, count(*) AS num_samples, count(*) * (count(*) - 1) // 2 AS num_pairs_all FROM t GROUP BY ALL)
SELECT dataset, label, num_samples, num_pairs_all, num_pairs, 0 AS num_pairs_failed, {', '.join(f'{R(c)} AS {c}' for c in (f'intra_class_dtw_{s}' for s in ('mean', 'std', 'min', 'max', 'median')))} FROM ia JOIN sz USING (dataset, label)""")
def dtw_intra_class(t):
    return rounded(D.intra_class(label_pairs(t), samples=series(t)))


SAMPLE = 100


@query("dtw_pair_sample", f"WITH RECURSIVE {intra_sql(SAMPLE)} SELECT dataset, label, vec_id_a, vec_id_b, {R('d')} AS dtw_distance FROM ip")
def dtw_pair_sample(t):
    """Distances of at most 100 drawn pairs of each label."""
    return rounded(label_pairs(t, SAMPLE))


PROTO = """c AS (SELECT vec_id % 2 AS dataset, label, CAST(k AS INTEGER) AS position, avg(CAST(embedding[k+1] AS DOUBLE)) AS value, count(*) AS num_samples FROM embeddings, range(64) t(k) GROUP BY ALL)"""


@query("dtw_prototypes", f"WITH {PROTO} SELECT dataset, label, position, {R('value')} AS value, num_samples FROM c")
def dtw_prototypes(t):
    p = D.prototypes(series(t), ["dataset", "label"], "trajectory")
    return rounded(p.select("dataset", "label", "num_samples", F.posexplode("prototype").alias("position", "value")))


NEAREST = 3
INTER = f"""{PROTO}, pa AS MATERIALIZED (SELECT dataset, label, list(value ORDER BY position) AS t FROM c GROUP BY ALL), ms AS (SELECT dataset, position, avg(value) AS m, stddev_pop(value) + 1e-6 AS s FROM c GROUP BY ALL),
zc AS (SELECT dataset, label, list((value - m) / s ORDER BY position) AS z FROM c JOIN ms USING (dataset, position) GROUP BY ALL),
nn AS (SELECT x.dataset, x.label AS i, y.label AS j, row_number() OVER (PARTITION BY x.dataset, x.label ORDER BY round(list_distance(x.z, y.z) ** 2, 9), y.label) AS k FROM zc x JOIN zc y ON x.dataset = y.dataset AND x.label <> y.label),
np AS (SELECT DISTINCT dataset, least(i, j) AS label_a, greatest(i, j) AS label_b FROM nn WHERE k <= {NEAREST}),
pr AS (SELECT row_number() OVER () AS id, x.dataset, x.label AS label_a, y.label AS label_b, x.t AS a, y.t AS b FROM pa x JOIN pa y ON x.dataset = y.dataset AND x.label < y.label), {warp_sql('pr')},
ep AS (SELECT dataset, label_a, label_b, distance AS d FROM pr JOIN warped USING (id))"""


def label_prototypes(t):
    return cut_lineage(D.prototypes(series(t), ["dataset", "label"], "trajectory"))


@query("dtw_inter_class", f"""
WITH RECURSIVE {INTER} SELECT dataset, label_a, label_b, {R('d')} AS dtw_distance, 'exhaustive' AS mode FROM ep
UNION ALL SELECT dataset, label_a, label_b, {R('d')}, 'nearest_candidates_then_dtw' FROM ep JOIN np USING (dataset, label_a, label_b)""")
def dtw_inter_class(t):
    p = label_prototypes(t)
    near = D.inter_class(p, "label", CHANNELS, candidates=NEAREST)
    every = D.inter_class(p, "label", CHANNELS, exhaustive=True, candidates=NEAREST)
    return rounded(near.unionByName(every))


@query("rpt_dtw_quantiles", f"""
WITH RECURSIVE {intra_sql(D.MOST_PAIRS)}, {INTER.replace('sized', 'sized2').replace('filled', 'filled2').replace('warped', 'warped2').replace('pr AS', 'pr2 AS').replace('FROM pr', 'FROM pr2')},
pp AS (SELECT dataset, d FROM ep JOIN np USING (dataset, label_a, label_b))
SELECT dataset, 'intra' AS kind, count(*) AS n, {R('avg(v)')} AS mean, {R('max(v)')} AS max, {R('median(v)')} AS median, {R('quantile_cont(v, 0.75)')} AS p75, {R('quantile_cont(v, 0.9)')} AS p90,
  CAST(NULL AS DOUBLE) AS min, CAST(NULL AS BIGINT) AS zero_pairs, CAST(NULL AS DOUBLE) AS p10 FROM (SELECT dataset, intra_class_dtw_mean AS v FROM ia) GROUP BY dataset
UNION ALL SELECT dataset, 'inter', count(*), NULL, NULL, {R('median(d)')}, NULL, NULL, {R('min(d)')}, count(*) FILTER (d <= 1e-9), {R('quantile_cont(d, 0.1)')} FROM pp GROUP BY dataset""")
def rpt_dtw_quantiles(t):
    """Spread of the labels' mean distances, and of the distances of candidate label pairs."""
    intra = P.intra_quantiles(cut_lineage(D.intra_class(label_pairs(t))), "intra_class_dtw_mean").withColumn("kind", F.lit("intra"))
    near = cut_lineage(D.inter_class(label_prototypes(t), "label", CHANNELS, candidates=NEAREST))
    inter = P.inter_quantiles(near, "dtw_distance").withColumn("kind", F.lit("inter"))
    return rounded(intra.unionByName(inter, allowMissingColumns=True))


def trajectories_sql(points: int = 30) -> str:
    """CTE ``ht``: both hand centers of ``nm`` resampled to equal spacing over all frames of a user."""
    chans = ("lx", "ly", "rx", "ry")
    near = ", ".join(
        f"last_value(CASE WHEN {c} IS NOT NULL THEN frame END IGNORE NULLS) OVER b AS {c}pf, last_value({c} IGNORE NULLS) OVER b AS {c}pv, "
        f"first_value(CASE WHEN {c} IS NOT NULL THEN frame END IGNORE NULLS) OVER f AS {c}nf, first_value({c} IGNORE NULLS) OVER f AS {c}nv" for c in chans
    )
    value = lambda c: f"""coalesce(CASE WHEN t = {points} THEN {c} WHEN {c}pf = frame AND fr = 0 THEN {c}pv WHEN {c}pf IS NULL THEN {c}nv WHEN {c}nf IS NULL THEN {c}pv
      ELSE {c}pv + ({c}nv - {c}pv) / ({c}nf - {c}pf) * (frame + fr - {c}pf) END, 0)"""
    return f"""hl AS (SELECT user_id, count(*) AS t FROM nm GROUP BY ALL), hi AS (SELECT *, unnest(range({points})) AS i FROM hl),
hg AS (SELECT user_id, t, i, i * (t - 1) // {points - 1} AS lo, (i * (t - 1) % {points - 1}) / {points - 1}.0 AS fr FROM hi),
hn AS (SELECT *, {near} FROM nm WINDOW b AS (PARTITION BY user_id ORDER BY frame ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), f AS (PARTITION BY user_id ORDER BY frame ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING)),
ht AS (SELECT hn.user_id, i AS frame, {', '.join(f'{value(c)} AS {c}' for c in chans)} FROM hn JOIN hg ON hn.user_id = hg.user_id AND frame = lo)"""


CHANNEL_SQL = ", ".join(f"{R(c)} AS {c}" if c[1] != "z" else f"CAST(0 AS DOUBLE) AS {c}" for c in ("lx", "ly", "lz", "rx", "ry", "rz"))


@query("hand_trajectories", f"{features_sql()}, {trajectories_sql()} SELECT user_id, frame, {CHANNEL_SQL} FROM ht")
def hand_trajectories(t):
    """Both hands of every user, resampled to 30 frames."""
    normalised = cut_lineage(S.normalised_frames(centers(t), USERS))
    return rounded(S.hand_trajectories(normalised, USERS))


@query("chart_trajectories", f"""
{features_sql()}, {trajectories_sql()}, best AS (SELECT user_id FROM base ORDER BY round(total_motion, 9) DESC NULLS LAST, user_id LIMIT 6)
SELECT user_id, frame, {CHANNEL_SQL} FROM ht JOIN best USING (user_id)""")
def chart_trajectories(t):
    """Example trajectories: the six users with the most motion."""
    normalised = cut_lineage(S.normalised_frames(centers(t), USERS))
    features = S.sequence_features(normalised, USERS).select("user_id", "total_motion")
    best = cut_lineage(P.most_moving(features, normalised, ["user_id"]))
    return rounded(S.hand_trajectories(best, USERS))
