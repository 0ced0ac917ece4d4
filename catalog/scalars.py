from pyspark.sql import functions as F

from catalog import R, query, r6, rounded
from seqatlas.functions import numbers as N, text as X


@query("fn_dataset_key", """
SELECT r_regionkey,
       upper(trim(coalesce(r_name, ''))) AS plain_key,
       CASE WHEN upper(trim(r_name)) = 'ASIA' THEN 'EAST' ELSE upper(trim(coalesce(r_name, ''))) END AS aliased_key,
       upper(trim(coalesce(CASE WHEN r_regionkey = 2 THEN NULL ELSE '  ' || lower(r_name) || ' ' END, ''))) AS padded_key
FROM region""")
def fn_dataset_key(t):
    name = F.col("r_name")
    padded = F.when(F.col("r_regionkey") != 2, F.concat(F.lit("  "), F.lower(name), F.lit(" ")))
    return t("region").select(
        "r_regionkey",
        X.dataset_key(name).alias("plain_key"),
        X.dataset_key(name, {"ASIA": "EAST"}).alias("aliased_key"),
        X.dataset_key(padded).alias("padded_key"),
    )


@query("fn_text_key", """
SELECT doc_id, md5(trim(coalesce(text, ''))) AS trimmed, md5(nfc_normalize(trim(coalesce(text, '')))) AS composed
FROM documents""")
def fn_text_key(t):
    return t("documents").select(
        "doc_id",
        F.md5(X.text_key(F.col("text"), compose=False)).alias("trimmed"),
        F.md5(X.text_key(F.col("text"))).alias("composed"),
    )


@query("fn_video_key", r"""
WITH p AS (SELECT page_id, url, lower(regexp_extract(replace(trim(url), '\', '/'), '([^/]*)$', 1)) AS name FROM pages)
SELECT page_id,
       CASE WHEN length(name) > 1 THEN regexp_replace(name, '^(.+)\.[^.]*$', '\1') ELSE name END AS any_suffix,
       regexp_replace(name, '\.(npz|mp4|avi|mov|mkv)$', '') AS known_suffix
FROM p""")
def fn_video_key(t):
    url = F.col("url")
    return t("pages").select("page_id", X.video_key(url).alias("any_suffix"), X.video_key(url, X.VIDEO_SUFFIXES).alias("known_suffix"))


@query("fn_canonical_columns", """
SELECT o_orderstatus AS dataset, o_orderpriority AS gloss, o_orderkey AS video, o_totalprice, o_custkey
FROM orders""")
def fn_canonical_columns(t):
    source = t("orders").select(
        F.col("o_orderstatus").alias("DataSet"), F.col("o_orderpriority").alias("Label"),
        F.col("o_orderkey").alias("FILE"), "o_totalprice", "o_custkey",
    )
    return X.canonical_columns(source, {"dataset": ["dataset"], "gloss": ["gloss", "label"], "video": ["video", "file", "video_name", "path"]})


@query("fn_numeric_select", """
SELECT l_orderkey, l_linenumber, CAST(l_quantity AS DOUBLE) AS l_quantity, l_extendedprice, l_discount, l_tax,
       CAST(l_suppkey AS DOUBLE) AS l_suppkey, TRY_CAST(l_returnflag AS DOUBLE) AS l_returnflag
FROM lineitem""")
def fn_numeric_select(t):
    rows = t("lineitem")
    features = N.numeric_columns(rows, exclude=["l_orderkey", "l_linenumber", "l_partkey"]) + ["l_returnflag"]
    return N.select_numeric(rows, ["l_orderkey", "l_linenumber"], features)


@query("fn_prefix_columns", """
SELECT o_orderkey, o_totalprice AS orders__o_totalprice, o_orderstatus AS orders__o_orderstatus FROM orders""")
def fn_prefix_columns(t):
    return X.prefix_columns(t("orders").select("o_orderkey", "o_totalprice", "o_orderstatus"), "orders", keep=["o_orderkey"])


@query("fn_clean_nonfinite", """
SELECT event_id, CASE WHEN event_id % 7 IN (0, 1, 2) THEN NULL ELSE value END AS value FROM events""")
def fn_clean_nonfinite(t):
    kind = F.col("event_id") % 7
    dirty = (
        F.when(kind == 0, F.lit(float("nan"))).when(kind == 1, F.lit(float("inf"))).when(kind == 2, F.lit(float("-inf")))
        .otherwise(F.col("value"))
    )
    return N.clean_nonfinite(t("events").select("event_id", dirty.alias("value")))


@query("fn_region_gloss", """
WITH g AS (SELECT p_partkey, p_type || CASE p_partkey % 5 WHEN 0 THEN '_B' WHEN 1 THEN '_T' WHEN 2 THEN '_N' WHEN 3 THEN '_X' ELSE '' END AS gloss FROM part)
SELECT p_partkey, gloss, nullif(regexp_extract(gloss, '^(.+)_([BTN])$', 1), '') AS base,
       nullif(regexp_extract(gloss, '^(.+)_([BTN])$', 2), '') AS region
FROM g""")
def fn_region_gloss(t):
    suffix = F.element_at(F.array(*[F.lit(s) for s in ("_B", "_T", "_N", "_X", "")]), (F.col("p_partkey") % 5 + 1).cast("int"))
    rows = t("part").select("p_partkey", F.concat("p_type", suffix).alias("gloss"))
    base, region = X.region_of_label(F.col("gloss"))
    return rows.select("p_partkey", "gloss", base.alias("base"), region.alias("region"))


@query("fn_region_file", """
WITH f AS (SELECT p_partkey, 'D' || lpad(CAST(p_partkey AS VARCHAR), 6, '0') ||
           CASE p_partkey % 6 WHEN 0 THEN 'N' WHEN 1 THEN 't' WHEN 2 THEN 'B' WHEN 3 THEN 'Q' WHEN 4 THEN '' ELSE '-x' END || '.mp4' AS file FROM part)
SELECT p_partkey, CASE upper(regexp_extract(file, '^[A-Za-z]+[0-9]+([A-Za-z]*)[.][^.]+$', 1))
       WHEN 'N' THEN 'Nam' WHEN 'T' THEN 'Trung' WHEN 'B' THEN 'Bac' END AS variant
FROM f""")
def fn_region_file(t):
    letter = F.element_at(F.array(*[F.lit(s) for s in ("N", "t", "B", "Q", "", "-x")]), (F.col("p_partkey") % 6 + 1).cast("int"))
    name = F.concat(F.lit("D"), F.lpad(F.col("p_partkey").cast("string"), 6, "0"), letter, F.lit(".mp4"))
    return t("part").select("p_partkey", X.region_of_file(name).alias("variant"))


@query("fn_safe_folder", r"""
WITH c AS (SELECT page_id, trim(regexp_replace(trim(CASE WHEN page_id % 11 = 0 THEN ' .. ' ELSE url END), '[<>:"/\\|?*]', '_', 'g'), ' .') AS f FROM pages)
SELECT page_id, CASE WHEN f = '' THEN 'unknown_label' ELSE f END AS folder FROM c""")
def fn_safe_folder(t):
    label = F.when(F.col("page_id") % 11 == 0, F.lit(" .. ")).otherwise(F.col("url"))
    return t("pages").select("page_id", X.safe_folder(label).alias("folder"))


@query("fn_gloss_tokens", r"""
SELECT doc_id, md5(upper(trim(regexp_replace(replace(text, 'ß', 'ss'), '[\s\x0b\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+', ' ', 'g')))) AS tokens FROM documents""")
def fn_gloss_tokens(t):
    return t("documents").select("doc_id", F.md5(X.label_tokens(F.col("text"))).alias("tokens"))


@query("fn_resolution", """
SELECT p_partkey, CAST(p_size AS VARCHAR) || 'x' || CAST(p_partkey % 9 AS VARCHAR) AS resolution,
       CASE WHEN p_partkey % 4 < 2 THEN 'unknown' ELSE p_type END AS codec
FROM part""")
def fn_resolution(t):
    codec = F.when(F.col("p_partkey") % 4 == 0, F.lit("")).when(F.col("p_partkey") % 4 > 1, F.col("p_type"))
    return t("part").select(
        "p_partkey", X.resolution(F.col("p_size"), F.col("p_partkey") % 9).alias("resolution"), X.or_unknown(codec).alias("codec")
    )


FEATURE_NAMES = ["angle", "motion_features__hand_face", "finger_dir_x", "head_ratio", "one_two_hand", "plain", "palm_normal_y", "left_right_hand"]


@query("fn_feature_group", """
WITH n AS (SELECT p_partkey, p_type || '_' || ['angle','motion_features__hand_face','finger_dir_x','head_ratio','one_two_hand','plain','palm_normal_y','left_right_hand'][CAST(p_partkey % 8 + 1 AS BIGINT)] AS name FROM part)
SELECT p_partkey, CASE
  WHEN regexp_matches(lower(name), 'angle|distance_ratio|palm_width|openness|curvature|handshape') THEN 'handshape'
  WHEN regexp_matches(lower(name), 'motion|velocity|acceleration|trajectory|straightness|direction_change|dtw') THEN 'movement'
  WHEN regexp_matches(lower(name), 'finger_dir|palm_normal|orientation') THEN 'orientation'
  WHEN regexp_matches(lower(name), 'location|head_|shoulder_|chest_|waist_|body|face|left_right') THEN 'spatial relationship'
  WHEN regexp_matches(lower(name), 'one_two|has_left|has_right') THEN 'structure' ELSE 'other' END AS feature_group
FROM n""")
def fn_feature_group(t):
    names = F.array(*[F.lit(n) for n in FEATURE_NAMES])
    name = F.concat("p_type", F.lit("_"), F.element_at(names, (F.col("p_partkey") % 8 + 1).cast("int")))
    return t("part").select("p_partkey", X.feature_group(name).alias("feature_group"))


@query("fn_score_band", f"""
WITH s AS (SELECT vec_id, (CAST(embedding[1] AS DOUBLE) / sqrt(CAST(embedding[1] AS DOUBLE) * CAST(embedding[1] AS DOUBLE) + CAST(embedding[2] AS DOUBLE) * CAST(embedding[2] AS DOUBLE)) + 1) / 2 AS score FROM embeddings)
SELECT vec_id, {R('score')} AS score, CASE WHEN score >= 0.7 THEN 'high' WHEN score >= 0.5 THEN 'moderate' ELSE 'low' END AS band FROM s""")
def fn_score_band(t):
    a, b = (F.col("embedding")[i].cast("double") for i in (0, 1))
    score = N.similarity_score(a / F.sqrt(a * a + b * b))
    return t("embeddings").select("vec_id", r6(score).alias("score"), N.score_band(score).alias("band"))


@query("fn_minmax_direction", f"""
WITH m AS (SELECT avg(n_chars) FILTER (lang = 'en') AS m1, stddev_samp(n_chars) FILTER (lang = 'en') AS s1,
                  avg(n_chars) FILTER (lang = 'fr') AS m2, stddev_samp(n_chars) FILTER (lang = 'fr') AS s2 FROM documents),
b AS (SELECT *, list_min(list_filter([m1-s1, m1+s1, m2-s2, m2+s2], lambda x: x > 0)) AS lo,
                list_max(list_filter([m1-s1, m1+s1, m2-s2, m2+s2], lambda x: x > 0)) AS hi FROM m)
SELECT doc_id, {R('CASE WHEN hi - lo < 1e-4 THEN 0.5 ELSE least(1.0, greatest(0.0, (n_chars - lo) / (hi - lo))) END')} AS up,
       {R('CASE WHEN hi - lo < 1e-4 THEN 0.5 ELSE least(1.0, greatest(0.0, 1 - (n_chars - lo) / (hi - lo))) END')} AS down
FROM documents, b""")
def fn_minmax_direction(t):
    docs = t("documents")
    of = lambda f, lang: f(F.when(F.col("lang") == lang, F.col("n_chars")))
    stats = docs.agg(F.struct(*[of(f, l).alias(f"{n}{i}") for i, l in ((1, "en"), (2, "fr")) for n, f in (("m", F.avg), ("s", F.stddev_samp))]).alias("s"))
    rows = docs.select("doc_id", "n_chars", stats.scalar().alias("s"))
    means, stds = [F.col("s.m1"), F.col("s.m2")], [F.col("s.s1"), F.col("s.s2")]
    value = lambda low: N.directed_minmax(F.col("n_chars"), means, stds, F.lit(low))
    return rows.select("doc_id", r6(value(False)).alias("up"), r6(value(True)).alias("down"))
