from pyspark.sql import functions as F

from catalog import R, query, r6, rounded
from catalog.features import LINE, line_rows
from seqatlas.functions import text as X
from seqatlas.operators import features as FE, joins as J, profile as PR, scaling as SC

ORDERS = "o AS (SELECT o_orderkey AS video, o_orderstatus AS status, o_totalprice AS price FROM orders WHERE o_orderkey % 5 <> 0), lv AS (SELECT l_orderkey AS video, avg(l_quantity) AS quantity FROM lineitem GROUP BY ALL), sv AS (SELECT l_orderkey AS video, max(l_tax) AS tax FROM lineitem WHERE l_linenumber > 2 GROUP BY ALL)"


def order_tables(t):
    orders = t("orders").filter(F.col("o_orderkey") % 5 != 0).select(
        F.col("o_orderkey").alias("video"), F.col("o_orderstatus").alias("status"), F.col("o_totalprice").alias("price")
    )
    lines = t("lineitem").groupBy(F.col("l_orderkey").alias("video")).agg(F.avg("l_quantity").alias("quantity"))
    taxes = t("lineitem").filter("l_linenumber > 2").groupBy(F.col("l_orderkey").alias("video")).agg(F.max("l_tax").alias("tax"))
    return [orders, lines, taxes]


@query("join_features_outer", f"WITH {ORDERS} SELECT video, status, price, {R('quantity')} AS quantity, tax FROM o FULL JOIN lv USING (video) FULL JOIN sv USING (video)")
def join_features_outer(t):
    return rounded(J.merge_outer(order_tables(t), ["video"]), "quantity")


@query("join_features_inner", f"WITH {ORDERS} SELECT video, status, price, {R('quantity')} AS quantity, tax FROM o JOIN lv USING (video) JOIN sv USING (video)")
def join_features_inner(t):
    return rounded(J.merge_inner(order_tables(t), ["video"]), "quantity")


MAPPING = """mp AS (SELECT CAST(n_nationkey % 12 AS VARCHAR) AS l, CASE WHEN n_nationkey = 7 THEN ' ' ELSE CAST(n_nationkey % 4 + 6 AS VARCHAR) END AS r FROM nation UNION ALL SELECT CAST(n_nationkey % 12 AS VARCHAR), CAST(n_nationkey % 4 + 6 AS VARCHAR) FROM nation WHERE n_nationkey < 5),
us AS (SELECT trim(l) AS l, trim(r) AS r, count(*) AS c FROM mp WHERE trim(l) <> '' AND trim(r) <> '' GROUP BY ALL),
ll AS (SELECT DISTINCT CAST(label AS VARCHAR) AS l FROM embeddings WHERE vec_id % 2 = 0), rl AS (SELECT DISTINCT CAST(label AS VARCHAR) AS r FROM embeddings WHERE vec_id % 2 = 1 AND label <> 8),
st AS (SELECT us.l, us.r, c, CASE WHEN ll.l IS NULL THEN 'missing_left' WHEN rl.r IS NULL THEN 'missing_right' ELSE 'matched' END AS status FROM us LEFT JOIN ll USING (l) LEFT JOIN rl USING (r))"""


def mapping(t):
    n = t("nation").withColumn("k", F.col("n_nationkey"))
    left, right = (F.col("k") % 12).cast("string").alias("l"), (F.col("k") % 4 + 6).cast("string")
    first = n.select(left, F.when(F.col("k") == 7, F.lit(" ")).otherwise(right).alias("r"))
    return first.unionByName(n.filter("k < 5").select(left, right.alias("r")))


def sides(t):
    e = t("embeddings").withColumn("label", F.col("label").cast("string"))
    return e.filter("vec_id % 2 = 0").withColumn("l", F.col("label")), e.filter("vec_id % 2 = 1 AND label <> '8'").withColumn("r", F.col("label"))


@query("join_mapping_pairs", f"WITH {MAPPING} SELECT l, r, c AS copies, status FROM st")
def join_mapping_pairs(t):
    left, right = sides(t)
    return J.mapping_status(mapping(t), left, right, "l", "r")


@query("validate_merge", f"""
WITH {LINE}, {MAPPING}
SELECT 'rows_before' AS fact, CAST(count(*) AS DOUBLE) AS value FROM li
UNION ALL SELECT 'unique_videos', count(DISTINCT (dataset, video)) FROM li UNION ALL SELECT 'unique_labels', count(DISTINCT (dataset, gloss)) FROM li
UNION ALL SELECT 'rows_after', count(*) FROM (SELECT DISTINCT dataset, gloss, video FROM li)
UNION ALL SELECT 'mapping_rows', count(*) FROM mp UNION ALL SELECT 'mapping_pairs_unique', count(*) FROM st
UNION ALL SELECT 'mapping_pairs_matched', count(*) FILTER (status = 'matched') FROM st UNION ALL SELECT 'missing_left', count(*) FILTER (status = 'missing_left') FROM st
UNION ALL SELECT 'missing_right', count(*) FILTER (status = 'missing_right') FROM st UNION ALL SELECT 'duplicate_pairs_removed', sum(c - 1) FROM st""")
def validate_merge(t):
    rows = line_rows(t)
    after = FE.mean_by(rows, ["dataset", "gloss", "video"], ["quantity"])
    left, right = sides(t)
    merge = PR.merge_facts(rows, after, video=["dataset", "video"], label=["dataset", "gloss"])
    return merge.unionByName(PR.mapping_facts(mapping(t), left, right, "l", "r"))


@query("join_region_pairs", """
WITH g AS (SELECT p_brand || '_' || p_type AS base, CASE p_partkey % 3 WHEN 0 THEN 'B' WHEN 1 THEN 'T' ELSE 'N' END AS region, count(*) AS n FROM part GROUP BY ALL)
SELECT a.base, a.region AS region_a, b.region AS region_b, a.n AS n_a, b.n AS n_b FROM g a JOIN g b ON a.base = b.base AND a.region < b.region""")
def join_region_pairs(t):
    letter = F.when(F.col("p_partkey") % 3 == 0, "_B").when(F.col("p_partkey") % 3 == 1, "_T").otherwise("_N")
    base, region = X.region_of_label(F.concat("p_brand", F.lit("_"), "p_type", letter))
    labels = t("part").select(base.alias("base"), region.alias("region")).groupBy("base", "region").agg(F.count(F.lit(1)).alias("n"))
    return J.region_pairs(labels, "base", "region", ["n"])


@query("join_all_pairs", f"""
WITH c AS (SELECT label, avg(CAST(embedding[1] AS DOUBLE)) AS m FROM embeddings GROUP BY ALL)
SELECT a.label AS label_a, b.label AS label_b, {R('a.m')} AS m_a, {R('b.m')} AS m_b FROM c a JOIN c b ON a.label < b.label""")
def join_all_pairs(t):
    means = t("embeddings").groupBy("label").agg(F.avg(F.col("embedding")[0].cast("double")).alias("m"))
    return rounded(J.pairs_within(means, "label"))


@query("join_intra_pairs", """
SELECT a.label, a.vec_id % 2 AS dataset, a.vec_id AS vec_id_a, b.vec_id AS vec_id_b FROM embeddings a JOIN embeddings b ON a.label = b.label AND a.vec_id % 2 = b.vec_id % 2 AND a.vec_id < b.vec_id""")
def join_intra_pairs(t):
    rows = t("embeddings").select((F.col("vec_id") % 2).alias("dataset"), "label", "vec_id")
    return J.pairs_within(rows, "vec_id", ["dataset", "label"])


@query("join_attach_label", """
SELECT s_suppkey, s_name, n_name, p.mean_price IS NOT NULL AS has_price, round(p.mean_price + 1e-9, 4) + 0.0 AS mean_price FROM supplier LEFT JOIN nation ON n_nationkey = CASE WHEN s_suppkey % 3 = 0 THEN -1 - s_nationkey ELSE s_nationkey END
LEFT JOIN (SELECT l_suppkey, avg(l_extendedprice) AS mean_price FROM lineitem GROUP BY ALL) p ON l_suppkey = CASE WHEN s_suppkey % 4 = 0 THEN -s_suppkey ELSE s_suppkey END""")
def join_attach_label(t):
    """All nations and line items; suppliers whose key is turned negative find none."""
    nations = t("nation").select(F.col("n_nationkey").cast("long").alias("nation_key"), "n_name")
    prices = t("lineitem").groupBy(F.col("l_suppkey").cast("long").alias("price_key")).agg(F.avg("l_extendedprice").alias("mean_price"))
    key = lambda lost, c, other: F.when(lost, other).otherwise(F.col(c)).cast("long")
    suppliers = t("supplier").select(
        "s_suppkey", "s_name", key(F.col("s_suppkey") % 3 == 0, "s_nationkey", -1 - F.col("s_nationkey")).alias("nation_key"),
        key(F.col("s_suppkey") % 4 == 0, "s_suppkey", -F.col("s_suppkey")).alias("price_key"),
    )
    rows = J.attach_small(suppliers, nations, "nation_key")
    out = J.attach_salted(rows, prices, ["price_key"], ["s_name"])
    return out.select("s_suppkey", "s_name", "n_name", F.col("mean_price").isNotNull().alias("has_price"), r6("mean_price", 4).alias("mean_price"))


@query("profile_table", """
WITH n AS (SELECT count(*) AS r FROM lineitem)
SELECT c AS "column", d AS dtype, CASE WHEN d IN ('string', 'timestamp_ntz', 'timestamp') THEN 'categorical' ELSE 'numeric' END AS kind, r AS rows,
  CASE WHEN c = 'l_tax' THEN (SELECT count(*) FROM lineitem WHERE l_linenumber = 2) ELSE 0 END AS nulls, CASE WHEN c = 'l_discount' THEN (SELECT count(*) FROM lineitem WHERE l_linenumber = 3) ELSE 0 END AS nans
FROM n, (VALUES ('l_orderkey', 'bigint'), ('l_linenumber', 'int'), ('l_quantity', 'double'), ('l_discount', 'double'), ('l_tax', 'double'), ('l_returnflag', 'string')) v(c, d)""")
def profile_table(t):
    nan = F.when(F.col("l_linenumber") == 3, F.lit(float("nan"))).otherwise(F.col("l_discount"))
    tax = F.when(F.col("l_linenumber") != 2, F.col("l_tax"))
    rows = t("lineitem").select("l_orderkey", "l_linenumber", "l_quantity", nan.alias("l_discount"), tax.alias("l_tax"), "l_returnflag")
    return PR.profile_table(rows)


@query("profile_arrays", """
WITH a AS (SELECT label, vec_id, CASE WHEN vec_id % 17 = 0 THEN 0 WHEN vec_id % 5 = 0 AND label < 5 THEN 10 ELSE 64 END AS length, vec_id % 11 = 0 AS n, vec_id % 13 = 0 AS i FROM embeddings),
s AS (SELECT label, length, count(*) AS arrays, count(*) FILTER (n AND length > 1) AS with_nan, count(*) FILTER (i AND length > 2) AS with_inf, count(*) FILTER (length = 0) AS empty FROM a GROUP BY ALL)
SELECT label, CAST(length AS INTEGER) AS length, arrays, with_nan, with_inf, empty, count(*) OVER (PARTITION BY label) = 1 AS consistent FROM s""")
def profile_arrays(t):
    e, v = F.col("embedding"), F.col("vec_id")
    bad = F.transform(e, lambda x, i: F.when((i == 1) & (v % 11 == 0), F.lit(float("nan"))).when((i == 2) & (v % 13 == 0), F.lit(float("inf"))).otherwise(x.cast("double")))
    cut = F.when(v % 17 == 0, F.slice(bad, 1, 0)).when((v % 5 == 0) & (F.col("label") < 5), F.slice(bad, 1, 10)).otherwise(bad)
    return PR.profile_arrays(t("embeddings").withColumn("a", cut), ["label"], "a")
