from pyspark.sql import functions as F

from catalog import R, query, r6, rounded
from catalog.warping import drawn_sql
from seqatlas.operators import classes as C, ranking as RK, report as P

STATUS = "c AS (SELECT o_orderstatus AS dataset, o_orderpriority AS priority, o_custkey % 7 AS kind, count(*) AS count FROM orders GROUP BY ALL), p AS (SELECT *, count * 100.0 / sum(count) OVER (PARTITION BY dataset) AS percentage FROM c)"


@query("top_component", f"""
WITH {STATUS}, r AS (SELECT *, priority || ' / ' || kind AS component, row_number() OVER (PARTITION BY dataset ORDER BY count DESC, priority || ' / ' || kind) AS i FROM p)
SELECT dataset, component, count, {R('percentage')} AS percentage FROM r WHERE i <= 5""")
def top_component(t):
    rows = t("orders").select(F.col("o_orderstatus").alias("dataset"), F.col("o_orderpriority").alias("priority"), (F.col("o_custkey") % 7).alias("kind"))
    return rounded(RK.top_component(C.shares(rows, ["priority", "kind"]), ["priority", "kind"]))


@query("top_per_dataset", """
SELECT dataset, gloss, score FROM (SELECT p_brand AS dataset, p_partkey AS gloss, p_retailprice AS score, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey) AS i FROM part) WHERE i <= 50""")
def top_per_dataset(t):
    rows = t("part").select(F.col("p_brand").alias("dataset"), F.col("p_partkey").alias("gloss"), F.col("p_retailprice").alias("score"))
    return RK.top_per_group(rows, ["dataset"], [F.col("score").desc(), F.col("gloss")], 50)


@query("top_global", f"""
WITH s AS (SELECT vec_id, label, {R('CAST(embedding[1] AS DOUBLE) * CAST(embedding[2] AS DOUBLE)')} AS score FROM embeddings)
(SELECT 'best' AS list, * FROM s ORDER BY score DESC, vec_id LIMIT 20) UNION ALL (SELECT 'worst', * FROM s ORDER BY score, vec_id LIMIT 20)""")
def top_global(t):
    rows = t("embeddings").select("vec_id", "label", r6(F.col("embedding")[0].cast("double") * F.col("embedding")[1].cast("double")).alias("score"))
    pick = lambda name, order: RK.top_overall(rows, [order, F.col("vec_id")], 20).select(F.lit(name).alias("list"), "*")
    return pick("best", F.col("score").desc()).unionByName(pick("worst", F.col("score").asc()))


@query("rank_dataset_order", f"""
WITH m AS (SELECT o_orderpriority AS dataset, o_custkey AS gloss, {R('avg(o_totalprice)', 4)} AS metric FROM orders GROUP BY ALL) SELECT * FROM m""")
def rank_dataset_order(t):
    rows = t("orders").groupBy(F.col("o_orderpriority").alias("dataset"), F.col("o_custkey").alias("gloss")).agg(r6(F.avg("o_totalprice"), 4).alias("metric"))
    return RK.ranked(rows, ["5-LOW", "1-URGENT"], "metric", "gloss")


@query("set_union_components", f"""
WITH a AS (SELECT o_orderstatus AS dataset, o_orderpriority AS component, count(*) AS count FROM orders GROUP BY ALL), b AS (SELECT CAST(c_nationkey % 3 AS VARCHAR) AS dataset, c_mktsegment AS component, count(*) AS count FROM customer GROUP BY ALL)
SELECT *, {R('count * 100.0 / sum(count) OVER (PARTITION BY dataset)')} AS percentage, 'orders' AS analysis FROM a UNION ALL SELECT *, {R('count * 100.0 / sum(count) OVER (PARTITION BY dataset)')}, 'segments' FROM b""")
def set_union_components(t):
    orders = t("orders").select(F.col("o_orderstatus").alias("dataset"), F.col("o_orderpriority").alias("component"))
    people = t("customer").select((F.col("c_nationkey") % 3).cast("string").alias("dataset"), F.col("c_mktsegment").alias("component"))
    out = RK.stack_summaries({"orders": C.shares(orders, ["component"]), "segments": C.shares(people, ["component"])})
    return rounded(out.drop("dataset_total"))


@query("set_distinct_pairs", "SELECT l_partkey, l_suppkey, count(*) AS copies FROM lineitem GROUP BY ALL")
def set_distinct_pairs(t):
    from seqatlas.operators.joins import distinct_pairs

    return distinct_pairs(t("lineitem"), "l_partkey", "l_suppkey").select(
        F.col("l_partkey").cast("long").alias("l_partkey"), F.col("l_suppkey").cast("long").alias("l_suppkey"), "copies"
    )


@query("sample_pairs_seeded", f"WITH {drawn_sql('embeddings', 'label', 25)} SELECT * FROM drawn")
def sample_pairs_seeded(t):
    """At most 25 pairs of each label; a pair is drawn by its number, and only drawn ones are built."""
    return RK.draw_pairs(t("embeddings").select("label", "vec_id"), "vec_id", ["label"], 25)


@query("chart_histogram", f"""
WITH e AS (SELECT event_type AS dataset, CASE WHEN event_id % 8 = 0 THEN NULL ELSE value END AS v FROM events), n AS (SELECT least(30, greatest(10, CAST(floor(sqrt(count(v))) AS INT))) AS bins FROM e),
s AS (SELECT dataset, min(v) AS lo, max(v) AS hi, any_value(bins) AS bins FROM e, n GROUP BY dataset)
SELECT dataset, CAST(least(floor((v - lo) / ((hi - lo) / bins)), bins - 1) AS INTEGER) AS bin, {R('any_value(lo + least(floor((v - lo) / ((hi - lo) / bins)), bins - 1) * ((hi - lo) / bins))')} AS left_edge,
  {R('any_value(lo + (least(floor((v - lo) / ((hi - lo) / bins)), bins - 1) + 1) * ((hi - lo) / bins))')} AS right_edge, count(*) AS count FROM e JOIN s USING (dataset) WHERE v IS NOT NULL GROUP BY dataset, bin""")
def chart_histogram(t):
    rows = t("events").select(F.col("event_type").alias("dataset"), F.when(F.col("event_id") % 8 != 0, F.col("value")).alias("v"))
    return rounded(P.histogram(rows, "v", groups=["dataset"]))


@query("chart_boxplot", f"""
WITH q AS (SELECT o_orderstatus AS dataset, quantile_cont(o_totalprice, 0.25) AS q1, median(o_totalprice) AS median, quantile_cont(o_totalprice, 0.75) AS q3 FROM orders GROUP BY ALL)
SELECT dataset, {R('any_value(q1)')} AS q1, {R('any_value(median)')} AS median, {R('any_value(q3)')} AS q3, {R('min(o_totalprice) FILTER (o_totalprice >= q1 - 1.5 * (q3 - q1))')} AS whisker_low,
  {R('max(o_totalprice) FILTER (o_totalprice <= q3 + 1.5 * (q3 - q1))')} AS whisker_high, count(*) FILTER (o_totalprice < q1 - 1.5 * (q3 - q1) OR o_totalprice > q3 + 1.5 * (q3 - q1)) AS outliers
FROM orders JOIN q ON o_orderstatus = dataset GROUP BY dataset""")
def chart_boxplot(t):
    return rounded(P.boxplot(t("orders").withColumn("dataset", F.col("o_orderstatus")), "o_totalprice"))


@query("chart_scatter_points", """
SELECT l_returnflag AS dataset, l_quantity AS x, l_extendedprice AS y FROM lineitem WHERE l_linenumber NOT IN (2, 5)""")
def chart_scatter_points(t):
    x = F.when(F.col("l_linenumber") == 2, F.lit(float("nan"))).otherwise(F.col("l_quantity"))
    y = F.when(F.col("l_linenumber") != 5, F.col("l_extendedprice"))
    return P.scatter_points(t("lineitem").select(F.col("l_returnflag").alias("dataset"), x.alias("a"), y.alias("b")), "a", "b")
