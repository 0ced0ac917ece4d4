from pyspark.sql import functions as F

from catalog import R, query, rounded
from seqatlas.functions import text as X
from seqatlas.operators import classes as C, report as P

COUNTS = "c AS (SELECT l_returnflag AS dataset, l_partkey AS class_name, count(*) AS n FROM lineitem GROUP BY ALL)"


def samples(t):
    return t("lineitem").select(F.col("l_returnflag").alias("dataset"), F.col("l_partkey").alias("class_name"), "l_suppkey", "l_linenumber")


def counts(t):
    return C.distribution(samples(t))


@query("agg_percent_of_group", f"""
WITH c AS (SELECT o_orderstatus AS dataset, o_orderpriority AS priority, count(*) AS count FROM orders GROUP BY ALL)
SELECT *, CAST(sum(count) OVER (PARTITION BY dataset) AS BIGINT) AS dataset_total,
       {R('count * 100.0 / sum(count) OVER (PARTITION BY dataset)')} AS percentage FROM c""")
def agg_percent_of_group(t):
    rows = t("orders").select(F.col("o_orderstatus").alias("dataset"), F.col("o_orderpriority").alias("priority"))
    return rounded(C.shares(rows, ["priority"]))


@query("cls_distribution", "SELECT l_returnflag AS dataset, l_partkey AS class_name, count(*) AS sample_count FROM lineitem GROUP BY ALL")
def cls_distribution(t):
    return counts(t)


@query("cls_summary", f"""
WITH c AS (SELECT o_orderstatus AS dataset, o_custkey, count(*) AS n, count(*) FILTER (o_totalprice <= 5000) AS bad FROM orders GROUP BY ALL),
s AS (SELECT o_orderstatus AS dataset, count(DISTINCT o_orderpriority) AS num_signers FROM orders GROUP BY ALL)
SELECT dataset, count(*) AS num_classes, CAST(sum(n) AS BIGINT) AS num_videos, CAST(sum(bad) AS BIGINT) AS num_unreadable,
       {R('avg(n)')} AS mean_samples_per_class, min(n) AS min_samples_per_class, max(n) AS max_samples_per_class,
       {R('median(n)')} AS median_samples_per_class, any_value(num_signers) AS num_signers
FROM c JOIN s USING (dataset) GROUP BY dataset""")
def cls_summary(t):
    rows = t("orders").select(
        F.col("o_orderstatus").alias("dataset"), F.col("o_custkey").alias("class_name"), "o_totalprice", "o_orderpriority"
    )
    return rounded(C.summary(rows, readable=F.col("o_totalprice") > 5000, signer="o_orderpriority"))


@query("cls_video_statistics", f"""
WITH v AS (SELECT p_brand AS dataset, unnest(['size', 'price']) AS attribute, unnest([CAST(p_size AS DOUBLE), p_retailprice]) AS v
           FROM part WHERE p_partkey % 13 <> 0)
SELECT dataset, attribute, count(*) AS n, {R('avg(v)')} AS mean, {R('coalesce(stddev_samp(v), 0)')} AS std,
       {R('min(v)')} AS min, {R('max(v)')} AS max, {R('median(v)')} AS median
FROM v GROUP BY ALL""")
def cls_video_statistics(t):
    rows = t("part").select(F.col("p_brand").alias("dataset"), F.col("p_size").alias("size"), F.col("p_retailprice").alias("price"), "p_partkey")
    return rounded(C.attribute_statistics(rows, ["size", "price"], readable=F.col("p_partkey") % 13 != 0))


@query("cls_resolution_freq", f"""
SELECT p_size || 'x' || p_brand AS resolution, count(*) AS count, {R('count(*) * 1.0 / (SELECT count(*) FROM part)')} AS proportion
FROM part GROUP BY ALL ORDER BY count DESC, resolution LIMIT 10""")
def cls_resolution_freq(t):
    return rounded(C.top_frequencies(t("part"), X.resolution(F.col("p_size"), F.col("p_brand")), 10, "resolution"))


@query("cls_codec_freq", f"""
SELECT CASE WHEN event_id % 9 = 0 THEN 'unknown' ELSE event_type END AS codec, count(*) AS count,
       {R('count(*) * 1.0 / (SELECT count(*) FROM events)')} AS proportion
FROM events GROUP BY ALL""")
def cls_codec_freq(t):
    codec = F.when(F.col("event_id") % 9 != 0, F.col("event_type"))
    return rounded(C.top_frequencies(t("events"), X.or_unknown(codec), name="codec"))


@query("cls_region_freq", f"""
SELECT coalesce(nullif(c_mktsegment, 'BUILDING'), '(none)') AS variant, count(*) AS count,
       {R('count(*) * 1.0 / (SELECT count(*) FROM customer)')} AS proportion
FROM customer GROUP BY ALL""")
def cls_region_freq(t):
    variant = F.coalesce(F.nullif("c_mktsegment", F.lit("BUILDING")), F.lit("(none)"))
    return rounded(C.top_frequencies(t("customer"), variant, name="variant"))


@query("cls_signer_distribution", f"""
WITH e AS (SELECT event_type AS dataset, nullif(user_id, 7) AS signer FROM events),
s AS (SELECT dataset, signer, count(*) AS n FROM e WHERE signer IS NOT NULL GROUP BY ALL)
SELECT dataset, count(*) AS num_signers, {R('avg(n)')} AS mean_samples_per_signer, min(n) AS min_samples_per_signer, max(n) AS max_samples_per_signer
FROM s GROUP BY dataset""")
def cls_signer_distribution(t):
    rows = t("events").select(F.col("event_type").alias("dataset"), F.nullif("user_id", F.lit(7)).alias("signer"))
    return rounded(C.signer_diversity(rows, "signer"))


REGION_SUMMARY = """
r AS (SELECT r_name AS dataset, o_custkey, o_totalprice FROM orders JOIN customer ON o_custkey = c_custkey
      JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey),
k AS (SELECT dataset, o_custkey, count(*) AS n FROM r GROUP BY ALL),
s AS (SELECT dataset, CAST(count(*) AS DOUBLE) AS num_classes, CAST(sum(n) AS DOUBLE) AS num_videos, avg(n) AS mean_samples_per_class, median(n) AS median_samples_per_class FROM k GROUP BY ALL),
d AS (SELECT dataset, avg(o_totalprice) AS mean_duration FROM r GROUP BY ALL)"""
REGIONS = ("AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST")


def region_orders(t):

    places = t("nation").join(t("region"), F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", "r_name")
    customers = t("customer").join(places, F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", "r_name")
    return t("orders").join(customers, F.col("o_custkey") == F.col("c_custkey")).select(
        F.col("r_name").alias("dataset"), F.col("o_custkey").alias("class_name"), "o_totalprice"
    )


def region_summary(t):
    rows = region_orders(t)
    duration = rows.groupBy("dataset").agg(F.avg("o_totalprice").alias("mean_duration"))
    return C.summary(rows).join(duration, "dataset")


METRICS = ("num_classes", "num_videos", "mean_samples_per_class", "median_samples_per_class", "mean_duration")


@query("cls_comparison_table", f"""
WITH {REGION_SUMMARY},
l AS (SELECT dataset, unnest({list(METRICS)}) AS metric, unnest([{', '.join(METRICS)}]) AS value FROM s JOIN d USING (dataset))
SELECT metric, {', '.join(f'''{R(f"max(value) FILTER (dataset = '{d}')")} AS "{d}"''' for d in REGIONS)},
       {', '.join(f'''{R(f"max(value) FILTER (dataset = '{d}') / max(value)")} AS "{d}_relative"''' for d in REGIONS)}
FROM l GROUP BY metric""")
def cls_comparison_table(t):
    return rounded(C.comparison_table(region_summary(t), METRICS, REGIONS))


@query("cls_gini", f"""
WITH {COUNTS}, r AS (SELECT dataset, n, row_number() OVER (PARTITION BY dataset ORDER BY n, class_name) AS i, count(*) OVER (PARTITION BY dataset) AS k FROM c)
SELECT dataset, {R('sum((2 * i - k - 1) * n) * 1.0 / (any_value(k) * sum(n))')} AS gini FROM r GROUP BY dataset""")
def cls_gini(t):
    return rounded(C.gini(counts(t)))


TAILS = """
r AS (SELECT dataset, n, row_number() OVER (PARTITION BY dataset ORDER BY n DESC, class_name) AS d,
             row_number() OVER (PARTITION BY dataset ORDER BY n, class_name) AS a,
             greatest(1, CAST(ceil(count(*) OVER (PARTITION BY dataset) * 0.1) AS BIGINT)) AS k FROM c)"""


@query("cls_tail_shares", f"""
WITH {COUNTS}, {TAILS}
SELECT dataset, any_value(k) AS tail_size, {R('sum(n) FILTER (d <= k) * 1.0 / sum(n)')} AS top_share, {R('sum(n) FILTER (a <= k) * 1.0 / sum(n)')} AS bottom_share
FROM r GROUP BY dataset""")
def cls_tail_shares(t):
    return rounded(C.tail_shares(counts(t)))


@query("cls_imbalance", f"""
WITH {COUNTS}, {TAILS}, g AS (SELECT *, count(*) OVER (PARTITION BY dataset) AS q FROM r)
SELECT dataset, count(*) AS num_classes, max(n) AS max_samples, min(n) AS min_samples, {R('avg(n)')} AS mean_samples, {R('median(n)')} AS median_samples,
       {R('stddev_samp(n)')} AS std_samples, {R('max(n) * 1.0 / min(n)')} AS imbalance_ratio, {R('stddev_samp(n) / avg(n)')} AS coefficient_of_variation,
       {R('sum((2 * a - q - 1) * n) * 1.0 / (any_value(q) * sum(n))')} AS gini,
       {R('sum(n) FILTER (d <= k) * 1.0 / sum(n)')} AS top_share, {R('sum(n) FILTER (a <= k) * 1.0 / sum(n)')} AS bottom_share
FROM g GROUP BY dataset""")
def cls_imbalance(t):
    return rounded(C.imbalance(counts(t)))


@query("cls_lorenz", f"""
WITH {COUNTS}, r AS (SELECT dataset, row_number() OVER w AS position, sum(n) OVER (w ROWS UNBOUNDED PRECEDING) AS run,
       count(*) OVER (PARTITION BY dataset) AS k, sum(n) OVER (PARTITION BY dataset) AS total FROM c WINDOW w AS (PARTITION BY dataset ORDER BY n, class_name))
SELECT dataset, position, {R('position * 1.0 / k')} AS class_fraction, {R('run * 1.0 / total')} AS sample_fraction FROM r
UNION ALL SELECT DISTINCT dataset, CAST(0 AS BIGINT), 0.0, 0.0 FROM c""")
def cls_lorenz(t):
    return rounded(C.lorenz(counts(t)))


@query("cls_cumulative", f"""
WITH {COUNTS}, r AS (SELECT dataset, class_name, n AS sample_count, row_number() OVER w AS rank, sum(n) OVER (w ROWS UNBOUNDED PRECEDING) * 1.0 / sum(n) OVER (PARTITION BY dataset) AS f
       FROM c WINDOW w AS (PARTITION BY dataset ORDER BY n DESC, class_name))
SELECT dataset, class_name, sample_count, rank, {R('f')} AS cumulative_fraction FROM r""")
def cls_cumulative(t):
    return rounded(C.cumulative(counts(t), bucket=F.floor(F.col("class_name") / 65_536)))


@query("rpt_label_sparsity", f"""
WITH {COUNTS}
SELECT dataset, count(*) AS labels, CAST(sum(n) AS BIGINT) AS videos, {R('median(n)')} AS median_samples, {R('avg(n)')} AS mean_samples,
       min(n) AS min_samples, max(n) AS max_samples, count(*) FILTER (n < 2) AS labels_lt2, count(*) FILTER (n < 5) AS labels_lt5, count(*) FILTER (n < 10) AS labels_lt10
FROM c GROUP BY dataset""")
def rpt_label_sparsity(t):
    return rounded(P.label_sparsity(counts(t)))


@query("rpt_facts", f"""
WITH {REGION_SUMMARY}, a AS (SELECT * FROM s JOIN d USING (dataset)),
f AS (SELECT 'larger_corpus' AS fact, dataset, num_videos AS value, row_number() OVER (ORDER BY num_videos DESC, dataset) AS i FROM a
  UNION ALL SELECT 'most_classes', dataset, num_classes, row_number() OVER (ORDER BY num_classes DESC, dataset) FROM a
  UNION ALL SELECT 'denser_corpus', dataset, mean_samples_per_class, row_number() OVER (ORDER BY mean_samples_per_class DESC, dataset) FROM a
  UNION ALL SELECT 'shortest_mean', dataset, mean_duration, row_number() OVER (ORDER BY mean_duration, dataset) FROM a)
SELECT fact, dataset, {R('value')} AS value FROM f WHERE i = 1
UNION ALL SELECT 'num_classes', dataset, {R('num_classes')} FROM a""")
def rpt_facts(t):
    best = {
        "larger_corpus": ("num_videos", True), "most_classes": ("num_classes", True),
        "denser_corpus": ("mean_samples_per_class", True), "shortest_mean": ("mean_duration", False),
    }
    return rounded(P.corpus_facts(region_summary(t), best, each=["num_classes"]))
