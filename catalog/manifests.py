import tempfile

from pyspark.sql import functions as F

from catalog import R, query, rounded
from seqatlas.guards import must_hold, require_columns, single_corpus
from seqatlas.operators import manifest as M, report as P
from seqatlas.session import shared_folder
from seqatlas.sources import sinks as K
from seqatlas.streaming.resume import process_new_files


def folder(t, name):
    """A new folder for one run below the shared one."""
    import uuid

    return f"{shared_folder(t.spark)}/{name}-{uuid.uuid4().hex}"


@query("sink_stage_table", "SELECT o_orderstatus AS dataset, o_orderkey AS video, o_totalprice AS value FROM orders")
def sink_stage_table(t):
    path = folder(t, "stage")
    K.write_stage(t("orders").select(F.col("o_orderstatus").alias("dataset"), F.col("o_orderkey").alias("video"), F.col("o_totalprice").alias("value")), path)
    return t.spark.read.parquet(path)


@query("sink_summary_json", """
SELECT n_regionkey, '{"' || CAST(n_regionkey AS VARCHAR) || '":{"nations":' || count(*) || ',"largest":' || max(n_nationkey) || '}}' AS json FROM nation GROUP BY n_regionkey""")
def sink_summary_json(t):
    per_region = t("nation").groupBy("n_regionkey").agg(F.count(F.lit(1)).alias("nations"), F.max("n_nationkey").alias("largest"))
    return K.summary_json(per_region, "n_regionkey")


@query("sink_error_rows", """
SELECT event_id, CASE WHEN event_id % 50 = 0 THEN 'failed' ELSE 'good' END AS outcome FROM events""")
def sink_error_rows(t):
    rows = t("events").select("event_id", F.when(F.col("event_id") % 50 == 0, F.lit("load_failed: planted")).alias("error"))
    good, bad = K.split_errors(rows)
    return good.withColumn("outcome", F.lit("good")).unionByName(bad.select("event_id", F.lit("failed").alias("outcome")))


@query("manifest_group", "SELECT role AS label, conv_id * 1000 + turn AS video, row_number() OVER (PARTITION BY role ORDER BY conv_id * 1000 + turn) - 1 AS position FROM conversations")
def manifest_group(t):
    files = t("conversations").select(F.col("role").alias("label"), (F.col("conv_id") * 1000 + F.col("turn")).alias("video"))
    return M.group_files(files, "label", "video", bucket=F.floor(F.col("video") / 65_536))


@query("manifest_copy_plan", """
WITH s AS (SELECT source AS label, CASE WHEN doc_id % 10 = 3 THEN 'MISSING' WHEN doc_id IN (SELECT doc_id FROM labels) THEN 'SKIP' ELSE 'COPY' END AS status FROM documents)
SELECT label, count(*) AS files, count(*) FILTER (status = 'COPY') AS copy, count(*) FILTER (status = 'SKIP') AS skip, count(*) FILTER (status = 'MISSING') AS missing FROM s GROUP BY ALL""")
def manifest_copy_plan(t):
    docs = t("documents")
    plan = M.copy_plan(docs.select("doc_id", F.col("source").alias("label")), docs.filter("doc_id % 10 <> 3"), t("labels"), "doc_id")
    return M.plan_totals(plan)


@query("resume_pending", "SELECT doc_id, lang FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def resume_pending(t):
    return M.pending(t("documents").select("doc_id", "lang"), t("labels"), "doc_id")


@query("resume_streaming", "SELECT doc_id, quality, quality + toxic AS flags FROM labels")
def resume_streaming(t):
    """The stream form of resuming: two runs over the same folder process each file once."""
    source, target, checkpoint = (folder(t, n) for n in ("incoming", "done", "progress"))
    labels = t("labels").select("doc_id", "quality", "toxic")
    work = lambda df: df.select("doc_id", "quality", (F.col("quality") + F.col("toxic")).alias("flags"))
    for part in (0, 1):
        labels.filter(F.col("doc_id") % 2 == part).write.mode("append").parquet(source)
        process_new_files(t.spark, source, labels.schema, work, target, checkpoint)
    return t.spark.read.parquet(target)


@query("shard_labels", """
WITH l AS (SELECT DISTINCT p_brand AS label FROM part), r AS (SELECT label, row_number() OVER (ORDER BY label) AS label_rank, count(*) OVER () AS n_labels FROM l)
SELECT label, label_rank, n_labels, CAST(floor((label_rank - 1) / ceil(n_labels / 4)) + 1 AS BIGINT) AS shard, CAST(floor((label_rank - 1) / 10) + 1 AS BIGINT) AS block FROM r""")
def shard_labels(t):
    parts = t("part").select(F.col("p_brand").alias("label"))
    blocks = M.shard_labels(parts, "label", block=10).select("label", F.col("shard").alias("block"))
    return M.shard_labels(parts, "label", workers=4).join(blocks, "label")


@query("guard_required", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'F'")
def guard_required(t):
    rows = require_columns(t("orders"), ["o_orderkey", "o_totalprice", "o_orderstatus"], "orders")
    one = single_corpus(rows.filter("o_orderstatus = 'F'"), "o_orderstatus")
    return one.filter(must_hold(F.col("o_totalprice") >= 0, "negative price")).select("o_orderkey", "o_totalprice")


@query("chart_axis_ticks", """
WITH l AS (SELECT DISTINCT p_brand AS label FROM part), r AS (SELECT label, row_number() OVER (ORDER BY label) AS label_rank, count(*) OVER () AS n FROM l)
SELECT label, label_rank FROM r WHERE (label_rank - 1) % greatest(1, CAST(ceil(n / 10) AS BIGINT)) = 0""")
def chart_axis_ticks(t):
    return P.axis_ticks(M.number_labels(t("part").select(F.col("p_brand").alias("label")), "label"), "label", 10)
