"""The end-to-end jobs on small derived tables."""

from pyspark.sql import functions as F

from catalog.series import centers
from seqatlas.operators import features as FE
from seqatlas.plans import jobs


def test_imbalance_job(spark, tables, tmp_path):
    o = tables("orders")
    videos = o.select(
        F.col("o_orderstatus").alias("dataset"), (F.col("o_custkey") % 40).cast("string").alias("class_name"), (F.col("o_orderkey") % 9 > 0).alias("readable"),
        F.col("o_orderpriority").alias("signer_id"), F.col("o_totalprice").alias("duration_seconds"), F.lit(25.0).alias("fps"),
    )
    jobs.imbalance_job(videos, str(tmp_path), ["duration_seconds", "fps"])
    corpora = videos.select("dataset").distinct().count()
    assert spark.read.parquet(f"{tmp_path}/imbalance").count() == corpora
    assert spark.read.parquet(f"{tmp_path}/video_statistics").count() == 2 * corpora
    curve = spark.read.parquet(f"{tmp_path}/cumulative")
    assert curve.filter("cumulative_fraction = 1").count() == corpora


def test_motion_job(spark, tables, tmp_path):
    c = centers(tables).select(
        (F.col("user_id") % 2).cast("string").alias("dataset"), (F.col("user_id") % 5).cast("string").alias("label"), F.col("user_id").alias("sample_id"), "*"
    ).drop("user_id")
    jobs.motion_job(c, str(tmp_path), F.lit(25.0))
    per_video = spark.read.parquet(f"{tmp_path}/motion_features_per_video")
    assert per_video.count() == c.select("sample_id").distinct().count()
    assert spark.read.parquet(f"{tmp_path}/trajectories").count() == 30 * per_video.count()
    labels = spark.read.parquet(f"{tmp_path}/motion_features_by_label")
    assert labels.agg(F.max("motion_complexity_score")).collect()[0][0] <= 1


def test_feature_space_job(spark, tables, tmp_path):
    e = tables("embeddings").select(
        F.when(F.col("vec_id") % 2 == 0, " vs ").otherwise("as").alias("dataset"), F.col("label").cast("string").alias("gloss"),
        F.concat(F.lit("d/"), F.col("vec_id").cast("string"), F.lit(".npz")).alias("video"), "embedding",
    )
    pick = lambda names, shift: e.select("dataset", "gloss", "video", *[F.col("embedding")[(i + shift) % 64].alias(n) for i, n in enumerate(names)])
    stage = {name: pick(cols, 7 * k) for k, (name, cols) in enumerate(FE.STAGE_FEATURES.items())}
    mapping = spark.createDataFrame([(str(i), str((i + 1) % 10)) for i in range(10)] + [("0", "1"), ("x", "1")], "left string, right string")
    jobs.feature_space_job(stage, mapping, "VS", "AS", str(tmp_path))
    scores = spark.read.parquet(f"{tmp_path}/label_similarity").collect()
    assert len(scores) == 10 and all(0 <= r.similarity_score <= 1 and r.coverage_left == 1.0 for r in scores)
    assert spark.read.parquet(f"{tmp_path}/signer_variation").count() == 20
    metrics = spark.read.parquet(f"{tmp_path}/feature_space_metrics").collect()
    assert len(metrics) == 2 and all(-1 <= r.silhouette_score <= 1 and r.feature_dimension == 80 for r in metrics)
