"""The three analyses end to end. Every stage is written before the next one reads it."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from seqatlas.distribution import Sequences
from seqatlas.functions.numbers import select_numeric
from seqatlas.functions.text import dataset_key, text_key, video_key
from seqatlas.operators import classes, features as FE, joins, scaling, separability, sequences as S, similarity, variation
from seqatlas.session import cut_lineage
from seqatlas.sources.sinks import write_stage


def imbalance_job(videos: DataFrame, out: str, attributes: Sequence[str] = ("duration_seconds", "frame_count", "fps", "width", "height")) -> None:
    """Corpus scale and class imbalance from video metadata rows."""
    counts = cut_lineage(classes.distribution(videos))
    write_stage(classes.summary(videos, readable=F.col("readable"), signer="signer_id"), f"{out}/dataset_summary")
    write_stage(classes.attribute_statistics(videos, list(attributes), F.col("readable")), f"{out}/video_statistics")
    write_stage(classes.imbalance(counts), f"{out}/imbalance")
    write_stage(classes.lorenz(counts), f"{out}/lorenz")
    write_stage(classes.cumulative(counts), f"{out}/cumulative")


LABEL_MEANS = {
    "mean_total_motion": "total_motion", "mean_velocity": "mean_velocity", "motion_variance_mean": "motion_variance",
    "acceleration_mean": "mean_acceleration", "trajectory_length_mean": "trajectory_length", "straightness_mean": "straightness_ratio",
    "direction_change_mean": "direction_change_count", "lr_hand_dist_mean": "left_right_hand_dist_mean",
    "hand_face_dist_mean": "hand_face_dist_mean", "hand_body_dist_mean": "hand_body_dist_mean", "hand_missing_mean": "hand_frame_missing_ratio",
}
COMPLEXITY = (
    "mean_total_motion", "mean_velocity", "motion_variance_mean", "acceleration_mean", "trajectory_length_mean", "sequence_length_variance",
)


def motion_job(centers: DataFrame, out: str, fps: Column | None = None) -> None:
    """Motion features per sequence, per label and per corpus from frame centers keyed by
    dataset, label and sample_id."""
    seq = Sequences(("dataset", "label", "sample_id"))
    normalised = S.normalised_frames(centers, seq)
    spark = centers.sparkSession
    write_stage(normalised, f"{out}/normalised_frames")
    frames = spark.read.parquet(f"{out}/normalised_frames")
    write_stage(S.sequence_features(frames, seq, fps=fps), f"{out}/motion_features_per_video")
    write_stage(S.hand_trajectories(frames, seq), f"{out}/trajectories")
    per_video = spark.read.parquet(f"{out}/motion_features_per_video")
    labels = FE.label_motion(per_video, ["dataset", "label"], LABEL_MEANS)
    write_stage(FE.complexity_score(cut_lineage(labels), COMPLEXITY), f"{out}/motion_features_by_label")
    write_stage(FE.sequence_length(per_video, ["dataset", "label"]), f"{out}/sequence_length_by_label")
    write_stage(FE.corpus_summary(per_video, ["num_frames", "hand_frame_missing_ratio", *FE.MOTION_FEATURES]), f"{out}/motion_summary")


def canonical(table: DataFrame, columns: Sequence[str], aliases: Mapping[str, str] | None = None) -> DataFrame:
    """Keys of a feature table in one form, rows without a key dropped, one row per video."""
    keyed = table.withColumns(
        {"dataset": dataset_key(F.col("dataset"), aliases), "gloss": text_key(F.col("gloss")), "video": video_key(F.col("video"))}
    ).filter("dataset <> '' AND gloss <> '' AND video <> ''")
    keys = ["dataset", "gloss", "video"]
    return FE.mean_by(select_numeric(keyed, keys, columns), keys, columns)


def feature_space_job(tables: Mapping[str, DataFrame], mapping: DataFrame, left: str, right: str, out: str) -> None:
    """Similarity of mapped labels, signer variation and separability from the stage
    tables with their whitelisted features; ``left`` and ``right`` name the two corpora."""
    keys = ["dataset", "gloss", "video"]
    parts = [
        canonical(df, FE.STAGE_FEATURES[name]).withColumnsRenamed({c: f"{name}__{c}" for c in FE.STAGE_FEATURES[name]})
        for name, df in tables.items()
    ]
    names = [f"{name}__{c}" for name in tables for c in FE.STAGE_FEATURES[name]]
    merged = cut_lineage(joins.merge_outer(parts, keys))
    vectors = scaling.feature_vector(merged, names).select(*keys, "features")
    vectors = vectors.withColumn("sample", F.concat_ws("/", *keys))

    labels = FE.mean_by(merged, ["dataset", "gloss"], names)
    counts = merged.groupBy("dataset", "gloss").agg(F.count(F.lit(1)).alias("samples"))
    label_vectors = scaling.feature_vector(labels, names).withColumn("coverage", scaling.coverage("features"))
    scaled = cut_lineage(scaling.scale(label_vectors, "features", fill="mean", into="vector").join(counts, ["dataset", "gloss"]))
    side = lambda d, key: scaled.filter(F.col("dataset") == d).withColumnRenamed("gloss", key)
    pairs = cut_lineage(similarity.cosine_pairs(mapping, side(left, "left"), side(right, "right"), "left", "right"))
    text = similarity.contribution_summary(pairs, ["left", "right"], names)
    coverage = lambda d, key: side(d, key).select(key, F.col("coverage").alias(f"coverage_{key}"))
    scored = pairs.drop("vector_left", "vector_right").join(text, ["left", "right"])
    write_stage(scored.join(coverage(left, "left"), "left").join(coverage(right, "right"), "right"), f"{out}/label_similarity")
    write_stage(similarity.score_statistics(pairs, "similarity_score"), f"{out}/similarity_statistics")

    everywhere = scaling.scale(vectors, "features")
    write_stage(variation.signer_variation(everywhere, "scaled", "sample"), f"{out}/signer_variation")
    inner = cut_lineage(joins.merge_inner(parts, keys))
    complete = scaling.feature_vector(inner, names).select(*keys, "features").withColumn("sample", F.concat_ws("/", *keys))
    write_stage(separability.metrics_row(complete, "features", "sample"), f"{out}/feature_space_metrics")
