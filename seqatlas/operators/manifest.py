"""Work lists: what to copy, what is still to do, how labels are dealt to workers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from seqatlas.distribution import attach_row, number_rows, rank_rows
from seqatlas.functions.text import safe_folder


def group_files(df: DataFrame, label: str, file: str, *, bucket: Column) -> DataFrame:
    """Files of each label in order, as rows (label, position, file): a label may have
    any number of files, so they are numbered, not gathered into one list."""
    unique = df.select(label, file).distinct()
    return number_rows(unique, [label], [file], bucket=bucket, into="position")


def copy_plan(requests: DataFrame, sources: DataFrame, targets: DataFrame, file: str, label: str = "label") -> DataFrame:
    """COPY, SKIP (already at the target) or MISSING (no source) for each requested file."""
    have = sources.select(file).distinct().withColumn("_have", F.lit(True))
    done = targets.select(file).distinct().withColumn("_done", F.lit(True))
    status = (
        F.when(F.col("_have").isNull(), "MISSING").when(F.col("_done").isNotNull(), "SKIP").otherwise("COPY")
    )
    return (
        requests.join(have, file, "left")
        .join(done, file, "left")
        .select(*requests.columns, safe_folder(F.col(label)).alias("folder"), status.alias("status"))
    )


def plan_totals(plan: DataFrame, label: str = "label") -> DataFrame:
    """Per label: files to copy, to skip and missing."""
    count = lambda s: F.count(F.when(F.col("status") == s, 1)).alias(s.lower())
    return plan.groupBy(label).agg(F.count(F.lit(1)).alias("files"), count("COPY"), count("SKIP"), count("MISSING"))


def pending(inputs: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Inputs without a finished result."""
    return inputs.join(done.select(key).distinct(), key, "left_anti")


def number_labels(df: DataFrame, label: str) -> DataFrame:
    """Distinct labels with their 1-based rank in sort order and their number."""
    labels = df.select(label).distinct()
    ranked = rank_rows(labels, [], [label], into="_rank")
    total = ranked.agg(F.count(F.lit(1)).alias("n_labels"))
    return attach_row(ranked, total).select(label, (F.col("_rank") + 1).alias("label_rank"), "n_labels")


def shard_labels(df: DataFrame, label: str, *, workers: int | None = None, block: int | None = None) -> DataFrame:
    """Sorted labels dealt in equal runs to ``workers``, or in runs of ``block`` labels."""
    if (workers is None) == (block is None):
        raise ValueError("give either workers or block")
    size = F.ceil(F.col("n_labels") / workers) if workers is not None else F.lit(block)
    shard = F.floor((F.col("label_rank") - 1) / size) + 1
    return number_labels(df, label).withColumn("shard", shard.cast("long"))


def take_shard(df: DataFrame, shards: DataFrame, label: str, shard: int) -> DataFrame:
    """Rows whose label belongs to one shard."""
    return df.join(shards.filter(F.col("shard") == shard).select(label), label, "left_semi")
