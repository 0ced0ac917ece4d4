"""The numbers behind reports and charts. Nothing is drawn."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, functions as F

from seqatlas.distribution import attach_row, exact_quantiles
from seqatlas.functions.numbers import finite, safe_ratio
from seqatlas.operators.ranking import top_per_group

DATASET = ["dataset"]


def length_profile(df: DataFrame, frames: str = "num_frames", label: str = "label") -> DataFrame:
    base = df.groupBy(*DATASET).agg(
        F.count(F.lit(1)).alias("videos"),
        F.count_distinct(label).alias("labels"),
        F.avg(frames).alias("mean_frames"),
        F.max(frames).cast("double").alias("max_frames"),
    )
    return base.join(exact_quantiles(df, DATASET, frames, {"median_frames": 0.5, "p95_frames": 0.95}, few_groups=True), DATASET)


def metric_ratios(long: DataFrame, a: str, b: str) -> DataFrame:
    """Per metric: both means, difference and ratio of the second to the first (blank when
    the first is 0), and which corpus is higher."""
    pick = lambda d: F.max(F.when(F.col("dataset") == d, F.col("mean")))
    wide = long.groupBy("metric").agg(pick(a).alias("mean_a"), pick(b).alias("mean_b"))
    x, y = F.col("mean_a"), F.col("mean_b")
    higher = F.when(x > y, F.lit(a)).when(y > x, F.lit(b)).when(x == y, F.lit("equal"))
    return wide.withColumns({"difference": y - x, "ratio": safe_ratio(y, x), "higher": higher})


def label_sparsity(counts: DataFrame, limits: Sequence[int] = (2, 5, 10)) -> DataFrame:
    """Labels, videos and samples per label, and how many labels have few samples. Labels
    are first counted by size, so the median needs the sizes only."""
    sizes = counts.groupBy("dataset", F.col("sample_count").alias("_s")).agg(F.count(F.lit(1)).alias("_c"))
    videos = F.sum(F.col("_s") * F.col("_c"))
    below = [F.coalesce(F.sum(F.when(F.col("_s") < k, F.col("_c"))), F.lit(0)).alias(f"labels_lt{k}") for k in limits]
    return sizes.groupBy(*DATASET).agg(
        F.sum("_c").alias("labels"),
        videos.alias("videos"),
        F.percentile("_s", 0.5, F.col("_c")).alias("median_samples"),
        (videos / F.sum("_c")).alias("mean_samples"),
        F.min("_s").alias("min_samples"),
        F.max("_s").alias("max_samples"),
        *below,
    )


def worst_labels(df: DataFrame, lists: Mapping[str, tuple[str, int, bool]], label: str = "label") -> DataFrame:
    """Leading labels per corpus by several metrics; ``lists`` maps a name to (metric,
    count, descending). Metrics are ranked to nine digits, so that the order of summation
    doesn't decide between equal ones."""
    out = None
    for name, (metric, count, descending) in lists.items():
        rank_by = F.round(F.col(metric).cast("double"), 9)
        by = rank_by.desc_nulls_last() if descending else rank_by.asc_nulls_last()
        best = top_per_group(df, DATASET, [by, F.col(label)], count, rank="place")
        part = best.select(F.lit(name).alias("list"), "dataset", "place", label, F.col(metric).alias("value"))
        out = part if out is None else out.unionByName(part)
    return out


def intra_quantiles(df: DataFrame, value: str) -> DataFrame:
    base = df.groupBy(*DATASET).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.max(value).alias("max"))
    return base.join(exact_quantiles(df, DATASET, value, {"median": 0.5, "p75": 0.75, "p90": 0.9}, few_groups=True), DATASET)


def inter_quantiles(df: DataFrame, value: str, zero: float = 1e-9) -> DataFrame:
    base = df.groupBy(*DATASET).agg(
        F.count(value).alias("n"), F.min(value).alias("min"), F.count(F.when(F.col(value) <= zero, 1)).alias("zero_pairs")
    )
    return base.join(exact_quantiles(df, DATASET, value, {"p10": 0.1, "median": 0.5}, few_groups=True), DATASET)


def corpus_facts(per_dataset: DataFrame, best: Mapping[str, tuple[str, bool]], each: Sequence[str] = ()) -> DataFrame:
    """Facts of a narrative as (fact, dataset, value) rows: the corpus with the largest or
    smallest metric (``best`` maps a fact to metric and direction; ties by name), and the
    metrics of every corpus."""
    aggs, rows = [], []
    for i, (fact, (metric, largest)) in enumerate(best.items()):
        v = F.col(metric).cast("double")
        key = F.struct((-v if largest else v).alias("k"), F.col("dataset").alias("d"), v.alias("v"))
        aggs.append(F.min(key).alias(f"_f{i}"))
        rows.append(F.struct(F.lit(fact).alias("fact"), F.col(f"_f{i}.d").alias("dataset"), F.col(f"_f{i}.v").alias("value")))
    out = per_dataset.agg(*aggs).select(F.explode(F.array(*rows)).alias("_r")).select("_r.*")
    if each:
        long = per_dataset.select("dataset", *[F.col(m).cast("double").alias(m) for m in each]).unpivot(
            ["dataset"], list(each), "fact", "value"
        )
        out = out.unionByName(long.select("fact", "dataset", "value"))
    return out


def histogram(df: DataFrame, value: str, *, bins: int | None = None, cap: int = 30, groups: Sequence[str] = (), pooled: bool = True) -> DataFrame:
    """Counts of equal-width bins, the last one closed on the right.

    Without ``bins`` their number is min(cap, max(10, floor(sqrt n))), n being all rows
    (``pooled``) or the rows of the group. Empty bins give no row.
    """
    keys = list(groups)
    base = df.select(*groups, finite(F.col(value)).alias("_v")).filter("_v is not null")
    span = base.groupBy(*keys).agg(F.min("_v").alias("_lo"), F.max("_v").alias("_hi"), F.count(F.lit(1)).alias("_n"))
    if bins is not None:
        span = span.withColumn("_bins", F.lit(bins))
    else:
        if pooled and groups:
            span = attach_row(span.drop("_n"), base.agg(F.count(F.lit(1)).alias("_n")))
        span = span.withColumn("_bins", F.least(F.lit(cap), F.greatest(F.lit(10), F.floor(F.sqrt("_n")).cast("int"))))
    flat = F.col("_hi") == F.col("_lo")
    span = span.withColumn("_lo", F.when(flat, F.col("_lo") - 0.5).otherwise(F.col("_lo"))).withColumn(
        "_hi", F.when(flat, F.col("_hi") + 0.5).otherwise(F.col("_hi"))
    )
    width = (F.col("_hi") - F.col("_lo")) / F.col("_bins")
    nth = F.least(F.floor((F.col("_v") - F.col("_lo")) / width).cast("int"), F.col("_bins") - 1)
    spread = base.join(span, keys) if keys else attach_row(base, span)
    counted = spread.groupBy(*keys, "_lo", "_hi", "_bins", nth.alias("bin")).agg(F.count(F.lit(1)).alias("count"))
    return counted.select(
        *groups, "bin", (F.col("_lo") + F.col("bin") * width).alias("left_edge"), (F.col("_lo") + (F.col("bin") + 1) * width).alias("right_edge"), "count"
    )


def boxplot(df: DataFrame, value: str, groups: Sequence[str] = ("dataset",)) -> DataFrame:
    """Quartiles, whiskers at the last values within 1.5 interquartile ranges, and the
    number of values beyond them."""
    keys = list(groups)
    rows = df.select(*keys, finite(F.col(value)).alias("_v")).filter("_v is not null")
    q = exact_quantiles(rows, keys, "_v", {"q1": 0.25, "median": 0.5, "q3": 0.75}, few_groups=True)
    reach = 1.5 * (F.col("q3") - F.col("q1"))
    joined = rows.join(q, keys)
    low, high = F.col("_v") >= F.col("q1") - reach, F.col("_v") <= F.col("q3") + reach
    return joined.groupBy(*keys, "q1", "median", "q3").agg(
        F.min(F.when(low, F.col("_v"))).alias("whisker_low"),
        F.max(F.when(high, F.col("_v"))).alias("whisker_high"),
        F.count(F.when(~(low & high), 1)).alias("outliers"),
    )


def scatter_points(df: DataFrame, x: str, y: str) -> DataFrame:
    return df.select("dataset", finite(F.col(x)).alias("x"), finite(F.col(y)).alias("y")).filter("x is not null and y is not null")


def most_moving(features: DataFrame, rows: DataFrame, keys: Sequence[str], count: int = 6, metric: str = "total_motion") -> DataFrame:
    """Rows (frames or trajectories) of the samples with the most motion."""
    best = features.orderBy(F.round(F.col(metric).cast("double"), 9).desc_nulls_last(), *keys).limit(count).select(*keys)
    return rows.join(best, list(keys), "left_semi")


def axis_ticks(labels: DataFrame, label: str, shown: int = 40) -> DataFrame:
    """Every ceil(n / shown)-th label of a numbered label list."""
    step = F.greatest(F.lit(1), F.ceil(F.col("n_labels") / shown))
    return labels.filter((F.col("label_rank") - 1) % step == 0).select(label, "label_rank")


def first_rows(matrix: DataFrame, order: str, count: int) -> DataFrame:
    return matrix.orderBy(order).limit(count)
