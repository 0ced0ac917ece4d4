"""Class distribution and imbalance.

Whole-corpus curves are computed from the histogram of class sizes: how many classes
have 1, 2, 3, ... samples. With N samples there are at most sqrt(2 N) different sizes, so
that table is small however many classes there are.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from seqatlas.distribution import attach_row, exact_quantiles, number_rows, rank_rows, salted_join
from seqatlas.guards import must_hold

KEYS = ["dataset"]


def distribution(df: DataFrame, dataset: str = "dataset", class_name: str = "class_name") -> DataFrame:
    return df.groupBy(F.col(dataset).alias("dataset"), F.col(class_name).alias("class_name")).agg(
        F.count(F.lit(1)).alias("sample_count")
    )


def summary(df: DataFrame, *, readable: Column | None = None, signer: str | None = None) -> DataFrame:
    """Per corpus: videos, unreadable ones, classes, samples per class and known signers."""
    flag = F.lit(True) if readable is None else readable
    sized = df.withColumn("_bad", F.when(~flag, 1).otherwise(0))
    per_class = sized.groupBy("dataset", "class_name").agg(F.count(F.lit(1)).alias("_size"), F.sum("_bad").alias("_bad"))
    sizes = per_class.groupBy("dataset", "_size").agg(F.count(F.lit(1)).alias("_classes"), F.sum("_bad").alias("_bad"))
    out = sizes.groupBy("dataset").agg(
        F.sum("_classes").alias("num_classes"),
        F.sum(F.col("_size") * F.col("_classes")).alias("num_videos"),
        F.sum("_bad").alias("num_unreadable"),
        (F.sum(F.col("_size") * F.col("_classes")) / F.sum("_classes")).alias("mean_samples_per_class"),
        F.min("_size").alias("min_samples_per_class"),
        F.max("_size").alias("max_samples_per_class"),
        F.percentile("_size", 0.5, F.col("_classes")).alias("median_samples_per_class"),
    )
    if signer is not None:
        signers = df.groupBy("dataset").agg(F.count_distinct(signer).alias("num_signers"))
        out = out.join(signers, KEYS)
    return out


def attribute_statistics(df: DataFrame, attributes: Sequence[str], readable: Column | None = None) -> DataFrame:
    """Per corpus and attribute: n, mean, sample deviation (0 for one row), min, max, median."""
    rows = (df if readable is None else df.filter(readable)).select(
        "dataset", *[F.col(a).cast("double").alias(a) for a in attributes]
    )
    long = rows.unpivot(["dataset"], list(attributes), "attribute", "value").filter("value is not null")
    keys = ["dataset", "attribute"]
    base = long.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"),
        F.avg("value").alias("mean"),
        F.coalesce(F.stddev_samp("value"), F.lit(0.0)).alias("std"),
        F.min("value").alias("min"),
        F.max("value").alias("max"),
    )
    return base.join(exact_quantiles(long, keys, "value", {"median": 0.5}, few_groups=True), keys)


def shares(df: DataFrame, categories: Sequence[str], groups: Sequence[str] = ("dataset",), percent: bool = True) -> DataFrame:
    """Count per group and category, total of the group, and the share of it.

    Totals come from the counted categories, not from a window over them.
    """
    counted = df.groupBy(*groups, *categories).agg(F.count(F.lit(1)).alias("count"))
    totals = counted.groupBy(*groups).agg(F.sum("count").alias("dataset_total"))
    share = F.col("count") / F.col("dataset_total")
    name = ("percentage", share * 100) if percent else ("proportion", share)
    joined = counted.join(totals, list(groups)) if groups else attach_row(counted, totals)
    return joined.withColumn(*name)


def top_frequencies(df: DataFrame, category: Column, count: int | None = None, name: str = "category") -> DataFrame:
    """Most frequent values with their share of all rows, ties by value."""
    freq = shares(df.select(category.alias(name)), [name], groups=(), percent=False)
    rows = freq.select(name, "count", "proportion")
    return rows if count is None else rows.orderBy(F.col("count").desc(), F.col(name)).limit(count)


def signer_distribution(df: DataFrame, signer: str) -> DataFrame:
    return df.filter(F.col(signer).isNotNull()).groupBy("dataset", signer).agg(F.count(F.lit(1)).alias("sample_count"))


def signer_diversity(df: DataFrame, signer: str) -> DataFrame:
    return signer_distribution(df, signer).groupBy("dataset").agg(
        F.count(F.lit(1)).alias("num_signers"),
        F.avg("sample_count").alias("mean_samples_per_signer"),
        F.min("sample_count").alias("min_samples_per_signer"),
        F.max("sample_count").alias("max_samples_per_signer"),
    )


def comparison_table(per_dataset: DataFrame, metrics: Sequence[str], datasets: Sequence[str]) -> DataFrame:
    """Metrics by corpus side by side, each also divided by its maximum."""
    long = per_dataset.select("dataset", *[F.col(m).cast("double").alias(m) for m in metrics]).unpivot(
        ["dataset"], list(metrics), "metric", "value"
    )
    value = lambda d: F.max(F.when(F.col("dataset") == d, F.col("value")))
    wide = long.groupBy("metric").agg(*[value(d).alias(d) for d in datasets], F.max("value").alias("_top"))
    return wide.select("metric", *datasets, *[(F.col(d) / F.nullif("_top", F.lit(0.0))).alias(f"{d}_relative") for d in datasets])


# --- imbalance ------------------------------------------------------------------


def size_histogram(counts: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Classes per class size, with the classes and samples of smaller sizes."""
    sizes = counts.groupBy(*keys, F.col("sample_count").alias("size")).agg(F.count(F.lit(1)).alias("classes"))
    up = Window.partitionBy(*keys).orderBy("size").rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy(*keys)
    samples = F.col("size") * F.col("classes")
    return sizes.select(
        *keys,
        "size",
        "classes",
        F.coalesce(F.sum("classes").over(up), F.lit(0)).alias("classes_below"),
        F.coalesce(F.sum(samples).over(up), F.lit(0)).alias("samples_below"),
        F.sum("classes").over(every).alias("num_classes"),
        F.sum(samples).over(every).alias("num_samples"),
    )


def _gini() -> Column:
    """Aggregate over a size histogram. Classes of equal size take consecutive ranks, so a
    whole run of m of them adds size * m * (2 * below + m - n)."""
    term = F.col("size") * F.col("classes") * (2 * F.col("classes_below") + F.col("classes") - F.col("num_classes"))
    return F.sum(term.cast("double")) / (F.max("num_classes") * F.max("num_samples"))


def _tail(fraction: float) -> Column:
    return F.greatest(F.lit(1), F.ceil(F.col("num_classes") * F.lit(fraction)))


def _tail_share(fraction: float, largest: bool) -> Column:
    above = F.col("num_classes") - F.col("classes_below") - F.col("classes")
    skipped = above if largest else F.col("classes_below")
    taken = F.greatest(F.lit(0), F.least(F.col("classes"), _tail(fraction) - skipped))
    return F.sum(taken * F.col("size")) / F.max("num_samples")


def _checked_histogram(counts: DataFrame, keys: Sequence[str]) -> DataFrame:
    ok = (F.col("size") >= 0) & (F.col("num_samples") > 0)
    return size_histogram(counts, keys).filter(must_hold(ok, "class sizes must not be negative or all zero"))


def gini(counts: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Gini coefficient of the class sizes."""
    return _checked_histogram(counts, keys).groupBy(*keys).agg(_gini().alias("gini"))


def tail_shares(counts: DataFrame, fraction: float = 0.10, keys: Sequence[str] = KEYS) -> DataFrame:
    """Share of samples in the largest and the smallest ``ceil(fraction * n)`` classes."""
    if not 0.0 < fraction <= 1.0:
        raise ValueError("the tail fraction must be in (0, 1]")
    return _checked_histogram(counts, keys).groupBy(*keys).agg(
        F.max(_tail(fraction)).cast("long").alias("tail_size"),
        _tail_share(fraction, True).alias("top_share"),
        _tail_share(fraction, False).alias("bottom_share"),
    )


def imbalance(counts: DataFrame, fraction: float = 0.10) -> DataFrame:
    """Per corpus: extremes, mean, median, sample deviation, max/min ratio, variation,
    Gini and tail shares of the class sizes, all from one size histogram."""
    size, classes = F.col("size"), F.col("classes")
    n, total = F.max("num_classes"), F.max("num_samples")
    mean = F.col("num_samples") / F.col("num_classes")
    variance = F.sum(classes * (size - mean) * (size - mean)) / (n - 1)
    base = _checked_histogram(counts, KEYS).groupBy("dataset").agg(
        n.alias("num_classes"),
        F.max("size").alias("max_samples"),
        F.min("size").alias("min_samples"),
        (total / n).alias("mean_samples"),
        F.percentile("size", 0.5, F.col("classes")).alias("median_samples"),
        F.when(n > 1, F.sqrt(F.greatest(F.lit(0.0), variance))).otherwise(F.lit(0.0)).alias("std_samples"),
        _gini().alias("gini"),
        _tail_share(fraction, True).alias("top_share"),
        _tail_share(fraction, False).alias("bottom_share"),
    )
    ratio = F.when(F.col("min_samples") == 0, F.lit(float("inf"))).otherwise(F.col("max_samples") / F.col("min_samples"))
    return base.withColumn("imbalance_ratio", ratio).withColumn(
        "coefficient_of_variation", F.col("std_samples") / F.col("mean_samples")
    )


def lorenz(counts: DataFrame, step_rows: int = 10_000) -> DataFrame:
    """Lorenz curve points (0,0) to (1,1): cumulative share of classes and of samples.

    Points come from the size histogram; long runs of equal classes are first cut into
    pieces of ``step_rows``, so no single row unfolds into many.
    """
    h = size_histogram(counts)
    pieces = h.withColumn("_from", F.explode(F.sequence(F.lit(1).cast("long"), F.col("classes"), F.lit(step_rows).cast("long"))))
    to = F.least(F.col("classes"), F.col("_from") + step_rows - 1)
    points = pieces.repartition("dataset", "size", "_from").withColumn("_i", F.explode(F.sequence("_from", to)))
    curve = points.select(
        "dataset",
        (F.col("classes_below") + F.col("_i")).alias("position"),
        ((F.col("classes_below") + F.col("_i")) / F.col("num_classes")).alias("class_fraction"),
        ((F.col("samples_below") + F.col("_i") * F.col("size")) / F.col("num_samples")).alias("sample_fraction"),
    )
    zero = F.lit(0.0)
    origin = h.select("dataset").distinct().select(
        "dataset", F.lit(0).cast("long").alias("position"), zero.alias("class_fraction"), zero.alias("sample_fraction")
    )
    return curve.unionByName(origin)


def cumulative(counts: DataFrame, *, bucket: Column | None = None) -> DataFrame:
    """Classes by falling size (ties by name) with rank and cumulative share of samples.

    The rank is the number of larger classes plus the place among equal ones. Equal ones are numbered by
    ranges of their names, or inside ``bucket`` (not decreasing with the name) where names are dense numbers.
    """
    equal = ["dataset", "sample_count"]
    if bucket is None:
        placed = rank_rows(counts, equal, ["class_name"], into="_place")
    else:
        placed = number_rows(counts, equal, ["class_name"], bucket=bucket, into="_place")
    h = size_histogram(counts).withColumnRenamed("size", "sample_count")
    above = F.col("num_classes") - F.col("classes_below") - F.col("classes")
    samples_above = F.col("num_samples") - F.col("samples_below") - F.col("classes") * F.col("sample_count")
    keys = ["dataset", "sample_count"]
    joined = salted_join(placed, h, keys, salt_on=["class_name"])
    nth = F.col("_place") + 1
    return joined.select(
        "dataset",
        "class_name",
        "sample_count",
        (above + nth).alias("rank"),
        ((samples_above + nth * F.col("sample_count")) / F.col("num_samples")).alias("cumulative_fraction"),
    )
