"""Writers of stage tables, summaries and error rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F


def write_stage(df: DataFrame, path: str, partition_by: Sequence[str] = ("dataset",), csv: bool = False) -> None:
    """Parquet partitioned by corpus; optionally CSV with header as an export."""
    by = [c for c in partition_by if c in df.columns]
    writer = df.write.mode("overwrite").partitionBy(*by)
    if csv:
        writer.option("header", "true").csv(path)
    else:
        writer.parquet(path)


def write_bucketed(df: DataFrame, table: str, keys: Sequence[str], buckets: int) -> None:
    """A stage table bucketed and sorted by its keys, so that later joins on them need no shuffle."""
    df.write.mode("overwrite").bucketBy(buckets, *keys).sortBy(*keys).saveAsTable(table)


def summary_json(df: DataFrame, key: str) -> DataFrame:
    """One JSON text per row: {key: {metric: value, ...}}."""
    metrics = [c for c in df.columns if c != key]
    inner = F.struct(*[F.col(c) for c in metrics])
    return df.select(key, F.to_json(F.create_map(F.col(key).cast("string"), inner)).alias("json"))


def write_summary(df: DataFrame, key: str, path: str) -> None:
    summary_json(df, key).select("json").write.mode("overwrite").text(path)


def split_errors(df: DataFrame, error: str = "error") -> tuple[DataFrame, DataFrame]:
    """(good rows without the error column, failed rows)."""
    return df.filter(F.col(error).isNull()).drop(error), df.filter(F.col(error).isNotNull())
