"""Process only what has not been processed: a file stream with a checkpoint.

The batch form is ``operators.manifest.pending``; both give the same result.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType


def process_new_files(
    spark: SparkSession,
    source: str,
    schema: StructType,
    work: Callable[[DataFrame], DataFrame],
    target: str,
    checkpoint: str,
    *,
    source_format: str = "parquet",
    max_files: int | None = None,
) -> None:
    """Run ``work`` over files not seen by earlier runs and append the results.

    Every call handles what is there and returns. The checkpoint remembers finished files,
    also when a run dies in between; ``max_files`` bounds one micro-batch.
    """
    reader = spark.readStream.format(source_format).schema(schema).option("recursiveFileLookup", "true")
    if max_files is not None:
        reader = reader.option("maxFilesPerTrigger", max_files)
    query = (
        work(reader.load(source))
        .writeStream.format("parquet")
        .outputMode("append")
        .option("checkpointLocation", checkpoint)
        .option("path", target)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
