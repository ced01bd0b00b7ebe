"""The incremental load as a stream: files that arrive are brought in once, and the stream's checkpoint is the watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def read_stream(spark: SparkSession, path: str, schema, files_a_batch: int = 100) -> DataFrame:
    """Parquet files of a folder as a stream; `BucketTable.consume` brings it into a keyed table."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_a_batch).parquet(path)
