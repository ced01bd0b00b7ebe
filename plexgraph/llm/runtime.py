"""Where jobs keep intermediate tables, and how they let go of them."""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of a batch of rows that goes to Python, and rows of a batch of Parquet.
BATCH_BYTES, BATCH_ROWS = 4 << 20, 512

_own: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir, which all executors share; a local one only where it is unset."""
    folder = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not folder:
        folder = _own.setdefault("folder", tempfile.mkdtemp(prefix="spark-plexgraph-"))
    return folder.rstrip("/")


def stored(df: DataFrame, name: str) -> DataFrame:
    """The rows of df written as a Parquet table in the shared folder and read again: later stages don't repeat its work."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/plexgraph/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(*tables: DataFrame) -> None:
    """Deletes stored tables that nothing reads any more, and lets Spark remove the shuffle files of finished jobs."""
    for df in tables:
        spark = df.sparkSession
        jvm = spark.sparkContext._jvm
        for path in {name.rsplit("/", 1)[0] for name in df.inputFiles()}:
            where = jvm.org.apache.hadoop.fs.Path(path)
            if "/plexgraph/" in path:
                where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
    sweep()


def sweep() -> None:
    """Shuffle files stay until the driver's JVM collects what refers to them."""
    gc.collect()
    spark = SparkSession.getActiveSession()
    if spark is not None:
        spark.sparkContext._jvm.System.gc()


def bounded_batches(spark: SparkSession) -> None:
    """From now on the session's batches are bounded by bytes: texts are long, and with Spark's bounds on rows a task's whole texts are one batch. Smaller bounds stay."""
    for name, most in (("execution.arrow.maxBytesPerBatch", BATCH_BYTES), ("parquet.columnarReaderBatchSize", BATCH_ROWS)):
        spark.conf.set(f"spark.sql.{name}", str(min(most, _number(spark.conf.get(f"spark.sql.{name}")))))


def _number(setting: str) -> int:
    """A setting in bytes or rows, with or without a unit."""
    digits = setting.lower().rstrip("b").rstrip("kmg")
    return int(digits) << {"k": 10, "m": 20, "g": 30}.get(setting.lower().rstrip("b")[-1:], 0)


def text_keys(text) -> list:
    """Two columns that together name a text: equal for equal texts."""
    text = F.coalesce(text, F.lit(""))
    return [F.xxhash64(text).alias("k1"), F.crc32(text.cast("binary")).alias("k2")]


def replaced(docs: DataFrame, computed: dict) -> DataFrame:
    """docs with computed columns, which take the place of columns of the same name in any spelling of case."""
    low = {name.lower() for name in computed}
    kept = [F.col(f"`{c}`") for c in docs.columns if c.lower() not in low]
    return docs.select(*kept, *[col.alias(name) for name, col in computed.items()])
