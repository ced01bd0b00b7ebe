"""Tables that iterative algorithms keep between their rounds."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame

_own: dict[str, str] = {}


def shared_folder(spark) -> str:
    """The folder of spark.checkpoint.dir, which all executors share; a local one only where it is unset, as in tests."""
    folder = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    return (folder or _own.setdefault("folder", tempfile.mkdtemp(prefix="spark-rounds-"))).rstrip("/")


class Rounds:
    """Writes the tables of a round to the shared folder and reads them again, so that lost executors cost no earlier round
    and plans stay as short as in the first. A table kept under a name takes the place of the one before, whose files go.
    """

    def __init__(self, like: DataFrame):
        self.spark, self.kept, self.parts = like.sparkSession, {}, {}
        self.folder = f"{shared_folder(self.spark)}/rounds-{uuid.uuid4().hex}"

    def keep(self, name: str, df: DataFrame, by: str | None = None) -> DataFrame:
        """The rows of df from the shared folder; with by, in a folder for each of its values."""
        path = f"{self.folder}/{uuid.uuid4().hex}"
        self._write(df.write.partitionBy(by) if by else df.write, path)
        self._drop(self.kept.get(name))
        self.kept[name] = path
        return self.spark.read.schema(df.schema).parquet(path)

    def _write(self, writer, path: str) -> None:
        """Writes a table and lets go of the shuffle files behind it, which else stay until the driver's JVM collects garbage."""
        conf, key = self.spark.conf, "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
        before = conf.get(key, "false")
        conf.set(key, "true")
        try:
            writer.parquet(path)
        finally:
            conf.set(key, before)

    def append(self, name: str, df: DataFrame) -> DataFrame:
        """Adds rows to the table kept under a name, without writing what is there again; gives the added rows."""
        path = self.kept.setdefault(name, f"{self.folder}/{uuid.uuid4().hex}")
        part = f"{path}/part={len(self.parts.setdefault(name, []))}"
        self._write(df.write, part)
        self.parts[name].append(part)
        return self.spark.read.schema(df.schema).parquet(part)

    def appended(self, name: str, schema) -> DataFrame:
        """All rows that were appended under a name."""
        return self.spark.read.schema(schema).parquet(*self.parts[name])

    def rename(self, old: str, new: str) -> None:
        """The table kept as old takes the place of the one kept as new."""
        self._drop(self.kept.get(new))
        self.kept[new] = self.kept.pop(old)

    def release(self, prefix: str) -> None:
        """Lets go of the tables whose names begin so."""
        for name in [x for x in self.kept if x.startswith(prefix)]:
            self._drop(self.kept.pop(name))

    def _drop(self, path: str | None) -> None:
        if path:
            where = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
