"""A keyed table in buckets of files, whose batches rewrite only the buckets that they touch.

Layout under a folder of the shared store:

    data/{write}/bucket={k}/part-*.parquet   the rows of a bucket, as one write left them
    manifests/{version}.json                 which write holds each bucket, and the batches that are in

A row's bucket follows from its key. A batch reads and writes the buckets that its keys fall in, and then puts up the next
manifest by renaming a finished file, which fails if that version exists: readers see a version whole or not at all, and of
two writers one has to begin again. A batch that is in already changes nothing, so a stream may repeat one. Files of
older versions stay until `vacuum`, for readers that still use them.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from plexgraph.operators.loading import latest, upsert


class Conflict(RuntimeError):
    """Another writer has put up the version."""


class BucketTable:
    def __init__(self, spark: SparkSession, folder: str, schema: StructType, keys: list[str], buckets: int = 64):
        """buckets counts for a new table; a table that exists keeps its own."""
        self.spark, self.folder, self.schema, self.keys = spark, folder.rstrip("/"), schema, keys
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._files = self._path(self.folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self.buckets = self.manifest()["buckets"] if self.version() is not None else buckets

    def _names(self, folder: str) -> list[str]:
        where = self._path(f"{self.folder}/{folder}")
        return [s.getPath().getName() for s in self._files.listStatus(where)] if self._files.exists(where) else []

    def version(self) -> int | None:
        """The newest version, or None before the first batch."""
        return max((int(n.removesuffix(".json")) for n in self._names("manifests") if n.endswith(".json")), default=None)

    def manifest(self, version: int | None = None) -> dict:
        """{buckets, writes: {bucket: write}, batches: {stream: last batch}} of a version, the newest if none is named."""
        version = self.version() if version is None else version
        if version is None:
            return {"buckets": self.buckets if hasattr(self, "buckets") else 0, "writes": {}, "batches": {}}
        stream = self._files.open(self._path(f"{self.folder}/manifests/{version}.json"))
        try:
            return json.loads(bytes(stream.readAllBytes()))
        finally:
            stream.close()

    def _commit(self, version: int, manifest: dict) -> None:
        self._files.mkdirs(self._path(f"{self.folder}/manifests"))
        trial, last = (self._path(f"{self.folder}/{x}") for x in (f"manifests/.{uuid.uuid4().hex}", f"manifests/{version}.json"))
        stream = self._files.create(trial, False)
        stream.write(bytearray(json.dumps(manifest, sort_keys=True).encode()))
        stream.close()
        if self._files.exists(last) or not self._files.rename(trial, last):
            self._files.delete(trial, False)
            raise Conflict(f"version {version} of {self.folder} exists")

    def bucket(self) -> Column:
        """The bucket of a row; rows with a null in their key lie in bucket 0."""
        known = F.lit(True)
        for k in self.keys:
            known = known & F.col(k).isNotNull()
        return F.when(known, F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets))).otherwise(F.lit(0)).cast("int")

    def read(self, version: int | None = None, only: list[int] | None = None) -> DataFrame:
        """The rows of a version, or of some buckets of it."""
        writes = self.manifest(version)["writes"]
        paths = [f"{self.folder}/data/{write}/bucket={k}" for k, write in writes.items() if only is None or int(k) in only]
        return self.spark.read.schema(self.schema).parquet(*paths) if paths else self.spark.createDataFrame([], self.schema)

    def upsert(self, batch: DataFrame, conflict: str = "update", order: str | None = None, stream: str = "", number: int | None = None) -> list[int]:
        """Brings the rows of a batch in and returns the buckets that it rewrote.

        conflict is that of `loading.upsert`. With an order column, a row replaces one of its key only if it isn't older,
        in whichever batch it comes. A numbered batch of a stream that is in already is passed over.
        """
        version, manifest = self.version(), self.manifest()
        if number is not None and manifest["batches"].get(stream, -1) >= number:
            return []
        rows = batch.select(*[F.col(f.name).cast(f.dataType) for f in self.schema.fields])
        touched = sorted(r[0] for r in rows.select(self.bucket().alias("b")).distinct().collect())  # at most as many as there are buckets
        write = uuid.uuid4().hex
        if touched:
            old = self.read(version, touched)
            if order and conflict == "update":
                merged = latest(old.unionByName(rows), self.keys, F.col(order))
            else:
                merged = upsert(old, rows, self.keys, conflict, F.col(order) if order else None)
            merged.withColumn("bucket", self.bucket()).repartition("bucket").write.partitionBy("bucket").parquet(f"{self.folder}/data/{write}")
        held = {k: w for k, w in manifest["writes"].items() if int(k) not in touched} | {str(k): write for k in touched}
        batches = manifest["batches"] | ({stream: number} if number is not None else {})
        self._commit(0 if version is None else version + 1, {"buckets": self.buckets, "writes": held, "batches": batches})
        return touched

    def vacuum(self, keep: int = 2) -> int:
        """Removes the manifests before the last `keep` versions and the files that none of those names; returns how many writes went."""
        last = self.version()
        if last is None:
            return 0
        kept = range(max(last - keep + 1, 0), last + 1)
        used = {f"{w}/bucket={k}" for v in kept for k, w in self.manifest(v)["writes"].items()}
        for name in self._names("manifests"):
            if name.endswith(".json") and int(name.removesuffix(".json")) not in kept:
                self._files.delete(self._path(f"{self.folder}/manifests/{name}"), False)
        gone = 0
        for write in self._names("data"):
            left = [f"{write}/{b}" for b in self._names(f"data/{write}") if b.startswith("bucket=")]
            for bucket in set(left) - used:
                self._files.delete(self._path(f"{self.folder}/data/{bucket}"), True)
            if not set(left) & used:
                self._files.delete(self._path(f"{self.folder}/data/{write}"), True)
                gone += 1
        return gone

    def consume(self, source: DataFrame, checkpoint: str, conflict: str = "update", order: str | None = None, stream: str = "stream"):
        """Starts a query that brings all that a stream has into the table, a batch at a time, and ends."""

        def bring(batch: DataFrame, number: int) -> None:
            self.upsert(batch, conflict, order, stream, number)

        return source.writeStream.foreachBatch(bring).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
