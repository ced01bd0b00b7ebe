"""Vectors stored by nearest centroid, and an exact search of the most similar that reads as few of the parts as it can.

A part has a centroid and a radius, the largest angle between the centroid and a vector of
the part. By the triangle inequality of angles no vector of a part is more like the one
asked for than cos(max(angle to the centroid - radius, 0)). Parts are read in the order of
that bound, until the k best found are better than any bound that is left.
"""

from __future__ import annotations

import math
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plexgraph.functions.scalar import cosine

#: Bounds are loosened by so much for rounding.
SLACK = 1e-7
#: Vectors that centroids are chosen among, and the most centroids.
SAMPLE, MOST_PARTS = 20_000, 1024
#: Vectors without length are a part of their own.
NONE = -1


def _unit(matrix: np.ndarray) -> np.ndarray:
    return matrix / np.maximum(np.linalg.norm(matrix, axis=1, keepdims=True), 1e-300)


def _centroids(sample: np.ndarray, parts: int, rounds: int = 8) -> np.ndarray:
    """Spherical k-means over a sample, from vectors spread through it."""
    unit = _unit(sample)
    centres = unit[np.linspace(0, len(unit) - 1, min(parts, len(unit))).astype(int)]
    for _ in range(rounds):
        near = np.argmax(unit @ centres.T, axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, near, unit)
        centres = np.where(np.linalg.norm(sums, axis=1, keepdims=True) > 0, _unit(sums), centres)
    return centres


class VectorIndex:
    def __init__(self, spark: SparkSession, folder: str, key: str, vector: str):
        self.spark, self.folder, self.key, self.vector = spark, folder.rstrip("/"), key, vector

    def build(self, rows: DataFrame, parts: int | None = None) -> VectorIndex:
        """Writes all rows that have a vector; all vectors need the same length. Centroids come from a sample of SAMPLE rows at most."""
        rows = rows.where(F.col(self.vector).isNotNull())
        n = rows.count()
        parts = parts or min(MOST_PARTS, max(1, math.isqrt(n)))
        share = min(1.0, SAMPLE / max(n, 1))
        chosen = rows.where(F.pmod(F.xxhash64(self.key), F.lit(1 << 30)) < int(share * (1 << 30))).orderBy(F.xxhash64(self.key), self.key).limit(SAMPLE)
        sample = chosen.select(F.col(self.vector).cast("array<double>").alias("v")).toArrow().column("v").to_pylist()
        long = np.array([v for v in sample if any(v)])
        centres = _centroids(long, parts) if len(long) else np.zeros((1, 1))
        shared = self.spark.sparkContext.broadcast(centres)  # MOST_PARTS vectors at most

        def near(vectors: pa.Array) -> pa.Array:
            matrix = np.array(vectors.to_pylist(), float)
            length = np.linalg.norm(matrix, axis=1)
            cosines = np.clip(_unit(matrix) @ shared.value.T, -1, 1) if len(matrix) and matrix.shape[1] == shared.value.shape[1] else np.zeros((len(matrix), 1))
            part = np.argmax(cosines, axis=1)
            angle = np.arccos(cosines[np.arange(len(part)), part])
            return pa.StructArray.from_arrays([pa.array(np.where(length > 0, part, NONE).astype(np.int32)), pa.array(angle)], ["part", "angle"])

        found = rows.withColumn("__near", F.arrow_udf(near, "part int, angle double")(F.col(self.vector).cast("array<double>")))
        self.data = f"{self.folder}/{uuid.uuid4().hex}"
        found = found.select(*rows.columns, F.col("__near.angle").alias("__angle"), F.col("__near.part").alias("__part"))
        self.schema = found.schema
        # a large part is several files, so that no task writes it alone
        found.repartition("__part", F.pmod(F.xxhash64(self.key), F.lit(4))).write.partitionBy("__part").parquet(self.data)
        stored = self.spark.read.schema(self.schema).parquet(self.data)
        sizes = stored.groupBy("__part").agg(F.max("__angle").alias("radius"), F.count(F.lit(1)).alias("n")).collect()  # a row a part
        self.parts = {r["__part"]: (centres[r["__part"]] if r["__part"] != NONE else None, r["radius"], r["n"]) for r in sizes}
        return self

    def bounds(self, asked: list[float]) -> list[tuple[float, int]]:
        """(no vector of the part is more alike, part), the highest first."""
        q = np.array(asked, float)
        out = []
        for part, (centre, radius, _) in self.parts.items():
            if centre is None or not np.linalg.norm(q):
                out.append((-2.0 if centre is None else 1.0, part))
                continue
            angle = math.acos(max(-1.0, min(1.0, float(centre @ (q / np.linalg.norm(q))))))
            out.append((math.cos(max(angle - radius, 0.0)) + SLACK, part))
        return sorted(out, key=lambda x: (-x[0], x[1]))

    def search(self, asked: list[float], k: int, where=None, at_once: int = 1) -> tuple[DataFrame, int]:
        """((key, score) of the k rows most like a vector, those of equal scores by key; and how many rows were read).

        where is a condition on the rows. Each round reads twice as many parts as the one before, from at_once on.
        """
        left, best, read = self.bounds(asked), None, 0
        q = F.array(*[F.lit(float(x)) for x in asked])
        while left:
            now, left = left[:at_once], left[at_once:]
            at_once *= 2
            read += sum(self.parts[p][2] for _, p in now)
            rows = self.spark.read.schema(self.schema).parquet(self.data).where(F.col("__part").isin([p for _, p in now]))
            rows = rows if where is None else rows.where(where)
            scored = rows.select(F.col(self.key), cosine(F.col(self.vector), q).alias("score")).where("score is not null")
            found = scored.orderBy(F.desc("score"), self.key).limit(k).collect()  # k rows
            best = sorted([*(best or []), *map(tuple, found)], key=lambda r: (-r[1], r[0]))[:k]
            if len(best) == k and (not left or left[0][0] < best[-1][1]):
                break
        kind = dict((f.name, f.dataType) for f in self.schema.fields)[self.key]
        return self.spark.createDataFrame(best or [], f"{self.key} {kind.simpleString()}, score double"), read
