"""A stored index of the trigrams of nodes' properties, for searches that don't read every node.

`build` writes two tables to a folder of the shared store: postings (gram, label, id), in
directories by a hash of the gram and sorted by it within a file, so that a search
reads the rows of its own grams alone; and texts (label, id, texts), in directories by a
hash of the node. A node that contains a text has all its trigrams: the postings of the
text's rarest grams are intersected, and only the nodes left are read and looked at.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plexgraph.operators.graph import PropertyGraph

#: Of a longer text this many grams, the rarest ones, are looked up; the look at the texts does the rest.
LOOKED_UP = 6


def _texts(graph: PropertyGraph, labels: tuple[str, ...]) -> DataFrame:
    """(label, id, texts) of all nodes: their properties as text, nulls left out."""
    parts = []
    for label in labels or tuple(graph.nodes_by_label):
        rows = graph.nodes(label)
        texts = F.array_compact(F.array(*[F.col(f"`{c}`").cast("string") for c in rows.columns]))
        parts.append(rows.select(F.lit(label).alias("label"), "id", texts.alias("texts")))
    return reduce(DataFrame.unionByName, parts)


def _grams(text: Column) -> Column:
    """All runs of three characters of a text."""
    return F.when(F.length(text) >= 3, F.transform(F.sequence(F.lit(1), F.length(text) - 2), lambda k: F.substring(text, k, 3))).otherwise(F.array().cast("array<string>"))


class TrigramIndex:
    def __init__(self, spark: SparkSession, folder: str, buckets: int = 64):
        self.spark, self.folder, self.buckets = spark, folder.rstrip("/"), buckets

    def _bucket(self, *columns) -> Column:
        return F.pmod(F.xxhash64(*columns), F.lit(self.buckets)).cast("int").alias("bucket")

    def build(self, graph: PropertyGraph, labels: tuple[str, ...] = ()) -> TrigramIndex:
        """Writes the index of the nodes of some labels, or of all. A repeated gram of a node is one posting."""
        texts = _texts(graph, labels)
        texts.select("label", "id", "texts", self._bucket("label", "id")).repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{self.folder}/texts")
        grams = texts.select("label", "id", F.explode(F.array_distinct(F.flatten(F.transform("texts", _grams)))).alias("gram"))
        # a frequent gram's postings are dealt over files by the node too, so none is one task's
        dealt = grams.select("gram", "label", "id", self._bucket("gram")).repartition("bucket", F.pmod(F.xxhash64("id"), F.lit(8)))
        dealt.sortWithinPartitions("bucket", "gram").write.mode("overwrite").partitionBy("bucket").parquet(f"{self.folder}/postings")
        return self

    def postings(self, grams: list[str]) -> DataFrame:
        """(gram, label, id) of some grams: a read of their directories, with the grams pushed down to the files."""
        numbers = self.spark.createDataFrame([(g,) for g in grams], "gram string").select(self._bucket("gram")).distinct().collect()
        rows = self.spark.read.schema("gram string, label string, id long, bucket int").parquet(f"{self.folder}/postings")
        return rows.where(F.col("bucket").isin([r[0] for r in numbers]) & F.col("gram").isin(grams)).select("gram", "label", "id")

    def candidates(self, text: str) -> DataFrame:
        """(label, id) of the nodes that have the text's rarest grams; a gram that no node has leaves none."""
        grams = sorted({text[k : k + 3] for k in range(len(text) - 2)})
        if len(grams) > LOOKED_UP:
            counted = self.postings(grams).groupBy("gram").agg(F.count(F.lit(1)).alias("n")).collect()  # a row a gram of the text
            n = {r["gram"]: r["n"] for r in counted}
            grams = sorted(grams, key=lambda g: (n.get(g, 0), g))[:LOOKED_UP]
        return self.postings(grams).groupBy("label", "id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") == len(grams)).select("label", "id")

    def search(self, text: str, labels: tuple[str, ...] = (), limit: int = 100) -> DataFrame:
        """(label, id) of the first nodes with the text in any property, as `PropertyGraph.search` gives them.

        A text of fewer than three characters, and `*` for all nodes, have no gram: they are searched by reading the texts
        of all nodes of the index.
        """
        rows = self.spark.read.schema("label string, id long, texts array<string>, bucket int").parquet(f"{self.folder}/texts")
        if labels:
            rows = rows.where(F.col("label").isin(list(labels)))
        if text == "*":
            return rows.select("label", "id").orderBy("label", "id").limit(limit)
        hit = F.exists("texts", lambda x: x.contains(F.lit(text)))
        if len(text) >= 3:
            rows = rows.join(self.candidates(text).withColumn("bucket", self._bucket("label", "id")), ["bucket", "label", "id"], "left_semi")
        return rows.where(hit).select("label", "id").orderBy("label", "id").limit(limit)
