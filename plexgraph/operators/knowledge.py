"""Vectors and knowledge entries: upserts, filtered searches, retention, and the usage tables kept beside them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plexgraph.functions.scalar import cosine
from plexgraph.operators.loading import upsert


def upsert_vectors(old: DataFrame, new: DataFrame, key: str, vector: str, dimensions: int) -> DataFrame:
    """old with new vectors by key; a vector of another length, or with none, fails the job."""
    fits = F.assert_true(F.coalesce(F.size(vector) == dimensions, F.lit(False)), F.lit(f"a vector has not {dimensions} dimensions"))
    return upsert(old, new.where(fits.isNull()), [key])


def top_similar(rows: DataFrame, vector: str, asked: DataFrame, k: int, key: str, where: dict | None = None, least: float | None = None) -> DataFrame:
    """(key, score) of the k rows most like one vector (asked: one row, column q), among those whose columns equal `where`."""
    for name, value in (where or {}).items():
        rows = rows.where(F.col(name) == F.lit(value))
    scored = rows.join(F.broadcast(asked.select("q").limit(1)), how="cross").select(F.col(key), cosine(F.col(vector), F.col("q")).alias("score")).where("score is not null")
    return (scored if least is None else scored.where(F.col("score") >= least)).orderBy(F.desc("score"), key).limit(k)


def retained(rows: DataFrame, last_used: str, after) -> DataFrame:
    """Rows used since a time; those never used go."""
    return rows.where(F.col(last_used) >= F.lit(after))


def deleted(rows: DataFrame, where: dict) -> DataFrame:
    """Rows without those whose columns equal all of `where`, which may not be empty."""
    if not where:
        raise ValueError("a deletion needs a condition")
    gone = reduce(lambda a, b: a & b, [F.col(name).eqNullSafe(F.lit(value)) for name, value in where.items()])
    return rows.where(~gone)


def retrieved_labels(hits: DataFrame, links: DataFrame, k: int = 12, least: float = 0.25, most: int = 40) -> list[str]:
    """Labels of the k best hits (label, score) from a score on, and their neighbours over links (a, b) breadth first, most in all."""
    found = [r.label for r in hits.where(F.col("score") >= least).orderBy(F.desc("score"), "label").limit(k).collect()]
    frontier = found[:]
    while frontier and len(found) < most:  # labels of a schema: few
        rows = links.where(F.col("a").isin(frontier)).select(F.col("b").alias("label")).union(links.where(F.col("b").isin(frontier)).select("a")).distinct().orderBy("label").limit(most + len(found)).collect()
        frontier = [r.label for r in rows if r.label not in found]
        found += frontier
    return found[:most]


def lookup(entries: DataFrame, name: str, version: int, labels: list[str], k: int) -> DataFrame:
    """The k approved entries of an ontology and version that share a label, the most certain first."""
    rows = entries.where((F.col("ontology") == name) & (F.col("status") == "approved") & (F.col("version_min") <= version))
    rows = rows.where(F.col("version_max").isNull() | (F.col("version_max") >= version))
    return rows.where(F.arrays_overlap("labels", F.array(*[F.lit(x) for x in labels]).cast("array<string>"))).orderBy(F.desc("confidence"), "id").limit(k)


def stale(entries: DataFrame, name: str, labels: list[str]) -> DataFrame:
    """Entries after a change of labels: approved ones that share a label become stale, with half the confidence."""
    hit = (F.col("ontology") == name) & (F.col("status") == "approved") & F.arrays_overlap("labels", F.array(*[F.lit(x) for x in labels]).cast("array<string>"))
    hit = F.coalesce(hit, F.lit(False))
    return entries.withColumns({"confidence": F.when(hit, F.col("confidence") * 0.5).otherwise(F.col("confidence")), "status": F.when(hit, "stale").otherwise(F.col("status"))})


def cleaned(entries: DataFrame, now: Column, days: int, least: float = 0.1) -> DataFrame:
    """Entries with those of little confidence deprecated as of now, without deprecated ones that are older than some days."""
    low = (F.col("confidence") < least) & (F.col("status") != "deprecated")
    rows = entries.withColumns({"updated_at": F.when(low, now).otherwise(F.col("updated_at")), "status": F.when(low, "deprecated").otherwise(F.col("status"))})
    return rows.where((F.col("status") != "deprecated") | (F.col("updated_at") >= now - F.make_interval(days=F.lit(days))))


def counts_by(entries: DataFrame, *columns: str) -> DataFrame:
    return entries.groupBy(*columns).agg(F.count(F.lit(1)).alias("n"))


def lineage_summary(lineage: DataFrame) -> DataFrame:
    """(graph_label, element, sources, records, last_loaded) of completed loads."""
    done = lineage.where("status = 'completed'").groupBy("graph_label", "element")
    return done.agg(F.count(F.lit(1)).alias("sources"), F.coalesce(F.sum("record_count"), F.lit(0)).alias("records"), F.max("completed_at").alias("last_loaded"))
