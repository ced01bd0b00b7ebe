"""Work on many tables at once, within a time for each: failures and late ones are recorded, and the others go on."""

from __future__ import annotations

import threading
import time
import uuid
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from plexgraph.operators.governance import profile

#: So many tables at once, and fewer from so many tables on (fixed values).
AT_ONCE, AT_ONCE_OF_MANY, MANY = 8, 4, 100
#: Seconds for a table (fixed value).
TIMEOUT = 10.0


@dataclass
class Outcome:
    """What became of one piece of work: rows, or the reason why there are none."""

    name: str
    status: str  # done, failed, late
    rows: list
    schema: StructType | None
    seconds: float
    error: str | None = None


def each_within(spark: SparkSession, work: dict[str, Callable[[], DataFrame]], timeout: float = TIMEOUT, at_once: int | None = None) -> list[Outcome]:
    """The small results of some jobs, in the order of their names as given.

    A job runs under a tag of its own. When its time is over, Spark cancels the jobs of that tag and of no other; its time
    begins when it does, not when it is queued. An error of one job, or of making it, is kept as its outcome.
    """
    at_once = at_once or (AT_ONCE_OF_MANY if len(work) >= MANY else AT_ONCE)
    context = spark.sparkContext

    def run(name: str) -> Outcome:
        tag, began, over = f"within-{uuid.uuid4().hex}", time.monotonic(), threading.Event()

        def stop() -> None:
            over.set()
            while not done.is_set():  # a job may begin after the others were cancelled
                context.cancelJobsWithTag(tag)
                done.wait(0.5)

        done, watch = threading.Event(), threading.Timer(timeout, stop)
        watch.daemon = True
        context.addJobTag(tag)
        context.setInterruptOnCancel(True)
        watch.start()
        try:
            df = work[name]()
            rows = df.collect()
            if over.is_set():
                return Outcome(name, "late", [], None, time.monotonic() - began, f"longer than {timeout:g} s")
            return Outcome(name, "done", rows, df.schema, time.monotonic() - began)
        except Exception as fault:  # noqa: BLE001 - any fault of a table is an outcome
            late = over.is_set()
            return Outcome(name, "late" if late else "failed", [], None, time.monotonic() - began, f"longer than {timeout:g} s" if late else str(fault).split("\n")[0][:300])
        finally:
            done.set()
            watch.cancel()
            context.removeJobTag(tag)

    with ThreadPoolExecutor(at_once) as pool:
        return list(pool.map(run, work))


def profiles(spark: SparkSession, tables: dict[str, DataFrame], timeout: float = TIMEOUT, at_once: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(table and the columns of `governance.profile`) of the tables that could be profiled, and (position, table, status, error) of all."""
    found = each_within(spark, {name: lambda df=df: profile(df, df.columns) for name, df in tables.items()}, timeout, at_once)
    rows = [(o.name, *r) for o in found for r in o.rows]
    kept = spark.createDataFrame(rows, "table string, column string, n long, n_null long, n_distinct long, lowest string, highest string")
    return kept, spark.createDataFrame([(k, o.name, o.status, o.error) for k, o in enumerate(found)], "position int, table string, status string, error string")
