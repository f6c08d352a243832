"""Late matches: events without a reference wait a day for one.

Unmatched events lie in a queue in folders of one hour of event time. A batch of new references reads the hours
its references can explain and probes their hashes in steps that lose nothing, from equal hashes up to the
tolerance; an event that is settled at one step does not reach the next. Hours that no reference
can explain any more fall away as whole folders, their rows are not read.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from airtally.functions import hashes
from airtally.operators import matching
from airtally.plans import skew
from airtally.session import saved, temporary_tables
from airtally.sources import folders

HOUR = 3600
DAY = 24 * HOUR
EVENT_KEYS = ("device_id", "fingerprint_hash", "timestamp_utc")


def write_spans(rows: DataFrame, path: str, batch_id: int, seconds: int = HOUR) -> None:
    """By span of event time, and by batch below, so that a batch that is run again replaces itself."""
    (
        rows.withColumns({"span": F.floor(F.col("timestamp_utc") / seconds), "batch_id": F.lit(batch_id)})
        .hint("rebalance", "span").write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
        .partitionBy("span", "batch_id").parquet(path)
    )


def read_spans(spark: SparkSession, path: str, schema: str, low: int, high: int, seconds: int = HOUR,
               before: int | None = None) -> DataFrame:
    """Rows of the spans that hold the times from `low` to `high`, of batches before one if asked; other
    folders are not opened."""
    leaves = [f"{path}/span={n}/batch_id={b}" for n, b in folders.two_levels(spark, path, "span", "batch_id")
              if low // seconds <= int(n) <= high // seconds and (before is None or int(b) < before)]
    if not leaves:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(*leaves)


def queue_sink(queue_path: str):
    """Batch function that lets unmatched events wait; malformed hashes can never match and are left out."""

    def run(batch: DataFrame, batch_id: int) -> None:
        write_spans(batch.filter(hashes.is_hash("fingerprint_hash")), queue_path, batch_id)

    return run


def probe(events: DataFrame, references: DataFrame, keys: Sequence[str] = EVENT_KEYS, hours: int = 24,
          tolerance: int = matching.DEFAULT_TOLERANCE, steps: Sequence[int] = (15,)) -> DataFrame:
    """The nearest reference of each event among those created up to `hours` after it: the keys, distance,
    reference_hash, created_at, content_id. Equal distances go to the smaller hash, then to the older row.

    A step below the number of byte bands finds every pair within it, so the nearest reference in time that
    it finds is the nearest there is, and its event need not be looked at again.
    """
    keys = list(keys)
    left = events.withColumn("query_hash", F.lower("fingerprint_hash"))
    refs = references.select(F.lower("fingerprint_hash").alias("reference_hash"), "created_at", "content_id")
    in_time = F.expr(f"created_at BETWEEN timestamp_utc AND timestamp_utc + {hours * HOUR}")
    found = []
    for step in [s for s in steps if s < min(tolerance, hashes.HASH_BITS // 8)] + [tolerance]:
        asked = left.select("query_hash").distinct()
        if step == 0:
            pairs = matching.exact_pairs(asked, references, "query_hash")
        else:
            pairs = matching.match_pairs(asked, references, step, query_column="query_hash")
        near = pairs.withColumnRenamed("fingerprint_hash", "reference_hash").join(refs, "reference_hash")
        met = skew.salted_join(left, near, ["query_hash"], tuple(keys), "inner").filter(in_time)
        best = F.min(F.struct("distance", "reference_hash", "created_at", "content_id")).alias("best")
        matched = saved(met.groupBy(*keys).agg(best).select(*keys, "best.*"), "late-found")
        found.append(matched)
        if step < tolerance:
            left = saved(left.join(matched, keys, "left_anti"), "late-left")
            if left.isEmpty():
                break
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


def probe_sink(queue_path: str, matches_path: str, hours: int = 24,
               tolerance: int = matching.DEFAULT_TOLERANCE, slack_hours: int = 1,
               arrival: Callable[[], float] = time.time):
    """Batch function over new references (fingerprint_hash, content_id, created_at). The matches are a table
    by day of event time.

    An event is matched once, by the first batch that explains it. References may come out of order
    by `slack_hours`; hours further back than that and `hours` are dropped. A reference whose clock is ahead of
    its arrival drops nothing.
    """
    match_schema = ("device_id string, fingerprint_hash string, timestamp_utc bigint, distance int, "
                    "reference_hash string, created_at bigint, content_id string")
    event_schema = "device_id string, fingerprint_hash string, timestamp_utc bigint"

    def run(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        good = batch.filter(hashes.is_hash("fingerprint_hash") & F.col("created_at").isNotNull())
        ends = good.agg(F.min("created_at").alias("low"), F.max("created_at").alias("high")).first()
        if ends["low"] is None:
            return
        low, high = ends["low"] - hours * HOUR, ends["high"]
        waiting = read_spans(spark, queue_path, event_schema, low, high)
        done = read_spans(spark, matches_path, match_schema, low, high, DAY, batch_id)
        # Equal rows are one event.
        events = waiting.distinct().join(done.select(*EVENT_KEYS), list(EVENT_KEYS), "left_anti")
        with temporary_tables(spark):
            # Many small folders are read once.
            events = saved(events, "waiting")
            write_spans(probe(events, good, EVENT_KEYS, hours, tolerance), matches_path, batch_id, DAY)
        horizon = min(ends["low"], int(arrival())) // HOUR - hours - slack_hours
        folders.drop_partitions(spark, queue_path, "span", [
            n for n in folders.partition_values(spark, queue_path, "span") if int(n) < horizon])

    return run
