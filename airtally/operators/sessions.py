"""Watch sessions from time-ordered events."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from airtally.plans import skew

GAP_SECONDS = 300
MIN_SECONDS = 1
_MERGE = {"sum": F.sum, "min": F.min, "max": F.max}


def sessionize(
    points: DataFrame,
    keys: Sequence[str],
    time: str,
    gap: int = GAP_SECONDS,
    content: Sequence[str] = (),
    measures: Mapping[str, tuple[str, Column]] | None = None,
    bucket_seconds: int = 3600,
) -> DataFrame:
    """Runs of a key's events with no pause above `gap` and, where `content` columns
    are named, no change in them.

    Gives keys, content, session_start, session_end, events and the measures, each
    of which is (sum|min|max, column). Order within a second follows the content.

    No task gets a key's whole time line. Events are first merged per second. The
    time line is cut into buckets that overlap by the gap, and sessions are built
    per bucket. Only the pieces at the edges of buckets, at most two per bucket,
    meet again per key to be put together.
    """
    measures = dict(measures or {})
    merged = {"events": "sum", **{name: how for name, (how, _) in measures.items()}}
    seconds = points.groupBy(*keys, F.col(time).alias("_t"), *content).agg(
        F.count(F.lit(1)).alias("events"),
        *[_MERGE[how](col).alias(name) for name, (how, col) in measures.items()],
    )
    placed = skew.with_halo(seconds, "_t", max(bucket_seconds, gap), gap)

    in_bucket = W.partitionBy(*keys, "bucket").orderBy("_t", *content)
    previous = F.lag("_t").over(in_bucket)
    starts = previous.isNull() | (F.col("_t") - previous > gap)
    for name in content:
        starts = starts | ~F.col(name).eqNullSafe(F.lag(name).over(in_bucket))
    numbered = (
        placed.withColumn("_starts", starts.cast("int"))
        .filter(~F.col("halo"))
        .withColumn(
            "_run", F.sum("_starts").over(in_bucket.rowsBetween(W.unboundedPreceding, 0))
        )
    )
    runs = numbered.groupBy(*keys, "bucket", "_run", *content).agg(
        F.min("_t").alias("session_start"),
        F.max("_t").alias("session_end"),
        *[_MERGE[how](name).alias(name) for name, how in merged.items()],
    )
    last = F.max("_run").over(W.partitionBy(*keys, "bucket"))
    at_edge = (F.col("_run") == 0) | (F.col("_run") == last)
    lanes = runs.withColumn("_line", F.when(~at_edge, F.col("bucket")))
    along = W.partitionBy(*keys, "_line").orderBy("bucket", "_run")
    joined = lanes.withColumn("_session", F.sum((F.col("_run") > 0).cast("int")).over(along))
    return (
        joined.groupBy(*keys, "_line", "_session", *content)
        .agg(
            F.min("session_start").alias("session_start"),
            F.max("session_end").alias("session_end"),
            *[_MERGE[how](name).alias(name) for name, how in merged.items()],
        )
        .drop("_line", "_session")
    )


def _long_enough(sessions: DataFrame, minimum: int) -> DataFrame:
    length = F.col("session_end") - F.col("session_start")
    return sessions.withColumn("duration_sec", length).filter(F.col("duration_sec") >= minimum)


def gap_sessions(events: DataFrame, keys: Sequence[str] = ("device_id",),
                 time: str = "timestamp_utc", gap: int = GAP_SECONDS,
                 minimum: int = MIN_SECONDS, **options) -> DataFrame:
    """Sessions by pause alone; those under `minimum` seconds are left out."""
    return _long_enough(sessionize(events, keys, time, gap, **options), minimum)


def content_sessions(matched: DataFrame, keys: Sequence[str] = ("device_id",),
                     time: str = "watch_start_utc", gap: int = GAP_SECONDS,
                     minimum: int = MIN_SECONDS, **options) -> DataFrame:
    """Sessions that end when the content changes or after a pause."""
    return _long_enough(
        sessionize(matched, keys, time, gap, content=("content_id",), **options), minimum
    )


def last_match_sessions(events: DataFrame, keys: Sequence[str] = ("device_id",),
                        time: str = "timestamp_utc", order: str = "event_id",
                        content: str = "content_id", gap: int = GAP_SECONDS,
                        minimum: int = MIN_SECONDS, **options) -> DataFrame:
    """The literal rule: every match starts the session anew, and only events
    without a match lengthen it.

    Of each run of events, then, the last match opens the one session that is
    left to expire, and the last event closes it.
    """
    match = F.when(
        F.col(content).isNotNull(),
        F.struct(F.col(time).alias("at"), F.col(order).alias("order"), F.col(content).alias("id")),
    )
    runs = sessionize(events, keys, time, gap, measures={"_match": ("max", match)}, **options)
    opened = runs.filter(F.col("_match").isNotNull()).select(
        *keys,
        F.col("_match.id").alias(content),
        F.col("_match.at").alias("session_start"),
        "session_end",
    )
    return _long_enough(opened, minimum)
