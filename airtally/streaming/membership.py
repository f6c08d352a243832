"""Live segment membership: entries and exits as viewing comes in and as it grows old.

What makes a device a member is kept as *evidence*: per rule the last day on which it was true, and for
rules with hours the minutes of each day. From it follows the last true day of each (device, segment):
the device is a member until that day is older than the lookback. That day is known at once, so each pair
is written into a calendar under the day on which it expires. A batch looks at its own devices and at
those whose pairs expire now, and at nothing else: pairs that were renewed meanwhile stand in the calendar
under a later day too, and stay.

The evidence lies in hash buckets and a batch rewrites the buckets it touches, so that what is read does not
grow with the number of batches.
"""

from __future__ import annotations

import datetime
from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from airtally.operators import segments
from airtally.sources import buckets as bucketed
from airtally.sources import folders, lake

EVIDENCE = ("device_id string, household_id string, segment_id string, rule int, all_of int, needed double, "
            "day date, minutes bigint")
RULE_KEYS = ["device_id", "household_id", "segment_id", "rule", "all_of", "needed"]


def _parts(segment: segments.Segment) -> list[tuple[int, int, float | None, Column]]:
    """(rule, all_of, minutes needed, condition) of a definition. One without hours asks for a row that
    satisfies it as a whole; in one with hours each rule is true of the device by itself. `all_of` is the
    number of rules that have to be true, 0 where any of them will do."""
    conditions = [segments.rule_condition(r) for r in segment.rules]
    both = segment.logic == "AND"
    if not any(r.min_hours_week for r in segment.rules):
        whole = reduce((lambda a, b: a & b) if both else (lambda a, b: a | b), conditions)
        return [(0, 1, None, whole)]
    return [(i, len(conditions) if both else 0, 60.0 * r.min_hours_week if r.min_hours_week else None, c)
            for i, (r, c) in enumerate(zip(segment.rules, conditions))]


def _combined(rows: DataFrame) -> DataFrame:
    """One row per rule, and per day for rules with hours. Combines before the shuffle."""
    own_day = F.when(F.col("needed").isNotNull(), F.col("day")).alias("_own_day")
    return rows.groupBy(*RULE_KEYS, own_day).agg(
        F.max("day").alias("day"), F.sum("minutes").alias("minutes")).drop("_own_day")


def evidence(viewership: DataFrame, definitions: Sequence[segments.Segment]) -> DataFrame:
    """What the rows say about each device and rule, all definitions in one scan."""
    found = [
        F.when(condition, F.struct(
            F.lit(s.segment_id).alias("segment_id"), F.lit(rule).alias("rule"), F.lit(all_of).alias("all_of"),
            F.lit(needed).cast("double").alias("needed")))
        for s in map(segments.validate, definitions) for rule, all_of, needed, condition in _parts(s)]
    rows = viewership.select(
        "device_id", "household_id", F.col("viewing_date").alias("day"),
        F.col("duration_minutes").cast("bigint").alias("minutes"),
        F.inline(F.array_compact(F.array(*found))))
    minutes = F.when(F.col("needed").isNotNull(), F.coalesce("minutes", F.lit(0)))
    return _combined(rows.withColumn("minutes", minutes))


def last_days(rows: DataFrame) -> DataFrame:
    """(segment_id, device_id, last_day): the last day as of which the segment is still true without any
    lookback being considered.

    With hours, a week counts as long as what is left of it within the lookback reaches them: its last
    day is the latest from which on its minutes do. All rules then hold until the first of them ends,
    any of them until the last one does.
    """
    week = W.partitionBy(*RULE_KEYS, F.date_trunc("week", "day")).orderBy(F.desc("day"))
    hours = rows.filter("needed IS NOT NULL").withColumn("_from", F.sum("minutes").over(week)).filter(
        "_from >= needed").drop("_from")
    true = rows.filter("needed IS NULL").unionByName(hours)
    per_rule = true.groupBy("device_id", "household_id", "segment_id", "rule", "all_of").agg(
        F.max("day").alias("day"))
    joined = per_rule.groupBy("device_id", "household_id", "segment_id", "all_of").agg(
        F.count(F.lit(1)).alias("held"), F.min("day").alias("first"), F.max("day").alias("last"))
    day = F.when(F.col("all_of") == 0, F.col("last")).when(F.col("held") == F.col("all_of"), F.col("first"))
    return joined.withColumn("day", day).filter("day IS NOT NULL").groupBy("segment_id", "device_id").agg(
        F.max("day").alias("last_day"))


def newest_day(batch: DataFrame) -> datetime.date | None:
    return batch.agg(F.max("viewing_date")).first()[0]


def _lookback(definitions: Sequence[segments.Segment]) -> Column:
    pairs = [F.lit(x) for s in definitions for x in (s.segment_id, s.lookback_days)]
    return F.create_map(*pairs)[F.col("segment_id")]


def _due(spark: SparkSession, calendar: str, day: datetime.date, before: int) -> DataFrame:
    """Devices with a pair that expires by the day, as earlier batches wrote them down."""
    leaves = [f"{calendar}/expires={d}/batch_id={b}"
              for d, b in folders.two_levels(spark, calendar, "expires", "batch_id")
              if d <= day.isoformat() and int(b) < before]
    if not leaves:
        return spark.createDataFrame([], "device_id string")
    return spark.read.schema("device_id string").parquet(*leaves)


def membership_sink(definitions: Sequence[segments.Segment], state_path: str, events_path: str,
                    as_of: Callable[[DataFrame], datetime.date | None] = newest_day,
                    buckets: int = bucketed.BUCKETS):
    """Batch function that sends (segment_id, device_id, event_type, day): who entered and who left since
    the batch before, as of the batch's day (its newest viewing date unless `as_of` says otherwise, and
    never before that of an earlier batch).

    The rows are those of `segments.transitions` between the populations as of the two days. A batch that is
    run again gives the same rows. The state belongs to the definitions it was made with.
    """
    state, calendar, days = (f"{state_path}/{n}" for n in ("evidence", "calendar", "days"))
    lookback = _lookback(definitions)

    def run(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        day = as_of(batch)
        known_days = {int(b): d for b, d in folders.two_levels(spark, days, "batch_id", "day")
                      if int(b) < batch_id}
        last_batch = max(known_days, default=None)
        previous = datetime.date.fromisoformat(known_days[last_batch]) if known_days else None
        if day is None:
            return
        day = max(day, previous) if previous else day
        if previous:
            # What expired by then has been settled by a batch that is finished.
            over = {d for d, _ in folders.two_levels(spark, calendar, "expires", "batch_id")
                    if d <= previous.isoformat()}
            folders.drop_partitions(spark, calendar, "expires", over)
        new = evidence(batch, definitions).persist()
        affected = new.select("device_id").unionByName(_due(spark, calendar, day, batch_id)).distinct().persist()
        rewritten = bucketed.touched(affected, "device_id", buckets)
        old = bucketed.read(spark, state, EVIDENCE, rewritten, batch_id, "device_id").persist()
        mine = old.join(affected, "device_id", "left_semi")
        within = F.col("day") >= F.date_sub(F.lit(day), lookback)
        merged = _combined(mine.unionByName(new)).filter(within).persist()
        before, after = last_days(mine).persist(), last_days(merged).persist()
        try:
            member = F.col("last_day") >= F.date_sub(F.lit(day), lookback)
            was = before.filter(F.col("last_day") >= F.date_sub(F.lit(previous), lookback)) if previous else (
                before.limit(0))
            changed = segments.transitions(was, after.filter(member)).withColumn("day", F.lit(day))
            lake.append_changes(changed, events_path, batch_id)
            renewed = after.filter(member).join(before, ["segment_id", "device_id", "last_day"], "left_anti")
            expires = F.date_add("last_day", lookback + 1)
            (
                renewed.select("device_id", expires.cast("string").alias("expires"), F.lit(batch_id).alias("batch_id"))
                .distinct().write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
                .partitionBy("expires", "batch_id").parquet(calendar)
            )
            others = old.join(affected, "device_id", "left_anti")
            bucketed.write(merged.unionByName(others), state, rewritten, batch_id, "device_id", buckets)
            folders.drop_partitions(spark, days, "batch_id", [str(batch_id)])
            folders.make(spark, f"{days}/batch_id={batch_id}/day={day.isoformat()}")
            done = [str(b) for b in known_days if b < last_batch]
            folders.drop_partitions(spark, days, "batch_id", done)
        finally:
            for frame in (new, affected, old, merged, before, after):
                frame.unpersist()

    return run
