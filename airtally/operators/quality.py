"""Data quality: completeness, volume, match rate, and range checks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

# Expected ranges of a nightly cleanup.
DELETED_RANGE = (10_000, 100_000)
ARCHIVED_RANGE = (100, 50_000)


def completeness(frame: DataFrame, columns: list[str], minimum: float = 0.95) -> DataFrame:
    """Share of non-null values per column, in one pass."""
    counted = frame.agg(
        F.count(F.lit(1)).alias("_rows"), *[F.count(c).alias(c) for c in columns]
    )
    rows = [F.struct(F.lit(c).alias("column"), F.col(c).alias("present")) for c in columns]
    flat = counted.select(F.col("_rows").alias("rows"), F.inline(F.array(*rows)))
    share = F.coalesce(F.try_divide(F.col("present").cast("double"), F.col("rows")), F.lit(0.0))
    return flat.withColumn("share", share).withColumn("passed", F.col("share") >= minimum)


def volume_drops(frame: DataFrame, day: str, trailing: int = 7, max_drop: float = 0.5) -> DataFrame:
    """Rows per day against the mean of the days before. One row per day enters the
    window."""
    daily = frame.groupBy(day).agg(F.count(F.lit(1)).alias("rows"))
    line = W.partitionBy().orderBy(day).rowsBetween(-trailing, -1)
    expected = F.avg("rows").over(line)
    scored = daily.withColumn("expected", expected)
    low = F.col("rows") < F.col("expected") * (1 - max_drop)
    return scored.withColumn("passed", ~F.coalesce(low, F.lit(False)))


def rate_anomalies(rates: DataFrame, day: str, rate: str, trailing: int = 7,
                   max_change: float = 0.2) -> DataFrame:
    """Daily rates that leave the mean of the days before by more than `max_change`."""
    line = W.partitionBy().orderBy(day).rowsBetween(-trailing, -1)
    scored = rates.withColumn("expected", F.avg(rate).over(line))
    off = F.abs(F.col(rate) - F.col("expected")) > F.col("expected") * max_change
    return scored.withColumn("passed", ~F.coalesce(off, F.lit(False)))


def in_range(counts: DataFrame, checks: dict[str, tuple[int, int]]) -> DataFrame:
    """One row per check: the count, its range, and whether it is inside."""
    rows = [
        F.struct(
            F.lit(name).alias("check"), F.col(name).cast("bigint").alias("value"),
            F.lit(low).cast("bigint").alias("low"), F.lit(high).cast("bigint").alias("high"),
            F.col(name).between(low, high).alias("passed"),
        )
        for name, (low, high) in checks.items()
    ]
    return counts.select(F.inline(F.array(*rows)))


def all_passed(checks: DataFrame) -> DataFrame:
    return checks.agg(F.bool_and("passed").alias("passed"))


def required(columns: list[str]) -> Column:
    return reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in columns])
