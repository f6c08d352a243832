"""Joins and windows that stay balanced when a few keys hold much of the data."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROWS_PER_SLICE = 5_000_000
MAX_HOT_KEYS = 100_000


def is_small(frame: DataFrame, rows: int) -> bool:
    """True when the frame has at most `rows` rows, by counting them."""
    return frame.count() <= rows


def hot_keys(
    frame: DataFrame, keys: Sequence[str], rows_per_slice: int = ROWS_PER_SLICE
) -> DataFrame:
    """Keys with more rows than one slice takes, and the slices each one needs.

    A key counts as hot only above a 100,000th of all rows, so that the result
    never has more than 100,000 rows and can be broadcast.
    """
    counts = frame.groupBy(*keys).agg(F.count(F.lit(1)).alias("rows"))
    total = counts.agg(F.sum("rows").alias("rows")).scalar()
    slice_rows = F.greatest(F.lit(float(rows_per_slice)), total / F.lit(MAX_HOT_KEYS))
    return counts.filter(F.col("rows") > slice_rows).select(
        *keys, F.ceil(F.col("rows") / slice_rows).cast("int").alias("slices")
    )


def with_slices(frame: DataFrame, hot: DataFrame, keys: Sequence[str], name: str) -> DataFrame:
    """Adds the number of slices of each row's key, 1 for keys that are not hot."""
    marked = frame.join(F.broadcast(hot.withColumnRenamed("slices", name)), list(keys), "left")
    return marked.withColumn(name, F.coalesce(name, F.lit(1)))


def slice_of(spread: Sequence[str], slices: str) -> Column:
    """Slice of a row by a hash of the columns that tell rows of one key apart. A hash,
    not a random number, so that a rerun task makes the same slices."""
    return F.pmod(F.xxhash64(*spread), F.col(slices)).cast("int")


def all_slices(slices: str) -> Column:
    return F.explode(F.sequence(F.lit(0), F.col(slices) - 1))


def salted_join(
    left: DataFrame,
    right: DataFrame,
    keys: Sequence[str],
    spread: Sequence[str],
    how: str = "inner",
    rows_per_slice: int = ROWS_PER_SLICE,
) -> DataFrame:
    """Join a large left side to a right side with few rows per key.

    The rows of a hot key are cut into slices, and the right rows of that key are
    repeated once per slice. The right side may have as many keys as the left one and
    is never broadcast, however small Spark takes it for: few rows are for the caller to broadcast.
    """
    hot = hot_keys(left, keys, rows_per_slice)
    l = with_slices(left, hot, keys, "_slices").withColumn("_slice", slice_of(spread, "_slices"))
    r = with_slices(right, hot, keys, "_slices").withColumn("_slice", all_slices("_slices"))
    joined = l.drop("_slices").join(r.drop("_slices").hint("merge"), [*keys, "_slice"], how)
    return joined.drop("_slice")


def with_halo(frame: DataFrame, time: str, width: int, reach: int) -> DataFrame:
    """Cut each key's time line into buckets of `width`.

    Rows of the last `reach` units of a bucket are also given to the next one,
    marked as halo, so that a look back of up to `reach` never leaves the bucket.
    """
    if reach > width:
        raise ValueError("a bucket must be at least as wide as the look back")
    offset = F.pmod(F.col(time), F.lit(width))
    bucket = ((F.col(time) - offset) / width).cast("bigint")

    def place(number: Column, halo: bool) -> Column:
        return F.struct(number.alias("bucket"), F.lit(halo).alias("halo"))

    places = F.when(
        offset >= width - reach, F.array(place(bucket, False), place(bucket + 1, True))
    ).otherwise(F.array(place(bucket, False)))
    return frame.select("*", F.inline(places))
