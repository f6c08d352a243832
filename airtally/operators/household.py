"""Household rollups: hours and counts per genre and daypart, and their shares."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from airtally.functions.scoring import percent_int
from airtally.functions.times import daypart

BRAND_TYPE = "array<struct<brand:string,score:int>>"
# Shares of hours have a denominator of one hour at least.
MINUTES_FLOOR = 60
BRAND_NOTE = "brand affinity needs a brand catalog"


def recent(viewership: DataFrame, as_of: Column, days: int = 7) -> DataFrame:
    """Rows of the last `days` days. The comparison is on the partition column's own
    text form, so that a partitioned table is pruned to those days."""
    oldest = F.date_format(F.date_sub(as_of, days), "yyyy-MM-dd")
    return viewership.filter(F.col("watch_date") >= oldest)


def genre_hours(viewership: DataFrame) -> DataFrame:
    return (
        viewership.filter(F.col("genre").isNotNull())
        .groupBy("household_id", "genre")
        .agg(
            F.sum("duration_minutes").alias("watch_minutes"),
            F.count(F.lit(1)).alias("view_count"),
        )
        .withColumn("watch_hours", F.col("watch_minutes") / 60)
    )


def daypart_counts(viewership: DataFrame) -> DataFrame:
    return (
        viewership.filter(F.col("watch_hour").isNotNull())
        .groupBy("household_id", daypart("watch_hour").alias("daypart"))
        .agg(F.count(F.lit(1)).alias("view_count"))
    )


def genre_affinity(viewership: DataFrame) -> DataFrame:
    """Share of a household's hours per genre.

    The windows run over one row per household and genre, already summed, and
    reuse the household partitioning.
    """
    mine = W.partitionBy("household_id")
    hours = genre_hours(viewership)
    total = F.sum("watch_minutes").over(mine)
    return hours.withColumn("total_minutes", total).withColumn(
        "score", percent_int(F.col("watch_minutes"), F.col("total_minutes"), MINUTES_FLOOR)
    )


def daypart_share(viewership: DataFrame) -> DataFrame:
    mine = W.partitionBy("household_id")
    counts = daypart_counts(viewership)
    total = F.sum("view_count").over(mine)
    return counts.withColumn("percentage", percent_int(F.col("view_count"), total))


def households(viewership: DataFrame) -> DataFrame:
    return viewership.select("household_id").distinct()


def brand_affinity(viewership: DataFrame, brands: DataFrame | None = None) -> DataFrame:
    """Brand signals per household.

    Without a catalog of (content_id, brand) the signals are an empty list with a
    note; with one they are the brand's share of the household's views.
    """
    if brands is None:
        return households(viewership).select(
            "household_id",
            F.array().cast(BRAND_TYPE).alias("brand_affinity_signals"),
            F.lit(BRAND_NOTE).alias("affinity_note"),
        )
    seen = (
        viewership.groupBy("household_id", "content_id").agg(F.count(F.lit(1)).alias("n"))
        .join(brands.select("content_id", "brand").distinct(), "content_id")
        .groupBy("household_id", "brand").agg(F.sum("n").alias("n"))
    )
    total = F.sum("n").over(W.partitionBy("household_id"))
    scored = seen.withColumn("score", percent_int(F.col("n"), total))
    return scored.groupBy("household_id").agg(
        F.sort_array(F.collect_list(F.struct("brand", "score"))).alias("brand_affinity_signals"),
        F.lit(None).cast("string").alias("affinity_note"),
    )


def profiles(viewership: DataFrame) -> DataFrame:
    """Hours, genre scores and daypart shares per household from a single scan.

    Grouping sets bring both groupings through one shuffle of partial sums. What
    crosses the second shuffle is one row per household and genre or daypart.
    """
    views = viewership.select(
        "household_id", "genre", daypart("watch_hour").alias("daypart"), "duration_minutes"
    )
    cells = (
        views.groupingSets(
            [["household_id", "genre"], ["household_id", "daypart"]],
            "household_id", "genre", "daypart",
        )
        .agg(
            F.grouping("daypart").alias("by_genre"),
            F.sum("duration_minutes").alias("watch_minutes"),
            F.count(F.lit(1)).alias("view_count"),
        )
        .filter(F.coalesce("genre", "daypart").isNotNull())
        .repartition("household_id")
    )
    is_genre = F.col("by_genre") == 1
    size = F.when(is_genre, F.col("watch_minutes")).otherwise(F.col("view_count"))
    share = F.when(is_genre, percent_int(F.col("size"), F.col("total"), MINUTES_FLOOR)).otherwise(
        percent_int(F.col("size"), F.col("total"))
    )
    total = F.sum("size").over(W.partitionBy("household_id", "by_genre"))
    scored = cells.withColumn("size", size).withColumn("total", total).withColumn("share", share)
    genre_score = F.struct("genre", F.col("share").alias("score"))
    daypart_part = F.struct("daypart", F.col("share").alias("percentage"))
    return (
        scored.groupBy("household_id")
        .agg(
            (F.sum(F.when(is_genre, F.col("watch_minutes"))) / 60).alias("total_hours_watched"),
            F.sort_array(F.collect_list(F.when(is_genre, genre_score)))
            .alias("genre_affinity_scores"),
            F.sort_array(F.collect_list(F.when(~is_genre, daypart_part)))
            .alias("daypart_patterns"),
        )
        .filter((F.size("genre_affinity_scores") > 0) & (F.size("daypart_patterns") > 0))
    )


def household_aggregates(
    viewership: DataFrame, brands: DataFrame | None = None, aggregated_at: Column | None = None
) -> DataFrame:
    """One row per household that has both a genre and a daypart: hours, genre
    scores, dayparts, brand signals."""
    merged = profiles(viewership)
    if brands is None:
        merged = merged.withColumns(
            {"brand_affinity_signals": F.array().cast(BRAND_TYPE), "affinity_note": F.lit(BRAND_NOTE)}
        )
    else:
        merged = merged.join(brand_affinity(viewership, brands), "household_id", "left")
    return with_score_maps(merged).withColumn(
        "aggregated_at", F.current_timestamp() if aggregated_at is None else aggregated_at
    )


def with_score_maps(aggregates: DataFrame) -> DataFrame:
    """Maps beside the arrays, so that `genre_scores['news']` reads a score."""
    return aggregates.withColumns(
        {
            "genre_scores": F.map_from_entries("genre_affinity_scores"),
            "daypart_scores": F.map_from_entries("daypart_patterns"),
        }
    )


# The standard segments as (id, name, kind, key, threshold).
STANDARD_SEGMENTS = (
    ("seg_high_engagement", "High Engagement Viewers", "hours", None, 50),
    ("seg_primetime_viewers", "Primetime Preference", "daypart", "primetime", 40),
    ("seg_news_watchers", "News Genre Enthusiasts", "genre", "news", 70),
    ("seg_sports_fans", "Sports Enthusiasts", "genre", "sports", 60),
)


def standard_segments(aggregates: DataFrame, definitions=STANDARD_SEGMENTS) -> DataFrame:
    """Members of the threshold segments, all of them in one pass."""
    measures = {
        "hours": lambda key: F.col("total_hours_watched"),
        "daypart": lambda key: F.try_element_at("daypart_scores", F.lit(key)),
        "genre": lambda key: F.try_element_at("genre_scores", F.lit(key)),
    }
    tags = [
        F.when(measures[kind](key) > threshold, F.lit(segment_id))
        for segment_id, _, kind, key, threshold in definitions
    ]
    return aggregates.select(
        F.explode(F.array_compact(F.array(*tags))).alias("segment_id"), "household_id"
    )
