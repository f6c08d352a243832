"""Queries over household rollups."""

from __future__ import annotations

from pyspark.sql import functions as F

from airtally.operators import household as hh
from airtally.plans import domain as d
from airtally.plans.registry import query

AS_OF = "2024-01-31"

_GENRE = """, genre_hours AS (
  SELECT household_id, genre, CAST(sum(duration_minutes) AS BIGINT) AS minutes, sum(duration_minutes) / 60.0 AS watch_hours, count(*) AS view_count
  FROM viewership WHERE genre IS NOT NULL GROUP BY ALL),
genre_scored AS (
  SELECT *, sum(watch_hours) OVER (PARTITION BY household_id) AS total_hours,
         CAST(minutes * 100 // greatest(sum(minutes) OVER (PARTITION BY household_id), 60) AS INT) AS score
  FROM genre_hours)"""
_DAYPART = """, daypart_counts AS (
  SELECT household_id, CASE WHEN watch_hour BETWEEN 6 AND 11 THEN 'morning' WHEN watch_hour BETWEEN 12 AND 17 THEN 'afternoon'
         WHEN watch_hour BETWEEN 18 AND 22 THEN 'primetime' ELSE 'latenight' END AS daypart, count(*) AS view_count
  FROM viewership GROUP BY ALL),
daypart_scored AS (
  SELECT *, CAST(view_count * 100 // greatest(sum(view_count) OVER (PARTITION BY household_id), 1) AS INT) AS percentage
  FROM daypart_counts)"""


@query("household_genre_affinity", d.views("viewership") + _GENRE + """
SELECT household_id, genre, round(CAST(watch_hours AS DOUBLE), 4) AS watch_hours, view_count, score FROM genre_scored""")
def household_genre_affinity(spark, sf):
    return hh.genre_affinity(d.viewership(spark, sf)).select(
        "household_id", "genre", F.round("watch_hours", 4).alias("watch_hours"), "view_count", "score"
    )


@query("household_daypart", d.views("viewership") + _DAYPART + """
SELECT household_id, daypart, view_count, percentage FROM daypart_scored""")
def household_daypart(spark, sf):
    return hh.daypart_share(d.viewership(spark, sf))


_AGG = d.views("viewership") + _GENRE + _DAYPART + """, merged AS (
  SELECT g.household_id, g.total_hours_watched, g.genres, p.dayparts FROM
    (SELECT household_id, sum(watch_hours) AS total_hours_watched,
            string_agg(genre || ':' || score, ',' ORDER BY genre) AS genres FROM genre_scored GROUP BY 1) g
  JOIN (SELECT household_id, string_agg(daypart || ':' || percentage, ',' ORDER BY daypart) AS dayparts
        FROM daypart_scored GROUP BY 1) p USING (household_id))"""


def _pairs(col: str, a: str, b: str):
    return F.concat_ws(
        ",", F.transform(col, lambda x: F.concat(x[a], F.lit(":"), x[b].cast("string")))
    )


@query("household_aggregates", _AGG + """
SELECT household_id, round(CAST(total_hours_watched AS DOUBLE), 4) AS total_hours_watched, genres, dayparts,
       0 AS brand_signals FROM merged""")
def household_aggregates(spark, sf):
    return hh.household_aggregates(d.viewership(spark, sf)).select(
        "household_id",
        F.round("total_hours_watched", 4).alias("total_hours_watched"),
        _pairs("genre_affinity_scores", "genre", "score").alias("genres"),
        _pairs("daypart_patterns", "daypart", "percentage").alias("dayparts"),
        F.size("brand_affinity_signals").alias("brand_signals"),
    )


@query("household_total_hours_7d", d.views("viewership") + f"""
SELECT household_id, round(CAST(sum(duration_minutes) / 60.0 AS DOUBLE), 4) AS total_hours, count(*) AS view_count
FROM viewership WHERE watch_date >= strftime(DATE '{AS_OF}' - INTERVAL 7 DAY, '%Y-%m-%d') GROUP BY 1""")
def household_total_hours_7d(spark, sf):
    recent = hh.recent(d.viewership(spark, sf), F.lit(AS_OF).cast("date"), 7)
    return recent.groupBy("household_id").agg(
        F.round(F.sum("duration_minutes") / 60, 4).alias("total_hours"),
        F.count(F.lit(1)).alias("view_count"),
    )


@query("distinct_households", d.views("viewership") + "SELECT DISTINCT household_id FROM viewership")
def distinct_households(spark, sf):
    return hh.households(d.viewership(spark, sf))


@query("brand_affinity", d.views("viewership") + """, seen AS (
  SELECT household_id, network AS brand, count(*) AS n FROM viewership GROUP BY ALL)
SELECT household_id, brand,
       CAST(n * 100 // greatest(sum(n) OVER (PARTITION BY household_id), 1) AS INT) AS score
FROM seen""")
def brand_affinity(spark, sf):
    brands = d.content(spark, sf).select("content_id", F.col("network").alias("brand"))
    return hh.brand_affinity(d.viewership(spark, sf), brands).select(
        "household_id", F.inline("brand_affinity_signals")
    )


# The given tables have no news or sports; two of their genres stand in.
SEGMENTS = (
    ("seg_high_engagement", "High Engagement Viewers", "hours", None, 10),
    ("seg_primetime_viewers", "Primetime Preference", "daypart", "primetime", 25),
    ("seg_economy_watchers", "Economy Enthusiasts", "genre", "economy", 20),
    ("seg_promo_fans", "Promo Enthusiasts", "genre", "promo", 20),
)


@query("standard_segments", d.views("viewership") + _GENRE + _DAYPART + """
SELECT 'seg_high_engagement' AS segment_id, household_id FROM genre_scored GROUP BY household_id HAVING sum(watch_hours) > 10
UNION ALL SELECT 'seg_primetime_viewers', household_id FROM daypart_scored WHERE daypart = 'primetime' AND percentage > 25
UNION ALL SELECT 'seg_economy_watchers', household_id FROM genre_scored WHERE genre = 'economy' AND score > 20
UNION ALL SELECT 'seg_promo_fans', household_id FROM genre_scored WHERE genre = 'promo' AND score > 20""")
def standard_segments(spark, sf):
    return hh.standard_segments(hh.household_aggregates(d.viewership(spark, sf)), SEGMENTS)
