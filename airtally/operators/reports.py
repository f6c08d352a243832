"""Delivery, campaign, partner, billing and usage reports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from airtally.functions import times
from airtally.functions.scoring import ratio_or_zero

# Revenue share and payout terms.
REVENUE_SHARE = 0.30
MIN_PAYOUT = 500.0
LATENCY_BUCKETS = (0.01, 0.05, 0.1, 0.5, 1.0, 5.0)


def delivery_stats(activations: DataFrame, as_of: Column, days: int = 7,
                   segment_id: str | None = None) -> DataFrame:
    recent = activations.filter(F.col("activated_at") >= F.date_sub(as_of, days))
    if segment_id is not None:
        recent = recent.filter(F.col("segment_id") == segment_id)
    return recent.agg(
        F.count(F.lit(1)).alias("activations"),
        F.coalesce(F.sum("device_count"), F.lit(0)).alias("devices"),
        F.coalesce(F.avg("cpm_floor"), F.lit(0.0)).alias("avg_cpm"),
    )


def delivery_kpis(delivery: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """CPM, CPC and return. Money comes in whole cents, so that sums are exact in any
    order; the rates are in the same unit."""
    sums = delivery.groupBy(*keys).agg(
        *[F.sum(c).alias(c) for c in ("impressions", "clicks", "conversions", "spend", "revenue")]
    )
    return sums.withColumns(
        {
            "cpm": ratio_or_zero(F.col("spend").cast("double"), F.col("impressions")) * 1000,
            "cpc": ratio_or_zero(F.col("spend").cast("double"), F.col("clicks")),
            "roi": ratio_or_zero(F.col("revenue").cast("double"), F.col("spend")),
        }
    )


def activate(requests: DataFrame, segments: DataFrame) -> DataFrame:
    """Status of each activation request: the segment must exist, the offer must
    reach its floor."""
    known = segments.select("segment_id", "minimum_cpm_floor", F.lit(True).alias("known"))
    joined = requests.join(known, "segment_id", "left")
    status = (
        F.when(F.col("known").isNull(), "not_found")
        .when(F.col("cpm_floor") < F.col("minimum_cpm_floor"), "below_floor")
        .otherwise("activated")
    )
    return joined.withColumn("status", status).drop("known")


def reach_series(samples: DataFrame, first: Column, last: Column) -> DataFrame:
    """One row per day of the span, also for days without samples."""
    daily = samples.groupBy(F.to_date("ts").alias("day")).agg(
        F.count_distinct("device_id").alias("unique_devices"),
        F.count(F.lit(1)).alias("impressions"),
        F.sum("spend_usd").alias("spend_usd"),
    )
    # A global aggregate gives the single row on which the day spine stands.
    one = samples.agg(F.count(F.lit(1)).alias("n"))
    spine = one.select(F.explode(F.sequence(first, last)).alias("day"))
    return spine.join(daily, "day", "left").select(
        "day",
        *[F.coalesce(c, F.lit(0)).alias(c) for c in ("unique_devices", "impressions")],
        F.coalesce("spend_usd", F.lit(0.0)).alias("spend_usd"),
    )


def report_totals(series: DataFrame) -> DataFrame:
    sums = series.agg(
        F.coalesce(F.sum("unique_devices"), F.lit(0)).alias("devices"),
        F.coalesce(F.sum("impressions"), F.lit(0)).alias("impressions"),
        F.coalesce(F.sum("spend_usd"), F.lit(0.0)).alias("spend_usd"),
    )
    return sums.withColumns(
        {
            "frequency": ratio_or_zero(F.col("impressions").cast("double"), F.col("devices")),
            "avg_cpm": ratio_or_zero(F.col("spend_usd"), F.col("impressions")) * 1000,
        }
    )


def campaign_rates(campaigns: DataFrame) -> DataFrame:
    """Effective CPM and share of the budget that is spent."""
    spend = F.col("spend_to_date_usd")
    return campaigns.withColumns(
        {
            "ecpm": ratio_or_zero(spend, F.col("impressions_delivered")) * 1000,
            "budget_used_percent": ratio_or_zero(spend, F.col("budget_usd")) * 100,
        }
    )


def campaign_segments(campaigns: DataFrame, segments: DataFrame) -> DataFrame:
    """Campaigns with the name of their segment. Segments are few next to
    campaigns, so the optimizer broadcasts them when their size allows."""
    return campaigns.join(segments.select("segment_id", "name"), "segment_id")


def overview(campaigns: DataFrame, events: DataFrame, spend: DataFrame, now: Column) -> DataFrame:
    """The front page: active campaigns, last day's devices and matches, month's spend."""
    day = F.col("ts") >= now - F.make_dt_interval(days=F.lit(1))
    seen = events.agg(
        F.count_distinct(F.when(day, F.col("device_id"))).alias("devices_24h"),
        F.count_if(day & F.col("matched")).alias("matches_24h"),
        F.count_if(day).alias("events_24h"),
    )
    active = campaigns.agg(F.count_if(F.col("status") == "active").alias("n")).scalar()
    this_month = F.date_trunc("month", F.col("ts")) == F.date_trunc("month", now)
    spent = spend.agg(F.coalesce(F.sum(F.when(this_month, F.col("usd"))), F.lit(0.0)).alias("n"))
    rate = ratio_or_zero(F.col("matches_24h").cast("double"), F.col("events_24h")) * 100
    return seen.select(
        active.alias("active_campaigns"), "devices_24h", "matches_24h",
        rate.alias("match_rate"), spent.scalar().alias("spend_mtd_usd"),
    )


def device_counts(events: DataFrame) -> DataFrame:
    return events.groupBy("manufacturer").agg(F.count_distinct("device_id").alias("device_count"))


def revenue_shares(counts: DataFrame, revenue: float, share: float = REVENUE_SHARE) -> DataFrame:
    """Each maker's part of the shared revenue by its part of the devices."""
    total = counts.agg(F.sum("device_count").alias("n")).scalar()
    part = F.col("device_count") / total
    return counts.select(
        "manufacturer", "device_count",
        F.round(part * revenue * share, 2).alias("revenue_share_usd"),
        F.round(part * 100, 2).alias("percentage"),
    )


def total_payout(shares: DataFrame) -> DataFrame:
    return shares.agg(F.sum("revenue_share_usd").alias("total_payout_usd"))


def manufacturer_summary(points: DataFrame, share: float = REVENUE_SHARE) -> DataFrame:
    """Gross revenue, share, fingerprints and devices. `points` has one row per data
    point with its price."""
    sums = points.groupBy("manufacturer").agg(
        F.sum("price").alias("gross_revenue"),
        F.count(F.lit(1)).alias("fingerprints_collected"),
        F.count_distinct("device_id").alias("active_devices"),
    )
    return sums.withColumns(
        {
            "manufacturer_share_pct": F.lit(share * 100),
            "manufacturer_payout": F.col("gross_revenue") * share,
        }
    )


def partner_statistics(points: DataFrame) -> DataFrame:
    """Per maker, and per maker and segment: devices, fingerprints, programs, revenue.
    Points are first counted per device and program, so that the two levels and their distinct counts
    copy those rows only; the maker's own row has no segment."""
    counted = points.groupBy("manufacturer", "segment", "device_id", "content_id").agg(
        F.count(F.lit(1)).alias("_points"), F.sum("price").alias("_price"))
    return counted.groupingSets(
        [["manufacturer"], ["manufacturer", "segment"]], "manufacturer", "segment"
    ).agg(
        F.count_distinct("device_id").alias("active_devices"),
        F.sum("_points").alias("fingerprints"),
        F.count_distinct("content_id").alias("programs"),
        F.sum("_price").alias("revenue"),
    )


def payout_rollover(monthly: DataFrame, minimum: float = MIN_PAYOUT) -> DataFrame:
    """Monthly payouts with the balance carried on while it is below the minimum.

    `monthly` has (manufacturer, month, earned), one row per month. A partner's
    months are few, so they are folded as one sorted list.
    """
    rows = monthly.groupBy("manufacturer").agg(
        F.array_sort(F.collect_list(F.struct("month", "earned"))).alias("months")
    )
    step = "struct<month:string,earned:double,paid:double,balance:double>"
    start = F.array().cast(f"array<{step}>")

    def fold(done: Column, row: Column) -> Column:
        carried = F.coalesce(F.try_element_at(done, F.lit(-1))["balance"], F.lit(0.0))
        due = carried + row["earned"]
        pays = due >= minimum
        entry = F.struct(
            row["month"].alias("month"),
            row["earned"].cast("double").alias("earned"),
            F.when(pays, due).otherwise(0.0).alias("paid"),
            F.when(pays, 0.0).otherwise(due).alias("balance"),
        )
        return F.concat(done, F.array(entry.cast(step)))

    folded = rows.select("manufacturer", F.aggregate("months", start, fold).alias("steps"))
    return folded.select("manufacturer", F.inline("steps"))


def monthly_invoices(billing: DataFrame) -> DataFrame:
    return billing.groupBy(
        "advertiser_id",
        F.trunc("event_date", "month").alias("period_start"),
        F.last_day("event_date").alias("period_end"),
    ).agg(F.sum("amount_cents").alias("amount_cents"), F.count(F.lit(1)).alias("events"))


def usage_by_type(billing: DataFrame) -> DataFrame:
    return billing.groupBy("advertiser_id", "event_type").agg(
        F.count(F.lit(1)).alias("events"), F.sum("amount_cents").alias("amount_cents")
    )


def api_usage_stats(usage: DataFrame, keys: tuple[str, ...] = ("client_id", "endpoint")) -> DataFrame:
    """Calls, latency quantiles and error share. Latency is in whole milliseconds,
    and the exact quantile keeps one counter per distinct value."""
    parts = [
        F.expr(f"percentile_disc({q}) WITHIN GROUP (ORDER BY response_ms)").cast("double").alias(n)
        for q, n in ((0.5, "p50_ms"), (0.95, "p95_ms"), (0.99, "p99_ms"))
    ]
    return usage.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("calls"), *parts,
        (F.avg((F.col("status_code") >= 500).cast("int")) * 100).alias("error_percent"),
    )


def latency_histogram(events: DataFrame, latency: str, buckets=LATENCY_BUCKETS,
                      keys: tuple[str, ...] = ()) -> DataFrame:
    """Cumulative counts per upper bound, the last one without bound."""
    counted = events.groupBy(*keys).agg(
        *[F.count_if(F.col(latency) <= b).alias(f"b{n}") for n, b in enumerate(buckets)],
        F.count(F.lit(1)).alias("all"),
    )
    rows = [
        F.struct(F.lit(str(b)).alias("le"), F.col(f"b{n}").alias("events"))
        for n, b in enumerate(buckets)
    ]
    rows.append(F.struct(F.lit("+Inf").alias("le"), F.col("all").alias("events")))
    return counted.select(*keys, F.inline(F.array(*rows)))


def match_counters(matches: DataFrame) -> DataFrame:
    """Counts by network and genre, by network, and over all, in one pass."""
    return matches.rollup("network", "genre").agg(F.count(F.lit(1)).alias("matches"))


def active_sessions(sessions: DataFrame, now: Column, ttl: int = 300) -> DataFrame:
    alive = sessions.filter(~times.older_than(now, "session_end", ttl))
    return alive.groupBy("network").agg(F.count(F.lit(1)).alias("active_sessions"))


def top_networks(viewership: DataFrame, n: int = 10) -> DataFrame:
    """Networks with most views. A sort with a limit keeps n rows per task."""
    counted = viewership.groupBy("network").agg(
        F.count(F.lit(1)).alias("views"), F.sum("duration_minutes").alias("minutes")
    )
    return counted.orderBy(F.col("views").desc(), "network").limit(n)


def newest(frame: DataFrame, ts: str, n: int = 1, ties: Sequence[str] = ()) -> DataFrame:
    """Newest rows; equal times go by `ties`, and without them by all other columns."""
    others = list(ties) or [c for c in frame.columns if c != ts]
    return frame.orderBy(F.col(ts).desc(), *others).limit(n)


def run_sql(spark, statement: str, one_row: bool = False) -> DataFrame:
    """A query in SQL over the session's views: all rows or the first one."""
    result = spark.sql(statement)
    return result.limit(1) if one_row else result
