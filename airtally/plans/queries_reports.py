"""Queries over reports, billing, usage, alerts and data quality."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from airtally.operators import alerts as al
from airtally.operators import quality as ql
from airtally.operators import reports as rp
from airtally.plans import domain as d
from airtally.plans.registry import query

AS_OF = "2001-08-01"
NOW = "2024-01-30 12:00:00"
NOW_SECONDS = 1706616000


def _date(text):
    return F.lit(text).cast("date")


def _round(frame, *columns, digits=4):
    return frame.withColumns({c: F.round(c, digits) for c in columns})


@query("delivery_stats", d.views("segment_activations") + f"""
SELECT count(*) AS activations, CAST(coalesce(sum(device_count), 0) AS BIGINT) AS devices, round(coalesce(avg(cpm_floor), 0), 6) AS avg_cpm
FROM segment_activations WHERE activated_at >= DATE '{AS_OF}' - INTERVAL 90 DAY""")
def delivery_stats(spark, sf):
    return _round(rp.delivery_stats(d.segment_activations(spark, sf), _date(AS_OF), 90), "avg_cpm", digits=6)


@query("delivery_stats_segment", d.views("segment_activations") + f"""
SELECT count(*) AS activations, CAST(coalesce(sum(device_count), 0) AS BIGINT) AS devices, round(coalesce(avg(cpm_floor), 0), 6) AS avg_cpm
FROM segment_activations WHERE activated_at >= DATE '{AS_OF}' - INTERVAL 365 DAY AND segment_id = '2-HIGH'""")
def delivery_stats_segment(spark, sf):
    out = rp.delivery_stats(d.segment_activations(spark, sf), _date(AS_OF), 365, "2-HIGH")
    return _round(out, "avg_cpm", digits=6)


_DELIVERY = """WITH delivery AS (SELECT l_returnflag AS segment_id, CAST(l_shipdate AS DATE) AS date, CAST(l_quantity * 1000 AS BIGINT) AS impressions,
  CAST(l_quantity AS BIGINT) AS clicks, CAST(l_linenumber AS BIGINT) AS conversions, CAST(floor(l_extendedprice) AS BIGINT) AS spend, CAST(floor(l_extendedprice * (1 - l_discount) * 2) AS BIGINT) AS revenue FROM lineitem)"""


def delivery(spark, sf):
    return d.table(spark, sf, "lineitem").select(
        F.col("l_returnflag").alias("segment_id"),
        F.to_date("l_shipdate").alias("date"),
        (F.col("l_quantity") * 1000).cast("bigint").alias("impressions"),
        F.col("l_quantity").cast("bigint").alias("clicks"),
        F.col("l_linenumber").cast("bigint").alias("conversions"),
        F.floor("l_extendedprice").cast("bigint").alias("spend"),
        F.floor(F.col("l_extendedprice") * (1 - F.col("l_discount")) * 2).cast("bigint").alias("revenue"),
    )


@query("delivery_kpis", _DELIVERY + """
SELECT segment_id, date, CAST(sum(impressions) AS BIGINT) AS impressions, CAST(sum(clicks) AS BIGINT) AS clicks,
  CAST(sum(conversions) AS BIGINT) AS conversions, CAST(sum(spend) AS BIGINT) AS spend, CAST(sum(revenue) AS BIGINT) AS revenue,
  round(sum(spend)::DOUBLE / sum(impressions)::DOUBLE * 1000, 8) AS cpm, round(sum(spend)::DOUBLE / sum(clicks)::DOUBLE, 8) AS cpc, round(sum(revenue)::DOUBLE / sum(spend)::DOUBLE, 8) AS roi
FROM delivery GROUP BY 1, 2""")
def delivery_kpis(spark, sf):
    out = rp.delivery_kpis(delivery(spark, sf), ("segment_id", "date"))
    return _round(out, "cpm", "cpc", "roi", digits=8)


_SEGMENT_FLOORS = """floors AS (SELECT o_orderpriority AS segment_id, 0.20 + count(*) % 30 / 100.0 AS minimum_cpm_floor FROM orders
  WHERE o_orderpriority <> '5-LOW' GROUP BY 1)"""


@query("activation_checks", d.views("segment_activations") + ", " + _SEGMENT_FLOORS + """
SELECT id, CASE WHEN f.segment_id IS NULL THEN 'not_found' WHEN a.cpm_floor < CAST(f.minimum_cpm_floor AS DOUBLE) THEN 'below_floor' ELSE 'activated' END AS status
FROM segment_activations a LEFT JOIN floors f USING (segment_id)""")
def activation_checks(spark, sf):
    a = d.segment_activations(spark, sf)
    floors = (
        a.filter(F.col("segment_id") != "5-LOW").groupBy("segment_id")
        .agg((F.lit(0.20) + F.count(F.lit(1)) % 30 / 100.0).alias("minimum_cpm_floor"))
    )
    return rp.activate(a, floors).select("id", "status")


_SAMPLES = d.views("fingerprints") + """, samples AS (SELECT device_id, make_timestamp(timestamp_utc * 1000000) AS ts, value / 100 AS spend_usd, event_type FROM fingerprints)"""


def samples(spark, sf):
    return d.fingerprints(spark, sf).select(
        "device_id", F.timestamp_seconds("timestamp_utc").alias("ts"),
        (F.col("value") / 100).alias("spend_usd"), "event_type",
    )


_SERIES = _SAMPLES + """, spine AS (SELECT CAST(x AS DATE) AS day FROM range(DATE '2023-12-25', DATE '2024-02-05', INTERVAL 1 DAY) t(x)),
daily AS (SELECT CAST(ts AS DATE) AS day, count(DISTINCT device_id) AS u, count(*) AS i, sum(spend_usd) AS s FROM samples GROUP BY 1),
series AS (SELECT day, coalesce(u, 0) AS unique_devices, coalesce(i, 0) AS impressions, coalesce(s, 0.0) AS spend_usd FROM spine LEFT JOIN daily USING (day))"""


def series(spark, sf):
    return rp.reach_series(samples(spark, sf), _date("2023-12-25"), _date("2024-02-04"))


@query("reach_series", _SERIES + " SELECT day, unique_devices, impressions, round(spend_usd, 4) AS spend_usd FROM series")
def reach_series(spark, sf):
    return _round(series(spark, sf), "spend_usd")


@query("report_totals", _SERIES + """
SELECT CAST(sum(unique_devices) AS BIGINT) AS devices, CAST(sum(impressions) AS BIGINT) AS impressions, round(sum(spend_usd), 4) AS spend_usd,
  round(sum(impressions) / sum(unique_devices)::DOUBLE, 6) AS frequency, round(sum(spend_usd) / sum(impressions) * 1000, 6) AS avg_cpm FROM series""")
def report_totals(spark, sf):
    out = rp.report_totals(series(spark, sf))
    return _round(_round(out, "spend_usd"), "frequency", "avg_cpm", digits=6)


_CAMPAIGNS = d.views("campaigns") + """, spent AS (SELECT o_custkey AS campaign_id, CAST(sum(CAST(floor(o_totalprice) AS BIGINT)) AS DOUBLE) / 1000 AS spend, count(*) * 5000 AS impressions FROM orders GROUP BY 1),
c AS (SELECT campaign_id, segment_id, status, budget_usd, coalesce(spend, 0.0) AS spend_to_date_usd, coalesce(impressions, 0) AS impressions_delivered
  FROM campaigns LEFT JOIN spent USING (campaign_id))"""


def running_campaigns(spark, sf):
    spent = d.table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("campaign_id")).agg(
        (F.sum(F.floor("o_totalprice")) / 1000).alias("spend_to_date_usd"),
        (F.count(F.lit(1)) * 5000).alias("impressions_delivered"),
    )
    joined = d.campaigns(spark, sf).join(spent, "campaign_id", "left")
    return joined.withColumns(
        {
            "spend_to_date_usd": F.coalesce("spend_to_date_usd", F.lit(0.0)),
            "impressions_delivered": F.coalesce("impressions_delivered", F.lit(0)),
        }
    )


@query("campaign_ecpm", _CAMPAIGNS + """
SELECT campaign_id, round(CASE WHEN impressions_delivered = 0 THEN 0.0 ELSE spend_to_date_usd / impressions_delivered * 1000 END, 8) AS ecpm,
  round(CASE WHEN budget_usd = 0 THEN 0.0 ELSE spend_to_date_usd / budget_usd * 100 END, 8) AS budget_used_percent FROM c""")
def campaign_ecpm(spark, sf):
    out = rp.campaign_rates(running_campaigns(spark, sf))
    return _round(out.select("campaign_id", "ecpm", "budget_used_percent"), "ecpm", "budget_used_percent", digits=8)


@query("campaign_segment_names", d.views("campaigns") + """, s AS (SELECT segment_id, 'Segment ' || segment_id AS name FROM (SELECT DISTINCT segment_id FROM campaigns))
SELECT campaign_id, segment_id, name FROM campaigns JOIN s USING (segment_id)""")
def campaign_segment_names(spark, sf):
    c = d.campaigns(spark, sf)
    names = c.select("segment_id").distinct().withColumn(
        "name", F.concat(F.lit("Segment "), F.col("segment_id"))
    )
    return rp.campaign_segments(c, names).select("campaign_id", "segment_id", "name")


@query("overview_kpis", _SAMPLES + f""", base AS (SELECT *, event_type <> 'error' AS matched, ts >= TIMESTAMP '{NOW}' - INTERVAL 1 DAY AS recent FROM samples)
SELECT (SELECT count(*) FROM customer WHERE c_acctbal > 0) AS active_campaigns, count(DISTINCT CASE WHEN recent THEN device_id END) AS devices_24h,
  count(*) FILTER (recent AND matched) AS matches_24h, round(count(*) FILTER (recent AND matched)::DOUBLE / count(*) FILTER (recent) * 100, 6) AS match_rate,
  round((SELECT sum(spend_usd) FROM samples WHERE date_trunc('month', ts) = DATE '2024-01-01'), 4) AS spend_mtd_usd FROM base""")
def overview_kpis(spark, sf):
    s = samples(spark, sf).withColumn("matched", F.col("event_type") != "error")
    now = F.lit(NOW).cast("timestamp")
    spend = s.select("ts", F.col("spend_usd").alias("usd"))
    out = rp.overview(d.campaigns(spark, sf), s, spend, now)
    return _round(_round(out, "spend_mtd_usd"), "match_rate", digits=6)


_COUNTS = d.views("fingerprints") + ", counts AS (SELECT manufacturer, count(DISTINCT device_id) AS device_count FROM fingerprints GROUP BY 1)"
_SHARES = _COUNTS + """, shares AS (SELECT manufacturer, device_count, round(device_count / (SELECT sum(device_count) FROM counts)::DOUBLE * 1000000.0 * 0.3, 2) AS revenue_share_usd,
  round(device_count / (SELECT sum(device_count) FROM counts)::DOUBLE * 100, 2) AS percentage FROM counts)"""


@query("manufacturer_device_counts", _COUNTS + " SELECT * FROM counts")
def manufacturer_device_counts(spark, sf):
    return rp.device_counts(d.fingerprints(spark, sf))


def shares(spark, sf):
    return rp.revenue_shares(rp.device_counts(d.fingerprints(spark, sf)), 1_000_000.0)


@query("revenue_share", _SHARES + " SELECT * FROM shares")
def revenue_share(spark, sf):
    return shares(spark, sf)


@query("total_payout", _SHARES + " SELECT round(sum(revenue_share_usd), 2) AS total_payout_usd FROM shares")
def total_payout(spark, sf):
    return _round(rp.total_payout(shares(spark, sf)), "total_payout_usd", digits=2)


_POINTS = d.views("viewership") + ", points AS (SELECT manufacturer, device_id, content_id, genre AS segment, 0.02::DOUBLE + duration_minutes / 200.0::DOUBLE AS price FROM viewership)"


def points(spark, sf):
    return d.viewership(spark, sf).select(
        "manufacturer", "device_id", "content_id", F.col("genre").alias("segment"),
        (F.lit(0.02) + F.col("duration_minutes") / 200.0).alias("price"),
    )


@query("manufacturer_summary", _POINTS + """
SELECT manufacturer, round(sum(price), 4) AS gross_revenue, count(*) AS fingerprints_collected, count(DISTINCT device_id) AS active_devices,
  30.0::DOUBLE AS manufacturer_share_pct, round(sum(price) * 0.3, 4) AS manufacturer_payout FROM points GROUP BY 1""")
def manufacturer_summary(spark, sf):
    return _round(rp.manufacturer_summary(points(spark, sf)), "gross_revenue", "manufacturer_payout", "manufacturer_share_pct")


@query("partner_statistics", _POINTS + """
SELECT manufacturer, segment, count(DISTINCT device_id) AS active_devices, count(*) AS fingerprints, count(DISTINCT content_id) AS programs,
  round(sum(price), 4) AS revenue FROM points GROUP BY GROUPING SETS ((manufacturer), (manufacturer, segment))""")
def partner_statistics(spark, sf):
    return _round(rp.partner_statistics(points(spark, sf)), "revenue")


@query("payout_rollover", """WITH RECURSIVE monthly AS (SELECT 'm' || (l_suppkey % 8) AS manufacturer, strftime(l_shipdate, '%Y-%m') AS month,
    floor(sum(l_quantity)) / 4 AS earned FROM lineitem GROUP BY 1, 2),
n AS (SELECT *, row_number() OVER (PARTITION BY manufacturer ORDER BY month) AS i FROM monthly),
steps AS (SELECT manufacturer, month, i, earned, CASE WHEN earned >= 500 THEN earned ELSE 0.0 END AS paid, CASE WHEN earned >= 500 THEN 0.0 ELSE earned END AS balance FROM n WHERE i = 1
  UNION ALL SELECT n.manufacturer, n.month, n.i, n.earned, CASE WHEN s.balance + n.earned >= 500 THEN s.balance + n.earned ELSE 0.0 END,
    CASE WHEN s.balance + n.earned >= 500 THEN 0.0 ELSE s.balance + n.earned END FROM steps s JOIN n ON n.manufacturer = s.manufacturer AND n.i = s.i + 1)
SELECT manufacturer, month, earned, paid, balance FROM steps""")
def payout_rollover(spark, sf):
    l = d.table(spark, sf, "lineitem")
    monthly = l.groupBy(
        F.concat(F.lit("m"), F.col("l_suppkey") % 8).alias("manufacturer"),
        F.date_format("l_shipdate", "yyyy-MM").alias("month"),
    ).agg((F.floor(F.sum("l_quantity")) / 4).alias("earned"))
    return rp.payout_rollover(monthly)


@query("monthly_invoices", d.views("billing_events") + """
SELECT advertiser_id, date_trunc('month', event_date)::DATE AS period_start, last_day(event_date) AS period_end,
  CAST(sum(amount_cents) AS BIGINT) AS amount_cents, count(*) AS events FROM billing_events GROUP BY 1, 2, 3""")
def monthly_invoices(spark, sf):
    return rp.monthly_invoices(d.billing_events(spark, sf))


@query("billing_usage", d.views("billing_events") + """
SELECT advertiser_id, event_type, count(*) AS events, CAST(sum(amount_cents) AS BIGINT) AS amount_cents FROM billing_events GROUP BY 1, 2""")
def billing_usage(spark, sf):
    return rp.usage_by_type(d.billing_events(spark, sf))


@query("api_usage_percentiles", d.views("api_usage") + """
SELECT client_id, endpoint, count(*) AS calls, quantile_disc(response_ms, 0.5)::DOUBLE AS p50_ms, quantile_disc(response_ms, 0.95)::DOUBLE AS p95_ms,
  quantile_disc(response_ms, 0.99)::DOUBLE AS p99_ms, round(avg(CASE WHEN status_code >= 500 THEN 100.0 ELSE 0.0 END), 4) AS error_percent FROM api_usage GROUP BY 1, 2""")
def api_usage_percentiles(spark, sf):
    return _round(rp.api_usage_stats(d.api_usage(spark, sf)), "error_percent")


@query("latency_histogram", d.views("api_usage") + ", b AS (SELECT client_id, " + ", ".join(
    f"count(*) FILTER (response_ms / 60.0::DOUBLE <= {b}) AS b{n}" for n, b in enumerate(rp.LATENCY_BUCKETS))
    + ", count(*) AS a FROM api_usage GROUP BY 1)\n" + "\nUNION ALL ".join(
    [f"SELECT client_id, '{b}' AS le, b{n} AS events FROM b" for n, b in enumerate(rp.LATENCY_BUCKETS)]
    + ["SELECT client_id, '+Inf' AS le, a AS events FROM b"]))
def latency_histogram(spark, sf):
    usage = d.api_usage(spark, sf).withColumn("seconds", F.col("response_ms") / 60.0)
    return rp.latency_histogram(usage, "seconds", keys=("client_id",))


@query("match_counters", d.views("viewership") + """
SELECT network, genre, count(*) AS matches FROM viewership GROUP BY ROLLUP (network, genre)""")
def match_counters(spark, sf):
    return rp.match_counters(d.viewership(spark, sf))


@query("unmatched_by_manufacturer", d.views("fingerprints") + """
SELECT manufacturer, count(*) AS unmatched FROM fingerprints WHERE event_type = 'error' GROUP BY 1""")
def unmatched_by_manufacturer(spark, sf):
    f = d.fingerprints(spark, sf).filter(F.col("event_type") == "error")
    return f.groupBy("manufacturer").agg(F.count(F.lit(1)).alias("unmatched"))


@query("active_sessions", d.views("viewership") + f""", s AS (SELECT device_id, network, max(watch_start_utc) AS session_end FROM viewership GROUP BY 1, 2)
SELECT network, count(*) AS active_sessions FROM s WHERE {NOW_SECONDS} - session_end <= 43200 GROUP BY 1""")
def active_sessions(spark, sf):
    s = d.viewership(spark, sf).groupBy("device_id", "network").agg(F.max("watch_start_utc").alias("session_end"))
    return rp.active_sessions(s, F.lit(NOW_SECONDS), 43200)


@query("top_networks", d.views("viewership") + """
SELECT network, count(*) AS views, CAST(sum(duration_minutes) AS BIGINT) AS minutes FROM viewership GROUP BY 1 ORDER BY views DESC, network LIMIT 10""")
def top_networks(spark, sf):
    return rp.top_networks(d.viewership(spark, sf))


@query("newest_event", "SELECT event_id, user_id FROM events ORDER BY ts DESC LIMIT 1")
def newest_event(spark, sf):
    return rp.newest(d.table(spark, sf, "events"), "ts").select("event_id", "user_id")


@query("sql_households", d.views("viewership") + "SELECT daypart, count(DISTINCT household_id) AS households FROM (SELECT household_id, CASE WHEN watch_hour BETWEEN 6 AND 11 THEN 'morning' WHEN watch_hour BETWEEN 12 AND 17 THEN 'afternoon' WHEN watch_hour BETWEEN 18 AND 22 THEN 'primetime' ELSE 'latenight' END AS daypart FROM viewership) GROUP BY 1")
def sql_households(spark, sf):
    """Ad-hoc SQL with the engine's own functions."""
    from airtally.functions import catalog

    catalog.register(spark)
    d.viewership(spark, sf).createOrReplaceTempView("viewership_rows")
    return rp.run_sql(
        spark,
        "SELECT daypart(watch_hour) AS daypart, count(DISTINCT household_id(device_id, ip_address)) AS households "
        "FROM viewership_rows GROUP BY 1",
    )


_RATES = d.views("fingerprints") + """, w AS (SELECT manufacturer, timestamp_utc - timestamp_utc % 3600 AS window_start, count(*) AS events,
  count(*) FILTER (event_type = 'error') AS failed FROM fingerprints GROUP BY 1, 2)"""


def rates(spark, sf, seconds=3600):
    return al.window_rates(
        d.fingerprints(spark, sf), "timestamp_utc", seconds, ("manufacturer",),
        F.col("event_type") == "error",
    )


@query("window_rates", _RATES + """
SELECT manufacturer, window_start, events, failed, round(events / 3600.0, 8) AS per_second, round(failed * 100.0 / events, 4) AS error_percent FROM w""")
def window_rates(spark, sf):
    return _round(_round(rates(spark, sf), "per_second", digits=8), "error_percent")


@query("rate_5m", d.views("fingerprints") + """
SELECT timestamp_utc - timestamp_utc % 300 AS window_start, count(*) AS events, round(count(*) / 300.0, 8) AS per_second FROM fingerprints GROUP BY 1""")
def rate_5m(spark, sf):
    out = al.window_rates(d.fingerprints(spark, sf), "timestamp_utc", 300)
    return _round(out.select("window_start", "events", "per_second"), "per_second", digits=8)


@query("rolling_spike", _RATES + """, r AS (SELECT manufacturer, window_start, events, avg(events) OVER (PARTITION BY manufacturer ORDER BY window_start
  RANGE BETWEEN 86400 PRECEDING AND CURRENT ROW) AS rolling FROM w)
SELECT manufacturer, window_start, events, round(rolling, 6) AS rolling FROM r WHERE events > rolling * 2""")
def rolling_spike(spark, sf):
    out = al.rolling_spikes(
        rates(spark, sf).select("manufacturer", "window_start", "events"),
        "manufacturer", value="events", seconds=86400, multiple=2.0,
    )
    return _round(out, "rolling", digits=6)


@query("alert_hold", _RATES + """, bad AS (SELECT manufacturer, window_start, window_start - 3600 * row_number() OVER (PARTITION BY manufacturer ORDER BY window_start) AS island
  FROM w WHERE failed * 100.0 / events > 10)
SELECT manufacturer, min(window_start) AS first_window, max(window_start) AS last_window, count(*) AS windows FROM bad GROUP BY manufacturer, island HAVING count(*) >= 2""")
def alert_hold(spark, sf):
    breaches = rates(spark, sf).withColumn("breach", F.col("error_percent") > 10)
    return al.held(breaches, "manufacturer", "window_start", 3600, 2)


@query("slo_breaches", d.views("api_usage") + """
SELECT at_ms // 1000 - (at_ms // 1000) % 21600 AS window_start, count(*) AS requests, round(avg(CASE WHEN status_code >= 500 THEN 1.0 ELSE 0.0 END), 6) AS error_rate,
  quantile_disc(response_ms, 0.95)::DOUBLE AS latency, avg(CASE WHEN status_code >= 500 THEN 1.0 ELSE 0.0 END) > 0.25 OR quantile_disc(response_ms, 0.95) > 100 AS breach
FROM api_usage GROUP BY 1""")
def slo_breaches(spark, sf):
    usage = d.api_usage(spark, sf).withColumn("at", F.floor(F.col("at_ms") / 1000).cast("bigint"))
    out = al.slo_windows(usage, "at", "response_ms", F.col("status_code") >= 500, 21600, 0.25, 0.95, 100.0)
    return _round(out, "error_rate", digits=6)


_ALERTS = d.views("fingerprints") + """, day AS (SELECT manufacturer, timestamp_utc // 86400 AS d, count(*) AS n, count(*) FILTER (event_type = 'signup') AS s,
   count(*) FILTER (event_type <> 'error') AS m FROM fingerprints GROUP BY 1, 2),
cur AS (SELECT * FROM day WHERE d = 19735), base AS (SELECT manufacturer, avg(n) AS n, avg(s) AS s FROM day WHERE d < 19735 GROUP BY 1),
alerts AS (
 SELECT manufacturer, 'ingest_rate_drop' AS type, c.n::DOUBLE AS current, b.n AS baseline, (b.n - c.n) / b.n * 100 AS measure, 'critical' AS severity FROM cur c JOIN base b USING (manufacturer) WHERE (b.n - c.n) / b.n * 100 > 5
 UNION ALL SELECT manufacturer, 'low_match_rate', m * 100.0::DOUBLE / n, 82.0, m * 100.0::DOUBLE / n, 'warning' FROM (SELECT manufacturer, count(*) AS n, count(*) FILTER (event_type <> 'error') AS m FROM fingerprints GROUP BY 1) WHERE m * 100.0::DOUBLE / n < 82
 UNION ALL SELECT manufacturer, 'optout_spike', c.s::DOUBLE, b.s, CASE WHEN b.s > 0 THEN c.s / b.s ELSE 1.0 END, 'high' FROM cur c JOIN base b USING (manufacturer) WHERE CASE WHEN b.s > 0 THEN c.s / b.s ELSE 1.0 END > 1.2)"""


def alerts(spark, sf):
    f = d.fingerprints(spark, sf).withColumn("day", F.floor(F.col("timestamp_utc") / 86400))
    daily = f.groupBy("manufacturer", "day").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("event_type") == "signup").alias("s")
    )
    today, before = daily.filter(F.col("day") == 19735), daily.filter(F.col("day") < 19735)

    def pair(c):
        return (
            today.select("manufacturer", F.col(c).alias("current")),
            before.groupBy("manufacturer").agg(F.avg(c).alias("baseline")),
        )

    rates_ = al.match_rates(f, F.col("event_type") != "error")
    return al.consolidate(
        al.ingest_rate_alerts(*pair("n"), 5.0), al.match_rate_alerts(rates_, 82.0),
        al.optout_alerts(*pair("s"), 1.2),
    )


@query("alerts_consolidated", _ALERTS + """
SELECT manufacturer, type, round(current, 4) AS current, round(baseline, 4) AS baseline, round(measure, 4) AS measure, severity FROM alerts""")
def alerts_consolidated(spark, sf):
    return _round(alerts(spark, sf), "current", "baseline", "measure")


@query("alert_counts", _ALERTS + """, kinds AS (SELECT unnest(['ingest_rate_drop', 'low_match_rate', 'optout_spike']) AS type)
SELECT k.type, count(a.type) AS alerts FROM kinds k LEFT JOIN alerts a USING (type) GROUP BY 1 UNION ALL SELECT 'total', count(*) FROM alerts""")
def alert_counts(spark, sf):
    return al.alert_counts(alerts(spark, sf))


@query("operational_checks", d.views("privacy_requests", "consent_events") + f""", c AS (
SELECT 'consent_stale' AS "check", {NOW_SECONDS} - max(consent_time) AS value, {NOW_SECONDS} - max(consent_time) > 3600 AS alert FROM consent_events
UNION ALL SELECT 'queue_depth', count(*) FILTER (status <> 'completed'), count(*) FILTER (status <> 'completed') > 10000 FROM privacy_requests
UNION ALL SELECT 'deletion_age', {NOW_SECONDS} - epoch_us(min(requested_at) FILTER (status <> 'completed' AND request_type = 'erasure')) // 1000000,
  {NOW_SECONDS} - epoch_us(min(requested_at) FILTER (status <> 'completed' AND request_type = 'erasure')) // 1000000 > 82800 FROM privacy_requests
UNION ALL SELECT 'consumer_lag', CAST(sum(ends - coalesce(seen, 0)) AS BIGINT), sum(ends - coalesce(seen, 0)) > 1000 FROM (
  SELECT user_id % 8 AS p, count(*) AS ends, nullif(count(*) FILTER (event_type <> 'error' AND user_id % 8 <> 3), 0) AS seen FROM events GROUP BY 1))
SELECT * FROM c""")
def operational_checks(spark, sf):
    requests, now = d.privacy_requests(spark, sf), F.lit(NOW_SECONDS)
    consent = al.freshness(
        d.consent_events(spark, sf), "consent_time", now, al.CONSENT_AGE_SECONDS, "consent_stale"
    )
    # Errors stand for messages not read yet; partition 3 was never read.
    part = F.struct(F.lit("raw.fingerprints").alias("topic"), (F.col("user_id") % 8).alias("partition"))
    events = d.table(spark, sf, "events").select(part.alias("p"), "event_type").select("p.*", "event_type")
    ends = events.groupBy("topic", "partition").agg(F.count(F.lit(1)).alias("offset"))
    read = events.filter("event_type <> 'error' AND partition <> 3").groupBy("topic", "partition").agg(
        F.count(F.lit(1)).alias("offset"))
    return al.consolidate(
        consent, al.backlog(requests), al.deletion_delay(requests, now), al.consumer_lag(read, ends, 1000))


@query("data_quality_completeness", d.views("raw_fingerprints") + """, t AS (SELECT count(*) AS rows, count(CASE WHEN length(device_id) = 64 THEN 1 END) AS a,
  count(CASE WHEN length(fingerprint_hash) = 64 THEN 1 END) AS b FROM raw_fingerprints)
SELECT rows, 'device_id' AS "column", a AS present, round(a / rows::DOUBLE, 6) AS share, a / rows::DOUBLE >= 0.977 AS passed FROM t
UNION ALL SELECT rows, 'fingerprint_hash', b, round(b / rows::DOUBLE, 6), b / rows::DOUBLE >= 0.977 FROM t""")
def data_quality_completeness(spark, sf):
    raw = d.raw_fingerprints(spark, sf)
    valid = raw.select(
        *[F.when(F.length(c) == 64, F.col(c)).alias(c) for c in ("device_id", "fingerprint_hash")]
    )
    return _round(ql.completeness(valid, ["device_id", "fingerprint_hash"], 0.977), "share", digits=6)


@query("data_quality_volume", d.views("viewership") + """, t AS (SELECT watch_date, count(*) AS rows FROM viewership GROUP BY 1),
e AS (SELECT *, avg(rows) OVER (ORDER BY watch_date ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING) AS expected FROM t)
SELECT watch_date, rows, round(expected, 4) AS expected, NOT coalesce(rows < expected * 0.95, false) AS passed FROM e""")
def data_quality_volume(spark, sf):
    out = ql.volume_drops(d.viewership(spark, sf), "watch_date", 7, 0.05)
    return _round(out, "expected")


@query("data_quality_match_rate", d.views("fingerprints") + """, t AS (SELECT timestamp_utc // 86400 AS day, count(*) FILTER (event_type <> 'error') * 100.0::DOUBLE / count(*) AS rate FROM fingerprints GROUP BY 1),
e AS (SELECT *, avg(rate) OVER (ORDER BY day ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING) AS expected FROM t)
SELECT day, round(rate, 4) AS rate, round(expected, 4) AS expected, NOT coalesce(abs(rate - expected) > expected * 0.02, false) AS passed FROM e""")
def data_quality_match_rate(spark, sf):
    f = d.fingerprints(spark, sf)
    daily = f.groupBy(F.floor(F.col("timestamp_utc") / 86400).alias("day")).agg(
        (F.count_if(F.col("event_type") != "error") * 100.0 / F.count(F.lit(1))).alias("rate")
    )
    return _round(ql.rate_anomalies(daily, "day", "rate", 7, 0.02), "rate", "expected")


@query("cleanup_range_checks", d.views("viewership") + """, t AS (SELECT count(*) FILTER (watch_date < '2024-01-15') AS deleted, count(DISTINCT household_id) AS archived FROM viewership)
SELECT 'deleted' AS "check", deleted AS value, 10000 AS low, 100000 AS high, deleted BETWEEN 10000 AND 100000 AS passed FROM t
UNION ALL SELECT 'archived', archived, 100, 50000, archived BETWEEN 100 AND 50000 FROM t""")
def cleanup_range_checks(spark, sf):
    counts = d.viewership(spark, sf).agg(
        F.count_if(F.col("watch_date") < "2024-01-15").alias("deleted"),
        F.count_distinct("household_id").alias("archived"),
    )
    out = ql.in_range(counts, {"deleted": ql.DELETED_RANGE, "archived": ql.ARCHIVED_RANGE})
    return out.withColumns({c: F.col(c).cast("int") for c in ("low", "high")})


_BOUNDS = ("5", "20", "60", "150", "+Inf")
_COUNTERS = d.views("api_usage") + """, slots AS (SELECT endpoint, (at_ms // 1000) // 1800 * 1800 + 1800 AS ts, response_ms FROM api_usage),
counts AS (""" + " UNION ALL ".join(
    f"SELECT endpoint, '{b}' AS le, ts, count(*) FILTER ({'true' if b == '+Inf' else f'response_ms <= {b}'}) AS n FROM slots GROUP BY ALL"
    for b in _BOUNDS) + """),
samples AS (SELECT endpoint, le, ts, CAST(sum(n) OVER (PARTITION BY endpoint, le, ts // 200000 ORDER BY ts) AS DOUBLE) AS value FROM counts),
lagged AS (SELECT *, lag(ts) OVER w AS before_at, lag(value) OVER w AS before, (ts + 10799) // 10800 * 10800 AS t FROM samples
  WINDOW w AS (PARTITION BY endpoint, le ORDER BY ts)),
spread AS (SELECT *, t + 10800 * h AS tick FROM lagged, range(2) r(h) WHERE t + 10800 * h < ts + 21600),
seen AS (SELECT endpoint, le, tick, count(*) AS n, min(ts) AS t0, max(ts) AS t1, arg_min(value, ts) AS v0, arg_max(value, ts) AS v1,
    sum(CASE WHEN before_at > tick - 21600 AND value < before THEN before ELSE 0 END) AS lost
  FROM spread GROUP BY ALL HAVING count(*) > 1),
grown AS (SELECT *, v1 - v0 + lost AS g, CAST(t1 - t0 AS DOUBLE) AS span, CAST(t1 - t0 AS DOUBLE) / (n - 1) AS mean,
    CAST(t0 - (tick - 21600) AS DOUBLE) AS ahead, CAST(tick - t1 AS DOUBLE) AS behind FROM seen),
ends AS (SELECT *, CASE WHEN ahead >= mean * 1.1::DOUBLE THEN mean / 2 ELSE ahead END AS s, CASE WHEN behind >= mean * 1.1::DOUBLE THEN mean / 2 ELSE behind END AS e FROM grown),
rates AS (SELECT endpoint, le, tick, g * ((span + CASE WHEN g > 0 THEN least(s, span * (v0 / g)) ELSE s END + e) / span) / 21600.0::DOUBLE AS per_second FROM ends)"""


def counter_samples(spark, sf):
    """Latency counters per endpoint and upper bound, read each half hour with calls, that start again
    every 200,000 seconds."""
    usage = d.api_usage(spark, sf)
    second = F.floor(F.col("at_ms") / 1000)
    slots = usage.select("endpoint", (F.floor(second / 1800) * 1800 + 1800).alias("at"), "response_ms")
    counts = slots.groupBy("endpoint", "at").agg(*[
        (F.count(F.lit(1)) if b == "+Inf" else F.count_if(F.col("response_ms") <= int(b))).alias(b) for b in _BOUNDS])
    tall = counts.unpivot(["endpoint", "at"], list(_BOUNDS), "le", "n")
    line = Window.partitionBy("endpoint", "le", F.floor(F.col("at") / 200000)).orderBy("at")
    return tall.select("endpoint", "le", "at", F.sum("n").over(line).cast("double").alias("value"))


@query("counter_rates", _COUNTERS + """
SELECT endpoint, le, tick AS "at", round(per_second * 21600, 6) AS increase, round(per_second, 9) AS per_second FROM rates""")
def counter_rates(spark, sf):
    out = al.counter_rates(counter_samples(spark, sf), ("endpoint", "le"), "at", "value", 21600, 10800)
    return _round(_round(out, "increase", digits=6), "per_second", digits=9)


@query("bucket_quantiles", _COUNTERS + """, tops AS (SELECT endpoint, tick, max(per_second) AS total FROM rates GROUP BY ALL HAVING bool_or(le = '+Inf') AND count(*) > 1 AND max(per_second) > 0),
ordered AS (SELECT *, max(per_second) OVER (PARTITION BY endpoint, tick ORDER BY b) AS v FROM (
  SELECT *, CASE le WHEN '+Inf' THEN 'infinity'::DOUBLE ELSE TRY_CAST(le AS DOUBLE) END AS b FROM rates)),
steps AS (SELECT *, lag(v, 1, 0) OVER w AS under, lag(b, 1, 0) OVER w AS low FROM ordered WINDOW w AS (PARTITION BY endpoint, tick ORDER BY b)),
asked AS (SELECT endpoint, tick, total, q, total * q AS rank FROM tops, (VALUES (0.5::DOUBLE), (0.95::DOUBLE), (0.99::DOUBLE)) x(q)),
hit AS (SELECT a.*, s.b, s.v, s.low, s.under FROM asked a JOIN steps s USING (endpoint, tick) WHERE s.v >= a.rank
  QUALIFY row_number() OVER (PARTITION BY endpoint, tick, q ORDER BY b) = 1)
SELECT endpoint, tick AS "at", q AS quantile, round(CASE WHEN isinf(b) THEN low ELSE low + (b - low) * (rank - under) / (v - under) END, 6) AS estimate FROM hit""")
def bucket_quantiles(spark, sf):
    """Latency quantiles of the last six hours, every three hours, from restarting counters alone."""
    rated = al.counter_rates(counter_samples(spark, sf), ("endpoint", "le"), "at", "value", 21600, 10800)
    out = al.bucket_quantiles(rated, ("endpoint", "at"), (0.5, 0.95, 0.99), "le", "per_second")
    return _round(out.filter("estimate IS NOT NULL"), "estimate", digits=6)
