"""Queries over ingest checks and sessions."""

from __future__ import annotations

from pyspark.sql import functions as F

from airtally.functions import identity, times
from airtally.operators import enrich as en
from airtally.operators import ingest as ing
from airtally.operators import sessions as ses
from airtally.plans import domain as d
from airtally.plans.registry import query

_REASON = """CASE WHEN NOT regexp_full_match(device_id, '[a-fA-F0-9]{64}') THEN 'invalid_device_id'
       WHEN NOT regexp_full_match(fingerprint_hash, '[a-fA-F0-9]{64}') THEN 'invalid_fingerprint_hash'
       WHEN NOT (ingested_at - timestamp_utc BETWEEN 0 AND 300) THEN 'timestamp_out_of_range'"""
_ASN = d.views("raw_fingerprints", "asn_ranges") + """, numbered AS (
  SELECT *, CAST(split_part(ip_address, '.', 1) AS BIGINT) * 16777216 + CAST(split_part(ip_address, '.', 2) AS BIGINT) * 65536
          + CAST(split_part(ip_address, '.', 3) AS BIGINT) * 256 + CAST(split_part(ip_address, '.', 4) AS BIGINT) AS ip FROM raw_fingerprints),
located AS (SELECT n.*, a.asn FROM numbered n LEFT JOIN asn_ranges a ON n.ip BETWEEN a.lo AND a.hi),
checked AS (SELECT *, """ + _REASON + """ WHEN asn IN (16509, 24940) THEN 'datacenter_network' END AS reject_reason FROM located)"""


def checked(spark, sf):
    return ing.validate(
        d.raw_fingerprints(spark, sf), "ingested_at", d.asn_ranges(spark, sf)
    )


def requests(spark, sf):
    """Events in upload requests of 60 or 120 events."""
    block = F.floor(F.col("event_id") / 120)
    name = F.when(block % 2 == 0, F.concat(F.lit("L"), block.cast("string"))).otherwise(
        F.concat(F.lit("S"), F.floor(F.col("event_id") / 60).cast("string"))
    )
    event = F.struct("event_id", "device_id", "fingerprint_hash", "timestamp_utc", "manufacturer")
    return (
        d.fingerprints(spark, sf).groupBy(name.alias("request_id"))
        .agg(F.collect_list(event).alias("batch"))
    )


_REQUESTS = d.views("fingerprints") + """, named AS (
  SELECT *, CASE WHEN (event_id // 120) % 2 = 0 THEN 'L' || (event_id // 120) ELSE 'S' || (event_id // 60) END AS request_id FROM fingerprints),
sizes AS (SELECT request_id, count(*) AS n FROM named GROUP BY 1)"""


@query("ingest_batch_gate", _REQUESTS + """
SELECT request_id, n AS events, n BETWEEN 1 AND 100 AS accepted FROM sizes""")
def ingest_batch_gate(spark, sf):
    return requests(spark, sf).select(
        "request_id", F.size("batch").cast("bigint").alias("events"),
        ing.batch_size_ok("batch").alias("accepted"),
    )


@query("ingest_flatten", _REQUESTS + """
SELECT request_id, event_id, device_id, fingerprint_hash, timestamp_utc, manufacturer
FROM named JOIN sizes USING (request_id) WHERE n <= 100""")
def ingest_flatten(spark, sf):
    return ing.flatten_batches(ing.accepted_batches(requests(spark, sf)))


@query("ingest_checked", _ASN + " SELECT event_id, asn, reject_reason FROM checked")
def ingest_checked(spark, sf):
    raw = ing.with_asn(d.raw_fingerprints(spark, sf), d.asn_ranges(spark, sf))
    return raw.select(
        "event_id", "asn", ing.reject_reason("ingested_at", asn="asn").alias("reject_reason")
    )


@query("ingest_reject_reasons", _ASN + """
SELECT reject_reason, count(*) AS events FROM checked WHERE reject_reason IS NOT NULL GROUP BY 1""")
def ingest_reject_reasons(spark, sf):
    return ing.rejections(checked(spark, sf))


@query("ingest_totals", _ASN + """
SELECT count(*) FILTER (reject_reason IS NULL) AS processed, count(*) FILTER (reject_reason IS NOT NULL) AS rejected FROM checked""")
def ingest_totals(spark, sf):
    return ing.ingest_totals(checked(spark, sf))


@query("ingest_accept_by_manufacturer", _ASN + """
SELECT manufacturer, count(*) FILTER (reject_reason IS NULL) AS processed, count(*) FILTER (reject_reason IS NOT NULL) AS rejected
FROM checked GROUP BY 1""")
def ingest_accept_by_manufacturer(spark, sf):
    return ing.ingest_totals(checked(spark, sf), ("manufacturer",))


@query("geo_asn_filter", _ASN + """
SELECT event_id, ip_address FROM located WHERE asn IS NULL OR asn NOT IN (16509, 24940)""")
def geo_asn_filter(spark, sf):
    kept = ing.drop_datacenters(d.raw_fingerprints(spark, sf), d.asn_ranges(spark, sf))
    return kept.select("event_id", "ip_address")


@query("geo_asn_shuffled", _ASN + "SELECT event_id, asn FROM located")
def geo_asn_shuffled(spark, sf):
    """The way taken when the range table is too large to broadcast."""
    out = ing.with_asn(
        d.raw_fingerprints(spark, sf), d.asn_ranges(spark, sf), broadcast_ranges=0
    )
    return out.select("event_id", "asn")


_TWO_FAMILIES = d.views("fingerprints") + """, networks AS (SELECT s_suppkey AS n FROM supplier),
p24 AS (SELECT n % 3 AS a, n % 16 AS b, min(100000 + n) AS asn FROM networks WHERE n % 2 = 0 GROUP BY ALL),
p16 AS (SELECT n % 3 AS a, min(CASE n % 5 WHEN 1 THEN 16509 ELSE 200000 + n END) AS asn FROM networks WHERE n % 2 = 1 GROUP BY ALL),
p48 AS (SELECT n % 64 AS a, min(CASE n % 5 WHEN 0 THEN 24940 ELSE 300000 + n END) AS asn FROM networks WHERE n % 2 = 0 GROUP BY ALL),
p60 AS (SELECT n % 64 AS a, n % 16 AS b, min(400000 + n) AS asn FROM networks WHERE n % 3 = 0 GROUP BY ALL),
located AS (SELECT event_id, CASE WHEN event_id % 50 = 0 THEN NULL
    WHEN event_id % 3 = 1 THEN CASE WHEN event_id % 7 = 0 THEN 8075 ELSE coalesce(x.asn, y.asn, 64513) END
    ELSE coalesce(v.asn, w.asn, 64512) END AS asn
  FROM fingerprints f LEFT JOIN p24 v ON v.a = (user_id // 64) % 256 AND v.b = (user_id % 64) // 4
  LEFT JOIN p16 w ON w.a = (user_id // 64) % 256
  LEFT JOIN p48 y ON y.a = user_id % 64 LEFT JOIN p60 x ON x.a = user_id % 64 AND x.b = k % 16)
"""


def two_families(spark, sf):
    """Fingerprints with addresses of both families in several spellings, and some that are none."""
    f = d.fingerprints(spark, sf)
    a, b = F.lower(F.hex(F.col("user_id") % 64)), F.hex(F.col("k").cast("bigint") % 16)
    end = F.when(F.col("event_id") % 7 == 0, F.lit("::dead:beef")).otherwise(
        F.concat(F.lit("0::"), F.hex(F.col("event_id") % 65536)))
    six = F.concat(F.lit("2001:0DB8:"), a, F.lit(":"), b, end)
    mapped = F.concat(F.lit("::ffff:"), F.col("ip_address"))
    odd = F.when(F.col("event_id") % 100 == 0, F.lit("2001:db8::1::2")).otherwise(F.lit("10.0.0.256"))
    kind = F.col("event_id") % 3
    return f.withColumn("ip_address", F.when(F.col("event_id") % 50 == 0, odd).when(kind == 1, six).when(
        kind == 2, mapped).otherwise(F.col("ip_address")))


def network_table(spark, sf):
    """Nested networks of both families: /8, /16 and /24; /32, /48, /60 and single addresses."""
    n = F.col("s_suppkey")
    s = d.table(spark, sf, "supplier")
    hexed = F.lower(F.hex(n % 64))
    parts = [
        (F.lit(True), F.lit("10.0.0.0/8"), F.lit(64512)),
        (F.lit(True), F.lit("2001:db8::/32"), F.lit(64513)),
        (n % 2 == 0, F.concat(F.lit("10."), n % 3, F.lit("."), n % 16, F.lit(".77/24")), 100000 + n),
        (n % 2 == 1, F.concat(F.lit("::ffff:10."), n % 3, F.lit(".0.0/112")), F.when(n % 5 == 1, 16509).otherwise(200000 + n)),
        (n % 2 == 0, F.concat(F.lit("2001:db8:"), hexed, F.lit("::/48")), F.when(n % 5 == 0, 24940).otherwise(300000 + n)),
        (n % 3 == 0, F.concat(F.lit("2001:db8:"), hexed, F.lit(":"), F.hex(n % 16), F.lit("0::/60")), 400000 + n),
        (n % 7 == 0, F.lit("nonsense/12"), n), (n % 7 == 1, F.lit("10.0.0.0/33"), n),
    ]
    out = [s.filter(on).select(p.alias("prefix"), asn.cast("bigint").alias("asn")) for on, p, asn in parts]
    dead = d.fingerprints(spark, sf).filter("event_id % 7 = 0").select(
        F.concat(F.lit("2001:db8:"), F.lower(F.hex(F.col("user_id") % 64)), F.lit(":"),
                 F.hex(F.col("k").cast("bigint") % 16), F.lit("::dead:beef")).alias("prefix"), F.lit(8075).cast("bigint").alias("asn"))
    table = out[0].limit(1).unionByName(out[1].limit(1))
    for more in (*out[2:], dead):
        table = table.unionByName(more)
    return table


@query("geo_prefix_asn", _TWO_FAMILIES + "SELECT event_id, asn FROM located")
def geo_prefix_asn(spark, sf):
    return ing.with_prefix_asn(two_families(spark, sf), network_table(spark, sf)).select("event_id", "asn")


@query("geo_prefix_shuffled", _TWO_FAMILIES + "SELECT event_id, asn FROM located")
def geo_prefix_shuffled(spark, sf):
    """The way taken when the table of networks is too large to broadcast."""
    out = ing.with_prefix_asn(two_families(spark, sf), network_table(spark, sf), broadcast_ranges=0)
    return out.select("event_id", "asn")


@query("geo_prefix_filter", _TWO_FAMILIES + """
SELECT event_id, coalesce(CASE WHEN asn IN (16509, 24940, 8075) THEN 'datacenter_network' END, 'accepted') AS outcome FROM located""")
def geo_prefix_filter(spark, sf):
    """The checks of the ingest with networks of both families."""
    checked = ing.validate(two_families(spark, sf), "timestamp_utc", prefixes=network_table(spark, sf))
    return checked.select("event_id", F.coalesce("reject_reason", F.lit("accepted")).alias("outcome"))


_LATEST = d.views("consent_events", "fingerprints") + """, latest AS (SELECT * FROM consent_events
  QUALIFY row_number() OVER (PARTITION BY device_id ORDER BY consent_time DESC, event_id DESC) = 1)"""


def consents(spark, sf):
    return ing.latest_consents(d.consent_events(spark, sf), ("consent_time", "event_id"))


@query("latest_consent", _LATEST + " SELECT device_id, opted_in, consent_time, jurisdiction, event_id FROM latest")
def latest_consent(spark, sf):
    return consents(spark, sf).select(
        "device_id", "opted_in", "consent_time", "jurisdiction", "event_id"
    )


@query("consent_opt_out_filter", _LATEST + """
SELECT event_id, device_id FROM fingerprints WHERE device_id NOT IN (SELECT device_id FROM latest WHERE NOT opted_in)""")
def consent_opt_out_filter(spark, sf):
    kept = ing.consent_filter(d.fingerprints(spark, sf), consents(spark, sf), "opt_out")
    return kept.select("event_id", "device_id")


@query("consent_opt_in_filter", _LATEST + """
SELECT event_id, device_id FROM fingerprints WHERE device_id IN (SELECT device_id FROM latest WHERE opted_in)""")
def consent_opt_in_filter(spark, sf):
    kept = ing.consent_filter(d.fingerprints(spark, sf), consents(spark, sf), "opt_in")
    return kept.select("event_id", "device_id")


@query("consent_jurisdiction_filter", _LATEST + """, located AS (SELECT event_id, device_id,
  (['US', 'EU', 'CA'])[CAST(user_id % 3 AS INT) + 1] AS jurisdiction FROM fingerprints),
answered AS (SELECT * FROM latest WHERE (consent_time // 3600) % 24 >= 12)
SELECT l.event_id, l.jurisdiction FROM located l LEFT JOIN answered s USING (device_id)
WHERE CASE WHEN l.jurisdiction IN ('EU', 'CA') THEN coalesce(s.opted_in, false) ELSE coalesce(s.opted_in, true) END""")
def consent_jurisdiction_filter(spark, sf):
    """Some devices never answered: they count in the US and not elsewhere."""
    events = d.fingerprints(spark, sf).withColumn(
        "jurisdiction", d._pick(d.JURISDICTION_ORDER, F.col("user_id") % 3)
    )
    answered = consents(spark, sf).filter(times.utc_hour("consent_time") >= 12)
    kept = ing.consent_filter(events, answered, "jurisdiction")
    return kept.select("event_id", "jurisdiction")


@query("consent_default_place_filter", _LATEST + """, answered AS (SELECT device_id, opted_in FROM latest WHERE (consent_time // 3600) % 24 >= 12)
SELECT f.event_id FROM fingerprints f LEFT JOIN answered s USING (device_id) WHERE coalesce(s.opted_in, false)""")
def consent_default_place_filter(spark, sf):
    """Events that name no place, taken to be from the EU: no record means no consent."""
    answered = consents(spark, sf).filter(times.utc_hour("consent_time") >= 12).select("device_id", "opted_in")
    kept = ing.consent_filter(d.fingerprints(spark, sf), answered, "jurisdiction", "EU")
    return kept.select("event_id")


_REPEATED = d.views("fingerprints") + """, e AS (
  SELECT event_id, manufacturer AS device_id, 'h' || (k % 5) AS fingerprint_hash, timestamp_utc FROM fingerprints)"""


def repeated_events(spark, sf):
    """Few senders and few hashes, so that repeats do occur."""
    return d.fingerprints(spark, sf).select(
        "event_id",
        F.col("manufacturer").alias("device_id"),
        F.concat(F.lit("h"), F.col("k") % 5).alias("fingerprint_hash"),
        "timestamp_utc",
    )


def _dedup_sql(seconds):
    return _REPEATED + f""", firsts AS (SELECT device_id, fingerprint_hash, timestamp_utc, min(event_id) AS event_id FROM e GROUP BY ALL),
gaps AS (SELECT *, timestamp_utc - lag(timestamp_utc) OVER (PARTITION BY device_id, fingerprint_hash ORDER BY timestamp_utc) AS gap FROM firsts)
SELECT event_id, device_id, fingerprint_hash, timestamp_utc FROM gaps WHERE gap IS NULL OR gap > {seconds}"""


@query("dedup_60s", _dedup_sql(60))
def dedup_60s(spark, sf):
    return ing.drop_repeats(repeated_events(spark, sf))


@query("dedup_6h", _dedup_sql(21600))
def dedup_6h(spark, sf):
    return ing.drop_repeats(repeated_events(spark, sf), 21600)


@query("overlimit_sliding", d.views("api_usage") + """, counts AS (
  SELECT endpoint, at_ms, count(*) AS n FROM api_usage GROUP BY ALL),
w AS (SELECT endpoint, at_ms, CAST(sum(n) OVER (PARTITION BY endpoint ORDER BY at_ms RANGE BETWEEN 599999 PRECEDING AND CURRENT ROW) AS BIGINT) AS in_window FROM counts)
SELECT * FROM w WHERE in_window > 2""")
def overlimit_sliding(spark, sf):
    return ing.over_limit(d.api_usage(spark, sf), "endpoint", "at_ms", limit=2, window_ms=600_000)


@query("overlimit_fixed", d.views("api_usage") + """
SELECT endpoint, at_ms - at_ms % 3600000 AS window_start_ms, count(*) AS in_window FROM api_usage GROUP BY 1, 2 HAVING count(*) > 3""")
def overlimit_fixed(spark, sf):
    return ing.over_limit_fixed(d.api_usage(spark, sf), "endpoint", "at_ms", limit=3, seconds=3600)


def _gap_sql(source, key, gap, content=None):
    part = f"PARTITION BY {key} ORDER BY t{', ' + content if content else ''}"
    change = f" OR {content} IS DISTINCT FROM lag({content}) OVER ({part})" if content else ""
    cols = f"{key}, {content}" if content else key
    return f""", s AS (SELECT {cols}, t, count(*) AS n FROM ({source}) GROUP BY ALL),
flagged AS (SELECT *, CASE WHEN lag(t) OVER ({part}) IS NULL OR t - lag(t) OVER ({part}) > {gap}{change} THEN 1 ELSE 0 END AS starts FROM s),
numbered AS (SELECT *, sum(starts) OVER ({part} ROWS UNBOUNDED PRECEDING) AS sid FROM flagged)
SELECT {cols}, min(t) AS session_start, max(t) AS session_end, CAST(sum(n) AS BIGINT) AS events, max(t) - min(t) AS duration_sec
FROM numbered GROUP BY {cols}, sid HAVING max(t) - min(t) >= 1"""


@query("sessions_gap300", d.views("fingerprints") + _gap_sql(
    "SELECT manufacturer, timestamp_utc AS t FROM fingerprints", "manufacturer", 300))
def sessions_gap300(spark, sf):
    return ses.gap_sessions(d.fingerprints(spark, sf), ["manufacturer"])


@query("sessions_by_device_6h", d.views("fingerprints") + _gap_sql(
    "SELECT device_id, timestamp_utc AS t FROM fingerprints", "device_id", 21600))
def sessions_by_device_6h(spark, sf):
    return ses.gap_sessions(d.fingerprints(spark, sf), gap=21600, bucket_seconds=86400)


@query("sessions_by_content", d.views("viewership") + _gap_sql(
    "SELECT manufacturer, genre AS content_id, watch_start_utc AS t FROM viewership", "manufacturer", 7200, "content_id"))
def sessions_by_content(spark, sf):
    v = d.viewership(spark, sf).withColumn("content_id", F.col("genre"))
    return ses.content_sessions(v, ["manufacturer"], gap=7200)


@query("sessions_last_match", d.views("fingerprints") + """, ordered AS (SELECT manufacturer, timestamp_utc AS t, event_id,
    CASE WHEN event_type = 'error' THEN NULL ELSE 'c-' || k END AS content_id FROM fingerprints),
flagged AS (SELECT *, CASE WHEN t - lag(t) OVER w <= 1800 THEN 0 ELSE 1 END AS starts FROM ordered
  WINDOW w AS (PARTITION BY manufacturer ORDER BY t, event_id)),
numbered AS (SELECT *, sum(starts) OVER (PARTITION BY manufacturer ORDER BY t, event_id ROWS UNBOUNDED PRECEDING) AS sid FROM flagged),
runs AS (SELECT manufacturer, sid, max(t) AS session_end, max(struct_pack(t := t, e := event_id, c := content_id)) FILTER (content_id IS NOT NULL) AS m
  FROM numbered GROUP BY 1, 2)
SELECT manufacturer, m.c AS content_id, m.t AS session_start, session_end, session_end - m.t AS duration_sec
FROM runs WHERE m IS NOT NULL AND session_end - m.t >= 1""")
def sessions_last_match(spark, sf):
    f = d.fingerprints(spark, sf).withColumn(
        "content_id",
        F.when(F.col("event_type") != "error", F.concat(F.lit("c-"), F.col("k").cast("string"))),
    )
    return ses.last_match_sessions(f, ["manufacturer"], gap=1800)


@query("household_ids", d.views("viewership") + """
SELECT device_id, ip_address, household_id, 'hh_' || substr(sha256(regexp_extract(ip_address, '^([0-9]+[.][0-9]+[.][0-9]+)[.]', 1)), 1, 16) AS subnet_household,
       regexp_extract(ip_address, '^([0-9]+[.][0-9]+[.][0-9]+)[.]', 1) || '.0' AS network,
       count(*) AS events FROM viewership GROUP BY ALL""")
def household_ids(spark, sf):
    v = d.viewership(spark, sf)
    return (
        v.select(
            "device_id", "ip_address", "household_id",
            identity.household_id_subnet("ip_address").alias("subnet_household"),
            identity.subnet_network("ip_address").alias("network"),
        )
        .groupBy("device_id", "ip_address", "household_id", "subnet_household", "network")
        .agg(F.count(F.lit(1)).alias("events"))
    )


@query("device_identities", d.views("fingerprints") + """
SELECT event_id, sha256(device_id || ':tv-' || strftime(make_timestamp(timestamp_utc * 1000000), '%Y-%m')) AS monthly_id,
       sha256(device_id || '|' || manufacturer || '|' || model || '|salt') AS stable_id, sha256(device_id) AS pseudonym,
       ((timestamp_utc + 30) // 60) * 60 AS nearest_minute, (timestamp_utc // 60) * 60 AS minute_floor FROM fingerprints""")
def device_identities(spark, sf):
    return d.fingerprints(spark, sf).select(
        "event_id",
        identity.monthly_device_id("device_id", F.timestamp_seconds("timestamp_utc"), "tv").alias("monthly_id"),
        identity.stable_device_id("device_id", "manufacturer", "model", F.lit("salt")).alias("stable_id"),
        identity.pseudonym("device_id").alias("pseudonym"),
        times.nearest_minute("timestamp_utc").alias("nearest_minute"),
        times.minute_floor("timestamp_utc").alias("minute_floor"),
    )


@query("enriched_viewership", d.views("viewership") + """
SELECT device_id, household_id, content_id, watch_date, watch_hour, CAST(duration_minutes AS INT) AS duration_minutes,
       dma_code, '00000' AS zip_code, watch_start_utc FROM viewership""")
def enriched_viewership(spark, sf):
    """Matched events joined to an area per device."""
    v = d.viewership(spark, sf)
    events = v.select(
        "device_id", "content_id", "title", "network", "genre", "match_confidence",
        "watch_start_utc", "duration_sec", "manufacturer", "model", "ip_address",
    )
    c = d.table(spark, sf, "customer")
    profiles = c.select(
        F.sha2(F.concat(F.lit("device-"), F.col("c_custkey")), 256).alias("device_id"),
        (F.col("c_nationkey") + 100).cast("string").alias("dma_code"),
        F.lit(None).cast("string").alias("zip_code"),
    )
    return en.enrich(events, profiles).select(
        "device_id", "household_id", "content_id", "watch_date", "watch_hour",
        "duration_minutes", "dma_code", "zip_code", "watch_start_utc",
    )
