"""Queries over consent, privacy requests, retention, files and audio."""

from __future__ import annotations

from pyspark.sql import functions as F

from airtally.functions import codec
from airtally.functions import consent as cs
from airtally.operators import audio, enrich, ingest, lifecycle, privacy, segments
from airtally.operators import household as hh
from airtally.plans import domain as d
from airtally.plans import queries_reports as qr
from airtally.plans import queries_segments as qs
from airtally.plans.registry import query
from airtally.session import scratch_path
from airtally.sources import files, folders, lake

NOW = "2001-08-01 00:00:00"

# Every tenth string is cut so that it does not decode, another tenth so that it is
# too short.
_TCF = d.views("consent_events") + """, t AS (SELECT event_id, device_id, opted_in, consent_time, jurisdiction,
  CASE event_id % 10 WHEN 0 THEN substr(tcf_string, 1, 21) WHEN 1 THEN substr(tcf_string, 1, 20) ELSE tcf_string END AS tcf_string FROM consent_events),
b AS (SELECT *, CASE WHEN event_id % 10 <> 0 THEN from_base64(tcf_string) END AS data FROM t)"""
_NAMES = "[" + ", ".join(f"'{p}'" for p in cs.PURPOSES) + "]"


def tcf_events(spark, sf):
    c = d.consent_events(spark, sf)
    kind = F.col("event_id") % 10
    return c.withColumn(
        "tcf_string",
        F.when(kind == 0, F.substring("tcf_string", 1, 21))
        .when(kind == 1, F.substring("tcf_string", 1, 20))
        .otherwise(F.col("tcf_string")),
    )


@query("tcf_purposes", _TCF + f"""
SELECT event_id, CASE WHEN data IS NOT NULL THEN array_to_string(list_filter(list_transform(range(14), lambda i:
    CASE WHEN octet_length(data) > 12 + i // 8 AND get_bit(data::BIT, CAST(96 + i AS INT)) = 1 THEN ({_NAMES})[i + 1] END), lambda x: x IS NOT NULL), ',') END AS purposes,
  coalesce(octet_length(data) >= 20, false) AS valid FROM b""")
def tcf_purposes(spark, sf):
    purposes = cs.consent_purposes("data")
    decoded = tcf_events(spark, sf).withColumn("data", cs.decode_consent("tcf_string"))
    return decoded.select(
        "event_id",
        F.when(purposes.isNotNull(), F.concat_ws(",", purposes)).alias("purposes"),
        cs.is_valid_consent("tcf_string").alias("valid"),
    )


@query("tcf_purpose_checks", _TCF + f""", p AS (SELECT event_id, list_filter(list_transform(range(14), lambda i:
    CASE WHEN octet_length(data) > 12 + i // 8 AND get_bit(data::BIT, CAST(96 + i AS INT)) = 1 THEN ({_NAMES})[i + 1] END), lambda x: x IS NOT NULL) AS purposes, data FROM b)
SELECT event_id, data IS NOT NULL AND coalesce(list_contains(purposes, 'analytics'), false) AS analytics,
  data IS NOT NULL AND len(purposes) > 7 AS purpose_7, false AS vendor_10 FROM p""")
def tcf_purpose_checks(spark, sf):
    records = privacy.consent_records(tcf_events(spark, sf))
    return records.select(
        "event_id",
        cs.has_purpose("purposes", "analytics").alias("analytics"),
        cs.has_purpose_count("purposes", 7).alias("purpose_7"),
        cs.has_vendor("vendors", 10).alias("vendor_10"),
    )


@query("valid_consent_records", _TCF + """
SELECT event_id, device_id, jurisdiction FROM b WHERE coalesce(octet_length(data) >= 20, false)""")
def valid_consent_records(spark, sf):
    records = privacy.valid_consents(privacy.consent_records(tcf_events(spark, sf)))
    return records.select("event_id", "device_id", "jurisdiction")


_REQ = d.views("privacy_requests")


@query("opt_out_deadlines", _REQ + f""", t AS (SELECT *, requested_at + CASE WHEN jurisdiction = 'US' THEN INTERVAL 24 HOUR ELSE INTERVAL 72 HOUR END AS due FROM privacy_requests)
SELECT id, strftime(due, '%Y-%m-%d %H:%M:%S') AS completion_deadline, status <> 'completed' AND due < TIMESTAMP '{NOW}' AS overdue,
  strftime(requested_at + INTERVAL 72 HOUR, '%Y-%m-%d %H:%M:%S') AS export_expires FROM t""")
def opt_out_deadlines(spark, sf):
    out = privacy.with_deadlines(d.privacy_requests(spark, sf), F.lit(NOW).cast("timestamp"))
    due = F.date_format("completion_deadline", "yyyy-MM-dd HH:mm:ss")
    expires = F.date_format(cs.export_expiry("requested_at"), "yyyy-MM-dd HH:mm:ss")
    return out.select("id", due.alias("completion_deadline"), "overdue", expires.alias("export_expires"))


@query("accepted_requests", _REQ + """
SELECT id, device_id, request_type, status FROM privacy_requests WHERE status = 'completed'
UNION ALL SELECT id, device_id, request_type, status FROM (SELECT * FROM privacy_requests WHERE status <> 'completed'
  QUALIFY row_number() OVER (PARTITION BY device_id, request_type ORDER BY requested_at, id) = 1)""")
def accepted_requests(spark, sf):
    r = d.privacy_requests(spark, sf)
    half = F.col("id") % 2 == 0
    out = privacy.accept_requests(r.filter(half), r.filter(~half))
    return out.select("id", "device_id", "request_type", "status")


CHAIN_SEGMENTS = (
    segments.Segment("chain_news", "Economy or promo", (
        segments.Rule("watched_genre", ("economy", "promo")),), "AND", 10),
    segments.Segment("chain_income", "Income in primetime", (
        segments.Rule("household_income", ("40000",), "gte"), segments.Rule("daypart", ("primetime",), "eq")),
        "AND", 20),
)

# Devices with an escalated request to be left out or erased.
_GONE = """, gone AS (SELECT DISTINCT device_id FROM privacy_requests WHERE request_type IN ('opt_out', 'erasure') AND escalated)"""


def leaving(spark, sf):
    return d.privacy_requests(spark, sf).filter("escalated")


@query("opt_out_segment_removal", d.views("viewership_enriched", "privacy_requests") + qs._members_cte() + _GONE + """
SELECT segment_id, device_id FROM members WHERE device_id NOT IN (SELECT device_id FROM gone)""")
def opt_out_segment_removal(spark, sf):
    out = privacy.remove_from_segments(qs.members(spark, sf), leaving(spark, sf))
    return out.select("segment_id", "device_id")


def lake_copy(spark, sf, name):
    """A viewership lake of the given tables in the shared folder."""
    path = scratch_path(spark, name)
    lake.write_viewership(d.viewership(spark, sf), path)
    return path


_LAKES: dict[tuple[str, str], str] = {}


def read_only_lake(spark, sf):
    """One lake per session and scale, for queries that change nothing in it."""
    key = (spark.sparkContext.applicationId, sf)
    if key not in _LAKES:
        _LAKES[key] = lake_copy(spark, sf, "lake")
    return _LAKES[key]


@query("erasure_effect", d.views("viewership", "privacy_requests") + _GONE + """
SELECT watch_date, count(*) AS rows, count(DISTINCT device_id) AS devices FROM viewership
WHERE device_id NOT IN (SELECT device_id FROM gone) GROUP BY 1""")
def erasure_effect(spark, sf):
    """A lake after devices were erased, with the audit written beside it."""
    path, audit = lake_copy(spark, sf, "erasure"), scratch_path(spark, "audit")
    requests = leaving(spark, sf).filter(F.col("request_type").isin("opt_out", "erasure"))
    privacy.erase_devices(spark, requests, {path: "watch_date"}, audit, F.lit(NOW).cast("timestamp"))
    return lake.read_viewership(spark, path).groupBy("watch_date").agg(
        F.count(F.lit(1)).alias("rows"), F.count_distinct("device_id").alias("devices")
    )


@query("erasure_audit", d.views("viewership", "privacy_requests") + """, asked AS (
  SELECT device_id, count(*) AS requests FROM privacy_requests WHERE request_type IN ('opt_out', 'erasure') AND escalated GROUP BY 1)
SELECT action, count(*) AS entries, count(DISTINCT device_id_hash) AS devices
FROM (SELECT action, sha256(device_id) AS device_id_hash, unnest(range(requests)) AS n FROM asked,
  (VALUES ('data_deletion_initiated'), ('data_deletion_completed')) t(action)) GROUP BY 1""")
def erasure_audit(spark, sf):
    """The entries that an erasure leaves, read back from the audit log."""
    path, audit = lake_copy(spark, sf, "erasure"), scratch_path(spark, "audit")
    requests = leaving(spark, sf).filter(F.col("request_type").isin("opt_out", "erasure"))
    privacy.erase_devices(spark, requests, {path: "watch_date"}, audit, F.lit(NOW).cast("timestamp"))
    return spark.read.json(audit).groupBy("action").agg(
        F.count(F.lit(1)).alias("entries"), F.count_distinct("device_id_hash").alias("devices"))


@query("retention_audit", d.views("viewership") + """
SELECT '2024-01-31' AS execution_time, count(*) FILTER (watch_date < '2024-01-11' AND watch_date >= '2024-01-06') AS viewership_deleted_count,
  count(*) FILTER (watch_date < '2024-01-06') AS aggregates_archived_count, 'success' AS status FROM viewership""")
def retention_audit(spark, sf):
    """Two policies on one lake, the older part archived first, and the entry they leave."""
    path, archive = lake_copy(spark, sf, "retention"), scratch_path(spark, "archived")
    audit = scratch_path(spark, "deletions")
    older = lifecycle.Policy(path, "watch_date", 25, "archive", archive)
    lifecycle.apply_policies(
        spark, [older, lifecycle.Policy(path, "watch_date", 20)], "2024-01-31", audit)
    return spark.read.parquet(audit)


@query("nightly_chain", d.views("viewership_enriched") + """, lake AS (
  SELECT *, CASE WHEN event_id % 2 = 0 THEN event_id % 90 * 1000 ELSE NULL END AS income FROM viewership_enriched),
found AS (SELECT 'chain_news' AS segment_id, device_id FROM lake WHERE genre IN ('economy', 'promo') AND viewing_date >= DATE '2024-01-21'
  UNION ALL SELECT 'chain_income', device_id FROM lake WHERE income >= 40000 AND daypart = 'primetime' AND viewing_date >= DATE '2024-01-11')
SELECT 'segment' AS kind, segment_id AS name, count(DISTINCT device_id) AS value FROM found GROUP BY 2
UNION ALL SELECT 'households', 'all', count(DISTINCT household_id) FROM lake""")
def nightly_chain(spark, sf):
    """The nightly run as one chain: a lake in an older and a newer layout, household aggregates that
    replace yesterday's, segments from the lake's own columns, member sets, and their sizes."""
    views = d.viewership_enriched(spark, sf).drop("daypart", "viewing_date", "household_income")
    path, table, sets = (scratch_path(spark, n) for n in ("chain", "aggregates", "members"))
    income = F.when(F.col("event_id") % 2 == 0, F.col("event_id") % 90 * 1000)
    half = F.col("watch_date") < "2024-01-16"
    lake.write_viewership(views.filter(half), path + "/a")
    # The newer layout has one more column.
    lake.write_viewership(views.filter(~half).withColumn("app_version", F.lit("2")), path + "/b")
    both = lake.read_viewership(spark, path + "/a").unionByName(
        lake.read_viewership(spark, path + "/b"), allowMissingColumns=True)
    for _ in range(2):
        lake.write_aggregates(hh.genre_hours(both), table)
    rows = enrich.for_segments(both.withColumn("household_income", income.cast("bigint")))
    found = segments.populations(rows, CHAIN_SEGMENTS, F.lit("2024-01-31").cast("date"))
    now = F.lit("2024-01-31 00:00:00").cast("timestamp")
    files.write_members(found, sets, now, [s.segment_id for s in CHAIN_SEGMENTS])
    sizes = segments.sizes(files.read_members(spark, sets, now)).select(
        F.lit("segment").alias("kind"), F.col("segment_id").alias("name"), F.col("device_count").alias("value"))
    households = spark.read.parquet(table).agg(F.count_distinct("household_id").alias("value"))
    return sizes.unionByName(households.select(
        F.lit("households").alias("kind"), F.lit("all").alias("name"), "value"))


@query("retention_effect", d.views("viewership") + """
SELECT watch_date, count(*) AS rows FROM viewership WHERE watch_date >= '2024-01-11' GROUP BY 1""")
def retention_effect(spark, sf):
    path = lake_copy(spark, sf, "retention")
    policy = lifecycle.Policy(path, "watch_date", 20)
    lifecycle.apply_policies(spark, [policy], "2024-01-31", scratch_path(spark, "deletions"))
    return lake.read_viewership(spark, path).groupBy("watch_date").agg(F.count(F.lit(1)).alias("rows"))


@query("archive_split", d.views("viewership") + """
SELECT CASE WHEN watch_date < '2024-01-11' THEN 'archived' ELSE 'kept' END AS part, count(*) AS rows, min(watch_date) AS first_date, max(watch_date) AS last_date
FROM viewership GROUP BY 1""")
def archive_split(spark, sf):
    path, archive = lake_copy(spark, sf, "archive"), scratch_path(spark, "archived")
    lifecycle.archive_expired(spark, path, "watch_date", "2024-01-11", archive, "2024-01-31")
    kept = lake.read_viewership(spark, path).select("watch_date", F.lit("kept").alias("part"))
    moved = lake.read_merged(spark, archive + "/2024-01-31").select(
        F.col("watch_date").cast("string").alias("watch_date"), F.lit("archived").alias("part")
    )
    return kept.unionByName(moved).groupBy("part").agg(
        F.count(F.lit(1)).alias("rows"), F.min("watch_date").alias("first_date"),
        F.max("watch_date").alias("last_date"),
    )


@query("compaction_effect", d.views("viewership") + """
SELECT watch_date, count(*) AS rows, count(DISTINCT device_id) AS devices, CAST(sum(duration_minutes) AS BIGINT) AS minutes FROM viewership GROUP BY 1""")
def compaction_effect(spark, sf):
    """A lake of many small files after compaction holds the same rows."""
    path = scratch_path(spark, "compaction")
    rows = d.viewership(spark, sf).repartition(6, "event_id")
    rows.write.partitionBy("watch_date").parquet(path)
    lifecycle.compact(spark, path, "watch_date", ["network", "genre"], ["device_id", "event_id"])
    return lake.read_viewership(spark, path).groupBy("watch_date").agg(
        F.count(F.lit(1)).alias("rows"), F.count_distinct("device_id").alias("devices"),
        F.sum("duration_minutes").alias("minutes"),
    )


@query("lake_scan_7d", d.views("viewership") + """
SELECT network, count(*) AS views FROM viewership WHERE watch_date >= '2024-01-24' GROUP BY 1""")
def lake_scan_7d(spark, sf):
    path = read_only_lake(spark, sf)
    rows = lake.read_viewership(spark, path, since="2024-01-24", columns=["network"])
    return rows.groupBy("network").agg(F.count(F.lit(1)).alias("views"))


@query("deletion_delta", d.views("viewership") + """
SELECT count(*) AS rows_before, count(*) FILTER (watch_date >= '2024-01-11') AS rows_after, count(*) FILTER (watch_date < '2024-01-11') AS deleted FROM viewership""")
def deletion_delta(spark, sf):
    v = d.viewership(spark, sf).select("watch_date")
    kept = F.col("watch_date") >= "2024-01-11"
    return v.agg(
        F.count(F.lit(1)).alias("rows_before"), F.count_if(kept).alias("rows_after"),
        F.count_if(~kept).alias("deleted"),
    )


@query("member_sets", qs._M + """
SELECT segment_id, count(DISTINCT device_id) AS members FROM members WHERE segment_id <> 'seg_night' GROUP BY 1""")
def member_sets(spark, sf):
    """Two refreshes of the member sets: in the second one a segment is left empty."""
    path = scratch_path(spark, "members")
    now = F.lit("2024-01-31 00:00:00").cast("timestamp")
    m = qs.members(spark, sf)
    ids = [s.segment_id for s in qs.SEGMENTS]
    files.write_members(m, path, now, ids)
    files.write_members(m.filter(F.col("segment_id") != "seg_night"), path, now, ids)
    alive = files.read_members(spark, path, now)
    return alive.groupBy("segment_id").agg(F.count_distinct("device_id").alias("members"))


@query("segment_size_upsert", qs._M + """, n AS (SELECT segment_id, count(DISTINCT device_id) AS c FROM members GROUP BY 1)
SELECT segment_id, c AS household_count, 2 AS version FROM n WHERE segment_id <> 'seg_or' UNION ALL SELECT segment_id, 0, 1 FROM n WHERE segment_id = 'seg_or'""")
def segment_size_upsert(spark, sf):
    """Stored sizes of the first run, replaced by the second run's where it has one."""
    path = scratch_path(spark, "sizes")
    sizes = qs.segment_sizes(spark, sf).select("segment_id", F.col("device_count").alias("household_count"))
    first = sizes.withColumns({"household_count": F.lit(0).cast("bigint"), "version": F.lit(1)})
    second = sizes.filter(F.col("segment_id") != "seg_or").withColumn("version", F.lit(2))
    lake.append_changes(first, path, 1)
    lake.append_changes(second, path, 2)
    return lake.latest_rows(spark.read.parquet(path), ["segment_id"], [F.col("version")])


@query("payout_report_files", qr._SHARES + """
SELECT manufacturer, CAST(device_count AS VARCHAR) AS device_count, printf('%.2f', revenue_share_usd) AS revenue_share_usd, printf('%.2f', percentage) || '%' AS percentage FROM shares""")
def payout_report_files(spark, sf):
    path = scratch_path(spark, "payouts")
    files.write_payout_reports(qr.shares(spark, sf), path, "2024-01")
    schema = "device_count string, revenue_share_usd string, percentage string, maker string, payout_month string, manufacturer string"
    return spark.read.schema(schema).option("header", True).csv(path).select(
        "manufacturer", "device_count", "revenue_share_usd", "percentage"
    )


@query("audit_trail", d.views("consent_events") + """
SELECT sha256(device_id) AS device_id_hash, jurisdiction, count(*) AS entries, count(DISTINCT event_id) AS events
FROM consent_events WHERE consent_time >= epoch_us(TIMESTAMP '2024-01-24') // 1000000 GROUP BY 1, 2""")
def audit_trail(spark, sf):
    """Audit entries of all consent changes, read back for the last seven days."""
    path = scratch_path(spark, "audit")
    at = F.timestamp_seconds("consent_time")
    entries = files.audit_rows(d.consent_events(spark, sf), "consent", at, event_id=F.col("event_id"))
    files.append_audit(entries, path)
    now = F.lit("2024-01-31 00:00:00").cast("timestamp")
    logs = files.read_audit(spark, path, as_of=now, days=7)
    return logs.groupBy("device_id_hash", "jurisdiction").agg(
        F.count(F.lit(1)).alias("entries"), F.count_distinct(F.col("metadata")["event_id"]).alias("events")
    )


_SUBJECT = d.views("viewership_enriched", "privacy_requests", "consent_events") + qs._members_cte() + """, latest AS (SELECT * FROM consent_events
  QUALIFY row_number() OVER (PARTITION BY device_id ORDER BY consent_time DESC, event_id DESC) = 1),
subjects AS (SELECT DISTINCT device_id FROM privacy_requests WHERE request_type = 'portability'),
w AS (SELECT device_id, count(*) AS views, CAST(sum(duration_minutes) AS BIGINT) AS minutes, min(watch_date) AS first_date, max(watch_date) AS last_date FROM viewership GROUP BY 1),
s AS (SELECT device_id, string_agg(segment_id, ',' ORDER BY segment_id) AS segments FROM (SELECT DISTINCT device_id, segment_id FROM members) GROUP BY 1),
report AS (SELECT l.device_id, l.opted_in, l.jurisdiction, coalesce(w.views, 0) AS views, coalesce(w.minutes, 0) AS minutes, w.first_date, w.last_date, coalesce(s.segments, '') AS segments
  FROM latest l JOIN subjects USING (device_id) LEFT JOIN w USING (device_id) LEFT JOIN s USING (device_id))"""


def subject_rows(spark, sf):
    subjects = d.privacy_requests(spark, sf).filter(F.col("request_type") == "portability")
    consents = ingest.latest_consents(d.consent_events(spark, sf), ("consent_time", "event_id"))
    return privacy.subject_report(
        subjects, consents, d.viewership_enriched(spark, sf), qs.members(spark, sf)
    )


@query("subject_access_report", _SUBJECT + " SELECT * FROM report")
def subject_access_report(spark, sf):
    return subject_rows(spark, sf).drop("consent_time").withColumn(
        "segments", F.concat_ws(",", "segments")
    )


@query("subject_export_csv", _SUBJECT + """
SELECT device_id, CAST(views AS VARCHAR) AS views, CASE WHEN segments = '' THEN '[]' ELSE '["' || replace(segments, ',', '","') || '"]' END AS segments FROM report""")
def subject_export_csv(spark, sf):
    path = scratch_path(spark, "export")
    rows = subject_rows(spark, sf).select("device_id", "views", "segments")
    files.write_export(rows, path, "csv")
    return spark.read.schema("device_id string, views string, segments string").option(
        "header", True).option("escape", "\\").csv(path)


@query("mark_sent", d.views("fingerprints") + """
SELECT event_id, event_type IN ('click', 'view') AS transmitted FROM fingerprints WHERE timestamp_utc >= 1706659200 - 20 * 86400""")
def mark_sent(spark, sf):
    f = d.fingerprints(spark, sf)
    queue = f.select("event_id", "timestamp_utc", (F.col("event_type") == "click").alias("transmitted"))
    recent = lifecycle.purge_older(queue, "timestamp_utc", F.lit(1706659200), 20)
    sent = f.filter(F.col("event_type") == "view")
    return lifecycle.mark_sent(recent, sent).select("event_id", "transmitted")


@query("z_order_value", d.views("viewership") + """
SELECT event_id, """ + " + ".join(
    f"(((watch_hour >> {b}) & 1) << {2 * b}) + (((duration_minutes >> {b}) & 1) << {2 * b + 1})" for b in range(8)
) + " AS z FROM (SELECT event_id, CAST(watch_hour AS BIGINT) AS watch_hour, duration_minutes FROM viewership)")
def z_order_value(spark, sf):
    v = d.viewership(spark, sf)
    z = lifecycle.z_value([F.col("watch_hour"), F.col("duration_minutes")], 8)
    return v.select("event_id", z.alias("z"))


@query("clip_keys", d.views("content") + """
SELECT content_id || ':' || (k * 1500) AS clip_key, content_id, CAST(k * 1500 AS BIGINT) AS start_ms,
  '{"content_id":"' || content_id || '"' || CASE WHEN k % 2 = 0 THEN ',"genre":"' || genre || '"' ELSE '' END || '}' AS body FROM content""")
def clip_keys(spark, sf):
    c = d.content(spark, sf)
    keyed = c.select("k", "genre", codec.clip_key("content_id", F.col("k") * 1500).alias("clip_key"))
    content_id, start = codec.clip_parts("clip_key")
    named = keyed.withColumns({"content_id": content_id, "start_ms": start})
    genre = F.when(F.col("k") % 2 == 0, F.col("genre")).alias("genre")
    return named.select(
        "clip_key", "content_id", "start_ms", codec.row_to_json("content_id", genre).alias("body")
    )


@query("hash_line_source", """WITH t AS (SELECT p_partkey AS k, sha256('ref-' || p_partkey) AS h FROM part)
SELECT CAST(k * 1500 AS BIGINT) AS start_ms, h AS fingerprint_hash FROM t WHERE k % 7 <> 0""")
def hash_line_source(spark, sf):
    """Hash lists written as text, every seventh line malformed, and read again."""
    path = scratch_path(spark, "hashes")
    key = F.col("p_partkey")
    h = F.sha2(F.concat(F.lit("ref-"), key), 256)
    good = F.concat((key * 1500).cast("string"), F.lit(" "), h)
    lines = d.table(spark, sf, "part").select(F.when(key % 7 == 0, h).otherwise(good).alias("value"))
    lines.write.text(path)
    return files.read_hash_lines(spark, path)


def manifests(spark, sf):
    """Manifests of fifty items, titles with braces and quotes, every third document followed by one cut short."""
    path = scratch_path(spark, "manifest")
    p = d.table(spark, sf, "part")
    item = F.struct(
        F.concat(F.lit("c-"), "p_partkey").alias("content_id"), F.concat(F.lit('{"Live"} {'), "p_name", F.lit("} {HD\\")).alias("title"),
        F.concat(F.lit("w"), "p_partkey").alias("wav"),
    )
    # Fifty items per document, however many there are in all.
    block = F.floor(F.col("p_partkey") / 50)
    documents = p.groupBy(block.alias("block")).agg(F.to_json(F.struct(F.collect_list(item).alias("items"))).alias("value"))
    cut = F.when(F.col("block") % 3 == 0, F.concat(F.lit('\n{"items": [{"content_id": "lost-'), "block", F.lit('", "title": "{a} {')))
    documents.select(F.concat("value", F.lit(" "), F.lit('{"items": []}'), F.coalesce(cut, F.lit(""))).alias("value")).write.text(path)
    return path


@query("manifest_source", """SELECT 'c-' || p_partkey AS content_id, '{"Live"} {' || p_name || '} {HD\\' AS title, 'w' || p_partkey AS wav FROM part""")
def manifest_source(spark, sf):
    """Content manifests written as JSON documents and read again."""
    return files.read_manifest(spark, manifests(spark, sf)).select("content_id", "title", "wav")


@query("manifest_broken", """SELECT '{"items": [{"content_id": "lost-' || b || '", "title": "{a} {' AS value
FROM (SELECT DISTINCT p_partkey // 50 AS b FROM part) WHERE b % 3 = 0""")
def manifest_broken(spark, sf):
    """What of the same manifests is no document."""
    return files.read_broken_manifests(spark, manifests(spark, sf)).select(F.trim("value").alias("value"))


@query("consent_state", d.views("consent_events") + """, c AS (SELECT device_id, consent_time,
  event_id % 5 = 0 OR opted_in AS opted_in, coalesce(nullif(jurisdiction, 'US'), 'EU') AS jurisdiction FROM consent_events)
SELECT device_id, consent_time, bool_and(opted_in) AS opted_in, min(jurisdiction) AS jurisdiction FROM c
WHERE (device_id, consent_time) IN (SELECT (device_id, max(consent_time)) FROM c GROUP BY device_id) GROUP BY 1, 2""")
def consent_state(spark, sf):
    """Consent records with defaults for a choice and a jurisdiction that are not named, recorded in two batches
    of which the second runs twice."""
    events = d.consent_events(spark, sf).withColumns({
        "opted_in": F.when(F.col("event_id") % 5 != 0, F.col("opted_in")),
        "jurisdiction": F.when(F.col("jurisdiction") != "US", F.col("jurisdiction"))})
    path = scratch_path(spark, "consent-state")
    for batch_id, part in ((1, 0), (2, 1), (2, 1)):
        privacy.record_consents(
            privacy.consent_records(events.filter(F.col("event_id") % 2 == part)), path, batch_id, count=8)
    return privacy.current_consents(spark, path, count=8).select(
        "device_id", "consent_time", "opted_in", "jurisdiction")


@query("audio_fingerprints")
def audio_fingerprints(spark, sf):
    """Sound made of the vectors: each one repeated to half a second of samples."""
    e = d.table(spark, sf, "embeddings")
    top = F.array_max(F.transform("embedding", lambda x: F.abs(x)))
    sample = F.transform(
        "embedding", lambda x: F.substring(F.hex((x / top * 30000).cast("bigint")), -4, 4)
    )
    padded = F.transform(sample, lambda h: F.lpad(h, 4, "0"))
    swapped = F.transform(padded, lambda h: F.concat(F.substring(h, 3, 2), F.substring(h, 1, 2)))
    pcm = F.unhex(F.repeat(F.concat_ws("", swapped), F.lit(128)))
    windows = e.select(
        F.col("vec_id").cast("string").alias("path"), F.lit(0).cast("bigint").alias("start_ms"),
        pcm.alias("pcm"),
    )
    return audio.fingerprint_windows(windows)


@query("clip_windows", """SELECT p_partkey AS k, unnest(range(0, CAST(3000 + (p_partkey % 20) * 1000 - 3000 + 1 AS BIGINT), 1500)) AS start_ms FROM part""")
def clip_windows(spark, sf):
    p = d.table(spark, sf, "part")
    length = (F.lit(3000) + F.col("p_partkey") % 20 * 1000).cast("int")
    starts = audio.clip_starts(length)
    exploded = p.select(F.col("p_partkey").alias("k"), F.explode(starts).alias("start_ms"))
    return exploded.withColumn("start_ms", F.col("start_ms").cast("bigint"))


@query("spectral_peaks", """WITH cells AS (SELECT vec_id // 100 AS clip_id, vec_id % 100 AS t, f, embedding[CAST(f + 1 AS INT)]::DOUBLE AS amplitude FROM embeddings, range(64) r(f)),
n AS (SELECT c.*, lag(amplitude) OVER a AS w, lead(amplitude) OVER a AS x, lag(amplitude) OVER b AS y, lead(amplitude) OVER b AS z FROM cells c
  WINDOW a AS (PARTITION BY clip_id, t ORDER BY f), b AS (PARTITION BY clip_id, f ORDER BY t))
SELECT clip_id, t, f, amplitude FROM n WHERE w IS NOT NULL AND x IS NOT NULL AND y IS NOT NULL AND z IS NOT NULL AND amplitude > greatest(w, x, y, z)
QUALIFY row_number() OVER (PARTITION BY clip_id ORDER BY amplitude DESC, t, f) <= 64""")
def spectral_peaks(spark, sf):
    e = d.table(spark, sf, "embeddings")
    clip = F.floor(F.col("vec_id") / 100).cast("bigint")
    cells = e.select(
        clip.alias("clip_id"), (F.col("vec_id") % 100).alias("t"),
        F.posexplode("embedding").alias("f", "amplitude"),
    )
    return audio.spectral_peaks(
        cells.select("clip_id", "t", F.col("f").cast("bigint").alias("f"), F.col("amplitude").cast("double").alias("amplitude"))
    )


@query("households_recent_scan", d.views("viewership") + """
SELECT household_id, genre, count(*) AS view_count FROM viewership WHERE watch_date >= '2024-01-24' GROUP BY 1, 2""")
def households_recent_scan(spark, sf):
    """The nightly job's scan: the last week of the lake, rolled up."""
    path = read_only_lake(spark, sf)
    recent = hh.recent(lake.read_viewership(spark, path), F.lit("2024-01-31").cast("date"), 7)
    return hh.genre_hours(recent).drop("watch_hours", "watch_minutes")


@query("partition_listing", d.views("viewership") + "SELECT DISTINCT watch_date FROM viewership")
def partition_listing(spark, sf):
    path = read_only_lake(spark, sf)
    days = folders.partition_values(spark, path, "watch_date")
    rows = spark.read.parquet(path).select(F.col("watch_date").cast("string").alias("watch_date"))
    return rows.filter(F.col("watch_date").isin(days)).distinct()
