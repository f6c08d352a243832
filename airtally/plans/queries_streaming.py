"""Queries that drain the given tables as streams. Results go to the shared folder
and are read back; each agrees with its batch twin."""

from __future__ import annotations

import datetime

from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from airtally.operators import ingest, privacy
from airtally.operators import segments as sg
from airtally.plans import domain as d
from airtally.plans import queries_ingest as qi
from airtally.plans import queries_matching as qm
from airtally.plans import queries_segments as qs
from airtally.plans.registry import query
from airtally.session import saved, scratch_path
from airtally.sources import folders, lake, streams
from airtally.streaming import jobs, late, membership


def event_stream(spark, sf):
    """The `events` table as a file stream."""
    schema = d.table(spark, sf, "events").schema
    return spark.readStream.schema(schema).parquet(f"{sf}/events.parquet*")


def fingerprint_stream(spark, sf):
    return d.fingerprints_of(event_stream(spark, sf))


def drain(spark, stream, name, schema_of=None):
    """Run the stream to its end into Parquet files and read them."""
    path = scratch_path(spark, name)
    jobs.start(jobs.to_lake(stream, path), path + "-checkpoint", once=True).awaitTermination()
    return spark.read.schema(stream.schema).parquet(path)


def drain_batches(spark, stream, sink, name):
    writer = stream.writeStream.foreachBatch(sink)
    jobs.start(writer, scratch_path(spark, name + "-checkpoint"), once=True).awaitTermination()


def drain_in_turn(spark, parts, sink, name):
    """Frames that arrive one after the other, each as one batch of a stream that goes on where it stopped.
    A frame is written by as many tasks as it has."""
    source, checkpoint = scratch_path(spark, name + "-in"), scratch_path(spark, name + "-checkpoint")
    for part in parts:
        part.write.mode("append").parquet(source)
        stream = spark.readStream.schema(part.schema).parquet(source)
        jobs.start(stream.writeStream.foreachBatch(sink), checkpoint, once=True).awaitTermination()


_LAST = "(SELECT max(timestamp_utc) FROM fingerprints)"


@query("stream_enriched", d.views("viewership") + """
SELECT device_id, household_id, content_id, watch_date, watch_hour, watch_start_utc FROM viewership""")
def stream_enriched(spark, sf):
    f = fingerprint_stream(spark, sf).filter(F.col("event_type") != "error")
    matched = f.join(d.by_size(d.content(spark, sf)), "k").select(
        "device_id", "content_id", "title", "network", "genre", F.lit(0.95).alias("match_confidence"),
        F.col("timestamp_utc").alias("watch_start_utc"),
        F.floor(F.col("value") * 60).cast("bigint").alias("duration_sec"),
        "manufacturer", "model", "ip_address",
    )
    path = scratch_path(spark, "lake")
    drain_batches(spark, jobs.enriched(matched), jobs.lake_sink(path), "enriched")
    return lake.read_viewership(spark, path).select(
        "device_id", "household_id", "content_id", "watch_date", "watch_hour", "watch_start_utc"
    )


_WM = f"{_LAST} - 600"


@query("stream_sessions", d.views("fingerprints") + qi._gap_sql(
    "SELECT manufacturer, timestamp_utc AS t FROM fingerprints", "manufacturer", 300)
    + f" AND max(t) + 300 <= {_WM}")
def stream_sessions(spark, sf):
    out = jobs.session_windows(fingerprint_stream(spark, sf), ["manufacturer"], "timestamp_utc")
    return drain(spark, out, "sessions")


@query("stream_rates", d.views("fingerprints") + f"""
SELECT timestamp_utc - timestamp_utc % 300 AS window_start, count(*) AS events FROM fingerprints GROUP BY 1
HAVING timestamp_utc - timestamp_utc % 300 + 300 <= {_WM}""")
def stream_rates(spark, sf):
    return drain(spark, jobs.rates(fingerprint_stream(spark, sf), "timestamp_utc"), "rates")


@query("stream_hopping", d.views("fingerprints") + f""", hops AS (
  SELECT manufacturer, timestamp_utc - timestamp_utc % 1800 - 1800 * h AS window_start FROM fingerprints, range(2) t(h))
SELECT manufacturer, window_start, count(*) AS events FROM hops GROUP BY 1, 2 HAVING window_start + 3600 <= {_WM}""")
def stream_hopping(spark, sf):
    out = jobs.hopping_counts(
        fingerprint_stream(spark, sf), ["manufacturer"], "timestamp_utc", "3600 seconds", "1800 seconds"
    )
    flat = out.select(
        "manufacturer", F.unix_timestamp("window.start").alias("window_start"), "events"
    )
    return drain(spark, flat, "hopping")


_ODD_CLOCKS = qi._REPEATED.replace("e AS (", "plain AS (", 1) + """, e AS (SELECT * REPLACE (CASE
    WHEN event_id % 97 = 0 THEN timestamp_utc + 86400 * (event_id % 500) WHEN device_id IN ('LG', 'TCL') THEN timestamp_utc - 7200
    ELSE timestamp_utc END AS timestamp_utc) FROM plain)"""


def odd_clocks(spark, sf):
    """Events of few senders with the time they arrive at: some clocks are up to 500 days ahead for one
    event, two senders deliver two hours late."""
    e = qi.repeated_events(spark, sf).withColumn("arrives", F.col("timestamp_utc"))
    ahead = F.col("timestamp_utc") + 86400 * (F.col("event_id") % 500)
    late = F.col("timestamp_utc") - 7200
    return e.withColumn("timestamp_utc", F.when(F.col("event_id") % 97 == 0, ahead).when(
        F.col("device_id").isin("LG", "TCL"), late).otherwise(F.col("timestamp_utc")))


@query("stream_dedup", qi._dedup_sql(60).replace(qi._REPEATED, _ODD_CLOCKS))
def stream_dedup(spark, sf):
    """In the order of arrival, an eighth of the span per batch."""
    e = odd_clocks(spark, sf)
    ends = e.agg(F.min("arrives").alias("a"), F.max("arrives").alias("b")).first()
    eighth = (ends["b"] - ends["a"]) // 8 + 1
    inside = F.col("arrives") - ends["a"]
    e = e.withColumn("part", F.floor(inside / eighth)).drop("arrives")
    schema = e.drop("part").schema
    out, known = scratch_path(spark, "repeats-out"), scratch_path(spark, "repeats-known")
    parts = (e.filter(F.col("part") == n).drop("part") for n in range(8))
    drain_in_turn(spark, parts, jobs.repeats_sink(out, known), "repeats")
    return spark.read.schema(schema).parquet(out).select(*schema.names)


@query("stream_last_match", d.views("fingerprints") + """, ordered AS (SELECT manufacturer AS device_id, timestamp_utc AS t, event_id,
    CASE WHEN event_type = 'error' THEN NULL ELSE 'c-' || k END AS content_id FROM fingerprints),
flagged AS (SELECT *, CASE WHEN t - lag(t) OVER w <= 1800 THEN 0 ELSE 1 END AS starts FROM ordered
  WINDOW w AS (PARTITION BY device_id ORDER BY t, event_id)),
numbered AS (SELECT *, sum(starts) OVER (PARTITION BY device_id ORDER BY t, event_id ROWS UNBOUNDED PRECEDING) AS sid FROM flagged),
runs AS (SELECT device_id, sid, max(t) AS session_end, max(struct_pack(t := t, e := event_id, c := content_id)) FILTER (content_id IS NOT NULL) AS m
  FROM numbered GROUP BY 1, 2)
SELECT device_id, m.c AS content_id, m.t AS session_start, session_end, session_end - m.t AS duration_sec
FROM runs WHERE m IS NOT NULL AND session_end - m.t >= 1 AND session_end + 1800 <= (SELECT max(t) FROM ordered) - 600""")
def stream_last_match(spark, sf):
    f = fingerprint_stream(spark, sf).withColumn(
        "content_id",
        F.when(F.col("event_type") != "error", F.concat(F.lit("c-"), F.col("k").cast("string"))),
    )
    return drain(spark, jobs.last_match_sessions(f, "manufacturer", gap=1800), "last-match")


@query("stream_match", qm._MATCHED + """
SELECT device_id, content_id, timestamp_utc AS watch_start_utc, true AS matched FROM matched WHERE content_id IS NOT NULL
UNION ALL SELECT device_id, NULL, timestamp_utc, false FROM matched WHERE content_id IS NULL""")
def stream_match(spark, sf):
    good, bad = scratch_path(spark, "matched"), scratch_path(spark, "unmatched")
    sink = jobs.match_sink(lambda: d.reference_fingerprints(spark, sf), good, bad)
    drain_batches(spark, fingerprint_stream(spark, sf), sink, "match")
    matched = spark.read.parquet(good).select(
        "device_id", "content_id", "watch_start_utc", F.lit(True).alias("matched")
    )
    unmatched = spark.read.schema("device_id string, timestamp_utc bigint").parquet(bad).select(
        "device_id", F.lit(None).cast("string").alias("content_id"),
        F.col("timestamp_utc").alias("watch_start_utc"), F.lit(False).alias("matched"),
    )
    return matched.unionByName(unmatched)


_CONSENTED = d.views("consent_events") + """, latest AS (SELECT * FROM consent_events
  QUALIFY row_number() OVER (PARTITION BY device_id ORDER BY consent_time DESC, event_id DESC) = 1)"""


def consent_stream(spark, sf):
    e = event_stream(spark, sf)
    return e.select(
        "event_id",
        F.sha2(F.concat(F.lit("device-"), F.col("user_id")), 256).alias("device_id"),
        (F.floor(F.col("value") * 100) % 7 != 0).alias("opted_in"),
        F.unix_timestamp("ts").alias("consent_time"),
    )


_STATE = "device_id string, opted_in boolean, consent_time bigint, event_id bigint"


def consent_changes(path):
    return jobs.consent_sink(path, _STATE, [F.col("consent_time"), F.col("event_id")], 8)


@query("stream_consents", _CONSENTED + " SELECT device_id, opted_in, consent_time FROM latest")
def stream_consents(spark, sf):
    """Consent changes as they come in, and the state they lead to."""
    path = scratch_path(spark, "consents")
    drain_batches(spark, consent_stream(spark, sf), consent_changes(path), "consents")
    state = privacy.current_consents(spark, path, _STATE, count=8)
    return state.select("device_id", "opted_in", "consent_time")


@query("stream_consent_enforcement", _CONSENTED.replace("WITH ", "WITH ", 1) + """, fp AS (
  SELECT event_id, sha256('device-' || user_id) AS device_id FROM events)
SELECT event_id FROM fp WHERE device_id NOT IN (SELECT device_id FROM latest WHERE NOT opted_in)""")
def stream_consent_enforcement(spark, sf):
    """Fingerprints of a stream without those of devices that opted out."""
    consents, kept = scratch_path(spark, "consents"), scratch_path(spark, "allowed")
    drain_batches(spark, consent_stream(spark, sf), consent_changes(consents), "c")
    drain_batches(spark, fingerprint_stream(spark, sf), jobs.enforcement_sink(consents, kept, _STATE, count=8), "enforce")
    return spark.read.parquet(kept).select("event_id")


@query("stream_restart", d.views("fingerprints") + qi._gap_sql(
    "SELECT manufacturer, timestamp_utc AS t FROM fingerprints", "manufacturer", 300)
    + f" AND max(t) + 300 <= {_WM}")
def stream_restart(spark, sf):
    """Sessions of a stream that stops and starts again: the first start fails after it has written a
    batch, which the second one runs again; the third one finds the later half of the events."""
    source, out = scratch_path(spark, "halves"), scratch_path(spark, "restarted")
    checkpoint = scratch_path(spark, "restarted-checkpoint")
    f = d.fingerprints(spark, sf).select("manufacturer", "timestamp_utc")
    middle = f.agg(F.percentile_approx("timestamp_utc", 0.5)).first()[0]
    with jobs.rocksdb_state(spark):
        f.filter(F.col("timestamp_utc") <= middle).write.parquet(source)
        stream = spark.readStream.schema(f.schema).parquet(source)
        found = jobs.session_windows(stream, ["manufacturer"], "timestamp_utc")
        failed = []

        def sink(batch, batch_id):
            # What was written says whether the batch holds rows; asking the batch would run its state twice.
            jobs.write_batch(batch, out, batch_id)
            if not failed and folders.exists(spark, f"{out}/batch_id={batch_id}"):
                failed.append(batch_id)
                raise RuntimeError("stopped after the write")

        def run():
            jobs.start(found.writeStream.foreachBatch(sink), checkpoint, once=True).awaitTermination()

        try:
            run()
        except StreamingQueryException:
            if not failed:
                raise
        run()
        f.filter(F.col("timestamp_utc") > middle).write.mode("append").parquet(source)
        run()
    # Of events without a pause no session has ended, and no file says what its columns are.
    return spark.read.schema(found.schema).parquet(out).select(*found.columns)


@query("keyed_topic", d.views("fingerprints") + """
SELECT device_id, count(*) AS events, 1::BIGINT AS files FROM fingerprints WHERE device_id IS NOT NULL GROUP BY 1""")
def keyed_topic(spark, sf):
    """Fingerprints as a topic of files: a device's messages lie in one file."""
    path = scratch_path(spark, "topic")
    messages = fingerprint_stream(spark, sf).select("device_id", "fingerprint_hash", "timestamp_utc")
    drain_batches(spark, messages, jobs.keyed_sink(path), "topic")
    back = spark.read.schema("device_id string").json(path)
    return back.select("device_id", F.col("_metadata.file_path").alias("file")).groupBy("device_id").agg(
        F.count(F.lit(1)).alias("events"), F.count_distinct("file").alias("files"))


@query("stream_reference_upsert", """WITH w AS (SELECT o_orderkey AS version, sha256('ref-' || (o_custkey % 500)) AS fingerprint_hash, 'c-' || o_custkey AS content_id FROM orders)
SELECT fingerprint_hash, content_id, 32 AS bands FROM w QUALIFY row_number() OVER (PARTITION BY fingerprint_hash ORDER BY version DESC) = 1""")
def stream_reference_upsert(spark, sf):
    schema = d.table(spark, sf, "orders").schema
    writes = spark.readStream.schema(schema).parquet(f"{sf}/orders.parquet*").select(
        F.col("o_orderkey").alias("version"),
        F.sha2(F.concat(F.lit("ref-"), F.col("o_custkey") % 500), 256).alias("fingerprint_hash"),
        F.concat(F.lit("c-"), F.col("o_custkey")).alias("content_id"),
    )
    refs, bands = scratch_path(spark, "references"), scratch_path(spark, "bands")
    drain_batches(spark, writes, jobs.reference_sink(refs, bands, "version"), "references")
    state = lake.latest_rows(spark.read.parquet(refs), ["fingerprint_hash"], [F.col("version")])
    per_hash = (
        spark.read.parquet(bands).select("band_index", "band_hash", "fingerprint_hash").distinct()
        .groupBy("fingerprint_hash").agg(F.count(F.lit(1)).cast("int").alias("bands"))
    )
    return state.join(per_hash, "fingerprint_hash").select("fingerprint_hash", "content_id", "bands")


_FILES = 16


@query("stream_segment_entries", qs._M + """
SELECT DISTINCT segment_id, device_id, 'segment_entry' AS event_type FROM members""")
def stream_segment_entries(spark, sf):
    known, entries = scratch_path(spark, "known"), scratch_path(spark, "entries")
    source = scratch_path(spark, "viewership")
    views = d.viewership_enriched(spark, sf).select(*_VIEW_COLUMNS)
    # A batch takes two files and rewrites the state, so files grow with the table, not in number.
    views.coalesce(_FILES).write.parquet(source)
    stream = spark.readStream.schema(views.schema).option("maxFilesPerTrigger", 2).parquet(source)
    day = datetime.date.fromisoformat(qs.AS_OF)
    drain_batches(spark, stream, membership.membership_sink(
        qs.SEGMENTS, known, entries, lambda batch: day, buckets=8), "entries")
    return spark.read.parquet(entries).select("segment_id", "device_id", "event_type")


# Short lookbacks, so that devices leave and come back within the given month.
_LIVE = (
    sg.Segment("live_and", "Brand in primetime", (
        sg.Rule("watched_network", ("Brand#1", "Brand#2", "Brand#3")), sg.Rule("daypart", ("primetime",), "eq")), "AND", 3),
    sg.Segment("live_or", "Promo or some areas", (
        sg.Rule("watched_genre", ("promo",), "eq"), sg.Rule("dma", ("100", "101"))), "OR", 2),
    sg.Segment("live_hours_and", "An hour of early brands and any night", (
        sg.Rule("watched_network", ("Brand#1", "Brand#2", "Brand#3"), "in", 1.0), sg.Rule("daypart", ("latenight",), "eq")),
        "AND", 6),
    sg.Segment("live_hours_or", "Two hours of mornings or promo", (
        sg.Rule("daypart", ("morning",), "eq", 2.0), sg.Rule("watched_genre", ("promo",), "eq")), "OR", 5),
)
_VIEW_COLUMNS = ("device_id", "household_id", "genre", "network", "daypart", "dma_code", "household_income",
                 "viewing_date", "duration_minutes")
_LIVE_STEPS = 8

# The populations as of each batch's day, from the rows that had come by then.
_BRANDS = "network IN ('Brand#1', 'Brand#2', 'Brand#3')"
_LIVE_SQL = d.views("viewership_enriched") + f""", ends AS (SELECT min(viewing_date) AS a, max(viewing_date) AS b FROM viewership_enriched),
parts AS (SELECT *, (viewing_date - a) * {_LIVE_STEPS} // (b - a + 1) AS part FROM viewership_enriched, ends),
days AS (SELECT part, max(viewing_date) AS day FROM parts GROUP BY part),
seen AS (SELECT n.part, n.day, p.* EXCLUDE (part), n.day - p.viewing_date AS age, date_trunc('week', p.viewing_date) AS week
  FROM days n JOIN parts p ON p.part <= n.part),
weekly AS (SELECT part, day, household_id, device_id, week,
    coalesce(sum(duration_minutes) FILTER ({_BRANDS} AND age <= 6), 0) >= 60 AS brands,
    coalesce(bool_or(daypart = 'latenight' AND age <= 6), false) AS night,
    coalesce(sum(duration_minutes) FILTER (daypart = 'morning' AND age <= 5), 0) >= 120 AS mornings,
    coalesce(bool_or(genre = 'promo' AND age <= 5), false) AS promo FROM seen GROUP BY ALL),
held AS (SELECT part, day, household_id, device_id, bool_or(brands) AND bool_or(night) AS hours_and,
    bool_or(mornings) OR bool_or(promo) AS hours_or FROM weekly GROUP BY ALL),
members AS (
  SELECT DISTINCT part, 'live_and' AS segment_id, device_id FROM seen WHERE {_BRANDS} AND daypart = 'primetime' AND age <= 3
  UNION SELECT part, 'live_or', device_id FROM seen WHERE (genre = 'promo' OR dma_code IN ('100', '101')) AND age <= 2
  UNION SELECT part, 'live_hours_and', device_id FROM held WHERE hours_and
  UNION SELECT part, 'live_hours_or', device_id FROM held WHERE hours_or),
numbered AS (SELECT m.*, n.no FROM members m JOIN (SELECT *, row_number() OVER (ORDER BY part) AS no FROM days) n USING (part)),
moves AS (
  SELECT segment_id, device_id, 'segment_entry' AS event_type, no FROM numbered x
  WHERE NOT EXISTS (FROM numbered y WHERE y.segment_id = x.segment_id AND y.device_id = x.device_id AND y.no = x.no - 1)
  UNION ALL SELECT segment_id, device_id, 'segment_exit', no + 1 FROM numbered x
  WHERE NOT EXISTS (FROM numbered y WHERE y.segment_id = x.segment_id AND y.device_id = x.device_id AND y.no = x.no + 1))
SELECT segment_id, device_id, event_type, day FROM moves
JOIN (SELECT day, row_number() OVER (ORDER BY part) AS no FROM days) USING (no)"""


@query("stream_membership", _LIVE_SQL)
def stream_membership(spark, sf):
    """Entries, exits and second entries over eight batches of some days each."""
    views = d.viewership_enriched(spark, sf).select(*_VIEW_COLUMNS)
    ends = views.agg(F.min("viewing_date").alias("a"), F.max("viewing_date").alias("b")).first()
    length = (ends["b"] - ends["a"]).days + 1
    part = F.floor(F.datediff("viewing_date", F.lit(ends["a"])) * _LIVE_STEPS / length)
    marked = saved(views.withColumn("part", part), "viewership")
    state, events = scratch_path(spark, "membership"), scratch_path(spark, "moves")
    parts = (marked.filter(F.col("part") == n).drop("part") for n in range(_LIVE_STEPS))
    drain_in_turn(spark, parts, membership.membership_sink(_LIVE, state, events, buckets=8), "membership")
    moves = spark.read.schema("segment_id string, device_id string, event_type string, day date").parquet(events)
    return moves.select("segment_id", "device_id", "event_type", "day")


@query("stream_content_counts", d.views("viewership") + """
SELECT content_id, count(*) AS views FROM viewership GROUP BY 1""")
def stream_content_counts(spark, sf):
    f = fingerprint_stream(spark, sf).filter(F.col("event_type") != "error")
    counts = jobs.content_counts(f.join(d.by_size(d.content(spark, sf)), "k"))
    path = scratch_path(spark, "counts")
    writer = counts.writeStream.outputMode("update").foreachBatch(
        lambda batch, batch_id: jobs.write_batch(batch, path, batch_id)
    )
    jobs.start(writer, path + "-checkpoint", once=True).awaitTermination()
    newest = lake.latest_rows(spark.read.parquet(path), ["content_id"], [F.col("views")])
    return newest.select("content_id", "views")


@query("stream_late_matches", d.views("fingerprints") + f""", noise AS (
  SELECT device_id, fingerprint_hash, event_id, timestamp_utc FROM fingerprints WHERE event_type = 'error'),
refs AS (SELECT event_id, {qm.FLIPPED} AS reference_hash, {qm.FLIPS} AS distance,
  timestamp_utc + (event_id % 40) * 3600 AS created_at FROM noise)
SELECT n.device_id, 'c-n' || event_id AS content_id, reference_hash, distance FROM noise n JOIN refs r USING (event_id)
WHERE r.created_at BETWEEN n.timestamp_utc AND n.timestamp_utc + 86400 AND distance <= 65""")
def stream_late_matches(spark, sf):
    """References at distances up to 70 that arrive up to 39 hours after the events they explain, in
    four batches in the order of their creation."""
    noise = d.fingerprints(spark, sf).filter(F.col("event_type") == "error")
    queue, matches = (scratch_path(spark, n) for n in ("queue", "late"))
    events = fingerprint_stream(spark, sf).filter(F.col("event_type") == "error").select(
        "device_id", "fingerprint_hash", "timestamp_utc")
    drain_batches(spark, events, late.queue_sink(queue), "queue")
    refs = noise.select(
        F.expr(qm.FLIPPED).alias("fingerprint_hash"), F.concat(F.lit("c-n"), F.col("event_id")).alias("content_id"),
        (F.col("timestamp_utc") + F.col("event_id") % 40 * 3600).alias("created_at"))
    ends = refs.agg(F.min("created_at").alias("a"), F.max("created_at").alias("b")).first()
    quarter = (ends["b"] - ends["a"]) // 4 + 1
    number = F.floor((F.col("created_at") - ends["a"]) / quarter)
    drain_in_turn(spark, (refs.filter(number == n) for n in range(4)), late.probe_sink(queue, matches), "late")
    columns = ["device_id", "content_id", "reference_hash", "distance"]
    return spark.read.parquet(matches).select(*columns)


_REQUESTS = d.views("fingerprints") + """, base AS (
  SELECT *, event_id // 3 AS request, timestamp_utc + (event_id % 7) * 60 AS received_at FROM fingerprints),
sent AS (SELECT *, max(received_at) OVER (PARTITION BY request) AS sent_at, count(*) OVER (PARTITION BY request) AS size FROM base),
checked AS (SELECT event_id, request, CASE WHEN event_id % 11 = 0 THEN 'invalid_device_id'
    WHEN event_id % 13 = 0 THEN 'invalid_fingerprint_hash'
    WHEN sent_at - timestamp_utc NOT BETWEEN 0 AND 300 THEN 'timestamp_out_of_range'
    WHEN NOT coalesce(opted_in, false) THEN 'no_consent' END AS reason
  FROM sent LEFT JOIN (SELECT device_id, opted_in FROM consent_state) USING (device_id)
  WHERE request % 17 <> 0 AND request % 19 <> 0)"""


@query("stream_ingest_requests", _REQUESTS.replace(", base AS", """, consent_state AS (
  SELECT device_id, bool_and(user_id % 5 <> 0) AS opted_in FROM fingerprints WHERE user_id % 3 <> 0 GROUP BY 1), base AS""") + """
SELECT event_id, coalesce(reason, 'accepted') AS outcome FROM checked
UNION ALL SELECT request, 'not_decoded' FROM sent WHERE request % 17 = 0 GROUP BY 1
UNION ALL SELECT request, 'batch_size' FROM sent WHERE request % 17 <> 0 AND request % 19 = 0 GROUP BY 1""")
def stream_ingest_requests(spark, sf):
    """Events in requests of three as JSON texts, some cut off, some with an empty batch, drained
    into accepted, rejected and broken ones."""
    f = d.fingerprints(spark, sf)
    consents = f.filter("user_id % 3 <> 0").groupBy("device_id").agg(
        F.bool_and(F.col("user_id") % 5 != 0).alias("opted_in"))
    event = F.struct(
        "event_id",
        F.when(F.col("event_id") % 11 == 0, "short").otherwise(F.col("device_id")).alias("device_id"),
        F.when(F.col("event_id") % 13 == 0, "zz").otherwise(F.col("fingerprint_hash")).alias("fingerprint_hash"),
        "timestamp_utc", "manufacturer", "model", "ip_address")
    number = F.floor(F.col("event_id") / 3).cast("bigint").alias("request")
    requests = f.groupBy(number).agg(
        F.max(F.col("timestamp_utc") + F.col("event_id") % 7 * 60).alias("received_at"),
        F.collect_list(event).alias("batch"))
    text = F.to_json(F.struct(
        F.col("request").cast("string").alias("api_key"), "received_at",
        F.when(F.col("request") % 19 != 0, F.col("batch")).otherwise(F.slice("batch", 1, 0)).alias("batch")))
    broken = F.concat(F.lit("{"), F.col("request"))
    source = scratch_path(spark, "requests")
    requests.select(F.when(F.col("request") % 17 == 0, broken).otherwise(text).alias("value")).repartition(
        4).write.text(source)
    values = streams.raw_values(spark, "ingest.requests", source, maxFilesPerTrigger=1)
    good, bad, odd = (scratch_path(spark, n) for n in ("accepted", "rejected", "broken"))
    drain_batches(spark, values, jobs.ingest_sink(good, bad, odd, consents=lambda: consents), "requests")
    accepted = spark.read.schema("event_id bigint").parquet(good).withColumn("outcome", F.lit("accepted"))
    rejected = spark.read.schema("event_id bigint, reject_reason string").parquet(bad).withColumnRenamed(
        "reject_reason", "outcome")
    named = F.coalesce(
        F.get_json_object("value", "$.api_key"), F.regexp_extract("value", "[0-9]+", 0)).cast("bigint")
    left = spark.read.schema("value string, reason string").parquet(odd).select(
        named.alias("event_id"), F.col("reason").alias("outcome"))
    columns = ["event_id", "outcome"]
    return accepted.select(*columns).unionByName(rejected.select(*columns)).unionByName(left.select(*columns))
