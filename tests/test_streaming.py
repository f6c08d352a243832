import json
import random
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from airtally.operators import ingest, sessions
from airtally.operators import segments as sg
from airtally.session import scratch_path
from airtally.sources import buckets, folders, lake, streams
from airtally.streaming import jobs, late, membership
from tests.conftest import rows

EVENT = "event_id bigint, device_id string, content_id string, timestamp_utc bigint"


def events(seed=1, n=300, span=40_000):
    rng = random.Random(seed)
    out = [(i, rng.choice("ab"), rng.choice(["x", "y", None]), rng.randrange(span)) for i in range(n)]
    return sorted(out, key=lambda e: e[3])


def source(spark, tmp_path, data, schema, files=4):
    """Data as JSON files, taken one file per micro-batch in order."""
    folder = tmp_path / "in"
    folder.mkdir()
    names = [p.split()[0] for p in schema.split(",")]
    step = -(-len(data) // files)
    for n in range(files):
        part = data[n * step:(n + 1) * step]
        path = folder / f"{n}.json"
        path.write_text("\n".join(json.dumps(dict(zip(names, e))) for e in part))
        import os
        os.utime(path, (1_000_000 + n, 1_000_000 + n))
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(folder))


def drain(spark, stream):
    path = scratch_path(spark, "t")
    jobs.start(jobs.to_lake(stream, path), path + "-cp", once=True).awaitTermination()
    return spark.read.schema(stream.schema).parquet(path)


FLUSH = [(10_000, "flush", "z", 200_000), (10_001, "flush", "z", 200_000)]


def test_session_windows_equal_batch(spark, tmp_path):
    data = events() + FLUSH
    out = drain(spark, jobs.session_windows(source(spark, tmp_path, data, EVENT), ["device_id"], "timestamp_utc"))
    batch = sessions.gap_sessions(spark.createDataFrame(data, EVENT))
    columns = ["device_id", "session_start", "session_end", "events"]
    assert rows(out.select(*columns)) == rows(batch.select(*columns))


def test_last_match_equals_batch(spark, tmp_path):
    data = events(5) + FLUSH
    out = drain(spark, jobs.last_match_sessions(source(spark, tmp_path, data, EVENT)))
    batch = sessions.last_match_sessions(spark.createDataFrame(data, EVENT))
    columns = ["device_id", "content_id", "session_start", "session_end"]
    assert rows(out.select(*columns)) == rows(batch.select(*columns)) != []


@pytest.mark.parametrize("files", [1, 4, 11])
def test_repeats_do_not_depend_on_the_batches(spark, tmp_path, files):
    rng = random.Random(9)
    data = sorted(((i, rng.choice("ab"), rng.choice("gh"), rng.randrange(20_000)) for i in range(400)),
                  key=lambda e: (e[3], e[0]))
    data += [(900, "a", "g", 100_000), (901, "a", "g", 186_400), (902, "a", "g", 186_430)]
    schema = "event_id bigint, device_id string, fingerprint_hash string, timestamp_utc bigint"
    out, known = scratch_path(spark, "out"), scratch_path(spark, "known")
    stream = source(spark, tmp_path, data, schema, files)
    sink = jobs.repeats_sink(out, known)
    jobs.start(stream.writeStream.foreachBatch(sink), scratch_path(spark, "cp"), once=True).awaitTermination()
    batch = ingest.drop_repeats(spark.createDataFrame(data, schema))
    got = rows(spark.read.schema(schema).parquet(out).select(*batch.columns))
    assert got == rows(batch)
    # A batch that is run again changes nothing.
    sink(spark.createDataFrame(data[:-(-len(data) // files)], schema), 0)
    assert rows(spark.read.schema(schema).parquet(out).select(*batch.columns)) == got


def test_ingest_from_texts(spark):
    good, bad, odd = (scratch_path(spark, n) for n in ("good", "bad", "odd"))
    consents = spark.createDataFrame([("a" * 64, True), ("b" * 64, False)], "device_id string, opted_in boolean")
    one = {"event_id": 1, "device_id": "a" * 64, "fingerprint_hash": "0" * 64, "timestamp_utc": 100}
    texts = [
        json.dumps({"api_key": "k", "received_at": 150, "batch": [one, {**one, "event_id": 2, "device_id": "x"}]}),
        json.dumps({"received_at": 150, "batch": [{**one, "event_id": 3, "device_id": "b" * 64},
                                                  {**one, "event_id": 4, "device_id": "c" * 64}]}),
        json.dumps({"received_at": 1500, "batch": [{**one, "event_id": 5}]}),
        json.dumps({"received_at": 150, "batch": []}), "{ broken", json.dumps({"received_at": 150}),
    ]
    jobs.ingest_sink(good, bad, odd, consents=lambda: consents)(
        spark.createDataFrame([(t,) for t in texts], "value string"), 0)
    assert rows(spark.read.parquet(good).select("event_id")) == [(1,)]
    assert rows(spark.read.parquet(bad).select("event_id", "reject_reason")) == [
        (2, "invalid_device_id"), (3, "no_consent"), (4, "no_consent"), (5, "timestamp_out_of_range")]
    assert rows(spark.read.parquet(odd).select("reason")) == [
        ("batch_size",), ("batch_size",), ("not_decoded",)]


RAW = "device_id string, fingerprint_hash string, timestamp_utc bigint, manufacturer string, model string, ip_address string"
REF = "fingerprint_hash string, content_id string, title string, network string, genre string, confidence double"


def test_match_job_fans_out_and_obeys_consent(spark, tmp_path):
    ref = "ab" * 32
    data = [("d%d" % (i % 4), ref if i % 3 else "0" * 64, i, "m", "x", "1.1.1.1") for i in range(24)]
    references = spark.createDataFrame([(ref, "c", "t", "n", "g", 1.0)], REF)
    consents = spark.createDataFrame([("d0", False)], "device_id string, opted_in boolean").withColumn("jurisdiction", F.lit("US"))
    good, bad = scratch_path(spark, "good"), scratch_path(spark, "bad")
    sink = jobs.match_sink(lambda: references, good, bad, lambda: consents, default_jurisdiction="US")
    stream = source(spark, tmp_path, data, RAW)
    jobs.start(stream.writeStream.foreachBatch(sink), scratch_path(spark, "cp"), once=True).awaitTermination()
    kept = [e for e in data if e[0] != "d0"]
    assert spark.read.parquet(good).count() == sum(e[1] == ref for e in kept)
    assert spark.read.parquet(bad).count() == sum(e[1] != ref for e in kept)
    before = spark.read.parquet(good).count()
    sink(spark.createDataFrame(data[:6], RAW), 0)
    assert spark.read.parquet(good).count() == before


VIEWS = ("device_id string, household_id string, genre string, network string, daypart string, dma_code string, "
         "household_income bigint, viewing_date string, duration_minutes bigint")


def test_membership_follows_the_populations_day_by_day(spark, tmp_path):
    """Entries, exits and second entries equal the transitions between the populations as of each day, with a
    batch run twice, a batch without rows and rows that come late."""
    rnd = random.Random(4)
    defs = [
        sg.Segment("and", "and rows", (sg.Rule("watched_genre", ("news",)), sg.Rule("daypart", ("morning",))), "AND", 2),
        sg.Segment("or", "or rows", (sg.Rule("watched_genre", ("news",)), sg.Rule("dma", ("7",))), "OR", 1),
        sg.Segment("hours_and", "hours and", (
            sg.Rule("watched_genre", ("drama",), "in", 1.0), sg.Rule("daypart", ("night",))), "AND", 4),
        sg.Segment("hours_or", "hours or", (
            sg.Rule("daypart", ("morning",), "in", 1.5), sg.Rule("network", ("x",), "in", 1.0)), "OR", 3, extended=True),
    ]
    state, events = scratch_path(spark, "membership"), scratch_path(spark, "moves")
    sink = membership.membership_sink(defs, state, events, buckets=4)
    seen, before, expected = [], None, []
    for n, day in enumerate([3, 4, 6, 9, 15, 16]):
        batch = [(f"d{rnd.randrange(12)}", f"h{rnd.randrange(2)}", rnd.choice(["news", "drama", None]),
                  rnd.choice(["x", "y"]), rnd.choice(["morning", "night"]), rnd.choice(["7", "8", "9"]), 1,
                  f"2024-01-{rnd.choice([day, day, max(1, day - 1)]):02d}", rnd.choice([5, 20, 40, None]))
                 for _ in range(rnd.choice([4, 10]))]
        batch.append(("d0", "h0", "none", "y", "night", "9", 1, f"2024-01-{day:02d}", 1))
        seen += batch
        frame = spark.createDataFrame(batch, VIEWS).withColumn("viewing_date", F.to_date("viewing_date"))
        sink(frame, 2 * n)
        if n in (2, 4):
            sink(frame, 2 * n)
            sink(frame.limit(0), 2 * n + 1)
        known = spark.createDataFrame(seen, VIEWS).withColumn("viewing_date", F.to_date("viewing_date"))
        now = {(r.segment_id, r.device_id) for r in sg.populations(
            known, defs, F.lit(f"2024-01-{day:02d}").cast("date")).collect()}
        expected += [(*m, "segment_entry", f"2024-01-{day:02d}") for m in now - (before or set())]
        expected += [(*m, "segment_exit", f"2024-01-{day:02d}") for m in (before or set()) - now]
        before = now
    got = spark.read.parquet(events).select("segment_id", "device_id", "event_type", F.col("day").cast("string"))
    assert rows(got) == sorted(expected, key=repr)
    assert sum(e[2] == "segment_exit" for e in expected) > 5
    kept = buckets.versions(spark, f"{state}/evidence")
    assert all(len(v) <= 2 for v in kept.values())


def test_repeats_are_judged_by_runs_whatever_the_clocks_say(spark, tmp_path):
    schema = "event_id bigint, device_id string, fingerprint_hash string, timestamp_utc bigint"
    out, known = scratch_path(spark, "out"), scratch_path(spark, "known")
    clock = [0]
    sink = jobs.repeats_sink(out, known, arrival=lambda: clock[0])
    batches = [
        [(1, "a", "h", 100), (2, "a", "h", 130), (3, "b", "h", 10**9), (4, "a", "h", 10**9), (5, "a", "g", 100)],
        [(6, "a", "h", 190), (7, "a", "h", 10**9 + 50), (8, "b", "h", 100), (9, "c", "h", 5), (10, "a", "h", 115)],
        [(11, "a", "h", 250), (12, "b", "h", 161), (13, "b", "h", 160), (14, "c", "h", 66), (15, "a", "h", 250)],
    ]
    for n, batch in enumerate(batches):
        clock[0] += 100
        for _ in range(2):
            sink(spark.createDataFrame(batch, schema), n)
    everything = spark.createDataFrame([e for b in batches for e in b], schema)
    names = schema.replace(" bigint", "").replace(" string", "").split(", ")
    got = spark.read.schema(schema).parquet(out).select(*names)
    assert rows(got) == rows(ingest.drop_repeats(everything))
    clock[0] += 4000
    sink(spark.createDataFrame([(20, "a", "h", 255)], schema), 3)
    assert (20,) in rows(spark.read.schema(schema).parquet(out).select("event_id"))
    assert spark.read.parquet(f"{known}/batch_id=3").count() == 1
    assert len(list(Path(known).glob("batch_id=*"))) == 2


def test_references_and_bands_are_upserted(spark, tmp_path):
    data = [("ab" * 32, "old", 1), ("cd" * 32, "x", 1), ("ab" * 32, "new", 2)]
    schema = "fingerprint_hash string, content_id string, version bigint"
    refs, bands = scratch_path(spark, "refs"), scratch_path(spark, "bands")
    sink = jobs.reference_sink(refs, bands, "version")
    stream = source(spark, tmp_path, data, schema, 3)
    jobs.start(stream.writeStream.foreachBatch(sink), scratch_path(spark, "cp"), once=True).awaitTermination()
    state = lake.latest_rows(spark.read.parquet(refs), ["fingerprint_hash"], [F.col("version")])
    assert rows(state.select("content_id")) == [("new",), ("x",)]
    assert spark.read.parquet(bands).drop("batch_id").distinct().count() == 64


def test_poison_messages_do_not_stop_a_stream(spark, tmp_path):
    folder = tmp_path / "topic"
    folder.mkdir()
    good = {"device_id": "d", "opted_in": True, "timestamp": "2024-01-01T00:00:01.123456Z", "jurisdiction": "US"}
    (folder / "a.json").write_text(json.dumps(good) + "\nnonsense\n" + json.dumps({**good, "device_id": "e"}))
    stream, broken = streams.open_topic(spark, "consent.events", str(folder))
    assert sorted(r.device_id for r in drain(spark, stream).collect()) == ["d", "e"]
    assert rows(drain(spark, broken)) == [("nonsense",)]
    assert {r.consent_time for r in drain(spark, streams.consents_from(stream)).collect()} == {1704067201}
    query = streams.write_topic(stream, "consent.events", scratch_path(spark, "cp"), scratch_path(spark, "topic"))
    query.trigger(availableNow=True).start().awaitTermination()


def test_late_matches_are_the_nearest_in_time_and_made_once(spark):
    rnd = random.Random(9)

    def flipped(hash_, bits):
        return f"{int(hash_, 16) ^ sum(1 << b for b in rnd.sample(range(100), bits)):064x}"

    base = [f"{rnd.getrandbits(256):064x}" for _ in range(6)]
    events = [(f"d{i}", flipped(rnd.choice(base), rnd.choice([0, 2, 14, 30])), 1_000_000 + rnd.randrange(300_000))
              for i in range(60)]
    events += [events[0], ("odd", "not hex", 1_000_100), ("hot", base[0], 1_000_200), ("hot", base[0], 1_000_300)]
    refs = [[(flipped(rnd.choice(base), rnd.choice([0, 1, 7, 16, 34])).upper(), f"c{n}-{i}",
              1_000_000 + 100_000 * n + rnd.randrange(100_000)) for i in range(8)] for n in range(4)]
    queue, found = scratch_path(spark, "queue"), scratch_path(spark, "found")
    late.queue_sink(queue)(spark.createDataFrame(
        events, "device_id string, fingerprint_hash string, timestamp_utc bigint"), 0)
    sink = late.probe_sink(queue, found, slack_hours=30)
    for n, batch in enumerate(refs):
        frame = spark.createDataFrame(
            [*batch, ("neither", "x", 1_000_000)], "fingerprint_hash string, content_id string, created_at bigint")
        sink(frame, n)
        sink(frame, n)
    expected, done = [], set()
    for batch in refs:
        for e in sorted(set(events) - {("odd", "not hex", 1_000_100)} - done):
            near = sorted(((int(e[1], 16) ^ int(h, 16)).bit_count(), h.lower(), t, c) for h, c, t in batch
                          if e[2] <= t <= e[2] + 86_400)
            if near and near[0][0] <= 65:
                expected.append((e[0], e[2], near[0][0], near[0][3]))
                done.add(e)
    got = spark.read.parquet(found).select("device_id", "timestamp_utc", "distance", "content_id")
    assert rows(got) == sorted(expected, key=repr) and len({e[2] for e in expected}) > 5


def test_hours_that_nothing_can_explain_fall_away(spark):
    queue, found = scratch_path(spark, "queue"), scratch_path(spark, "found")
    schema = "device_id string, fingerprint_hash string, timestamp_utc bigint"
    late.queue_sink(queue)(spark.createDataFrame(
        [("a", "0" * 64, h * 3600) for h in range(100)], schema), 0)
    sink = late.probe_sink(queue, found, arrival=lambda: 60 * 3600)
    refs = "fingerprint_hash string, content_id string, created_at bigint"
    sink(spark.createDataFrame([("f" * 64, "c", 50 * 3600)], refs), 0)
    assert folders.partition_values(spark, queue, "span") == sorted(str(h) for h in range(25, 100))
    sink(spark.createDataFrame([("f" * 64, "c", 10**9)], refs), 1)  # a clock far ahead
    assert folders.partition_values(spark, queue, "span") == sorted(str(h) for h in range(35, 100))


def test_hopping_and_rates(spark, tmp_path):
    data = [(i, "a", "x", i * 10) for i in range(60)] + [(100, "a", "x", 50_000)]
    counts = drain(spark, jobs.rates(source(spark, tmp_path, data, EVENT), "timestamp_utc"))
    assert rows(counts) == [(0, 30), (300, 30)]
    other = tmp_path / "h"
    other.mkdir()
    hops = jobs.hopping_counts(source(spark, other, data, EVENT), ["device_id"], "timestamp_utc")
    got = drain(spark, hops.select(F.unix_timestamp("window.start").alias("s"), "events"))
    assert {r.s: r.events for r in got.collect()}[0] == 30 and got.count() == 29


def test_lake_and_topic_batches_replace_themselves(spark, tmp_path):
    views = spark.createDataFrame(
        [(f"d{i % 3}", f"2024-01-0{1 + i % 2}", "N", "g", i) for i in range(20)],
        "device_id string, watch_date string, network string, genre string, timestamp_utc int")
    path = str(tmp_path / "lake")
    sink = jobs.lake_sink(path)
    for batch_id in (0, 1, 1):
        sink(views, batch_id)
    back = lake.read_viewership(spark, path)
    assert back.count() == 40 and "batch_id" not in back.columns
    assert lake.read_viewership(spark, path, "2024-01-02").count() == 20
    topic = tmp_path / "topic"
    for batch_id in (0, 0):
        jobs.keyed_sink(str(topic))(views.orderBy(F.rand(1)), batch_id)
    seen = {}
    for part in topic.rglob("part-*.json"):
        read = [json.loads(line) for line in part.read_text().splitlines()]
        for device in {r["device_id"] for r in read}:
            assert device not in seen
            seen[device] = [r["timestamp_utc"] for r in read if r["device_id"] == device]
    assert seen == {f"d{k}": list(range(k, 20, 3)) for k in range(3)}


def test_rocksdb_state_is_for_the_queries_inside(spark):
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key, None)
    with jobs.rocksdb_state(spark):
        assert "RocksDB" in spark.conf.get(key)
    assert spark.conf.get(key, None) == before
