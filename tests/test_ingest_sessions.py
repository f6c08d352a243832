import random

import pytest
from pyspark.sql import functions as F

from airtally.operators import enrich, ingest, sessions
from tests.conftest import one, rows

OK = "a" * 64


def test_batch_size_gate(spark):
    sizes = [0, 1, 20, 100, 101]
    frame = spark.createDataFrame([(n, [1] * n) for n in sizes], "n int, batch array<int>")
    assert {r.n for r in ingest.accepted_batches(frame).collect()} == {1, 20, 100}


def test_reject_reasons_in_order(spark):
    now = 10_000
    cases = [
        ("ok", OK, OK, now - 300, None, None),
        ("device_first", "x", "x", 0, 16509, "invalid_device_id"),
        ("null_device", None, OK, now, None, "invalid_device_id"),
        ("hash", OK, "a" * 63, 0, None, "invalid_fingerprint_hash"),
        ("old", OK, OK, now - 301, None, "timestamp_out_of_range"),
        ("future", OK, OK, now + 1, None, "timestamp_out_of_range"),
        ("no_time", OK, OK, None, None, "timestamp_out_of_range"),
        ("cloud", OK, OK, now, 24940, "datacenter_network"),
        ("home", OK, OK, now, 7922, None),
    ]
    frame = spark.createDataFrame(
        cases, "name string, device_id string, fingerprint_hash string, timestamp_utc bigint, asn int, want string")
    out = frame.withColumn("got", ingest.reject_reason(F.lit(now), asn="asn"))
    assert [(r.name, r.got) for r in out.collect()] == [(c[0], c[5]) for c in cases]


def test_milliseconds(spark):
    assert one(spark, ingest.in_time(F.lit(100), F.lit(99_500), "ms"), ingest.in_time(F.lit(100), F.lit(101_000), "ms")) == (True, False)


@pytest.mark.parametrize("limit", [1000, 0])
def test_asn_range_join_crosses_blocks(spark, limit):
    def n(a, b, c, d):
        return ((a * 256 + b) * 256 + c) * 256 + d

    ranges = spark.createDataFrame(
        [(n(1, 0, 0, 0), n(1, 3, 255, 255), 15169), (n(1, 4, 0, 0), n(1, 4, 0, 255), 7922), (n(9, 9, 9, 9), n(9, 9, 9, 9), 6697)],
        "lo bigint, hi bigint, asn int")
    ips = ["1.0.0.0", "1.3.255.255", "1.4.0.255", "1.4.1.0", "9.9.9.9", "bad", None, "10.0.0.1", "127.0.0.1"]
    events = spark.createDataFrame([(str(i), i, ip) for i, ip in enumerate(ips)], "device_id string, timestamp_utc bigint, ip_address string")
    got = {r.ip_address: r.asn for r in ingest.with_asn(events, ranges, broadcast_ranges=limit).collect()}
    assert got == {"1.0.0.0": 15169, "1.3.255.255": 15169, "1.4.0.255": 7922, "1.4.1.0": None, "9.9.9.9": 6697,
                   "bad": None, None: None, "10.0.0.1": None, "127.0.0.1": None}
    kept = {r.ip_address for r in ingest.drop_datacenters(events, ranges, broadcast_ranges=limit).collect()}
    assert kept == {"1.4.0.255", "1.4.1.0", "bad", None, "10.0.0.1", "127.0.0.1"}


def test_consent_modes(spark):
    consents = spark.createDataFrame([("in", True), ("out", False)], "device_id string, opted_in boolean")
    events = spark.createDataFrame([(d, j) for d in ("in", "out", "new") for j in ("US", "EU")], "device_id string, jurisdiction string")
    got = {mode: rows(ingest.consent_filter(events, consents, mode)) for mode in ("opt_out", "opt_in", "jurisdiction")}
    assert got["opt_out"] == [("in", "EU"), ("in", "US"), ("new", "EU"), ("new", "US")]
    assert got["opt_in"] == [("in", "EU"), ("in", "US")]
    assert got["jurisdiction"] == [("in", "EU"), ("in", "US"), ("new", "US")]


def random_events(seed, n=400, span=20_000):
    rng = random.Random(seed)
    return [(i, rng.choice("abc"), rng.choice("xy"), rng.randrange(span)) for i in range(n)]


def test_repeats_at_the_border(spark):
    cases = [(1, "d", "h", 3590), (2, "d", "h", 3650), (3, "d", "h", 3711), (4, "d", "h", 3711), (5, "d", "g", 3600)]
    frame = spark.createDataFrame(cases, "event_id int, device_id string, fingerprint_hash string, timestamp_utc bigint")
    assert sorted(r.event_id for r in ingest.drop_repeats(frame).collect()) == [1, 3, 5]


@pytest.mark.parametrize("bucket", [60, 500, 10**6])
def test_repeats_equal_brute_force(spark, bucket):
    events = random_events(bucket)
    frame = spark.createDataFrame(events, "event_id int, device_id string, fingerprint_hash string, timestamp_utc bigint")
    got = sorted(r.event_id for r in ingest.drop_repeats(frame, 60, bucket_seconds=bucket).collect())
    want = []
    for e in events:
        before = [o for o in events if o[1:3] == e[1:3] and (o[3], o[0]) < (e[3], e[0])]
        if all(e[3] - o[3] > 60 for o in before):
            want.append(e[0])
    assert got == sorted(want)


@pytest.mark.parametrize("bucket", [1000, 60_000])
def test_over_limit_equals_brute_force(spark, bucket):
    rng = random.Random(4)
    calls = [(rng.choice("ab"), rng.randrange(30_000)) for _ in range(500)]
    frame = spark.createDataFrame(calls, "k string, at bigint")
    got = rows(ingest.over_limit(frame, "k", "at", limit=12, bucket_ms=bucket))
    want = set()
    for k, at in calls:
        n = sum(1 for k2, a2 in calls if k2 == k and at - 999 <= a2 <= at)
        if n > 12:
            want.add((k, at, n))
    assert got == sorted(want, key=repr) and want


def split(points, gap, with_content):
    out, current = [], None
    for t, c in sorted(points):
        if current is None or t - current[1] > gap or (with_content and c != current[2]):
            if current:
                out.append(current)
            current = [t, t, c, 0]
        current[1] = t
        current[3] += 1
    return out + [current]


def test_sessions_by_pause(spark):
    cases = [("a", t) for t in (0, 100, 250, 900, 1000)] + [("b", 10), ("b", 20), ("z", 5)]
    cases += [("e", 3500), ("e", 3800), ("f", 3500), ("f", 3801), ("f", 3802)]
    frame = spark.createDataFrame(cases, "device_id string, timestamp_utc bigint")
    got = rows(sessions.gap_sessions(frame).select("device_id", "session_start", "session_end"))
    assert got == [("a", 0, 250), ("a", 900, 1000), ("b", 10, 20), ("e", 3500, 3800), ("f", 3801, 3802)]


@pytest.mark.parametrize("bucket", [300, 1000, 10**7])
@pytest.mark.parametrize("content", [False, True])
def test_sessions_equal_brute_force(spark, bucket, content):
    events = random_events(bucket + content, 600, 60_000)
    frame = spark.createDataFrame(events, "event_id int, device_id string, content_id string, t bigint")
    got = sessions.sessionize(frame, ["device_id"], "t", 300, ("content_id",) if content else (), bucket_seconds=bucket)
    got = rows(got.select("device_id", "session_start", "session_end", "events"))
    want = []
    for d in "abc":
        for s in split([(e[3], e[2]) for e in events if e[1] == d], 300, content):
            want.append((d, s[0], s[1], s[3]))
    assert got == sorted(want, key=repr)


def literal(points, gap):
    """State machine of the literal rule on (t, id, content)."""
    out, state = [], None
    for t, _, c in sorted(points, key=lambda p: p[:2]):
        if state and t - state[2] > gap:
            out.append(state)
            state = None
        if c is not None:
            state = [c, t, t]
        elif state:
            state[2] = t
    if state:
        out.append(state)
    return [(s[0], s[1], s[2]) for s in out if s[2] - s[1] >= 1]


def test_last_match_sessions_equal_state_machine(spark):
    rng = random.Random(9)
    events = [(i, rng.choice("ab"), rng.choice(["x", "y", None, None]), rng.randrange(60_000)) for i in range(500)]
    frame = spark.createDataFrame(events, "event_id int, device_id string, content_id string, timestamp_utc bigint")
    got = rows(sessions.last_match_sessions(frame, bucket_seconds=900).select("device_id", "content_id", "session_start", "session_end"))
    want = [(d, *s) for d in "ab" for s in literal([(e[3], e[0], e[2]) for e in events if e[1] == d], 300)]
    assert got == sorted(want, key=repr) and want


def test_enrichment(spark):
    cases = [("d1", "c", "t", "n", "g", 0.9, 1640000000, 3659, "m", "x", "192.168.1.100"), ("d2", "c", "t", "n", "g", 0.9, 1640000000, 10, "m", "x", None)]
    frame = spark.createDataFrame(
        cases, "device_id string, content_id string, title string, network string, genre string, match_confidence double, "
               "watch_start_utc bigint, duration_sec int, manufacturer string, model string, ip_address string")
    profiles = spark.createDataFrame([("d1", "501", "10001")], "device_id string, dma_code string, zip_code string")
    got = {r.device_id: r for r in enrich.enrich(frame, profiles).collect()}
    assert (got["d1"].watch_date, got["d1"].watch_hour, got["d1"].duration_minutes, got["d1"].dma_code) == ("2021-12-20", 11, 60, "501")
    assert (got["d2"].dma_code, got["d2"].zip_code) == ("00000", "00000")
    assert enrich.enrich(frame, household="subnet").columns == list(enrich.LAKE_COLUMNS)
