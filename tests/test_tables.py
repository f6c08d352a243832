import glob
import io
import math
import os
import struct
import wave

import numpy as np
import pytest
from pyspark.sql import functions as F

from airtally.operators import audio, lifecycle, privacy
from airtally.sources import audio as wav
from airtally.sources import files, folders, lake, streams
from tests.conftest import rows

def now():
    return F.lit("2024-03-01 00:00:00").cast("timestamp")


@pytest.fixture
def table(spark, tmp_path):
    """Ten days of five devices; day 2 holds device d1 only."""
    path = str(tmp_path / "lake")
    data = [(f"d{i}", f"2024-01-{d:02d}", "net%d" % (i % 2), "drama", d * 10 + i) for d in range(1, 11) for i in range(5) if d != 2 or i == 1]
    frame = spark.createDataFrame(data, "device_id string, watch_date string, network string, genre string, duration_minutes int")
    lake.write_viewership(frame, path)
    return path


def test_lake_layout_and_pruning(spark, table):
    assert folders.partition_values(spark, table, "watch_date") == [f"2024-01-{d:02d}" for d in range(1, 11)]
    recent = lake.read_viewership(spark, table, "2024-01-09", ["device_id", "watch_date"])
    assert recent.count() == 10
    plan = recent._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(watch_date" in plan.replace("\n", "")
    assert "ingest_timestamp" in spark.read.parquet(table).columns


def test_fine_layout(spark, tmp_path):
    path = str(tmp_path / "fine")
    frame = spark.createDataFrame([("a", "2024-01-01", "n", "g", 1)], "device_id string, watch_date string, network string, genre string, duration_minutes int")
    lake.write_viewership(frame, path, partitions=lake.FINE_PARTITIONS)
    assert os.path.isdir(f"{path}/watch_date=2024-01-01/network=n/genre=g")


def test_retention_drops_whole_days(spark, table):
    assert lifecycle.drop_expired(spark, table, "watch_date", "2024-01-05") == 16
    assert lifecycle.drop_expired(spark, table, "watch_date", "2024-01-05") == 0
    assert spark.read.parquet(table).count() == 30


def test_archive_then_drop(spark, table, tmp_path):
    root = str(tmp_path / "archive")
    assert lifecycle.archive_expired(spark, table, "watch_date", "2024-01-03", root, "2024-03-01") == 6
    assert spark.read.parquet(root + "/2024-03-01").count() == 6
    assert spark.read.parquet(table).count() == 40
    with pytest.raises(Exception):
        lake.write_archive(spark.range(1), root, "2024-03-01")


def test_policies_and_audit(spark, table, tmp_path):
    audit = str(tmp_path / "audit")
    policies = [lifecycle.Policy(table, "watch_date", 55), lifecycle.Policy(str(tmp_path / "none"), "day", 1)]
    done = lifecycle.apply_policies(spark, policies, "2024-03-01", audit)
    assert done[table] == 21
    assert tuple(spark.read.parquet(audit).first()) == ("2024-03-01", 21, 0, "success")


def test_erasure_rewrites_only_what_it_must(spark, table, tmp_path):
    audit = str(tmp_path / "audit")
    kept_before = {p: os.path.getmtime(p) for p in glob.glob(table + "/*/*.parquet")}
    spark.createDataFrame([("d9", "2024-01-09", "n", "g", 1)], "device_id string, watch_date string, network string, genre string, duration_minutes int") \
        .write.mode("append").partitionBy("watch_date").parquet(table)
    requests = spark.createDataFrame([("d9", "US")], "device_id string, jurisdiction string")
    assert privacy.erase_devices(spark, requests, {table: "watch_date"}, audit, now()) == {table: 1}
    untouched = [p for p in kept_before if "2024-01-09" not in p]
    assert all(os.path.exists(p) for p in untouched)
    gone = spark.createDataFrame([("d1", "US"), ("d1", "US")], "device_id string, jurisdiction string")
    assert privacy.erase_devices(spark, gone, {table: "watch_date"}, audit, now()) == {table: 10}
    left = spark.read.parquet(table)
    assert left.filter("device_id in ('d1', 'd9')").count() == 0 and left.count() == 36
    assert "2024-01-02" not in folders.partition_values(spark, table, "watch_date")
    assert privacy.erase_devices(spark, gone, {table: "watch_date"}, audit, now()) == {table: 0}
    actions = {r.action for r in files.read_audit(spark, audit).collect()}
    assert actions == {"data_deletion_initiated", "data_deletion_completed"}


def test_failed_erasure_is_audited(spark, tmp_path):
    audit = str(tmp_path / "audit")
    gone = spark.createDataFrame([("d1", "US")], "device_id string, jurisdiction string")
    with pytest.raises(Exception):
        privacy.erase_devices(spark, gone, {str(tmp_path / "missing"): "watch_date"}, audit, now())
    assert {r.action for r in files.read_audit(spark, audit).collect()} == {"data_deletion_initiated", "data_deletion_failed"}


def test_compaction_keeps_rows(spark, tmp_path):
    path = str(tmp_path / "small")
    frame = spark.range(3000).select(
        F.concat(F.lit("d"), F.col("id") % 97).alias("device_id"), F.col("id"), (F.col("id") % 5).alias("network"),
        F.concat(F.lit("2024-01-0"), F.col("id") % 2 + 1).alias("watch_date"))
    frame.repartition(8).write.partitionBy("watch_date").parquet(path)
    before = rows(spark.read.parquet(path).select("id", "device_id", "network"))
    assert lifecycle.compact(spark, path, "watch_date", ["network"], ["id"]) == {"2024-01-01": 1, "2024-01-02": 1}
    assert rows(spark.read.parquet(path).select("id", "device_id", "network")) == before
    assert len(glob.glob(path + "/*/*.parquet")) <= 4
    assert lifecycle.compact(spark, path, "watch_date", ["network"], ["id"]) == {}


def test_z_value(spark):
    frame = spark.createDataFrame([(a, b) for a in range(4) for b in range(4)], "a int, b int")
    got = {(r.a, r.b): r.z for r in frame.select("a", "b", lifecycle.z_value([F.col("a"), F.col("b")], 2).alias("z")).collect()}
    assert got[(3, 0)] == 0b0101 and got[(0, 3)] == 0b1010 and sorted(got.values()) == list(range(16))


def test_change_tables_store_a_batch_once(spark, tmp_path):
    path = str(tmp_path / "changes")
    one = spark.createDataFrame([("a", 1, 10), ("b", 1, 10)], "k string, v int, at int")
    two = spark.createDataFrame([("a", 2, 20)], "k string, v int, at int")
    for batch, frame in ((1, one), (2, two), (2, two), (1, one)):
        lake.append_changes(frame, path, batch)
    assert spark.read.parquet(path).count() == 3
    assert rows(lake.latest_rows(spark.read.parquet(path), ["k"], [F.col("at")])) == [("a", 2, 20), ("b", 1, 10)]


def test_snapshots_carry_the_state_on(spark, tmp_path):
    changes, snapshots = str(tmp_path / "changes"), str(tmp_path / "snapshots")
    order = [F.col("at")]
    schema = "k string, v int, at int"
    for batch, data in enumerate(([("a", 1, 1), ("b", 1, 1)], [("a", 2, 2)], [("c", 3, 3), ("b", 0, 0)])):
        lake.append_changes(spark.createDataFrame(data, schema), changes, batch)
        if batch == 1:
            assert lake.write_snapshot(spark, changes, snapshots, ["k"], order) == 1
    want = [("a", 2, 2), ("b", 1, 1), ("c", 3, 3)]
    assert rows(lake.read_state(spark, changes, snapshots, ["k"], order)) == want
    assert rows(lake.latest_rows(spark.read.parquet(changes), ["k"], order)) == want
    assert lake.write_snapshot(spark, changes, snapshots, ["k"], order) == 2
    assert rows(lake.read_state(spark, changes, snapshots, ["k"], order)) == want


def test_erasure_in_the_fine_layout(spark, tmp_path):
    path = str(tmp_path / "fine")
    data = [("d1", "2024-01-01", "A#1", "x", 1), ("d2", "2024-01-01", "A#1", "y", 1), ("d1", "2024-01-01", "B", "x", 1), ("d2", "2024-01-02", "B", "x", 1)]
    frame = spark.createDataFrame(data, "device_id string, watch_date string, network string, genre string, duration_minutes int")
    lake.write_viewership(frame, path, partitions=lake.FINE_PARTITIONS)
    gone = spark.createDataFrame([("d1",)], "device_id string")
    assert privacy.erase_from_table(spark, path, gone, lake.FINE_PARTITIONS) == 2
    left = spark.read.parquet(path).select("device_id", "network", "genre")
    assert rows(left) == [("d2", "A#1", "y"), ("d2", "B", "x")]


def test_partition_values_must_be_folder_names(spark, tmp_path):
    path = str(tmp_path / "months")
    spark.createDataFrame([("d1", "01"), ("d2", "01")], "device_id string, month string").write.partitionBy("month").parquet(path)
    with pytest.raises(ValueError, match="folder names"):
        privacy.erase_from_table(spark, path, spark.createDataFrame([("d1",)], "device_id string"), "month")


def test_member_sets_replace_only_what_is_refreshed(spark, tmp_path):
    path = str(tmp_path / "members")
    first = spark.createDataFrame([("a", "d1"), ("b", "d1"), ("c", "d1")], "segment_id string, device_id string")
    files.write_members(first, path, now(), ["a", "b", "c"])
    second = spark.createDataFrame([("a", "d2"), ("c", "d9")], "segment_id string, device_id string")
    files.write_members(second, path, now(), ["a", "b"])
    got = rows(files.read_members(spark, path, now()).select("segment_id", "device_id"))
    assert got == [("a", "d2"), ("c", "d1")]
    late = F.lit("2024-03-02 01:00:00").cast("timestamp")
    assert files.read_members(spark, path, late).count() == 0


def test_requests_are_accepted_once_while_open(spark):
    schema = "id int, device_id string, request_type string, status string, requested_at int"
    old = spark.createDataFrame([(1, "d", "opt_out", "pending", 1), (2, "d", "opt_out", "completed", 0)], schema)
    new = spark.createDataFrame([(3, "d", "opt_out", "pending", 2), (4, "d", "erasure", "pending", 2)], schema)
    got = privacy.accept_requests(old, new)
    assert sorted(r.id for r in got.collect()) == [1, 2, 4]
    members = spark.createDataFrame([("s1", "d"), ("s2", "d"), ("s1", "e")], "segment_id string, device_id string")
    assert rows(privacy.remove_from_segments(members, got).select("segment_id", "device_id")) == [("s1", "e")]


def test_subject_report_needs_a_consent_record(spark):
    devices = spark.createDataFrame([("d1",), ("d2",)], "device_id string")
    consents = spark.createDataFrame([("d1", True, "US", 1)], "device_id string, opted_in boolean, jurisdiction string, consent_time bigint")
    views = spark.createDataFrame([("d2", 5, "2024-01-01")], "device_id string, duration_minutes bigint, watch_date string")
    members = spark.createDataFrame([("s", "d1")], "segment_id string, device_id string")
    got = privacy.subject_report(devices, consents, views, members).collect()
    assert [(r.device_id, r.views, r.segments) for r in got] == [("d1", 0, ["s"])]


def test_consent_records_and_state(spark, tmp_path):
    path = str(tmp_path / "consents")
    schema = "device_id string, opted_in boolean, consent_time bigint, jurisdiction string, tcf_string string, ip_address string"
    first = spark.createDataFrame([("d", None, 1, None, "not-valid-base64-!!!", "1.2.3.4")], schema)
    second = spark.createDataFrame([("d", False, 2, "US", None, None)], schema)
    privacy.record_consents(privacy.consent_records(first), path, 1)
    privacy.record_consents(privacy.consent_records(second), path, 2)
    record = privacy.consent_records(first).first()
    assert (record.opted_in, record.jurisdiction, record.ip_at_consent, record.purposes) == (True, "EU", "1.2.3.0", None)
    privacy.record_consents(privacy.consent_records(second), path, 2)
    state = privacy.current_consents(spark, path).first()
    assert (state.opted_in, state.jurisdiction) == (False, "US")
    # A record that comes late changes nothing, a refusal wins at the same time, and no device no record.
    late = spark.createDataFrame([("d", True, 0, None, None, None), ("e", True, 5, None, None, None), ("e", False, 5, None, None, None), (None, True, 9, None, None, None)], schema)
    privacy.record_consents(privacy.consent_records(late), path, 3)
    everyone = privacy.current_consents(spark, path)
    assert sorted((r.device_id, r.opted_in, r.consent_time) for r in everyone.collect()) == [("d", False, 2), ("e", False, 5)]
    asked = privacy.current_consents(spark, path, devices=spark.createDataFrame([("e",)], "device_id string"))
    assert [r.device_id for r in asked.collect() if r.device_id == "e"] == ["e"]
    assert privacy.valid_consents(privacy.consent_records(first)).count() == 0


def test_reports_exports_and_manifests(spark, tmp_path):
    payouts = spark.createDataFrame([("LG", 5, 10.0, 50.0), ("Sony", 5, 10.0, 50.0)], "manufacturer string, device_count bigint, revenue_share_usd double, percentage double")
    files.write_payout_reports(payouts, str(tmp_path / "p"), "2024-01")
    text = open(glob.glob(str(tmp_path / "p/payout_month=2024-01/manufacturer=LG/*.csv"))[0]).read()
    assert text.splitlines() == ["device_count,revenue_share_usd,percentage,maker", "5,10.00,50.00%,LG"]
    rows_ = spark.createDataFrame([("d", ["a", "b"])], "device_id string, segments array<string>")
    files.write_export(rows_, str(tmp_path / "j"), "json")
    assert spark.read.json(str(tmp_path / "j")).first().segments == ["a", "b"]
    with pytest.raises(ValueError):
        files.write_export(rows_, str(tmp_path / "x"), "xml")
    (tmp_path / "catalog.json").write_text('{"version": 1,\n "items": [{"content_id": "c1", "title": "t", "network": "n",\n "wav": "a.wav", "confidence": 1.0}]}')
    items = files.read_manifest(spark, str(tmp_path / "catalog.json"))
    (tmp_path / "two.json").write_text(
        '{"items": [{"content_id": "c2", "title": "x"},\n {"content_id": "c3"}]}\n\n{"items":\n [{"content_id": "c4"}]}\n{"items": []}')
    several = files.read_manifest(spark, str(tmp_path / "two.json"))
    assert sorted(r.content_id for r in several.collect()) == ["c2", "c3", "c4"]
    clips = spark.createDataFrame([("a.wav", 1500, "f" * 64)], "wav string, start_ms bigint, fingerprint_hash string")
    seeded = files.seed_references(items, clips).first()
    assert (seeded.content_id, seeded.genre, seeded.episode) == ("c1:1500", "unknown", None)


def test_manifests_with_braces_and_cut_documents(spark, tmp_path):
    path = tmp_path / "odd.json"
    path.write_text(
        '{"items":[{"content_id":"a","title":"{Live} {HD}"},{"content_id":"b"}]}\n'
        '{"items":[{"content_id":"c","title":"say \\"}\\" {x} {y\\\\"}]} {"items":[{"content_id":"d"}]}\n'
        '{"items":[{"content_id":"lost","title":"{a} {\n'
        '{"items":[\n{"content_id":"e"},\n{"content_id":"f","title":"} {"}\n]}\n'
        '{"items":[{"content_id":"lost too"},\n'
        '{"items":[{"content_id":"g"}]}\n'
        'no json at all')
    items = {r.content_id: r.title for r in files.read_manifest(spark, str(path)).collect()}
    assert items == {"a": "{Live} {HD}", "b": None, "c": 'say "}" {x} {y\\', "d": None, "e": None, "f": "} {", "g": None}
    broken = [r.value for r in files.read_broken_manifests(spark, str(path)).collect()]
    assert sum("lost" in v for v in broken) == 2 and sum("no json" in v for v in broken) <= 1
    empty = tmp_path / "empty.json"
    empty.write_text("")
    assert files.read_manifest(spark, str(empty)).count() == files.read_broken_manifests(spark, str(empty)).count() == 0


def test_dimensions(spark, tmp_path):
    spark.range(10).write.parquet(str(tmp_path / "dims/segments"))
    got = files.read_dimension(spark, str(tmp_path / "dims"), "segments", F.col("id") > 7)
    assert sorted(r.id for r in got.collect()) == [8, 9]
    assert "GreaterThan(id,7)" in got._jdf.queryExecution().executedPlan().toString()


def test_hash_lines(spark, tmp_path):
    (tmp_path / "h.txt").write_text(f"0 {'A' * 64}\n1500   {'b' * 64}\nbad line\n\n7 short\n")
    assert rows(files.read_hash_lines(spark, str(tmp_path / "h.txt"))) == [(0, "a" * 64), (1500, "b" * 64)]


def test_decoding(spark):
    good = '{"fingerprint_hash":"h","content_id":"c","title":"t","network":"n","airdate":"2024-01-02T03:04:05Z"}'
    cases = [good, '{"fingerprint_hash":"h"}', "poison{", good.replace("2024-01-02T03:04:05Z", "yesterday")]
    values = spark.createDataFrame([(c,) for c in cases], "value string")
    decoded, broken = streams.decode_lenient(values, streams.TOPICS["reference.content"])
    assert [r.value for r in broken.collect()] == ["poison{"]
    refs = streams.references_from(decoded).collect()
    assert [(r.genre, r.confidence, r.airdate is None) for r in refs] == [("unknown", 1.0, False), ("unknown", 1.0, True)]
    with pytest.raises(Exception):
        streams.decode_strict(values, streams.TOPICS["reference.content"]).collect()


def test_keyed_messages(spark, tmp_path):
    frame = spark.createDataFrame([("d%d" % (i % 3), i) for i in range(30)], "device_id string, n int")
    assert streams.keyed_messages(frame).filter("key = 'd1'").first().value.startswith('{"device_id":"d1"')
    streams.write_keyed(frame, str(tmp_path / "keyed"))
    per_key = spark.read.json(str(tmp_path / "keyed")).select("device_id", F.input_file_name().alias("f")).distinct()
    assert per_key.count() == 3


def tone(seconds, rate=16000, channels=1, base=300.0):
    t = np.arange(int(seconds * rate)) / rate
    x = sum(np.sin(2 * math.pi * base * k * t) / k for k in range(1, 8))
    x = (x / np.abs(x).max() * 20000).astype("<i2")
    buffer = io.BytesIO()
    with wave.open(buffer, "wb") as w:
        w.setnchannels(channels)
        w.setsampwidth(2)
        w.setframerate(rate)
        w.writeframes(np.repeat(x, channels).tobytes())
    return buffer.getvalue()


def test_wav_folder_to_fingerprints(spark, tmp_path):
    whole = tone(30)
    (tmp_path / "a.wav").write_bytes(whole)
    (tmp_path / "b.wav").write_bytes(tone(4, 44100, 2))
    (tmp_path / "c.wav").write_bytes(b"nothing")
    (tmp_path / "d.wav").write_bytes(tone(1))
    (tmp_path / "e.wav").write_bytes(whole[: 44 + 2 * 16000 * 4])
    windows = wav.read_windows(spark, str(tmp_path))
    prints = audio.fingerprint_windows(windows)
    counts = {os.path.basename(r[0]): r[1] for r in prints.groupBy("path").count().collect()}
    assert counts == {"a.wav": 19, "b.wav": 1, "e.wav": 1}
    problems = {os.path.basename(r.path): r.problem for r in windows.filter("problem is not null").collect()}
    assert problems == {"c.wav": "not a RIFF/WAVE file", "d.wav": "audio shorter than window"}
    again = audio.fingerprint_windows(wav.read_windows(spark, str(tmp_path)))
    assert rows(prints) == rows(again)
    mine = {r.start_ms: r.fingerprint_hash for r in prints.collect() if r.path.endswith("a.wav")}
    near = [(int(mine[s], 16) ^ int(mine[s + 1500], 16)).bit_count() for s in sorted(mine)[:-1]]
    assert max(near) < 90


def test_band_levels_against_plain_transform():
    rng = np.random.default_rng(2)
    pcm = (rng.normal(size=4096 + 2048) * 3000).astype("<i2")
    got = audio.band_levels(pcm.tobytes())
    edges = audio.band_edges()
    n = np.arange(4096)
    total = np.zeros(256)
    for first in (0, 2048):
        x = pcm[first:first + 4096] / 32768 * (0.5 * (1 - np.cos(2 * np.pi * n / 4095)))
        for b in range(256):
            e = sum(abs(np.dot(x, np.exp(-2j * np.pi * k * n / 4096))) ** 2 for k in range(edges[b], edges[b + 1]))
            total[b] += math.log(e + 1e-9)
    assert np.allclose(got[:256], total / 2, atol=1e-3) and got[256] == 0.0 and len(got) == 257
    assert audio.band_levels(b"\0\0") == []


def test_wav_downmix_and_resample():
    data = tone(1, 8000, 2)
    samples, rate = wav.parse_wav(data)
    assert rate == 8000 and len(samples) == 8000
    assert len(wav.resample(samples, rate)) == 16000
    odd = data[:36] + b"LIST" + struct.pack("<I", 3) + b"abc\0" + data[36:]
    assert np.array_equal(wav.parse_wav(odd)[0], samples)
    with pytest.raises(ValueError, match="16-bit"):
        wav.parse_wav(data[:34] + struct.pack("<H", 8) + data[36:])


def test_clip_starts(spark):
    got = spark.range(1).select(audio.clip_starts(F.lit(30000)).alias("a"), audio.clip_starts(F.lit(2999)).alias("b")).first()
    assert len(got.a) == 19 and got.b == []


def test_peaks(spark):
    cells = [("c", t, f, float((t * 7 + f * 13) % 11)) for t in range(6) for f in range(6)]
    cells[2 * 6 + 3] = ("c", 2, 3, 99.0)
    grid = {(t, f): a for _, t, f, a in cells}
    want = sorted((("c", t, f, grid[t, f]) for t in range(1, 5) for f in range(1, 5)
                   if all(grid[t, f] > grid[t + a, f + b] for a, b in ((0, 1), (0, -1), (1, 0), (-1, 0)))), key=repr)
    frame = spark.createDataFrame(cells, "clip_id string, t int, f int, amplitude double")
    assert rows(audio.spectral_peaks(frame)) == want
    assert [r.amplitude for r in audio.spectral_peaks(frame, limit=1).collect()] == [99.0]
