"""Steps that grow with the tables: what is broadcast, what one task reads, what runs twice."""

import glob
import re

import pytest
from pyspark.sql import functions as F

from airtally.plans import all_queries, domain
from airtally.plans import queries_streaming as qst
from airtally.sources import buckets
from airtally.streaming import jobs
from tests.conftest import rows


def test_large_tables_are_not_broadcast_to_the_events(spark, sf, monkeypatch):
    small = rows(domain.viewership(spark, sf))
    monkeypatch.setattr(domain, "BROADCAST_ROWS", 0)
    large = domain.viewership(spark, sf)
    plan = large._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in plan and plan.count("SortMergeJoin") >= 2
    assert rows(large) == small


def test_a_large_bucket_is_written_by_several_tasks(spark, tmp_path):
    path, key = str(tmp_path / "b"), F.sha2(F.col("id").cast("string"), 256).alias("k")
    name = "spark.sql.adaptive.advisoryPartitionSizeInBytes"
    before = spark.conf.get(name)
    spark.conf.set(name, "64KB")
    try:
        buckets.write(spark.range(0, 20_000, 1, 4).select(key), path, [0], 0, "k", 1)
    finally:
        spark.conf.set(name, before)
    assert len(glob.glob(f"{path}/bucket=0/batch_id=0/*.parquet")) > 1
    assert buckets.read(spark, path, "k string", [0], 1, "k").distinct().count() == 20_000


def test_frames_in_turn_are_one_batch_each_however_many_files(spark):
    seen = []
    parts = (spark.range(n * 100, n * 100 + 40, 1, 4) for n in range(3))
    qst.drain_in_turn(spark, parts, lambda b, i: seen.append((i, sorted(r.id for r in b.collect()))), "turns")
    assert seen == [(n, list(range(n * 100, n * 100 + 40))) for n in range(3)]


def test_restart_does_not_run_a_batch_a_second_time(spark, sf, monkeypatch):
    def refuse(self):
        raise AssertionError("the batch's state runs twice")

    monkeypatch.setattr(type(spark.range(1)), "isEmpty", refuse)
    assert all_queries()["stream_restart"](spark, sf).count() > 0


def test_restart_of_events_without_a_pause_sends_no_session(spark, tmp_path):
    """At sizes where each manufacturer sends all the time, no session ends and nothing is written."""
    events = spark.range(400).select(
        F.col("id").alias("event_id"), F.timestamp_seconds(F.lit(1704067200) + F.col("id")).alias("ts"),
        F.col("id").alias("user_id"), F.lit("view").alias("event_type"), F.lit(1.0).alias("value"),
        F.lit('{"k": 1}').alias("props"))
    events.write.parquet(f"{tmp_path}/events.parquet")
    found = all_queries()["stream_restart"](spark, str(tmp_path))
    assert found.columns == ["manufacturer", "session_start", "session_end", "events", "duration_sec"]
    assert found.count() == 0


@pytest.mark.parametrize("name", ["content_price"])
def test_matches_that_are_read_twice_are_a_table(spark, sf, name):
    found = all_queries()[name](spark, sf)
    assert any("/sold-" in f for f in found.inputFiles())


def met_by_shuffle(frame):
    """How events meet the matches of their hashes; the text of a plan names the keys of each join."""
    plan = frame._jdf.queryExecution().executedPlan().toString()
    return set(re.findall(r"(\w+Join)(?:\(skew=true\))? \[query_hash#\d+, _slice#", plan)) == {"SortMergeJoin"}


@pytest.mark.parametrize("name", [
    "match_confidence_tiers",
    "match_rate_by_manufacturer",
    "matched_viewership",
])
def test_matches_meet_their_events_in_a_shuffle(spark, sf, name):
    assert met_by_shuffle(all_queries()[name](spark, sf))


def test_matches_of_a_batch_meet_its_events_in_a_shuffle(spark, sf, monkeypatch):
    met, write = [], jobs.write_batch

    def watched(frame, *rest):
        met.append(met_by_shuffle(frame))
        write(frame, *rest)

    monkeypatch.setattr(jobs, "write_batch", watched)
    assert all_queries()["stream_match"](spark, sf).count() > 0
    assert met and all(met)
