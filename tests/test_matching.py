import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from airtally.operators import blocks
from airtally.operators import matching as m
from tests.conftest import rows


def flip(h, bits):
    value = int(h, 16)
    for b in bits:
        value ^= 1 << b
    return "%064x" % value


def hash_frame(spark, hashes):
    return spark.createDataFrame([(h,) for h in hashes], "fingerprint_hash string")


@pytest.fixture(scope="module")
def data():
    rng = random.Random(11)
    refs = ["%064x" % rng.getrandbits(256) for _ in range(60)] + ["0" * 64, "0" * 62 + "0f"]
    queries = []
    for r in refs:
        for n in (0, 1, 5, 8, 9, 20, 31, 40, 65, 66, 90):
            queries.append(flip(r, rng.sample(range(256), n)))
    # Errors spread so that no byte is equal: 32 errors, one in each byte.
    queries.append(flip(refs[0], [8 * i for i in range(32)]))
    return queries, refs


def brute(queries, refs, tolerance, shared=1):
    out = []
    for q in set(queries):
        for r in set(refs):
            x = int(q, 16) ^ int(r, 16)
            same = sum(1 for i in range(32) if not x >> 8 * i & 255)
            if x.bit_count() <= tolerance and same >= shared:
                out.append((q, r, x.bit_count()))
    return sorted(out, key=repr)


@pytest.mark.parametrize("tolerance", [0, 1, 3, 8, 12, 20, 31, 32, 65, 100])
def test_pairs_equal_brute_force(spark, data, tolerance):
    q, r = hash_frame(spark, data[0] * 2), hash_frame(spark, data[1])
    assert rows(m.match_pairs(q, r, tolerance)) == brute(*data, tolerance)


@pytest.mark.parametrize("tolerance", [8, 65])
def test_shuffled_pairs_with_hot_pieces(spark, data, tolerance):
    q, r = hash_frame(spark, data[0]), hash_frame(spark, data[1])
    got = m.match_pairs(q, r, tolerance, broadcast_references=0, rows_per_slice=5, references_per_list=3)
    assert rows(got) == brute(*data, tolerance)


@pytest.mark.parametrize("shared", [2, 10])
def test_min_shared_bands(spark, data, shared):
    q, r = hash_frame(spark, data[0]), hash_frame(spark, data[1])
    assert rows(m.match_pairs(q, r, 65, min_shared_bands=shared)) == brute(*data, 65, shared)


def test_two_byte_bands_find_a_subset(spark, data):
    q, r = hash_frame(spark, data[0]), hash_frame(spark, data[1])
    wide = set(rows(m.match_pairs(q, r, 65, band_bytes=2)))
    assert wide < set(brute(*data, 65))


def test_no_equal_byte_is_no_candidate(spark, data):
    q, r = hash_frame(spark, data[0][-1:]), hash_frame(spark, data[1][:1])
    assert rows(m.match_pairs(q, r, 65)) == []


def test_best_match_breaks_ties_by_hash(spark):
    q = "0" * 64
    pairs = spark.createDataFrame([(q, "b" * 64, 3), (q, "a" * 64, 3), (q, "0" * 64, 9)],
                                  "query_hash string, fingerprint_hash string, distance int")
    assert rows(m.best_match(pairs)) == [(q, 3, "a" * 64)]
    ranked = m.ranked_matches(pairs, 2).orderBy("rank").collect()
    assert [r.fingerprint_hash[0] for r in ranked] == ["a", "b"]


EVENT = "device_id string, fingerprint_hash string, timestamp_utc bigint, manufacturer string, model string, ip_address string"
REF = "fingerprint_hash string, content_id string, title string, network string, genre string, confidence double"


def test_events_split_into_matched_and_unmatched(spark, data):
    ref = data[1][0]
    events = [("d%d" % i, flip(ref, range(3)).upper(), i, "m", "x", "1.1.1.1") for i in range(20)]
    events += [("e", "f" * 64, 1, "m", "x", None)]
    refs = spark.createDataFrame([(ref, "c1", None, "net", None, 1.2)], REF)
    out = m.match_events(spark.createDataFrame(events, EVENT), refs, 8, rows_per_slice=3)
    good, bad = m.viewership_events(out), m.unmatched_events(out)
    assert good.count() == 20 and bad.count() == 1
    first = good.first()
    assert (first.title, first.genre, first.match_confidence, first.duration_sec) == ("Unknown", "unknown", 1.0, 0)
    assert bad.first().fingerprint_hash == "f" * 64


def test_rematch_looks_back_24_hours(spark, data):
    ref = data[1][0]
    late = [("a", ref, 1000, "m", "x", None), ("b", ref, 100_000, "m", "x", None)]
    refs = spark.createDataFrame([(ref, "c1", "t", "n", "g", 1.0)], REF)
    out = m.rematch(spark.createDataFrame(late, EVENT), refs, F.lit(100_100))
    assert [r.device_id for r in out.collect()] == ["b"]


def test_upsert_is_idempotent(spark, data):
    refs = spark.createDataFrame(
        [("h1", "old", 1), ("h1", "new", 2), ("h2", "x", 1), ("h2", "x", 1)],
        "fingerprint_hash string, content_id string, version int")
    assert rows(m.latest_references(refs, "version").select("fingerprint_hash", "content_id")) == [("h1", "new"), ("h2", "x")]


def test_recall(spark, data):
    ref = data[1][0]
    near, far = flip(ref, range(4)), flip(ref, range(100))
    labelled = spark.createDataFrame([(near, ref), (far, ref)], "query_hash string, expected_hash string")
    found = spark.createDataFrame([(near, ref, 4)], "query_hash string, fingerprint_hash string, distance int")
    r = m.recall(labelled, found).first()
    assert (r.queries, r.within_tolerance, r.found, r.recall, r.false_match_rate) == (2, 1, 1, 1.0, 0.0)


def test_small_references_are_broadcast_and_queries_stay(spark, data):
    q, r = hash_frame(spark, data[0]), hash_frame(spark, data[1])
    plan = m.match_pairs(q, r)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "CartesianProduct" not in plan and "NestedLoop" not in plan


@pytest.mark.parametrize("sizes", [(1, 1), (7, 5), (10**6, 10**6)])
def test_many_references_meet_queries_in_blocks_without_broadcast(spark, data, sizes):
    q, r = hash_frame(spark, data[0]), hash_frame(spark, data[1])
    met = m.match_pairs(q, r, 65, broadcast_references=0, rows_per_slice=sizes[0], references_per_list=sizes[1])
    plan = met._jdf.queryExecution().executedPlan().toString()
    # A broadcast or a join on pieces holds every hash once per piece.
    assert "Broadcast" not in plan and "Join" not in plan
    assert rows(met) == brute(*data, 65)


@pytest.mark.parametrize("shared", [2, 10])
def test_min_shared_bands_in_blocks(spark, data, shared):
    q, r = hash_frame(spark, data[0]), hash_frame(spark, data[1])
    got = m.match_pairs(q, r, 65, min_shared_bands=shared, broadcast_references=0)
    assert rows(got) == brute(*data, 65, shared)


def test_blocks_with_a_hot_piece_and_no_rows(spark):
    rng = random.Random(3)
    refs = ["ab" + "%062x" % rng.getrandbits(248) for _ in range(300)]
    queries = [flip(r, rng.sample(range(240), n % 70)) for n, r in enumerate(refs)]
    q, r = hash_frame(spark, queries), hash_frame(spark, refs)
    options = {"broadcast_references": 0, "rows_per_slice": 50, "references_per_list": 100}
    assert rows(m.match_pairs(q, r, 65, **options)) == brute(queries, refs, 65)
    assert m.match_pairs(q.limit(0), r, 65, **options).count() == 0
    assert m.nearest(q, r.limit(0), 65, **{**options, "broadcast_references": -1}).count() == 0


def sha_frame(spark, rows, tag="ref-"):
    """Hashes whose size Spark knows, and takes for small."""
    return spark.range(rows).select(F.sha2(F.concat(F.lit(tag), "id"), 256).alias("fingerprint_hash"), "id")


def test_a_few_thousand_references_are_not_gathered_in_pieces(spark):
    """Their pieces, 32 times as many, would pass through the driver."""
    refs = sha_frame(spark, 3_000)
    queries = sha_frame(spark, 40).unionByName(sha_frame(spark, 10, "noise-")).select("fingerprint_hash")
    for met in (m.match_pairs(queries, refs), m.nearest(queries, refs)):
        plan = met._jdf.queryExecution().executedPlan().toString()
        assert "Broadcast" not in plan
        assert met.filter("distance = 0").count() == met.count() == 40


def test_many_references_are_not_broadcast_to_their_matches(spark):
    refs = sha_frame(spark, 3_000)
    found = m.lookup(sha_frame(spark, 40).select("fingerprint_hash"), refs, 8)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in plan and "SortMergeJoin" in plan
    assert sorted(r.id for r in found.collect()) == list(range(40))


def test_matches_are_not_broadcast_to_their_events(spark):
    """There is a match per distinct hash of the events, so it grows with them; only hot keys are broadcast."""
    refs = sha_frame(spark, 3_000).withColumnRenamed("id", "content_id")
    heard = sha_frame(spark, 40).unionByName(sha_frame(spark, 10, "noise-"))
    events = heard.withColumnRenamed("id", "timestamp_utc").withColumn("device_id", F.lit("d"))
    out = m.match_events(events, refs, 8)
    met = out.select("device_id", "timestamp_utc", "reference_hash")
    plan = met._jdf.queryExecution().executedPlan().toString()
    assert not re.search(r"Broadcast\w+Join \[query_hash#\d+, _slice#", plan)
    assert re.search(r"SortMergeJoin(\(skew=true\))? \[query_hash#\d+, _slice#", plan)
    assert out.count() == 50
    assert sorted(r.content_id for r in out.filter("reference_hash IS NOT NULL").collect()) == list(range(40))


def test_matches_are_not_broadcast_to_what_is_known_of_them(spark):
    hashes = sha_frame(spark, 100).select(F.col("fingerprint_hash").alias("query_hash"), "id")
    known = hashes.select("query_hash", F.col("query_hash").alias("expected_hash"))
    met = hashes.filter("id < 60").select("query_hash", F.col("query_hash").alias("fingerprint_hash"))
    out = m.recall(known, met)
    assert "Broadcast" not in out._jdf.queryExecution().executedPlan().toString()
    assert (out.first().queries, out.first().found) == (100, 60)


def random_lanes(seed, rows, lanes=4):
    return np.random.default_rng(seed).integers(0, 2**64, (lanes, rows), dtype=np.uint64)


@pytest.mark.parametrize("tolerance, lanes, size", [(65, 3, 22), (100, 3, 22), (104, 4, 32), (15, 3, 17), (130, 4, 32)])
def test_distances_by_a_product_of_matrices(tolerance, lanes, size):
    q, r = random_lanes(1, 500, lanes), random_lanes(2, 7_003, lanes)
    r[:, :200] = q[:, :200]
    r[0, 50:150] ^= np.uint64(2**40 - 1)
    r[:, 200] = ~q[:, 0]
    text = [np.ascontiguousarray(x.T).view(np.uint8)[:, :size] for x in (q, r)]
    apart = np.bitwise_count(text[0][:, None, :] ^ text[1][None, :, :]).sum(axis=2, dtype=np.int64)
    want = set(zip(*(x.tolist() for x in np.nonzero(apart <= tolerance))))
    got = [p for i, j in blocks._product(q, r, tolerance, size, blocks._room()) for p in zip(i.tolist(), j.tolist())]
    assert len(want) >= 100 and len(got) == len(want) and set(got) == want


def test_large_rectangles_are_a_product_of_matrices(monkeypatch):
    """The same pairs as pair by pair; the time of many queries and references lies in these."""
    asked, product = [], blocks._product
    monkeypatch.setattr(blocks, "_product", lambda a, b, *rest: asked.append(a.shape[1]) or product(a, b, *rest))
    r = random_lanes(3, 4_000)
    r[0] = r[0] >> np.uint64(8)
    q = r[:, :300] ^ np.uint64(2**12 - 1)
    met = [p for i, j in blocks.near_rows(q, r, 8, 65) for p in zip(i.tolist(), j.tolist())]
    assert asked == [300] and sorted(met) == [(n, n) for n in range(300)]


@pytest.fixture(scope="module")
def followed():
    """References, some near others, and queries at many distances from those that several of them follow."""
    rng = random.Random(7)
    refs = ["%064x" % rng.getrandbits(256) for _ in range(80)]
    refs += [flip(r, rng.sample(range(256), n)) for r in refs[:20] for n in (3, 30, 60, 90)] + [flip(refs[0], [1])]
    queries = [flip(r, rng.sample(range(256), n)) for r in refs[:40] for n in (0, 1, 15, 16, 30, 39, 40, 52, 53, 65, 66)]
    queries += [flip(refs[0], [1, 2]), flip(refs[0], [8 * i for i in range(32)])]
    return queries + ["%064x" % rng.getrandbits(256) for _ in range(30)], refs


@pytest.mark.parametrize("followers, sizes", [(1, (10**6, 10**6)), (4, (200, 90)), (10**6, (10**6, 10**6))])
def test_queries_that_follow_a_reference_meet_what_is_around_it(spark, followed, monkeypatch, followers, sizes):
    monkeypatch.setattr(blocks, "ANCHORED_PAIRS", 0)
    monkeypatch.setattr(blocks, "FOLLOWERS", followers)
    q, r = hash_frame(spark, followed[0]), hash_frame(spark, followed[1])
    options = {"broadcast_references": 0, "rows_per_slice": sizes[0], "references_per_list": sizes[1]}
    near = brute(*followed, 65)
    assert rows(m.match_pairs(q, r, 65, **options)) == near
    assert rows(m.match_pairs(q, r, 65, min_shared_bands=10, **options)) == brute(*followed, 65, 10)
    best = {}
    for query, ref, distance in near:
        best[query] = min(best.get(query, (257, "")), (distance, ref))
    assert rows(m.nearest(q, r, 65, **options)) == sorted(((k, *v) for k, v in best.items()), key=repr)


def test_followers_are_not_compared_with_all_that_share_a_byte(spark, followed, monkeypatch):
    """Among very many pairs only queries without a reference nearby meet all references by bytes."""
    seen, by_pieces = [], blocks._by_pieces

    def watched(queries, references, cut, width, *rest):
        seen.append((width, queries.count()))
        return by_pieces(queries, references, cut, width, *rest)

    monkeypatch.setattr(blocks, "ANCHORED_PAIRS", 0)
    monkeypatch.setattr(blocks, "FOLLOWERS", 2)
    monkeypatch.setattr(blocks, "_by_pieces", watched)
    q, r = hash_frame(spark, followed[0]), hash_frame(spark, followed[1])
    m.match_pairs(q, r, 65, broadcast_references=0).count()
    assert [w for w, _ in seen] == [16, 8] and seen[1][1] < seen[0][1] * 3 / 4


def test_a_block_is_one_task(spark):
    """By a hash of the block's number some tasks would have several blocks to do and others none."""
    refs = sha_frame(spark, 3_000)
    met = m.match_pairs(sha_frame(spark, 2_000).select("fingerprint_hash"), refs, rows_per_slice=250)
    plan = met._jdf.queryExecution().executedPlan().toString()
    assert "direct_shuffle_partition_id" in plan.lower() and "hashpartitioning(block" not in plan
    assert met.filter("distance = 0").count() == met.count() == 2_000
