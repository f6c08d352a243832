"""Queries over fingerprint matching."""

from __future__ import annotations

from pyspark.sql import functions as F

from airtally.functions import hashes, scoring
from airtally.operators import matching as m
from airtally.plans import domain as d
from airtally.plans.registry import query
from airtally.session import saved


def lane_sql(h: str, i: int) -> str:
    return f"CAST('0x' || substr({h}, {1 + 16 * i}, 16) AS UBIGINT)"


def lanes_sql(h: str, prefix: str, n: int = 4) -> str:
    return ", ".join(f"{lane_sql(h, i)} AS {prefix}{i}" for i in range(n))


def distance_sql(a: str, b: str, n: int = 4) -> str:
    return " + ".join(f"CAST(bit_count(xor({a}{i}, {b}{i})) AS INT)" for i in range(n))


def pairs_sql(tolerance: int, min_shared: int = 1, n: int = 4) -> str:
    """CTEs `pairs` by the band rule, from `q(h)` and `r(h)`."""
    bands = 8 * n
    return f""", qb AS (SELECT h, p AS band, substr(h, CAST(2 * p + 1 AS INT), 2) AS b FROM q, range({bands}) t(p)),
rb AS (SELECT h, p AS band, substr(h, CAST(2 * p + 1 AS INT), 2) AS b FROM r, range({bands}) t(p)),
shared AS (SELECT qb.h AS qh, rb.h AS rh FROM qb JOIN rb USING (band, b) GROUP BY 1, 2 HAVING count(*) >= {min_shared}),
ql AS (SELECT h, {lanes_sql('h', 'a', n)} FROM q), rl AS (SELECT h, {lanes_sql('h', 'b', n)} FROM r),
measured AS (SELECT qh, rh, {distance_sql('a', 'b', n)} AS distance
  FROM shared JOIN ql ON ql.h = qh JOIN rl ON rl.h = rh),
pairs AS (SELECT qh AS query_hash, rh AS fingerprint_hash, distance FROM measured WHERE distance <= {tolerance})"""


_QR = d.views("fingerprints", "reference_fingerprints") + """, q AS (SELECT DISTINCT fingerprint_hash AS h FROM fingerprints),
r AS (SELECT fingerprint_hash AS h FROM reference_fingerprints)"""
_BEST = """, best AS (SELECT query_hash, fingerprint_hash, distance FROM pairs
  QUALIFY row_number() OVER (PARTITION BY query_hash ORDER BY distance, fingerprint_hash) = 1)"""


@query("hamming_to_reference", d.views("fingerprints") + f""", l AS (
  SELECT event_id, {lanes_sql('fingerprint_hash', 'a')}, {lanes_sql("sha256('ref-' || k)", 'b')} FROM fingerprints)
SELECT event_id, {distance_sql('a', 'b')} AS distance FROM l""")
def hamming_to_reference(spark, sf):
    expected = F.sha2(F.concat(F.lit("ref-"), F.col("k")), 256)
    return d.fingerprints(spark, sf).select(
        "event_id", hashes.hamming("fingerprint_hash", expected).cast("int").alias("distance")
    )


@query("hash_bands", d.views("reference_fingerprints") + """
SELECT CAST(p AS INT) AS band_index, substr(fingerprint_hash, CAST(2 * p + 1 AS INT), 2) AS band_hash, count(*) AS hashes
FROM reference_fingerprints, range(32) t(p) GROUP BY 1, 2""")
def hash_bands(spark, sf):
    bands = m.band_table(d.reference_fingerprints(spark, sf))
    return bands.groupBy("band_index", "band_hash").agg(F.count(F.lit(1)).alias("hashes"))


@query("lsh_pairs", _QR + pairs_sql(65) + " SELECT * FROM pairs")
def lsh_pairs(spark, sf):
    return m.match_pairs(d.fingerprints(spark, sf), d.reference_fingerprints(spark, sf))


@query("lsh_pairs_tolerance_8", _QR + pairs_sql(8) + " SELECT * FROM pairs")
def lsh_pairs_tolerance_8(spark, sf):
    return m.match_pairs(d.fingerprints(spark, sf), d.reference_fingerprints(spark, sf), 8)


@query("lsh_pairs_two_bands", _QR + pairs_sql(65, 2) + " SELECT * FROM pairs")
def lsh_pairs_two_bands(spark, sf):
    return m.match_pairs(
        d.fingerprints(spark, sf), d.reference_fingerprints(spark, sf), min_shared_bands=2
    )


@query("lsh_pairs_shuffled", _QR + pairs_sql(65) + " SELECT * FROM pairs")
def lsh_pairs_shuffled(spark, sf):
    """The way taken when the references are too many to broadcast."""
    return m.match_pairs(
        d.fingerprints(spark, sf), d.reference_fingerprints(spark, sf),
        broadcast_references=0, rows_per_slice=20_000, references_per_list=64,
    )


@query("lsh_best_match", _QR + pairs_sql(65) + _BEST + """
SELECT b.query_hash, b.fingerprint_hash, b.distance, f.content_id, f.network
FROM best b JOIN reference_fingerprints f USING (fingerprint_hash)""")
def lsh_best_match(spark, sf):
    found = m.lookup(d.fingerprints(spark, sf), d.reference_fingerprints(spark, sf))
    return found.select("query_hash", "fingerprint_hash", "distance", "content_id", "network")


@query("lsh_ranked_matches", d.views("fingerprints", "content") + """, q AS (SELECT DISTINCT fingerprint_hash AS h FROM fingerprints),
r AS (SELECT substr(sha256('alt-' || k), 1, CAST(v * 3 AS INT)) || substr(sha256('ref-' || k), CAST(v * 3 + 1 AS INT)) AS h FROM content, range(3) t(v))"""
       + pairs_sql(65) + """
SELECT *, CAST(row_number() OVER (PARTITION BY query_hash ORDER BY distance, fingerprint_hash) AS INT) AS rank FROM pairs
QUALIFY row_number() OVER (PARTITION BY query_hash ORDER BY distance, fingerprint_hash) <= 2""")
def lsh_ranked_matches(spark, sf):
    """Three variants of each reference; the two nearest ones per query, in order."""
    hash_of = lambda tag: F.sha2(F.concat(F.lit(tag), F.col("k")), 256)
    variants = d.content(spark, sf).select("k", F.explode(F.sequence(F.lit(0), F.lit(2))).alias("v"))
    cut = F.col("v") * 3
    references = variants.select(
        F.concat(
            hash_of("alt-").substr(F.lit(1), cut), hash_of("ref-").substr(cut + 1, F.lit(64))
        ).alias("fingerprint_hash")
    )
    return m.ranked_matches(m.match_pairs(d.fingerprints(spark, sf), references), 2)


@query("exact_lookup", _QR + " SELECT q.h AS query_hash, r.h AS fingerprint_hash, 0 AS distance FROM q JOIN r ON q.h = r.h")
def exact_lookup(spark, sf):
    return m.exact_pairs(d.fingerprints(spark, sf), d.reference_fingerprints(spark, sf))


_MATCHED = _QR + pairs_sql(65) + _BEST + """, matched AS (
  SELECT f.*, b.distance, r2.content_id, r2.title, r2.network, r2.genre, r2.confidence
  FROM fingerprints f LEFT JOIN best b ON b.query_hash = f.fingerprint_hash
  LEFT JOIN reference_fingerprints r2 ON r2.fingerprint_hash = b.fingerprint_hash)"""


def matched(spark, sf):
    return m.match_events(d.fingerprints(spark, sf), d.reference_fingerprints(spark, sf))


@query("matched_viewership", _MATCHED + """
SELECT device_id, content_id, title, network, genre, timestamp_utc AS watch_start_utc, 0 AS duration_sec,
       manufacturer, model, ip_address FROM matched WHERE content_id IS NOT NULL""")
def matched_viewership(spark, sf):
    return m.viewership_events(matched(spark, sf)).drop("match_confidence")


@query("unmatched_fingerprints", _MATCHED + """
SELECT device_id, fingerprint_hash, timestamp_utc, manufacturer, model, ip_address FROM matched WHERE content_id IS NULL""")
def unmatched_fingerprints(spark, sf):
    return m.unmatched_events(matched(spark, sf))


@query("match_rate_by_manufacturer", _MATCHED + """
SELECT manufacturer, count(*) AS events, count(content_id) AS matches,
       round(avg(CASE WHEN content_id IS NULL THEN 0.0 ELSE 100.0 END), 4) AS match_rate FROM matched GROUP BY 1""")
def match_rate_by_manufacturer(spark, sf):
    from airtally.operators.alerts import match_rates

    rates = match_rates(matched(spark, sf), F.col("reference_hash").isNotNull())
    return rates.withColumn("match_rate", F.round("match_rate", 4))


@query("match_confidence_tiers", _MATCHED + """, tiers AS (
  SELECT CASE WHEN distance IS NULL THEN 'none' WHEN 1 - distance / 256.0 > 0.95 THEN 'exact'
              WHEN 1 - distance / 256.0 >= 0.85 THEN 'fuzzy' ELSE 'none' END AS tier FROM matched)
SELECT tier, count(*) AS matches, round(count(*) / CAST((SELECT count(*) FROM tiers) AS DOUBLE), 6) AS share FROM tiers GROUP BY 1""")
def match_confidence_tiers(spark, sf):
    scored = matched(spark, sf).withColumn("match_confidence", 1 - F.col("distance") / 256.0)
    return m.tier_shares(scored).withColumn("share", F.round("share", 6))


@query("match_recall", _QR + pairs_sql(65) + _BEST + f""", labelled AS (
  SELECT DISTINCT fingerprint_hash AS query_hash, sha256('ref-' || k) AS expected_hash FROM fingerprints WHERE event_type <> 'error'),
l AS (SELECT *, {lanes_sql('query_hash', 'a')}, {lanes_sql('expected_hash', 'b')} FROM labelled),
j AS (SELECT l.*, b.fingerprint_hash, ({distance_sql('a', 'b')}) <= 65 AS expected FROM l LEFT JOIN best b USING (query_hash)),
c AS (SELECT count(*) AS queries, count(*) FILTER (expected) AS within_tolerance,
       count(*) FILTER (expected AND fingerprint_hash = expected_hash) AS found,
       count(*) FILTER (fingerprint_hash <> expected_hash) AS false_matches FROM j)
SELECT *, round(found / CAST(within_tolerance AS DOUBLE), 6) AS recall, round(false_matches / CAST(queries AS DOUBLE), 6) AS false_match_rate FROM c""")
def match_recall(spark, sf):
    f = d.fingerprints(spark, sf)
    labelled = f.filter(F.col("event_type") != "error").select(
        F.col("fingerprint_hash").alias("query_hash"),
        F.sha2(F.concat(F.lit("ref-"), F.col("k")), 256).alias("expected_hash"),
    ).distinct()
    best = m.best_match(m.match_pairs(f, d.reference_fingerprints(spark, sf)))
    return m.recall(labelled, best).withColumns(
        {"recall": F.round("recall", 6), "false_match_rate": F.round("false_match_rate", 6)}
    )


# A hash with its first 0 to 15 digits inverted and the next 0 to 2 changed in one bit, and how far that is
# from the hash; both as text that Spark and DuckDB read alike.
_N, _M = "CAST(event_id % 17 AS INT)", "CAST(event_id % 3 AS INT)"
FLIPPED = (
    f"concat(translate(substr(fingerprint_hash, 1, {_N}), '0123456789abcdef', 'fedcba9876543210'), "
    f"translate(substr(fingerprint_hash, {_N} + 1, {_M}), '0123456789abcdef', '1032547698badcfe'), "
    f"substr(fingerprint_hash, {_N} + {_M} + 1))")
FLIPS = f"{_N} * 4 + {_M}"


@query("late_rematch", _QR + f""", late AS (SELECT * FROM fingerprints WHERE event_type = 'error'
    AND timestamp_utc >= (SELECT max(timestamp_utc) FROM fingerprints) - 86400)
SELECT event_id, CASE WHEN {FLIPS} <= 65 THEN 'c-n' || event_id END AS content_id,
  CASE WHEN {FLIPS} <= 65 THEN {FLIPS} END AS distance FROM late""")
def late_rematch(spark, sf):
    """Unmatched events of the last day find references that arrived afterwards, at distances of 0 to 65."""
    f = d.fingerprints(spark, sf)
    noise = f.filter(F.col("event_type") == "error")
    newer = noise.select(
        F.expr(FLIPPED).alias("fingerprint_hash"), F.concat(F.lit("c-n"), F.col("event_id")).alias("content_id"),
        F.lit(0.95).alias("confidence"),
    )
    now = f.agg(F.max("timestamp_utc")).first()[0]
    return m.rematch(noise, newer, F.lit(now)).select("event_id", "content_id", "distance")


@query("reference_totals", d.views("content") + """
SELECT network, count(*) AS total FROM content GROUP BY 1""")
def reference_totals(spark, sf):
    return m.count_by_network(d.reference_fingerprints(spark, sf))


@query("reference_count", d.views("content") + "SELECT count(*) AS total FROM content")
def reference_count(spark, sf):
    return m.count_references(d.reference_fingerprints(spark, sf))


@query("reference_upsert", """WITH writes AS (
  SELECT o_orderkey AS version, sha256('ref-' || (o_custkey % 500)) AS fingerprint_hash, 'c-' || o_custkey AS content_id FROM orders)
SELECT fingerprint_hash, content_id, version FROM writes
QUALIFY row_number() OVER (PARTITION BY fingerprint_hash ORDER BY version DESC) = 1""")
def reference_upsert(spark, sf):
    """Many writes per hash, the last one stays."""
    o = d.table(spark, sf, "orders")
    writes = o.select(
        F.col("o_orderkey").alias("version"),
        F.sha2(F.concat(F.lit("ref-"), F.col("o_custkey") % 500), 256).alias("fingerprint_hash"),
        F.concat(F.lit("c-"), F.col("o_custkey")).alias("content_id"),
    )
    return m.latest_references(writes, "version").select("fingerprint_hash", "content_id", "version")


_BITS = """, v AS (SELECT vec_id, embedding AS e FROM embeddings),
bits AS (SELECT vec_id, i, CASE WHEN i < 63 AND e[CAST(i + 1 AS INT)] > e[CAST(i + 2 AS INT)] THEN 1 ELSE 0 END AS bit FROM v, range(64) t(i)),
digits AS (SELECT vec_id, i // 4 AS n, sum(bit << CAST(3 - i % 4 AS INT)) AS value FROM bits GROUP BY 1, 2),
signs AS (SELECT vec_id, string_agg(substr('0123456789abcdef', CAST(value + 1 AS INT), 1), '' ORDER BY n) AS h FROM digits GROUP BY 1)"""


@query("sign_fingerprints", "WITH" + _BITS[1:] + " SELECT vec_id, h AS fingerprint_hash FROM signs")
def sign_fingerprints(spark, sf):
    e = d.table(spark, sf, "embeddings")
    return e.select("vec_id", hashes.sign_fingerprint("embedding").alias("fingerprint_hash"))


@query("sign_neighbours", "WITH" + _BITS[1:] + """, q AS (SELECT DISTINCT h FROM signs), r AS (SELECT DISTINCT h FROM signs)"""
       + pairs_sql(12, 1, 1) + " SELECT * FROM pairs")
def sign_neighbours(spark, sf):
    """Vectors of like shape: 64-bit sign hashes within 12 bits of each other."""
    signs = sign_fingerprints(spark, sf)
    return m.match_pairs(signs, signs.select("fingerprint_hash"), 12, bits=64)


@query("content_price", _MATCHED + """, sold AS (
  SELECT network, count(*) AS matches, avg(confidence) AS confidence FROM matched WHERE content_id IS NOT NULL GROUP BY 1)
SELECT network, matches, round(0.10 * confidence * (1 + matches / CAST((SELECT sum(matches) FROM sold) AS DOUBLE)) *
       CASE WHEN matches < (SELECT avg(matches) FROM sold) THEN 2.5 ELSE 1.0 END, 6) AS price FROM sold""")
def content_price(spark, sf):
    """Price per network: rarer networks cost more, wanted ones as well."""
    sold = (
        m.viewership_events(matched(spark, sf)).groupBy("network")
        .agg(F.count(F.lit(1)).alias("matches"),
             F.avg(F.col("match_confidence").cast("string").cast("double")).alias("confidence"))
    )
    # Read twice below; a row per network.
    sold = saved(sold, "sold")
    both = sold.agg(F.struct(F.sum("matches").alias("total"), F.avg("matches").alias("mean")).alias("all")).scalar()
    rarity = F.when(F.col("matches") < both["mean"], 2.5).otherwise(1.0)
    worth = scoring.price("confidence", 1 + F.col("matches") / both["total"], rarity)
    return sold.select("network", "matches", F.round(worth, 6).alias("price"))
