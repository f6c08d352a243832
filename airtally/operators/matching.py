"""Fingerprint lookup: band candidates refined by Hamming distance."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from airtally.functions import hashes, scoring
from airtally.operators import blocks
from airtally.plans import skew
from airtally.session import saved

DEFAULT_TOLERANCE = 65
# 2,000 references are 64,000 pieces, some 4 MB as a broadcast table, which the driver gathers, hashes and
# sends anew for each step. Above that queries and references meet in blocks, and the driver sees neither.
BROADCAST_REFERENCES = 2_000
# A piece of up to this many bits is shared by a dozen references or more.
NARROW_BITS = 12
REFERENCES_PER_LIST = blocks.MOST_REFERENCES
# Tolerances tried before the asked one. At each of them the widest rule that loses
# nothing has pieces far wider than a band, so it meets few unrelated references.
STEPS = (0, 8, 15)
# Up to so many references a piece of 16 bits, that of the step at 15, is shared by a few dozen of them.
FEW_REFERENCES = 2_000_000


def band_table(references: DataFrame, band_bytes: int = 1) -> DataFrame:
    """(band_index, band_hash, fingerprint_hash), one row per band."""
    return references.select(
        F.inline(hashes.bands("fingerprint_hash", band_bytes)), "fingerprint_hash"
    )


def piece_width(tolerance: int, band_bytes: int, min_shared_bands: int, bits: int) -> int:
    """Bits of the pieces on which a pair has to agree.

    A pair within the tolerance that is smaller than the number of byte bands
    always shares a byte, so the band rule drops nothing and any other rule that
    drops nothing gives the same pairs. The widest such rule cuts the hash into
    one piece more than there may be errors: one piece stays free of errors.
    From that point on the bands themselves are the rule.
    """
    lanes = bits // hashes.LANE_BITS
    if band_bytes == 1 and min_shared_bands == 1 and tolerance < bits // 8:
        per_lane = max(2, -(-(tolerance + 1) // lanes))
        return hashes.LANE_BITS // per_lane
    return 8 * band_bytes


def _unique_lanes(frame: DataFrame, hash_column: str, prefix: str, bits: int, small: bool) -> DataFrame:
    """Distinct well-formed hashes as 64-bit lanes, which are half the size of hex. Those that meet in blocks are
    a table, since they are counted first."""
    well_formed = F.col(hash_column).rlike(f"^[0-9a-fA-F]{{{bits // 4}}}$")
    lanes = [c.alias(f"{prefix}{i}") for i, c in enumerate(hashes.lanes(hash_column, bits))]
    unique = frame.filter(well_formed).select(*lanes).distinct()
    return unique if small else saved(unique, "lanes")


def _pieces(lanes: DataFrame, width: int) -> DataFrame:
    columns = [F.col(c) for c in lanes.columns]
    return lanes.select(F.explode(hashes.pieces(columns, width)).alias("piece"), *columns)


def _spread(frame: DataFrame) -> DataFrame:
    """Many partitions for a stage whose work is in computing, not in bytes: sized by
    bytes, as AQE does, a few million hashes would be left to a few tasks."""
    spark = frame.sparkSession
    wanted = max(
        4 * spark.sparkContext.defaultParallelism,
        int(spark.conf.get("spark.sql.shuffle.partitions")),
    )
    return frame.repartition(wanted, *frame.columns)


def match_pairs(
    queries: DataFrame,
    references: DataFrame,
    tolerance: int = DEFAULT_TOLERANCE,
    band_bytes: int = 1,
    min_shared_bands: int = 1,
    bits: int = hashes.HASH_BITS,
    query_column: str = "fingerprint_hash",
    broadcast_references: int = BROADCAST_REFERENCES,
    rows_per_slice: int = skew.ROWS_PER_SLICE,
    references_per_list: int = REFERENCES_PER_LIST,
) -> DataFrame:
    """(query_hash, fingerprint_hash, distance) of all pairs within the tolerance
    that share at least `min_shared_bands` bands.

    Equal hashes are looked up once.
    """
    small = skew.is_small(references, broadcast_references)
    q = _unique_lanes(queries, query_column, "q", bits, small)
    r = _unique_lanes(references, "fingerprint_hash", "r", bits, small)
    q_lanes, r_lanes = [F.col(c) for c in q.columns], [F.col(c) for c in r.columns]
    pairs = _near_lanes(q, r, tolerance, band_bytes, min_shared_bands, bits, small, rows_per_slice,
                        references_per_list)
    if small:
        pairs = pairs.groupBy(*q_lanes, *r_lanes).agg(F.count(F.lit(1)).alias("shared_bands"))
        if min_shared_bands > 1:
            pairs = pairs.filter(F.col("shared_bands") >= min_shared_bands)
    return pairs.select(
        hashes.lanes_to_hex(q_lanes).alias("query_hash"),
        hashes.lanes_to_hex(r_lanes).alias("fingerprint_hash"),
        hashes.lane_distance(q_lanes, r_lanes).cast("int").alias("distance"),
    )


def _near_lanes(unique: DataFrame, references: DataFrame, tolerance: int, band_bytes: int, min_shared_bands: int,
                bits: int, small: bool, rows_per_slice: int, references_per_list: int) -> DataFrame:
    """Lanes of pairs within the tolerance, of distinct lanes on both sides.

    Candidates beyond the tolerance are dropped where they are found. A small reference
    table is broadcast and the queries stay where they are; narrow pieces, which many
    references share, then come as one list per piece, and a pair comes once per piece that
    it shares. Otherwise both sides meet in blocks, and a pair comes once.
    """
    width = piece_width(tolerance, band_bytes, min_shared_bands, bits)
    if not small:
        return blocks.near(unique, references, width, tolerance, min_shared_bands, rows_per_slice, references_per_list)
    q_lanes, r_lanes = [F.col(c) for c in unique.columns], [F.col(c) for c in references.columns]
    r = _pieces(references, width)
    distance = hashes.lane_distance(q_lanes, r_lanes)
    q = _pieces(_spread(unique), width)
    if width <= NARROW_BITS:
        lists = r.groupBy("piece").agg(F.collect_list(F.struct(*r_lanes)).alias("found"))
        near = q.join(F.broadcast(lists), "piece").select(*q_lanes, F.inline("found"))
    else:
        near = q.join(F.broadcast(r), "piece")
    return near.filter(distance <= tolerance)


def best_match(pairs: DataFrame) -> DataFrame:
    """Nearest reference per query; equal distances go to the smaller hash."""
    return (
        pairs.groupBy("query_hash")
        .agg(F.min(F.struct("distance", "fingerprint_hash")).alias("best"))
        .select("query_hash", "best.distance", "best.fingerprint_hash")
    )


def _steps(references: DataFrame, tolerance: int, bits: int, few: int = FEW_REFERENCES) -> list[int]:
    """Tolerances to try in turn. The widest step that loses nothing settles all that narrower ones do; only
    among very many references are its pieces shared so widely that narrower steps pay."""
    wanted = [15] if skew.is_small(references, few) else STEPS
    return [s for s in wanted if s < tolerance and (s == 0 or s < bits // 8)] + [tolerance]


def nearest(queries: DataFrame, references: DataFrame, tolerance: int = DEFAULT_TOLERANCE,
            query_column: str = "fingerprint_hash", bits: int = hashes.HASH_BITS,
            broadcast_references: int = BROADCAST_REFERENCES,
            rows_per_slice: int = skew.ROWS_PER_SLICE,
            references_per_list: int = REFERENCES_PER_LIST, few_references: int = FEW_REFERENCES) -> DataFrame:
    """Nearest reference per query hash, as `best_match` of all pairs gives it.

    The tolerance rises in steps, each over the hashes that are left. A step that loses
    nothing finds the nearest reference if there is one within its tolerance, so only
    hashes without any near reference reach the wide rule; among very many pairs also few of those do that follow
    a reference farther off. Hashes stay 64-bit lanes until the end. What a
    step finds and leaves is one table; the minimum is taken in the join's own aggregate.
    """
    small = skew.is_small(references, broadcast_references)
    refs = _unique_lanes(references, "fingerprint_hash", "r", bits, small)
    left = _unique_lanes(queries, query_column, "q", bits, small)
    q, r = [F.col(c) for c in left.columns], [F.col(c) for c in refs.columns]
    # Lanes order as the hex text does once their sign is turned.
    smaller = F.struct(*[c.bitwiseXOR(F.lit(-(1 << 63))) for c in r])
    pair = F.struct(
        hashes.lane_distance(q, r).cast("int").alias("distance"), smaller.alias("order"), F.struct(*r).alias("hash"))
    found: list[DataFrame] = []
    steps = _steps(references, tolerance, bits, few_references)
    if not small and blocks.anchors_pay(
            left, left.count() * refs.count(), piece_width(tolerance, 1, 1, bits), tolerance):
        # One probe settles all steps but the last one, and names a nearby reference for that.
        probed = blocks.probe(left, refs, tolerance, rows_per_slice, references_per_list)
        settled = F.coalesce(F.col("off") < blocks.PROBE_BITS, F.lit(False))
        found.append(probed.filter(settled).select(*q, pair.alias("best")))
        met = blocks.near_after(
            probed.filter(~settled), refs, tolerance, 1, rows_per_slice, references_per_list, True)
        found.append(met.select(*q, pair.alias("pair")).groupBy(*q).agg(F.min("pair").alias("best")))
        steps = []
    for step in steps:
        near = _near_lanes(left, refs, step, 1, 1, bits, small, rows_per_slice, references_per_list)
        met = near.select(*q, pair.alias("pair"))
        if step == tolerance:
            found.append(met.groupBy(*q).agg(F.min("pair").alias("best")))
            break
        alone = left.select(*q, F.lit(None).cast(met.schema["pair"].dataType).alias("pair"))
        settled = saved(met.unionByName(alone).groupBy(*q).agg(F.min("pair").alias("best")), "lookup")
        found.append(settled.filter(F.col("best").isNotNull()))
        left = settled.filter(F.col("best").isNull()).select(*q)
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    best = [F.col(f"best.hash.{c}") for c in refs.columns]
    return out.select(
        hashes.lanes_to_hex(q).alias("query_hash"), F.col("best.distance").alias("distance"),
        hashes.lanes_to_hex(best).alias("fingerprint_hash"))


def ranked_matches(pairs: DataFrame, limit: int | None = None) -> DataFrame:
    """Matches of each query numbered from the nearest on, at most `limit` of them."""
    line = W.partitionBy("query_hash").orderBy("distance", "fingerprint_hash")
    ranked = pairs.withColumn("rank", F.row_number().over(line))
    return ranked if limit is None else ranked.filter(F.col("rank") <= limit)


def exact_pairs(queries: DataFrame, references: DataFrame, query_column: str = "fingerprint_hash"):
    """Equal hashes, at distance 0: the lookup of last resort."""
    q = queries.select(F.lower(query_column).alias("query_hash")).distinct()
    r = references.select(F.lower("fingerprint_hash").alias("query_hash")).distinct().withColumn(
        "fingerprint_hash", F.col("query_hash"))
    return q.join(r, "query_hash").select("query_hash", "fingerprint_hash", F.lit(0).alias("distance"))


def latest_references(references: DataFrame, version: str) -> DataFrame:
    """One row per hash, the last written one; of equal versions the largest row."""
    others = [c for c in references.columns if c != "fingerprint_hash"]
    last = F.max_by(F.struct(*others), F.struct(version, *others)).alias("last")
    return references.groupBy("fingerprint_hash").agg(last).select("fingerprint_hash", "last.*")


def lookup(
    queries: DataFrame, references: DataFrame, tolerance: int = DEFAULT_TOLERANCE, **options
) -> DataFrame:
    """Best match of every query hash with the content it stands for. A hash that is
    stored more than once, in either case, stands for the smallest of its rows."""
    if {"band_bytes", "min_shared_bands"} & set(options):
        best = best_match(match_pairs(queries, references, tolerance, **options))
    else:
        best = nearest(queries, references, tolerance, **options)
    others = [c for c in references.columns if c != "fingerprint_hash"]
    meta = references.groupBy(F.lower("fingerprint_hash").alias("fingerprint_hash")).agg(
        F.min(F.struct(*others)).alias("row")).select("fingerprint_hash", "row.*")
    # The size of its files says little of the size of the rows, so Spark would gather many of them in the driver.
    small = skew.is_small(references, options.get("broadcast_references", BROADCAST_REFERENCES))
    return best.join(meta if small else meta.hint("merge"), "fingerprint_hash")


def match_events(
    events: DataFrame,
    references: DataFrame,
    tolerance: int = DEFAULT_TOLERANCE,
    spread: tuple[str, ...] = ("device_id", "timestamp_utc"),
    rows_per_slice: int = skew.ROWS_PER_SLICE,
    **options,
) -> DataFrame:
    """All events, with the columns of their match or nulls.

    Many devices send the same hash when they watch the same thing, so the way
    back from hashes to events is a join with hot keys.
    """
    found = lookup(events, references, tolerance, **options).withColumnRenamed(
        "fingerprint_hash", "reference_hash"
    )
    keyed = events.withColumn("query_hash", F.lower("fingerprint_hash"))
    joined = skew.salted_join(keyed, found, ["query_hash"], spread, "left", rows_per_slice)
    return joined.drop("query_hash")


def viewership_events(matched: DataFrame) -> DataFrame:
    """Matched events as viewership events; the duration is not known yet."""
    return matched.filter(F.col("reference_hash").isNotNull()).select(
        "device_id",
        scoring.or_unknown("content_id").alias("content_id"),
        scoring.or_unknown("title", "Unknown").alias("title"),
        scoring.or_unknown("network").alias("network"),
        scoring.or_unknown("genre").alias("genre"),
        scoring.match_confidence("confidence").cast("float").alias("match_confidence"),
        F.col("timestamp_utc").alias("watch_start_utc"),
        F.lit(0).alias("duration_sec"),
        "manufacturer", "model", "ip_address",
    )


def unmatched_events(matched: DataFrame) -> DataFrame:
    return matched.filter(F.col("reference_hash").isNull()).select(
        "device_id", "fingerprint_hash", "timestamp_utc", "manufacturer", "model", "ip_address"
    )


def rematch(
    unmatched: DataFrame,
    references: DataFrame,
    now: Column,
    hours: int = 24,
    tolerance: int = DEFAULT_TOLERANCE,
    **options,
) -> DataFrame:
    """Second try for events of the last hours against a newer reference table."""
    recent = unmatched.filter(F.col("timestamp_utc") >= now - hours * 3600)
    return match_events(recent, references, tolerance, **options)


def count_references(references: DataFrame) -> DataFrame:
    return references.agg(F.count(F.lit(1)).alias("total"))


def count_by_network(references: DataFrame) -> DataFrame:
    return references.groupBy("network").agg(F.count(F.lit(1)).alias("total"))


def tier_shares(matches: DataFrame, confidence: str = "match_confidence") -> DataFrame:
    """Share of exact, fuzzy and unmatched among all events."""
    tiers = matches.groupBy(scoring.confidence_tier(confidence).alias("tier")).agg(
        F.count(F.lit(1)).alias("matches")
    )
    # At most three rows by now, so one task for the total is no matter.
    return tiers.withColumn("share", F.col("matches") / F.sum("matches").over(W.partitionBy()))


def recall(labelled: DataFrame, matches: DataFrame, tolerance: int = DEFAULT_TOLERANCE) -> DataFrame:
    """How well the lookup finds the reference that is known to be the right one.

    `labelled` holds (query_hash, expected_hash), `matches` the best match. A pair
    beyond the tolerance is not expected to be found.
    """
    expected = hashes.hamming("query_hash", "expected_hash") <= tolerance
    found = F.col("fingerprint_hash") == F.col("expected_hash")
    # Both have a row per query, so neither is a table to broadcast, whatever its files weigh.
    joined = labelled.join(matches.hint("merge"), "query_hash", "left")
    counted = joined.agg(
        F.count(F.lit(1)).alias("queries"),
        F.count_if(expected).alias("within_tolerance"),
        F.count_if(expected & found).alias("found"),
        F.count_if(F.col("fingerprint_hash").isNotNull() & ~found).alias("false_matches"),
    )
    return counted.withColumns(
        {
            "recall": scoring.ratio_or_zero(F.col("found"), F.col("within_tolerance")),
            "false_match_rate": scoring.ratio_or_zero(F.col("false_matches"), F.col("queries")),
        }
    )
