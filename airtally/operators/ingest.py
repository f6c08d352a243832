"""Checks on received fingerprints: format, time, network, consent, repeats."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from airtally.functions import hashes, identity, times
from airtally.plans import skew

MAX_BATCH = 100
TOLERANCE_SECONDS = 300
REPEAT_SECONDS = 60
# Networks of data centres and exit nodes.
DATACENTER_ASNS = (16509, 14061, 15169, 8075, 8068, 63949, 20473, 24940, 16276, 6697)
# A range table of this size is at most about 100 MB as a broadcast table.
BROADCAST_RANGES = 1_000_000


def batch_size_ok(batch: Column | str, limit: int = MAX_BATCH) -> Column:
    return F.coalesce(F.size(batch).between(1, limit), F.lit(False))


def accepted_batches(requests: DataFrame, limit: int = MAX_BATCH) -> DataFrame:
    return requests.filter(batch_size_ok("batch", limit))


def flatten_batches(requests: DataFrame) -> DataFrame:
    others = [c for c in requests.columns if c != "batch"]
    return requests.select(*others, F.inline("batch"))


def in_time(now: Column | str, timestamp: Column | str, unit: str = "s",
            tolerance: int = TOLERANCE_SECONDS) -> Column:
    """The event is at most `tolerance` seconds old and not from the future."""
    now_col = F.col(now) if isinstance(now, str) else now
    return F.coalesce(
        (now_col - times.seconds_of(timestamp, unit)).between(0, tolerance), F.lit(False)
    )


def with_asn(events: DataFrame, ranges: DataFrame, ip: str = "ip_address",
             spread: tuple[str, ...] = ("device_id", "timestamp_utc"),
             broadcast_ranges: int = BROADCAST_RANGES) -> DataFrame:
    """Adds the `asn` of an address, null for unknown or invalid ones.

    Ranges are cut at /16 borders, which turns the range join into an equal join on the
    block, one row of ranges per block. Of ranges that overlap the narrowest one counts
    (then the smallest number), so each event stays one row.
    """
    cut = ranges.select(
        F.explode(
            F.sequence(F.shiftright("lo", 16), F.shiftright("hi", 16))
        ).alias("_block"),
        F.struct("lo", "hi", "asn").alias("_range"),
    )
    numbered = events.withColumn("_ip", identity.ip_number(ip)).withColumn(
        "_block", F.shiftright("_ip", 16)
    )
    blocks = cut.groupBy("_block").agg(F.collect_list("_range").alias("_ranges"))
    if skew.is_small(ranges, broadcast_ranges):
        joined = numbered.join(F.broadcast(blocks), "_block", "left")
    else:
        joined = skew.salted_join(numbered, blocks, ["_block"], spread, "left")
    hits = F.filter("_ranges", lambda r: F.col("_ip").between(r["lo"], r["hi"]))
    narrowest = F.array_min(F.transform(
        hits, lambda r: F.struct((r["hi"] - r["lo"]).alias("width"), r["asn"].alias("asn"))))
    return joined.select(*events.columns, narrowest["asn"].alias("asn"))


def _mask(length: int) -> tuple[int, int]:
    """The first `length` of 128 bits as two signed 64-bit numbers."""
    bits = ((1 << length) - 1) << (128 - length)
    return tuple(n - (1 << 64) if n >> 63 else n for n in (bits >> 64, bits & ((1 << 64) - 1)))


def network_prefixes(prefixes: DataFrame) -> DataFrame:
    """(length, high, low, asn) of networks given as `prefix` (`10.0.0.0/8`, `2001:db8::/32`, or a single
    address) and `asn`. Bits behind the prefix do not count, invalid texts are left out, and of equal
    networks the smallest number stays."""
    parts = F.split("prefix", "/", -1)
    address, given = parts[0], F.try_element_at(parts, F.lit(2))
    four = F.instr(address, ":") == 0
    most = F.when(four, 32).otherwise(128)
    length = F.when(F.size(parts) == 1, most).otherwise(given.try_cast("int"))
    cut = prefixes.select(
        identity.ip_hex(address).alias("hex"), "asn",
        F.when((F.size(parts) <= 2) & length.between(0, most), length + F.when(four, 96).otherwise(0)).alias("length"),
    ).filter("hex IS NOT NULL AND length IS NOT NULL")
    high, low = hashes.lanes("hex", 128)
    ones = F.lit(-1).cast("bigint")
    in_high = F.when(F.col("length") == 0, 0).when(F.col("length") >= 64, ones).otherwise(
        F.call_function("shiftleft", ones, 64 - F.col("length")))
    in_low = F.when(F.col("length") <= 64, 0).otherwise(F.call_function("shiftleft", ones, 128 - F.col("length")))
    return cut.groupBy(
        "length", high.bitwiseAND(in_high).alias("high"), low.bitwiseAND(in_low).alias("low")
    ).agg(F.min("asn").alias("asn"))


def with_prefix_asn(events: DataFrame, prefixes: DataFrame, ip: str = "ip_address",
                    spread: tuple[str, ...] = ("device_id", "timestamp_utc"),
                    broadcast_ranges: int = BROADCAST_RANGES) -> DataFrame:
    """Adds the `asn` of the longest network that holds the address, IPv4 or IPv6; null for unknown and
    invalid addresses.

    There is one equal join per prefix length that occurs, on the address cut to it. Small tables are
    broadcast and the events stay where they are. Beyond that the distinct addresses are looked up, all
    lengths in one join, and the answer goes back to the events by address.
    """
    networks = network_prefixes(prefixes).persist()
    lengths = sorted((r[0] for r in networks.select("length").distinct().collect()), reverse=True)

    def cut_to(length: Column | int, bits: list[Column]) -> list[Column]:
        return [b.bitwiseAND(F.lit(m)) for b, m in zip(bits, _mask(length))]

    if skew.is_small(networks, broadcast_ranges):
        high, low = hashes.lanes("_hex", 128)
        out = events.withColumn("_hex", identity.ip_hex(ip)).withColumns({"_high": high, "_low": low})
        for length in lengths:
            at = networks.filter(F.col("length") == length).select(
                F.col("high").alias("_h"), F.col("low").alias("_l"), F.col("asn").alias(f"_asn{length}"))
            first, second = cut_to(length, [F.col("_high"), F.col("_low")])
            out = out.join(F.broadcast(at), (first == F.col("_h")) & (second == F.col("_l")), "left").drop("_h", "_l")
        asn = F.coalesce(*[F.col(f"_asn{n}") for n in lengths]) if lengths else F.lit(None)
        return out.select(*events.columns, asn.cast("bigint").alias("asn"))
    high, low = hashes.lanes("_hex", 128)
    asked = events.select(F.col(ip).alias("_ip")).distinct().withColumn("_hex", identity.ip_hex("_ip")).filter(
        "_hex IS NOT NULL").select("_ip", high.alias("_high"), low.alias("_low"))
    cuts = [F.struct(F.lit(n).alias("length"), first.alias("high"), second.alias("low"))
            for n in lengths for first, second in [cut_to(n, [F.col("_high"), F.col("_low")])]]
    cut = asked.select("_ip", F.inline(F.array(*cuts)))
    found = cut.join(networks, ["length", "high", "low"]).groupBy("_ip").agg(
        F.max_by("asn", "length").cast("bigint").alias("asn"))
    joined = skew.salted_join(events.withColumn("_ip", F.col(ip)), found, ["_ip"], spread, "left")
    return joined.select(*events.columns, "asn")


def is_datacenter(asn: Column | str) -> Column:
    col = F.col(asn) if isinstance(asn, str) else asn
    return F.coalesce(col.isin(*DATACENTER_ASNS), F.lit(False))


def drop_datacenters(events: DataFrame, ranges: DataFrame, **options) -> DataFrame:
    return with_asn(events, ranges, **options).filter(~is_datacenter("asn")).drop("asn")


def reject_reason(now: Column | str, unit: str = "s", tolerance: int = TOLERANCE_SECONDS,
                  asn: str | None = None) -> Column:
    """Name of the first check that fails, null for an event that passes all."""
    reason = (
        F.when(~hashes.is_hash("device_id"), "invalid_device_id")
        .when(~hashes.is_hash("fingerprint_hash"), "invalid_fingerprint_hash")
        .when(~in_time(now, "timestamp_utc", unit, tolerance), "timestamp_out_of_range")
    )
    return reason.when(is_datacenter(asn), "datacenter_network") if asn else reason


def validate(events: DataFrame, now: Column | str, ranges: DataFrame | None = None,
             unit: str = "s", tolerance: int = TOLERANCE_SECONDS,
             prefixes: DataFrame | None = None) -> DataFrame:
    """Adds `reject_reason`. Bad events are marked one by one, a batch is never lost. Networks come as
    IPv4 `ranges`, or as `prefixes` of both families."""
    if ranges is None and prefixes is None:
        return events.withColumn("reject_reason", reject_reason(now, unit, tolerance))
    located = with_asn(events, ranges) if prefixes is None else with_prefix_asn(events, prefixes)
    return located.withColumn(
        "reject_reason", reject_reason(now, unit, tolerance, "asn")
    ).drop("asn")


def accepted(validated: DataFrame) -> DataFrame:
    return validated.filter(F.col("reject_reason").isNull()).drop("reject_reason")


def rejections(validated: DataFrame) -> DataFrame:
    bad = validated.filter(F.col("reject_reason").isNotNull())
    return bad.groupBy("reject_reason").agg(F.count(F.lit(1)).alias("events"))


def ingest_totals(validated: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    ok = F.col("reject_reason").isNull()
    return validated.groupBy(*by).agg(
        F.count_if(ok).alias("processed"), F.count_if(~ok).alias("rejected")
    )


def latest_consents(consents: DataFrame, order: tuple[str, ...] = ("consent_time",)) -> DataFrame:
    """Last choice per device; of choices at the same time a refusal counts. The aggregate
    combines on the map side, so a device with very many records does not reach a
    single task in full."""
    others = [c for c in consents.columns if c != "device_id"]
    refusal = [(~F.col("opted_in")).alias("_refused")] if "opted_in" in others else []
    last = F.max_by(F.struct(*others), F.struct(*order, *refusal)).alias("last")
    return consents.groupBy("device_id").agg(last).select("device_id", "last.*")


def _agreed(events: DataFrame, consents: DataFrame, default_jurisdiction: str | None) -> DataFrame:
    """Adds `_agreed`: an opt-in in the EU and CA, no opt-out elsewhere."""
    named = "jurisdiction" in events.columns
    if not named and default_jurisdiction is None:
        raise ValueError("events without a jurisdiction need default_jurisdiction")
    recorded = "jurisdiction" in consents.columns
    choice = consents.select(
        "device_id", F.col("opted_in").alias("_opted_in"),
        (F.col("jurisdiction") if recorded else F.lit(None).cast("string")).alias("_recorded"))
    joined = events.join(choice, "device_id", "left")
    place = F.coalesce(
        F.col("jurisdiction") if named else F.lit(None), F.col("_recorded"), F.lit(default_jurisdiction))
    allowed = F.when(place.isin("EU", "CA"), F.col("_opted_in")).otherwise(
        F.coalesce("_opted_in", F.lit(True)))
    return joined.withColumn("_agreed", F.coalesce(allowed, F.lit(False)))


def with_consent_reason(validated: DataFrame, consents: DataFrame,
                        default_jurisdiction: str | None = None) -> DataFrame:
    """Rejects accepted events without consent, with the reason `no_consent`."""
    marked = _agreed(validated, consents, default_jurisdiction)
    reason = F.coalesce("reject_reason", F.when(~F.col("_agreed"), "no_consent"))
    others = [c for c in validated.columns if c != "reject_reason"]
    return marked.select(*others, reason.alias("reject_reason"))


def consent_filter(events: DataFrame, consents: DataFrame, mode: str = "jurisdiction",
                   default_jurisdiction: str | None = None) -> DataFrame:
    """Events that may be used.

    `opt_out` drops devices that opted out, `opt_in` keeps only devices that opted
    in, `jurisdiction` asks for an opt-in in the EU and CA and for no opt-out
    elsewhere. The place is the event's `jurisdiction`, else the one in the device's
    record, else `default_jurisdiction`; events without the column need that default, so
    that a device without a record is judged too. `consents` has one row per device.
    """
    if mode == "opt_out":
        refused = consents.filter(~F.col("opted_in")).select("device_id")
        return events.join(refused, "device_id", "left_anti")
    if mode == "opt_in":
        agreed = consents.filter(F.col("opted_in")).select("device_id")
        return events.join(agreed, "device_id", "left_semi")
    if mode == "jurisdiction":
        return _agreed(events, consents, default_jurisdiction).filter("_agreed").select(*events.columns)
    raise ValueError(f"unknown consent mode {mode!r}")


def drop_repeats(events: DataFrame, seconds: int = REPEAT_SECONDS, order: str = "event_id",
                 bucket_seconds: int = 3600) -> DataFrame:
    """Keeps an event when the same device sent the same hash at no time in the
    `seconds` before it.

    The gap is to the previous event, kept or not, so a steady stream of repeats
    keeps its first event only. Events of one second are one; after that a device's
    time line is cut into buckets, so one device never fills a task.
    """
    keys = ["device_id", "fingerprint_hash"]
    others = [c for c in events.columns if c not in (*keys, "timestamp_utc")]
    firsts = events.groupBy(*keys, "timestamp_utc").agg(
        F.min_by(F.struct(*others), F.col(order)).alias("_first")
    )
    placed = skew.with_halo(firsts, "timestamp_utc", max(bucket_seconds, seconds), seconds)
    line = W.partitionBy(*keys, "bucket").orderBy("timestamp_utc")
    gap = F.col("timestamp_utc") - F.lag("timestamp_utc").over(line)
    kept = placed.withColumn("_gap", gap).filter(
        ~F.col("halo") & (F.col("_gap").isNull() | (F.col("_gap") > seconds))
    )
    return kept.select(*keys, "timestamp_utc", "_first.*").select(*events.columns)


def over_limit(requests: DataFrame, key: str, at_ms: str, limit: int = 10_000,
               window_ms: int = 1000, bucket_ms: int = 60_000) -> DataFrame:
    """(key, at_ms, in_window) of each instant at which the requests of the last
    `window_ms` exceed the limit."""
    counts = requests.groupBy(key, at_ms).agg(F.count(F.lit(1)).alias("n"))
    placed = skew.with_halo(counts, at_ms, max(bucket_ms, window_ms), window_ms)
    line = W.partitionBy(key, "bucket").orderBy(at_ms).rangeBetween(-(window_ms - 1), 0)
    counted = placed.withColumn("in_window", F.sum("n").over(line))
    return counted.filter(~F.col("halo") & (F.col("in_window") > limit)).select(
        key, at_ms, "in_window"
    )


def over_limit_fixed(requests: DataFrame, key: str, at_ms: str, limit: int = 1000,
                     seconds: int = 60) -> DataFrame:
    """The same with fixed windows of whole seconds."""
    width = seconds * 1000
    start = F.col(at_ms) - F.pmod(F.col(at_ms), F.lit(width))
    counts = requests.groupBy(key, start.alias("window_start_ms")).agg(
        F.count(F.lit(1)).alias("in_window")
    )
    return counts.filter(F.col("in_window") > limit)
