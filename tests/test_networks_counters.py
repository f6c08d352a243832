import ipaddress
import random

import pytest
from pyspark.sql import functions as F

from airtally.functions import identity
from airtally.operators import alerts, ingest
from airtally.operators import segments as sg
from tests.conftest import rows

ODD = ["10.0.4.5", "::ffff:10.0.4.5", "2001:DB8::1", "::", "1::2::3", "::1", "1:2:3:4:5:6:7:8", "1:2:3:4:5:6:7::",
       "1:2:3:4:5:6:7:8:9", "10.0.0.256", "1:2", "::ffff:300.1.1.1", None, "", ":", ":::", "1:::2", "::1:2:3:4:5:6:7:8",
       "12345::", "g::", "1:2:3:4:5:6:1.2.3.4", "::1.2.3.4", "1.2.3", "fe80::1%eth0", "::ffff:1.2.3.4:5"]


def bits(text):
    try:
        address = ipaddress.ip_address(text)
    except ValueError:
        return None
    return int(address) + (0xFFFF << 32 if address.version == 4 else 0)


def test_addresses_of_both_families(spark):
    frame = spark.createDataFrame([(t,) for t in ODD], "ip string").select("ip", identity.ip_hex("ip").alias("h"))
    for ip, found in frame.collect():
        expected = bits(ip) if ip and "%" not in ip else None
        assert found == (None if expected is None else f"{expected:032x}"), ip


@pytest.mark.parametrize("broadcast", [0, 1_000_000])
def test_longest_prefix_counts(spark, broadcast):
    rnd = random.Random(2)

    def address():
        if rnd.random() < 0.5:
            return str(ipaddress.IPv4Address(rnd.choice([0x0A000000, 0x0A010000]) + rnd.randrange(512)))
        return str(ipaddress.IPv6Address((0x20010DB8 << 96) + (rnd.randrange(4) << 62) + rnd.randrange(8)))

    prefixes = [(f"{a}/{rnd.choice([0, 8, 24, 31, 32] if '.' in a else [0, 33, 64, 65, 127, 128])}", n)
                for n, a in enumerate(address() for _ in range(40))]
    prefixes += [("10.0.0.0/33", 1), ("x/8", 2), ("10.0.0.1", 77), ("10.0.0.1/32", 78), ("10.0.0.0/8/9", 3), (None, 4)]
    networks = []
    for text, asn in prefixes:
        try:
            net = ipaddress.ip_network(text, strict=False)
        except ValueError:
            continue
        if text:
            networks.append((net.prefixlen + (96 if net.version == 4 else 0), bits(str(net.network_address)), asn))
    events = [(i, address(), "d", i) for i in range(200)] + [(900, None, "d", 0), (901, "none", "d", 0), (902, "::ffff:10.0.0.1", "d", 0)]
    out = ingest.with_prefix_asn(
        spark.createDataFrame(events, "event_id int, ip_address string, device_id string, timestamp_utc int"),
        spark.createDataFrame(prefixes, "prefix string, asn bigint"), broadcast_ranges=broadcast)
    for event in out.collect():
        number = bits(event.ip_address) if event.ip_address else None
        hits = [] if number is None else [(-n, asn) for n, start, asn in networks if number >> (128 - n) == start >> (128 - n)]
        assert event.asn == (min(hits)[1] if hits else None), event


def plain_rate(samples, at, window):
    inside = sorted(s for s in samples if at - window < s[0] <= at)
    if len(inside) < 2:
        return None
    grown = inside[-1][1] - inside[0][1] + sum(a[1] for a, b in zip(inside, inside[1:]) if b[1] < a[1])
    span = inside[-1][0] - inside[0][0]
    mean = span / (len(inside) - 1)
    start, end = inside[0][0] - (at - window), at - inside[-1][0]
    start = mean / 2 if start >= mean * 1.1 else start
    if grown > 0:
        start = min(start, span * inside[0][1] / grown)
    end = mean / 2 if end >= mean * 1.1 else end
    return grown * (span + start + end) / span / window


@pytest.mark.parametrize("every", [100, 300])
def test_rates_of_counters_that_restart(spark, every):
    rnd = random.Random(3)
    samples = []
    for key in "ab":
        value = 0.0
        for t in sorted(rnd.sample(range(1, 5000), 120)):
            value = 0.0 if rnd.random() < 0.1 else value + rnd.randrange(9)
            samples.append((key, t, value))
    frame = spark.createDataFrame(samples, "key string, at int, value double")
    out = alerts.counter_rates(frame, ["key"], "at", "value", 300, every, bucket_seconds=700)
    got = {(r.key, r.at): r.per_second for r in out.collect()}
    expected = {(k, at): plain_rate([s[1:] for s in samples if s[0] == k], at, 300)
                for k in "ab" for at in range(0, 5400, every)}
    assert got == {k: pytest.approx(v) for k, v in expected.items() if v is not None}


def test_quantiles_of_buckets(spark):
    data = [("a", "1", 2.0), ("a", "2", 8.0), ("a", "4", 9.0), ("a", "+Inf", 10.0), ("b", "1", 5.0), ("c", "1", 0.0),
            ("c", "+Inf", 0.0), ("d", "1", 4.0), ("d", "2", 3.0), ("d", "+Inf", 4.0), ("e", "-1", 3.0), ("e", "+Inf", 4.0)]
    out = alerts.bucket_quantiles(
        spark.createDataFrame(data, "k string, le string, value double"), ["k"], (0.1, 0.5, 0.95))
    got = {(r.k, r.quantile): r.estimate for r in out.collect()}
    assert [got["a", q] for q in (0.1, 0.5, 0.95)] == pytest.approx([0.5, 1.5, 4.0])
    assert [got["b", 0.5], got["c", 0.5]] == [None, None]
    assert got["d", 0.95] == pytest.approx(0.95) and got["e", 0.1] == -1 and got["e", 0.95] == -1


def test_daily_sketches_give_sizes_of_any_span(spark):
    views = spark.range(40_000).select(
        (F.col("id") % 20_000).cast("string").alias("device_id"), F.lit("h").alias("household_id"),
        F.when(F.col("id") % 3 == 0, "news").otherwise("drama").alias("genre"), F.lit("n").alias("network"),
        F.when(F.col("id") % 2 == 0, "morning").otherwise("night").alias("daypart"), F.lit("1").alias("dma_code"),
        F.lit(1).alias("household_income"), F.expr("date_add(DATE '2024-01-01', cast(id % 10 as int))").alias("viewing_date"))
    defs = [sg.Segment("news", "news", (sg.Rule("watched_genre", ("news",)),)),
            sg.Segment("morning", "morning", (sg.Rule("daypart", ("morning",)),)),
            sg.Segment("none", "none", (sg.Rule("dma", ("9",)),))]
    as_of = F.lit("2024-01-10").cast("date")
    for lg in (10, 16):
        spans = sg.span_sketches(sg.daily_sketches(views, defs, lg), as_of, 4, lg)
        recent = views.filter("viewing_date >= DATE '2024-01-06'")
        exact = {k: recent.filter(c).select("device_id").distinct() for k, c in
                 (("news", "genre = 'news'"), ("morning", "daypart = 'morning'"))}
        error = 0 if lg == 16 else 4 / 2 ** (lg / 2)
        for segment, members in sg.sketched_sizes(spans).collect():
            assert members == pytest.approx(exact[segment].count(), rel=error)
        union, both = sg.sketched_overlap(spans, ("news", "morning"), lg).first()
        size = exact["news"].union(exact["morning"]).distinct().count()
        assert union == pytest.approx(size, rel=error)
        assert both == pytest.approx(exact["news"].intersect(exact["morning"]).count(), abs=error * size)
        assert rows(sg.sketched_overlap(spans, ("news", "none")).select("overlap_size")) == [(0,)]
    with pytest.raises(ValueError):
        sg.daily_sketches(views, [sg.Segment("hours", "hours", (sg.Rule("daypart", ("night",), "in", 1.0),))])
