import base64
import random

import pytest
from pyspark.sql import functions as F

from airtally.functions import catalog, codec, consent, hashes, identity, scoring, times
from tests.conftest import one, rows


def lit(v):
    return F.lit(v)


def test_hamming_counts_bits(spark):
    zero, full = "0" * 64, "f" * 64
    low8, low9 = "0" * 62 + "ff", "0" * 61 + "1ff"
    got = one(spark, *[hashes.hamming(lit(zero), lit(x)).alias(f"c{i}")
                       for i, x in enumerate((zero, full, low8, low9))])
    assert got == (0, 256, 8, 9)


def test_hamming_agrees_with_python(spark):
    rng = random.Random(5)
    pairs = [("%064x" % rng.getrandbits(256), "%064x" % rng.getrandbits(256)) for _ in range(200)]
    frame = spark.createDataFrame(pairs, "a string, b string")
    got = frame.select("a", "b", hashes.hamming("a", "b").alias("d")).collect()
    assert all(r.d == (int(r.a, 16) ^ int(r.b, 16)).bit_count() for r in got)


def test_hamming_rejects_unequal_lengths(spark):
    with pytest.raises(Exception, match="lengths differ"):
        one(spark, hashes.hamming(lit("0" * 64), lit("0" * 62)))


def test_lanes_round_trip(spark):
    h = "fedcba9876543210" * 4
    assert one(spark, hashes.lanes_to_hex(hashes.lanes(lit(h)))) == (h,)


def test_bands_and_hex(spark):
    h = "".join(f"{i:02x}" for i in range(32))
    bands = one(spark, hashes.bands(lit(h.upper())))[0]
    assert [(b.band_index, b.band_hash) for b in bands] == [(i, f"{i:02x}") for i in range(32)]
    assert len(one(spark, hashes.bands(lit(h), 2))[0]) == 16
    assert one(spark, hashes.hex_encode(lit(b"\x0a\xff")), hashes.hex_decode(lit("0AfF"))) == ("0aff", bytearray(b"\x0a\xff"))
    assert one(spark, hashes.hex_decode(lit("zz"))) == (None,)


@pytest.mark.parametrize("width", [8, 9, 10, 12, 16, 21, 32])
def test_first_shared_piece(spark, width):
    rng = random.Random(width)
    pairs = []
    for _ in range(60):
        a = rng.getrandbits(256)
        b = a ^ rng.getrandbits(256) if rng.random() < 0.5 else a ^ (1 << rng.randrange(256))
        pairs.append(("%064x" % a, "%064x" % b))
    per = 64 // width

    def first(a, b):
        for p in range(per * 4):
            shift = 64 - width * (p % per + 1)
            lane = lambda h: int(h[16 * (p // per):16 * (p // per) + 16], 16) >> shift & ((1 << width) - 1)
            if lane(a) == lane(b):
                return p
        return None

    frame = spark.createDataFrame(pairs, "a string, b string")
    got = frame.select("a", "b", hashes.first_shared_piece(hashes.lanes("a"), hashes.lanes("b"), width).alias("p"))
    assert all(r.p == first(r.a, r.b) for r in got.collect())


def test_sign_fingerprint(spark):
    rng = random.Random(1)
    for n in (2, 9, 64, 257):
        values = [rng.random() for _ in range(n)]
        bits = "".join("1" if values[i] > values[i + 1] else "0" for i in range(n - 1))
        bits += "0" * (-len(bits) % 8)
        want = "%0*x" % (len(bits) // 4, int(bits, 2))
        assert one(spark, hashes.sign_fingerprint(F.array(*[lit(v) for v in values]))) == (want,)


def test_subnets(spark):
    cases = ["192.168.1.100", None, "", "1.2.3", "::1", "1.2.3.4.5", "1.2"]
    frame = spark.createDataFrame([(i, c) for i, c in enumerate(cases)], "i int, ip string")
    got = frame.orderBy("i").select(
        identity.subnet_prefix("ip").alias("p"), identity.subnet_network("ip").alias("n")
    ).collect()
    assert [r.p for r in got] == ["192.168.1", "0.0.0", "0.0.0", "0.0.0", "0.0.0", "0.0.0", "0.0.0"]
    assert [r.n for r in got] == ["192.168.1.0", None, "", "1.2.3.0", "::1", "1.2.3.0", "1.2"]


def test_ip_number(spark):
    cases = ["10.0.0.1", "255.255.255.255", "256.1.1.1", "a.b.c.d", "1.2.3", None]
    frame = spark.createDataFrame([(i, c) for i, c in enumerate(cases)], "i int, ip string")
    got = [r.n for r in frame.orderBy("i").select(identity.ip_number("ip").alias("n")).collect()]
    assert got == [167772161, 4294967295, None, None, None, None]


def test_household_ids(spark):
    import hashlib

    want = "hh_" + hashlib.sha256(b"dev|192.168.1").hexdigest()[:16]
    shared = "hh_" + hashlib.sha256(b"192.168.1").hexdigest()[:16]
    ip = lit("192.168.1.7")
    assert one(spark, identity.household_id_device(lit("dev"), ip), identity.household_id_subnet(ip)) == (want, shared)
    assert one(spark, identity.fallback_household_id(lit("ab-cd-0123456789abcdef"))) == ("abcd0123456789ab",)


def test_request_fields_take_precedence(spark):
    device, ip = identity.device_and_ip(lit(None).cast("string"), lit("ifa"), lit("1.1.1.1"), lit("2.2.2.2"))
    assert one(spark, device.alias("d"), ip.alias("i")) == ("ifa", "1.1.1.1")


def test_dayparts(spark):
    frame = spark.range(24)
    got = {r.id: r.d for r in frame.select("id", times.daypart("id").alias("d")).collect()}
    assert {h for h, d in got.items() if d == "morning"} == set(range(6, 12))
    assert {h for h, d in got.items() if d == "afternoon"} == set(range(12, 18))
    assert {h for h, d in got.items() if d == "primetime"} == set(range(18, 23))
    assert {h for h, d in got.items() if d == "latenight"} == {23, 0, 1, 2, 3, 4, 5}


def test_times(spark):
    got = one(
        spark, times.utc_date(lit(1640000000)), times.utc_hour(lit(1640000000)),
        times.whole_minutes(lit(119)), times.nearest_minute(lit(89)), times.nearest_minute(lit(90)),
        times.minute_floor(lit(119)), times.seconds_of(lit(1999), "ms"),
    )
    assert got == ("2021-12-20", 11, 1, 60, 120, 60, 1)


def test_consent_strings_decode_like_python(spark):
    rng = random.Random(3)
    alphabet = "ABCabc019-_+/!"
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randrange(40))) for _ in range(400)]
    texts += [base64.urlsafe_b64encode(rng.randbytes(rng.randrange(1, 30))).decode() for _ in range(100)]
    texts += ["COwyDgAOwyDAAAEsACEsAA==", "not-valid-base64-!!!"]

    def decode(t):
        padded = t + "=" * (-len(t) % 4)
        try:
            return base64.urlsafe_b64decode(padded)
        except Exception:
            return None

    def purposes(data):
        if not data:
            return None
        return [n for i, n in enumerate(consent.PURPOSES)
                if 12 + i // 8 < len(data) and data[12 + i // 8] >> (7 - i % 8) & 1]

    frame = spark.createDataFrame([(t,) for t in texts], "t string").withColumn("d", consent.decode_consent("t"))
    for r in frame.select("t", "d", consent.consent_purposes("d").alias("p"),
                          consent.is_valid_consent("t").alias("v")).collect():
        want = decode(r.t)
        assert (None if r.d is None else bytes(r.d)) == want, r.t
        assert r.p == purposes(want)
        assert r.v == (want is not None and len(want) >= 20)


def test_short_consent_string_is_not_valid(spark):
    assert one(spark, consent.is_valid_consent(lit("COwyDgAOwyDAAAEsACEsAA==")),
               consent.is_valid_consent(lit(None).cast("string"))) == (False, False)


def test_purpose_checks(spark):
    p = F.array(lit("analytics"), lit("market_research"))
    assert one(spark, consent.has_purpose(p, "analytics"), consent.has_purpose(p, "ad_selection"),
               consent.has_purpose_count(p, 1), consent.has_purpose_count(p, 2),
               consent.has_vendor(consent.consent_vendors(), 1)) == (True, False, True, False, False)


def test_deadlines(spark):
    base = lit("2024-01-01 00:00:00").cast("timestamp")
    got = one(spark, *[consent.deadline(base, lit(j)).cast("string").alias(j) for j in ("US", "EU", "CA")])
    assert got == ("2024-01-02 00:00:00", "2024-01-04 00:00:00", "2024-01-04 00:00:00")
    assert one(spark, consent.is_jurisdiction(lit("US")), consent.is_jurisdiction(lit("UK"))) == (True, False)


def test_reach_model(spark):
    genre = scoring.rule_factor(lit("genre"), F.array(lit("sports")))
    dma = scoring.rule_factor(lit("dma"), F.array(lit("501"), lit("502")))
    f = F.array(genre, dma)
    every, some = scoring.combined_factor(f, lit("and")), scoring.combined_factor(f, lit("or"))
    got = one(spark, scoring.modelled_reach(every), scoring.modelled_cpm(every),
              scoring.modelled_reach(some), scoring.modelled_cpm(some))
    assert got == (2592000, 0.64, 33408000, 0.48)
    assert one(spark, scoring.rule_factor(lit("dma"), lit(None).cast("array<string>"))) == (0.1,)


def test_shares_and_confidence(spark):
    got = one(spark, scoring.percent_int(lit(30), lit(30), 60), scoring.percent_int(lit(2), lit(3)),
              scoring.match_confidence(lit(None).cast("double")), scoring.match_confidence(lit(1.5)),
              scoring.reach_percent(lit(1_000_000)), scoring.reach_percent(lit(60_000_000)),
              scoring.confidence_tier(lit(0.96)), scoring.confidence_tier(lit(0.9)), scoring.confidence_tier(lit(0.5)))
    assert got == (50, 66, 0.95, 1.0, 2.0, 100.0, "exact", "fuzzy", "none")


def test_codec(spark):
    content, start = codec.clip_parts(codec.clip_key(lit("show:1"), lit(1500)))
    assert one(spark, content, start) == ("show:1", 1500)
    assert one(spark, codec.json_to_list(codec.list_to_json(F.array(lit("a"), lit("b"))))) == (["a", "b"],)
    assert one(spark, codec.row_to_json(lit(1).alias("a"), lit(None).cast("string").alias("b"))) == ('{"a":1}',)


def test_sql_functions(spark):
    catalog.register(spark)
    a, b = "0" * 64, "0" * 63 + "7"
    got = spark.sql(f"SELECT hamming('{a}', '{b}'), daypart(23), subnet_prefix('1.2.3.4'), household_id('dev', '192.168.1.1')").first()
    want = one(spark, identity.household_id_device(lit("dev"), lit("192.168.1.1")))[0]
    assert tuple(got) == (3, "latenight", "1.2.3", want)


def test_monthly_identity_changes_with_the_month(spark):
    days = ["2024-01-01", "2024-01-31", "2024-02-01"]
    frame = spark.createDataFrame([(x,) for x in days], "day string")
    ids = rows(frame.select(identity.monthly_device_id(lit("a"), F.to_timestamp("day"), "s")))
    assert len(set(ids)) == 2
