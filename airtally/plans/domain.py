"""Audience tables derived from the given tables, in Spark and as SQL text.

Every view reads whole tables. The SQL twin of a view is kept beside it so that
a query and its check start from the same rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from airtally.functions import identity, times
from airtally.plans.skew import is_small
from airtally.session import use_utc

# Set makers in the order of the payout report.
MANUFACTURERS = ("Samsung", "LG", "Sony", "Vizio", "TCL", "Philips", "Panasonic", "Others")
JURISDICTION_ORDER = ("US", "EU", "CA")
# Some 250 MB of the widest table that is joined to events.
BROADCAST_ROWS = 2_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    use_utc(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def by_size(frame: DataFrame, rows: int | None = None) -> DataFrame:
    """The frame for the side of a join that Spark would broadcast by the size of its files, which says little
    of the size of its rows: above a number of rows, by counting them, both sides are shuffled."""
    return frame if is_small(frame, BROADCAST_ROWS if rows is None else rows) else frame.hint("merge")


def _pick(names, index: Column) -> Column:
    return F.element_at(F.array(*[F.lit(n) for n in names]), (index + 1).cast("int"))


def _sql_pick(names, index: str) -> str:
    listed = ", ".join(f"'{n}'" for n in names)
    return f"([{listed}])[CAST({index} AS INT) + 1]"


def content(spark, sf_dir) -> DataFrame:
    part = table(spark, sf_dir, "part")
    return part.select(
        F.col("p_partkey").cast("int").alias("k"),
        F.concat(F.lit("c-"), F.col("p_partkey")).alias("content_id"),
        F.col("p_name").alias("title"),
        F.col("p_brand").alias("network"),
        F.lower("p_type").alias("genre"),
    )


def reference_fingerprints(spark, sf_dir) -> DataFrame:
    return content(spark, sf_dir).select(
        F.sha2(F.concat(F.lit("ref-"), F.col("k")), 256).alias("fingerprint_hash"),
        "content_id", "title", "network", "genre", F.lit(0.95).alias("confidence"),
    )


def fingerprints_of(events: DataFrame) -> DataFrame:
    """Fingerprint events; works on a batch or a streaming frame of `events`."""
    e = events.withColumn("k", F.regexp_extract("props", "([0-9]+)", 1).cast("int"))
    n = (F.col("event_id") % 24).cast("int")
    reference = F.sha2(F.concat(F.lit("ref-"), F.col("k")), 256)
    flip = F.sha2(F.concat(F.lit("flip-"), F.col("event_id")), 256)
    noise = F.sha2(F.concat(F.lit("noise-"), F.col("event_id")), 256)
    user = F.col("user_id")
    second = F.floor(user / 64) % 256
    third = F.floor((user % 64) / 4)
    return e.select(
        "event_id",
        "user_id",
        "k",
        "event_type",
        "value",
        F.sha2(F.concat(F.lit("device-"), user), 256).alias("device_id"),
        F.when(F.col("event_type") == "error", noise)
        .otherwise(F.concat(flip.substr(F.lit(1), n), reference.substr(n + 1, F.lit(64))))
        .alias("fingerprint_hash"),
        F.unix_timestamp("ts").alias("timestamp_utc"),
        _pick(MANUFACTURERS, user % 8).alias("manufacturer"),
        F.concat(F.lit("TV-"), (user % 6 + 2018).cast("string")).alias("model"),
        F.concat_ws(
            ".", F.lit("10"), second.cast("string"), third.cast("string"),
            (F.col("event_id") % 250 + 1).cast("string"),
        ).alias("ip_address"),
    )


def fingerprints(spark, sf_dir) -> DataFrame:
    return fingerprints_of(table(spark, sf_dir, "events"))


def raw_fingerprints(spark, sf_dir) -> DataFrame:
    """As received: some ids and hashes are malformed, some events are late or early."""
    f = fingerprints(spark, sf_dir)
    eid = F.col("event_id")
    return f.withColumns(
        {
            "device_id": F.when(eid % 41 == 0, F.concat(F.lit("dev-"), F.col("user_id")))
            .otherwise(F.col("device_id")),
            "fingerprint_hash": F.when(eid % 43 == 0, F.substring("fingerprint_hash", 1, 40))
            .otherwise(F.col("fingerprint_hash")),
            "ingested_at": F.col("timestamp_utc") + eid % 400 - 20,
        }
    )


def viewership(spark, sf_dir) -> DataFrame:
    f = fingerprints(spark, sf_dir).filter(F.col("event_type") != "error")
    people = table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("user_id"),
        (F.col("c_nationkey") + 100).cast("string").alias("dma_code"),
        F.floor((F.col("c_acctbal") + 1000) * 10).cast("bigint").alias("household_income"),
    )
    seconds = F.col("timestamp_utc")
    duration = F.floor(F.col("value") * 60).cast("bigint")
    return (
        f.join(by_size(content(spark, sf_dir)), "k")
        .join(by_size(people), "user_id", "left")
        .select(
            "event_id", "user_id", "device_id",
            identity.household_id_device("device_id", "ip_address").alias("household_id"),
            "content_id", "title", "network", "genre",
            times.utc_date(seconds).alias("watch_date"),
            times.utc_hour(seconds).alias("watch_hour"),
            times.whole_minutes(duration).cast("bigint").alias("duration_minutes"),
            F.coalesce("dma_code", F.lit("00000")).alias("dma_code"),
            "manufacturer", "model",
            F.lit(0.95).alias("match_confidence"),
            seconds.alias("watch_start_utc"),
            duration.alias("duration_sec"),
            "ip_address", "household_income",
        )
    )


def viewership_enriched(spark, sf_dir) -> DataFrame:
    v = viewership(spark, sf_dir)
    return v.withColumns(
        {"viewing_date": F.to_date("watch_date"), "daypart": times.daypart("watch_hour")}
    )


def consent_events(spark, sf_dir) -> DataFrame:
    """Every event of a user restates the user's choice; the last one counts."""
    e = table(spark, sf_dir, "events")
    return e.select(
        "event_id",
        F.sha2(F.concat(F.lit("device-"), F.col("user_id")), 256).alias("device_id"),
        (F.floor(F.col("value") * 100) % 7 != 0).alias("opted_in"),
        F.unix_timestamp("ts").alias("consent_time"),
        _pick(JURISDICTION_ORDER, F.col("user_id") % 3).alias("jurisdiction"),
        F.base64(
            F.unhex(F.sha2(F.concat(F.lit("tcf-"), F.col("event_id")), 256))
        ).alias("tcf_string"),
    )


def segment_activations(spark, sf_dir) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    return o.select(
        F.col("o_orderkey").alias("id"),
        F.col("o_orderpriority").alias("segment_id"),
        F.col("o_custkey").alias("client_id"),
        (F.lit(0.10) + F.col("o_totalprice") / 1e6).alias("cpm_floor"),
        F.col("o_custkey").alias("device_count"),
        F.to_date("o_orderdate").alias("activated_at"),
    )


def billing_events(spark, sf_dir) -> DataFrame:
    l = table(spark, sf_dir, "lineitem")
    return l.select(
        F.col("l_suppkey").alias("advertiser_id"),
        F.col("l_returnflag").alias("event_type"),
        F.round(F.col("l_extendedprice") * 100).cast("bigint").alias("amount_cents"),
        F.to_date("l_shipdate").alias("event_date"),
    )


def api_usage(spark, sf_dir) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.select(
        F.col("event_id").alias("id"),
        F.col("user_id").alias("client_id"),
        F.col("event_type").alias("endpoint"),
        F.floor("value").cast("int").alias("response_ms"),
        F.when(F.col("event_type") == "error", 500).otherwise(200).alias("status_code"),
        (F.unix_micros(F.col("ts").cast("timestamp")) / 1000).cast("bigint").alias("at_ms"),
    )


def asn_ranges(spark, sf_dir) -> DataFrame:
    """Address ranges of 1,024 addresses each, half of them data centres."""
    s = table(spark, sf_dir, "supplier")
    lo = F.lit(167772160) + F.col("s_suppkey") * 1024
    asn = (
        F.when(F.col("s_suppkey") % 4 == 0, F.lit(16509))
        .when(F.col("s_suppkey") % 4 == 1, F.lit(24940))
        .otherwise(F.lit(64512) + F.col("s_suppkey"))
    )
    return s.select(
        lo.cast("bigint").alias("lo"), (lo + 1023).cast("bigint").alias("hi"),
        asn.cast("bigint").alias("asn"),
    )


def privacy_requests(spark, sf_dir) -> DataFrame:
    """Each customer's orders stand for that customer's privacy requests."""
    o = table(spark, sf_dir, "orders")
    return o.select(
        F.col("o_orderkey").alias("id"),
        F.sha2(F.concat(F.lit("device-"), F.col("o_custkey")), 256).alias("device_id"),
        _pick(JURISDICTION_ORDER, F.col("o_custkey") % 3).alias("jurisdiction"),
        F.when(F.col("o_orderstatus") == "F", "opt_out")
        .when(F.col("o_orderstatus") == "O", "erasure")
        .otherwise("portability").alias("request_type"),
        F.when(F.col("o_orderpriority") == "5-LOW", "completed").otherwise("pending").alias("status"),
        F.col("o_orderdate").cast("timestamp").alias("requested_at"),
        (F.col("o_totalprice") > 490000).alias("escalated"),
    )


def campaigns(spark, sf_dir) -> DataFrame:
    """One campaign per customer: budget from the balance, segment by market."""
    c = table(spark, sf_dir, "customer")
    return c.select(
        F.col("c_custkey").alias("campaign_id"),
        F.lower("c_mktsegment").alias("segment_id"),
        F.when(F.col("c_acctbal") > 0, "active").otherwise("paused").alias("status"),
        F.greatest(F.col("c_acctbal"), F.lit(0.0)).alias("budget_usd"),
    )


_VIEWS: dict[str, tuple[tuple[str, ...], str]] = {
    "content": ((), """
        SELECT CAST(p_partkey AS INT) AS k, 'c-' || p_partkey AS content_id, p_name AS title,
               p_brand AS network, lower(p_type) AS genre FROM part"""),
    "reference_fingerprints": (("content",), """
        SELECT sha256('ref-' || k) AS fingerprint_hash, content_id, title, network, genre,
               CAST(0.95 AS DOUBLE) AS confidence FROM content"""),
    "fingerprints": ((), f"""
        SELECT event_id, user_id, k, event_type, value, sha256('device-' || user_id) AS device_id,
               CASE WHEN event_type = 'error' THEN sha256('noise-' || event_id)
                    ELSE substr(sha256('flip-' || event_id), 1, CAST(event_id % 24 AS INT))
                      || substr(sha256('ref-' || k), CAST(event_id % 24 AS INT) + 1) END AS fingerprint_hash,
               epoch_us(ts) // 1000000 AS timestamp_utc,
               {_sql_pick(MANUFACTURERS, 'user_id % 8')} AS manufacturer,
               'TV-' || (user_id % 6 + 2018) AS model,
               '10.' || ((user_id // 64) % 256) || '.' || ((user_id % 64) // 4) || '.' || (event_id % 250 + 1) AS ip_address
        FROM (SELECT *, CAST(regexp_extract(props, '([0-9]+)', 1) AS INT) AS k FROM events)"""),
    "raw_fingerprints": (("fingerprints",), """
        SELECT * REPLACE (
                 CASE WHEN event_id % 41 = 0 THEN 'dev-' || user_id ELSE device_id END AS device_id,
                 CASE WHEN event_id % 43 = 0 THEN substr(fingerprint_hash, 1, 40) ELSE fingerprint_hash END AS fingerprint_hash),
               timestamp_utc + event_id % 400 - 20 AS ingested_at
        FROM fingerprints"""),
    "viewership": (("fingerprints", "content"), """
        SELECT f.event_id, f.user_id, f.device_id,
               'hh_' || substr(sha256(f.device_id || '|' || regexp_extract(f.ip_address, '^([0-9]+[.][0-9]+[.][0-9]+)[.]', 1)), 1, 16) AS household_id,
               c.content_id, c.title, c.network, c.genre,
               strftime(make_timestamp(f.timestamp_utc * 1000000), '%Y-%m-%d') AS watch_date,
               CAST((f.timestamp_utc // 3600) % 24 AS INT) AS watch_hour,
               CAST(floor(f.value * 60) AS BIGINT) // 60 AS duration_minutes,
               coalesce(CAST(p.c_nationkey + 100 AS VARCHAR), '00000') AS dma_code,
               f.manufacturer, f.model, CAST(0.95 AS DOUBLE) AS match_confidence,
               f.timestamp_utc AS watch_start_utc, CAST(floor(f.value * 60) AS BIGINT) AS duration_sec,
               f.ip_address, CAST(floor((p.c_acctbal + 1000) * 10) AS BIGINT) AS household_income
        FROM fingerprints f JOIN content c USING (k) LEFT JOIN customer p ON p.c_custkey = f.user_id
        WHERE f.event_type <> 'error'"""),
    "viewership_enriched": (("viewership",), """
        SELECT *, CAST(watch_date AS DATE) AS viewing_date,
               CASE WHEN watch_hour BETWEEN 6 AND 11 THEN 'morning' WHEN watch_hour BETWEEN 12 AND 17 THEN 'afternoon'
                    WHEN watch_hour BETWEEN 18 AND 22 THEN 'primetime' ELSE 'latenight' END AS daypart
        FROM viewership"""),
    "consent_events": ((), f"""
        SELECT event_id, sha256('device-' || user_id) AS device_id,
               CAST(floor(value * 100) AS BIGINT) % 7 <> 0 AS opted_in,
               epoch_us(ts) // 1000000 AS consent_time,
               {_sql_pick(JURISDICTION_ORDER, 'user_id % 3')} AS jurisdiction,
               to_base64(unhex(sha256('tcf-' || event_id))) AS tcf_string
        FROM events"""),
    "segment_activations": ((), """
        SELECT o_orderkey AS id, o_orderpriority AS segment_id, o_custkey AS client_id,
               CAST(0.10 AS DOUBLE) + o_totalprice / 1e6 AS cpm_floor, o_custkey AS device_count,
               CAST(o_orderdate AS DATE) AS activated_at FROM orders"""),
    "billing_events": ((), """
        SELECT l_suppkey AS advertiser_id, l_returnflag AS event_type,
               CAST(round(l_extendedprice * 100) AS BIGINT) AS amount_cents,
               CAST(l_shipdate AS DATE) AS event_date FROM lineitem"""),
    "api_usage": ((), """
        SELECT event_id AS id, user_id AS client_id, event_type AS endpoint,
               CAST(floor(value) AS INT) AS response_ms,
               CASE WHEN event_type = 'error' THEN 500 ELSE 200 END AS status_code,
               epoch_us(ts) // 1000 AS at_ms FROM events"""),
    "asn_ranges": ((), """
        SELECT 167772160 + s_suppkey * 1024 AS lo, 167772160 + s_suppkey * 1024 + 1023 AS hi,
               CASE s_suppkey % 4 WHEN 0 THEN 16509 WHEN 1 THEN 24940 ELSE 64512 + s_suppkey END AS asn
        FROM supplier"""),
    "privacy_requests": ((), f"""
        SELECT o_orderkey AS id, sha256('device-' || o_custkey) AS device_id,
               {_sql_pick(JURISDICTION_ORDER, 'o_custkey % 3')} AS jurisdiction,
               CASE o_orderstatus WHEN 'F' THEN 'opt_out' WHEN 'O' THEN 'erasure' ELSE 'portability' END AS request_type,
               CASE WHEN o_orderpriority = '5-LOW' THEN 'completed' ELSE 'pending' END AS status,
               o_orderdate AS requested_at, o_totalprice > 490000 AS escalated FROM orders"""),
    "campaigns": ((), """
        SELECT c_custkey AS campaign_id, lower(c_mktsegment) AS segment_id,
               CASE WHEN c_acctbal > 0 THEN 'active' ELSE 'paused' END AS status,
               greatest(c_acctbal, 0.0) AS budget_usd FROM customer"""),
}


def views(*names: str) -> str:
    """`WITH` clause that defines the named views and all they rest on."""
    ordered: list[str] = []

    def add(name: str) -> None:
        for base in _VIEWS[name][0]:
            add(base)
        if name not in ordered:
            ordered.append(name)

    for name in names:
        add(name)
    return "WITH " + ",\n".join(f"{n} AS ({_VIEWS[n][1]})" for n in ordered) + "\n"
