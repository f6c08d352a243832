"""Consent records, privacy requests, subject reports and erasure."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from airtally.functions import consent as cs
from airtally.functions import identity
from airtally.sources import buckets, files, folders, lake

CONSENT_STATE = (
    "device_id string, opted_in boolean, consent_time bigint, consent_version string, ip_at_consent string, "
    "jurisdiction string, tcf_string string, purposes array<string>, vendors array<string>, "
    "special_features array<string>"
)


def consent_records(events: DataFrame, version: str = "1.0") -> DataFrame:
    """Consent events as records: purposes read from the consent string, the address
    cut to its subnet. A string that does not decode leaves no purposes."""
    data = F.col("_data")
    known = [c for c in ("event_id",) if c in events.columns]
    ip = F.col("ip_address") if "ip_address" in events.columns else F.lit(None).cast("string")
    decoded = events.withColumn("_data", cs.decode_consent("tcf_string"))
    return decoded.select(
        "device_id", *known,
        F.coalesce("opted_in", F.lit(True)).alias("opted_in"),
        "consent_time",
        F.lit(version).alias("consent_version"),
        identity.subnet_network(ip).alias("ip_at_consent"),
        F.coalesce("jurisdiction", F.lit("EU")).alias("jurisdiction"),
        "tcf_string",
        cs.consent_purposes(data).alias("purposes"),
        cs.consent_vendors().alias("vendors"),
        F.when(data.isNotNull(), cs.consent_special_features()).alias("special_features"),
    )


def valid_consents(records: DataFrame) -> DataFrame:
    """Records with a known jurisdiction and, if there is a string, a valid one."""
    text_ok = F.col("tcf_string").isNull() | cs.is_valid_consent("tcf_string")
    return records.filter(cs.is_jurisdiction("jurisdiction") & text_ok)


def with_deadlines(requests: DataFrame, now: Column | None = None) -> DataFrame:
    out = requests.withColumn("completion_deadline", cs.deadline("requested_at", "jurisdiction"))
    if now is None:
        return out
    late = (F.col("status") != "completed") & (F.col("completion_deadline") < now)
    return out.withColumn("overdue", late)


def accept_requests(existing: DataFrame, new: DataFrame) -> DataFrame:
    """All requests, where a device has one open request per type at most: the first
    stays and later ones are taken as repeats of it."""
    every = existing.unionByName(new)
    done = F.col("status") == "completed"
    others = [c for c in every.columns if c not in ("device_id", "request_type")]
    first = F.min_by(F.struct(*others), F.struct("requested_at", "id")).alias("_first")
    opened = (
        every.filter(~done).groupBy("device_id", "request_type").agg(first)
        .select("device_id", "request_type", "_first.*")
    )
    return every.filter(done).unionByName(opened.select(*every.columns))


def opted_out(requests: DataFrame) -> DataFrame:
    kinds = F.col("request_type").isin("opt_out", "erasure")
    return requests.filter(kinds).select("device_id").distinct()


def remove_from_segments(members: DataFrame, requests: DataFrame) -> DataFrame:
    """Membership without the devices that asked to be left out."""
    return members.join(opted_out(requests), "device_id", "left_anti")


def subject_report(devices: DataFrame, consents: DataFrame, viewership: DataFrame,
                   members: DataFrame) -> DataFrame:
    """What is held about each device; a device without a consent record is not known.

    Each source is cut down to the subjects before it is aggregated.
    """
    known = consents.join(devices.select("device_id").distinct(), "device_id", "left_semi")
    ids = known.select("device_id")
    watched = (
        viewership.join(ids, "device_id", "left_semi").groupBy("device_id").agg(
            F.count(F.lit(1)).alias("views"), F.sum("duration_minutes").alias("minutes"),
            F.min("watch_date").alias("first_date"), F.max("watch_date").alias("last_date"),
        )
    )
    held = (
        members.join(ids, "device_id", "left_semi").groupBy("device_id")
        .agg(F.array_sort(F.collect_set("segment_id")).alias("segments"))
    )
    return (
        known.select("device_id", "opted_in", "jurisdiction", "consent_time")
        .join(watched, "device_id", "left").join(held, "device_id", "left")
        .withColumns(
            {
                "views": F.coalesce("views", F.lit(0)),
                "minutes": F.coalesce("minutes", F.lit(0)),
                "segments": F.coalesce("segments", F.array().cast("array<string>")),
            }
        )
    )


def erase_from_table(spark: SparkSession, path: str, devices: DataFrame,
                     partitions: str | Sequence[str], key: str = "device_id") -> int:
    """Remove devices from a partitioned table; gives the number of rows removed.

    Only days (values of the first partition column) that hold such a device are
    rewritten. The new files replace the old ones when the job commits, and a folder
    left without rows is dropped. Running it again finds nothing and changes nothing.
    """
    columns = [partitions] if isinstance(partitions, str) else list(partitions)
    day = columns[0]
    gone = devices.select(key).distinct()
    table = spark.read.parquet(path)
    texts = [F.col(c).cast("string").alias(c) for c in columns]
    hit = (
        table.join(gone, key, "left_semi").groupBy(*columns)
        .agg(F.count(F.lit(1)).alias("removed"))
    )
    total = table.groupBy(*columns).agg(F.count(F.lit(1)).alias("rows"))
    # One row per folder with a hit; folders are metadata, not data.
    plan = hit.join(total, columns).select(*texts, "removed", "rows").collect()
    if not plan:
        return 0
    days = sorted({r[day] for r in plan})
    folders.check_names(spark, path, day, days)
    if any(r["removed"] < r["rows"] for r in plan):
        kept = table.filter(F.col(day).cast("string").isin(days))
        (
            kept.join(gone, key, "left_anti")
            .hint("rebalance", *columns)
            .write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
            .partitionBy(*columns).parquet(path)
        )
    emptied = [tuple(r[c] for c in columns) for r in plan if r["removed"] == r["rows"]]
    folders.drop_leaves(spark, path, columns, emptied)
    return sum(r["removed"] for r in plan)


def erase_devices(spark: SparkSession, requests: DataFrame,
                  tables: dict[str, str | Sequence[str]], audit_path: str,
                  now: Column) -> dict[str, int]:
    """Erase the devices of the requests from every table (path to partition columns),
    with audit entries before and after. A failure is audited and raised."""
    files.append_audit(files.audit_rows(requests, "data_deletion_initiated", now), audit_path)
    removed: dict[str, int] = {}
    try:
        for path, partitions in tables.items():
            removed[path] = erase_from_table(spark, path, requests, partitions)
    except Exception:
        files.append_audit(files.audit_rows(requests, "data_deletion_failed", now), audit_path)
        raise
    files.append_audit(files.audit_rows(requests, "data_deletion_completed", now), audit_path)
    return removed


def record_consents(records: DataFrame, path: str, batch_id: int, schema: str = CONSENT_STATE,
                    order: Sequence[Column] | None = None, count: int = buckets.BUCKETS) -> None:
    """Bring the state of consents up to date: the last record per device, in buckets by device of which a
    batch rewrites those that it touches. Of records of the same time a refusal counts. A batch that
    is run again starts from the state before it. Records without a device are dropped."""
    names = [f.name for f in records.sparkSession.createDataFrame([], schema).schema]
    fresh = records.select(*names).filter("device_id IS NOT NULL")
    order = list(order) if order else [F.col("consent_time"), ~F.col("opted_in")]
    wanted = buckets.touched(fresh, "device_id", count)
    known = buckets.read(records.sparkSession, path, schema, wanted, batch_id, "device_id")
    state = lake.latest_rows(known.unionByName(fresh), ["device_id"], order)
    buckets.write(state, path, wanted, batch_id, "device_id", count)


def current_consents(spark: SparkSession, path: str, schema: str = CONSENT_STATE,
                     devices: DataFrame | None = None, count: int = buckets.BUCKETS) -> DataFrame:
    """The state of consents, or the part of it that may hold the given devices."""
    wanted = range(count) if devices is None else buckets.touched(devices, "device_id", count)
    return buckets.read(spark, path, schema, wanted, buckets.NEWEST, "device_id")
