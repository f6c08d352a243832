"""Retention, archiving, flags and compaction of tables."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from datetime import date, timedelta
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from airtally import schemas
from airtally.sources import folders, lake

# Days to keep, and file sizes.
VIEWERSHIP_DAYS = 90
AGGREGATE_DAYS = 365
TARGET_FILE_BYTES = 128 * 1024 * 1024
MIN_FILES = 5


@dataclass(frozen=True)
class Policy:
    """Keep `days` of a table partitioned by `date_column`, then delete or archive."""

    path: str
    date_column: str
    days: int
    action: str = "delete"
    archive_root: str | None = None


def expired(frame: DataFrame, date_column: str, cutoff: str) -> DataFrame:
    return frame.filter(F.col(date_column) < cutoff)


def drop_expired(spark: SparkSession, path: str, date_column: str, cutoff: str) -> int:
    """Delete the partitions before the cutoff and give the number of rows in them.

    The count reads Parquet footers of those partitions only; nothing is rewritten.
    """
    old = [v for v in folders.partition_values(spark, path, date_column) if v < cutoff]
    if not old:
        return 0
    table = spark.read.parquet(path)
    count = table.filter(F.col(date_column).cast("string") < cutoff).count()
    folders.drop_partitions(spark, path, date_column, old)
    return count


def archive_expired(spark: SparkSession, path: str, date_column: str, cutoff: str,
                    archive_root: str, stamp: str) -> int:
    """Copy expired partitions to a dated archive, compare counts, then drop them."""
    old = [v for v in folders.partition_values(spark, path, date_column) if v < cutoff]
    if not old:
        return 0
    table = spark.read.parquet(path)
    rows = table.filter(F.col(date_column).cast("string") < cutoff)
    count = rows.count()
    written = lake.write_archive(rows, archive_root, stamp)
    if spark.read.parquet(written).count() != count:
        raise RuntimeError(f"archive {written} is incomplete; nothing was deleted")
    folders.drop_partitions(spark, path, date_column, old)
    return count


def apply_policies(spark: SparkSession, policies: Sequence[Policy], today: str,
                   audit_path: str | None = None) -> dict[str, int]:
    """Apply every policy; gives rows deleted or archived per table."""
    done: dict[str, int] = {}
    deleted = archived = 0
    for p in policies:
        cutoff = str(date.fromisoformat(today) - timedelta(days=p.days))
        if p.action == "archive":
            done[p.path] = archive_expired(
                spark, p.path, p.date_column, cutoff, p.archive_root, today
            )
            archived += done[p.path]
        else:
            done[p.path] = drop_expired(spark, p.path, p.date_column, cutoff)
            deleted += done[p.path]
    if audit_path:
        entry = [(today, deleted, archived, "success")]
        lake.append_rows(spark, entry, schemas.DELETION_AUDIT, audit_path)
    return done


def purge_older(frame: DataFrame, at: str, now: Column, days: int) -> DataFrame:
    """Queue rows (epoch seconds in `at`) that are at most `days` old."""
    return frame.filter(F.col(at) >= now - days * 86400)


def mark_sent(queue: DataFrame, sent: DataFrame, key: str = "event_id") -> DataFrame:
    """Set the flag on the rows whose key is in `sent`."""
    ids = sent.select(key, F.lit(True).alias("_sent")).distinct()
    joined = queue.join(ids, key, "left")
    return joined.withColumn("transmitted", F.col("transmitted") | F.coalesce("_sent", F.lit(False))).drop("_sent")


def z_value(columns: Sequence[Column], bits: int = 16) -> Column:
    """Interleaved bits of non-negative numbers: rows near in every column are near
    in this one."""
    n = len(columns)
    if n * bits > 62:
        raise ValueError("too many bits for one number")
    parts = []
    for b in range(bits):
        for i, col in enumerate(columns):
            bit = F.shiftright(col.cast("bigint"), b).bitwiseAND(F.lit(1))
            parts.append(F.shiftleft(bit, b * n + i))
    return reduce(lambda a, c: a.bitwiseOR(c), parts)


def file_sizes(spark: SparkSession, path: str, partition: str) -> DataFrame:
    """Files and bytes per partition, from file metadata."""
    table = spark.read.parquet(path).select(
        F.col(partition).cast("string").alias(partition),
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_size").alias("bytes"),
    )
    return table.distinct().groupBy(partition).agg(
        F.count(F.lit(1)).alias("files"), F.sum("bytes").alias("bytes")
    )


def compact(spark: SparkSession, path: str, partition: str, cluster: Sequence[str],
            spread: Sequence[str], target_bytes: int = TARGET_FILE_BYTES,
            min_files: int = MIN_FILES) -> dict[str, int]:
    """Rewrite partitions of many small files into few of the target size, each
    sorted along a z-curve of the cluster columns.

    All such partitions are rewritten by a single job, range-partitioned by
    partition, z-value and a hash of `spread`, so that rows alike in the cluster
    columns can still be cut apart. Gives the files wanted per partition.
    """
    wanted = F.greatest(F.lit(1), F.ceil(F.col("bytes") / target_bytes)).cast("int")
    plan = (
        file_sizes(spark, path, partition).withColumn("wanted", wanted)
        .filter((F.col("files") >= min_files) & (F.col("files") > F.col("wanted"))).collect()
    )
    if not plan:
        return {}
    targets = {r[partition]: r["wanted"] for r in plan}
    folders.check_names(spark, path, partition, targets)
    table = spark.read.parquet(path)
    rows = table.filter(F.col(partition).cast("string").isin(list(targets)))
    ranks = [F.pmod(F.xxhash64(c), F.lit(1 << 16)) for c in cluster]
    ordered = rows.withColumn("_z", z_value(ranks)).withColumn("_h", F.xxhash64(*spread))
    (
        ordered.repartitionByRange(sum(targets.values()), partition, "_z", "_h")
        .sortWithinPartitions(partition, "_z").drop("_z", "_h")
        .write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
        .partitionBy(partition).parquet(path)
    )
    return targets
