"""A table in hash buckets, of which a batch rewrites only the buckets it touches.

Every bucket has versions, one per batch that wrote it. A batch reads the newest version from before it, so
a batch that is run again starts from what it started from; older versions are dropped. A version
holds a row of nulls besides its own rows, so that a bucket that became empty has a version too.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from airtally.sources import folders

BUCKETS = 256
NEWEST = 2**63 - 1


def bucket_of(key: Column | str, buckets: int = BUCKETS) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")


def touched(keys: DataFrame, key: str, buckets: int = BUCKETS) -> list[int]:
    """Buckets of the given keys: at most as many as there are buckets."""
    return sorted(r[0] for r in keys.select(bucket_of(key, buckets)).distinct().collect())


def versions(spark: SparkSession, path: str) -> dict[int, list[int]]:
    """Versions of each bucket, from folder names alone."""
    found: dict[int, list[int]] = {}
    for bucket, batch in folders.two_levels(spark, path, "bucket", "batch_id"):
        found.setdefault(int(bucket), []).append(int(batch))
    return found


def read(spark: SparkSession, path: str, schema: str, wanted: Iterable[int], before: int, key: str) -> DataFrame:
    """Rows of the wanted buckets as they were before a batch."""
    known = versions(spark, path)
    leaves = []
    for bucket in wanted:
        earlier = [v for v in known.get(bucket, []) if v < before]
        if earlier:
            leaves.append(f"{path}/bucket={bucket}/batch_id={max(earlier)}")
    if not leaves:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(*leaves).filter(F.col(key).isNotNull())


def write(frame: DataFrame, path: str, rewritten: list[int], batch_id: int, key: str,
          buckets: int = BUCKETS) -> None:
    """New versions of all the rewritten buckets; those older than the last one before are dropped. A large
    bucket is written by several tasks."""
    spark = frame.sparkSession
    if not rewritten:
        return
    empty = frame.limit(0).withColumn("bucket", F.lit(None).cast("int"))
    marks = empty.unionByName(
        spark.createDataFrame([(b,) for b in rewritten], "bucket int"), allowMissingColumns=True)
    rows = frame.withColumn("bucket", bucket_of(key, buckets)).unionByName(marks)
    (
        rows.withColumn("batch_id", F.lit(batch_id))
        .hint("rebalance", "bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
        .partitionBy("bucket", "batch_id").parquet(path)
    )
    known = versions(spark, path)
    for bucket in rewritten:
        before = [v for v in known[bucket] if v < batch_id]
        old = [str(v) for v in before if v < max(before)]
        if old:
            folders.drop_partitions(spark, f"{path}/bucket={bucket}", "batch_id", old)
