"""The viewership lake and the tables beside it, as Parquet folders."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from airtally.sources import folders

# By day only: three levels of folders would give very many small files. Rows are
# clustered by network and genre inside a day instead, so that Parquet statistics
# still skip most row groups for a filter on those.
PARTITIONS = ("watch_date",)
FINE_PARTITIONS = ("watch_date", "network", "genre")
CLUSTER = ("network", "genre")
RECORDS_PER_FILE = 4_000_000


def write_viewership(viewership: DataFrame, path: str, mode: str = "append",
                     partitions: tuple[str, ...] = PARTITIONS,
                     records_per_file: int = RECORDS_PER_FILE) -> None:
    """Rows are spread over tasks by day and a hash, so a heavy day is written by
    many tasks; the spread is left to AQE, which sizes and splits the partitions."""
    stamped = viewership
    if "ingest_timestamp" not in viewership.columns:
        stamped = viewership.withColumn("ingest_timestamp", F.current_timestamp())
    inner = [c for c in CLUSTER if c not in partitions]
    (
        stamped.hint("rebalance", *partitions)
        .sortWithinPartitions(*partitions, *inner)
        .write.mode(mode).partitionBy(*partitions)
        .option("maxRecordsPerFile", records_per_file)
        .option("partitionOverwriteMode", "dynamic")
        .parquet(path)
    )


def write_viewership_batch(viewership: DataFrame, path: str, batch_id: int,
                           partitions: tuple[str, ...] = PARTITIONS) -> None:
    """A batch of a stream, laid out and sized like any other write. The batch is the last level of
    folders, so a batch that is run again replaces what it wrote and nothing else."""
    rows = viewership.withColumn("batch_id", F.lit(batch_id))
    write_viewership(rows, path, "overwrite", (*partitions, "batch_id"))


def read_viewership(spark: SparkSession, path: str, since: str | None = None,
                    columns: list[str] | None = None) -> DataFrame:
    """Days from `since` on; older folders are not opened. The folder names are kept
    as text, as in the table's own layout."""
    table = spark.read.parquet(path).withColumn(
        "watch_date", F.col("watch_date").cast("string")
    ).drop("batch_id")
    if since is not None:
        table = table.filter(F.col("watch_date") >= since)
    return table.select(*columns) if columns else table


def write_aggregates(aggregates: DataFrame, path: str) -> None:
    """Replace the whole table."""
    aggregates.write.mode("overwrite").option("partitionOverwriteMode", "static").parquet(path)


def read_merged(spark: SparkSession, path: str) -> DataFrame:
    """Files of older and newer layouts together; missing columns are null."""
    return spark.read.option("mergeSchema", "true").parquet(path)


def write_archive(rows: DataFrame, root: str, date: str) -> str:
    """A dated folder that must not exist yet."""
    path = f"{root}/{date}"
    rows.write.mode("errorifexists").parquet(path)
    return path


def append_rows(spark: SparkSession, rows: list[tuple], schema: str, path: str) -> None:
    """A few literal rows, such as an audit entry."""
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)


def append_changes(changes: DataFrame, path: str, batch_id: int | str) -> None:
    """Add a batch of changes to a table kept as a list of changes.

    The batch is its own partition and is overwritten as a whole, so a batch that
    runs twice is stored once.
    """
    (
        changes.withColumn("batch_id", F.lit(str(batch_id)))
        .write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
        .partitionBy("batch_id").parquet(path)
    )


def latest_rows(changes: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """Current state of such a table: the last change per key. Each task combines
    its own rows first."""
    others = [c for c in changes.columns if c not in keys and c != "batch_id"]
    last = F.max_by(F.struct(*others), F.struct(*order)).alias("_last")
    return changes.groupBy(*keys).agg(last).select(*keys, "_last.*")


def write_snapshot(spark: SparkSession, changes: str, snapshots: str, keys: list[str],
                   order: list[Column]) -> int | None:
    """Store the state after the last batch, so that readers need not go through all
    batches again. Gives the number of that batch."""
    batches = [int(b) for b in folders.partition_values(spark, changes, "batch_id")]
    if not batches:
        return None
    state = read_state(spark, changes, snapshots, keys, order)
    last = max(batches)
    state.write.mode("overwrite").option("partitionOverwriteMode", "static").parquet(
        f"{snapshots}/upto={last}"
    )
    return last


def read_state(spark: SparkSession, changes: str, snapshots: str, keys: list[str],
               order: list[Column]) -> DataFrame:
    """Newest finished snapshot with the batches after it."""
    done = [
        int(n) for n in folders.partition_values(spark, snapshots, "upto")
        if folders.exists(spark, f"{snapshots}/upto={n}/_SUCCESS")
    ]
    table = spark.read.parquet(changes)
    if not done:
        return latest_rows(table, keys, order)
    newer = table.filter(F.col("batch_id").cast("bigint") > max(done)).drop("batch_id")
    base = spark.read.parquet(f"{snapshots}/upto={max(done)}")
    return latest_rows(base.unionByName(newer), keys, order)
