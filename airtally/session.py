"""Session settings and the shared scratch folder."""

from __future__ import annotations

import tempfile
import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

# UTC because every date and hour in the data model is UTC. Shuffle partition
# counts and memory belong to the cluster's own configuration; AQE sizes the
# partitions at run time and splits the skewed ones.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}

ROCKSDB_STATE_STORE = (
    "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
)


def build_session(app: str = "airtally", master: str | None = None, **conf) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**SETTINGS, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def use_utc(spark: SparkSession) -> None:
    """Dates and hours are UTC whatever the session was started with."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")


def shared_dir(spark: SparkSession) -> str:
    """The folder that every executor can reach, as named by the cluster.

    Where the setting is absent a temporary folder serves, but only for a local
    master: on a cluster such a folder would exist on one machine only.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder shared by all executors")
    folder = tempfile.mkdtemp(prefix="airtally-")
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


_INSIDE = threading.local()


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new, unused path inside the shared folder."""
    folder = getattr(_INSIDE, "folder", None) or f"{shared_dir(spark)}/airtally"
    return f"{folder}/{name}-{uuid.uuid4().hex}"


@contextmanager
def temporary_tables(spark: SparkSession) -> Iterator[None]:
    """What is saved inside is deleted at the end, so results have to be written by then. For
    jobs that go on for ever; the tables of a single query stay for the reader of its result."""
    outer = getattr(_INSIDE, "folder", None)
    _INSIDE.folder = scratch_path(spark, "batch")
    try:
        yield
    finally:
        where = spark._jvm.org.apache.hadoop.fs.Path(_INSIDE.folder)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
        _INSIDE.folder = outer


def saved(frame: DataFrame, name: str) -> DataFrame:
    """The frame written to the shared folder and read again, so that later steps
    neither repeat its work nor lose it with an executor."""
    spark = frame.sparkSession
    path = scratch_path(spark, name)
    frame.write.parquet(path)
    return spark.read.schema(frame.schema).parquet(path)
