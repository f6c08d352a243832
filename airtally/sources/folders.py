"""Partition folders of path-based tables."""

from __future__ import annotations

from collections.abc import Iterable
from urllib.parse import unquote

from pyspark.sql import SparkSession


def _fs(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    where, fs = _fs(spark, path)
    return fs.exists(where)


def make(spark: SparkSession, path: str) -> None:
    """An empty folder whose name says all there is to say."""
    where, fs = _fs(spark, path)
    fs.mkdirs(where)


def partition_values(spark: SparkSession, path: str, column: str) -> list[str]:
    """Values of the first partition column, from folder names alone."""
    where, fs = _fs(spark, path)
    if not fs.exists(where):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(where)]
    head = f"{column}="
    return sorted(unquote(n[len(head):]) for n in names if n.startswith(head))


def two_levels(spark: SparkSession, path: str, first: str, second: str) -> list[tuple[str, str]]:
    """Values of the first two partition columns, by one listing of folder names."""
    where, fs = _fs(spark, f"{path}/{first}=*/{second}=*")
    found = []
    for status in fs.globStatus(where) or []:
        leaf = status.getPath()
        found.append((unquote(leaf.getParent().getName()[len(first) + 1:]), unquote(leaf.getName()[len(second) + 1:])))
    return sorted(found)


def check_names(spark: SparkSession, path: str, column: str, values: Iterable[str]) -> None:
    """Raise when a value read from the table is not the name of its folder, as with
    `01` read as a number: such a folder could be neither replaced nor dropped."""
    strange = sorted(set(values) - set(partition_values(spark, path, column)))
    if strange:
        raise ValueError(f"{column} values {strange} are not folder names of {path}")


def drop_leaves(spark: SparkSession, path: str, columns: list[str], leaves: Iterable[tuple]) -> None:
    """Delete leaf folders of a table with several partition columns."""
    by_first: dict[str, list[tuple]] = {}
    for leaf in leaves:
        by_first.setdefault(leaf[0], []).append(leaf[1:])
    if len(columns) == 1:
        drop_partitions(spark, path, columns[0], by_first)
        return
    where, fs = _fs(spark, path)
    head = f"{columns[0]}="
    for status in fs.listStatus(where):
        name = status.getPath().getName()
        rest = by_first.get(unquote(name[len(head):])) if name.startswith(head) else None
        if rest:
            drop_leaves(spark, status.getPath().toString(), columns[1:], rest)


def drop_partitions(spark: SparkSession, path: str, column: str, values: Iterable[str]) -> list[str]:
    """Delete the folders of whole partitions; rows are not read."""
    wanted = set(values)
    where, fs = _fs(spark, path)
    dropped = []
    if not fs.exists(where):
        return dropped
    head = f"{column}="
    for status in fs.listStatus(where):
        name = status.getPath().getName()
        if name.startswith(head) and unquote(name[len(head):]) in wanted:
            fs.delete(status.getPath(), True)
            dropped.append(unquote(name[len(head):]))
    return sorted(dropped)
