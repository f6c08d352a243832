"""Connected components of a table of edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from airtally.llm.tables import saved


def components(edges: DataFrame) -> DataFrame:
    """node, component: the smallest node that a node of `edges` (a, b) reaches.

    Each round gives every node the smallest of itself and its neighbours as a name and renames the
    ends of the edges; edges within a name vanish. Rounds are written, and the names of all rounds
    are put together at the end. Nothing is gathered on the driver, and the smallest neighbour of a
    node with many edges is found by partial aggregates.
    """
    left = saved(edges.select("a", "b").filter("a <> b").distinct(), "edges")
    names: list[DataFrame] = []
    while names == [] or not left.isEmpty():
        ends = left.unionByName(left.select(F.col("b").alias("a"), F.col("a").alias("b")))
        name = saved(
            ends.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("name")).withColumnRenamed("a", "node"),
            "names")
        names.append(name)
        first = name.select(F.col("node").alias("a"), F.col("name").alias("name_a"))
        second = name.select(F.col("node").alias("b"), F.col("name").alias("name_b"))
        left = saved(
            left.join(first, "a").join(second, "b").filter("name_a <> name_b")
            .select(F.col("name_a").alias("a"), F.col("name_b").alias("b")).distinct(),
            "edges")
    found = names[0].withColumnRenamed("name", "component")
    for name in names[1:]:
        step = name.select(F.col("node").alias("component"), "name")
        found = found.join(step, "component", "left").select(
            "node", F.coalesce("name", "component").alias("component"))
    return saved(found, "components")
