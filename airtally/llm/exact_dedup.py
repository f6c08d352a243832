"""Exact duplicates, with the frequent texts taken out before the shuffle.

Every text is reduced to its SHA-256 once, in a small table. A frequent-items sketch
(Misra-Gries counters, merged over tasks; Spark's approx_top_k) names the digests that may
be frequent. It keeps `counters` counters, so that no digest with more than about one
`counters`-th of the rows escapes. The named ones are counted exactly; the winners, at most
`candidates` rows, are broadcast and settle their copies where they are read. What is left has
no large group and takes an ordinary shuffle by digest.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from airtally.llm.tables import documents_of, packed, saved

COUNTERS = 8192
CANDIDATES = 1000


def text_digest(text: Column) -> Column:
    return F.sha2(F.coalesce(text.cast("string"), F.lit("")), 256)


def frequent_digests(digests: DataFrame, candidates: int = CANDIDATES,
                     counters: int = COUNTERS) -> DataFrame:
    """Digests that the sketch finds frequent, at most `candidates` rows of `text_sha256`."""
    found = digests.agg(F.expr(f"approx_top_k(text_sha256, {candidates}, {counters})").alias("top"))
    return found.select(F.explode("top").alias("one")).select(F.col("one.item").alias("text_sha256"))


def verified_winners(digests: DataFrame, candidates: int = CANDIDATES,
                     counters: int = COUNTERS) -> DataFrame:
    """Exact winner and group size of the frequent digests that really repeat."""
    named = F.broadcast(frequent_digests(digests, candidates, counters))
    return (
        digests.join(named, "text_sha256")
        .groupBy("text_sha256")
        .agg(F.max(F.struct("doc_id", "row_no")).alias("winner"), F.count(F.lit(1)).alias("group_size"))
        .filter("group_size > 1")
    )


def mark_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                    candidates: int = CANDIDATES, counters: int = COUNTERS) -> DataFrame:
    """One row per row of `docs`: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical; no text counts as empty text. Of equal texts the row with the
    largest id stays (no id is below every id); of rows with the same id and text exactly one stays.
    An empty table gives no rows. Other columns of `docs` are not looked at.
    """
    digests = saved(
        documents_of(docs, id_col, text_col).select(
            "doc_id", text_digest(F.col("text")).alias("text_sha256"),
            F.monotonically_increasing_id().alias("row_no"),
        ),
        "text-digests",
    )
    winners = saved(verified_winners(digests, candidates, counters), "frequent-winners")
    hot = digests.join(F.broadcast(winners), "text_sha256")
    group = Window.partitionBy("text_sha256")
    rest = (
        digests.join(F.broadcast(winners.select("text_sha256")), "text_sha256", "left_anti")
        .withColumn("winner", F.max(F.struct("doc_id", "row_no")).over(group))
        .withColumn("group_size", F.count(F.lit(1)).over(group))
    )
    return hot.unionByName(rest).select(
        "doc_id",
        F.col("winner.doc_id").alias("keep_id"),
        "group_size",
        (F.col("row_no") == F.col("winner.row_no")).alias("kept"),
        "text_sha256",
    )


def without_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                       candidates: int = CANDIDATES, counters: int = COUNTERS) -> DataFrame:
    """The rows of `docs` that stay, with their own columns.

    Copies of frequent texts go where they are read; the others meet by digest. The rank limit
    below is applied before the shuffle too, so that a task sends one row per digest at most.
    Rows with the same id and text differ at most in other columns; a hash of the row decides.
    """
    rows = packed(docs).select(
        "row",
        F.col(f"row.{id_col}").alias("doc_id"),
        text_digest(F.col(f"row.{text_col}")).alias("text_sha256"),
    )
    digests = saved(
        rows.select("doc_id", "text_sha256", F.lit(0).alias("row_no")), "text-digests")
    winners = saved(
        verified_winners(digests, candidates, counters).select(
            "text_sha256", F.col("winner.doc_id").alias("keep_id")),
        "frequent-winners",
    )
    left = rows.join(F.broadcast(winners), "text_sha256", "left").filter(
        F.col("keep_id").isNull() | (F.col("doc_id") == F.col("keep_id")))
    group = Window.partitionBy("text_sha256").orderBy(
        F.col("doc_id").desc_nulls_last(), F.xxhash64(F.to_json("row")))
    return left.withColumn("rank", F.row_number().over(group)).filter("rank = 1").select("row.*")
