"""Mixing sources to target weights, in blocks of equal size.

Targets come from the totals of the sources alone. Blocks of `block_words` words, or of fewer where a target
is small, go to the sources
by highest quotients (Sainte-Lague: target / 1, / 3, / 5, ...), then in the same way from each source
to its shards, which hold about `shard_words` words each, so that a large source is many tasks.
In a shard the documents stand in a seeded order, end to end in a ring; the shard's blocks are the
run of that many blocks from a seeded first block on, going round twice at most.
"""

from __future__ import annotations

import heapq
from collections.abc import Sequence
from fractions import Fraction

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from airtally.llm.tables import packed, saved, word_count

WEIGHTS = (5, 2, 1)
SHARE = Fraction(3, 2)
MOST_REPEATS = 2
BLOCK_WORDS = 32
SHARD_WORDS = 2_000_000
SHARD_DOCUMENTS = 100_000
MAX_SOURCES = 100_000
SHARDS_AT_ONCE = 10_000


def targets(totals: Sequence[int], weights: Sequence[int], share: Fraction = SHARE,
            repeats: int = MOST_REPEATS) -> list[Fraction]:
    """Target of each source: its weight's part of `share` of all words, at most `repeats` times its
    own words; what is above goes to the others by weight until none is above."""
    left = share * sum(totals)
    out: list[Fraction] = [Fraction(0)] * len(totals)
    open_ = set(range(len(totals)))
    while open_:
        weight = sum(weights[i] for i in open_)
        full = [i for i in open_ if left * weights[i] / weight > repeats * totals[i]]
        if not full:
            for i in open_:
                out[i] = left * weights[i] / weight
            break
        for i in full:
            out[i] = Fraction(repeats * totals[i])
            open_.discard(i)
        left -= sum(out[i] for i in full)
    return out


def apportion(shares: Sequence[float], seats: int, most: Sequence[int]) -> list[int]:
    """Seats by highest quotients share / (2 * seats so far + 1), no more than `most` each; equal
    quotients go to the earlier one. A divisor found by bisection gives all but the last few seats,
    since a seat's quotient is above the divisor exactly when share / divisor rounds up to it."""
    share = np.asarray(shares, dtype=float)
    limit = np.where(share > 0, np.asarray(most, dtype=np.int64), 0)
    seats = min(int(seats), int(limit.sum()))
    given = np.zeros(len(share), dtype=np.int64)
    if seats > 4 * len(share):
        low, high = 0.0, 2.0 * float(share.sum()) + 1.0
        for _ in range(200):
            middle = (low + high) / 2
            if middle in (low, high):
                break
            tried = np.minimum(limit, np.floor(share / (2 * middle) + 0.5)).astype(np.int64)
            if tried.sum() > seats:
                low = middle
            else:
                high, given = middle, tried
            if given.sum() == seats:
                break
        given = np.maximum(given - 1, 0)  # the last seats go by exact order, ties included
    waiting = [(-share[i] / (2 * int(given[i]) + 1), i) for i in range(len(share)) if given[i] < limit[i]]
    heapq.heapify(waiting)
    for _ in range(seats - int(given.sum())):
        _, i = heapq.heappop(waiting)
        given[i] += 1
        if given[i] < limit[i]:
            heapq.heappush(waiting, (-share[i] / (2 * int(given[i]) + 1), i))
    return given.tolist()


def _plan(sizes: DataFrame, weights: Sequence[int], share: Fraction, repeats: int, block: int,
          shard_words: int, shard_documents: int) -> DataFrame:
    """One row per source: source_size, target, blocks, shards."""
    totals = sizes.groupBy("source").agg(
        F.sum("size").alias("words"), F.count(F.lit(1)).alias("documents"))
    rows = totals.limit(MAX_SOURCES + 1).collect()
    if len(rows) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources")
    rows.sort(key=lambda r: (r["source"] is None, r["source"]))
    words = [int(r["words"]) for r in rows]
    wanted = targets(words, [weights[i % len(weights)] for i in range(len(rows))], share, repeats)
    # Small enough for the smallest target to be met within a thirty-second of it, or a word.
    smallest = min((t for t in wanted if t > 0), default=Fraction(block))
    block = max(1, min(block, int(smallest) // 32))
    seats = round(sum(wanted) / block)
    blocks = apportion([float(t) for t in wanted], seats, [-(-repeats * w // block) for w in words])
    plan = [
        (r["source"], w, float(t), b, block, max(1, -(-w // shard_words), -(-int(r["documents"]) // shard_documents)))
        for r, w, t, b in zip(rows, words, wanted, blocks)
    ]
    return sizes.sparkSession.createDataFrame(
        plan, "source string, source_size long, target double, blocks long, block long, shards long")


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
        weights: Sequence[int] = WEIGHTS, share: Fraction = SHARE, repeats: int = MOST_REPEATS,
        block_words: int = BLOCK_WORDS, shard_words: int = SHARD_WORDS,
        shard_documents: int = SHARD_DOCUMENTS, seed: int = 17) -> DataFrame:
    """row (all columns of `docs`), doc_id, size, source_size, target, taken: one row per row of `docs`.

    Size is the number of words of the whole text (0 without one). Sources stand in the order of
    their code points, no source last and a source of its own. `taken` is the number of words the mix
    takes of the row, repeats counted, at most `repeats` times its size. Rows that agree in id and
    text may swap their parts; apart from that reruns agree, whatever the layout of the table. An
    empty table gives no rows. There may be up to 100,000 sources.
    """
    rows = packed(docs).select(
        "row",
        F.col(f"row.{source_col}").cast("string").alias("source"),
        F.coalesce(word_count(F.col(f"row.{text_col}").cast("string")), F.lit(0).cast("long")).alias("size"),
        F.col(f"row.{id_col}").alias("doc_id"),
        F.xxhash64(F.lit(seed), f"row.{id_col}", f"row.{text_col}").alias("place"),
    )
    plan = saved(
        _plan(rows.select("source", "size"), weights, share, repeats, block_words, shard_words,
              shard_documents), "mix-plan")
    planned = rows.withColumnRenamed("source", "own").join(
        F.broadcast(plan), F.col("own").eqNullSafe(F.col("source"))
    ).withColumn("shard", F.pmod("place", "shards"))
    most = F.ceil(F.col("words") * repeats / F.col("block"))
    shard_sizes = planned.groupBy("source", "shard", "block", "blocks").agg(F.sum("size").alias("words")).withColumns(
        {"most": most, "batch": F.floor(F.col("shard") / SHARDS_AT_ONCE)})

    def quotas(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(group.columns[1])
        group["quota"] = apportion(group["words"].tolist(), int(group["blocks"].iloc[0]), group["most"].tolist())
        return group

    # From a source to batches of its shards, from a batch to its shards: no task holds all shards of a source.
    batches = saved(
        shard_sizes.groupBy("source", "batch", "blocks").agg(F.sum("words").alias("words"), F.sum("most").alias("most"))
        .select("source", "batch", "blocks", "words", "most").groupBy("source").applyInPandas(
            quotas, "source string, batch long, blocks long, words long, most long, quota long"), "mix-batches"
    ).select(F.col("source").alias("its"), F.col("batch").alias("of"), F.col("quota").alias("given"))
    shared = shard_sizes.join(
        batches, F.col("source").eqNullSafe(F.col("its")) & (F.col("batch") == F.col("of"))
    ).select("source", "shard", F.col("given").alias("blocks"), "words", "most", "batch", "block")
    quota = saved(
        shared.groupBy("source", "batch").applyInPandas(
            quotas, "source string, shard long, blocks long, words long, most long, batch long, block long, quota long"),
        "mix-quotas",
    ).select(F.col("source").alias("its"), F.col("shard").alias("number"), "words", "quota")
    line = Window.partitionBy("its", "number").orderBy("place", "doc_id", "size")
    ring = planned.join(
        quota, F.col("source").eqNullSafe(F.col("its")) & (F.col("shard") == F.col("number"))
    ).withColumn("stop", F.sum("size").over(line.rowsBetween(Window.unboundedPreceding, 0)))
    ring = ring.withColumn("start", F.col("stop") - F.col("size")).withColumn(
        "wanted", F.least(F.col("quota") * F.col("block"), F.col("words") * repeats)
    ).withColumn("rounds", F.floor(F.col("wanted") / F.greatest("words", F.lit(1)))).withColumn(
        "part", F.col("wanted") - F.col("rounds") * F.col("words")
    ).withColumn(
        "first",
        F.pmod(F.xxhash64(F.lit(seed), "its", "number"),
               F.greatest(F.floor(F.col("words") / F.col("block")), F.lit(1))) * F.col("block"),
    )

    def overlap(shift: Column) -> Column:
        begin, end = F.col("first") - shift, F.col("first") + F.col("part") - shift
        return F.greatest(F.least("stop", end) - F.greatest("start", begin), F.lit(0))

    taken = F.col("rounds") * F.col("size") + overlap(F.lit(0)) + overlap(F.col("words"))
    return ring.select(
        "row", "doc_id", "size", "source_size", "target", taken.cast("long").alias("taken"))


def mixed_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
               source_col: str = "source", **options) -> DataFrame:
    """The rows of `docs` as the mix takes them: left out, once or repeated, with their own columns.
    A row of which a part is taken counts from half of its words on."""
    taken = mix(docs, id_col, text_col, source_col, **options)
    copies = F.round(F.col("taken") / F.greatest("size", F.lit(1))).cast("int")
    return taken.withColumn("copies", copies).filter("copies > 0").select(
        "row", F.explode(F.sequence(F.lit(1), "copies"))).select("row.*")
