"""Exact top-k by inner product: a ball tree per shard, searched by branch and bound.

Vectors are dealt to shards of at most about `shard_rows` rows by a hash of the row; each shard's
tree is built once and written. Queries come in blocks. A block first searches one shard; the k-th
score that each query has then is the bound with which it enters all other shards, so that most
of their nodes are never opened. A pair of a tree and a block is one task with bounded memory.
"""

from __future__ import annotations

import heapq
import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from airtally.llm.tables import saved

SHARD_ROWS = 16_384
BLOCK_ROWS = 1024
LEAF_ROWS = 64
EXACT = float(1 << 53)


def whole_numbers(vector: Column, scale: int) -> Column:
    """floor(scale * x) of each component; null for a vector that is null, empty, or holds a component
    that is null or not finite."""
    scaled = F.transform(vector, lambda x: F.floor(x.cast("double") * scale).cast("long"))
    odd = F.exists(vector, lambda x: x.isNull() | F.isnan(x.cast("double"))
                   | (F.abs(x.cast("double")) == float("inf")))
    return F.when((F.size(vector) > 0) & ~odd, scaled)


class BallTree:
    """Balls around halves of the rows. Rows are stored leaf by leaf; children of a node follow it."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray, leaf_rows: int = LEAF_ROWS):
        self.centers: list[np.ndarray] = []
        self.radii: list[float] = []
        self.least_id: list[int] = []
        self.span: list[tuple[int, int]] = []
        self.children: list[tuple[int, int] | None] = []
        order = np.lexsort((ids,))
        self.order = order
        self.leaf_rows = leaf_rows
        points = rows.astype(np.float64)
        waiting = [(0, len(ids), -1, 0)]
        while waiting:
            start, stop, parent, side = waiting.pop()
            part = order[start:stop]
            center = points[part].mean(axis=0)
            away = np.sqrt(((points[part] - center) ** 2).sum(axis=1))
            node = len(self.radii)
            self.centers.append(center)
            # A little more than computed: rounding must never make a bound too small.
            self.radii.append(float(away.max()) * (1 + 1e-9) + 1e-9)
            self.least_id.append(int(ids[part].min()))
            self.span.append((start, stop))
            self.children.append(None)
            if parent >= 0:
                pair = self.children[parent] or (0, 0)
                self.children[parent] = (node, pair[1]) if side == 0 else (pair[0], node)
            if stop - start <= leaf_rows or self.radii[-1] <= 1e-8:
                order[start:stop] = part[np.argsort(ids[part], kind="stable")]
                continue
            one = points[part[away.argmax()]]
            from_one = ((points[part] - one) ** 2).sum(axis=1)
            other = points[part[from_one.argmax()]]
            along = points[part] @ (other - one)
            half = (stop - start) // 2
            order[start:stop] = part[np.argpartition(along, half)]
            waiting.append((start + half, stop, node, 1))
            waiting.append((start, start + half, node, 0))
        self.centers = np.array(self.centers)
        self.radii = np.array(self.radii)
        self.ids, self.rows = ids[order], rows[order]
        size = np.abs(rows).max(initial=0)
        self.size = float(size)

    def search(self, query: np.ndarray, own: int, k: int, bound: tuple[int, int] | None
               ) -> list[tuple[int, int]]:
        """Best (score, -id), at most k, best first; only what beats `bound` where one is given."""
        floats = query.astype(np.float64)
        length = float(np.sqrt(floats @ floats)) * (1 + 1e-9)
        slack = 1e-9 * (1.0 + length * (float(np.abs(self.centers).max(initial=0)) * len(query) + 1.0))
        upper = self.centers @ floats + length * self.radii + slack
        # Floating point products are exact while every sum stays below 2^53.
        exact = len(query) * self.size * float(np.abs(floats).max(initial=0)) < EXACT
        best: list[tuple[int, int]] = []

        def hopeless(node: int) -> bool:
            worst = best[0] if len(best) == k else None
            if bound is not None and (worst is None or bound > worst):
                worst = bound
            return worst is not None and (upper[node], -self.least_id[node]) <= worst

        waiting = [(-upper[0], 0)]
        while waiting:
            _, node = heapq.heappop(waiting)
            if hopeless(node):
                continue
            if self.children[node] is not None:
                for child in self.children[node]:
                    if not hopeless(child):
                        heapq.heappush(waiting, (-upper[child], child))
                continue
            start, stop = self.span[node]
            rows = self.rows[start:stop]
            if exact:
                scores = (rows.astype(np.float64) @ floats).astype(np.int64)
            else:
                scores = rows @ query
            floor = best[0][0] if len(best) == k else None
            if bound is not None and (floor is None or bound[0] > floor):
                floor = bound[0]
            good = np.arange(stop - start) if floor is None else np.flatnonzero(scores >= floor)
            # The query's own rows go first, however many: they must not take places of candidates.
            good = good[self.ids[start + good] != own]
            if len(good) > k:
                # Ids rise within a leaf, so a stable order puts the smaller id first.
                good = good[np.argsort(-scores[good], kind="stable")[:k]]
            for at in good.tolist():
                one = (int(scores[at]), -int(self.ids[start + at]))
                if bound is not None and one <= bound:
                    continue
                if len(best) < k:
                    heapq.heappush(best, one)
                elif one > best[0]:
                    heapq.heapreplace(best, one)
        return sorted(best, reverse=True)


def _search_block(trees: DataFrame, blocks: DataFrame, k: int) -> DataFrame:
    """Joins trees and blocks (columns `pair`, and the two blobs) and searches each pair."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for tree_blob, block_blob in zip(batch["tree"], batch["queries"]):
                tree = object.__new__(BallTree)
                vars(tree).update(pickle.loads(tree_blob))
                found = [
                    (query_id, -minus_id, score)
                    for query_id, vector, bound in pickle.loads(block_blob)
                    for score, minus_id in tree.search(vector, query_id, k, bound)
                ]
                yield pd.DataFrame(found, columns=["query_id", "vec_id", "score"])

    # Batches of one row: a tree and a block at a time.
    return trees.join(blocks, ["dim", "pair"]).select("tree", "queries").repartition(
        "tree", "queries").mapInPandas(run, "query_id long, vec_id long, score long")


def _best(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 5, id_col: str = "vec_id",
          vector_col: str = "embedding", scale: int = 256, shard_rows: int = SHARD_ROWS,
          block_rows: int = BLOCK_ROWS) -> DataFrame:
    """query_id, rank, vec_id, score: the k best rows of `vectors` for each row of `queries`.

    Components become floor(scale * x); the score is their inner product, equal scores go to the
    smaller id, and a row is no candidate for a query of its own id. Vectors that are null, empty, or
    hold a component that is null or not finite take no part, nor do rows without id; a query meets
    the vectors of its own length only. A repeated id is a candidate once per row. Empty tables give no rows.
    """
    spark = vectors.sparkSession

    def usable(frame: DataFrame) -> DataFrame:
        return frame.select(
            F.col(id_col).cast("long").alias("id"), whole_numbers(F.col(vector_col), scale).alias("v")
        ).dropna().withColumn("dim", F.size("v"))

    rows, asked = usable(vectors), usable(queries)
    counts = {r["dim"]: r["n"] for r in rows.groupBy("dim").agg(F.count("*").alias("n")).collect()}
    blocks_of = {r["dim"]: r["n"] for r in asked.groupBy("dim").agg(F.count("*").alias("n")).collect()}
    shape = [(dim, max(1, -(-n // shard_rows)), max(1, -(-blocks_of.get(dim, 0) // block_rows)))
             for dim, n in counts.items()]
    shapes = F.broadcast(spark.createDataFrame(shape, "dim int, shards int, blocks int"))

    def build(group: pd.DataFrame) -> pd.DataFrame:
        tree = BallTree(group["id"].to_numpy(np.int64), np.stack(group["v"].to_numpy()).astype(np.int64))
        return pd.DataFrame({"dim": group["dim"].iloc[:1], "shard": group["shard"].iloc[:1],
                             "tree": [pickle.dumps(vars(tree))]})

    dealt = rows.join(shapes, "dim").withColumn(
        "shard", F.pmod(F.xxhash64("id", "v"), F.col("shards")).cast("int"))
    trees = saved(
        dealt.select("dim", "shard", "id", "v").groupBy("dim", "shard").applyInPandas(
            build, "dim int, shard int, tree binary"), "ball-trees").join(shapes, "dim")

    def pack(group: pd.DataFrame) -> pd.DataFrame:
        bounds = [None if score != score or score is None else (int(score), -int(vec))
                  for score, vec in zip(group["score"], group["vec"])]
        block = [(int(i), np.asarray(v, dtype=np.int64), bound)
                 for i, v, bound in zip(group["id"], group["v"], bounds)]
        return pd.DataFrame({"dim": group["dim"].iloc[:1], "block": group["block"].iloc[:1],
                             "queries": [pickle.dumps(block)]})

    def blocks(frame: DataFrame) -> DataFrame:
        return frame.select("dim", "block", "id", "v", "score", "vec").groupBy("dim", "block").applyInPandas(
            pack, "dim int, block int, queries binary").join(shapes, "dim")

    asked = asked.dropDuplicates(["id", "v"]).join(shapes, "dim").withColumn(
        "block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    home = F.pmod(F.col("block"), F.col("shards"))
    none = asked.withColumn("score", F.lit(None).cast("double")).withColumn("vec", F.lit(None).cast("double"))
    first_blocks = blocks(none).withColumn("pair", F.struct(home.alias("shard"), "block")).select(
        "dim", "pair", "queries")
    pairs = trees.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).withColumn(
        "pair", F.struct("shard", "block")).withColumn("home", F.col("shard") == home)
    first = saved(_best(_search_block(
        pairs.filter("home").select("dim", "pair", "tree"), first_blocks, k), k), "first-shard")
    reached = first.filter(F.col("rank") == k).select(
        F.col("query_id").alias("id"), F.col("score").cast("double").alias("score"),
        F.col("vec_id").cast("double").alias("vec"))
    others = blocks(asked.join(reached, "id", "left")).withColumn(
        "shard", F.explode(F.sequence(F.lit(0), F.col("shards") - 1))
    ).filter(F.col("shard") != home).withColumn("pair", F.struct("shard", "block")).select(
        "dim", "pair", "queries")
    second = _search_block(pairs.filter("NOT home").select("dim", "pair", "tree"), others, k)
    return _best(first.drop("rank").unionByName(second), k).select(
        "query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
