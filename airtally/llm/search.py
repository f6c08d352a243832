"""Ranked lexical search: best-first over document intervals with range-maximum tables.

Every document is cut into terms once; what is kept of it are its length and, for the terms of the queries,
how often they occur. Documents are dealt into shards of a bounded number of postings. A shard holds
its posting lists side by side, in the order of documents, with the impact of each posting and a sparse
table of range maxima over them. A query starts with the interval of all documents. The maxima of
its terms in an interval, summed, bound every score in it. The interval with the greatest bound is split
at the document of its greatest single impact: that document is scored, the two sides are bounded anew.
An interval whose bound is below the k-th score falls away.

The k-th score is carried from shard to shard: a first shard is searched alone, then a few, then all others,
each with the k-th scores found so far. Queries are taken in blocks, so that their terms fit in a broadcast.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from airtally.session import saved

B = 75
SCALE = 1_000_000_000
SHARD_POSTINGS = 1_500_000
# Bytes of query texts in a block: its terms and their weights are broadcast.
BLOCK_BYTES = 8_000_000
# Intervals split at once.
WIDTH = 64
# Intervals times terms that are looked at together.
MATRIX = 200_000
# Shards that have been searched before the next round.
ROUNDS = (1, 8)
SLICE_BYTES = 1_000_000

# Letters A-Z in lower case, all that parts terms to a space.
FOLD = bytes(
    c + 32 if 0x41 <= c <= 0x5A else c if c >= 0x80 or 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A else 0x20
    for c in range(256))


def term_counts(text: bytes) -> Counter:
    """How often each term occurs; long texts are cut at a space, so their words are never all listed."""
    counts: Counter = Counter()
    at, size = 0, len(text)
    while at < size:
        end = min(at + SLICE_BYTES, size)
        piece = text[at:end].translate(FOLD)
        if end < size:
            cut = piece.rfind(b" ")
            while cut < 0 and end < size:  # one term longer than a slice
                end = min(end + SLICE_BYTES, size)
                piece = text[at:end].translate(FOLD)
                cut = piece.rfind(b" ")
            if end < size:
                piece, end = piece[:cut], at + cut + 1
        counts.update(piece.split())
        at = end
    return counts


def query_blocks(items: DataFrame, item_col: str, text_col: str, block_bytes: int) -> tuple[DataFrame, int]:
    """query, item_id, text, block: rows numbered, so that equal items stay apart. Blocks are dealt
    by hash to hold about `block_bytes` of text."""
    rows = saved(
        items.select(
            F.monotonically_increasing_id().alias("query"), F.col(item_col).alias("item_id"),
            F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")), "queries")
    size = rows.agg(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0
    blocks = max(1, -(-size // block_bytes))
    return rows.withColumn("block", F.pmod(F.xxhash64("query"), F.lit(blocks))), blocks


def matched_terms(docs: DataFrame, vocabulary, id_col: str, text_col: str) -> DataFrame:
    """Documents as (doc_id, no_id, row_no, n, terms, counts), and per task one row without row_no that sums them:
    n is then the number of all terms, docs of all documents with a term, counts that of each term."""

    def scan(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = vocabulary.value
        holding = np.zeros(len(known), np.int64)
        total = found = 0
        for batch in batches:
            out = []
            for doc_id, no_id, row_no, text in zip(
                    *(batch[c].tolist() for c in ("doc_id", "no_id", "row_no", "text"))):
                counts = term_counts(text)
                n = counts.total()
                if not n:
                    continue
                total, found = total + n, found + 1
                hits = [(known[t], c) for t, c in counts.items() if t in known]
                if hits:
                    hits = np.array(hits, dtype="<i4")
                    holding[hits[:, 0]] += 1
                    out.append((doc_id, no_id, row_no, n, 1, hits[:, 0].tobytes(), hits[:, 1].tobytes()))
            yield framed(out)
        terms = np.flatnonzero(holding)
        yield framed([(0, True, None, total, found, terms.astype("<i4").tobytes(),
                       holding[terms].astype("<i8").tobytes())])

    def framed(rows: list[tuple]) -> pd.DataFrame:
        frame = pd.DataFrame(rows, columns=["doc_id", "no_id", "row_no", "n", "docs", "terms", "counts"])
        frame["row_no"] = pd.array([row[2] for row in rows], dtype="Int64")
        return frame

    rows = docs.select(
        F.coalesce(F.col(id_col).cast("long"), F.lit(0)).alias("doc_id"), F.col(id_col).isNull().alias("no_id"),
        F.monotonically_increasing_id().alias("row_no"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary").alias("text"))
    return rows.mapInPandas(
        scan, "doc_id long, no_id boolean, row_no long, n long, docs long, terms binary, counts binary")


def holding_counts(sums: DataFrame) -> DataFrame:
    """Documents that hold each term, from the rows of the tasks."""

    def spread(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for terms, counts in zip(batch["terms"], batch["counts"]):
                yield pd.DataFrame({"term": np.frombuffer(terms, "<i4"), "df": np.frombuffer(counts, "<i8")})

    return sums.select("terms", "counts").mapInPandas(spread, "term int, df long").groupBy("term").agg(
        F.sum("df").alias("df"))


def term_weight(documents: int, holding: int) -> int:
    return math.floor(1000 * math.log((2 * documents + 2) / (2 * holding + 1)))


class Shard:
    """Posting lists of a shard, side by side, with a sparse table of the places of range maxima."""

    def __init__(self, n: np.ndarray, per_doc: np.ndarray, terms: np.ndarray, counts: np.ndarray,
                 weights: np.ndarray, documents: int, length: int):
        self.docs = len(n)
        # Whole numbers beyond 64 bits may occur in 75 * n * documents.
        norm = np.array([100 - B + (B * int(x) * documents) // length for x in n], np.int64)
        doc = np.repeat(np.arange(self.docs), per_doc)
        order = np.argsort(terms, kind="stable")
        terms, doc, tf = terms[order], doc[order], counts[order].astype(np.int64)
        self.key = terms.astype(np.int64) * self.docs + doc
        self.doc = doc
        self.begin = np.searchsorted(terms, np.arange(len(weights) + 1))
        self.impact = weights[terms] * ((SCALE * tf) // (1000 * tf + 8 * norm[doc]))
        longest = int(np.diff(self.begin).max()) if len(terms) else 0
        self.table = [np.arange(len(terms), dtype=np.int32)]
        step = 1
        while 2 * step <= longest:
            last = self.table[-1]
            left, right = last[:len(last) - step], last[step:]
            self.table.append(np.where(self.impact[left] >= self.impact[right], left, right))
            step *= 2
        # Of each level only the places a query may ask for are filled; all have one width.
        self.table = np.stack([np.pad(t, (0, len(terms) - len(t))) for t in self.table])

    def greatest(self, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places and impacts of the maxima of non-empty ranges; 0 for empty ones."""
        size = high - low
        some = size > 0
        level = np.frexp(np.maximum(size, 1))[1] - 1
        low = np.where(some, low, 0)
        left = self.table[level, low]
        right = self.table[level, np.where(some, high - (1 << level), 0)]
        place = np.where(self.impact[left] >= self.impact[right], left, right)
        return place, np.where(some, self.impact[place], 0)

    def bounds(self, terms: np.ndarray, repeats: np.ndarray, low: np.ndarray,
               high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of ranges of postings, a line per interval: the sum of the maxima, and the document to split at."""
        place, value = self.greatest(low, high)
        value = value * repeats
        return value.sum(axis=1), self.doc[place[np.arange(len(place)), value.argmax(axis=1)]]

    def search(self, terms: np.ndarray, repeats: np.ndarray, k: int, floor: int) -> list[tuple[int, int]]:
        """(score, document) of the k best of at least `floor` and above 0, ties to the smaller document.

        Intervals wait as (first document, document behind the last one, bound, document to split at).
        """
        held = self.begin[terms + 1] > self.begin[terms]
        terms, repeats = terms[held], repeats[held]
        if not len(terms) or not self.docs:
            return []
        at_once = max(1, min(WIDTH, MATRIX // len(terms)))
        keys = terms * self.docs
        best: list[tuple[int, int]] = []  # (score, -document), the worst first
        bound, split = self.bounds(terms, repeats, self.begin[terms][None, :], self.begin[terms + 1][None, :])
        first, behind = np.array([0]), np.array([self.docs])
        while len(bound):
            # Equal scores matter only in documents before the one that is k-th now.
            full = len(best) == k and best[0][0] >= floor
            if full:
                floor = best[0][0]
            keep = (bound >= floor) & (bound > 0)
            if full:
                keep &= (bound > floor) | (first < -best[0][1])
            first, behind, bound, split = first[keep], behind[keep], bound[keep], split[keep]
            if not len(bound):
                break
            taken = np.zeros(len(bound), bool)
            taken[np.argpartition(bound, -at_once)[-at_once:] if len(bound) > at_once else slice(None)] = True
            low = np.searchsorted(self.key, keys + first[taken, None])
            high = np.searchsorted(self.key, keys + behind[taken, None])
            at = split[taken]
            here = np.searchsorted(self.key, keys + at[:, None])
            near = np.minimum(here, len(self.doc) - 1)
            hit = (here < high) & (self.doc[near] == at[:, None])
            score = (np.where(hit, self.impact[near], 0) * repeats).sum(axis=1)
            best = sorted(best + [(s, -d) for s, d in zip(score.tolist(), at.tolist()) if s >= floor and s > 0])[-k:]
            bounds, splits = self.bounds(
                terms, repeats, np.concatenate([low, here + hit]), np.concatenate([here, high]))
            first, behind = (
                np.concatenate([first[~taken], first[taken], at + 1]),
                np.concatenate([behind[~taken], at, behind[taken]]))
            bound, split = np.concatenate([bound[~taken], bounds]), np.concatenate([split[~taken], splits])
        return [(s, -d) for s, d in reversed(best)]


def shard_search(queries, floors, weights, k: int, documents: int, length: int):
    """Task function: one shard, all queries of a block. `queries`, `floors` and `weights` are broadcast."""

    def search(rows: pd.DataFrame) -> pd.DataFrame:
        # Documents without id come last.
        rows = rows.sort_values(["no_id", "doc_id", "row_no"], kind="stable")
        terms = np.frombuffer(b"".join(rows["terms"]), "<i4")
        counts = np.frombuffer(b"".join(rows["counts"]), "<i4")
        per_doc = np.array([len(t) // 4 for t in rows["terms"]])
        shard = Shard(rows["n"].to_numpy(), per_doc, terms, counts, weights.value, documents, length)
        ids, absent = rows["doc_id"].tolist(), rows["no_id"].tolist()
        numbers = rows["row_no"].tolist()
        out = [(query, None if absent[doc] else ids[doc], numbers[doc], score)
               for query, of_query, repeats in queries.value
               for score, doc in shard.search(of_query, repeats, k, floors.value.get(query, 1))]
        frame = pd.DataFrame(out, columns=["query", "doc_id", "row_no", "score"])
        frame["doc_id"] = pd.array([row[1] for row in out], dtype="Int64")
        return frame

    return search


def ranked(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query").orderBy(
        F.desc("score"), F.col("doc_id").asc_nulls_last(), "row_no")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def search_block(spark: SparkSession, docs: DataFrame, queries: list[tuple[int, str]], k: int, id_col: str,
                 text_col: str, shard_postings: int, rounds: tuple[int, ...]) -> DataFrame:
    """The k best documents of each query of one block: query, doc_id, row_no, score, rank."""
    context = spark.sparkContext
    words = {query: term_counts(text.encode()) for query, text in queries}
    vocabulary = {t: i for i, t in enumerate(sorted(set().union(*words.values())))}
    table = saved(matched_terms(docs, context.broadcast(vocabulary), id_col, text_col), "matched-terms")
    sums, rows = table.filter("row_no IS NULL"), table.filter("row_no IS NOT NULL").drop("docs")
    totals = sums.agg(F.sum("docs").alias("docs"), F.sum("n").alias("n")).first()
    documents, length = totals["docs"] or 0, totals["n"] or 0
    empty = "query long, doc_id long, row_no long, score long"
    if not documents or not vocabulary:
        return ranked(spark.createDataFrame([], empty), k)
    weights = np.zeros(len(vocabulary), np.int64)
    # One row per term of the block.
    for term, holding in holding_counts(sums).collect():
        weights[term] = term_weight(documents, holding)
    shared = context.broadcast(weights)
    asked = context.broadcast([
        (query, np.array([vocabulary[t] for t in counts], np.int64), np.array(list(counts.values()), np.int64))
        for query, counts in words.items() if counts])
    postings = rows.agg(F.sum(F.octet_length("terms") / 4).cast("long").alias("n")).first()["n"] or 0
    shards = max(1, -(-postings // shard_postings))
    dealt = rows.withColumn("shard", F.pmod(F.xxhash64("row_no"), F.lit(shards)))
    found, begin, floors = None, 0, {}
    for end in [n for n in rounds if n < shards] + [shards]:
        part = dealt.filter((F.col("shard") >= begin) & (F.col("shard") < end))
        task = shard_search(asked, context.broadcast(floors), shared, k, documents, length)
        more = part.repartition(4 * (end - begin), "shard").groupBy("shard").applyInPandas(task, empty)
        found = ranked(more if found is None else found.unionByName(more), k).drop("rank")
        begin = end
        if end < shards:
            found = saved(found, "found")
            # A query with k documents needs no score below its k-th one.
            floors = {query: score for query, score, n in found.groupBy("query").agg(
                F.min("score"), F.count(F.lit(1))).collect() if n == k}
    return ranked(found, k)


def search(docs: DataFrame, items: DataFrame, k: int = 10, id_col: str = "doc_id", text_col: str = "text",
           item_col: str = "item_id", query_col: str = "text", shard_postings: int = SHARD_POSTINGS,
           block_bytes: int = BLOCK_BYTES, rounds: tuple[int, ...] = ROUNDS) -> DataFrame:
    """The k documents with the highest scores above 0 for each item: item_id, rank, doc_id, score.

    Terms are runs of digits, letters a-z (A-Z lower-cased) and everything beyond ASCII, of whole texts; no
    text has none. A document's score is summed over the item's terms, repeats included. Equal scores go by doc_id,
    none last. Repeated rows are documents, and items, of their own. Items without terms and empty tables
    give no rows. Other columns are not looked at.
    """
    spark = docs.sparkSession
    queries, blocks = query_blocks(items, item_col, query_col, block_bytes)
    results = []
    for block in range(blocks):
        # At most about `block_bytes` of text.
        texts = [tuple(r) for r in queries.filter(F.col("block") == block).select("query", "text").collect()]
        results.append(search_block(
            spark, docs, texts, k, id_col, text_col, shard_postings, rounds))
    found = results[0]
    for more in results[1:]:
        found = found.unionByName(more)
    return found.join(queries.select("query", "item_id"), "query").select(
        "item_id", F.col("rank").cast("int"), "doc_id", "score")
