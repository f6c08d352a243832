"""Repeated byte strings of a fixed length, by a sparse suffix array over range-partitioned suffixes.

Anchors. Of the k-grams of each window of `length` bytes the one with the smallest hash (the first of
equal ones) is the window's anchor. Equal windows have their anchor at the same place, so only
suffixes at anchors are needed, about one in ninety bytes, and of these only the ones whose k-gram
occurs at another anchor too. Tasks combine equal k-grams before they send them.

Suffixes. Each such anchor sends the bytes of its windows. Splitters sampled from the leading k-grams
deal the suffixes to buckets by range. A splitter is a whole k-gram, so suffixes with the same one are
neighbours in one bucket, and the last suffix of a bucket and the first of the next differ within
it; no match crosses a boundary. A bucket is sorted by multikey quicksort over words of
eight bytes; common prefixes of neighbours give the stretches of suffixes that agree as far
as a window needs, and within a stretch the bytes before the anchor are compared by a hash. K-grams
with more than `hot_anchors` anchors do not go into a bucket: each task finds the equal ones among
their windows, and one row per different window and task goes on to be counted.

Marks. Covered bytes go back to their texts as intervals. Equal texts take part once; all of
their windows are repeated.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from airtally.llm.jaccard import _BYTES, mixed
from airtally.llm.tables import documents_of, saved

LENGTH = 200
GRAM = 32
HOT_ANCHORS = 20_000
BUCKET_SUFFIXES = 20_000
SAMPLED_TEXTS = 2_000
SAMPLED_SUFFIXES = 50_000
HOT_WINDOWS = 300_000
MAX_BROADCAST = 100_000
CHUNK_ANCHORS = 200_000
BUCKET_ANCHORS = 500_000
SEGMENT_BYTES = 1 << 22
ROWS_AT_ONCE = 4_096

_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_PLACE = np.uint64((1 << 24) - 1)
_SMALL = 48


def _gram_hashes(values: np.ndarray, gram: int) -> np.ndarray:
    """Hash of the `gram` bytes from each place on; `gram` is a power of two."""
    width, factor = 1, _BASE
    while width < gram:
        values = values[:-width] * factor + values[width:]
        width, factor = 2 * width, factor * factor
    return mixed(values)


def _window_min(values: np.ndarray, width: int) -> np.ndarray:
    done = 1
    while 2 * done <= width:
        values = np.minimum(values[:-done], values[done:])
        done *= 2
    rest = width - done
    return np.minimum(values[:-rest], values[rest:]) if rest else values


def anchors(raw: bytes, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """Anchors of all windows: place, first and last window start that it serves, hash of its k-gram."""
    parts: list[tuple[np.ndarray, ...]] = []
    for begin in range(0, len(raw) - length + 1, SEGMENT_BYTES):
        piece = raw[begin:begin + SEGMENT_BYTES + length - 1]
        with np.errstate(over="ignore"):
            hashes = _gram_hashes(_BYTES[np.frombuffer(piece, dtype=np.uint8)], gram)
        ranked = (hashes & ~_PLACE) | np.arange(len(hashes), dtype=np.uint64)
        chosen = (_window_min(ranked, length - gram + 1) & _PLACE).astype(np.int64)
        first = np.flatnonzero(np.concatenate(([True], chosen[1:] != chosen[:-1])))
        last = np.append(first[1:], len(chosen)) - 1
        place = chosen[first]
        parts.append((place + begin, first + begin, last + begin, hashes[place].view(np.int64)))
    if not parts:
        return tuple(np.zeros(0, dtype=np.int64) for _ in range(4))
    return tuple(np.concatenate(p) for p in zip(*parts))


def text_key(raw: bytes) -> int:
    return int(hashlib.sha256(raw).hexdigest()[:15], 16)


def _key_column() -> Column:
    return F.conv(F.substring(F.sha2("text", 256), 1, 15), 16, 10).cast("long")


def repeated_anchors(source: DataFrame, length: int, gram: int) -> DataFrame:
    """key, n, place, hash of the anchors whose k-gram is at another anchor too (one row or more each)."""
    size = source.agg(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0
    buckets = max(8, min(1 << 20, size // (80 * BUCKET_ANCHORS)))
    names = ("hashes", "keys", "sizes", "places")

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        waiting, seen = 0, set()

        def dealt(rows: np.ndarray, by: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            """Rows in the order of their buckets, and where each bucket begins."""
            bucket = (mixed(by) % np.uint64(buckets)).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            return rows[:, order], np.searchsorted(bucket[order], np.arange(buckets + 1))

        def emit() -> pa.RecordBatch:
            rows = np.concatenate(held, axis=1)
            rows = rows[:, np.argsort(rows[0], kind="stable")]
            same = rows[0, 1:] == rows[0, :-1]
            head = np.concatenate(([True], ~same))
            repeated = np.concatenate((same, [False])) | ~head
            # One row per k-gram goes on to the bucket of its k-gram. Rows that repeat here are found already:
            # they need not meet, and are dealt evenly, so that a common passage fills no bucket.
            out = []
            sent, found = rows[:, head], rows[:, repeated]
            sent, cuts = dealt(sent, sent[0].view(np.uint64))
            found, found_cuts = dealt(found, mixed(found[1].view(np.uint64)) + found[3].view(np.uint64))
            for k, (i, j, a, b) in enumerate(zip(cuts, cuts[1:], found_cuts, found_cuts[1:])):
                if j > i or b > a:
                    out.append((k, *(r[i:j].tobytes() for r in sent), *(r[a:b].tobytes() for r in found)))
            kinds = (pa.int32(), *[pa.binary()] * 8)
            return pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(zip(*out), kinds)],
                ["bucket", *names, *(f"found_{n}" for n in names)])

        for batch in batches:
            for text in batch.column(0):
                raw = text.as_py().encode("utf-8", "replace")
                if len(raw) < length:
                    continue
                key = text_key(raw)
                if key in seen:
                    continue
                seen.add(key)
                place, _, _, hashes = anchors(raw, length, gram)
                held.append(np.stack((hashes, np.full_like(place, key), np.full_like(place, len(raw)), place)))
                waiting += len(place)
                if waiting >= CHUNK_ANCHORS:
                    yield emit()
                    held, waiting = [], 0
                    if len(seen) > 1_000_000:
                        seen.clear()
        if held:
            yield emit()

    def meet(group: pd.DataFrame) -> pd.DataFrame:
        def all_of(prefix: str) -> np.ndarray:
            return np.stack([np.frombuffer(b"".join(group[prefix + n]), dtype=np.int64) for n in names])

        rows = all_of("")
        rows = rows[:, np.argsort(rows[0], kind="stable")]
        same = rows[0, 1:] == rows[0, :-1]
        repeated = np.concatenate((same, [False])) | np.concatenate(([False], same))
        rows = np.concatenate((rows[:, repeated], all_of("found_")), axis=1)
        return pd.DataFrame({"hash": rows[0], "key": rows[1], "n": rows[2], "place": rows[3]})

    sent = source.select("text").mapInArrow(
        send, "bucket int, " + ", ".join(f"{n} binary" for n in names)
        + ", " + ", ".join(f"found_{n} binary" for n in names))
    return sent.groupBy("bucket").applyInPandas(meet, "hash long, key long, n long, place long")


def _suffixes(candidates: DataFrame, length: int, gram: int, hot: bool, splitters: list[bytes]) -> DataFrame:
    """A row per wanted anchor of each text: bucket, lead (its k-gram), key, n, place, first, bytes. Only
    the hot anchors, or only the others."""
    shared = candidates.sparkSession.sparkContext.broadcast(splitters)
    names = ["bucket", "lead", "key", "n", "place", "first", "bytes"]
    kinds = [pa.int32(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bounds = shared.value
        for batch in batches:
            for key, n, text, places, hot_places in zip(*(batch.column(c) for c in range(5))):
                raw = text.as_py().encode("utf-8", "replace")
                place, first, last, _ = anchors(raw, length, gram)
                warm = set(hot_places.as_py())
                mine = warm if hot else set(places.as_py()) - warm
                rows = [
                    (bisect_right(bounds, raw[p:p + gram]), raw[p:p + gram], key.as_py(), n.as_py(), p, a,
                     raw[a:b + length])
                    for p, a, b in zip(place.tolist(), first.tolist(), last.tolist()) if p in mine
                ]
                if rows:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)

    wanted = candidates if not hot else candidates.filter(F.size("hot") > 0)
    return wanted.select("key", "n", "text", "places", "hot").mapInArrow(
        run, "bucket int, lead binary, key long, n long, place long, first long, bytes binary")


def _splitters(candidates: DataFrame, texts: int, length: int, gram: int, buckets: int) -> list[bytes]:
    """At most `buckets` - 1 leading k-grams that cut a sample of the suffixes into equal parts."""
    part = F.pmod(F.xxhash64("key", "n"), F.lit(1 << 20)) <= min(1 << 20, (SAMPLED_TEXTS << 20) // max(1, texts))
    rows = _suffixes(candidates.filter(part), length, gram, False, []).select("lead").limit(
        SAMPLED_SUFFIXES).collect()
    leads = sorted(bytes(r["lead"]) for r in rows)
    return sorted({leads[len(leads) * k // buckets] for k in range(1, buckets)}) if leads else []


def multikey_sort(words: np.ndarray) -> np.ndarray:
    """Order of rows of words, by multikey quicksort: split in three by a pivot's word, go to the next
    word where the words are equal; short stretches are sorted at once."""
    order = np.arange(len(words))
    waiting = [(0, len(words), 0)]
    while waiting:
        low, high, depth = waiting.pop()
        while high - low > 1 and depth < words.shape[1]:
            part = order[low:high]
            column = words[part, depth]
            if high - low <= _SMALL:
                order[low:high] = part[np.lexsort(words[part, depth:].T[::-1])]
                break
            pivot = np.sort(column[[0, len(column) // 2, -1]])[1]
            less, more = column < pivot, column > pivot
            equal = ~(less | more)
            order[low:high] = np.concatenate((part[less], part[equal], part[more]))
            one, two = low + int(less.sum()), high - int(more.sum())
            waiting.append((low, one, depth))
            waiting.append((two, high, depth))
            low, high, depth = one, two, depth + 1
    return order


def repeated_windows(first: np.ndarray, place: np.ndarray, data: list[bytes], length: int
                     ) -> tuple[np.ndarray, np.ndarray]:
    """Smallest and largest number of bytes before the anchor for which a window also occurs at
    another row (largest -1: none does). Windows of a row start at `first` and later."""
    n = len(data)
    before = place - first
    sizes = np.fromiter(map(len, data), np.int64, n)
    least = before - (sizes - length)
    # From the anchor on, padded to whole words; then what lies before it, in the order of the suffixes.
    after = np.zeros((n, -(-length // 8) * 8), dtype=np.uint8)
    for i, (text, skip) in enumerate(zip(data, before.tolist())):
        after[i, :len(text) - skip] = np.frombuffer(text, np.uint8, offset=skip)
    words = after.view(">u8").astype(np.uint64)
    order = multikey_sort(words)
    del words
    common = np.empty(max(0, n - 1), dtype=np.int64)
    for i in range(0, n - 1, ROWS_AT_ONCE):
        part = after[order[i:i + ROWS_AT_ONCE + 1], :length]
        differ = part[1:] != part[:-1]
        common[i:i + ROWS_AT_ONCE] = np.where(differ.any(axis=1), differ.argmax(axis=1), length)
    del after
    before, least = before[order], least[order]
    reach = int(before.max(initial=0))
    ahead = np.zeros((n, reach), dtype=np.uint8)
    for i, (row, skip) in enumerate(zip(order.tolist(), before.tolist())):
        if skip:
            ahead[i, reach - skip:] = np.frombuffer(data[row], np.uint8, skip)
    low = np.full(n, 1 << 30)
    high = np.full(n, -1)
    left = np.zeros(n, dtype=np.uint64)
    for d in range(0, int(before.max(initial=-1)) + 1):
        if d:
            left = left * _BASE + _BYTES[ahead[:, reach - d]]
        stretch = np.concatenate(([0], np.cumsum(common < length - d)))
        able = np.flatnonzero((before >= d) & (least <= d))
        if len(able) < 2:
            continue
        keys = mixed(left[able]) + mixed(stretch[able].astype(np.uint64))
        ranked = np.argsort(keys, kind="stable")
        same = keys[ranked][1:] == keys[ranked][:-1]
        twice = np.zeros(len(able), dtype=bool)
        twice[ranked[1:][same]] = True
        twice[ranked[:-1][same]] = True
        hit = able[twice]
        low[hit] = np.minimum(low[hit], d)
        high[hit] = d
    result_low, result_high = np.empty_like(low), np.empty_like(high)
    result_low[order], result_high[order] = low, high
    return result_low, result_high


_MARKS = "key long, n long, start long, stop long"


def _marks(key, n, start, stop) -> pa.Table:
    return pa.table({"key": pa.array(key, pa.int64()), "n": pa.array(n, pa.int64()),
                     "start": pa.array(start, pa.int64()), "stop": pa.array(stop, pa.int64())})


def _bucket_marks(suffixes: DataFrame, length: int) -> DataFrame:
    def run(rows: pa.Table) -> pa.Table:
        key, n, place, first = (rows.column(c).to_numpy() for c in ("key", "n", "place", "first"))
        low, high = repeated_windows(first, place, rows.column("bytes").to_pylist(), length)
        hit = high >= 0
        return _marks(key[hit], n[hit], place[hit] - high[hit], place[hit] - low[hit] + length)

    return suffixes.select("bucket", "key", "n", "place", "first", "bytes").groupBy("bucket").applyInArrow(
        run, _MARKS)


def _hot_marks(suffixes: DataFrame, length: int) -> DataFrame:
    """Windows of very frequent k-grams by a 128-bit digest. A task marks what is equal within it and
    sends each different window once; what two tasks sent is marked too."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: dict[bytes, tuple[int, int, int]] = {}
        again: set[bytes] = set()

        def sent() -> pd.DataFrame:
            rows = [(digest, *at, at[2] + length, False) for digest, at in seen.items()]
            return pd.DataFrame(rows, columns=["digest", "key", "n", "start", "stop", "marked"])

        for batch in batches:
            marks = []
            for key, n, first, data in zip(batch["key"], batch["n"], batch["first"], batch["bytes"]):
                low, high = None, None
                for i in range(len(data) - length + 1):
                    digest = hashlib.blake2b(data[i:i + length], digest_size=16).digest()
                    at = (key, n, first + i)
                    old = seen.setdefault(digest, at)
                    if old is at:
                        continue
                    if digest not in again:
                        again.add(digest)
                        marks.append((None, *old, old[2] + length, True))
                    low, high = first + i if low is None else low, first + i
                if high is not None:  # an anchor's windows all overlap
                    marks.append((None, key, n, low, high + length, True))
            yield pd.DataFrame(marks, columns=["digest", "key", "n", "start", "stop", "marked"])
            if len(seen) > HOT_WINDOWS:
                yield sent()
                seen.clear()
                again.clear()
        yield sent()

    rows = saved(suffixes.select("key", "n", "first", "bytes").mapInPandas(
        run, "digest binary, " + _MARKS + ", marked boolean"), "hot-windows")
    single = rows.filter("NOT marked")
    twice = single.groupBy("digest").count().filter(F.col("count") > 1).select("digest")
    columns = ["key", "n", "start", "stop"]
    return rows.filter("marked").select(*columns).unionByName(
        single.join(twice, "digest", "left_semi").select(*columns))


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                    length: int = LENGTH, gram: int = GRAM, hot_anchors: int = HOT_ANCHORS,
                    bucket_suffixes: int = BUCKET_SUFFIXES) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept (binary, null for whole texts), one row per row.

    A byte is removed when a string of `length` bytes that covers it also starts anywhere else in any
    text, the same one included; strings overlap freely, do not cross texts, and are judged on
    the input. No text counts as empty. Repeated rows are equal texts, so all they hold goes, if it is
    long enough. Texts are told apart by 60 bits of their SHA-256 and their size. An empty table
    gives no rows; other columns are not looked at.
    """
    source = documents_of(docs, id_col, text_col)
    keyed = source.withColumn("key", _key_column()).withColumn("n", F.octet_length("text").cast("long"))
    found = saved(repeated_anchors(source, length, gram), "repeated-anchors")
    hot = saved(found.groupBy("hash").count().filter(F.col("count") > hot_anchors).select(
        "hash", F.lit(True).alias("hot")), "hot-hashes")
    if hot.count() <= MAX_BROADCAST:  # else an ordinary join
        hot = F.broadcast(hot)
    places = found.join(hot, "hash", "left").groupBy("key", "n").agg(
        F.collect_set("place").alias("places"),
        F.collect_set(F.when(F.col("hot"), F.col("place"))).alias("hot"))
    once = Window.partitionBy("key", "n").orderBy("n")
    texts = keyed.select("key", "n", "text").filter(F.col("n") >= length).withColumn(
        "copy", F.row_number().over(once)).filter("copy = 1").drop("copy")
    candidates = saved(texts.join(places, ["key", "n"]), "texts-with-repeats")
    sizes = candidates.agg(
        F.sum(F.size("places")).alias("n"), F.count(F.lit(1)).alias("texts"),
        F.max(F.size("hot")).alias("hot")).first()
    buckets = max(1, -(-(sizes["n"] or 0) // bucket_suffixes))
    splitters = _splitters(candidates, sizes["texts"], length, gram, buckets)
    marks = _bucket_marks(_suffixes(candidates, length, gram, False, splitters), length)
    if sizes["hot"]:
        marks = marks.unionByName(_hot_marks(_suffixes(candidates, length, gram, True, []), length))
    spans = marks.groupBy("key", "n").agg(F.collect_set(F.struct("start", "stop")).alias("spans"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for key, n, text, marked in zip(*(batch.column(c).to_pylist() for c in range(4))):
                raw, kept, at, runs = text.encode("utf-8", "replace"), [], 0, 0
                for start, stop in sorted((m["start"], m["stop"]) for m in marked):
                    if start > at or not runs:
                        kept.append(raw[at:start])
                        runs += 1
                    at = max(at, stop)
                kept = b"".join([*kept, raw[at:]])
                rows.append((key, n, len(raw) - len(kept), runs, kept))
            if not rows:
                continue
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(zip(*rows), [pa.int64()] * 4 + [pa.binary()])],
                ["key", "n", "removed", "runs", "rest"])

    shortened = saved(
        candidates.select("key", "n", "text").join(spans, ["key", "n"]).mapInArrow(
            cut, "key long, n long, removed long, runs long, rest binary"), "shortened-texts")
    copies = keyed.groupBy("key", "n").count().filter(
        (F.col("count") > 1) & (F.col("n") >= length)).select("key", "n", F.lit(True).alias("copied"))
    rows = keyed.select("doc_id", "key", "n", F.sha2("text", 256).alias("whole")).join(
        copies, ["key", "n"], "left").join(shortened, ["key", "n"], "left")
    copied = F.coalesce(F.col("copied"), F.lit(False))
    rest = F.when(copied, F.lit(b"")).otherwise(F.col("rest"))
    zero = F.lit(0).cast("long")
    return rows.select(
        "doc_id", F.col("n").alias("n_bytes"),
        F.when(copied, F.col("n")).otherwise(F.coalesce("removed", zero)).alias("n_removed"),
        F.when(copied, F.lit(1).cast("long")).otherwise(F.coalesce("runs", zero)).alias("n_spans"),
        F.coalesce(F.sha2(rest, 256), F.col("whole")).alias("kept_sha256"),
        rest.alias("kept"),
    )
