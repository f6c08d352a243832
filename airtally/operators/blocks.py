"""Near pairs of hashes between all queries and all references, block by block.

Both sides are cut into blocks by a hash of the row, and every block of queries meets every block of
references once. What is shuffled are whole hashes, once per block of the other side, not their pieces; a
task holds one block of each side, however many hashes share a piece. Inside a block a pair is looked at
only when it shares a piece.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from airtally.functions import hashes
from airtally.session import saved

# Rows of a block: some 300 MB in the task that has both sides.
MOST_QUERIES = 1 << 20
MOST_REFERENCES = 1 << 21
# Smaller blocks may be asked for as long as they are no more than this.
QUERY_BLOCKS = 64
REFERENCE_BLOCKS = 4
# Fewer queries than this are not worth a block of their own.
LEAST_QUERIES = 1_000
BLOCKS_PER_CORE = 4
# More than one block per core and list only if each has this many queries, which share the work on the references.
WORTH_A_BLOCK = 1 << 16
# Pairs looked at in one step, and those of one piece from which on they are looked at as a rectangle.
STEP = 1 << 18
RECTANGLE = 1 << 11
# What a rectangle is computed in stays close to the core.
RECTANGLE_STEP = 1 << 15
# A rectangle of so many pairs and queries is a product of matrices, in tiles of so many rows and columns. Of unrelated
# pairs one in some thousands is within 65 bits in so many bytes: more of them would cost more than they refuse.
PRODUCT, PRODUCT_ROWS = 1 << 17, 64
ROWS, COLUMNS = 192, 1024
TELLING_BYTES, WHOLE_BYTES = 22, 32
# From so many pairs on, queries with a reference nearby are compared with what lies around that reference only.
# Of unrelated hashes one in 600 is within this many bits of it, where one in eight shares a byte.
ANCHORED_PAIRS = 1 << 38
REACH = 104
# Width of the pieces by which a nearby reference is looked for, and the queries that have to share it: to compare
# it with all references costs as much as some dozen queries.
PROBE_BITS = 16
FOLLOWERS = 16
# Queries of one reference that stay together.
SLICE_QUERIES = 1 << 16


def _piece(lanes: np.ndarray, position: int, width: int) -> np.ndarray:
    """The run of bits at a position, as `hashes.pieces` cuts them."""
    per_lane = hashes.LANE_BITS // width
    shift = hashes.LANE_BITS - width * (position % per_lane + 1)
    found = lanes[position // per_lane] >> np.uint64(shift)
    if width < hashes.LANE_BITS:
        found = found & np.uint64((1 << width) - 1)
    # Numbers of 16 bits are sorted by digits.
    return found.astype(np.uint16) if width <= 16 else found


def _distance(a: Sequence[np.ndarray], b: Sequence[np.ndarray]) -> np.ndarray:
    total = np.bitwise_count(a[0] ^ b[0])
    if len(a) > 3:
        total = total.astype(np.uint16)
    for x, y in zip(a[1:], b[1:]):
        total += np.bitwise_count(x ^ y)
    return total


def _rectangle(a: np.ndarray, b: np.ndarray, tolerance: int,
               room: list[np.ndarray]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (row of a, row of b) within the tolerance, the longer side along the rows of a step. Works in
    the given room, since new memory for each step would cost more than the step."""
    if a.shape[1] > b.shape[1]:
        for j, i in _rectangle(b, a, tolerance, room):
            yield i, j
        return
    wide = min(b.shape[1], RECTANGLE_STEP)
    high = min(a.shape[1], max(1, RECTANGLE_STEP // wide))
    for right in range(0, b.shape[1], wide):
        along = b[:, right:right + wide]
        for top in range(0, a.shape[1], high):
            down = a[:, top:top + high, None]
            shape = (down.shape[1], along.shape[1])
            words, ones, total, near = (x[:shape[0] * shape[1]].reshape(shape) for x in room)
            for lane in range(len(a)):
                np.bitwise_xor(down[lane], along[lane], out=words)
                np.bitwise_count(words, out=ones if lane else total)
                if lane:
                    np.add(total, ones, out=total)
            np.less_equal(total, tolerance, out=near)
            place = np.flatnonzero(near)
            if len(place):
                i, j = np.divmod(place, shape[1])
                yield i + top, j + right


def _byte_lines(lanes: np.ndarray, most: int) -> np.ndarray:
    """The first bytes of lanes, a line per byte."""
    split = np.ascontiguousarray(lanes).view(np.uint8).reshape(*lanes.shape, 8)
    return split.transpose(0, 2, 1).reshape(8 * len(lanes), lanes.shape[1])[:most]


def _product(a: np.ndarray, b: np.ndarray, tolerance: int, size: int,
             room: list[np.ndarray]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (row of a, row of b) that are within the tolerance in their first `size` bytes.

    The distances come from a product of matrices, since two rows are as far apart as they have bits less twice those
    they share. On one side is a row of a as bits, on the other are several rows of b, which share one number per bit
    and have a field of it each. A field ends up as half its range plus the tolerance less the distance, so its top
    bit says whether the pair is near. All are whole numbers below 2**53, so the product is exact. Works in
    the given room, since new memory for each step would cost much of the step.
    """
    bits = 8 * size
    fields, width = (6, 8) if bits - 128 <= tolerance < 128 else (5, 10)
    half = 1 << (width - 1)
    each = sum(1 << (width * k) for k in range(fields))
    top, twice = np.uint64(half * each), np.uint64(2 * each)
    left, right = _byte_lines(a, size), _byte_lines(b, size)
    own = np.bitwise_count(left).sum(axis=0, dtype=np.int64)
    rest = half + tolerance - np.bitwise_count(right).sum(axis=0, dtype=np.int64)
    for at in range(0, b.shape[1], fields * COLUMNS):
        part = right[:, at:at + fields * COLUMNS]
        columns = -(-part.shape[1] // fields)
        packed = np.zeros((size, columns), np.uint64)
        matrix = room[0][:(bits + 2) * columns].reshape(bits + 2, columns)
        matrix[bits], matrix[bits + 1] = 2.0 ** 52, -float(each)
        for k in range(fields):
            some = part[:, k::fields]
            packed[:, :some.shape[1]] |= some.astype(np.uint64) << np.uint64(width * k)
            matrix[bits, :some.shape[1]] += rest[at + k:at + part.shape[1]:fields] * 2.0 ** (width * k)
        cells = matrix[:bits].reshape(size, 8, columns)
        for bit in range(8):
            moved = packed >> np.uint64(bit - 1) if bit else packed << np.uint64(1)
            moved &= twice
            cells[:, 7 - bit] = moved.view(np.int64)
        # Fields without a row are as good as far apart from all.
        empty = float(sum(1 << (width * k) for k in range(part.shape[1] - fields * (columns - 1), fields)))
        matrix[bits, -1] += bits * empty
        for first in range(0, left.shape[1], ROWS):
            asked = left[:, first:first + ROWS]
            rows = asked.shape[1]
            flags = room[1][:(bits + 2) * rows].reshape(bits + 2, rows)
            flags[:bits], flags[bits], flags[bits + 1] = np.unpackbits(asked, axis=0), 1, own[first:first + ROWS]
            product = room[2][:rows * columns].reshape(rows, columns)
            near = np.matmul(flags.T, matrix, out=product).view(np.uint64).ravel()
            near &= top
            place = np.flatnonzero(near != 0)
            if len(place):
                i, column = np.divmod(place, columns)
                found = near[place]
                for k in range(fields):
                    good = (found >> np.uint64(width * k + width - 1)) & np.uint64(1) != 0
                    j = column[good] * fields + k
                    inside = j < part.shape[1]
                    yield i[good][inside] + first, j[inside] + at


def _room() -> list[np.ndarray]:
    bits = 8 * WHOLE_BYTES + 2
    return [np.empty(n) for n in (bits * COLUMNS, bits * ROWS, ROWS * COLUMNS)]


def _room_for_tiles(lanes: int) -> list[np.ndarray]:
    count = np.uint8 if lanes <= 4 else np.uint16
    return [np.empty(RECTANGLE_STEP, t) for t in (np.uint64, np.uint8, count, bool)]


def _lists(counts: np.ndarray, low: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (n, place) with `counts[n]` places from `low[n]` on, a step at a time."""
    ends = np.cumsum(counts)
    done = 0
    while done < len(counts):
        base = ends[done - 1] if done else 0
        upto = max(done + 1, int(np.searchsorted(ends, base + STEP, "right")))
        some = counts[done:upto]
        n = np.repeat(np.arange(done, upto), some)
        inside = np.arange(len(n)) - np.repeat(ends[done:upto] - some - base, some)
        yield n, low[n] + inside
        done = upto


def _met(q: np.ndarray, r: np.ndarray, position: int, width: int,
         tolerance: int, room: list[np.ndarray], tiles: list[np.ndarray]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows of pairs that share the piece at a position and may be within the tolerance."""
    q_piece, r_piece = _piece(q, position, width), _piece(r, position, width)
    q_order, r_order = np.argsort(q_piece, kind="stable"), np.argsort(r_piece, kind="stable")
    q_piece, r_piece = q_piece[q_order], r_piece[r_order]
    # The lane of the piece tells least; the others alone refuse nearly all.
    own = position // (hashes.LANE_BITS // width)
    telling = [i for i in range(len(q)) if i != own] or [own]
    qs, rs = (np.stack([side[i].take(order) for i in telling]) for side, order in ((q, q_order), (r, r_order)))
    size = min(8 * len(telling), TELLING_BYTES, 16 + tolerance // 8)
    start = np.flatnonzero(np.r_[True, q_piece[1:] != q_piece[:-1]])
    rows = np.diff(np.r_[start, len(q_piece)])
    low = np.searchsorted(r_piece, q_piece[start], "left")
    found = np.searchsorted(r_piece, q_piece[start], "right") - low
    large = rows * found >= RECTANGLE
    for g in np.flatnonzero(large):
        a, b, c, d = start[g], start[g] + rows[g], low[g], low[g] + found[g]
        by_product = rows[g] >= PRODUCT_ROWS and rows[g] * found[g] >= PRODUCT
        met = _product(qs[:, a:b], rs[:, c:d], tolerance, size, room) if by_product else _rectangle(
            qs[:, a:b], rs[:, c:d], tolerance, tiles)
        for i, j in met:
            yield q_order[i + a], r_order[j + c]
    small = np.repeat(~large & (found > 0), rows)
    asked = np.flatnonzero(small)
    for n, j in _lists(np.repeat(found, rows)[asked], np.repeat(low, rows)[asked]):
        i = asked[n]
        near = _distance([x.take(i) for x in qs], [x.take(j) for x in rs]) <= tolerance
        yield q_order[i[near]], r_order[j[near]]


def _gathered(pairs: Iterator[tuple[np.ndarray, np.ndarray]]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The same pairs in fewer, larger arrays."""
    left, right, rows = [], [], 0
    for i, j in pairs:
        left.append(i)
        right.append(j)
        rows += len(i)
        if rows >= STEP:
            yield np.concatenate(left), np.concatenate(right)
            left, right, rows = [], [], 0
    if rows:
        yield np.concatenate(left), np.concatenate(right)


def near_rows(q: np.ndarray, r: np.ndarray, width: int, tolerance: int,
              min_shared: int = 1) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows of q and r (arrays of lanes) of all pairs within the tolerance that share at least `min_shared`
    pieces. A pair comes once, at the first piece that it shares."""
    total = (hashes.LANE_BITS // width) * len(q)
    if not q.shape[1] or not r.shape[1]:
        return
    room, tiles = _room(), _room_for_tiles(len(q))
    for position in range(total):
        for i, j in _gathered(_met(q, r, position, width, tolerance, room, tiles)):
            apart = q[:, i] ^ r[:, j]
            good = np.bitwise_count(apart).sum(axis=0, dtype=np.int64) <= tolerance
            i, j, apart = i[good], j[good], apart[:, good]
            fresh = np.ones(len(i), bool)
            for earlier in range(position):
                fresh &= _piece(apart, earlier, width) != 0
            if min_shared > 1:
                shared = sum((_piece(apart, p, width) == 0).astype(np.int64) for p in range(position, total))
                fresh &= shared >= min_shared
            if fresh.any():
                yield i[fresh], j[fresh]


def _apart(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a ^ b).sum(axis=0, dtype=np.int64)


def _smaller(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    less, same = np.zeros(a.shape[1], bool), np.ones(a.shape[1], bool)
    for x, y in zip(a, b):
        less |= same & (x < y)
        same &= x == y
    return less


def _nearest_of(q: np.ndarray, r: np.ndarray,
                pairs: Iterator[tuple[np.ndarray, np.ndarray]]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Of pairs of rows the nearest one of each row of q; equal distances go to the smaller hash."""
    far = 64 * len(q) + 1
    best, place = np.full(q.shape[1], far), np.zeros(q.shape[1], np.int64)
    for i, j in pairs:
        d = _apart(q[:, i], r[:, j])
        order = np.lexsort((*r[::-1, j], d, i))
        i, j, d = i[order], j[order], d[order]
        first = np.flatnonzero(np.r_[True, i[1:] != i[:-1]])
        i, j, d = i[first], j[first], d[first]
        better = d < best[i]
        tie = np.flatnonzero(d == best[i])
        better[tie] = _smaller(r[:, j[tie]], r[:, place[i[tie]]])
        best[i[better]], place[i[better]] = d[better], j[better]
    found = np.flatnonzero(best < far)
    yield found, place[found]


def around_rows(q: np.ndarray, anchors: np.ndarray, r: np.ndarray, tolerance: int, min_shared: int,
                nearest: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows of q and r of all pairs within the tolerance that share at least `min_shared` bytes, by way of an anchor of
    each q. With `nearest` only pairs that are no farther apart than q and its anchor.

    What is within some distance of a hash is, of its anchor, at most so much farther away as the two are apart.
    So each distinct anchor is compared with all of r, and its queries only with those within their reach.
    """
    off = _apart(q, anchors)
    radius = off if nearest else np.full(q.shape[1], tolerance)
    reach = off + radius
    order = np.lexsort((reach, *anchors))
    anchors, reach = anchors[:, order], reach[order]
    start = np.flatnonzero(np.r_[True, (anchors[:, 1:] != anchors[:, :-1]).any(axis=0)])
    end = np.r_[start[1:], len(order)]
    # Queries of an anchor lie in order of their reach.
    wide = 2 * 64 * len(q) + 1
    key = np.repeat(np.arange(len(start)), end - start) * wide + reach
    own, farthest = np.ascontiguousarray(anchors[:, start]), reach[end - 1]
    for g, j in _gathered(_product(own, r, int(farthest.max()), 8 * len(q), _room())):
        d = _apart(own[:, g], r[:, j])
        near = d <= farthest[g]
        g, j, d = g[near], j[near], d[near]
        low = np.searchsorted(key, g * wide + d, "left")
        for n, place in _lists(end[g] - low, low):
            i, k = order[place], j[n]
            apart = q[:, i] ^ r[:, k]
            good = np.bitwise_count(apart).sum(axis=0, dtype=np.int64) <= radius[i]
            i, k, apart = i[good], k[good], apart[:, good]
            shared = (_byte_lines(apart, 8 * len(q)) == 0).sum(axis=0) >= min_shared
            if shared.any():
                yield i[shared], k[shared]


def _parts(rows: int, wanted: int, most: int, limit: int) -> int:
    return max(1, -(-rows // most), min(-(-rows // wanted), limit))


def _cut(spark: SparkSession, asked: int, listed: int, query_rows: int, reference_rows: int,
         worth: int = WORTH_A_BLOCK) -> tuple[int, int]:
    """Blocks of the queries and of the references: as many as fill all cores some whole times."""
    lists = _parts(listed, reference_rows, MOST_REFERENCES, REFERENCE_BLOCKS)
    cores = spark.sparkContext.defaultParallelism
    turns = min(max(1, asked * lists // (worth * cores)), BLOCKS_PER_CORE)
    return max(_parts(asked, query_rows, MOST_QUERIES, QUERY_BLOCKS),
               min(-(-turns * cores // lists), -(-asked // LEAST_QUERIES))), lists


def _in_blocks(queries: DataFrame, references: DataFrame, names: Sequence[str], more: Sequence[str], mine: Column,
               slices: int, lists: int, rows_of: Callable) -> DataFrame:
    """Lanes of the pairs that `rows_of` finds between each block of queries and each block of references. Queries
    come with their lanes and `more`, `mine` is the number of a query's block."""
    found = references.columns
    lanes = [f"lane{i}" for i in range(len(names) + len(more))]

    def placed(frame: DataFrame, own: Column, is_query: bool) -> DataFrame:
        others = lists if is_query else slices
        every = F.explode(F.sequence(F.lit(0), F.lit(others - 1))).alias("other")
        cells = [F.col(c) for c in ([*names, *more] if is_query else found)]
        cells += [F.lit(0).cast("long")] * (len(lanes) - len(cells))
        rows = frame.select(own.alias("mine"), every, *[c.alias(n) for c, n in zip(cells, lanes)])
        block = F.col("mine") * lists + F.col("other") if is_query else F.col("other") * lists + F.col("mine")
        return rows.select(block.alias("block"), F.lit(is_query).alias("asks"), *lanes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sides: dict[int, tuple[list, list]] = {}
        for batch in batches:
            block, asks = (batch.column(n).to_numpy(zero_copy_only=False) for n in ("block", "asks"))
            rows = np.stack([batch.column(n).to_numpy() for n in lanes]).view(np.uint64)
            for number in np.unique(block):
                asked, listed = sides.setdefault(int(number), ([], []))
                asked.append(rows[:, asks & (block == number)])
                listed.append(rows[:len(found), ~asks & (block == number)])
        while sides:
            asked, listed = sides.popitem()[1]
            q, r = np.concatenate(asked, axis=1), np.concatenate(listed, axis=1)
            del asked, listed
            if not q.shape[1] or not r.shape[1]:
                continue
            for i, j in rows_of(q, r):
                for at in range(0, len(i), STEP):
                    both = np.concatenate([q[:len(names), i[at:at + STEP]], r[:, j[at:at + STEP]]]).view(np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in both], names=[*names, *found])

    listed = F.pmod(F.xxhash64(*references.columns), F.lit(lists)).cast("int")
    blocks = placed(queries, mine, True).unionByName(placed(references, listed, False))
    schema = ", ".join(f"{c} long" for c in [*names, *found])
    # A partition is one block; by a hash of their numbers some partitions would have several and others none.
    return blocks.repartitionById(slices * lists, "block").mapInArrow(run, schema)


def _by_pieces(queries: DataFrame, references: DataFrame, cut: tuple[int, int], width: int, tolerance: int,
               min_shared: int, first_only: bool = False) -> DataFrame:
    """Pairs that share pieces; with `first_only` the nearest of each query in each block of references."""

    def rows_of(q: np.ndarray, r: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        met = near_rows(q, r, width, tolerance, min_shared)
        return _nearest_of(q, r, met) if first_only else met

    mine = F.pmod(F.xxhash64(*queries.columns), F.lit(cut[0])).cast("int")
    return _in_blocks(queries, references, queries.columns, (), mine, *cut, rows_of)


def near(queries: DataFrame, references: DataFrame, width: int, tolerance: int, min_shared: int,
         query_rows: int, reference_rows: int) -> DataFrame:
    """The lanes of both sides of all pairs within the tolerance that share at least `min_shared` pieces, each
    pair once. Both frames hold distinct lanes and are counted, so they should be tables.

    Blocks have at most the given rows, unless that would make more blocks than it pays to copy the
    other side for.
    """
    asked, listed = queries.count(), references.count()
    if anchors_pay(queries, asked * listed, width, tolerance):
        first = probe(queries, references, tolerance, query_rows, reference_rows)
        return near_after(first, references, tolerance, min_shared, query_rows, reference_rows, False)
    cut = _cut(queries.sparkSession, asked, listed, query_rows, reference_rows)
    return _by_pieces(queries, references, cut, width, tolerance, min_shared)


def anchors_pay(queries: DataFrame, pairs: int, width: int, tolerance: int) -> bool:
    """Whether there are so many pairs that to look for a nearby reference first costs little beside them. The
    reach is measured for hashes of 256 bits and pieces of a byte."""
    return pairs >= ANCHORED_PAIRS and width == 8 and len(queries.columns) == 4 and PROBE_BITS <= tolerance <= REACH


def probe(queries: DataFrame, references: DataFrame, tolerance: int, query_rows: int,
          reference_rows: int) -> DataFrame:
    """Each query with the distance (`off`) and the lanes of the nearest reference within the tolerance that shares a
    wide piece with it, or nulls. Distances below `PROBE_BITS` are those of the nearest reference of all."""
    # The work is that of copying and sorting the references more than that of the pairs.
    cut = _cut(queries.sparkSession, queries.count(), references.count(), query_rows, reference_rows, MOST_QUERIES)
    q, r = queries.columns, references.columns
    met = _by_pieces(queries, references, cut, PROBE_BITS, tolerance, 1, True)
    off = hashes.lane_distance([F.col(c) for c in q], [F.col(c) for c in r]).cast("int")
    # Lanes order as the hex text does once their sign is turned.
    turned = [F.col(c).bitwiseXOR(F.lit(-(1 << 63))).alias(c) for c in r]
    pair = met.select(*q, F.struct(off.alias("off"), *turned).alias("pair"))
    alone = queries.select(*q, F.lit(None).cast(pair.schema["pair"].dataType).alias("pair"))
    best = pair.unionByName(alone).groupBy(*q).agg(F.min("pair").alias("best"))
    back = [F.col(f"best.{c}").bitwiseXOR(F.lit(-(1 << 63))).alias(c) for c in r]
    return saved(best.select(*q, F.col("best.off").alias("off"), *back), "probed")


def near_after(probed: DataFrame, references: DataFrame, tolerance: int, min_shared: int, query_rows: int,
               reference_rows: int, nearest: bool) -> DataFrame:
    """The same pairs as `near` by bytes, of queries that were probed. With `nearest` at least the nearest pairs of each.

    A query that follows a reference which many others follow too is compared with what lies around that one;
    all others meet the references that share a byte.
    """
    spark, r = probed.sparkSession, references.columns
    q = [c for c in probed.columns if c not in (*r, "off")]
    within = F.coalesce(F.col("off") + (F.col("off") if nearest else F.lit(tolerance)) <= REACH, F.lit(False))
    close = probed.filter(within).select(*q, *r)
    many = close.groupBy(*r).agg(F.count(F.lit(1)).alias("followers")).filter(F.col("followers") >= FOLLOWERS)
    # Both sides grow with the tables; a reference that very many follow is left to the skew join.
    counted = saved(close.join(many.hint("merge"), r, "left").select(*q, *r, "followers"), "anchored")
    around = counted.filter(F.col("followers").isNotNull())
    rest = saved(probed.filter(~within).select(*q).unionByName(
        counted.filter(F.col("followers").isNull()).select(*q)), "alone")
    listed = references.count()
    cut = _cut(spark, rest.count(), listed, query_rows, reference_rows)
    pairs = _by_pieces(rest, references, cut, 8, tolerance, min_shared)

    def rows_of(rows: np.ndarray, refs: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        lanes = len(refs)
        return around_rows(rows[:lanes], rows[lanes:], refs, tolerance, min_shared, nearest)

    cut = _cut(spark, around.count(), listed, query_rows, reference_rows)
    part = F.pmod(F.xxhash64(*q), F.ceil(F.col("followers") / SLICE_QUERIES))
    mine = F.pmod(F.xxhash64(*r, part), F.lit(cut[0])).cast("int")
    own = [f"a{i}" for i in range(len(r))]
    placed = around.select(*q, *[F.col(c).alias(a) for c, a in zip(r, own)], mine.alias("mine"))
    met = _in_blocks(placed, references, q, own, F.col("mine"), *cut, rows_of)
    return pairs.unionByName(met)
