"""Byte-level BPE: texts to token ids and back.

A text is cut by the tokenizer's pattern; each piece is merged on its own. Over the bytes of a
piece lies a segment tree: leaf i holds the rank of the pair of the token that starts at byte i
and the next one, an inner node the smaller of its children. The root tells the smallest rank, a
walk down that prefers the left child finds its leftmost place, and a merge changes three leaves:
the pair itself, the pair before, and the pair that is gone. So a piece of n bytes takes
O(n log n), however long it is.

Many short pieces are merged side by side, each in its own row of a numpy array that holds the
same tree; long ones one by one.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from airtally.llm.tables import documents_of

NONE = 1 << 30
LONG_PIECE = 65
CACHED_PIECES = 250_000
CHUNK_CHARS = 1_000_000
BATCH_ROWS = 1000
MAX_VOCABULARY = 2_000_000


def load_ranks(path: str) -> dict[bytes, int]:
    """Token bytes to rank, from a file of lines `base64 rank`."""
    with open(path, "rb") as lines:
        pairs = (line.split() for line in lines if line.strip())
        return {base64.b64decode(token): int(rank) for token, rank in pairs}


class Merger:
    """Encodes pieces by ranks; keeps the ids of recent pieces as packed bytes."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks = ranks
        self.split = regex.compile(pattern).findall
        self.known: dict[str, bytes] = {}
        pairs = [
            ((ranks[token[:cut]] << 32) | ranks[token[cut:]], rank)
            for token, rank in ranks.items()
            for cut in range(1, len(token))
            if token[:cut] in ranks and token[cut:] in ranks
        ]
        pairs.sort()
        self.pair_keys = np.array([key for key, _ in pairs] + [np.iinfo(np.int64).max], dtype=np.int64)
        self.pair_ranks = np.array([rank for _, rank in pairs] + [NONE], dtype=np.int64)
        self.byte_ids = np.array([ranks.get(bytes([b]), -1) for b in range(256)], dtype=np.int64)
        if (self.byte_ids < 0).any():
            raise ValueError("the vocabulary lacks single bytes")

    def merge_one(self, piece: bytes) -> list[int]:
        ranks = self.ranks
        if piece in ranks:
            return [ranks[piece]]
        n = len(piece)
        size = 1
        while size < n - 1:
            size *= 2
        tree = [NONE] * (2 * size)
        end = list(range(1, n + 1))
        before = list(range(-1, n))
        for i in range(n - 1):
            tree[size + i] = ranks.get(piece[i:i + 2], NONE)
        for node in range(size - 1, 0, -1):
            tree[node] = min(tree[2 * node], tree[2 * node + 1])

        def put(leaf: int, rank: int) -> None:
            node = size + leaf
            tree[node] = rank
            while node > 1:
                node //= 2
                smaller = min(tree[2 * node], tree[2 * node + 1])
                if tree[node] == smaller:
                    return
                tree[node] = smaller

        while tree[1] < NONE:
            smallest, node = tree[1], 1
            while node < size:
                node *= 2
                if tree[node] != smallest:
                    node += 1
            left = node - size
            right = end[left]
            stop = end[right]
            end[left] = stop
            before[stop] = left
            put(right, NONE) if right < n - 1 else None
            put(left, ranks.get(piece[left:end[stop]], NONE) if stop < n else NONE)
            if before[left] >= 0:
                put(before[left], ranks.get(piece[before[left]:stop], NONE))
        ids, at = [], 0
        while at < n:
            ids.append(ranks[piece[at:end[at]]])
            at = end[at]
        return ids

    def _pair_rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        keys = (left << 32) | right
        places = np.searchsorted(self.pair_keys, keys)
        return np.where(self.pair_keys[places] == keys, self.pair_ranks[places], NONE)

    def merge_many(self, pieces: list[bytes], size: int) -> list[bytes]:
        """Packed ids of pieces of 2 to size + 1 bytes, all merged side by side."""
        rows, width = len(pieces), size + 1
        lengths = np.array([len(p) for p in pieces], dtype=np.int64)
        data = np.frombuffer(b"".join(p.ljust(width, b"\0") for p in pieces), dtype=np.uint8)
        places = np.arange(width)
        inside = places < lengths[:, None]
        ids = np.where(inside, self.byte_ids[data.reshape(rows, width)], -1)
        # End of the token that starts at a byte, and start of the token before it.
        end = np.broadcast_to(places + 1, (rows, width)).copy()
        before = np.broadcast_to(np.arange(-1, width), (rows, width + 1)).copy()
        tree = np.full((rows, 2 * size), NONE, dtype=np.int64)
        paired = inside[:, 1:]
        tree[:, size:][paired] = self._pair_rank(ids[:, :-1][paired], ids[:, 1:][paired])
        node = size
        while node > 1:
            tree[:, node // 2:node] = np.minimum(tree[:, node:2 * node:2], tree[:, node + 1:2 * node:2])
            node //= 2

        def put(row: np.ndarray, leaf: np.ndarray, rank) -> None:
            at = leaf + size
            tree[row, at] = rank
            step = size
            while step > 1:
                at = at >> 1
                tree[row, at] = np.minimum(tree[row, 2 * at], tree[row, 2 * at + 1])
                step //= 2

        live = np.flatnonzero(tree[:, 1] < NONE)
        while len(live):
            smallest = tree[live, 1]
            at = np.ones(len(live), dtype=np.int64)
            step = 1
            while step < size:
                at = 2 * at
                at += tree[live, at] != smallest
                step *= 2
            left = at - size
            right = end[live, left]
            stop = end[live, right]
            ids[live, left] = smallest
            ids[live, right] = -1
            end[live, left] = stop
            before[live, stop] = left
            gone = right < size
            put(live[gone], right[gone], NONE)
            after = np.full(len(live), NONE, dtype=np.int64)
            more = stop < lengths[live]
            after[more] = self._pair_rank(smallest[more], ids[live[more], stop[more]])
            put(live, left, after)
            first = before[live, left]
            has = first >= 0
            put(live[has], first[has], self._pair_rank(ids[live[has], first[has]], smallest[has]))
            live = live[tree[live, 1] < NONE]
        kept = ids >= 0
        counts = kept.sum(axis=1)
        flat = ids[kept].astype("<u4").tobytes()
        stops = np.cumsum(counts) * 4
        starts = stops - counts * 4
        return [flat[a:b] for a, b in zip(starts.tolist(), stops.tolist())]

    def learn(self, pieces: set[str]) -> None:
        """Adds the ids of pieces that are not known yet."""
        groups: dict[int, tuple[list[str], list[bytes]]] = {}
        for piece in pieces:
            raw = piece.encode("utf-8")
            rank = self.ranks.get(raw)
            if rank is not None:
                self.known[piece] = rank.to_bytes(4, "little")
            elif len(raw) > LONG_PIECE:
                self.known[piece] = np.array(self.merge_one(raw), dtype="<u4").tobytes()
            else:
                size = max(1, 1 << (len(raw) - 2).bit_length())
                names, raws = groups.setdefault(size, ([], []))
                names.append(piece)
                raws.append(raw)
        for size, (names, raws) in groups.items():
            for start in range(0, len(names), 20_000):
                packed = self.merge_many(raws[start:start + 20_000], size)
                self.known.update(zip(names[start:start + 20_000], packed))

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        out: list[bytes] = []
        start = 0
        while start < len(texts):
            stop, size = start, 0
            while stop < len(texts) and (stop == start or size < CHUNK_CHARS):
                size += len(texts[stop])
                stop += 1
            pieces = [self.split(text) for text in texts[start:stop]]
            if len(self.known) > CACHED_PIECES:
                self.known.clear()
            new = set().union(*pieces).difference(self.known)
            self.learn(new)
            look = self.known.__getitem__
            out.extend(b"".join(map(look, each)) for each in pieces)
            start = stop
        return out


class Decoder:
    def __init__(self, ranks: dict[bytes, int]):
        top = max(ranks.values())
        if top > MAX_VOCABULARY:
            raise ValueError("ids are too large for a table of tokens")
        self.tokens: list[bytes | None] = [None] * (top + 1)
        for token, rank in ranks.items():
            self.tokens[rank] = token

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.tokens.__getitem__, np.frombuffer(ids, dtype="<u4").tolist()))


def shared_ranks(spark: SparkSession, vocabulary: str):
    """The vocabulary file, read on the driver and broadcast; its size does not grow with data."""
    ranks = load_ranks(vocabulary)
    if len(ranks) > MAX_VOCABULARY:
        raise ValueError(f"{len(ranks)} tokens are too many to broadcast")
    return spark.sparkContext.broadcast(ranks)


def encode(docs: DataFrame, vocabulary: str, pattern: str, id_col: str = "doc_id",
           text_col: str = "text", round_trip: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids (binary, little-endian unsigned 32-bit), one row per row of `docs`; with
    `round_trip` also decoded (binary), the bytes that the ids decode to, found in the same pass.

    No text and empty text have no tokens. Whole texts are encoded; strings of special tokens are
    ordinary text. Repeated rows give repeated rows, an empty table gives none, and other columns
    are not looked at.
    """
    ranks = shared_ranks(docs.sparkSession, vocabulary)
    source = documents_of(docs, id_col, text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        merger = Merger(ranks.value, pattern)
        decoder = Decoder(ranks.value) if round_trip else None
        for whole in batches:
            for start in range(0, whole.num_rows, BATCH_ROWS):
                batch = whole.slice(start, BATCH_ROWS)
                ids = merger.encode(batch.column(1).to_pylist())
                columns = [batch.column(0), pa.array([len(each) // 4 for each in ids], pa.int64()),
                           pa.array(ids, pa.binary())]
                if decoder:
                    columns.append(pa.array(map(decoder.decode, ids), pa.binary(), size=len(ids)))
                yield pa.RecordBatch.from_arrays(columns, names)

    kind = source.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, n_tokens long, ids binary" + (", decoded binary" if round_trip else "")
    names = ["doc_id", "n_tokens", "ids", "decoded"][:4 if round_trip else 3]
    return source.mapInArrow(run, schema)


def decode(encoded: DataFrame, vocabulary: str, ids_col: str = "ids") -> DataFrame:
    """The columns of `encoded` and `decoded` (binary), the bytes of the ids; no ids give no bytes."""
    ranks = shared_ranks(encoded.sparkSession, vocabulary)
    schema = T.StructType([f for f in encoded.schema.fields if f.name != "decoded"]
                          + [T.StructField("decoded", T.BinaryType())])
    names = [f.name for f in schema.fields[:-1]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = Decoder(ranks.value)
        for batch in batches:
            texts = [decoder.decode(each or b"") for each in batch.column(ids_col).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(n) for n in names] + [pa.array(texts, pa.binary())], [*names, "decoded"])

    return encoded.select(*names).mapInArrow(run, schema)
