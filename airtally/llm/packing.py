"""Token ids packed into rows of equal length, with little padding.

Documents longer than a row are cut into whole rows and a rest; nothing is left out. The pieces of a
shard go into rows by best fit, longest first: a segment tree over the room that is left in the rows
finds the fullest row that still takes a piece. A shard holds about `shard_bytes` bytes of text,
so that a task's memory does not depend on the size of the corpus.
"""

from __future__ import annotations

from array import array

import numpy as np
import pandas as pd
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from airtally.llm.bpe import shared_ranks
from airtally.llm.tables import documents_of

ROW_TOKENS = 2048
SHARD_BYTES = 8_000_000


_CODERS: dict[str, tuple[dict[bytes, int], tiktoken.Encoding]] = {}


def coder_of(ranks: dict[bytes, int], pattern: str) -> tiktoken.Encoding:
    """The library's encoder, made once per worker process."""
    kept = _CODERS.get(pattern)
    if kept is None or kept[0] != ranks:
        kept = _CODERS[pattern] = ranks, tiktoken.Encoding(
            "packing", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    return kept[1]


class RoomTree:
    """Rows by the room left in them; a node counts the rows below it."""

    def __init__(self, most: int):
        self.size = 1 << most.bit_length()
        self.count = [0] * (2 * self.size)
        self.rows: list[list[int]] = [[] for _ in range(most + 1)]

    def _add(self, room: int, change: int) -> None:
        node = self.size + room
        while node:
            self.count[node] += change
            node //= 2

    def put(self, row: int, room: int) -> None:
        self.rows[room].append(row)
        self._add(room, 1)

    def take(self, length: int) -> tuple[int, int] | None:
        """A row with the least room of at least `length`, and that room."""
        node, count = self.size + length, self.count
        if not count[node]:
            while node > 1 and (node & 1 or not count[node + 1]):
                node //= 2
            if node <= 1:
                return None
            node += 1
            while node < self.size:
                node = 2 * node if count[2 * node] else 2 * node + 1
        room = node - self.size
        row = self.rows[room].pop()
        self._add(room, -1)
        return row, room


def best_fit(lengths: list[int], row_tokens: int) -> list[list[int]]:
    """Pieces of each row, by best fit in falling order of length (equal ones in their order)."""
    tree = RoomTree(row_tokens)
    rows: list[list[int]] = []
    for piece in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        found = tree.take(lengths[piece])
        row, room = found if found else (len(rows), row_tokens)
        if found is None:
            rows.append([])
        rows[row].append(piece)
        if room > lengths[piece]:
            tree.put(row, room - lengths[piece])
    return rows


def pieces_of(counts: list[int], row_tokens: int) -> list[tuple[int, int, int]]:
    """(document, first token, tokens) of all pieces; documents without tokens have none."""
    return [(doc, start, min(row_tokens, n - start))
            for doc, n in enumerate(counts) for start in range(0, n, row_tokens)]


def id_type(vocabulary_size: int) -> str:
    """Ids, and the padding id behind them, in two bytes where they fit, else in four."""
    return "<u2" if vocabulary_size < 1 << 16 else "<u4"


def pack(docs: DataFrame, vocabulary: str, pattern: str, row_tokens: int = ROW_TOKENS,
         id_col: str = "doc_id", text_col: str = "text", shard_bytes: int = SHARD_BYTES,
         seed: int = 23) -> DataFrame:
    """One row per packed row: shard, row, n_tokens, doc_ids, starts, cu_seqlens, ids, positions.

    `doc_ids` and `starts` name the segments' documents and their first tokens there, `cu_seqlens`
    the places where segments begin and the last one ends. `ids` holds `row_tokens` little-endian
    integers (two bytes each for vocabularies below 65,536 tokens, else four), padded with the first
    id behind the vocabulary; `positions` as many four-byte positions, which start again from 0 with
    each segment and are 0 in the padding. Missing and empty texts and empty tables give no rows;
    repeated rows are packed once each. Shards follow a hash of id and text, so reruns agree.
    """
    source = documents_of(docs, id_col, text_col)
    ranks = shared_ranks(docs.sparkSession, vocabulary)
    size = source.agg(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0
    shards = max(1, -(-size // shard_bytes))
    pad = 1 + max(ranks.value.values())
    kind = id_type(pad)
    width = int(kind[-1])
    code = "H" if width == 2 else "I"
    doc_kind = source.schema["doc_id"].dataType.simpleString()

    def pack_shard(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["place", "doc_id"], kind="stable")
        doc_ids = group["doc_id"].tolist()
        coder = coder_of(ranks.value, pattern)
        ids = [array(code, coder.encode_ordinary(text)).tobytes() for text in group["text"]]
        pieces = pieces_of([len(each) // width for each in ids], row_tokens)
        rows = best_fit([n for _, _, n in pieces], row_tokens)
        out = []
        for number, members in enumerate(rows):
            inside = [pieces[i] for i in members]
            lengths = [n for _, _, n in inside]
            cuts = np.cumsum([0] + lengths)
            matrix = np.full(row_tokens, pad, dtype=kind)
            places = np.zeros(row_tokens, dtype="<u4")
            for (doc, start, n), at in zip(inside, cuts.tolist()):
                matrix[at:at + n] = np.frombuffer(ids[doc], kind, n, width * start)
                places[at:at + n] = np.arange(n)
            out.append((int(group["shard"].iloc[0]), number, int(cuts[-1]),
                        [doc_ids[d] for d, _, _ in inside], [s for _, s, _ in inside],
                        cuts.tolist(), matrix.tobytes(), places.tobytes()))
        return pd.DataFrame(out, columns=["shard", "row", "n_tokens", "doc_ids", "starts",
                                          "cu_seqlens", "ids", "positions"])

    dealt = source.filter("text <> ''").withColumn(
        "place", F.xxhash64(F.lit(seed), "doc_id", "text")
    ).withColumn("shard", F.pmod("place", F.lit(shards)).cast("int"))
    return dealt.groupBy("shard").applyInPandas(
        pack_shard,
        f"shard int, row int, n_tokens int, doc_ids array<{doc_kind}>, starts array<int>, "
        "cu_seqlens array<int>, ids binary, positions binary")


def write(packed: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Packed rows as Parquet, each file in the order of shard and row."""
    packed.sortWithinPartitions("shard", "row").write.mode(mode).parquet(path)


def matrices(rows: pd.DataFrame, row_tokens: int, kind: str) -> tuple[np.ndarray, np.ndarray]:
    """Ids and positions of packed rows as two matrices, one line per row."""
    ids = np.frombuffer(b"".join(rows["ids"]), dtype=kind).reshape(len(rows), row_tokens)
    places = np.frombuffer(b"".join(rows["positions"]), dtype="<u4").reshape(len(rows), row_tokens)
    return ids, places
