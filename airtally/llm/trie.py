"""Prefix trie of conversations, by truncation peeling.

A node is a distinct sequence of first turns. The trie is taken down from its greatest depth: at each
depth the conversations that end there join the nodes that are left of the depth below, equal ones
merge, a finished node is sent off, and its last turn is stripped. Everything that is asked of a node is
summed on the way, so one pass finds the nodes and their figures.

Only digests move. Sequences are range-partitioned in their lexical order, so that the members of a node lie
side by side; a task peels its own range. A node whose members reach into a neighbouring range is sent as
a part, and parts are summed by their key. What a range has to know of its neighbours is how many turns its
first and last sequence share with them. Long conversations are cut into bands of `band` turns;
bands are peeled from the deepest one up, and what is left of a band meets the sequences of the band
above. No row thus holds more than a band, and no task more than a range.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from airtally.session import saved

BAND_TURNS = 65_536
# Turns and conversations per task.
TASK_ROWS = 1_000_000
HEAD_TURNS = 8
BLOCK_CHARS = 4_096
# Rows of a table that may be broadcast.
BROADCAST_ROWS = 100_000
ID_BYTES = 16
SUMS = ("n_convs", "n_children", "n_leaves", "saved_tokens")


def tasks_for(frame: DataFrame, rows: int, per_task: int) -> int:
    return max(frame.sparkSession.sparkContext.defaultParallelism, -(-rows // per_task))


def numbered_turns(conversations: DataFrame, per_task: int = TASK_ROWS) -> DataFrame:
    """conv_id, place (from 1), turn_id (128 bits as hex), size: one row per turn that has a conv_id.

    Turns are ordered by turn (none first), then by digest. A conversation may lie in several ranges of the
    sort, so its places are counted per range and then moved on by what lies in the ranges before.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    role = F.coalesce(F.col("role").cast("string"), F.lit(""))
    framed = F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text)
    turns = saved(
        conversations.filter(F.col("conv_id").isNotNull()).select(
            F.col("conv_id").cast("long"), F.col("turn"),
            F.substring(F.sha2(framed, 256), 1, 2 * ID_BYTES).alias("turn_id"),
            F.octet_length(text).cast("long").alias("size"),
            F.monotonically_increasing_id().alias("row_no"),
        ), "turns")
    order = [F.col("turn").asc_nulls_first(), F.col("turn_id"), F.col("row_no")]
    ranges = saved(
        turns.repartitionByRange(tasks_for(turns, turns.count(), per_task), "conv_id", *order)
        .withColumn("part", F.spark_partition_id()), "turn-ranges")
    inside = Window.partitionBy("conv_id", "part").orderBy(*order)
    earlier = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    # Only the first conversation of a range can have begun before it: one row per range at most.
    before = (
        ranges.groupBy("conv_id", "part").count()
        .withColumn("before", F.sum("count").over(earlier)).filter("before > 0").drop("count")
    )
    return (
        ranges.withColumn("place", F.row_number().over(inside).cast("long"))
        .join(F.broadcast(before), ["conv_id", "part"], "left")
        .select("conv_id", (F.col("place") + F.coalesce("before", F.lit(0))).alias("place"), "turn_id", "size")
    )


def shared_turns(conv_id: Column) -> Column:
    """How many first turns a conversation takes from its base: 0 to 8, by the checksum of its id."""
    return F.crc32(conv_id.cast("string").cast("binary")) % (HEAD_TURNS + 1)


def rebuilt(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Turns (conv_id, place, turn_id, size) and lengths (conv_id, length) of the rebuilt conversations.

    Conversation c begins with the first h turns of conversation c - c % 5 (fewer if it has fewer) and
    goes on with its own turns behind its first h. The remainder has the sign of c, as in SQL.
    """
    lengths = turns.groupBy("conv_id").agg(F.count(F.lit(1)).alias("own"))
    base = lengths.select(F.col("conv_id").alias("base_id"), F.col("own").alias("base_own"))
    wanted = lengths.select(
        "conv_id", "own", shared_turns(F.col("conv_id")).alias("h"),
        (F.col("conv_id") - F.col("conv_id") % 5).alias("base_id"))
    known = saved(
        wanted.join(base, "base_id", "left")
        .withColumn("taken", F.least("h", F.coalesce("base_own", F.lit(0)))), "lengths")
    heads = (
        turns.filter((F.col("conv_id") % 5 == 0) & (F.col("place") <= HEAD_TURNS))
        .withColumnRenamed("conv_id", "base_id")
        .join(known.select("conv_id", "base_id", "taken"), "base_id")
        .filter(F.col("place") <= F.col("taken"))
        .select("conv_id", "place", "turn_id", "size")
    )
    own = (
        turns.withColumn("h", shared_turns(F.col("conv_id"))).filter("place > h")
        .join(known.select("conv_id", "taken"), "conv_id")
        .select("conv_id", (F.col("place") - F.col("h") + F.col("taken")).alias("place"), "turn_id", "size")
    )
    length = F.col("taken") + F.greatest(F.col("own") - F.col("h"), F.lit(0))
    return heads.unionByName(own), known.select("conv_id", length.cast("long").alias("length"))


def chunks_of(turns: DataFrame, lengths: DataFrame, band: int, last_band: int) -> DataFrame:
    """One row per conversation and band: path (ids side by side), sizes, start (a 128-bit digest of the
    bands before, as two numbers), and whether the conversation ends in it."""
    inside = (
        turns.groupBy("conv_id", F.floor((F.col("place") - 1) / band).cast("int").alias("band"))
        .agg(F.sort_array(F.collect_list(F.struct("place", "turn_id", "size"))).alias("turns"))
        .select(
            "conv_id", "band",
            F.unhex(F.array_join(F.col("turns.turn_id"), "")).alias("path"),
            F.col("turns.size").alias("sizes"))
    )
    ends = F.greatest(F.floor((F.col("length") - 1) / band), F.lit(0)).cast("int")
    last = lengths.select("conv_id", ends.alias("last"))
    empty = lengths.filter("length = 0").select(
        "conv_id", F.lit(0).alias("band"), F.lit(b"").alias("path"),
        F.array().cast("array<bigint>").alias("sizes"))
    rows = inside.unionByName(empty).join(last, "conv_id").withColumn("ends", F.col("band") == F.col("last"))
    if last_band == 0:
        return rows.drop("last").withColumns({"s1": F.lit(0).cast("long"), "s2": F.lit(0).cast("long")})
    rows = saved(rows.drop("last"), "bands")
    before = Window.partitionBy("conv_id").orderBy("band").rowsBetween(Window.unboundedPreceding, -1)
    starts = rows.select(
        "conv_id", "band",
        *[F.xxhash64(F.lit(seed), "band", "path").alias(f"t{seed}") for seed in (1, 2)]
    ).select(
        "conv_id", "band",
        *[F.coalesce(F.bit_xor(f"t{seed}").over(before), F.lit(0)).alias(f"s{seed}") for seed in (1, 2)])
    return rows.join(starts, ["conv_id", "band"])


def cut_members(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Of rows in the order of key and conv_id: the digest of each key's ids, or, where the key may
    lie in a neighbouring range too or has many ids, these ids as texts in blocks."""
    part = TaskContext.get().partitionId()
    key, ids, chars, block, first = None, [], 0, 0, True
    out: list[tuple] = []

    def text_row() -> tuple:
        return key, part, block, len(ids), ids[0], None, ",".join(map(str, ids))

    for batch in batches:
        for k, conv in zip(batch["key"].tolist(), batch["conv_id"].tolist()):
            if k != key:
                if key is not None and (first or block):
                    out.append(text_row())
                elif key is not None:
                    digest = hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
                    out.append((key, part, 0, len(ids), ids[0], digest, None))
                first, key, ids, chars, block = key is None, k, [], 0, 0
            elif chars > BLOCK_CHARS:
                out.append(text_row())
                ids, chars, block = [], 0, block + 1
            ids.append(conv)
            chars += 12
        if out:
            yield pd.DataFrame(out, columns=MEMBER_COLUMNS)
            out = []
    if key is not None:
        yield pd.DataFrame([text_row()], columns=MEMBER_COLUMNS)


MEMBER_COLUMNS = ["key", "part", "block", "n_convs", "conv_id", "ends_sha256", "ids"]


def join_members(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Digests of keys whose ids come as texts, in the order of key, part and block."""
    key, hasher, count, least = None, None, 0, 0
    for batch in batches:
        out = []
        for k, n, conv, ids in zip(*(batch[c].tolist() for c in ("key", "n_convs", "conv_id", "ids"))):
            if k != key:
                if key is not None:
                    out.append((key, count, least, hasher.hexdigest()))
                key, hasher, count, least = k, hashlib.sha256(ids.encode()), n, conv
            else:
                hasher.update(f",{ids}".encode())
                count += n
        # The key that is open goes on in the next batch.
        yield pd.DataFrame(out, columns=["key", "n_convs", "conv_id", "ends_sha256"])
    if key is not None:
        yield pd.DataFrame([(key, count, least, hasher.hexdigest())],
                           columns=["key", "n_convs", "conv_id", "ends_sha256"])


def merged_ends(chunks: DataFrame, per_task: int) -> DataFrame:
    """Equal conversations as one row: key, n_convs, conv_id (the smallest), ends_sha256.

    The digest of a group's ids has to be taken in their order. Ids are range-partitioned by group and id, so a
    group of any size is spread over tasks; only groups at the borders of ranges and large ones meet again,
    as blocks of text which are hashed as they come.
    """
    members = chunks.filter("ends").select(
        F.sha2(F.concat(F.concat_ws(",", "band", "s1", "s2").cast("binary"), F.lit(b"|"), "path"), 256).alias("key"),
        "conv_id")
    members = saved(members, "members")
    cut = saved(
        members.repartitionByRange(tasks_for(members, members.count(), per_task), "key", "conv_id")
        .sortWithinPartitions("key", "conv_id")
        .mapInPandas(cut_members, "key string, part int, block long, n_convs long, conv_id long, "
                                  "ends_sha256 string, ids string"), "member-blocks")
    joined = (
        cut.filter("ids IS NOT NULL").repartition("key").sortWithinPartitions("key", "part", "block")
        .mapInPandas(join_members, "key string, n_convs long, conv_id long, ends_sha256 string")
    )
    return cut.filter("ids IS NULL").select("key", "n_convs", "conv_id", "ends_sha256").unionByName(joined)


def common_turns(a: bytes, b: bytes) -> int:
    """Number of ids that two paths share from the start."""
    least = min(len(a), len(b))
    if a[:least] == b[:least]:
        return least // ID_BYTES
    differ = np.frombuffer(a, np.uint8, least) != np.frombuffer(b, np.uint8, least)
    return int(differ.argmax()) // ID_BYTES


@F.pandas_udf(LongType())
def common_of(a: pd.DataFrame, b: pd.DataFrame) -> pd.Series:
    """Turns that two sequences share; -1 where a side is missing or their bands begin differently."""
    found = [common_turns(m, o) if s is not None and s == t else -1
             for s, m, t, o in zip(a["start"], a["path"], b["start"], b["path"])]
    return pd.Series(found, dtype="int64")


def prefix_keys(band: int, s1: int, s2: int, path: bytes, most: int) -> list[bytes]:
    """Keys of the prefixes of 0 to `most` turns."""
    state = hashlib.sha256(f"{band},{s1},{s2}|".encode())
    keys = [state.digest()]
    for at in range(0, most * ID_BYTES, ID_BYTES):
        state.update(path[at:at + ID_BYTES])
        keys.append(state.digest())
    return keys


NODE_SCHEMA = ("start boolean, key binary, parent_key binary, conv_id long, parent_conv_id long, depth long, "
               "n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string")
NODE_COLUMNS = [field.split()[0] for field in NODE_SCHEMA.split(", ")]


def peel_range(rows: pd.DataFrame, band_turns: int) -> pd.DataFrame:
    """Nodes of one range of sequences, from the greatest depth to the start of the band.

    `lcp[i]` is the number of turns row i shares with the row before it, in whichever range that lies.
    A node belongs to the range that holds its first row: there its text is taken off the savings once
    and it is counted as a child. So figures of parts only have to be summed.
    """
    rows = rows.sort_values(["s1", "s2", "path"], kind="stable").reset_index(drop=True)
    count, band = len(rows), int(rows["band"].iloc[0])
    lcp_in, lcp_out = int(rows["lcp_in"].iloc[0]), int(rows["lcp_out"].iloc[0])
    paths = rows["path"].tolist()
    starts = list(zip(rows["s1"].tolist(), rows["s2"].tolist()))
    lcp = np.array([lcp_in] + [
        common_turns(paths[i - 1], paths[i]) if starts[i - 1] == starts[i] else -1 for i in range(1, count)])
    length = np.array([len(p) // ID_BYTES for p in paths])
    sizes = np.concatenate([np.asarray(s, dtype=np.int64) for s in rows["sizes"]])
    offset = np.concatenate([[0], np.cumsum(length)])
    keys_in = prefix_keys(band, *starts[0], paths[0], max(lcp_in, 0))
    keys_out = prefix_keys(band, *starts[-1], paths[-1], max(lcp_out, 0))
    given = {c: rows[c].to_numpy(np.int64) for c in (*SUMS, "conv_id")}
    ends = rows["ends_sha256"].tolist()
    by_length = np.argsort(length, kind="stable")
    cuts = np.searchsorted(length[by_length], np.arange(length.max() + 2))
    nodes: list[pd.DataFrame] = []
    # Nodes of the depth below, in the order of their first rows.
    live = {c: np.empty(0, np.int64) for c in (*SUMS, "conv_id", "first", "last", "ended")}
    live_key = np.empty(0, object)
    for depth in range(int(length.max()), -1, -1):
        new = np.sort(by_length[cuts[depth]:cuts[depth + 1]])
        old = len(live["first"])
        first = np.concatenate([live["first"], new])
        order = np.argsort(first, kind="stable")
        first = first[order]
        is_child = np.concatenate([np.ones(old, bool), np.zeros(len(new), bool)])[order]

        def both(name: str, of_new: np.ndarray) -> np.ndarray:
            return np.concatenate([live[name], of_new])[order]

        opens = lcp[first] < depth
        opens[0] = True
        at = np.flatnonzero(opens)
        group = np.cumsum(opens) - 1
        head = first[at]
        tail = np.maximum.reduceat(both("last", new), at)
        conv = np.minimum.reduceat(both("conv_id", given["conv_id"][new]), at)
        n = np.add.reduceat(both("n_convs", given["n_convs"][new]), at)
        # A child is counted where its first row lies.
        own_child = is_child & (lcp[first] <= depth)
        kids = np.add.reduceat(
            np.where(is_child, own_child, both("n_children", given["n_children"][new])), at)
        leaves = np.add.reduceat(both("n_leaves", given["n_leaves"][new]), at)
        saved_sum = np.add.reduceat(both("saved_tokens", given["saved_tokens"][new]), at)
        ended = np.maximum.reduceat(np.where(is_child, -1, both("ended", new)), at)
        childless = ~np.logical_or.reduceat(is_child | (both("n_leaves", given["n_leaves"][new]) > 0), at)
        goes_on = (tail == count - 1) & (lcp_out >= depth)
        leaves = leaves + (childless & ~goes_on)
        if depth:
            size = sizes[offset[head] + depth - 1]
            saved_sum = saved_sum + n * size - np.where(lcp[head] < depth, size, 0)
        key = np.full(len(at), None, object)
        if depth == 0:
            for i, row in enumerate(head.tolist()):
                key[i] = prefix_keys(band, *starts[row], b"", 0)[0]
        else:
            if head[0] == 0 and lcp_in >= depth:
                key[0] = keys_in[depth]
            if goes_on[-1]:
                key[-1] = keys_out[depth]
        if old:
            parent = group[is_child]
            nodes.append(finished(live, live_key, depth + 1 + band * band_turns, ends,
                                  np.where(key[parent] == None, conv[parent], 0), key[parent]))  # noqa: E711
        live = {"n_convs": n, "n_children": kids, "n_leaves": leaves, "saved_tokens": saved_sum,
                "conv_id": conv, "first": head, "last": tail, "ended": ended}
        live_key = key
    top = finished(live, live_key, band * band_turns, ends, np.zeros(len(live_key), np.int64), None)
    return pd.concat([*nodes, top.assign(start=True)], ignore_index=True)[NODE_COLUMNS]


def finished(live: dict, key: np.ndarray, depth: int, ends: list, parent_conv: np.ndarray,
             parent_key: np.ndarray | None) -> pd.DataFrame:
    """Nodes of one depth; those with the key of a parent get its conv_id later."""
    frame = pd.DataFrame({c: live[c] for c in (*SUMS, "conv_id")})
    frame["start"], frame["key"], frame["depth"] = False, key, depth
    frame["ends_sha256"] = [ends[i] if i >= 0 else None for i in live["ended"].tolist()]
    frame["parent_key"] = parent_key
    frame["parent_conv_id"] = pd.array(parent_conv, dtype="Int64")
    if parent_key is not None:
        frame.loc[frame["parent_key"].notna(), "parent_conv_id"] = pd.NA
    return frame


def peel_band(rows: DataFrame, band_turns: int, per_task: int) -> DataFrame:
    """Nodes, parts of nodes (with a key) and starts of one band of sequences."""
    order = ["s1", "s2", "path"]
    rows = saved(rows, "sequences")
    n = tasks_for(rows, rows.count(), per_task)
    ranges = saved(rows.repartitionByRange(n, *order).withColumn("part", F.spark_partition_id()), "ranges")
    side = Window.orderBy("part")
    # One row per range.
    edges = ranges.groupBy("part").agg(
        F.min(F.struct(*order)).alias("low"), F.max(F.struct(*order)).alias("high"))
    sides = edges.withColumn("before", F.lag("high").over(side)).withColumn("after", F.lead("low").over(side))

    def ends_of(name: str) -> Column:
        start = F.when(F.col(name).isNotNull(), F.concat_ws(",", f"{name}.s1", f"{name}.s2"))
        return F.struct(start.alias("start"), F.col(f"{name}.path").alias("path"))

    shared = saved(
        sides.select(
            "part", common_of(ends_of("before"), ends_of("low")).alias("lcp_in"),
            common_of(ends_of("high"), ends_of("after")).alias("lcp_out")), "range-borders")
    return ranges.join(F.broadcast(shared), "part").groupBy("part").applyInPandas(
        lambda group: peel_range(group, band_turns), NODE_SCHEMA)


def summed(parts: DataFrame) -> DataFrame:
    """Parts of nodes as nodes."""
    return parts.groupBy("key").agg(
        F.max("parent_key").alias("parent_key"), F.min("conv_id").alias("conv_id"),
        F.max("depth").alias("depth"), *[F.sum(c).alias(c) for c in SUMS],
        F.max("ends_sha256").alias("ends_sha256"))


def prefix_trie(conversations: DataFrame, band_turns: int = BAND_TURNS, per_task: int = TASK_ROWS,
                broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """One row per node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    Takes conv_id, turn, role and text and looks at no other column. Turns are ordered by turn (none
    first; equal ones by a digest of role and text), repeated rows are turns of their own. No role and no text are
    empty ones. Rows without a conv_id take no part. An empty table has no conversation and no node.
    Long texts count by their digest and size. Different turns are told apart by 128 bits.
    """
    columns = conversations.select("conv_id", "turn", "role", "text")
    turns, lengths = rebuilt(saved(numbered_turns(columns, per_task), "places"))
    lengths = saved(lengths, "rebuilt-lengths")
    longest = lengths.agg(F.max("length").alias("n")).first()["n"]
    last_band = max(0, ((longest or 0) - 1) // band_turns)
    chunks = saved(chunks_of(turns, lengths, band_turns, last_band), "chunks")
    ended = merged_ends(chunks, per_task).drop("key")
    sequences = saved(chunks.filter("ends").drop("ends").join(ended, "conv_id"), "ended")
    nodes, names, left = [], [], None
    for band in range(last_band, -1, -1):
        rows = sequences.filter(F.col("band") == band).withColumns(
            {c: F.lit(0).cast("long") for c in SUMS[1:]})
        if left is not None:
            kept = chunks.filter(F.col("band") == band).drop("ends").join(left, "conv_id")
            rows = rows.withColumn("key", F.lit(None).cast("binary")).unionByName(
                kept.withColumn("ends_sha256", F.lit(None).cast("string")))
            rows = saved(rows.groupBy("band", "s1", "s2", "path").agg(
                F.min("conv_id").alias("conv_id"), F.first("sizes").alias("sizes"), F.max("key").alias("key"),
                *[F.sum(c).alias(c) for c in SUMS], F.max("ends_sha256").alias("ends_sha256")), "merged")
            # A conversation that ends here may be smaller than all that go on.
            names.append(rows.filter("key IS NOT NULL").select("key", F.col("conv_id").alias("named")))
            rows = rows.drop("key")
        peeled = saved(peel_band(rows, band_turns, per_task), "peeled")
        parts = saved(summed(peeled.filter("NOT start AND key IS NOT NULL")), "parts")
        starts = saved(summed(peeled.filter("start")), "starts")
        nodes += [peeled.filter("NOT start AND key IS NULL").drop("start", "key"),
                  parts.drop("key").withColumn("parent_conv_id", F.lit(None).cast("long"))]
        names.append(parts.select("key", F.col("conv_id").alias("named")))
        left = starts.select("key", "conv_id", *SUMS)
    names.append(starts.select("key", F.col("conv_id").alias("named")))
    root = starts.drop("key").withColumn("parent_conv_id", F.lit(None).cast("long"))
    found = nodes[0]
    for more in nodes[1:]:
        found = found.unionByName(more)
    known = names[0]
    for more in names[1:]:
        known = known.unionByName(more)
    if known.count() <= broadcast_rows:
        known = F.broadcast(known)
    open_nodes = found.filter("parent_key IS NOT NULL").drop("parent_conv_id").join(
        known, F.col("parent_key") == F.col("key")).withColumnRenamed("named", "parent_conv_id").drop("key")
    every = found.filter("parent_key IS NULL").unionByName(open_nodes).unionByName(root)
    return every.select(
        "conv_id", "depth", "parent_conv_id", *SUMS,
        F.coalesce("ends_sha256", F.sha2(F.lit(b""), 256)).alias("ends_sha256"))
