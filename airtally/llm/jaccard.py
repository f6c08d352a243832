"""Exact Jaccard join of word shingle sets by a token-group matrix, and its connected components.

Routing. Two sets of sizes a and b with similarity s differ in at most (1 - s) / (1 + s) * (a + b)
tokens. If tokens are dealt by their hash into more segments than that, some segment is the same in
both. So every set sends one signature per segment, for the size classes it can have partners in;
sets that share a signature are put into one candidate component. Signatures that occur once end
there, which is nearly all of them. Tasks combine equal signatures before they send them. So that
passages which many texts share do not connect everything, the segments leave out frequent shingles:
any fixed set of shingles may be left out, for what is left differs no more than the whole does.
Only a set that has too few other shingles (a copy among thousands) sends signatures of
all of them too; two such sets meet there. Which shingles count as frequent changes the
candidates, never the result: they are counted over all texts, in each task by itself, and the
`FREQUENT_SHINGLES` most frequent of those that repeat within tasks are broadcast.

Verification. Inside a candidate component similar sets (neighbours in the order of their smallest
hashes) form groups; a matrix holds the union of each group's tokens. A query set's overlap with a
union bounds its overlap with every member, and only groups whose bound reaches the threshold are
opened. Members that are already known to be connected with the query need no comparison. A
candidate component that is too large for one task is cut into blocks: blocks are linked on their
own first, in two different cuts; then every set outside the largest part is compared with
every block. That leaves out no pair of different parts.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from airtally.llm.graph import components
from airtally.llm.tables import documents_of, saved

SHINGLE = 4
THRESHOLD = (85, 100)
GROUP_SETS = 32
TASK_TOKENS = 1_000_000
CHUNK_SIGNATURES = 400_000
BUCKET_SIGNATURES = 1_000_000
FREQUENT_SHINGLES = 300_000
FREQUENT_FROM = 6
CHUNK_SHINGLES = 2_000_000

_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_BYTES = np.frombuffer(hashlib.shake_256(b"bytes").digest(2048), dtype=np.uint64)
_SPACE = b" \t\n\r\x0b\x0c"
_powers = [np.ones(1, dtype=np.uint64), np.ones(1, dtype=np.uint64)]


def _power(n: int) -> list[np.ndarray]:
    if len(_powers[0]) < n:
        size = 1 << n.bit_length()
        for k, base in enumerate((_BASE, _INVERSE)):
            steps = np.full(size, base, dtype=np.uint64)
            steps[0] = 1
            _powers[k] = np.cumprod(steps, dtype=np.uint64)
    return _powers


def mixed(values: np.ndarray) -> np.ndarray:
    values = (values ^ (values >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    values = (values ^ (values >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return values ^ (values >> np.uint64(31))


def shingles(text: str | None, width: int = SHINGLE) -> np.ndarray:
    """Sorted 64-bit hashes of the distinct shingles of words (A-Z lowered, ASCII white space between);
    a text of fewer words is one shingle, a text without words has none."""
    words = (text or "").encode("utf-8", "replace").lower().split()
    if not words:
        return np.zeros(0, dtype=np.uint64)
    line = np.frombuffer(b" ".join([*words, b""]), dtype=np.uint8)
    up, down = _power(len(line) + 1)
    sums = np.zeros(len(line) + 1, dtype=np.uint64)
    np.cumsum(_BYTES[line] * up[:len(line)], out=sums[1:])
    stops = np.flatnonzero(line == 32)
    starts = np.concatenate(([0], stops[:-1] + 1))
    last = stops[min(width, len(words)) - 1:]
    first = starts[:len(last)]
    hashes = (sums[last] - sums[first]) * down[first] + (last - first).astype(np.uint64)
    return np.unique(mixed(hashes))


def set_digest(tokens: np.ndarray) -> str:
    return hashlib.blake2b(tokens.tobytes(), digest_size=16).hexdigest()


class Classes:
    """Size classes. Class c holds the pairs whose smaller set is in band c; its larger set is in band
    c or c + 1. `segments` is more than the pairs of a class can differ in, by `spare`."""

    def __init__(self, threshold: tuple[int, int] = THRESHOLD):
        self.num, self.den = threshold
        self.bounds = [1]
        self.known: dict[int, int] = {}

    def _extend(self) -> None:
        low = self.bounds[-1]
        self.bounds.append(max(low + 1, (low - 1) * self.den // self.num + 1))

    def band(self, size: int) -> int:
        while self.bounds[-1] <= size:
            self._extend()
        return int(np.searchsorted(self.bounds, size, side="right")) - 1

    def segments(self, cls: int) -> tuple[int, int]:
        """Number of segments, and how many of them differ at most; (0, 0) if only equal sets link."""
        while len(self.bounds) <= cls + 1:
            self._extend()
        small = self.bounds[cls + 1] - 1
        large = small * self.den // self.num
        differ = (self.den - self.num) * (small + large) // (self.den + self.num)
        if differ == 0:
            return 0, 0
        if cls not in self.known:
            # So many more segments than can differ that chance leaves fewer empty ones, by far.
            fits = (count for count in range(differ + 1, 2 * differ + 10)
                    if count - differ >= (empty := count * math.exp(-self.bounds[cls] / count))
                    + 4 * math.sqrt(empty) + 1)
            self.known[cls] = next(fits, differ + 2)
        return self.known[cls], differ

    def signatures(self, tokens: np.ndarray, frequent: np.ndarray) -> np.ndarray:
        """A signature per segment that has tokens which are not frequent, in each class of the set.

        Empty segments are equal in too many sets to say anything. A pair may lack a common segment
        with tokens only if either set has as many empty ones as must be equal. Such sets send
        signatures of all their tokens as well, and if those fail too, one of the whole class.
        """
        band = self.band(len(tokens))
        rare = tokens
        if len(frequent):
            at = np.searchsorted(frequent, tokens)
            at[at == len(frequent)] = 0
            rare = tokens[frequent[at] != tokens]
        parts = []
        for cls in (band, band - 1):
            count, differ = self.segments(cls) if cls >= 0 else (0, 0)
            if not count:
                continue
            for kind, chosen in enumerate((rare, tokens)):
                salt = np.uint64((2 * cls + kind + 1) << 40)
                found, empty = self._segment_signatures(chosen, count, salt)
                parts.append(found)
                if empty < count - differ:
                    break
            else:
                parts.append(mixed(np.array([salt], dtype=np.uint64)))
        return np.concatenate(parts) if parts else np.zeros(0, dtype=np.uint64)

    @staticmethod
    def _segment_signatures(tokens: np.ndarray, count: int, salt: np.uint64) -> tuple[np.ndarray, int]:
        segment = ((tokens >> np.uint64(32)) % np.uint64(count)).astype(np.int64)
        sums = np.zeros(count, dtype=np.uint64)
        np.add.at(sums, segment, mixed(tokens + salt))
        filled = np.bincount(segment, minlength=count) > 0
        places = np.flatnonzero(filled).astype(np.uint64)
        return mixed(sums[filled] ^ mixed(places + salt)), count - len(places)


def frequent_shingles(source: DataFrame, width: int) -> np.ndarray:
    """Sorted hashes of shingles that repeat within tasks, the most frequent ones over all texts."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        waiting = 0

        def repeated() -> pa.RecordBatch:
            tokens, counts = np.unique(np.concatenate(held), return_counts=True)
            often = counts >= 3
            return pa.RecordBatch.from_arrays(
                [pa.array(tokens[often].view(np.int64)), pa.array(counts[often])], ["token", "n"])

        for batch in batches:
            for text in batch.column(0):
                tokens = shingles(text.as_py(), width)
                held.append(tokens)
                waiting += len(tokens)
                if waiting >= CHUNK_SHINGLES:
                    yield repeated()
                    held, waiting = [], 0
        if waiting:
            yield repeated()

    counted = source.select("text").mapInArrow(count, "token long, n long").groupBy("token").agg(
        F.sum("n").alias("n")).filter(F.col("n") >= FREQUENT_FROM)
    rows = counted.orderBy(F.desc("n"), "token").limit(FREQUENT_SHINGLES).select("token").toArrow()
    return np.sort(rows.column("token").to_numpy().astype(np.int64).view(np.uint64))


def _distinct_pairs(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.lexsort((b, a))
    a, b = a[order], b[order]
    new = np.ones(len(a), dtype=bool)
    new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    return a[new], b[new]


def stars(signatures: np.ndarray, nodes: np.ndarray) -> tuple[np.ndarray, ...]:
    """Distinct signatures with their smallest node, and distinct edges from other nodes to it."""
    order = np.lexsort((nodes, signatures))
    signatures, nodes = signatures[order], nodes[order]
    head = np.ones(len(signatures), dtype=bool)
    head[1:] = signatures[1:] != signatures[:-1]
    center = nodes[head][np.cumsum(head) - 1]
    other = nodes != center
    a, b = _distinct_pairs(nodes[other], center[other])
    return signatures[head], nodes[head], a, b


def _bytes(values: np.ndarray) -> bytes:
    return values.astype("<i8" if values.dtype.kind == "i" else "<u8").tobytes()


def candidate_edges(source: DataFrame, width: int, threshold: tuple[int, int]) -> DataFrame:
    """Edges (a, b) between the set numbers of sets that share a signature, in stars."""
    size = source.agg(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0
    shared = source.sparkSession.sparkContext.broadcast(frequent_shingles(source, width))
    buckets = max(8, min(1 << 20, size // (16 * BUCKET_SIGNATURES)))

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classes, frequent = Classes(threshold), shared.value
        held: list[tuple[np.ndarray, np.ndarray]] = []
        seen: set[int] = set()
        waiting = 0

        def emit() -> pa.RecordBatch:
            values, nodes, a, b = stars(*(np.concatenate(p) for p in zip(*held)))
            bucket = ((values >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)
            cuts = np.searchsorted(bucket, np.arange(buckets + 1, dtype=np.uint64))
            edge_cuts = np.linspace(0, len(a), buckets + 1).astype(int)
            rows = [
                (k, _bytes(values[i:j]), _bytes(nodes[i:j]), _bytes(a[p:q]), _bytes(b[p:q]))
                for k, (i, j, p, q) in enumerate(zip(cuts, cuts[1:], edge_cuts, edge_cuts[1:]))
                if j > i or q > p
            ]
            kinds = (pa.int32(), *[pa.binary()] * 4)
            return pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(zip(*rows), kinds)],
                ["bucket", "signatures", "nodes", "a", "b"])

        for batch in batches:
            for text in batch.column(0):
                tokens = shingles(text.as_py(), width)
                if not len(tokens):
                    continue
                number = int(set_digest(tokens)[:15], 16)
                if number in seen:  # the same set, in this task already
                    continue
                found = classes.signatures(tokens, frequent)
                if not len(found):
                    continue
                seen.add(number)
                held.append((found, np.full(len(found), number, dtype=np.int64)))
                waiting += len(found)
                if waiting >= CHUNK_SIGNATURES:
                    yield emit()
                    held, waiting = [], 0
                    if len(seen) > 1_000_000:
                        seen.clear()
        if held:
            yield emit()

    def meet(group: pd.DataFrame) -> pd.DataFrame:
        def all_of(name: str, kind: str) -> np.ndarray:
            return np.frombuffer(b"".join(group[name]), dtype=kind)

        _, _, a, b = stars(all_of("signatures", "<u8"), all_of("nodes", "<i8"))
        a, b = np.concatenate((a, all_of("a", "<i8"))), np.concatenate((b, all_of("b", "<i8")))
        a, b = _distinct_pairs(a, b)
        return pd.DataFrame({"a": a, "b": b})

    sent = source.select("text").mapInArrow(
        send, "bucket int, signatures binary, nodes binary, a binary, b binary")
    return sent.groupBy("bucket").applyInPandas(meet, "a long, b long")


class Parts:
    """Union-find over small numbers."""

    def __init__(self, n: int):
        self.parent = list(range(n))
        self.count = n

    def root(self, x: int) -> int:
        while self.parent[x] != x:
            self.parent[x] = self.parent[self.parent[x]]
            x = self.parent[x]
        return x

    def join(self, x: int, y: int) -> bool:
        x, y = self.root(x), self.root(y)
        if x == y:
            return False
        self.parent[max(x, y)] = min(x, y)
        self.count -= 1
        return True


class TokenGroups:
    """Sets in groups, and the matrix of groups and tokens (by token, the groups whose union holds it)."""

    def __init__(self, sets: list[np.ndarray], group_sets: int = GROUP_SETS):
        self.sets = sets
        order = sorted(range(len(sets)), key=lambda i: (int(sets[i][0]), len(sets[i])))
        self.members = [order[i:i + group_sets] for i in range(0, len(order), group_sets)]
        self.least = np.array([min(len(sets[i]) for i in g) for g in self.members])
        self.place = {i: k for k, g in enumerate(self.members) for i in g}
        unions = [np.unique(np.concatenate([sets[i] for i in g])) for g in self.members]
        tokens = np.concatenate(unions)
        groups = np.repeat(np.arange(len(unions)), [len(u) for u in unions])
        order = np.argsort(tokens, kind="stable")
        tokens, self.groups = tokens[order], groups[order]
        head = np.ones(len(tokens), dtype=bool)
        head[1:] = tokens[1:] != tokens[:-1]
        self.tokens = tokens[head]
        self.starts = np.append(np.flatnonzero(head), len(tokens))

    def qualifying(self, query: np.ndarray, num: int, den: int) -> np.ndarray:
        """Groups whose union overlaps the query as far as the smallest member must, at least."""
        at = np.searchsorted(self.tokens, query)
        at[at == len(self.tokens)] = 0
        at = at[self.tokens[at] == query]
        widths = self.starts[at + 1] - self.starts[at]
        ends = np.cumsum(widths)
        places = np.arange(ends[-1] if len(ends) else 0) + np.repeat(self.starts[at] - ends + widths, widths)
        overlap = np.bincount(self.groups[places], minlength=len(self.members))
        return np.flatnonzero(overlap * (num + den) >= num * (len(query) + self.least))


def link(sets: list[np.ndarray], labels: list[int], parts: Parts, threshold: tuple[int, int],
         queries: list[int] | None = None, against: list[int] | None = None) -> list[tuple[int, int]]:
    """Joins the parts of linked sets; returns the pairs of sets that joined two parts.

    All pairs, or `queries` with the sets in `against`. `labels` are the parts the sets are in.
    """
    num, den = threshold
    inside = list(range(len(sets))) if against is None else against
    if not inside:
        return []
    matrix = TokenGroups([sets[i] for i in inside])
    joined: list[tuple[int, int]] = []
    everything = set(labels)
    parts_left = len({parts.root(x) for x in everything})
    place = {i: k for k, i in enumerate(inside)}
    asking = inside if queries is None else queries
    if queries is None:
        asking = [inside[i] for g in matrix.members for i in g]
    for query in asking:
        if parts_left == 1:
            break
        tokens, size = sets[query], len(sets[query])
        own_group = matrix.place[place[query]] if queries is None else -1
        for group in matrix.qualifying(tokens, num, den).tolist():
            if group < own_group:
                continue  # compared when its members were queries
            for k in matrix.members[group]:
                other = inside[k]
                if parts.root(labels[other]) == parts.root(labels[query]):
                    continue
                least, most = sorted((size, len(sets[other])))
                if den * least < num * most:
                    continue
                at = np.searchsorted(tokens, sets[other])
                at[at == size] = 0
                overlap = int((tokens[at] == sets[other]).sum())
                if overlap * (num + den) >= num * (least + most):
                    parts.join(labels[query], labels[other])
                    joined.append((query, other))
                    parts_left -= 1
    return joined


def _sets_of(group: pd.DataFrame, width: int) -> tuple[list[str], list[np.ndarray], pd.DataFrame]:
    """Each wanted set once (a document's id may occur with other texts, which are not wanted)."""
    tokens = [shingles(t, width) for t in group["text"]]
    digests = [set_digest(t) for t in tokens]
    kept: dict[str, int] = {}
    for i, (digest, wanted) in enumerate(zip(digests, group["digest"])):
        if digest == wanted:
            kept.setdefault(digest, i)
    places = list(kept.values())
    return list(kept), [tokens[i] for i in places], group.iloc[places]


def _link_small(members: DataFrame, width: int, threshold: tuple[int, int]) -> DataFrame:
    """Edges between digests, for components of which several fit into a task (column `bin`)."""
    def run(group: pd.DataFrame) -> pd.DataFrame:
        found: list[tuple[str, str]] = []
        for _, rows in group.groupby("component"):
            digests, sets, _ = _sets_of(rows, width)
            parts = Parts(len(sets))
            found += [(digests[i], digests[j])
                      for i, j in link(sets, list(range(len(sets))), parts, threshold)]
        return pd.DataFrame(found, columns=["a", "b"])

    return members.select("bin", "component", "digest", "text").groupBy("bin").applyInPandas(
        run, "a string, b string")


def _link_blocks(frame: DataFrame, keys: list[str], width: int, threshold: tuple[int, int],
                 asked: bool) -> DataFrame:
    """Edges between the labels of a block's sets; with `asked`, of the rows marked `query` with all."""
    def run(group: pd.DataFrame) -> pd.DataFrame:
        if asked:
            blocks = [_sets_of(part, width) for _, part in sorted(group.groupby("query"), reverse=True)]
            if len(blocks) < 2:
                return pd.DataFrame([], columns=["a", "b"])
            sets = blocks[0][1] + blocks[1][1]
            names = blocks[0][2]["label"].tolist() + blocks[1][2]["label"].tolist()
            cut = len(blocks[0][1])
            queries, against = list(range(cut)), list(range(cut, len(sets)))
        else:
            _, sets, rows = _sets_of(group, width)
            names, queries, against = rows["label"].tolist(), None, None
        numbers = {name: i for i, name in enumerate(dict.fromkeys(names))}
        labels = [numbers[n] for n in names]
        parts = Parts(len(numbers))
        found = link(sets, labels, parts, threshold, queries, against)
        return pd.DataFrame([(names[i], names[j]) for i, j in found], columns=["a", "b"])

    return frame.groupBy(*keys).applyInPandas(run, "a string, b string")


def _relabelled(rows: DataFrame, edges: DataFrame) -> DataFrame:
    names = components(edges).select(F.col("node").alias("label"), F.col("component").alias("joined"))
    return rows.join(names, "label", "left").withColumn(
        "label", F.coalesce("joined", "label")).drop("joined")


def _link_large(members: DataFrame, width: int, threshold: tuple[int, int], task_tokens: int) -> DataFrame:
    """digest, label: exact parts of candidate components that do not fit into one task."""
    rows = members.select("component", "digest", "n", "text").withColumn("label", F.col("digest"))
    rows = saved(rows, "large-components")
    base = rows.drop("label")
    state = rows.select("component", "digest", "n", "label")

    def with_blocks(frame: DataFrame, name: str, seed: int) -> DataFrame:
        totals = frame.groupBy("component").agg(
            F.ceil(F.sum("n") / task_tokens).cast("int").alias(f"{name}s"))
        return frame.join(totals, "component").withColumn(
            name, F.pmod(F.xxhash64(F.lit(seed), "digest"), F.col(f"{name}s")).cast("int"))

    def texts(frame: DataFrame) -> DataFrame:
        return frame.join(base.select("digest", "text"), "digest")

    for seed in (1, 2):
        cut = texts(with_blocks(state, "block", seed))
        edges = _link_blocks(cut.select("component", "block", "digest", "label", "text"),
                             ["component", "block"], width, threshold, asked=False)
        state = saved(_relabelled(state, edges), "large-labels")
    sizes = state.groupBy("component", "label").agg(F.sum("n").alias("tokens"))
    largest = sizes.groupBy("component").agg(F.max(F.struct("tokens", "label")).alias("top")).select(
        "component", F.col("top.label").alias("top"))
    asking = with_blocks(
        state.join(largest, "component").filter("label <> top").drop("top"), "slice", 3)
    slices = asking.select("component", "slices").distinct()
    blocks = with_blocks(state, "block", 1)
    counts = blocks.select("component", "blocks").distinct()
    columns = ["component", "block", "slice", "query", "digest", "label", "text"]
    compared = texts(
        blocks.join(slices, "component").withColumn("slice", F.explode(F.sequence(F.lit(0), F.col("slices") - 1)))
        .withColumn("query", F.lit(False)).select(*columns[:-1])
        .unionByName(
            asking.join(counts, "component")
            .withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
            .withColumn("query", F.lit(True)).select(*columns[:-1])))
    edges = _link_blocks(compared.select(*columns), ["component", "block", "slice"], width, threshold, asked=True)
    return _relabelled(state, edges).select("digest", "label")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                    width: int = SHINGLE, threshold: tuple[int, int] = THRESHOLD,
                    task_tokens: int = TASK_TOKENS) -> DataFrame:
    """doc_id, n_shingles, component_id, one row per row of `docs`.

    Texts link when the similarity of their shingle sets is at least num / den of `threshold`; the
    component is the smallest id reached by links. Texts without words link with nothing. Equal sets
    meet by a 128-bit digest and shingles are compared by 64-bit hashes. Rows without id get the
    component of their set. Repeated rows give repeated rows, an empty table none; other columns
    are not looked at.
    """
    source = documents_of(docs, id_col, text_col)
    kind = source.schema["doc_id"].dataType.simpleString()

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingles(t.as_py(), width) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([len(s) for s in sets], pa.int64()),
                 pa.array([set_digest(s) for s in sets], pa.string())], ["doc_id", "n", "digest"])

    def name_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            digests = [set_digest(shingles(t.as_py(), width)) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([pa.array(digests, pa.string()), batch.column(1)], ["digest", "text"])

    sets = saved(source.mapInArrow(measure, f"doc_id {kind}, n long, digest string"), "shingle-sets")
    number = F.conv(F.substring("digest", 1, 15), 16, 10).cast("long")
    classes = sets.filter("n > 0").groupBy("digest").agg(
        F.min("doc_id").alias("least"), F.first("n").alias("n")).withColumn("node", number)
    routed = components(candidate_edges(source, width, threshold))
    members = saved(classes.join(routed, "node").select("component", "digest", "least", "n"), "members")
    weights = members.groupBy("component").agg(F.sum("n").alias("tokens"), F.count("*").alias("sets")).filter(
        "sets > 1")
    totals = weights.filter(F.col("tokens") <= task_tokens).agg(F.sum("tokens").alias("n")).first()["n"] or 0
    bins = max(1, -(-totals // task_tokens)) * 2
    wanted = members.join(weights, "component").withColumnRenamed("least", "doc_id")
    # An id names its text unless it is missing or stands for several sets: these are found by their digest.
    vague = saved(
        sets.filter("n > 0 AND doc_id IS NOT NULL").groupBy("doc_id").agg(
            F.min("digest").alias("low"), F.max("digest").alias("high"))
        .filter("low <> high").select("doc_id"), "vague-ids")
    nameless = not sets.filter("n > 0 AND doc_id IS NULL").isEmpty()
    columns = ["doc_id", "text", *(c for c in wanted.columns if c != "doc_id")]
    if nameless or not vague.isEmpty():
        odd = source.filter("doc_id IS NULL").unionByName(source.join(vague, "doc_id", "left_semi"))
        by_digest = odd.mapInArrow(name_texts, "digest string, text string").groupBy("digest").agg(
            F.first("text").alias("text"))
        clear = wanted.join(vague, "doc_id", "left_anti").filter("doc_id IS NOT NULL")
        unclear = wanted.filter("doc_id IS NULL").unionByName(wanted.join(vague, "doc_id", "left_semi"))
        found = source.join(clear, "doc_id").select(*columns).unionByName(
            by_digest.join(unclear, "digest").select(*columns))
    else:
        found = source.join(wanted, "doc_id").select(*columns)
    # The texts of documents that have candidates; the only time that all texts are moved.
    texts = saved(found, "texts-with-candidates")
    small = texts.filter(F.col("tokens") <= task_tokens).withColumn(
        "bin", F.pmod(F.xxhash64("component"), F.lit(bins)).cast("int"))
    parts = components(_link_small(small, width, threshold)).select(
        F.col("node").alias("digest"), F.col("component").alias("label"))
    large = weights.filter(F.col("tokens") > task_tokens)
    if not large.isEmpty():
        parts = parts.unionByName(saved(
            _link_large(texts.filter(F.col("tokens") > task_tokens), width, threshold, task_tokens),
            "large-parts"))
    named = classes.join(parts, "digest", "left").withColumn("label", F.coalesce("label", "digest"))
    least = named.groupBy("label").agg(F.min("least").alias("component_id"))
    answer = named.join(least, "label").select("digest", "component_id")
    return sets.join(answer, "digest", "left").select(
        "doc_id", F.col("n").alias("n_shingles"),
        F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))


def representatives(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                    width: int = 5, threshold: tuple[int, int] = (80, 100), **options) -> DataFrame:
    """The rows of `docs` that stay when of each component only the document with the smallest id does,
    with their own columns. Rows without id stay, and so do all rows of an id that stays."""
    found = near_duplicates(docs, id_col, text_col, width, threshold, **options)
    gone = found.filter(~F.col("doc_id").eqNullSafe(F.col("component_id"))).select(
        F.col("doc_id").alias("_gone")).distinct()
    rows = docs.select(F.struct("*").alias("row"))
    return rows.join(gone, F.col(f"row.{id_col}") == F.col("_gone"), "left_anti").select("row.*")
