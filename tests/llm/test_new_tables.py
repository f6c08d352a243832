"""Prefix trie, archives and ranked search against plain Python versions."""

import gzip
import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest

from airtally.llm import search, trie, warc

TALKS = "conv_id long, turn long, role string, text string, depth long, key string, n_convs long, part string"
PAGES = "page_id long, url string, html string, digest string, copy int, first struct<id:long>, payload string"
TEXTS = "doc_id long, text string, rank int, score string, terms string, shard int, n string"
ITEMS = "item_id long, text string, doc_id long, query string, rank string"


# Prefix trie


def odd_talks(seed=5):
    """Shared beginnings, copies, missing turns, roles and texts, repeated rows, a long conversation."""
    rnd = random.Random(seed)
    texts = ["", "hi", "hé", "日本", "go on", None]
    out = []
    for conv in [*range(60), 7_000_000_005, -6, -10]:
        if conv % 7 == 3:
            continue
        turns = rnd.choice([0, 1, 2, 3, 5, 8, 11])
        for t in range(turns):
            out.append((conv, rnd.choice([t, t, None, t + 1]), rnd.choice(["user", "bot", None]),
                        rnd.choice(texts)))
    out += [(c, t, "user", "same") for c in (100, 101, 102, 107, 131) for t in range(12)]
    out += [(200, t, "user", "w" * 5000) for t in range(14)] + [(201, 0, "a", "b")] * 9
    out += [(None, 0, "user", "nobody")]
    rnd.shuffle(out)
    return [(*r, 1, "k", 2, "p") for r in out]


def plain_trie(rows):
    def turn_key(row):
        role, text = row[2] or "", row[3] or ""
        digest = hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).hexdigest()
        return (row[1] is not None, row[1] or 0, digest[:32])

    own = defaultdict(list)
    for row in rows:
        if row[0] is not None:
            own[row[0]].append(row)
    own = {c: [(r[2] or "", r[3] or "") for r in sorted(rs, key=turn_key)] for c, rs in own.items()}
    members, ends = defaultdict(set), defaultdict(set)
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        base = c - int(math.fmod(c, 5))
        path = tuple(own.get(base, [])[:h] + turns[h:])
        ends[path].add(c)
        for d in range(len(path) + 1):
            members[path[:d]].add(c)
    kids = defaultdict(list)
    for path in members:
        if path:
            kids[path[:-1]].append(path)
    leaves, savings = {}, {}
    for path in sorted(members, key=len, reverse=True):
        leaves[path] = sum(leaves[k] for k in kids[path]) if kids[path] else 1
        size = len(path[-1][1].encode()) if path else 0
        savings[path] = (len(members[path]) - 1) * size + sum(savings[k] for k in kids[path])
    return sorted(
        (min(m), len(p), min(members[p[:-1]]) if p else -1, len(m), len(kids[p]), leaves[p], savings[p],
         hashlib.sha256(",".join(map(str, sorted(ends[p]))).encode()).hexdigest())
        for p, m in members.items())


@pytest.mark.parametrize("band, per_task, rows", [(65_536, 1_000_000, 100_000), (4, 20, 0)])
def test_trie_is_that_of_plain_python(spark, band, per_task, rows):
    talks = odd_talks()
    frame = spark.createDataFrame(talks, TALKS).repartition(3)
    got = trie.prefix_trie(frame, band, per_task, rows).fillna(-1, ["parent_conv_id"]).collect()
    assert sorted(map(tuple, got)) == plain_trie(talks)


def test_trie_of_one_group_of_copies_spread_over_all_ranges(spark):
    talks = [(5 * c, t, "u", f"t{t}") for c in range(3000) for t in range(2)]
    frame = spark.createDataFrame(talks, "conv_id long, turn long, role string, text string")
    got = trie.prefix_trie(frame, per_task=500).fillna(-1, ["parent_conv_id"]).collect()
    assert sorted(map(tuple, got)) == plain_trie(talks)


def test_trie_of_no_conversations(spark):
    assert trie.prefix_trie(spark.createDataFrame([], TALKS)).collect() == []
    nobody = spark.createDataFrame([(None, 1, "u", "t", 1, "k", 2, "p")], TALKS)
    assert trie.prefix_trie(nobody).collect() == []


# Archives


def odd_pages():
    big = "<p>é" + "x" * 300
    rows = [(9, "http://a/1", big), (3, "http://a/2", big), (3, "http://a/2", big), (None, "http://a/3", big),
            (4, "http://b/ ü\r\nX: y", "<b>short"), (5, None, "<b>short"), (6, "http://c", None), (7, "http://c", ""),
            (8, "http://d", "a\r\n\r\nb" * 50), (10, "http://d", "a\r\n\r\nb" * 50), (11, "http://e", "y" * 3_000_000),
            (None, None, "z" * 100), (None, None, "z" * 100), (12, "http://f", "q" * 99), (13, "http://f", "q" * 99)]
    rows += [(9007199254740993, "http://g", f"page {i} " * 20) for i in range(3)]
    rows += [(1000 + i, f"http://h/{i}", "hot page " * 30) for i in range(200)]
    return [(*r, "d", 1, None, "p") for r in rows]


def plain_archive(rows):
    groups = defaultdict(list)
    for i, (page, url, html) in enumerate(r[:3] for r in rows):
        groups[(html or "").encode()].append((page is None, page or 0, url is None, url or "", i))
    out = []
    for payload, members in groups.items():
        first = min(members)
        for m in members:
            revisit = len(payload) >= 100 and m != first
            out.append((None if m[0] else m[1], len(payload), hashlib.sha256(payload).hexdigest(),
                        "revisit" if revisit else "response",
                        None if not revisit or first[0] else first[1]))
    return sorted(out, key=repr)


@pytest.mark.parametrize("broadcast_rows, archive_bytes", [(100_000, 256_000_000), (0, 2_000)])
def test_archives_are_read_back_as_written(spark, tmp_path, broadcast_rows, archive_bytes):
    rows = odd_pages()
    pages = spark.createDataFrame(rows, PAGES).repartition(3)
    index = warc.write_archives(pages, str(tmp_path / "a"), archive_bytes=archive_bytes,
                                broadcast_rows=broadcast_rows)
    got = warc.read_records(index, read_bytes=10_000, gap_bytes=100)
    wanted = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    assert sorted(map(tuple, got.select(*wanted).collect()), key=repr) == plain_archive(rows)
    assert sorted(map(tuple, index.select("page_id", "payload_bytes", "payload_digest", "record_type").collect()),
                  key=repr) == sorted((r[:4] for r in plain_archive(rows)), key=repr)
    ids = [r.record_id for r in index.collect()]
    assert len(set(ids)) == len(ids)


def test_archives_are_gzip_members_that_also_read_from_the_front(spark, tmp_path):
    pages = spark.createDataFrame(odd_pages(), PAGES).repartition(2)
    index = warc.write_archives(pages, str(tmp_path / "a")).collect()
    for archive in {r.archive for r in index}:
        with open(archive.removeprefix("file://"), "rb") as source:
            data = source.read()
        assert sum(r.length for r in index if r.archive == archive) == len(data)
        text = gzip.decompress(data)
        starts = [m.start() for m in re.finditer(rb"WARC/1\.1\r\n", text)]
        assert len(starts) == sum(r.archive == archive for r in index)
        for begin, end in zip(starts, [*starts[1:], len(text)]):
            record = text[begin:end]
            head = record.split(b"\r\n\r\n")[0]
            size = int(re.search(rb"Content-Length: (\d+)$", head)[1])
            assert len(record) == len(head) + 4 + size + 4 and record.endswith(b"\r\n\r\n")
            assert b"\nX: y" not in head


def test_only_selected_records_are_read(spark, tmp_path):
    pages = spark.createDataFrame(odd_pages(), PAGES).repartition(2)
    index = warc.write_archives(pages, str(tmp_path / "a"))
    got = warc.read_records(index.filter("url = 'http://d' AND record_type = 'response'")).collect()
    assert [(r.page_id, bytes(r.payload), r.target_uri) for r in got] == [(8, b"a\r\n\r\nb" * 50, "http://d")]


def test_ranges_that_lie_close_are_one_read():
    ranges = [(0, 10), (10, 5), (20, 5), (40, 5), (45, 100), (145, 1)]
    assert list(warc.read_runs(ranges, 5, 30)) == [[0, 1, 2], [3], [4], [5]]
    assert list(warc.read_runs([], 5, 30)) == []


def test_archives_of_no_pages(spark, tmp_path):
    index = warc.write_archives(spark.createDataFrame([], PAGES), str(tmp_path / "a"))
    assert index.count() == 0 and warc.read_records(index).count() == 0


# Ranked search


def odd_texts(seed=11, count=400):
    rnd = random.Random(seed)
    words = [f"w{i}" for i in range(60)] + ["Été", "ÉTÉ", "x1y", "日本"]
    weights = [1 / (i + 1) for i in range(len(words))]
    rows = [(i, rnd.choice([" ", ", ", "\n", "\x00"]).join(rnd.choices(words, weights, k=rnd.choice([1, 3, 10, 60]))))
            for i in range(count)]
    rnd.shuffle(rows)
    rows += [(5000 + i, "the same W5 w7 text") for i in range(40)]
    rows += [(None, "w5 w7 w9"), (None, None), (6000, ""), (6001, "..."), (6002, "w5 " * 20_000), (6003, "w7 w7")]
    rows += [rows[0]] * 3
    return [(*r, 1, "s", "t", 2, "n") for r in rows]


def odd_items():
    rows = [(1, "w5 w7 text"), (2, "W1 w1 w1 w2"), (3, ""), (4, None), (5, "nowhere"), (6, "Été 日本 w30 w31 w59"),
            (1, "w5 w7 text"), (7, "w0"), (None, "w40, w41"), (8, " ".join(f"w{i}" for i in range(60)))]
    return [(*r, 1, "q", "r") for r in rows]


def plain_search(rows, items, k):
    def terms(text):
        return re.findall("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+",
                          re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))

    counts = [Counter(terms(r[1])) for r in rows]
    held = [(r[0], c, sum(c.values())) for r, c in zip(rows, counts) if c]
    total, length = len(held), sum(n for _, _, n in held)
    df = Counter(t for _, c, _ in held for t in c)
    out = []
    for item in items:
        scores = []
        for at, (doc, c, n) in enumerate(held):
            m = 25 + (75 * n * total) // length
            s = sum(math.floor(1000 * math.log((2 * total + 2) / (2 * df[t] + 1)))
                    * ((1_000_000_000 * c[t]) // (1000 * c[t] + 8 * m)) for t in terms(item[1]) if t in c)
            if s > 0:
                scores.append((-s, doc is None, doc or 0, at))
        out += [(item[0], rank, None if absent else doc, -s)
                for rank, (s, absent, doc, _) in enumerate(sorted(scores)[:k], 1)]
    return sorted(out, key=repr)


@pytest.mark.parametrize("k, postings, block, rounds", [
    (10, 1_500_000, 8_000_000, (1, 8)), (3, 300, 8_000_000, (1, 3)), (25, 500, 40, ()), (1, 100, 8_000_000, (2, 5, 9))])
def test_search_is_that_of_plain_python(spark, k, postings, block, rounds):
    rows, items = odd_texts(), odd_items()
    docs = spark.createDataFrame(rows, TEXTS).repartition(3)
    got = search.search(docs, spark.createDataFrame(items, ITEMS), k, shard_postings=postings,
                        block_bytes=block, rounds=rounds)
    assert sorted(map(tuple, got.collect()), key=repr) == plain_search(rows, items, k)


def test_search_of_nothing(spark):
    docs, items = spark.createDataFrame(odd_texts(), TEXTS), spark.createDataFrame(odd_items(), ITEMS)
    assert search.search(docs.limit(0), items).collect() == []
    assert search.search(docs, items.limit(0)).collect() == []
    assert search.search(docs, items.filter("text IS NULL")).collect() == []


def test_terms_of_long_texts_are_counted_in_slices(monkeypatch):
    text = ("Ab c9 " * 50 + "z" * 300 + " é.é " * 40).encode()
    whole = search.term_counts(text)
    monkeypatch.setattr(search, "SLICE_BYTES", 7)
    assert search.term_counts(text) == whole
    assert whole["z".encode() * 300] == 1 and whole["é".encode()] == 80
