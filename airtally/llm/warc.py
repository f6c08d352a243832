"""WARC archives with an index, written and read by byte ranges.

Each task writes the records of its rows to archives of its own, one gzip member per record, and gives
back an index row per record: archive, offset, length, URL and digest of the payload. The index is what
makes a record count: an archive that a lost or repeated task left behind is named by no row of it.
Reading starts from index rows. They are dealt by stretches of an archive, sorted by offset, and ranges
that lie close together become one read.

Archives lie in the shared folder and are reached through Arrow's file systems, by URI.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterable, Iterator
from urllib.parse import quote

import pandas as pd
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from airtally.session import saved, scratch_path

REVISIT_BYTES = 100
ARCHIVE_BYTES = 256_000_000
READ_BYTES = 4_000_000
GAP_BYTES = 65_536
TASK_BYTES = 64_000_000
# Rows of a table that may be broadcast.
BROADCAST_ROWS = 100_000
# Pages have no time of their own; a record must have one.
RECORD_DATE = "2024-01-01T00:00:00Z"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
# What may stand in a header's URI as it is.
URI_SAFE = "!#$%&'()*+,/:;=?@[]~"

INDEX_SCHEMA = ("archive string, offset long, length long, page_id long, url string, record_id string, "
                "record_type string, payload_digest string, payload_bytes long")
INDEX_COLUMNS = [field.split()[0] for field in INDEX_SCHEMA.split(", ")]
RECORD_SCHEMA = ("archive string, offset long, page_id long, target_uri string, record_id string, "
                 "record_type string, payload_digest string, payload_bytes long, refers_to long, payload binary")
RECORD_COLUMNS = [field.split()[0] for field in RECORD_SCHEMA.split(", ")]


def record_id(page_id: int | None, url: str | None, digest: str, copy: int) -> str:
    """The same id whenever the same row is written again."""
    name = f"{page_id}|{url}|{digest}|{copy}".encode("utf-8", "surrogatepass")
    return f"<urn:uuid:{uuid.UUID(bytes=hashlib.sha256(name).digest()[:16], version=5)}>"


def record_bytes(fields: list[tuple[str, str]], block: bytes) -> bytes:
    head = "".join(f"{name}: {value}\r\n" for name, value in fields)
    return b"WARC/1.1\r\n" + head.encode() + b"Content-Length: %d\r\n\r\n" % len(block) + block + b"\r\n\r\n"


def make_record(page_id: int | None, url: str | None, payload: bytes, digest: str, copy: int,
                first: tuple[int | None, str | None] | None) -> tuple[str, bytes]:
    """Id and bytes of a record; `first` is the (page_id, url) whose payload a revisit repeats.

    Page ids stand in fields of their own, which readers that do not know them skip.
    """
    own = record_id(page_id, url, digest, copy)
    uri = quote(url, safe=URI_SAFE) if url else f"urn:page:{page_id}"
    fields = [("WARC-Type", "revisit" if first else "response"), ("WARC-Record-ID", own),
              ("WARC-Date", RECORD_DATE), ("WARC-Target-URI", uri),
              ("WARC-Payload-Digest", f"sha256:{digest}"),
              ("Content-Type", "application/http;msgtype=response")]
    if page_id is not None:
        fields.append(("Page-ID", str(page_id)))
    if first:
        fields += [("WARC-Profile", REVISIT_PROFILE), ("WARC-Refers-To", record_id(*first, digest, 0))]
        if first[0] is not None:
            fields.append(("Refers-To-Page-ID", str(first[0])))
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    return own, record_bytes(fields, http if first else http + payload)


def packed_member(data: bytes) -> bytes:
    """A gzip member without a time, so that equal records give equal bytes."""
    coder = zlib.compressobj(6, zlib.DEFLATED, 31)
    return coder.compress(data) + coder.flush()


def fields_of(head: bytes) -> dict[str, str]:
    lines = head.split(b"\r\n")[1:]
    parts = (line.split(b":", 1) for line in lines if b":" in line)
    return {name.decode().lower(): value.strip().decode() for name, value in parts}


def parse_record(data: bytes) -> dict:
    """Fields of one record; the digest of a payload that is there is taken of its bytes."""
    head, _, rest = data.partition(b"\r\n\r\n")
    if not head.startswith(b"WARC/1."):
        raise ValueError("no record begins here")
    fields = fields_of(head)
    block = rest[:int(fields["content-length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    page, other = fields.get("page-id"), fields.get("refers-to-page-id")
    found = {
        "page_id": None if page is None else int(page), "target_uri": fields["warc-target-uri"],
        "record_id": fields["warc-record-id"], "record_type": fields["warc-type"],
        "refers_to": None if other is None else int(other), "payload": None,
        "payload_digest": fields["warc-payload-digest"].removeprefix("sha256:"),
        "payload_bytes": int(fields_of(http)["content-length"])}
    if found["record_type"] == "response":
        found |= {"payload": payload, "payload_digest": hashlib.sha256(payload).hexdigest(),
                  "payload_bytes": len(payload)}
    return found


def archive_writer(folder: str, archive_bytes: int):
    """Task function: rows to archives, index rows back."""

    def write(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store, base = fs.FileSystem.from_uri(folder)
        stem = f"part-{TaskContext.get().partitionId():05d}-{uuid.uuid4().hex}"
        sink, name, offset, number = None, "", 0, 0
        try:
            for batch in batches:
                out = []
                for row in batch.itertuples(index=False):
                    if sink is None or offset >= archive_bytes:
                        if sink is not None:
                            sink.close()
                        name, offset, number = f"{stem}-{number}.warc.gz", 0, number + 1
                        sink = store.open_output_stream(f"{base}/{name}", compression=None)
                    page_id = None if row.page_id is None else int(row.page_id)
                    first = None
                    if row.revisits:
                        first = None if row.first_id is None else int(row.first_id), row.first_url
                    own, data = make_record(page_id, row.url, row.payload, row.digest, int(row.copy), first)
                    member = packed_member(data)
                    sink.write(member)
                    out.append((f"{folder}/{name}", offset, len(member), page_id, row.url, own,
                                "revisit" if first else "response", row.digest, len(row.payload)))
                    offset += len(member)
                frame = pd.DataFrame(out, columns=INDEX_COLUMNS)
                frame["page_id"] = pd.array([entry[3] for entry in out], dtype="Int64")
                yield frame
        finally:
            if sink is not None:
                sink.close()

    return write


def first_of(page_id: Column, url: Column) -> Column:
    """Order of the rows with one payload: by page_id, none last, then by URL."""
    return F.struct(page_id.isNull().alias("no_id"), page_id.alias("id"), url.isNull().alias("no_url"),
                    url.alias("url"))


def with_firsts(pages: DataFrame, revisit_bytes: int = REVISIT_BYTES,
                broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """page_id, url, payload, digest, copy, revisits, first_id, first_url: what to write for each row.

    Payloads are compared by digest, counted before they are shuffled. Only digests that repeat
    are joined back to the pages; while they are few, the pages stay where they were read. Equal rows
    (page_id, URL and payload) are merged and written as often as they come: the first as the others' response.
    """
    rows = pages.select(
        F.col("page_id").cast("long"), F.col("url").cast("string"),
        F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary").alias("payload")
    ).withColumn("digest", F.sha2("payload", 256))
    counted = saved(
        rows.groupBy("page_id", "url", "digest", F.octet_length("payload").alias("size"))
        .agg(F.count(F.lit(1)).alias("copies")), "payload-digests")
    same = [F.col("page_id").eqNullSafe(F.col("same_id")), F.col("url").eqNullSafe(F.col("same_url"))]
    firsts = saved(
        counted.filter(F.col("size") >= revisit_bytes).groupBy("digest")
        .agg(F.sum("copies").alias("rows"), F.min(first_of(F.col("page_id"), F.col("url"))).alias("first"))
        .filter("rows > 1").select("digest", "first"), "repeated-payloads")
    repeated = saved(counted.filter("copies > 1").select(
        F.col("digest").alias("same_digest"), F.col("page_id").alias("same_id"), F.col("url").alias("same_url"),
        "copies"), "repeated-rows")
    small = firsts.count() <= broadcast_rows
    one = F.lit(0).cast("long").alias("copy")
    equal_rows = repeated.count()
    if equal_rows:
        found = F.broadcast(repeated) if equal_rows <= broadcast_rows else repeated
        on = [F.col("digest") == F.col("same_digest"), *same]
        merged = rows.join(found, on, "inner").groupBy("page_id", "url", "digest", "copies").agg(
            F.first("payload").alias("payload"))
        rows = rows.join(found, on, "left_anti").select("*", one).unionByName(
            merged.select("page_id", "url", "payload", "digest",
                          F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1)).alias("copy")))
    else:
        rows = rows.select("*", one)
    marked = rows.join(F.broadcast(firsts) if small else firsts, "digest", "left")
    is_first = (F.col("first.id").eqNullSafe(F.col("page_id")) & F.col("first.url").eqNullSafe(F.col("url"))
                & (F.col("copy") == 0))
    return marked.select(
        "page_id", "url", "payload", "digest", "copy", (F.col("first").isNotNull() & ~is_first).alias("revisits"),
        F.col("first.id").alias("first_id"), F.col("first.url").alias("first_url"))


def write_archives(pages: DataFrame, folder: str, revisit_bytes: int = REVISIT_BYTES,
                   archive_bytes: int = ARCHIVE_BYTES, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Archives of the pages below `folder`, and their index, which is a table there: one row per record.

    Takes page_id, url and html; other columns are not looked at. No html is an empty payload. Of
    equal payloads of at least `revisit_bytes` bytes the row with the smallest page_id (none last; equal
    ones by URL) is a response, the others revisit it; smaller payloads are all responses. Every row is
    written, repeated ones too. An empty table gives an empty index. Archives take about `archive_bytes`.
    """
    spark = pages.sparkSession
    store, base = fs.FileSystem.from_uri(folder if "://" in folder else f"file://{folder}")
    store.create_dir(base, recursive=True)
    uri = folder if "://" in folder else f"file://{folder}"
    # Ids go as text: beside missing ones, whole numbers would become fractions.
    rows = with_firsts(pages, revisit_bytes, broadcast_rows).withColumns(
        {c: F.col(c).cast("string") for c in ("page_id", "first_id")})
    rows.mapInPandas(archive_writer(uri, archive_bytes), INDEX_SCHEMA).write.parquet(f"{folder}/index")
    return spark.read.schema(INDEX_SCHEMA).parquet(f"{folder}/index")


def read_runs(ranges: list[tuple[int, int]], gap: int, most: int) -> Iterator[list[int]]:
    """Places of sorted (offset, length) ranges that are read together: at most `gap` bytes apart, and
    no longer than `most` together unless one alone is."""
    run: list[int] = []
    begin = end = 0
    for i, (offset, length) in enumerate(ranges):
        if run and (offset - end > gap or offset + length - begin > most):
            yield run
            run = []
        if not run:
            begin = end = offset
        run.append(i)
        end = max(end, offset + length)
    if run:
        yield run


def read_records(index: DataFrame, read_bytes: int = READ_BYTES, gap_bytes: int = GAP_BYTES) -> DataFrame:
    """Records of the given index rows: archive, offset, page_id, target_uri, record_id, record_type,
    payload_digest, payload_bytes, refers_to, payload (none in revisits).

    Payloads are hashed anew; a revisit has no payload of its own, its digest and size are those of the record.
    """

    def read(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for archive, rows in batch.groupby("archive", sort=False):
                store, path = fs.FileSystem.from_uri(archive)
                rows = rows.sort_values("offset", kind="stable")
                ranges = list(zip(rows["offset"].tolist(), rows["length"].tolist()))
                with store.open_input_file(path) as source:
                    for run in read_runs(ranges, gap_bytes, read_bytes):
                        begin = ranges[run[0]][0]
                        end = max(ranges[i][0] + ranges[i][1] for i in run)
                        data = source.read_at(end - begin, begin)
                        out = []
                        for i in run:
                            at = ranges[i][0] - begin
                            record = parse_record(zlib.decompress(data[at:at + ranges[i][1]], 31))
                            out.append({"archive": archive, "offset": ranges[i][0], **record})
                        frame = pd.DataFrame(out, columns=RECORD_COLUMNS)
                        for name in ("page_id", "refers_to"):
                            frame[name] = pd.array([record[name] for record in out], dtype="Int64")
                        yield frame

    # By bytes of the archives: an index is far too small to be spread by its own size.
    size = index.agg(F.sum("length").alias("n")).first()["n"] or 0
    tasks = max(index.sparkSession.sparkContext.defaultParallelism, -(-size // TASK_BYTES))
    stretch = F.floor(F.col("offset") / read_bytes).cast("long").alias("stretch")
    return (
        index.select("archive", "offset", "length", stretch).repartition(tasks, "archive", "stretch")
        .sortWithinPartitions("archive", "offset").select("archive", "offset", "length")
        .mapInPandas(read, RECORD_SCHEMA)
    )


def archive_and_read(spark: SparkSession, pages: DataFrame, folder: str | None = None) -> DataFrame:
    """What the archives of the pages hold, written to a new folder of the shared space and read back."""
    return read_records(write_archives(pages, folder or scratch_path(spark, "warc")))
