"""Manifests, hash lists, relational tables, reports and exports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from airtally import schemas
from airtally.functions import codec, times
from airtally.session import scratch_path
from airtally.sources import folders, streams


def manifest_texts(whole: DataFrame) -> DataFrame:
    """Texts of single documents (value) from texts with any number of them.

    Documents end with a brace and the next one begins with one, with white space between; inside a document
    a comma would stand there. Titles may hold the same, so what stands within quotes is left alone. Line
    breaks are never within quotes: a line that leaves a quote open ends a document that was cut short.
    """
    # Control characters cannot stand in JSON as they are, so they can stand for escaped characters.
    hidden = F.replace(F.replace("value", F.lit("\\\\"), F.lit("\u0001")), F.lit('\\"'), F.lit("\u0002"))

    def marked_line(line: Column) -> Column:
        parts = F.split(line, '"')
        outside = F.transform(
            parts, lambda part, at: F.when(at % 2 == 0, F.regexp_replace(part, r"\}\s+\{", "}\u0003{")).otherwise(part))
        return F.concat(F.array_join(outside, '"'), F.when(F.size(parts) % 2 == 0, "\u0003").otherwise(""))

    lines = F.array_join(F.transform(F.split(hidden, "\n"), marked_line), "\n")
    marked = F.regexp_replace(lines, r"\}[ \t\r]*\n\s*\{", "}\u0003{")
    cut = whole.select(F.explode(F.split(marked, "\u0003")).alias("hidden"))
    shown = F.replace(F.replace("hidden", F.lit("\u0002"), F.lit('\\"')), F.lit("\u0001"), F.lit("\\\\"))
    return cut.select(shown.alias("value")).filter(F.col("value").rlike(r"\S"))


def decode_manifests(whole: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Content items of texts of manifests (value), and the pieces that are no document. A document that
    was cut short takes no whole one along: of a text that does not decode, lines that are documents count."""
    good, broken = streams.decode_lenient(manifest_texts(whole), schemas.MANIFEST)
    pieces = broken.select(F.explode(F.split("value", r"\n\s*(?=\{)")).alias("value"))
    rescued, left = streams.decode_lenient(pieces, f"{schemas.MANIFEST}, content_id string")
    # A line that holds an item instead of a document belongs to a document that did not decode.
    no_document = rescued.filter("items IS NULL").select(F.to_json(F.struct("*")).alias("value"))
    documents = good.unionByName(rescued.filter("items IS NOT NULL").select("items"))
    return documents.select(F.inline("items")), left.unionByName(no_document)


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """Content items of JSON manifests: any number of documents per file, each on one
    line or spread over many. `read_broken_manifests` has what did not decode."""
    return decode_manifests(spark.read.text(path, wholetext=True))[0]


def read_broken_manifests(spark: SparkSession, path: str) -> DataFrame:
    """Pieces (value) of manifests that are no document, such as documents cut short."""
    return decode_manifests(spark.read.text(path, wholetext=True))[1]


def parse_hash_lines(lines: DataFrame) -> DataFrame:
    """`<start_ms> <hex>` per line; other lines are dropped."""
    parts = F.split(F.trim("value"), r"\s+", 2)
    start = F.try_element_at(parts, F.lit(1)).try_cast("bigint")
    text = F.lower(F.try_element_at(parts, F.lit(2)))
    parsed = lines.select(start.alias("start_ms"), text.alias("fingerprint_hash"))
    return parsed.filter(
        F.col("start_ms").isNotNull() & F.col("fingerprint_hash").rlike("^[0-9a-f]{64}$")
    )


def read_hash_lines(spark: SparkSession, path: str) -> DataFrame:
    return parse_hash_lines(spark.read.text(path))


def seed_references(items: DataFrame, clips: DataFrame) -> DataFrame:
    """Reference rows from a manifest and the hashes of its clips (wav, start_ms,
    fingerprint_hash): one row per clip, with the clip's own content id."""
    joined = items.join(clips, "wav")
    return joined.select(
        "fingerprint_hash",
        codec.clip_key("content_id", "start_ms").alias("content_id"),
        "title", "network", F.coalesce("genre", F.lit("unknown")).alias("genre"),
        "episode", "airdate", "confidence",
    )


def read_dimension(spark: SparkSession, source: str, table: str | None = None,
                   where: Column | None = None, partition: dict | None = None,
                   **options) -> DataFrame:
    """A relational table over JDBC, or a Parquet folder.

    `partition` (column, lowerBound, upperBound, numPartitions) reads a large JDBC
    table in parallel. The filter is pushed to the source in both cases.
    """
    if source.startswith("jdbc:"):
        reader = spark.read.format("jdbc").option("url", source).option("dbtable", table)
        for key, value in {**options, **(partition or {})}.items():
            reader = reader.option("partitionColumn" if key == "column" else key, str(value))
        frame = reader.load()
    else:
        frame = spark.read.parquet(source if table is None else f"{source}/{table}")
    return frame if where is None else frame.filter(where)


def write_payout_reports(payouts: DataFrame, path: str, month: str) -> None:
    """One CSV folder per month and maker, with a header and percent signs."""
    (
        payouts.select(
            F.lit(month).alias("payout_month"), "manufacturer", "device_count",
            F.format_string("%.2f", "revenue_share_usd").alias("revenue_share_usd"),
            F.concat(F.format_string("%.2f", "percentage"), F.lit("%")).alias("percentage"),
        )
        .withColumn("maker", F.col("manufacturer"))
        .repartition("manufacturer")
        .write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
        .partitionBy("payout_month", "manufacturer").option("header", True).csv(path)
    )


def write_export(rows: DataFrame, path: str, form: str = "json") -> None:
    """A subject's data as JSON or CSV; nested columns become JSON text in CSV."""
    if form == "json":
        rows.write.mode("overwrite").option("partitionOverwriteMode", "static").json(path)
        return
    if form != "csv":
        raise ValueError(f"unknown export format {form!r}")
    flat = [
        F.to_json(f.name).alias(f.name)
        if f.dataType.typeName() in ("array", "map", "struct") else F.col(f.name)
        for f in rows.schema.fields
    ]
    writer = rows.select(*flat).write.mode("overwrite").option("partitionOverwriteMode", "static")
    writer.option("header", True).csv(path)


def audit_rows(events: DataFrame, action: str, at: Column, device: str = "device_id",
               operator: Column | None = None, **metadata: Column) -> DataFrame:
    """Audit entries for rows with `device` and `jurisdiction`. Ids are hashes of the
    entry, so a job that runs twice writes the same ids."""
    hashed = F.sha2(F.col(device), 256)
    pairs = [x for name, col in metadata.items() for x in (F.lit(name), col.cast("string"))]
    extra = F.create_map(*pairs) if pairs else F.create_map().cast("map<string,string>")
    return events.select(
        F.sha2(F.concat_ws("|", hashed, F.lit(action), at.cast("string")), 256).alias("log_id"),
        at.alias("timestamp"), F.lit(action).alias("action"), hashed.alias("device_id_hash"),
        "jurisdiction",
        (F.lit(None).cast("string") if operator is None else operator).alias("operator_id"),
        extra.alias("metadata"),
    )


def append_audit(entries: DataFrame, path: str) -> None:
    (
        entries.withColumns(
            dict(zip(("year", "month", "day"), times.date_parts("timestamp")))
        )
        .hint("rebalance", "year", "month", "day")
        .write.mode("append").partitionBy("year", "month", "day").json(path)
    )


def read_audit(spark: SparkSession, path: str, device_hash: str | None = None,
               as_of: Column | None = None, days: int = 90) -> DataFrame:
    """Entries of the last days, for one device if named. The folders outside the
    span are not read."""
    schema = f"{schemas.AUDIT_LOG}, year string, month string, day string"
    logs = spark.read.schema(schema).json(path)
    if as_of is not None:
        folder = F.concat_ws("-", "year", "month", "day")
        oldest = F.date_format(F.date_sub(as_of.cast("date"), days), "yyyy-MM-dd")
        logs = logs.filter(folder >= oldest)
    if device_hash is not None:
        logs = logs.filter(F.col("device_id_hash") == device_hash)
    return logs.drop("year", "month", "day")


def write_members(members: DataFrame, path: str, now: Column, refreshed: list[str],
                  ttl_hours: int = 25) -> None:
    """Replace the member sets of the refreshed segments.

    Their partitions are overwritten; a segment that has no members any more loses
    its folder. Other segments are not touched.
    """
    spark = members.sparkSession
    expires = now + F.make_dt_interval(hours=F.lit(ttl_hours))
    before = set(folders.partition_values(spark, path, "segment_id"))
    fresh = members.filter(F.col("segment_id").isin(refreshed))
    # Written once beside the table; folder names then tell which segments are empty now.
    staged = scratch_path(spark, "members")
    fresh.hint("rebalance", "segment_id").write.partitionBy("segment_id").parquet(staged)
    filled = set(folders.partition_values(spark, staged, "segment_id"))
    if filled:
        (
            spark.read.schema(members.schema).parquet(staged).withColumn("expires_at", expires)
            .write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
            .partitionBy("segment_id").parquet(path)
        )
    folders.drop_partitions(spark, path, "segment_id", (before & set(refreshed)) - filled)


def read_members(spark: SparkSession, path: str, now: Column) -> DataFrame:
    """Members that have not expired."""
    return spark.read.parquet(path).filter(F.col("expires_at") > now)
