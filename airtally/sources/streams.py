"""Topics as streams: from Kafka on a cluster, from JSON files elsewhere."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from airtally import schemas
from airtally.functions import scoring

# Topics and their layouts.
TOPICS = {
    "raw.fingerprints": schemas.FINGERPRINT_EVENT,
    "matched.viewership": schemas.VIEWERSHIP_EVENT,
    "unmatched.fingerprints": schemas.UNMATCHED_EVENT,
    "reference.content": schemas.REFERENCE_EVENT,
    "consent.events": schemas.CONSENT_EVENT,
    "segmentation.updates": schemas.SEGMENT_EVENT,
    "billing.events": schemas.BILLING_EVENT,
    "ingest.requests": schemas.INGEST_BATCH,
}
REQUIRED_REFERENCE = ("fingerprint_hash", "content_id", "title", "network")


def raw_values(spark: SparkSession, topic: str, path: str | None = None,
               servers: str | None = None, **options) -> DataFrame:
    """The topic's messages as text in `value`, from the earliest on.

    Offsets are kept by the query's checkpoint, which takes over from there.
    """
    if servers:
        reader = (
            spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers)
            .option("subscribe", topic).option("startingOffsets", "earliest")
        )
        for key, value in options.items():
            reader = reader.option(key, value)
        return reader.load().select(F.col("value").cast("string").alias("value"))
    reader = spark.readStream.format("text")
    for key, value in options.items():
        reader = reader.option(key, value)
    return reader.load(path)


def decode_strict(values: DataFrame, schema: str) -> DataFrame:
    """A message that does not decode fails the job."""
    parsed = F.from_json("value", schema, {"mode": "FAILFAST"})
    return values.select(parsed.alias("v")).select("v.*")


def decode_lenient(values: DataFrame, schema: str) -> tuple[DataFrame, DataFrame]:
    """Decoded messages, and the texts that did not decode."""
    marked = f"{schema}, _corrupt_record string"
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"}
    parsed = values.select("value", F.from_json("value", marked, options).alias("v"))
    broken = F.col("v").isNull() | F.col("v._corrupt_record").isNotNull()
    good = parsed.filter(~broken).select("v.*").drop("_corrupt_record")
    return good, parsed.filter(broken).select("value")


def instant(text: str) -> Column:
    """Time of an RFC 3339 text with any number of digits of a second, null for others."""
    whole = F.regexp_replace(text, r"(\.[0-9]{1,6})[0-9]*", "$1")
    shape = F.col(text).rlike(
        r"^[0-9]{4}-[0-9]{2}-[0-9]{2}[Tt ][0-9:]{8}(\.[0-9]+)?([Zz]|[+-][0-9]{2}:[0-9]{2})$")
    return F.when(shape, whole.try_cast("timestamp"))


def complete_references(decoded: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Reference messages with the four required fields, and the others."""
    present = F.lit(True)
    for name in REQUIRED_REFERENCE:
        present = present & F.col(name).isNotNull()
    return decoded.filter(present), decoded.filter(~present)


def references_from(decoded: DataFrame) -> DataFrame:
    """Reference items: four fields are required, two have defaults, and a date that
    cannot be read is null. `complete_references` has what is missing here."""
    return complete_references(decoded)[0].select(
        "fingerprint_hash", "content_id", "title", "network",
        scoring.or_unknown("genre").alias("genre"),
        "episode",
        instant("airdate").alias("airdate"),
        F.coalesce("confidence", F.lit(1.0)).alias("confidence"),
    )


def consents_from(decoded: DataFrame) -> DataFrame:
    """Consent messages as consent records, their time in whole seconds."""
    return decoded.select(
        "device_id", "opted_in", F.unix_timestamp(instant("timestamp")).alias("consent_time"),
        "jurisdiction", "tcf_string",
    )


def open_topic(spark: SparkSession, topic: str, path: str | None = None,
               servers: str | None = None, strict: bool = False,
               **options) -> tuple[DataFrame, DataFrame | None]:
    """The decoded messages, and a stream of the texts that did not decode (none if a
    broken message fails the job)."""
    values = raw_values(spark, topic, path, servers, **options)
    if strict:
        return decode_strict(values, TOPICS[topic]), None
    return decode_lenient(values, TOPICS[topic])


def keyed_messages(frame: DataFrame, key: str = "device_id") -> DataFrame:
    """Key and JSON value as a Kafka sink takes them; one key, one partition."""
    return frame.select(
        F.col(key).alias("key"), F.to_json(F.struct(*frame.columns)).alias("value")
    )


def write_topic(frame: DataFrame, topic: str, checkpoint: str, path: str | None = None,
                servers: str | None = None, key: str = "device_id"):
    """A stream writer, not started yet, for Kafka or for JSON files."""
    if servers:
        return (
            keyed_messages(frame, key).writeStream.format("kafka")
            .option("kafka.bootstrap.servers", servers).option("topic", topic)
            .option("kafka.acks", "all").option("kafka.compression.type", "snappy")
            .option("kafka.linger.ms", "5").option("checkpointLocation", checkpoint)
        )
    return (
        frame.writeStream.format("json").option("path", path)
        .option("checkpointLocation", checkpoint)
    )


def in_key_order(frame: DataFrame, key: str = "device_id", order: Sequence[str] = ()) -> DataFrame:
    """All messages of a key in the same partition, side by side and in order."""
    return frame.repartition(key).sortWithinPartitions(key, *order)


def write_keyed(frame: DataFrame, path: str, key: str = "device_id", order: Sequence[str] = ()) -> None:
    """Batch form: all messages of a key end up in the same file, in order."""
    in_key_order(frame, key, order).write.mode("append").json(path)
