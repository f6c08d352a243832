"""From raw documents to token ids: filter, remove copies, remove near copies, mix, encode.

Every stage is a function of (session, documents, folder of the tables) and gives documents again, the
last one token ids. `run` writes what a stage gives and reads it again before the next, so a lost
executor costs the work of one stage at most.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from airtally.llm import bpe, exact_dedup, jaccard, mixing, quality
from airtally.llm.tables import saved, table

VOCABULARY = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality scorer keeps; it is fitted on the documents at hand."""
    _, weights = quality.fit(docs)
    return quality.accepted(docs, weights)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the document with the largest id."""
    return exact_dedup.without_duplicates(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts connected by a similarity of 0.8 of their five-word shingles the smallest id."""
    return jaccard.representatives(docs, width=5, threshold=(80, 100))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them: not at all, once, or twice."""
    return mixing.mixed_rows(docs)


def encode_texts(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each row, and the digest of the bytes they decode to."""
    encoded = bpe.encode(docs, VOCABULARY, public_tokenizers.PATTERN, round_trip=True)
    return encoded.select(
        "doc_id", "n_tokens", "ids",
        F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("quality classifier", keep_good),
    ("exact dedup", drop_copies),
    ("n-gram Jaccard join", drop_near_copies),
    ("mixing sources to target weights", mix_sources),
    ("byte-level BPE encoding and decoding", encode_texts),
]

# A trained scorer and token ids are beyond SQL; the tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for number, (_, stage) in enumerate(STAGES, 1):
        docs = saved(stage(spark, docs, sf_dir), f"stage-{number}")
    return docs
