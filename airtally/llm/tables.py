"""Reading tables and cutting lineage, shared by the operators of this package."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from airtally.session import scratch_path

# Bytes that separate words: space and \t \n \v \f \r.
SPACE = r"\x20\x09-\x0D"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def saved(frame: DataFrame, name: str) -> DataFrame:
    """The frame written to a new folder of the shared scratch space and read again.

    Later jobs then neither repeat its work nor depend on the executors that did it.
    """
    spark = frame.sparkSession
    path = scratch_path(spark, name)
    frame.write.parquet(path)
    return spark.read.schema(frame.schema).parquet(path)


def documents_of(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Only the id and the text, so that no other column can clash; no text is empty text."""
    return docs.select(
        F.col(id_col).alias("doc_id"),
        F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"),
    )


def word_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(f"[^{SPACE}]+")).cast("long")


def packed(docs: DataFrame) -> DataFrame:
    """All columns of a row as one struct, `row`: helper columns beside it clash with none."""
    return docs.select(F.struct("*").alias("row"))
