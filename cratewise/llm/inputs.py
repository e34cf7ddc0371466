"""What the queries and the pipeline read: the given tables, and the models learned from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cratewise.llm import langid, quality
from cratewise.session import tune

#: Rows that Spark hands to a Python worker at a time: long texts make the default of 10,000 too many.
ARROW_ROWS = 1_000


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", ARROW_ROWS)
    return tune(spark).read.parquet(f"{folder}/{name}.parquet")


def held_out(divisor: int, remainder: int) -> Column:
    """Whether the document is kept from training: by the CRC-32 of its id's digits."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % divisor == remainder


def language_model(spark: SparkSession, folder: str) -> langid.Model:
    return langid.fit(table(spark, folder, "documents").where(~held_out(4, 2)))


def quality_model(spark: SparkSession, folder: str) -> quality.Model | None:
    return quality.fit(table(spark, folder, "documents"), table(spark, folder, "labels").where(~held_out(5, 0)))
