"""The queries p7_ to p9_ over the texts in documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from filament.llm import packing, reading, tokens
from filament.runtime import prepare, table


def p7_ids(spark: SparkSession, d: str) -> DataFrame:
    prepare(spark)
    return tokens.token_ids(table(spark, d, "documents"), "doc_id", "text")


def p8_packed(spark: SparkSession, d: str) -> DataFrame:
    prepare(spark)
    return packing.packed(table(spark, d, "documents"), "doc_id", "text")


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    prepare(spark)
    documents = table(spark, d, "documents")
    english = documents.where((F.col("lang") == "en") & (F.col("doc_kind").isNull() | (F.col("doc_kind") != "listing")))
    return reading.reading_levels(english, table(spark, d, "reading_label"), documents)


QUERIES = {f.__name__: f for f in (p7_ids, p8_packed, p9_found)}
#: SQL cannot express these operators; tests/llm holds brute-force versions and round trips.
ORACLE: dict[str, str] = {}
