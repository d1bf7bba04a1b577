"""Fields that pack several values."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallgrass.operators.packed_values import split_values, unparsed
from tallgrass.sources.tables import table


def _fields(spark: SparkSession, d: str):
    return table(spark, d, "sft_corpus", "scan_idx", "question", "answer"), "answer", F.regexp_count("question", F.lit(r"\[ANS\]"))


def _split(spark: SparkSession, d: str) -> DataFrame:
    return split_values(*_fields(spark, d))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    """Each answer of a field that holds several, with its place among the blanks."""
    return _split(spark, d).select("scan_idx", "pos", "val")


def p5_dialects(spark: SparkSession, d: str) -> DataFrame:
    """How many fields each dialect was the cheapest for."""
    return _split(spark, d).groupBy("dialect").agg(F.countDistinct("scan_idx").alias("fields"), F.count("*").alias("vals"))


def p5_unparsed(spark: SparkSession, d: str) -> DataFrame:
    """Fields that no parse divides into as many values as their question has blanks."""
    return unparsed(*_fields(spark, d))


QUERIES = {f.__name__: f for f in (p5_found, p5_dialects, p5_unparsed)}
SQL: dict[str, str] = {}
