"""Majority votes over several samples of an item."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def majority(samples: DataFrame, item: str, answer: str, prompt: str, place: str, clean: list[str], text: str) -> DataFrame:
    """The winning answer of each item and its cleanest trace.

    Score of an answer: votes plus half its distinct prompts.  Ties go to more votes, more
    prompts, then the answer seen first.  ``clean`` orders traces, best first.  Null answers have
    no vote; an item with null answers only comes out with its cleanest trace and no votes.
    """
    trace = F.min_by(F.col(text), F.struct(*[F.col(c).alias(c) for c in clean], F.col(place).alias("_place")))
    g = samples.groupBy(item, answer).agg(
        F.count("*").alias("votes"), F.countDistinct(prompt).alias("prompts"), F.min(place).alias("first"), trace.alias("trace")
    )
    voted = F.col(answer).isNotNull()
    g = g.withColumn("votes", F.when(voted, F.col("votes")).otherwise(0)).withColumn("score", F.when(voted, F.col("votes") + 0.5 * F.col("prompts")).otherwise(-1.0))
    w = Window.partitionBy(item).orderBy(F.desc("score"), F.desc("votes"), F.desc("prompts"), "first")
    return g.withColumn("_r", F.row_number().over(w)).where("_r = 1").select(item, answer, "votes", "prompts", F.greatest("score", F.lit(0.0)).alias("score"), "trace")


def plain_majority(samples: DataFrame, item: str, answer: str, place: str) -> DataFrame:
    """Most frequent answer of each item; ties go to the answer seen first."""
    g = samples.where(F.col(answer).isNotNull()).groupBy(item, answer).agg(F.count("*").alias("votes"), F.min(place).alias("first"))
    return g.groupBy(item).agg(F.max_by(F.struct(answer, "votes"), F.struct(F.col("votes"), -F.col("first"))).alias("w")).select(item, f"w.{answer}", "w.votes")
