"""Ordered reject chains: the first failing test names the reason."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Test = tuple[str, Column]


def reason(tests: Sequence[Test]) -> Column:
    """Name of the first test that is true, null where none is.  The order is the meaning.

    A null test does not fail a row; wrap it where a missing value should.
    """
    return F.coalesce(*[F.when(t, F.lit(name)) for name, t in tests])


def split(df: DataFrame, tests: Sequence[Test]) -> tuple[DataFrame, DataFrame]:
    """Kept rows, and rejected rows with their ``reason``."""
    marked = df.withColumn("reason", reason(tests))
    return marked.where("reason is null").drop("reason"), marked.where("reason is not null")


def counts(df: DataFrame, tests: Sequence[Test]) -> DataFrame:
    """``(reason, rows)`` with ``kept`` among the reasons: one pass, combined before the shuffle."""
    return df.select(F.coalesce(reason(tests), F.lit("kept")).alias("reason")).groupBy("reason").agg(F.count("*").alias("rows"))


def two_phase(df: DataFrame, cheap: Sequence[Test], costly: Sequence[Test]) -> DataFrame:
    """``df`` with ``reason``, costly tests evaluated only where no cheap one failed.

    The cheap phase is a filter of its own, so a Python function in a costly test never sees a
    row that a cheap test rejects.
    """
    first = df.withColumn("reason", reason(cheap))
    return first.where("reason is not null").unionByName(first.where("reason is null").withColumn("reason", reason(costly)))
