"""Quantiles and quantile groups that follow fixed index rules."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def histogram_quantiles(df: DataFrame, value: str, ps: Sequence[float], lower: bool = True) -> DataFrame:
    """Exact index quantiles of an integer-valued column from its distinct values.

    Values are counted first (combined before the shuffle), so what is ordered is the number of
    distinct lengths, not the rows; quantiles are read off the running count.
    """
    c = df.where(F.col(value).isNotNull()).groupBy(F.col(value).alias("v")).agg(F.count("*").alias("c"))
    w = Window.orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
    run = c.withColumn("upto", F.sum("c").over(w)).withColumn("n", F.sum("c").over(Window.partitionBy()))
    picks = []
    for p in ps:
        i = F.floor(F.lit(float(p)) * F.col("n"))
        at = F.greatest(i - 1, F.lit(0)) if lower else F.least(i, F.col("n") - 1)
        picks.append(F.min(F.when(F.col("upto") > at, F.col("v"))).alias(f"p{round(p * 100)}"))
    return run.agg(*picks)


def edges(df: DataFrame, value: str, parts: int = 4) -> list[float]:
    """Interpolated inner edges of equal-frequency groups."""
    return df.agg(F.percentile(value, F.array(*[F.lit(i / parts) for i in range(1, parts)])).alias("e")).first()["e"] or []


def cut(value: Column, inner: Sequence[float]) -> Column:
    """Right-closed group of a value, from 1; a value on an edge belongs below it."""
    out = F.when(value.isNull(), None)
    for k, e in enumerate(inner, 1):
        out = out.when(value <= F.lit(e), k)
    return out.otherwise(len(inner) + 1)


def index_group(position: Column, n: Column, parts: int = 4) -> Column:
    """Group of a position (from 1) by index slices of floor(n / parts), the remainder in the last."""
    return F.least(F.floor((position - 1) / F.greatest(F.floor(n / parts), F.lit(1))), F.lit(parts - 1))


def index_slices(counts: DataFrame, value: str, count: str, parts: int = 4) -> DataFrame:
    """``(grp, n, least, most)`` of the index slices of a column, from the counts of its distinct values.

    Equal values fill successive positions, so which groups a value reaches, and with how many of
    its rows, follows from the running count: what is ordered is distinct values, not rows.
    """
    w = Window.orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    r = counts.withColumn("_to", F.sum(count).over(w)).withColumn("_n", F.sum(count).over(Window.partitionBy())).withColumn("_from", F.col("_to") - F.col(count) + 1)
    size = F.greatest(F.floor(F.col("_n") / parts), F.lit(1))
    reached = F.explode(F.sequence(index_group(F.col("_from"), F.col("_n"), parts).cast("bigint"), index_group(F.col("_to"), F.col("_n"), parts).cast("bigint")))
    r = r.select(value, "_from", "_to", size.alias("_size"), reached.alias("grp"))
    end = F.when(F.col("grp") == parts - 1, F.col("_to")).otherwise(F.least(F.col("_to"), (F.col("grp") + 1) * F.col("_size")))
    r = r.withColumn("_own", end - F.greatest(F.col("_from"), F.col("grp") * F.col("_size") + 1) + 1)
    return r.groupBy("grp").agg(F.sum("_own").alias("n"), F.min(value).alias("least"), F.max(value).alias("most"))
