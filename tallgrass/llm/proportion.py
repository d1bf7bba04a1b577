"""Problem 2: draw a sample whose category shares match targets, with minimum seats.

Method: divisor priorities.  Within a category rows are ranked at random; the row of rank r has
the priority (r - 0.5) / share, rows within the category's minimum come before all others, and
the globally smallest priorities are kept.  A category that runs out leaves its seats to the
next priorities, so redistribution needs no second pass.

Nothing is ranked in one task: a rank is the number of rows in smaller hash ranges of the same
category (a small prefix sum) plus the place within the range, so a category that holds a third
of all rows spreads over ``RANGES`` groups.  How many ranks a category keeps follows from its
supply alone, hence only the ranges that can hold a kept rank are ranked at all.

Defined results: categories are compared without case, outer blanks and the kind of separator
(``Amc-Aime `` is ``amc_aime``); a null category belongs to none; repeated rows count each; an
empty table gives targets of 0 seats; repeated target rows of one mix add their shares and take
the larger minimum.  Targets are compared with the supply in decimal arithmetic.
"""

from __future__ import annotations

from decimal import Decimal

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

RANGES = 1024
FIELDS = ("topic", "weak_topic")


def spelling(c: Column) -> Column:
    """The common spelling of a category."""
    return F.regexp_replace(F.lower(F.regexp_replace(c.cast("string"), r"^[\s\p{Z}]+|[\s\p{Z}]+$", "")), r"[\s\p{Z}_-]+", "_")


def seats(share: np.ndarray, floor: np.ndarray, supply: np.ndarray, size: int) -> np.ndarray:
    """Seats per category: the ``size`` smallest divisor priorities, minimum seats first.

    Ties go to the category that comes first.  Equal to sorting all priorities, but takes time
    by the number of categories, not of rows.
    """
    share, supply = np.maximum(np.asarray(share, float), 0), np.asarray(supply, np.int64)
    floor = np.minimum(np.maximum(np.asarray(floor, np.int64), 0), supply)
    base, cap = (np.zeros_like(floor), floor) if floor.sum() >= size else (floor, np.where(share > 0, supply, floor))
    size = int(min(size, cap.sum()))

    def at(level: float) -> np.ndarray:
        return np.clip(np.floor(np.minimum(level * share + 0.5, 9e18)).astype(np.int64), base, cap)

    lo, hi = 0.0, 1.0
    while at(hi).sum() < size and hi < 1e300:
        hi *= 2
    for _ in range(200):
        mid = (lo + hi) / 2
        if at(mid).sum() <= size:
            lo = mid
        else:
            hi = mid
    out = np.minimum(at(lo), cap)
    while out.sum() < size:  # ties at the threshold: at most one more seat a category
        nxt = np.where((out < cap) & (share > 0), (out + 0.5) / np.where(share > 0, share, 1), np.inf)
        if np.isinf(nxt.min()):  # only minimum seats without a share are left
            nxt = np.where(out < cap, 0.0, np.inf)
        out[int(nxt.argmin())] += 1
    return out


def _unmet(share: float, frac: float, floor: int, supply: int, rows: int) -> tuple[float, bool]:
    exact = max(Decimal(repr(float(share))) * Decimal(repr(float(frac))) * rows, Decimal(int(floor)))
    return float(exact), exact > int(supply)


def supplies(corpus: DataFrame, fields: tuple[str, ...] = FIELDS) -> DataFrame:
    """Rows of each category of each field: one scan, combined before the shuffle."""
    pairs = F.array(*[F.struct(F.lit(f).alias("by_field"), spelling(corpus[f]).alias("cat")) for f in fields])
    long = corpus.select(F.explode(pairs).alias("p")).select("p.*").where("cat is not null")
    return long.groupBy("by_field", "cat").agg(F.count("*").alias("supply"))


def allocate(corpus: DataFrame, targets: DataFrame) -> DataFrame:
    """The report: a row per target row with target, supply, seats, ``unmet`` and ``short``.

    ``unmet`` is a target beyond the supply, ``short`` one that got fewer whole seats than it asks
    for, be it for want of rows or because the minimums of others took them.
    """
    rows = corpus.count()
    t = targets.select("mix_id", "by_field", "category", "share", "min_rows", "sample_frac", spelling(F.col("category")).alias("cat"))
    t = t.join(supplies(corpus), ["by_field", "cat"], "left").fillna({"supply": 0, "share": 0.0, "min_rows": 0, "sample_frac": 0.0})

    def per_mix(g: pd.DataFrame) -> pd.DataFrame:
        one = g.groupby("cat", sort=True, dropna=False).agg(share=("share", "sum"), floor=("min_rows", "max"), supply=("supply", "first"))
        one["seats"] = seats(one["share"], one["floor"], one["supply"], int(g["sample_frac"].max() * rows + 0.5))
        g = g.merge(one[["seats"]], left_on="cat", right_index=True)
        told = [_unmet(*x, rows) for x in zip(g["share"], g["sample_frac"], g["min_rows"], g["supply"])]
        target = np.array([a for a, _ in told])
        return g.assign(target=target, unmet=[b for _, b in told], short=g["seats"].to_numpy() < np.floor(target + 1e-9))[OUT]

    OUT = ["mix_id", "by_field", "category", "cat", "target", "supply", "seats", "unmet", "short"]
    return t.groupBy("mix_id").applyInPandas(per_mix, "mix_id int, by_field string, category string, cat string, target double, supply bigint, seats bigint, unmet boolean, short boolean")


def sample(corpus: DataFrame, targets: DataFrame, *, key: str = "scan_idx", seed: int = 42) -> DataFrame:
    """The samples: ``(mix_id, key, cat, rank)`` of every row kept for a mix."""
    plan = allocate(corpus, targets).select("mix_id", "by_field", "cat", "seats").distinct()
    u = F.xxhash64(F.lit(seed), corpus[key])
    pairs = F.array(*[F.struct(F.lit(f).alias("by_field"), spelling(corpus[f]).alias("cat")) for f in FIELDS])
    long = corpus.select(corpus[key].alias("_key"), u.alias("_u"), F.explode(pairs).alias("p")).select("_key", "_u", "p.*").where("cat is not null")
    long = long.withColumn("_range", F.shiftrightunsigned("_u", 64 - (RANGES - 1).bit_length()))
    counts = long.groupBy("by_field", "cat", "_range").agg(F.count("*").alias("_n"))
    before = Window.partitionBy("by_field", "cat").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    most = plan.groupBy("by_field", "cat").agg(F.max("seats").alias("_most"))
    needed = counts.join(most, ["by_field", "cat"]).where("_before < _most").select("by_field", "cat", "_range", "_before")
    within = Window.partitionBy("by_field", "cat", "_range").orderBy(F.shiftrightunsigned("_u", 1), "_u", "_key")
    ranked = long.join(needed, ["by_field", "cat", "_range"]).withColumn("rank", F.col("_before") + F.row_number().over(within))
    return ranked.join(plan, ["by_field", "cat"]).where("rank <= seats").select("mix_id", F.col("_key").alias(key), "cat", "rank")
