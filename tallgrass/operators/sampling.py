"""Deterministic sampling: the same rows in any engine that has md5.

A key's uniform number stands in for a pseudo-random stream, so sizes, distribution and
constraints are those of the named methods while membership depends on seed and key only.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallgrass.functions.text import uniform


#: Ranges of the random number in which strata are ranked.
RANGES = 1024
#: Most keys that are sent to the workers; more are joined.
SHIPPED = 100_000


def order(key: str, seed: int) -> list[Column]:
    """Random order of a key."""
    return [uniform(F.col(key), seed), F.col(key)]


def stratified_fraction(df: DataFrame, strata: Sequence[str], fraction: float, key: str, seed: int = 42) -> DataFrame:
    """``max(1, floor(n * fraction))`` rows of each stratum."""
    sizes = df.groupBy(*strata).agg(F.greatest(F.lit(1), F.floor(F.count("*") * F.lit(fraction))).alias("_k"))
    return _first(df, sizes, strata, key, seed)


def proportional(df: DataFrame, stratum: str, target: int, key: str, seed: int = 42) -> DataFrame:
    """``target`` rows over the strata in proportion, at least one of each but the last, which takes the rest.

    Strata come in a random order of their names; each but the last gets its rounded share (half
    to even), no more than it has or than is left.  A pool no larger than the target is taken whole.
    """
    pool = [(r[stratum], r["n"]) for r in df.groupBy(stratum).agg(F.count("*").alias("n")).withColumn("u", uniform(F.col(stratum), seed)).orderBy("u", stratum).select(stratum, "n").collect()]
    spark, total = df.sparkSession, sum(n for _, n in pool)
    if total <= target:
        return df
    left, plan = target, []
    for i, (name, n) in enumerate(pool):
        k = min(max(round(target * n / total), 1), min(n, left)) if i < len(pool) - 1 else min(n, left)
        plan.append((name, k))
        left -= k
    sizes = spark.createDataFrame(plan, f"`{stratum}` {df.schema[stratum].dataType.simpleString()}, _k int")
    return _first(df, sizes, [stratum], key, seed)


def _same(a: str, b: str, names: Sequence[str]) -> Column:
    on = F.lit(True)
    for n in names:
        on = on & F.col(f"{a}.`{n}`").eqNullSafe(F.col(f"{b}.`{n}`"))
    return on


def _ranged(df: DataFrame, strata: Sequence[str], key: str, seed: int) -> tuple[DataFrame, DataFrame]:
    """Rows with ``_u`` and ``_range`` of it, and for each stratum and range the rows in smaller ranges as ``_before``."""
    rows = df.withColumn("_u", uniform(F.col(key), seed)).withColumn("_range", F.floor(F.col("_u") * RANGES))
    counts = rows.groupBy(*strata, "_range").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(*strata).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    return rows, counts.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0)))


def numbered(df: DataFrame, strata: Sequence[str], key: str, seed: int = 42) -> DataFrame:
    """Rows with their number from 0 in the random order of their stratum as ``_number``, and the stratum's size as ``_size``.

    As in ``_first`` a large stratum is ranked in ``RANGES`` groups.
    """
    rows, counts = _ranged(df, strata, key, seed)
    names = [*strata, "_range"]
    counts = counts.withColumn("_size", F.sum("_n").over(Window.partitionBy(*strata))).select(*[F.col(f"`{n}`") for n in names], "_before", "_size")
    place = F.row_number().over(Window.partitionBy(*names).orderBy("_u", key)) - 1
    return rows.alias("a").join(counts.alias("b"), _same("a", "b", names)).select("a.*", "_before", "_size").withColumn("_number", F.col("_before") + place).drop("_u", "_range", "_before")


def _first(df: DataFrame, sizes: DataFrame, strata: Sequence[str], key: str, seed: int) -> DataFrame:
    """The first ``_k`` rows of each stratum in random order.

    A row's rank is the number of rows in smaller ranges of the random number plus its place in
    its own range, so a stratum with a third of all rows is ranked in ``RANGES`` groups, and
    ranges beyond the last kept rank are left out before anything is sorted.
    """

    rows, counts = _ranged(df, strata, key, seed)
    needed = counts.alias("c").join(sizes.alias("s"), _same("c", "s", strata)).where("_before < _k").select(*[F.col(f"c.`{n}`") for n in strata], "_range", "_before", "_k")
    names = [*strata, "_range"]
    kept = rows.alias("a").join(needed.alias("b"), _same("a", "b", names)).select("a.*", "_before", "_k")
    place = F.row_number().over(Window.partitionBy(*names).orderBy("_u", key))
    return kept.withColumn("_r", place).where("_before + _r <= _k").drop("_r", "_k", "_u", "_range", "_before")


def draw(key: Column, n: Column, k: int, seed: int = 42) -> Column:
    """``k`` different numbers below ``n`` by key, all of them where ``n`` is no larger; every set is as likely (Floyd's method)."""

    def add(got: Column, j: Column) -> Column:
        t = F.floor(uniform(F.concat_ws(":", key.cast("string"), j.cast("string")), seed) * (j + 1))
        return F.concat(got, F.array(F.when(F.array_contains(got, t), j).otherwise(t)))

    few = F.sequence(F.lit(0).cast("bigint"), F.greatest(n - 1, F.lit(0)))
    return F.when(n <= k, few).otherwise(F.aggregate(F.sequence(F.greatest(n - k, F.lit(0)), F.greatest(n - 1, F.lit(0))), F.array().cast("array<bigint>"), add))


def weighted(df: DataFrame, k: int, weight: Column, key: str, seed: int = 42) -> DataFrame:
    """``k`` rows without replacement by weight: the largest ln(u) / w."""
    w = F.greatest(weight.cast("double"), F.lit(1e-9))
    score = F.log(F.greatest(uniform(F.col(key), seed), F.lit(1e-12))) / w
    return df.withColumn("_score", score).orderBy(F.desc("_score"), key).limit(k).drop("_score")


def reservoir(df: DataFrame, k: int, key: str, seed: int = 42) -> DataFrame:
    """``k`` rows, each with the same chance: a bounded top-k, no sort of all rows."""
    return df.withColumn("_u", uniform(F.col(key), seed)).orderBy("_u", key).limit(k).drop("_u")


def quota(df: DataFrame, bucket: str, quotas: dict[str, int], position: str) -> DataFrame:
    """The first rows of each bucket in scan order, up to its quota; buckets without quota get none."""
    limits = F.create_map(*[x for b, n in quotas.items() for x in (F.lit(b), F.lit(n))])
    rank = F.row_number().over(Window.partitionBy(bucket).orderBy(position))
    ranked = df.where(F.col(bucket).isin(*quotas)).withColumn("_r", rank)
    # the literal bound lets every task keep only that many rows of a bucket before the shuffle
    return ranked.where((F.col("_r") <= max(quotas.values())) & (F.col("_r") <= F.try_element_at(limits, F.col(bucket)))).drop("_r")


def mixed(df: DataFrame, bucket: str, quotas: dict[str, int], key: str, seed: int = 42) -> DataFrame:
    """A random sample of each bucket of its quota's size."""
    plan = df.sparkSession.createDataFrame(list(quotas.items()), f"`{bucket}` string, _k int")
    return _first(df, plan, [bucket], key, seed)


def longest_with_share(df: DataFrame, flag: Column, target: int, share: float, length: str, key: str) -> DataFrame:
    """``target`` longest rows with a share of flagged ones first, the rest unflagged, then flagged again.

    The flagged share is ``max(1, floor(target * share))``.
    """
    first = max(1, int(target * share))
    n_flagged = df.where(flag)
    head = n_flagged.orderBy(F.desc(length), key).limit(first).withColumn("_p", F.lit(0))
    taken = head.select(key)
    rest = df.join(F.broadcast(taken) if first <= SHIPPED else taken, key, "left_anti").withColumn("_p", F.when(flag, 2).otherwise(1))
    return head.unionByName(rest).orderBy("_p", F.desc(length), key).limit(target).drop("_p")


def compose(df: DataFrame, size: int, topic: str, key: str, seed: int = 42) -> DataFrame:
    """Rows of a topic put together in groups of ``size`` in random order, no row twice, incomplete groups left out.

    Gives ``_group`` (hash of topic and number) and ``_place`` within it.  Only the last ``size - 1``
    rows of a topic at most are left out, however many rows there are: they are numbered by
    ``numbered``, so a large topic is not ordered in one task.
    """
    r = numbered(df, [topic], key, seed).where(F.col("_number") < F.col("_size") - F.col("_size") % size)
    return r.withColumn("_group", F.xxhash64(topic, F.floor(F.col("_number") / size))).withColumn("_place", (F.col("_number") % size).cast("int")).drop("_number", "_size")
