"""Removing rows that overlap with protected questions."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallgrass.functions import fixed_values as fx
from tallgrass.functions import text as tx

try:
    import ahocorasick
except ImportError:  # then texts are looked for one by one
    ahocorasick = None

#: Most protected prefixes that are shipped to the workers; more are joined by their word runs.
SHIPPED = 5_000
#: Characters of a short text by which the places that could hold it are looked up.
GRAM = 8
#: Words in a run of a key that row and protected question must share before they are compared.
RUN = 4


def exact(df: DataFrame, protected: DataFrame, column: str = "question", protected_column: str = "question") -> DataFrame:
    """Rows whose overlap key is not a protected one: an anti join on a computed key."""
    keys = protected.select(tx.overlap_key(F.col(protected_column)).alias("_key")).distinct()
    return df.withColumn("_key", tx.overlap_key(F.col(column))).join(keys, "_key", "left_anti").drop("_key")


def prefixes(protected: DataFrame, column: str = "question") -> DataFrame:
    """Prefix keys of protected questions: the key of the first raw characters, if it is long enough."""
    p = tx.overlap_key(F.substring(F.col(column), 1, fx.PREFIX_CHARS))
    return protected.select(p.alias("prefix")).where(F.length("prefix") >= fx.PREFIX_LEAST).distinct()


def _hit(full: Column, head: Column, prefix: Column) -> Column:
    return F.contains(full, prefix) | F.contains(prefix, head) | F.contains(head, prefix)


def _runs(text: Column) -> Column:
    """Hashes of the runs of whole inner words of a key; empty for a key of few words.

    The words at both ends may be cut, the inner ones stand in any text that contains the key.
    """
    w = F.split(text, " ")
    last = F.size(w) - RUN
    return F.when(last >= 2, F.transform(F.sequence(F.lit(2), last), lambda i: F.xxhash64(F.array_join(F.slice(w, i, RUN), " ")))).otherwise(F.array().cast("array<bigint>"))


class Fragments:
    """Finds short texts inside a fixed set of texts: their first ``GRAM`` characters are looked up, and only those places compared."""

    def __init__(self, texts: list[str]):
        self.texts = texts
        self.places: dict[str, list[tuple[int, int]]] = {}
        for n, t in enumerate(texts):
            for i in range(len(t) - GRAM + 1):
                self.places.setdefault(t[i : i + GRAM], []).append((n, i))
        self.short = {t[i : i + k] for t in texts for k in range(GRAM) for i in range(len(t) - k + 1)}

    def has(self, s: str) -> bool:
        """Whether one of the texts contains ``s``."""
        if len(s) < GRAM:
            return s in self.short
        return any(self.texts[n].startswith(s, i) for n, i in self.places.get(s[:GRAM], ()))


def _matcher(texts: list[str]) -> Callable[..., Column]:
    """Arrow function of a key and its head: whether the key has one of the texts in it, or one of them the head."""

    @F.pandas_udf(T.BooleanType())
    def match(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        within = Fragments(texts)
        find = None
        if ahocorasick and texts:
            find = ahocorasick.Automaton()
            for t in texts:
                find.add_word(t, True)
            find.make_automaton()

        def inside(s: str) -> bool:
            return next(find.iter(s), None) is not None if find else any(t in s for t in texts)

        for full, head in batches:
            # a text in the head is one in the key too, unless the key of the cut head ends otherwise
            yield pd.Series([bool(texts) and f is not None and (within.has(h) or inside(f) or (not f.startswith(h) and inside(h))) for f, h in zip(full, head)], dtype=bool)

    return match


def _grams(text: Column) -> Column:
    """Every run of ``GRAM`` characters of a text, and every shorter one."""

    def runs_of(k: int) -> Column:
        runs = F.transform(F.sequence(F.lit(1), F.length(text) - (k - 1)), lambda i: F.substring(text, i, F.lit(k)))
        return F.when(F.length(text) >= k, runs).otherwise(F.array().cast("array<string>"))

    return F.array_distinct(F.concat(*map(runs_of, range(1, GRAM + 1))))


def _parts(texts: DataFrame, size: int) -> Iterator[list[str]]:
    """The texts in lists of about ``size``."""
    n = texts.count()
    parts = -(-n // max(size, 1)) if size else min(n, 1)
    for k in range(parts):
        yield [r[0] for r in texts.where(F.pmod(F.xxhash64("prefix"), F.lit(parts)) == k).collect()]


def containment(df: DataFrame, protected: DataFrame, column: str = "question", protected_column: str = "question") -> DataFrame:
    """``df`` with ``hit``: whether a protected prefix is in the row's key, or the row's prefix in it.

    A row key that is empty hits whenever anything is protected.  Keys are compared only where
    they can contain one another: a key contains a prefix only if it has the prefix's first run
    of inner words, and lies in one only if its own first run is among the prefix's.  Prefixes of too
    few words for a run are looked for by automata of ``SHIPPED`` of them, keys of too few words by
    their first ``GRAM`` characters among those of the prefixes.  Up to ``SHIPPED`` protected prefixes go to the
    workers as one automaton, with no join and no shuffle; more are joined by their runs.
    """
    p = prefixes(protected, protected_column).withColumn("_runs", _runs(F.col("prefix")))
    base = df.withColumn("_full", tx.overlap_key(F.col(column))).withColumn("_head", tx.overlap_key(F.substring(F.col(column), 1, fx.PREFIX_CHARS)))
    own, head = F.concat(_runs(F.col("_full")), _runs(F.col("_head"))), F.get(_runs(F.col("_head")), F.lit(0))
    if p.count() <= SHIPPED:
        hit = _matcher([r["prefix"] for r in p.select("prefix").collect()])  # bounded by the check
        return base.withColumn("hit", hit("_full", "_head")).drop("_full", "_head")
    keys = base.select("_full", "_head").distinct()
    marked = keys.withColumn("_head_run", head)
    by_own = marked.select("_full", "_head", F.explode(own).alias("_run")).distinct().join(p.select("prefix", F.get("_runs", F.lit(0)).alias("_run")), "_run")
    by_head = marked.select("_full", "_head", F.col("_head_run").alias("_run")).join(p.select("prefix", F.explode("_runs").alias("_run")), "_run")
    found = by_own.unionByName(by_head).where(_hit(F.col("_full"), F.col("_head"), F.col("prefix"))).select("_full", "_head")
    few = p.where(F.size("_runs") == 0).select("prefix")
    for part in _parts(few, SHIPPED):
        found = found.unionByName(keys.where(_matcher(part)("_full", "_head")))
    brief = marked.where("_head_run is null").select("_full", "_head")
    held = p.select("prefix", F.explode(_grams(F.col("prefix"))).alias("_gram"))
    by_gram = brief.where("_head <> ''").withColumn("_gram", F.substring("_head", 1, GRAM)).join(held, "_gram").where(F.contains("prefix", F.col("_head")))
    found = found.unionByName(by_gram.select("_full", "_head")).unionByName(brief.where("_head = ''").join(F.broadcast(p.limit(1).select(F.lit(1).alias("_any"))), F.lit(True), "left_semi"))
    out = base.join(found.distinct().withColumn("_is", F.lit(True)), ["_full", "_head"], "left")
    return out.withColumn("hit", F.coalesce("_is", F.lit(False))).drop("_full", "_head", "_is")
