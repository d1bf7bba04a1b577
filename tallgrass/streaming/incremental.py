"""Incremental versions of batch plans: a file stream instead of hand-written resume files."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from functools import reduce
from operator import and_

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from tallgrass.operators import reject
from tallgrass.sources.files import append, exists, remaining


def append_new(out: str, key: Sequence[str], order: str) -> Callable[[DataFrame, int], None]:
    """A batch sink that appends each key once, ever.

    Within a batch the first row of a key in ``order`` wins; keys already in the table are left
    out, so a batch that is run again after a failure adds nothing.
    """

    def sink(batch: DataFrame, _: int) -> None:
        names = [c for c in batch.columns if c not in key]
        first = batch.groupBy(*key).agg(F.min_by(F.struct(*names), order).alias("_f")).select(*key, *[F.col(f"_f.`{c}`").alias(c) for c in names])
        append(_unseen(first, out, key), out)

    return sink


def _unseen(first: DataFrame, out: str, key: Sequence[str]) -> DataFrame:
    """Rows whose key the table lacks: an anti join on the key columns, the only ones that are read of it."""
    spark = first.sparkSession
    if not exists(spark, out):
        return first
    seen = spark.read.parquet(out).select(*[F.col(k).alias(f"_seen_{n}") for n, k in enumerate(key)]).distinct()
    same = reduce(and_, [F.col(k).eqNullSafe(F.col(f"_seen_{n}")) for n, k in enumerate(key)])
    return first.join(seen, same, "left_anti")


def stream_files(spark: SparkSession, path: str, schema: T.StructType, per_batch: int = 100, kind: str = "parquet", glob: str | None = None) -> DataFrame:
    """A folder as a stream of its files."""
    r = spark.readStream.schema(schema).option("maxFilesPerTrigger", per_batch).option("recursiveFileLookup", "true")
    return (r.option("pathGlobFilter", glob) if glob else r).format(kind).load(path)


def curate(stream: DataFrame, tests: Sequence[reject.Test], out: str, checkpoint: str, key: Sequence[str], order: str) -> StreamingQuery:
    """Run a reject chain over a stream and append the kept rows, each key once; ends with the files there are."""
    kept = stream.withColumn("reason", reject.reason(tests)).where("reason is null").drop("reason") if tests else stream
    w = kept.writeStream.foreachBatch(append_new(out, key, order)).option("checkpointLocation", checkpoint).trigger(availableNow=True)
    return w.start()


def generate(items: DataFrame, generator: Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]], schema: str, path: str, key: str = "id") -> None:
    """Answer the items that a checkpoint table lacks with a pluggable batch generator, and append the answers."""
    append(remaining(items, path, key).mapInPandas(generator, schema), path)


def stub_generator(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """A deterministic generator for tests: boxes the length of the question."""
    for b in batches:
        yield pd.DataFrame({"id": b["id"], "response": [f"<think>\ncount\n</think>\n\n\\boxed{{{len(q)}}}" for q in b["question"]]})
