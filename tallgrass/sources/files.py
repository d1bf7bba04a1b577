"""Text sources and sinks: JSON lines, CSV with long quoted fields, manifests, checkpoints."""

from __future__ import annotations

import datetime
import hashlib
import json
import subprocess
from collections.abc import Callable, Iterable
from pathlib import Path
from typing import Any

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallgrass.functions import text as tx


def read_jsonl(spark: SparkSession, path: str, schema: T.StructType, strict: bool = False) -> DataFrame:
    """JSON lines under a declared schema; blank lines are skipped; ``strict`` fails on a malformed line."""
    return spark.read.schema(schema).option("mode", "FAILFAST" if strict else "PERMISSIVE").json(path)


def read_items(spark: SparkSession, path: str) -> DataFrame:
    """Items whose ``answer`` is a string or a list of strings, as a list.

    The union is resolved on the parsed value, never by parsing a string again, so an interval
    such as ``[0, 14]`` stays one answer.
    """
    v = spark.read.text(path).where(F.trim("value") != "").select(F.parse_json("value").alias("v"))
    is_list = F.schema_of_variant(F.expr("variant_get(v, '$.answer')")).startswith("ARRAY")
    answer = F.when(is_list, F.expr("try_variant_get(v, '$.answer', 'array<string>')")).otherwise(F.array(F.expr("try_variant_get(v, '$.answer', 'string')")))
    return v.select(
        F.expr("variant_get(v, '$.id', 'bigint')").alias("id"), F.expr("variant_get(v, '$.question', 'string')").alias("question"), F.expr("try_variant_get(v, '$.options', 'array<string>')").alias("options"),
        F.when(F.expr("variant_get(v, '$.answer')").isNotNull(), answer).alias("answer"),
    )


def write_jsonl(df: DataFrame, path: str, order: list[str] | None = None, overwrite: bool = False) -> None:
    """JSON lines, non-ASCII as it is.  With ``order``: one file, rows in that order (small results only)."""
    if order:
        df = df.coalesce(1).sortWithinPartitions(*order)
    df.write.mode("overwrite" if overwrite else "errorifexists").json(path)


def read_long_csv(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """CSV with header whose quoted fields hold line breaks and doubled quotes."""
    return spark.read.schema(schema).options(header=True, multiLine=True, quote='"', escape='"', maxCharsPerColumn=-1, ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False).csv(path)


def write_long_csv(df: DataFrame, path: str, order: list[str] | None = None, overwrite: bool = False) -> int:
    """CSV with minimal quoting; counted while it is written, read again and counted.  Gives the number of rows."""
    seen = Observation()
    df = df.observe(seen, F.count(F.lit(1)).alias("rows"))
    out = df.coalesce(1).sortWithinPartitions(*order) if order else df
    out.write.mode("overwrite" if overwrite else "errorifexists").options(header=True, quote='"', escape='"', emptyValue="", ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False).csv(path)
    rows = seen.get["rows"]
    got = read_long_csv(df.sparkSession, path, df.schema).count()
    if got != rows:
        raise RuntimeError(f"{path}: {rows} rows written, {got} read back")
    return rows


def rewrite_csv(spark: SparkSession, source: str, target: str, schema: T.StructType, change: Callable[[DataFrame], DataFrame]) -> int:
    """Read a CSV, change its rows, write it elsewhere."""
    return write_long_csv(change(read_long_csv(spark, source, schema)), target)


def read_configs(read: Callable[[str], DataFrame], configs: Iterable[str], column: str = "hf_config") -> DataFrame:
    """Several configurations of a source in one table, each marked with its name."""
    out = None
    for c in configs:
        one = read(c).withColumn(column, F.lit(c))
        out = one if out is None else out.unionByName(one, allowMissingColumns=True)
    if out is None:
        raise ValueError("no configuration")
    return out


def scan_cap(df: DataFrame, position: str, cap: int | None) -> DataFrame:
    """The first ``cap`` rows by their stored position; all without a cap."""
    return df if cap is None else df.where(F.col(position) < cap)


def append(df: DataFrame, path: str) -> None:
    """Append to a checkpoint table."""
    df.write.mode("append").parquet(path)


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a path exists on the session's file system."""
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    return jpath.getFileSystem(spark._jsc.hadoopConfiguration()).exists(jpath)


def remaining(df: DataFrame, path: str, key: str = "id") -> DataFrame:
    """Rows whose key is not in the checkpoint table yet; all where there is none."""
    spark = df.sparkSession
    if not exists(spark, path):
        return df
    try:
        return df.join(spark.read.parquet(path).select(key).distinct(), key, "left_anti")
    except AnalysisException:  # the folder is there, but no file has been committed
        return df


def cached(spark: SparkSession, path: str, version: str, build: Callable[[], DataFrame], force: bool = False) -> DataFrame:
    """A table built once per version and read afterwards."""
    full = f"{path}_{version}"
    if force or not exists(spark, full):
        build().write.mode("overwrite").parquet(full)
    return spark.read.parquet(full)


def fan_out(df: DataFrame, path: str, bucket: str, overwrite: bool = False) -> None:
    """A folder per bucket."""
    df.write.mode("overwrite" if overwrite else "errorifexists").partitionBy(bucket).json(path)


def file_sha256(path: str) -> str:
    """SHA-256 of a file's bytes."""
    h = hashlib.sha256()
    with open(path, "rb") as f:
        while chunk := f.read(1 << 20):
            h.update(chunk)
    return h.hexdigest()


def fingerprint(df: DataFrame) -> int:
    """Order-free fingerprint of a table's rows; repeated rows count."""
    h = F.xxhash64(*[F.col(f"`{c}`") for c in sorted(df.columns)])
    r = df.select(h.alias("h")).agg(F.sum(F.col("h").cast("decimal(38,0)")).alias("s"), F.count("*").alias("n")).first()
    return hash((int(r["s"] or 0), r["n"]))


def provenance(repo: str = ".") -> dict[str, str | None]:
    """Short commit and UTC time, for manifests."""
    try:
        sha = subprocess.run(["git", "-C", repo, "rev-parse", "--short", "HEAD"], capture_output=True, text=True, check=True).stdout.strip()
    except (OSError, subprocess.CalledProcessError):
        sha = None
    return {"git_commit": sha, "timestamp_utc": datetime.datetime.now(datetime.timezone.utc).isoformat()}


def read_document(path: str) -> dict[str, Any]:
    """A JSON document, empty where there is none."""
    p = Path(path)
    return json.loads(p.read_text(encoding="utf-8")) if p.is_file() else {}


def write_document(path: str, document: dict[str, Any], overwrite: bool = True) -> None:
    """Write a JSON document."""
    p = Path(path)
    if p.exists() and not overwrite:
        raise FileExistsError(path)
    p.parent.mkdir(parents=True, exist_ok=True)
    p.write_text(json.dumps(document, ensure_ascii=False, indent=2) + "\n", encoding="utf-8")


def upsert_entry(path: str, section: str, name: str, entry: dict[str, Any]) -> dict[str, Any]:
    """Replace one entry of a section of a document, keeping all others."""
    doc = read_document(path)
    doc.setdefault(section, {})[name] = entry
    write_document(path, doc)
    return doc


def manifest(df: DataFrame, topic: str = "topic", length: str = "trace_chars", key: str = "source_id") -> dict[str, Any]:
    """Counts, topic counts and length statistics of a corpus as one document."""
    one = df.agg(F.count("*").alias("n"), F.countDistinct(key).alias("ids"), F.round(F.avg(length), 1).alias("mean"), F.round(F.percentile(length, 0.5), 1).alias("median")).first()
    topics = {r["t"]: r["n"] for r in df.groupBy(F.coalesce(F.col(topic), F.lit("unknown")).alias("t")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "t").collect()}
    return {"final_row_count": one["n"], "distinct_ids": one["ids"], "topic_counts": topics, length: {"mean": one["mean"] or 0.0, "median": one["median"] or 0.0}, **provenance()}


def first_turn(conversations: Column, who: str) -> Column:
    """Text of the first turn of a speaker."""
    return F.get(F.filter(conversations, lambda c: c["from"] == who), F.lit(0))["value"]


def verified_generation(generations: Column, verified: Column, most: int = 10_000) -> Column:
    """The first generation that was verified and is not too long."""
    pairs = F.arrays_zip(generations.alias("g"), verified.alias("ok"))
    good = F.filter(pairs, lambda p: p["ok"] & (F.length(p["g"]) <= most))
    return F.get(good, F.lit(0))["g"]


def choice_question(query: Column) -> Column:
    """Question of a multiple-choice query without its options, in either of two layouts."""
    en = F.trim(F.split(F.regexp_replace(query, r"^Q:\s*", ""), "Answer Choices:")[0])
    zh = F.trim(F.split(F.regexp_replace(query, "^问题：", ""), "选项：")[0])
    return F.when(query.startswith("Q:"), en).when(query.startswith("问题："), zh).otherwise(tx.strip(query))
