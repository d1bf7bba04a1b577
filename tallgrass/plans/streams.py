"""Streaming plans."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallgrass.plans.registry import Registry
from tallgrass.session import scratch
from tallgrass.sources.tables import table
from tallgrass.streaming import incremental

query = Registry()


@query("select lower(trim(run_tag)) as run, count(distinct id) as ids from responses group by 1")
def stream_checkpoint(spark: SparkSession, d: str) -> DataFrame:
    """Responses read as a file stream into a checkpoint table that holds each run's item once."""
    schema = table(spark, d, "responses").schema
    # a table is one file or a folder of files: the parent folder is listed by name, a folder by itself
    jpath = spark._jvm.org.apache.hadoop.fs.Path(f"{d}/responses.parquet")
    is_folder = jpath.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(jpath).isDirectory()
    s = incremental.stream_files(spark, f"{d}/responses.parquet" if is_folder else d, schema, glob=None if is_folder else "responses.parquet")
    s = s.select(F.lower(F.trim("run_tag")).alias("run"), "id", "scan_idx")
    with scratch(spark) as folder:
        incremental.curate(s, [], f"{folder}/table", f"{folder}/progress", ["run", "id"], "scan_idx").awaitTermination()
        rows = spark.read.parquet(f"{folder}/table").groupBy("run").agg(F.count("*").alias("ids")).collect()  # a row a run
    return spark.createDataFrame(rows, "run string, ids bigint")


QUERIES, SQL = query.queries, query.sql
