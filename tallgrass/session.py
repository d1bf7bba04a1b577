"""Session construction and the few settings every plan relies on."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import SparkSession

DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def local_session(cores: int | str = 8, *, driver_memory: str = "8g", partitions: int = 8) -> SparkSession:
    """A local session for tests and benches; a cluster brings its own."""
    b = SparkSession.builder.master(f"local[{cores}]").config("spark.driver.memory", driver_memory)
    b = b.config("spark.sql.shuffle.partitions", str(partitions))
    for k, v in DEFAULTS.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_folder(spark: SparkSession) -> str:
    """A new folder that all executors share: below the checkpoint folder the cluster names.

    Only where that is unset, and Spark runs on this machine, a local temporary folder is used.
    """
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared is None:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir is unset on a cluster")
        shared = "file://" + os.path.join(tempfile.gettempdir(), "tallgrass-shared")
    return f"{shared.rstrip('/')}/{uuid.uuid4().hex}"


@contextmanager
def scratch(spark: SparkSession) -> Iterator[str]:
    """A shared folder that is deleted afterwards."""
    folder = shared_folder(spark)
    try:
        yield folder
    finally:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
