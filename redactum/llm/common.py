"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession

from redactum.session import scratch_path

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
#: Rows of one Arrow batch: a task holds so many texts in Python at a time.
BATCH_ROWS = 256


def prepare(spark: SparkSession) -> None:
    """Small Arrow batches, and this package on the workers' path.

    On a cluster the package is installed or shipped (``--py-files``); the path
    entry only serves workers that share the driver's disk.
    """
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    env = spark.sparkContext.environment
    paths = env.get("PYTHONPATH", "").split(os.pathsep)
    if ROOT not in paths:
        env["PYTHONPATH"] = os.pathsep.join([ROOT, *filter(None, paths)])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh_path(spark: SparkSession, name: str) -> str:
    """A path of its own in the shared folder of ``spark.checkpoint.dir``."""
    return scratch_path(spark, f"{name}-{uuid.uuid4().hex}")


def stored(spark: SparkSession, df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts the lineage,
    survives lost executors and keeps every later read on the same rows."""
    path = fresh_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def temp_name(*taken: str) -> str:
    """A column name that no given column has."""
    while True:
        name = f"_{uuid.uuid4().hex[:12]}"
        if name not in taken:
            return name
