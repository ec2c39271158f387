"""Session settings the operators rely on, and shared-storage tables for intermediate results."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def prepare(spark: SparkSession) -> SparkSession:
    """Pin the session zone: every TIMESTAMP in this library is an instant read as UTC."""
    if spark.conf.get("spark.sql.session.timeZone") != "UTC":
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark


def work_folder(spark: SparkSession) -> str:
    """Shared folder for intermediate tables.

    A cluster names it in ``spark.checkpoint.dir``. Only a local session, where driver and
    executors share one machine, may fall back to a temporary folder.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not spark.conf.get("spark.master", "local").startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")
    folder = tempfile.mkdtemp(prefix="kreiswerk-")
    spark.conf.set("kreiswerk.local.folder", folder)
    return folder


def write_through(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` once to the shared folder and continue from the written table.

    Used where several outputs are derived from one expensive input: the input is computed a
    single time, later reads prune columns, and a lost executor costs a re-read, not a re-run.
    """
    spark = df.sparkSession
    path = new_folder(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def new_folder(spark: SparkSession, label: str) -> str:
    """A path in the shared folder that no one else uses."""
    return f"{_folder_once(spark)}/tables/{label}-{uuid.uuid4().hex}"


def _folder_once(spark: SparkSession) -> str:
    return spark.conf.get("kreiswerk.local.folder", None) or work_folder(spark)
