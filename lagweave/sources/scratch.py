"""Tables that a plan writes and reads again, in the folder that the driver and all executors share."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_OWN: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir as a full path; where it is unset, a local master gets a folder of its own, which goes at the end.

    A folder named without a scheme is on Spark's default file system, and the path says so to whoever opens it otherwise.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return (found if "://" in found else qualified(spark, found)).rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not os.path.isdir(_OWN.get("dir", "")):
        _OWN["dir"] = tempfile.mkdtemp(prefix="lagweave-")
        atexit.register(shutil.rmtree, _OWN["dir"], ignore_errors=True)
    return f"file://{_OWN['dir']}"


def qualified(spark: SparkSession, path: str) -> str:
    """path with the scheme of the file system that Spark finds it on."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    full = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(where).toString()
    return f"file://{full[5:]}" if full.startswith("file:/") and not full.startswith("file://") else full


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """df written as Parquet and read back: its plan is run once, however often the result is used."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def delete_path(spark: SparkSession, path: str) -> None:
    """Delete a file or folder on whatever file system its path names."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def names_in(spark: SparkSession, path: str) -> list[str]:
    """The names in a folder; none if it isn't there."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    store = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return [f.getPath().getName() for f in store.listStatus(where)] if store.exists(where) else []
