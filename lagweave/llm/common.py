"""Helpers shared by the operators: shared tables, row packing, ordering without a single-task sort."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..sources.scratch import new_path, shared_dir  # noqa: F401

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
WORD = r"[^\x20\x09-\x0D]+"


def stored(df: DataFrame, name: str, path: str | None = None, **options) -> DataFrame:
    """Write df as Parquet in the shared folder and read it back: lineage ends there, and a lost executor loses nothing of it."""
    spark = df.sparkSession
    path = path or new_path(spark, name)
    df.write.mode("overwrite").option("compression", "zstd").options(**options).parquet(path)
    back = spark.read.schema(df.schema).parquet(path)
    back.stored_path = path
    return back


def forget(*tables: DataFrame) -> None:
    """Delete stored() tables that nothing reads any more."""
    for df in tables:
        if path := getattr(df, "stored_path", None):
            delete_path(df.sparkSession, path)


def delete_path(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def col(name: str) -> Column:
    """A column by its exact name, dots and backticks included."""
    return F.col("`" + name.replace("`", "``") + "`")


def packed(df: DataFrame, name: str = "row") -> Column:
    """All columns of df as one struct, so that no helper column can clash with them."""
    return F.struct(*[col(c) for c in df.columns]).alias(name)


def lower_ascii(text: Column) -> Column:
    """text with A-Z lower-cased: lower() where that is all it can change, translate() where there are other letters."""
    plain = F.octet_length(text) == F.length(text)
    return F.when(plain, F.lower(text)).otherwise(F.translate(text, UPPER, UPPER.lower()))


def id_remainder(doc_id: Column, mod: int) -> Column:
    """crc32 of the id written in decimal, modulo mod."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % mod


def in_order(df: DataFrame, order: Sequence[Column], name: str) -> DataFrame:
    """df with `pos` (long from 0) in the given order.

    A range-partitioned sort numbers rows within partitions; only one count per partition is summed in a single task.
    """
    shift = 33  # monotonically_increasing_id: partition above, row below
    sorted_rows = stored(df.orderBy(*order).withColumn("mid", F.monotonically_increasing_id()), name)
    part = F.shiftright("mid", shift)
    counts = sorted_rows.groupBy(part.alias("part")).agg(F.count("*").alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    out = sorted_rows.withColumn("part", part).join(offsets, "part")
    return out.withColumn("pos", F.col("first") + F.col("mid").bitwiseAND(F.lit((1 << shift) - 1))).drop("mid", "part", "first")


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
