"""Deterministic biological inputs made from the driver's tables, in SQL that Spark and DuckDB share where possible."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..sources.scratch import stored

LENGTH = 30
#: Hex digits to bases.
HEX, BASES = "0123456789abcdef", "ATGCATGCATGCATGC"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def letter_rows(texts: pa.Array, width: int) -> np.ndarray:
    """The bytes of strings of `width` ASCII letters each, a row a string."""
    texts = texts.cast(pa.string()).fill_null("0" * width)
    data = np.frombuffer(texts.buffers()[2], np.uint8) if len(texts) else np.zeros(0, np.uint8)
    first = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset] if len(texts) else 0
    return data[first : first + len(texts) * width].reshape(len(texts), width)


def mutated(gene: Column, key: Column, length: int, gaps: bool = True) -> Column:
    """A sequence near the gene's ancestor: base i is a substitute where hex digit i of md5('m'+key) is 0, a dash where it is 1 and i is a multiple of 11."""
    words = (length + 31) // 32
    parts = lambda p, v: F.concat(*[F.md5(F.concat(F.lit(p), v, F.lit(f"_{k}"))) for k in range(words)])

    @F.arrow_udf("string")
    def letters(a: pa.Array, m: pa.Array, s: pa.Array) -> pa.Array:
        to_base = np.zeros(256, np.uint8)
        to_base[np.frombuffer(HEX.encode(), np.uint8)] = np.frombuffer(BASES.encode(), np.uint8)
        own, digit, other = (letter_rows(x, 32 * words)[:, :length] for x in (a, m, s))
        out = np.where(digit == ord("0"), to_base[other], to_base[own])
        if gaps:
            out[(digit == ord("1")) & (np.arange(1, length + 1) % 11 == 0)] = ord("-")
        made = pa.StringArray.from_buffers(len(a), pa.py_buffer(np.arange(len(a) + 1, dtype=np.int32) * np.int32(length)), pa.py_buffer(np.ascontiguousarray(out)))
        unknown = pc.or_(pc.is_null(a), pc.or_(pc.is_null(m), pc.is_null(s)))
        return pc.if_else(unknown, pa.scalar(None, pa.string()), made)

    # marked so that a filter on the sequence isn't pushed below, which would make the letters once more for it
    return letters.asNondeterministic()(parts("g", gene), parts("m", key), parts("s", key))


@F.arrow_udf(T.ArrayType(T.IntegerType()))
def qualities(digits: pa.Array) -> pa.Array:
    """72 qualities of a read: 10 where the hex digit is f, else 40."""
    values = np.where(letter_rows(digits, 32)[:, np.arange(72) % 32] == ord("f"), 10, 40).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(np.arange(len(digits) + 1, dtype=np.int32) * 72), pa.array(values.reshape(-1)))


#: Line items of a partition.
PART_ROWS = 200_000


def lineitems(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The line items' distinct keys, those of a part together, in as many partitions as they ask for."""
    rows = table(spark, sf_dir, "lineitem").select("l_partkey", "l_orderkey", "l_linenumber")
    parts = max(spark.sparkContext.defaultParallelism, math.ceil(rows.count() / PART_ROWS))
    rows = rows.repartition(parts, "l_partkey")
    return rows.groupBy(*rows.columns).agg(F.lit(1).alias("one")).drop("one")


def alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """alignment(gene, pos, genome, clade, seq_idx, seq): a gene per part, a sequence per line item of it.

    A third of the sequences are a codon shorter; the genome is one of 12 by order, the clade one of 2 by line number.
    """
    rows = lineitems(spark, sf_dir)
    key = F.concat_ws("_", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string"))
    # numbered before the letters are made, while the rows of a part are known to be together
    order = Window.partitionBy("l_partkey").orderBy("l_orderkey", "l_linenumber")
    rows = rows.withColumn("seq_idx", F.row_number().over(order) - 1)
    gene = F.col("l_partkey").cast("string")
    seq = mutated(gene, key, LENGTH)
    short = F.col("l_orderkey") % 3 == 0
    made = rows.select(
        gene.alias("gene"), F.lit("1").alias("pos"), F.concat(F.lit("g"), F.lpad((F.col("l_orderkey") % 12).cast("string"), 2, "0")).alias("genome"),
        (F.col("l_linenumber") % 2).cast("int").alias("clade"), "seq_idx",
        F.substring(seq, F.lit(1), F.when(short, LENGTH - 3).otherwise(LENGTH)).alias("seq"),
    )
    return stored(made, "alignment")  # made once, and read like the table that it stands for


#: The alignment as a DuckDB query: gene, genome, clade, seq_idx, seq.
ALIGNMENT_SQL = f"""
keys AS (SELECT DISTINCT l_partkey, l_orderkey, l_linenumber FROM lineitem),
raw AS (
  SELECT CAST(l_partkey AS VARCHAR) AS gene, l_orderkey, 'g' || lpad(CAST(l_orderkey % 12 AS VARCHAR), 2, '0') AS genome, CAST(l_linenumber % 2 AS INTEGER) AS clade,
         row_number() OVER (PARTITION BY l_partkey ORDER BY l_orderkey, l_linenumber) - 1 AS seq_idx,
         translate(md5('g' || l_partkey || '_0'), '{HEX}', '{BASES}') AS a,
         md5('m' || l_orderkey || '_' || l_linenumber || '_0') AS m,
         translate(md5('s' || l_orderkey || '_' || l_linenumber || '_0'), '{HEX}', '{BASES}') AS s
  FROM keys
),
aln AS (
  SELECT gene, genome, clade, seq_idx, substr(array_to_string(list_transform(range(1, {LENGTH + 1}), lambda i:
           CASE WHEN substr(m, i, 1) = '0' THEN substr(s, i, 1) WHEN substr(m, i, 1) = '1' AND i % 11 = 0 THEN '-' ELSE substr(a, i, 1) END), ''),
           1, CASE WHEN l_orderkey % 3 = 0 THEN {LENGTH - 3} ELSE {LENGTH} END) AS seq
  FROM raw
)
"""


def genes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """genes(seq_name, start, end, strand, gene): a gene of 90 bases per part, on a contig per brand, every 100 bases."""
    parts = table(spark, sf_dir, "part").select("p_partkey", "p_brand")
    start = ((F.col("p_partkey") % 100_000) * 100 + 1).cast("int")
    return parts.select(F.col("p_brand").alias("seq_name"), start.alias("start"), (start + 89).alias("end"), F.when(F.col("p_partkey") % 4 == 0, -1).otherwise(1).alias("strand"), F.col("p_partkey").cast("string").alias("gene"))


def reads(spark: SparkSession, sf_dir: str, once: bool = False) -> DataFrame:
    """reads(...) of 72 bases, one per line item, on the contig of its part; a part of them is poor or soft-clipped.

    They are stored, unless their user reads them `once`.
    """
    rows = lineitems(spark, sf_dir)
    parts = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_brand").alias("rname"))
    rows = rows.join(parts, "l_partkey")
    key = F.concat_ws("_", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string"))
    digits = F.md5(F.concat(F.lit("q"), key))
    pos = ((F.col("l_partkey") % 100_000) * 100 + F.col("l_orderkey") % 12).cast("int")
    qual = qualities(digits)
    full = mutated(F.col("l_partkey").cast("string"), key, 96, gaps=False)
    clipped = F.col("l_linenumber") == 3
    made = rows.select(
        F.concat(F.lit("r"), F.col("l_orderkey").cast("string")).alias("qname"), "rname", pos.alias("pos"),
        F.when(F.col("l_orderkey") % 17 == 0, 20).otherwise(60).alias("mapq"), F.when(clipped, "6S66M").otherwise("72M").alias("cigar"),
        F.substring(full, F.when(clipped, 1).otherwise(F.col("l_orderkey") % 12 + 1).cast("int"), F.lit(72)).alias("seq"), qual.alias("qual"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("ordinal"), "l_partkey",
    )
    return made.drop("l_partkey") if once else stored(made.drop("l_partkey"), "reads")


def sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    """sites(chrom, pos, gts): a site per event, of 32 genotypes, on a chromosome per event type."""
    rows = table(spark, sf_dir, "events").select("event_id", "event_type")
    gts = F.translate(F.md5(F.concat(F.lit("v"), F.col("event_id").cast("string"))), HEX, "00000000111111..")
    return rows.select(F.col("event_type").alias("chrom"), (F.col("event_id") * 3 + 1).alias("pos"), F.filter(F.split(gts, ""), lambda x: x != "").alias("gts"))
