"""Readers of alignments: XMFA blocks and FASTA."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_xmfa(spark: SparkSession, path: str, min_sequences: int = 2) -> DataFrame:
    """alignment(block, gene, pos, genome, seq_idx, seq_id, seq) of the blocks with at least min_sequences sequences.

    A block ends with a line that starts with =. Header words are parted by single spaces: gene, position, genome; gene
    and position are those of a block's first sequence. Sequence lines are joined without white space, case kept. Spark
    splits files at block ends, so a large file is read by many tasks; block numbers grow with the place in the file.
    """
    blocks = spark.read.option("lineSep", "\n=").text(path).select(F.monotonically_increasing_id().alias("block"), F.concat(F.lit("\n"), F.regexp_replace("value", "\r", "")).alias("value"))
    # what is left of the line that ended the block before stands ahead of the first >
    parts = blocks.select("block", F.split("value", "\n>").alias("parts")).select("block", F.posexplode(F.slice("parts", F.lit(2), F.size("parts"))).alias("seq_idx", "part"))
    words = F.split(F.split("part", "\n")[0], " ")
    seq = F.regexp_replace(F.regexp_replace("part", "^[^\n]*\n?", ""), r"\s", "")
    seq = F.regexp_replace(seq, "=.*$", "")  # a file's own last =
    rows = parts.select("block", "seq_idx", F.split("part", "\n")[0].alias("seq_id"), words.alias("w"), seq.alias("seq"))
    first = rows.groupBy("block").agg(F.min_by("w", "seq_idx").alias("f"), F.count("*").alias("n")).filter(F.col("n") >= min_sequences)
    out = rows.join(first, "block")
    word = lambda c, k: F.try_element_at(F.col(c), F.lit(k))
    return out.select("block", word("f", 1).alias("gene"), word("f", 2).alias("pos"), word("w", 3).alias("genome"), "seq_idx", "seq_id", "seq")


def read_block_ends(spark: SparkSession, path: str) -> DataFrame:
    """The lines that end a block."""
    return spark.read.text(path).filter(F.col("value").startswith("="))


def count_blocks(spark: SparkSession, path: str) -> int:
    return read_block_ends(spark, path).count()


def read_fasta(spark: SparkSession, path: str) -> DataFrame:
    """mate(gene, genome, seq, ordinal): gene is the first word of a header, genome the third or else the first."""
    rows = spark.read.option("lineSep", "\n>").text(path).select(F.monotonically_increasing_id().alias("ordinal"), F.regexp_replace(F.regexp_replace("value", "\r", ""), "^>", "").alias("v")).filter(F.length(F.trim("v")) > 0)
    words = F.split(F.split("v", "\n")[0], " ")
    seq = F.regexp_replace(F.regexp_replace("v", "^[^\n]*\n?", ""), r"\s", "")
    return rows.select(words[0].alias("gene"), F.coalesce(F.try_element_at(words, F.lit(3)), words[0]).alias("genome"), seq.alias("seq"), "ordinal")


def mates(fasta: DataFrame) -> DataFrame:
    """One sequence per gene: the last one wins."""
    return fasta.groupBy("gene").agg(F.max_by("seq", "ordinal").alias("seq"), F.max_by("genome", "ordinal").alias("genome"))


def write_xmfa(aln: DataFrame, path: str) -> None:
    """alignment(gene, pos, genome, seq_idx, seq) as XMFA text, a block per gene and position."""
    head = F.concat_ws(" ", "gene", F.coalesce("pos", F.lit("0")), F.coalesce("genome", F.lit("?")))
    rows = aln.groupBy("gene", "pos").agg(F.array_sort(F.collect_list(F.struct("seq_idx", F.concat(F.lit(">"), head, F.lit("\n"), F.col("seq")).alias("t")))).alias("s"))
    rows.select(F.concat(F.array_join(F.transform("s", lambda x: x["t"]), "\n"), F.lit("\n=")).alias("value")).write.mode("overwrite").text(path)


def write_fasta(rows: DataFrame, path: str) -> None:
    """rows(gene, pos, genome, seq) as FASTA text; header words are gene, position and genome."""
    head = F.concat_ws(" ", "gene", F.coalesce("pos", F.lit("0")), F.coalesce("genome", F.lit("?")))
    rows.select(F.concat(F.lit(">"), head, F.lit("\n"), F.col("seq")).alias("value")).write.mode("overwrite").text(path)
