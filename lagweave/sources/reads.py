"""Readers of mapped reads and gene annotations: SAM, GFF3; and of variant calls: VCF. BAM has its own module."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .bam import read_bam


def read_sam(spark: SparkSession, path: str) -> DataFrame:
    """reads(qname, flag, rname, pos from 0, mapq, cigar, seq, qual, ordinal) of SAM text; header lines are skipped."""
    lines = spark.read.text(path).withColumn("ordinal", F.monotonically_increasing_id()).filter(~F.col("value").startswith("@"))
    f = lines.select(F.split("value", "\t").alias("f"), "ordinal").filter(F.size("f") >= 11)
    qual = F.when(F.get("f", F.lit(10)) == "*", F.array().cast("array<int>")).otherwise(F.transform(F.split(F.get("f", F.lit(10)), ""), lambda c: F.ascii(c) - 33))
    cells = [F.get("f", F.lit(0)).alias("qname"), F.get("f", F.lit(1)).cast("int").alias("flag"), F.get("f", F.lit(2)).alias("rname"), (F.get("f", F.lit(3)).cast("int") - 1).alias("pos"), F.get("f", F.lit(4)).cast("int").alias("mapq"), F.get("f", F.lit(5)).alias("cigar"), F.get("f", F.lit(9)).alias("seq")]
    return f.select(*cells, qual.alias("qual"), "ordinal")


def read_reads(spark: SparkSession, path: str) -> DataFrame:
    """BAM if the name, or that of a folder, ends in bam, otherwise SAM."""
    return read_bam(spark, path) if path.endswith("bam") else read_sam(spark, path)


def read_gff(spark: SparkSession, path: str) -> DataFrame:
    """genes(seq_name, start from 1, end, strand, gene, ordinal): the CDS features of GFF3 text; gene is the ID attribute."""
    lines = spark.read.text(path).withColumn("ordinal", F.monotonically_increasing_id()).filter(~F.col("value").startswith("#"))
    f = lines.select(F.split("value", "\t").alias("f"), "ordinal").filter((F.size("f") >= 9) & (F.get("f", F.lit(2)) == "CDS"))
    strand = F.when(F.get("f", F.lit(6)) == "-", -1).when(F.get("f", F.lit(6)) == "+", 1).otherwise(0)
    return f.select(F.get("f", F.lit(0)).alias("seq_name"), F.get("f", F.lit(3)).cast("int").alias("start"), F.get("f", F.lit(4)).cast("int").alias("end"), strand.alias("strand"), F.regexp_extract(F.get("f", F.lit(8)), "(?:^|;)ID=([^;]+)", 1).alias("gene"), "ordinal")


#: So many parts hold a contig's reads.
CONTIG_PARTS = 16


def write_sam(reads: DataFrame, path: str) -> None:
    """reads(qname, rname, pos from 0, mapq, cigar, seq, qual, ordinal) as gzipped SAM text.

    The reads of a contig are dealt by name to CONTIG_PARTS parts, so a hot contig fills several files; those of one
    name, mates among them, are in one file, in order.
    """
    qual = F.array_join(F.transform("qual", lambda q: F.char(q + 33)), "")
    cells = [F.col("qname"), F.lit("0"), F.col("rname"), (F.col("pos") + 1).cast("string"), F.col("mapq").cast("string"), F.col("cigar"), F.lit("*"), F.lit("0"), F.lit("0"), F.col("seq"), qual]
    part = F.pmod(F.xxhash64("qname"), F.lit(CONTIG_PARTS))
    lines = reads.select("rname", part.alias("part"), "ordinal", F.concat_ws("\t", *cells).alias("value"))
    lines.repartition("rname", "part").sortWithinPartitions("rname", "part", "ordinal").select("value").write.mode("overwrite").option("compression", "gzip").text(path)


def write_gff(genes: DataFrame, path: str) -> None:
    """genes(seq_name, start, end, strand, gene) as CDS features of GFF3 text."""
    strand = F.when(F.col("strand") < 0, "-").when(F.col("strand") > 0, "+").otherwise(".")
    cells = [F.col("seq_name"), F.lit("."), F.lit("CDS"), F.col("start").cast("string"), F.col("end").cast("string"), F.lit("."), strand, F.lit("0"), F.concat(F.lit("ID="), F.col("gene"))]
    genes.select(F.concat_ws("\t", *cells).alias("value")).write.mode("overwrite").text(path)


def write_vcf(sites: DataFrame, path: str) -> None:
    """sites(chrom, pos, gts) as records of VCF text, a sample of one allele for each of gts."""
    cells = [F.col("chrom"), F.col("pos").cast("string"), F.lit("."), F.lit("A"), F.lit("C"), F.lit("."), F.lit("PASS"), F.lit("."), F.lit("GT"), F.array_join("gts", "\t")]
    sites.select(F.concat_ws("\t", *cells).alias("value")).write.mode("overwrite").text(path)


def alleles(cells: Column) -> Column:
    """Allele letters of genotype cells: the GT subfield of each, without its separators."""
    return F.flatten(F.transform(cells, lambda c: F.filter(F.split(F.split(c, ":")[0], "[|/]"), lambda a: a != "")))


def read_vcf(spark: SparkSession, path: str) -> DataFrame:
    """sites(chrom, pos, ref, alt, gts): records with single-base Ref and Alt; gts are the samples' alleles in order."""
    lines = spark.read.text(path).filter(~F.col("value").startswith("#"))
    f = lines.select(F.split(F.trim("value"), "\t").alias("f")).filter(F.size("f") >= 9)
    f = f.filter((F.length(F.get("f", F.lit(3))) == 1) & (F.length(F.get("f", F.lit(4))) == 1) & F.get("f", F.lit(8)).rlike("^GT(:|$)"))
    return f.select(F.get("f", F.lit(0)).alias("chrom"), F.get("f", F.lit(1)).cast("long").alias("pos"), F.get("f", F.lit(3)).alias("ref"), F.get("f", F.lit(4)).alias("alt"), alleles(F.slice("f", F.lit(10), F.size("f"))).alias("gts"))
