"""Profiles of biallelic sites: pairs of sites within a distance, from genotype bit masks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MASK = 60


def mask(alleles: Column, letter: str) -> Column:
    """Bits of the genotypes that are `letter`, 60 to a long."""
    bits = F.regexp_replace(F.regexp_replace(alleles, f"[^{letter}]", "x"), letter, "1")
    bits = F.regexp_replace(bits, "x", "0")
    parts = F.sequence(F.lit(0), F.greatest(F.lit(0), F.floor((F.length(bits) - 1) / MASK)).cast("int"))
    return F.transform(parts, lambda i: F.conv(F.substring(bits, i * MASK + 1, F.lit(MASK)), 2, 10).cast("long"))


def common(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseAND(y))), F.lit(0), lambda s, x: s + x).cast("long")


def site_pairs(sites: DataFrame, max_length: int) -> DataFrame:
    """(chrom, lag, n_00, n_01, n_10, n_11): pairs of sites of a chromosome with 0 <= lag < max_length.

    The range join is an equi-join on (chromosome, bin of max_length): each anchor looks into its own bin and the next.
    """
    rows = sites.select("chrom", "pos", F.array_join("gts", "").alias("g"))
    rows = rows.select("chrom", "pos", mask(F.col("g"), "0").alias("zero"), mask(F.col("g"), "1").alias("one"), F.floor(F.col("pos") / max_length).alias("bin"))
    x = rows.withColumn("bin", F.explode(F.array(F.col("bin"), F.col("bin") + 1))).alias("x")
    y = rows.alias("y")
    near = (F.col("y.pos") >= F.col("x.pos")) & (F.col("y.pos") - F.col("x.pos") < max_length)
    both = x.join(y, (F.col("x.chrom") == F.col("y.chrom")) & (F.col("x.bin") == F.col("y.bin")) & near)
    cell = {f"n_{a}{b}": common(F.col(f"x.{p}"), F.col(f"y.{q}")) for a, p in (("0", "zero"), ("1", "one")) for b, q in (("0", "zero"), ("1", "one"))}
    return both.select(F.col("x.chrom").alias("chrom"), (F.col("y.pos") - F.col("x.pos")).alias("lag"), *[c.alias(n) for n, c in cell.items()])


def site_profile(sites: DataFrame, max_length: int = 300, region_start: int = 1, region_end: int = 10**12) -> DataFrame:
    """Profile rows (l, m, v, n, t, b) of sites(chrom, pos, gts): Ks is the mean at lag 0, P2 the sum over Ks' sum.

    Sites pairs without two usable genotypes are left out; v is 0.
    """
    from ..functions import paircov as P

    kept = sites.filter(F.col("pos").between(region_start, region_end))
    xy, n = P.p11(P.BITS)
    pairs = site_pairs(kept, max_length).select("lag", xy.alias("xy"), n.alias("n")).filter("n > 0")
    sums = pairs.groupBy("lag").agg(F.sum(F.col("xy") / F.col("n")).alias("s"), F.count("*").alias("c"))
    base = sums.filter("lag = 0").select(F.col("s").alias("s0"))
    out = sums.crossJoin(F.broadcast(base))  # one row
    m = F.when(F.col("lag") == 0, F.col("s") / F.col("c")).otherwise(F.col("s") / F.col("s0"))
    return out.select(F.col("lag").cast("int").alias("l"), m.alias("m"), F.lit(0.0).alias("v"), F.col("c").alias("n"), F.when(F.col("lag") == 0, "Ks").otherwise("P2").alias("t"), F.lit("all").alias("b"))
