"""Gene profiles of alignments: lag pairs within sequences, contingency tables, one and two clades, genome pairs."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import codons as C
from ..functions import paircov as P
from ..sources.scratch import stored
from .order import zipped
from .pairs import paired, sides
from .tables import sequence_tables


@dataclass(frozen=True)
class CodingOptions:
    """max_corr_length in bases; codon_position 1 to 3 counts a base, 4 the third base of synonymous classes."""

    max_corr_length: int = 300
    codon_position: int = 4
    codon_offset: int = 0
    min_sequences: int = 2
    min_allele_number: int = 0
    synonymous: bool | None = None

    @property
    def lags(self) -> int:
        return self.max_corr_length // 3

    @property
    def base(self) -> int:
        return C.codon_position(self.codon_position)[0]

    @property
    def classes(self) -> bool:
        return C.codon_position(self.codon_position)[1] if self.synonymous is None else self.synonymous


def codon_array(offset: int) -> Column:
    """The whole codons of `seq`."""

    def cut(seq: Column) -> Column:
        n = C.codon_count(seq, offset)
        return F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), lambda p: C.codon_at(seq, p, offset))).otherwise(F.array().cast("array<string>"))

    return C.bound(F.col("seq"), cut)


def tables(aln: DataFrame, o: CodingOptions, by: list[str], *prefixes: str, least: int = 1) -> DataFrame:
    """(by..., l, times, cells): the contingency tables of codon pairs per position pair and amino-acid pair; one per `side` with several prefixes."""
    return sequence_tables(aln, by, o.lags, offset=o.codon_offset, base=o.base, classes=o.classes, prefixes=prefixes or ("n_",), least=least)


def summed(cells: DataFrame, by: list[str], xy: Column, n: Column, step: int, kind: str = "P2") -> DataFrame:
    """(by..., lag, mean, n, type) from pair counts per table; lags without pairs are left out."""
    sums = cells.groupBy(*by, "l").agg(F.sum(xy * F.col("times")).alias("xy"), F.sum(n * F.col("times")).cast("long").alias("n")).filter("n > 0")
    return sums.select(*by, (F.col("l") * step).alias("lag"), (F.col("xy") / F.col("n")).alias("mean"), "n", F.lit(kind).alias("type"))


def gene_profile(aln: DataFrame, o: CodingOptions = CodingOptions(), *, statistic: str | Callable = "p11") -> DataFrame:
    """One-clade profile of alignment(gene, seq_idx, seq): gene, lag, mean, n (pairs), type.

    mean is the share of sequence pairs of one amino-acid class that differ (p11) or are alike (p00) at both codons, or
    what a statistic of the caller's own counts: its name in paircov.register_statistic, or the function.
    """
    xy, n = P.statistic_of(statistic)(least=o.min_allele_number)
    return summed(tables(aln, o, ["gene"], least=o.min_sequences), ["gene"], xy, n, 3)


def noncoding_profile(aln: DataFrame, max_lag: int = 300, min_allele_number: int = 0) -> DataFrame:
    """Profile by bases instead of codons; pairs with a letter beyond ATGC aren't counted."""
    cells = sequence_tables(aln, ["gene"], max_lag, unit=1, least=2)
    return summed(cells, ["gene"], *P.p11(least=min_allele_number), 1)


def first_match(aln: DataFrame, ordinal: str | None) -> DataFrame:
    """One block per gene and position: the first of a file that has several, by `ordinal` if there is such a column."""
    if ordinal is None or ordinal not in aln.columns:
        return aln
    first = aln.groupBy("gene", "pos").agg(F.min(ordinal).alias(ordinal))
    return aln.join(first, ["gene", "pos", ordinal], "left_semi")


def clade_profile(one: DataFrame, two: DataFrame, o: CodingOptions = CodingOptions(min_sequences=1), *, statistic: str = "p11", ordinal: str | None = "block") -> DataFrame:
    """Between-clade profile of two alignments(gene, pos, seq_idx, seq), joined on gene and position.

    Both clades' tables of a position pair and amino-acid pair are counted side by side in one pass; positions reach as far as the shorter of the
    two first sequences. statistic: p11, p00 or aps.
    """
    by = ["gene", "pos"]
    sides = [aln.select(*by, "seq_idx", "seq", F.lit(k).alias("side")) for k, aln in enumerate((one, first_match(two, ordinal)))]
    both = tables(sides[0].unionByName(sides[1]), o, by, "x_", "y_")
    xy, n = {"p11": lambda: P.mate_p11(least=o.min_allele_number), "p00": P.mate_p00, "aps": lambda: P.mate_p11_aps(least=o.min_allele_number)}[statistic]()
    return summed(both, by, xy, n, 3).drop("pos")


def block_genes(aln: DataFrame) -> DataFrame:
    """(block, gene): the gene of each block's first sequence.

    A string can't be updated in a hash aggregate, so its rows would all be sorted; as a key it can be, and few are left.
    """
    genes = aln.groupBy("block", "gene").agg(F.min("seq_idx").alias("first"))
    return genes.groupBy("block").agg(F.min_by("gene", "first").alias("gene"))


def zip_blocks(one: DataFrame, two: DataFrame) -> DataFrame:
    """(pos, x, y): the k-th block of one alignment with the k-th of another, whatever their genes; each a struct of block and gene.

    Blocks are in the order of their number; the blocks of the longer file that have no partner are left out.
    """
    return zipped(block_genes(one), block_genes(two), [F.col("block")], [F.col("block")])


def zipped_profile(one: DataFrame, two: DataFrame, o: CodingOptions = CodingOptions(min_sequences=1), *, statistic: str = "p11") -> DataFrame:
    """clade_profile of blocks that are paired by their place in the two files instead of by gene and position."""
    pairs = stored(zip_blocks(one, two), "zipped-blocks")
    left = one.join(pairs.select(F.col("x.block").alias("block"), F.col("pos").alias("k")), "block").select("gene", F.col("k").alias("pos"), "seq_idx", "seq")
    right = two.select("block", "seq_idx", "seq").join(pairs.select(F.col("y.block").alias("block"), F.col("x.gene").alias("gene"), F.col("pos").alias("k")), "block").select("gene", F.col("k").alias("pos"), "seq_idx", "seq")
    return clade_profile(left, right, o, statistic=statistic, ordinal=None)


def clade_profile_defaulted(one: DataFrame, two: DataFrame, o: CodingOptions = CodingOptions(min_sequences=1)) -> DataFrame:
    """clade_profile in the older variant: where the lag-0 mean is 0, later lags are 0 with the lag-0 count."""
    p = clade_profile(one, two, o)
    w = Window.partitionBy("gene")
    zero = F.max(F.when((F.col("lag") == 0) & (F.col("mean") == 0), F.col("n"))).over(w)
    return p.withColumn("z", zero).select("gene", "lag", F.when(F.col("z").isNotNull(), 0.0).otherwise(F.col("mean")).alias("mean"), F.coalesce("z", "n").alias("n"), "type")


#: Sequences of a block: a gene of more is dealt to several, and each pair of blocks is counted by itself.
PAIR_BLOCK = 256


def pairs_within(rows: DataFrame, block: int) -> DataFrame:
    """(gene, x, y): every pair of a gene's rows (seq_idx, genome, sites) with x before y, each made once, as pairs.sides deals them."""
    dealt = sides(rows, block).withColumn("row", F.struct("seq_idx", "genome", "sites"))
    x = dealt.filter("side = 0").select("gene", "i", "j", F.col("row").alias("x"))
    y = dealt.filter("side = 1 or i = j").select("gene", "i", "j", F.col("row").alias("y"))
    return x.join(y, ["gene", "i", "j"]).filter("i < j or x.seq_idx < y.seq_idx").select("gene", "x", "y")


def pair_codons(aln: DataFrame, o: CodingOptions, mate: DataFrame | None, synonymous_second: bool, block: int, add: bool) -> DataFrame:
    rows = aln.select("gene", "seq_idx", "genome", "seq").filter("gene is not null and seq_idx is not null and seq is not null")
    if mate is not None:
        name = F.col("genome") if "genome" in mate.columns else F.lit("mate")
        one = mate.groupBy("gene").agg(F.max_by("seq", "ordinal" if "ordinal" in mate.columns else "seq").alias("seq_x"), F.first(name).alias("genome_x"))
        rows = aln.select("gene", "genome", "seq").filter("seq is not null").join(one.filter("seq_x is not null"), "gene")
    return paired(rows, o.lags, offset=o.codon_offset, base=o.base, both=synonymous_second, block=block, mate=mate is not None, add=add)


def genome_pairs(aln: DataFrame, o: CodingOptions = CodingOptions(), mate: DataFrame | None = None, synonymous_second: bool = True, block: int = PAIR_BLOCK) -> DataFrame:
    """Profile of every pair of sequences of a gene: pair (a_vs_b), gene, lag, mean, n, type.

    Counted are codons k whose amino acids agree in both sequences (and at k + lag too if synonymous_second); mean is
    the share of them that differ at k and at k + lag. With mate(gene, seq) each sequence is paired with the gene's
    mate instead. The number of pairs is the result's own size; genome_pair_counts gives what sums over genes need.
    """
    sums = pair_codons(aln, o, mate, synonymous_second, block, False)
    return sums.select("pair", "gene", (F.col("l") * 3).alias("lag"), (F.col("d") / F.col("n")).alias("mean"), "n", F.lit("P2").alias("type"))


def genome_pair_counts(aln: DataFrame, o: CodingOptions = CodingOptions(), mate: DataFrame | None = None, synonymous_second: bool = True, block: int = PAIR_BLOCK) -> DataFrame:
    """The rows of genome_pairs without their genes, equal ones once with how many they are: pair, lag, mean, n, type, times."""
    sums = pair_codons(aln, o, mate, synonymous_second, block, True)
    return sums.select("pair", (F.col("l") * 3).alias("lag"), (F.col("d") / F.col("n")).alias("mean"), "n", F.lit("P2").alias("type"), "times")
