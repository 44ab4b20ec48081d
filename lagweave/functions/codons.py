"""Codon expressions: splitting, the genetic code, gap predicates, reverse complement."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Amino acids of NCBI translation table 11, first, second and third base in the order TCAG.
TABLE_11 = "FFLLSSSSYY**CC*WLLLLPPPPHHQQRRRRIIIMTTTTNNKKSSRRVVVVAAAADDEEGGGG"
ORDER = "TCAG"
UNKNOWN = "?"


def bound(value: Column, make: Callable[[Column], Column]) -> Column:
    """make(value), with value computed once a row however often make refers to it, even for each element of an array."""
    return F.element_at(F.transform(F.array(value), make), 1)


def codon_at(seq: Column, index: Column, offset: int = 0) -> Column:
    """The index-th codon (from 0) of a sequence read from `offset`."""
    return F.substring(seq, index * 3 + (offset + 1), F.lit(3))


def codon_count(seq: Column, offset: int = 0) -> Column:
    """Whole codons from `offset` on; a trailing part doesn't count."""
    return F.greatest(F.lit(0), F.floor((F.length(seq) - offset) / 3)).cast("int")


def amino_acid(codon: Column) -> Column:
    """The amino acid, * for a stop, ? for a codon that isn't in the table (lower case and ambiguous bases included)."""
    place = [F.instr(F.lit(ORDER), F.substring(codon, k, 1)) for k in (1, 2, 3)]
    known = (F.length(codon) == 3) & (F.least(*place) > 0)
    return F.when(known, F.substring(F.lit(TABLE_11), place[0] * 16 + place[1] * 4 + place[2] - 20, F.lit(1))).otherwise(F.lit(UNKNOWN))


def has_gap(codon: Column) -> Column:
    """Alignment gap rule: a dash or an N."""
    return (F.instr(codon, "-") > 0) | (F.instr(codon, "N") > 0)


def is_plain(codon: Column) -> Column:
    """Read rule: only A, T, G and C."""
    return (codon != "") & (F.translate(codon, "ATGC", "") == "")


def reverse_complement(seq: Column) -> Column:
    return F.reverse(F.translate(seq, "ACGTacgt", "TGCAtgca"))


def codon_position(option: int) -> tuple[int, bool]:
    """(base 0 to 2, whether classes are synonymous) of the option 1 to 4, where 4 is the synonymous third base."""
    if not 1 <= option <= 4:
        raise ValueError("codon position must be in the range of 1 to 4")
    return (2, True) if option == 4 else (option - 1, False)
