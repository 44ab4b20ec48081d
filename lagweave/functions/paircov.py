"""Pair statistics of k x k contingency tables in closed form, as Column expressions over count columns.

A table counts (first base, second base) over the sequences of one class. Cells above a minimum are kept. With T the
kept total, R and C the row and column sums: pairs that differ at both sites are (T^2 - sum R^2 - sum C^2 + sum c^2)/2.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

BASES, BITS = "ATGC", "01"


def cells(alphabet: str = BASES, prefix: str = "n_") -> list[str]:
    return [f"{prefix}{a}{b}" for a in alphabet for b in alphabet]


def counts(first: Column, second: Column, alphabet: str = BASES, weight: Column | None = None, prefix: str = "n_") -> list[Column]:
    """One conditional sum per cell; letters outside the alphabet count nowhere. The cell is one number, made once a row."""
    one = F.lit(1) if weight is None else weight
    place = lambda x: F.when(F.length(x) == 1, F.instr(F.lit(alphabet), x)).otherwise(0)
    x, y, k = place(first), place(second), len(alphabet) + 1
    cell = x * k + y  # k * 1 + 1 is the first; those with a row or column 0 are none's
    return [F.sum(F.when(cell == k * i + j, one).otherwise(0)).cast("long").alias(f"{prefix}{a}{b}") for i, a in enumerate(alphabet, 1) for j, b in enumerate(alphabet, 1)]


def append(alphabet: str = BASES, prefix: str = "n_") -> list[Column]:
    """Aggregates that add tables of one alphabet."""
    return [F.sum(c).alias(c) for c in cells(alphabet, prefix)]


def total(terms: Sequence[Column]) -> Column:
    return sum(terms[1:], terms[0])


def kept(alphabet: str, least: int, prefix: str) -> list[list[Column]]:
    cell = lambda a, b: F.when(F.col(f"{prefix}{a}{b}") > least, F.col(f"{prefix}{a}{b}")).otherwise(F.lit(0).cast("long"))
    return [[cell(a, b) for b in alphabet] for a in alphabet]


def square(x: Column) -> Column:
    return x * x


def sums(table: list[list[Column]]) -> tuple[list[Column], list[Column], list[Column], Column]:
    flat = [c for row in table for c in row]
    return flat, [total(row) for row in table], [total(list(col)) for col in zip(*table, strict=True)], total(flat)


def p11(alphabet: str = BASES, least: int = 0, prefix: str = "n_") -> tuple[Column, Column]:
    """(pairs that differ at both sites, all pairs)."""
    flat, rows, columns, t = sums(kept(alphabet, least, prefix))
    both = square(t) - total([square(r) for r in rows]) - total([square(c) for c in columns]) + total([square(c) for c in flat])
    return (both / 2).cast("long"), (t * (t - 1) / 2).cast("long")


def p00(alphabet: str = BASES, least: int = 0, prefix: str = "n_") -> tuple[Column, Column]:
    """(pairs that are alike at both sites, all pairs)."""
    flat, _, _, t = sums(kept(alphabet, least, prefix))
    return (total([c * (c - 1) for c in flat]) / 2).cast("long"), (t * (t - 1) / 2).cast("long")


def mate_p11(alphabet: str = BASES, least: int = 0, one: str = "x_", two: str = "y_") -> tuple[Column, Column]:
    """Between two tables: (pairs that differ at both sites over kept cells, pairs over all cells)."""
    a, b = sums(kept(alphabet, least, one)), sums(kept(alphabet, least, two))
    dot = lambda i: total([x * y for x, y in zip(a[i], b[i], strict=True)])
    whole = lambda p: total([F.col(c) for c in cells(alphabet, p)])
    return a[3] * b[3] - dot(1) - dot(2) + dot(0), whole(one) * whole(two)


def mate_p00(alphabet: str = BASES, one: str = "x_", two: str = "y_") -> tuple[Column, Column]:
    """Between two tables: (pairs alike at both sites, all pairs); every cell counts."""
    xs, ys = [F.col(c) for c in cells(alphabet, one)], [F.col(c) for c in cells(alphabet, two)]
    return total([x * y for x, y in zip(xs, ys, strict=True)]), total(xs) * total(ys)


def mate_p11_aps(alphabet: str = BASES, least: int = 0, one: str = "x_", two: str = "y_") -> tuple[Column, Column]:
    """Between two tables: (all kept pairs, all pairs times the kept cells of the first table)."""
    a, b = sums(kept(alphabet, least, one)), sums(kept(alphabet, least, two))
    cells_kept = total([(F.col(c) > least).cast("long") for c in cells(alphabet, one)])
    whole = lambda p: total([F.col(c) for c in cells(alphabet, p)])
    return a[3] * b[3], whole(one) * whole(two) * cells_kept


#: Statistics of one table by name: each takes `least` and gives (pairs that count, all pairs).
STATISTICS = {"p11": p11, "p00": p00}


def register_statistic(name: str, f) -> None:
    """Make f(least=...) -> (pairs that count, all pairs), Columns over the cells of counts(), available by name to profiles."""
    if name in STATISTICS and STATISTICS[name] is not f:
        raise ValueError(f"there is a statistic named {name} already")
    STATISTICS[name] = f


def statistic_of(statistic):
    """The function of a name, or the function itself."""
    if callable(statistic):
        return statistic
    if statistic not in STATISTICS:
        raise ValueError(f"a statistic is a function or one of {', '.join(STATISTICS)}")
    return STATISTICS[statistic]
