"""Pairs of sequences, counted with NumPy in tasks over rows that Spark has brought together by gene.

A pair's codons are words of 64 flags: which are synonymous, and which of them differ. Its lags are counted on those
words. What a task counts is added up by (pair, lag, codons, codons that differ) before it leaves the task if asked for.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .tables import KINDS, amino, letters_of, ragged

#: Rows and pairs of a partition; rows and letters that a task holds before it counts them.
PART_ROWS, PART_PAIRS, HELD_ROWS, HELD_LETTERS = 200_000, 10_000_000, 20_000, 8_000_000
#: Words of flags of the pairs, and cells of padded codons, that are counted at once.
CHUNK, CELLS = 300_000, 16_000_000
WORD = 64


def sides(rows: DataFrame, block: int) -> DataFrame:
    """rows with (i, j, side): a gene's rows are dealt to g = ceil(n / block) blocks by a hash of seq_idx, and every pair of blocks i <= j is a group.

    A row goes to the g pairs of blocks that its own is in, as side 0 where that is i, else as side 1; so a hot gene
    spreads over g (g + 1) / 2 groups of at most some block^2 pairs each.
    """
    g = rows.groupBy("gene").agg(F.greatest(F.lit(1), F.ceil(F.count("*") / block)).cast("int").alias("g"))
    own = rows.join(g, "gene").withColumn("own", F.pmod(F.xxhash64("seq_idx"), F.col("g")).cast("int"))
    each = own.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("g") - 1)))
    return each.select(*rows.columns, F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), F.when(F.col("own") <= F.col("other"), 0).otherwise(1).alias("side"))


def together(rows: DataFrame, block: int) -> DataFrame:
    """rows (gene, seq_idx, ...) with (i, j, side), the groups of sides() together and in order, in as many partitions as rows and pairs ask for."""
    n = F.col("n").cast("double")
    total, pairs, most = rows.groupBy("gene").agg(F.count("*").alias("n")).agg(F.sum("n"), F.sum(n * (n - 1) / 2), F.max("n")).first()
    parts = max(rows.sparkSession.sparkContext.defaultParallelism, math.ceil((total or 0) / PART_ROWS), math.ceil((pairs or 0) / PART_PAIRS))
    if (most or 0) <= block:
        none = F.lit(0)
        return rows.select("*", none.alias("i"), none.alias("j"), none.alias("side")).repartition(parts, "gene").sortWithinPartitions("gene", "seq_idx")
    return sides(rows, block).repartition(parts, "gene", "i", "j").sortWithinPartitions("gene", "i", "j", "side", "seq_idx")


class Codons:
    """Sequences as arrays of a row a codon: amino acids, which are told apart where unknown, bases, and whether there is one."""

    def __init__(self, seqs: pa.Array, offset: int, base: int, unknown: int):
        data, offsets = letters_of(seqs)
        self.size = np.maximum(0, (np.diff(offsets) - offset) // 3)
        shape = len(seqs), int(self.size.max(initial=0))
        row, place = ragged(self.size)
        at = offsets[:-1][row] + offset + 3 * place
        letter = [data[at + k] for k in range(3)]
        code = amino(*letter)
        self.aa, self.base = np.full(shape, unknown, np.uint8), np.zeros(shape, np.uint8)
        self.aa[row, place] = np.where(code == KINDS - 1, unknown, code)
        self.base[row, place] = letter[base]
        self.aa, self.base = np.ascontiguousarray(self.aa.T), np.ascontiguousarray(self.base.T)


def moved(words: np.ndarray, lag: int) -> np.ndarray:
    """The flags `lag` places ahead, in the words where those of each place are."""
    q, r = divmod(lag, WORD)
    out = np.zeros_like(words)
    if q < len(words):
        out[: len(words) - q] = words[q:] >> np.uint64(r)
        if r:
            out[: len(words) - q - 1] |= words[q + 1 :] << np.uint64(WORD - r)
    return out


def ones(words: np.ndarray) -> np.ndarray:
    return np.bitwise_count(words).sum(axis=0, dtype=np.int32) if len(words) > 1 else np.bitwise_count(words[0]).astype(np.int32)


def lag_counts(one: Codons, two: Codons, x: np.ndarray, y: np.ndarray, lags: int, both: bool) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(lag, n, d) for the pairs of row x of one and row y of two: codons that agree in their amino acid (and `lag` on too if `both`), and those that differ at both places."""
    reach = min(len(one.aa), len(two.aa))
    shape = (max(1, -(-reach // WORD)), len(x))
    syn, differ, there = (np.zeros(shape, np.uint64) for _ in range(3))
    common = np.minimum(one.size[x], two.size[y])
    for k in range(reach):
        w, bit = k // WORD, np.uint64(k % WORD)
        syn[w] |= (one.aa[k][x] == two.aa[k][y]).astype(np.uint64) << bit
        apart = one.base[k][x] != two.base[k][y]
        if not both:
            inside = common > k
            apart &= inside
            there[w] |= inside.astype(np.uint64) << bit
        differ[w] |= apart.astype(np.uint64) << bit
    first = syn & differ
    ahead_n, ahead_d = (syn, first) if both else (there, differ)
    for lag in range(min(lags, reach)):
        yield lag, ones(syn & moved(ahead_n, lag)), ones(first & moved(ahead_d, lag))


def whole_groups(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """(rows, first row of each group and their number) of consecutive groups, none of them cut; with keys = 0 each row is a group."""
    held, rows, letters = [], 0, 0

    def joined() -> tuple[pa.Table, np.ndarray]:
        table = pa.Table.from_batches(held).combine_chunks()
        if not keys:
            return table, np.arange(len(table) + 1)
        new = np.zeros(max(0, len(table) - 1), bool)
        for k in range(keys):
            c = pc.dictionary_encode(table.column(k)).combine_chunks()
            c = (c.chunk(0) if isinstance(c, pa.ChunkedArray) else c).indices.to_numpy(zero_copy_only=False)
            new |= c[1:] != c[:-1]
        return table, np.concatenate([[0], np.flatnonzero(new) + 1, [len(table)]])

    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        rows, letters = rows + batch.num_rows, letters + batch.column("seq").nbytes
        if rows >= HELD_ROWS or letters >= HELD_LETTERS:
            table, starts = joined()
            last = int(starts[-2]) if keys else len(table)
            if last:
                yield table.slice(0, last), starts[:-1] if keys else starts
            held = table.slice(last).to_batches()
            rows, letters = len(table) - last, sum(b.column("seq").nbytes for b in held)
    if held:
        yield joined()


def stretches(cost: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Ranges of elements whose costs sum to at most `most`, but at least one element."""
    ends, at = np.cumsum(cost), 0
    while at < len(cost):
        stop = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most, side="right")))
        yield at, stop
        at = stop


def padded(rows: list[int], longest: list[int]) -> Iterator[tuple[int, int]]:
    """Ranges of groups whose rows, all as long as the longest, have at most CELLS codons, but at least one group."""
    low, total, most = 0, 0, 0
    for k, (n, size) in enumerate(zip(rows, longest, strict=True)):
        total, most = total + n, max(most, size)
        if total * most > CELLS and k > low:
            yield low, k
            low, total, most = k, n, size
    yield low, len(rows)


def within(starts: np.ndarray, i: np.ndarray, j: np.ndarray, side: np.ndarray, order: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first, number) of the earlier rows that each row is paired with: those before it in its block, or those of the other block of its group."""
    lengths = np.diff(starts)
    group = np.repeat(np.arange(len(lengths)), lengths)
    row, first = np.arange(len(group)), starts[:-1][group]
    new = np.ones(len(row), bool)
    new[1:] = (group[1:] != group[:-1]) | (order[1:] != order[:-1])
    tied = np.maximum.accumulate(np.where(new, row, 0))  # rows of one seq_idx are no pair
    of_first = np.bincount(group, weights=side == 0, minlength=len(lengths)).astype(np.int64)
    return first, np.where(i == j, tied - first, np.where(side == 1, of_first[group], 0))


def names(column: pa.ChunkedArray) -> tuple[np.ndarray, list]:
    """(number of each row's name, -1 for null, and the names in order)."""
    kinds = pc.unique(column).drop_null()
    kinds = kinds.take(pc.sort_indices(kinds))
    found = pc.index_in(column, value_set=kinds)
    return found.fill_null(-1).to_numpy().astype(np.int64), kinds


def summed_up(a: np.ndarray, b: np.ndarray, total: int, counts: list[tuple[int, np.ndarray, np.ndarray]]) -> tuple[np.ndarray, ...]:
    """(a, b, lag, n, d, times): how often each comes; `total` is the number of names."""
    code = (a + 1) * (total + 1) + b + 1
    if (total + 1) ** 2 <= 4 * len(code) + 4096:
        there = np.zeros((total + 1) ** 2, bool)
        there[code] = True
        kinds = np.flatnonzero(there)
        pair = (np.cumsum(there) - 1)[code]
    else:
        kinds, pair = np.unique(code, return_inverse=True)
    wide, out = 1 + max((int(n.max(initial=0)) for _, n, _ in counts), default=0), []
    for lag, n, d in counts:
        keep = n > 0
        key = (pair[keep] * wide + n[keep]) * wide + d[keep]
        space = len(kinds) * wide * wide
        if space <= 4 * len(key) + 4096:
            times = np.bincount(key, minlength=space)
            once = np.flatnonzero(times)
            times = times[once]
        else:
            once, times = np.unique(key, return_counts=True)
        p = kinds[once // (wide * wide)]
        out.append((p // (total + 1) - 1, p % (total + 1) - 1, np.full(len(once), lag), once // wide % wide, once % wide, times))
    return tuple(np.concatenate(c) for c in zip(*out, strict=True)) if out else (np.zeros(0, np.int64),) * 6


def pair_name() -> Column:
    return F.concat_ws("_vs_", "a", "b")


def paired(rows: DataFrame, lags: int, *, offset: int, base: int, both: bool, block: int, mate: bool, add: bool) -> DataFrame:
    """(pair, gene, l, n, d, times) of the pairs of rows (gene, seq_idx, genome, seq), or of each with (genome_x, seq_x) of its own if `mate`.

    With `add` equal rows of all genes are added up by their `times`, and gene is left out.
    """
    kind = rows.schema["gene"].dataType.simpleString()
    if mate:
        ready, keys = rows.select("gene", "genome", "seq", "genome_x", "seq_x"), 0
    else:
        ready, keys = together(rows.select("gene", "seq_idx", "genome", "seq"), block).select("gene", "i", "j", "side", "seq_idx", "genome", "seq"), 3

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, starts in whole_groups(batches, keys):
            longest = np.maximum.reduceat(pc.binary_length(table.column("seq")).to_numpy(), starts[:-1]) // 3 + 1
            for low, high in padded(np.diff(starts).tolist(), longest.tolist()):
                at, end = int(starts[low]), int(starts[high])
                part = table.slice(at, end - at)
                codons = Codons(part.column("seq").combine_chunks(), offset, base, 255)
                if mate:
                    other = Codons(part.column("seq_x").combine_chunks(), offset, base, 254)
                    first, reach = np.arange(len(part)), np.ones(len(part), np.int64)
                    both_names = pa.chunked_array([*part.column("genome_x").chunks, *part.column("genome").chunks], pa.string())
                    name, kinds = names(both_names)
                    name_x, name_y = name[: len(part)], name[len(part) :]
                else:
                    other = Codons(part.column("seq").combine_chunks(), offset, base, 254)
                    i, j, side, order = (part.column(c).to_numpy() for c in ("i", "j", "side", "seq_idx"))
                    first, reach = within(starts[low : high + 1] - at, i, j, side, order)
                    name_x, kinds = names(part.column("genome"))
                    name_y = name_x
                words = max(1, -(-len(codons.aa) // WORD))
                for b, e in stretches(reach * words, CHUNK):
                    y, k = ragged(reach[b:e])
                    if not len(y):
                        continue
                    y, x = y + b, first[b:e][y] + k
                    counts = [*lag_counts(other, codons, x, y, lags, both)]
                    p, q = name_x[x], name_y[y]
                    p, q = np.where(p < 0, q, p), np.where(q < 0, p, q)
                    p, q = np.minimum(p, q), np.maximum(p, q)
                    if add:
                        p, q, lag, n, d, times = summed_up(p, q, len(kinds), counts)
                        gene = []
                    else:
                        kept = [np.flatnonzero(n > 0) for _, n, _ in counts]
                        lag = np.concatenate([np.full(len(s), c[0]) for s, c in zip(kept, counts, strict=True)]) if counts else np.zeros(0, np.int64)
                        n, d = (np.concatenate([c[v][s] for s, c in zip(kept, counts, strict=True)]) if counts else np.zeros(0, np.int64) for v in (1, 2))
                        where = np.concatenate(kept) if kept else np.zeros(0, np.int64)
                        p, q, times = p[where], q[where], np.ones(len(where), np.int64)
                        gene = [part.column("gene").combine_chunks().take(pa.array(y[where]))]
                    if len(lag):
                        of = lambda v: kinds.take(pa.array(v, mask=v < 0))
                        yield pa.RecordBatch.from_arrays([*gene, of(p), of(q), *[pa.array(c.astype(np.int64)) for c in (lag, n, d, times)]], [*["gene"] * (not add), "a", "b", "l", "n", "d", "times"])

    out = ready.mapInArrow(run, ("" if add else f"gene {kind}, ") + "a string, b string, l long, n long, d long, times long")
    if add:
        out = out.groupBy("a", "b", "l", "n", "d").agg(F.sum("times").alias("times"))
    return out.select(pair_name().alias("pair"), *["gene"] * (not add), F.col("l").cast("int").alias("l"), "n", "d", "times")
