"""Contingency tables of codon pairs, counted with NumPy in tasks over rows that Spark has brought together by group.

A task reads its partition sorted by group, a batch at a time. It counts the pairs of a batch by one sort of packed
keys; only the tables of the group that the batch ends in wait for the next, so its memory is that of a group's tables.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.codons import ORDER, TABLE_11, UNKNOWN
from ..functions.paircov import BASES, cells

#: Rows of a partition, and rows of a group beyond which it is dealt to several partitions.
PART_ROWS, HOT = 200_000, 20_000
#: Codons whose pairs are counted at once.
CHUNK = 200_000
AMINO = "".join(sorted(set(TABLE_11))) + UNKNOWN
KINDS = len(AMINO)
#: A cell for each pair of bases, and one for pairs with another letter.
WIDTH = len(BASES) ** 2 + 1


def by_letter(letters: str, other: int) -> np.ndarray:
    out = np.full(256, other, np.int64)
    out[np.frombuffer(letters.encode(), np.uint8)] = np.arange(len(letters))
    return out


PLACE, BASE = by_letter(ORDER, 4), by_letter(BASES, len(BASES))
GAP = np.isin(np.arange(256), np.frombuffer(b"-N", np.uint8))
#: The amino acid of three places in ORDER, 4 being any other letter.
CODE = np.full((5, 5, 5), KINDS - 1, np.int64)
CODE[:4, :4, :4] = np.array([AMINO.index(a) for a in TABLE_11]).reshape(4, 4, 4)
CODE = CODE.reshape(-1)


def amino(b0: np.ndarray, b1: np.ndarray, b2: np.ndarray) -> np.ndarray:
    return CODE[PLACE[b0] * 25 + PLACE[b1] * 5 + PLACE[b2]]


def letters_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of strings without nulls; a letter beyond ASCII counts as one unknown letter."""
    texts = texts.cast(pa.string())
    if texts.nbytes and pc.any(pc.not_equal(pc.binary_length(texts), pc.utf8_length(texts))).as_py():
        texts = pc.replace_substring_regex(texts, r"[^\x00-\x7F]", UNKNOWN)
    _, offsets, data = texts.buffers()
    offsets = np.frombuffer(offsets, np.int32, len(texts) + 1, texts.offset * 4).astype(np.int64)
    return np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8), offsets


def ragged(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, place within the row) of each element of rows of such lengths."""
    row = np.repeat(np.arange(len(lengths)), lengths)
    return row, np.arange(len(row)) - np.repeat(np.cumsum(lengths) - lengths, lengths)


def counted(keys: np.ndarray, counts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order and how often each comes, or the sum of its counts."""
    if not len(keys):
        return keys, np.zeros(0, np.int64)
    if counts is None:
        keys = np.sort(keys)
    else:
        order = np.argsort(keys, kind="stable")
        keys, counts = keys[order], counts[order]
    new = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
    return keys[new], np.diff(np.append(new, len(keys))) if counts is None else np.add.reduceat(counts, new)


def lag_tables(run, group, place, aa, base, lags: int, side=None, sides: int = 1, paired=None, twice=None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(group, key, counts) of the tables of codon pairs less than `lags` apart in a run; key packs place, lag and both amino acids.

    Codons are in order of run and place. Only those marked in `paired` have pairs with others; those in `twice` count
    twice with themselves. With sides, those of a run are of one, and a table has WIDTH cells for each.
    """
    width = WIDTH * sides
    wide, found, times = int(place.max(initial=0)) + 1, [], []
    for step in range(min(lags, len(run))):
        far = place[step:] - place[: len(place) - step]
        if step == 0:
            a = np.arange(len(run))
        else:
            a = np.flatnonzero((run[step:] == run[:-step]) & (far < lags) & (True if paired is None else paired[step:]))
        if not len(a):
            break
        x, y = base[a], base[a + step]
        cell = np.where((x < len(BASES)) & (y < len(BASES)), x * len(BASES) + y, WIDTH - 1)
        if side is not None:
            cell += WIDTH * side[a]
        key = (((group[a] * wide + place[a]) * lags + far[a]) * KINDS**2 + aa[a] * KINDS + aa[a + step]) * width + cell
        if step == 0 and twice is not None:
            key = np.concatenate([key, key[twice]])
        keys, n = counted(key)
        found.append(keys)
        times.append(n)
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros((0, width), np.int64)
    keys, n = counted(np.concatenate(found), np.concatenate(times))
    table, cell = keys // width, keys % width
    new = np.append(True, table[1:] != table[:-1])
    counts = np.zeros((int(new.sum()), width), np.int64)
    counts[np.cumsum(new) - 1, cell] = n
    per = wide * lags * KINDS**2
    return table[new] // per, table[new] % per, counts


class Waiting:
    """Passes on the counts of groups that follow each other; those of the last wait, as more of its rows may come."""

    def __init__(self):
        self.name, self.key, self.counts = None, None, None

    def add(self, names: list, group: np.ndarray, key: np.ndarray, counts: np.ndarray) -> tuple[list, np.ndarray, np.ndarray, np.ndarray]:
        if not names:
            return [], group, key, counts
        if self.name is not None and self.name == names[0]:
            mine = group == 0
            both = np.concatenate([self.key, key[mine]])
            once, inverse = np.unique(both, return_inverse=True)
            sums = np.zeros((len(once), counts.shape[1]), np.int64)
            np.add.at(sums, inverse, np.concatenate([self.counts, counts[mine]]))
            group, key, counts = np.concatenate([np.zeros(len(once), np.int64), group[~mine]]), np.concatenate([once, key[~mine]]), np.concatenate([sums, counts[~mine]])
        elif self.name is not None:
            names, group = [self.name, *names], np.concatenate([np.zeros(len(self.key), np.int64), group + 1])
            key, counts = np.concatenate([self.key, key]), np.concatenate([self.counts, counts])
        last = group == len(names) - 1
        self.name, self.key, self.counts = names[-1], key[last], counts[last]
        return names, group[~last], key[~last], counts[~last]

    def end(self) -> tuple[list, np.ndarray, np.ndarray, np.ndarray]:
        if self.name is None:
            return [], np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros((0, 1), np.int64)
        return [self.name], np.zeros(len(self.key), np.int64), self.key, self.counts


def named_runs(columns: list[list]) -> tuple[list[tuple], np.ndarray]:
    """(names of the groups of equal rows that follow each other, group of each row)."""
    rows = list(zip(*columns, strict=True))
    new = np.array([True, *(a != b for a, b in zip(rows, rows[1:], strict=False))], bool)[: len(rows)]
    return [rows[k] for k in np.flatnonzero(new)], np.cumsum(new) - 1


def arrow_runs(columns: list[pa.Array]) -> tuple[list[tuple], np.ndarray]:
    """named_runs of Arrow columns without nulls."""
    new = np.zeros(len(columns[0]), bool)
    new[:1] = True
    for c in columns:
        new[1:] |= pc.not_equal(c[1:], c[:-1]).to_numpy(zero_copy_only=False)
    at = pa.array(np.flatnonzero(new))
    return [*zip(*(c.take(at).to_pylist() for c in columns), strict=True)], np.cumsum(new) - 1


def chunks(lengths: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of rows of at most CHUNK elements, but at least one row."""
    ends, at = np.cumsum(lengths), 0
    while at < len(lengths):
        stop = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + CHUNK, side="right")))
        yield at, stop
        at = stop


def record(names: list, group: np.ndarray, kinds: list[pa.DataType], by: list[str], columns: dict[str, np.ndarray | pa.Array]) -> pa.RecordBatch:
    parts = list(zip(*names, strict=True)) if names else [()] * len(by)
    named = [pa.array(p, k).take(pa.array(group)) for p, k in zip(parts, kinds, strict=True)]
    return pa.RecordBatch.from_arrays([*named, *[c if isinstance(c, pa.Array) else pa.array(c) for c in columns.values()]], [*by, *columns])


def table_columns(key: np.ndarray, counts: np.ndarray, lags: int, prefixes: tuple[str, ...] = ("n_",)) -> dict[str, np.ndarray]:
    place, aa = key // KINDS**2, key % KINDS**2
    columns = {"l": (place % lags).astype(np.int32), "i": (place // lags).astype(np.int32), "aa": aa.astype(np.int32), "size": counts.sum(axis=1)}
    return columns | {c: np.ascontiguousarray(counts[:, WIDTH * s + k]) for s, p in enumerate(prefixes) for k, c in enumerate(cells(prefix=p))}


def like_columns(group: np.ndarray, key: np.ndarray, counts: np.ndarray, lags: int, prefixes: tuple[str, ...]) -> tuple[np.ndarray, dict[str, np.ndarray]]:
    """(group, columns l, times, cells): tables whose codon pairs are all in one cell once for each group, lag, cell and size, with how many they are."""
    lag, size, width = key // KINDS**2 % lags, counts.sum(axis=1), counts.shape[1]
    one = np.count_nonzero(counts, axis=1) == 1
    wide = int(size[one].max(initial=0)) + 1
    once, times = counted(((group[one] * lags + lag[one]) * width + counts[one].argmax(axis=1)) * wide + size[one])
    same = np.zeros((len(once), width), np.int64)
    same[np.arange(len(once)), once // wide % width] = once % wide
    place = once // (wide * width)
    group, counts = np.concatenate([group[~one], place // lags]), np.concatenate([counts[~one], same])
    columns = {"l": np.concatenate([lag[~one], place % lags]).astype(np.int32), "times": np.concatenate([np.ones(int((~one).sum()), np.int64), times])}
    return group, columns | {c: np.ascontiguousarray(counts[:, WIDTH * s + k]) for s, p in enumerate(prefixes) for k, c in enumerate(cells(prefix=p))}


def with_sizes(batches: Iterator[pa.RecordBatch], keys: int, sizes: dict[tuple, int]) -> Iterator[pa.RecordBatch]:
    """Batches without the rows that have no sequence, after their groups' rows have been added to sizes."""
    for batch in batches:
        if batch.num_rows:
            names, group = arrow_runs([batch.column(k) for k in range(keys)])
            for name, n in zip(names, np.bincount(group).tolist(), strict=True):
                sizes[name] = sizes.get(name, 0) + n
            yield batch.filter(batch.column(keys + 1).is_valid())


def spread(rows: DataFrame, by: list[str], order: list[str], salt: str) -> tuple[DataFrame, DataFrame | None]:
    """(rows of a group together and in order, sizes): partitions are as many as the rows ask for.

    A group of more than HOT rows is dealt to several partitions by a hash of `salt`; then sizes(by..., n) is given, and
    what is made of the rows of a group must be added up.
    """
    sizes = rows.groupBy(*by).agg(F.count("*").alias("n"))
    total, most = sizes.agg(F.sum("n"), F.max("n")).first()
    parts = max(rows.sparkSession.sparkContext.defaultParallelism, math.ceil((total or 0) / PART_ROWS))
    if (most or 0) <= HOT:
        return rows.repartition(parts, *by).sortWithinPartitions(*by, *order), None
    rows = rows.join(sizes, by).withColumn("_salt", F.pmod(F.xxhash64(salt), F.ceil(F.col("n") / HOT))).drop("n")
    return rows.repartition(parts, *by, "_salt").sortWithinPartitions(*by, "_salt", *order).drop("_salt"), sizes


def added(tables: DataFrame, by: list[str]) -> DataFrame:
    keys = [*by, "l", "i", "aa"]
    return tables.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in tables.columns if c not in keys])


def sequence_tables(aln: DataFrame, by: list[str], lags: int, unit: int = 3, offset: int = 0, base: int = 2, classes: bool = True, prefixes: tuple[str, ...] = ("n_",), least: int = 1) -> DataFrame:
    """(by..., l, times, cells): the tables of the pairs of sites i and i + l, 0 <= l < lags, and pairs of amino acids; what is made of them is summed `times` times.

    Sites are codons, or letters with unit 1. They reach as far as the first sequence by seq_idx of the group, and of
    its side where the rows have one (from 0, a prefix of cells each); a shorter one stops at its own end. With classes,
    codons with a gap are left out, and a table holds those of one pair of amino acids. Groups of fewer than `least`
    rows have no tables.
    """
    side = (F.col("side") if "side" in aln.columns else F.lit(0)).alias("side")
    rows = aln.select(*by, side, "seq_idx", "seq").filter(" and ".join(f"{c} is not null" for c in by))
    first, order = F.lit(None).cast("int"), ["side", "seq_idx"]
    ready, sizes = spread(rows, by, order, "seq_idx")
    hot = sizes is not None
    if hot:
        rows = rows.join(sizes.filter(F.col("n") >= least).select(*by), by).filter("seq is not null")
        size = F.greatest(F.lit(0), F.floor((F.length("seq") - offset) / unit)).cast("int")
        ready = spread(rows.join(rows.groupBy(*by, "side").agg(F.min_by(size, "seq_idx").alias("first")), [*by, "side"]), by, order, "seq_idx")[0]
        first = F.col("first")
    ready = ready.select(*by, "side", "seq", first.alias("first"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting, kinds, sizes = Waiting(), [None] * len(by), {}

        def made(names: list, group: np.ndarray, key: np.ndarray, counts: np.ndarray, last: bool = False) -> Iterator[pa.RecordBatch]:
            if not hot:  # then the rows of a group are all here
                enough = [sizes.pop(n) >= least for n in names[: len(names) - (not last)]]
                keep = np.array([*enough, True][: len(names)], bool)[group]
                group, key, counts = group[keep], key[keep], counts[keep]
            if len(key):
                group, columns = (group, table_columns(key, counts, lags, prefixes)) if hot else like_columns(group, key, counts, lags, prefixes)
                yield record(names, group, kinds, by, columns)

        for names, flat, kinds in site_runs(with_sizes(batches, len(by), sizes), len(by), unit, offset, base, classes):
            *codons, sides = flat
            yield from made(*waiting.add(names, *lag_tables(*codons, lags, sides if len(prefixes) > 1 else None, len(prefixes))))
        yield from made(*waiting.end(), last=True)

    kinds = [f"`{c}` {ready.schema[c].dataType.simpleString()}" for c in by]
    columns = "l int, i int, aa int, size long" if hot else "l int, times long"
    out = ready.mapInArrow(run, ", ".join([*kinds, columns, *[f"{c} long" for p in prefixes for c in cells(prefix=p)]]))
    return added(out, by).drop("i", "aa", "size").withColumn("times", F.lit(1).cast("long")) if hot else out


def site_runs(batches: Iterator[pa.RecordBatch], keys: int, unit: int, offset: int, base: int, classes: bool) -> Iterator[tuple]:
    """(names of groups, (row, group, place, amino acid, base, side) of sites, types of the names) of rows (keys..., side, seq, first)."""
    name, first = None, 0
    for batch in batches:
        if not batch.num_rows:
            continue
        kinds = [batch.schema.field(k).type for k in range(keys)]
        columns = [batch.column(k) for k in range(keys + 1)]
        names, group = arrow_runs(columns[:-1])
        firsts, part = arrow_runs(columns)
        data, offsets = letters_of(batch.column(keys + 1))
        size = np.maximum(0, (np.diff(offsets) - offset) // unit)
        starts = np.searchsorted(part, np.arange(len(firsts)))
        given = batch.column(keys + 2)
        if given.null_count < len(given):
            reach = given.to_numpy(zero_copy_only=False).astype(np.int64)[starts]
        else:
            reach = size[starts]
            if firsts[0] == name:
                reach[0] = first
        name, first = firsts[-1], reach[-1]
        n, sides = np.minimum(size, reach[part]), columns[-1].to_numpy().astype(np.int64)
        for a, b in chunks(n):
            row, place = ragged(n[a:b])
            at = offsets[a:b][row] + offset + unit * place
            if unit == 1:
                aa, own = np.zeros(len(at), np.int64), BASE[data[at]]
            else:
                letter = [data[at + k] for k in range(3)]
                aa, own = amino(*letter) if classes else np.zeros(len(at), np.int64), BASE[letter[base]]
                if classes:
                    keep = ~(GAP[letter[0]] | GAP[letter[1]] | GAP[letter[2]])
                    row, place, aa, own = row[keep], place[keep], aa[keep], own[keep]
            low = group[a]
            yield names[low : group[b - 1] + 1], (row, group[a:b][row] - low, place, aa, own, sides[a:b][row]), kinds
