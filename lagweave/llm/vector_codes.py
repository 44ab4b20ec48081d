"""Vector codes: product quantisation whose codebooks are found by filtering Lloyd rounds over kd-trees."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import col, forget, stored

PARTS, ENTRIES, ROUNDS, SCALE = 8, 16, 6, 4096
#: Rows of a block, over which each part position has one tree, and the most points of a leaf.
BLOCK, LEAF = 8192, 24
#: Components stay below this, so that squared distances are exact in 64 bits.
LARGEST = 1 << 26


class Tree:
    """A kd-tree over the parts of one position: points in tree order, and of each node the box, the sum and the count.

    Level t has 2^t nodes; node i of it holds the points from i n / 2^t to (i + 1) n / 2^t, so nodes need no pointers.
    Nodes are numbered by level: 2^t - 1 + i.
    """

    def __init__(self, points: np.ndarray, order: np.ndarray, low: np.ndarray, high: np.ndarray, sums: np.ndarray):
        self.points, self.order, self.low, self.high, self.sums = points, order, low, high, sums
        self.depth = len(low).bit_length() - 1

    @staticmethod
    def depth_of(n: int) -> int:
        return max(0, (-(-n // LEAF) - 1).bit_length())

    @classmethod
    def build(cls, points: np.ndarray) -> Tree:
        n, width = points.shape
        depth, order = cls.depth_of(n), np.arange(n, dtype=np.int32)
        low, high, sums = (np.zeros((2 ** (depth + 1) - 1, width), np.int64) for _ in range(3))
        for level in range(depth + 1):
            for i in range(1 << level):
                start, end = i * n >> level, (i + 1) * n >> level
                if start == end:
                    continue
                here, at = points[start:end], (1 << level) - 1 + i
                low[at], high[at], sums[at] = here.min(axis=0), here.max(axis=0), here.sum(axis=0)
                if level < depth:
                    cut = ((2 * i + 1) * n >> (level + 1)) - start
                    if 0 < cut < end - start:
                        by = np.argpartition(here[:, np.argmax(high[at] - low[at])], cut)
                        points[start:end], order[start:end] = here[by], order[start:end][by]
        return cls(points, order, low, high, sums)

    def nearest(self, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(labels in tree order, sums and counts of each entry's points): the nearest entry, ties to the lower index.

        Down the levels each node keeps the entries that may be nearest to some point in its box: with z the entry
        nearest to the middle, another one goes if even the corner of the box farthest towards it is no nearer to it
        than to z. A node with one entry left is assigned whole, by its cached sum; leaves with more try those that are left.
        """
        n, k = len(self.points), len(entries)
        labels, sums, counts = np.zeros(n, np.int16), np.zeros_like(entries), np.zeros(k, np.int64)
        nodes, left = np.zeros(1, np.int64), np.ones((1, k), bool)
        for level in range(self.depth + 1):
            at = (1 << level) - 1 + nodes
            low, high = self.low[at][:, None], self.high[at][:, None]
            middle = np.where(left, ((low + high - 2 * entries) ** 2).sum(axis=2), np.iinfo(np.int64).max).argmin(axis=1)
            best = entries[middle][:, None]
            corner = np.where(entries > best, high, low)
            gap = ((corner - entries) ** 2).sum(axis=2) - ((corner - best) ** 2).sum(axis=2)
            left &= (gap < 0) | ((gap == 0) & (np.arange(k) <= middle[:, None]))
            start, end = nodes * n >> level, (nodes + 1) * n >> level
            whole = left.sum(axis=1) == 1
            for s, e, z, node in zip(start[whole], end[whole], middle[whole], at[whole], strict=True):
                labels[s:e] = z
                counts[z] += e - s
                sums[z] += self.sums[node]
            nodes, left, start, end = nodes[~whole], left[~whole], start[~whole], end[~whole]
            if level < self.depth:
                nodes, left = np.concatenate([2 * nodes, 2 * nodes + 1]), np.concatenate([left, left])
        size = end - start
        if size.sum():
            rows = np.repeat(start - np.concatenate([[0], size.cumsum()[:-1]]), size) + np.arange(size.sum())
            points = self.points[rows]
            far = np.where(np.repeat(left, size, axis=0), distances(points, entries), np.iinfo(np.int64).max)
            labels[rows] = found = far.argmin(axis=1)
            for z in range(k):
                own = points[found == z]
                counts[z] += len(own)
                sums[z] += own.sum(axis=0)
        return labels, sums, counts


def distances(points: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Squared distances of all points to all entries, exact."""
    out = np.zeros((len(points), len(entries)), np.int64)
    for j in range(points.shape[1]):
        step = points[:, j, None] - entries[None, :, j]
        out += step * step
    return out


def kept_vectors(vectors: DataFrame, vec_id: str, vector: str, label: str) -> DataFrame:
    """(vec_id, label, v): the integer components of the vectors that have no null or non-finite one."""
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    rows = vectors.select(col(vec_id).alias("vec_id"), col(label).alias("label"), col(vector).cast("array<double>").alias("v"))
    rows = rows.filter((F.size("v") > 0) & ~F.exists("v", bad))
    return rows.withColumn("v", F.transform("v", lambda x: F.floor(x * SCALE)))


def first_entries(rows: DataFrame, entries: int) -> np.ndarray | None:
    """The vectors of the smallest ids, (entries, width); ties of ids by components. None of an empty table."""
    first = rows.orderBy(F.col("vec_id").asc_nulls_last(), "v").limit(entries).select("v").collect()
    if not first:
        return None
    width = len(first[0]["v"])
    return np.array([r["v"] for r in first if len(r["v"]) == width], np.int64)


def padded(v: np.ndarray, parts: int) -> np.ndarray:
    """v with zeros after its components up to a multiple of parts."""
    return np.pad(v, ((0, 0), (0, -v.shape[1] % parts)))


def block_schema(rows: DataFrame) -> T.StructType:
    row = T.StructType([rows.schema["vec_id"], rows.schema["label"]])
    return T.StructType([T.StructField("rows", T.ArrayType(row)), *[T.StructField(c, T.BinaryType()) for c in ("points", "order", "low", "high", "sums")]])


def grown(rows: DataFrame, width: int, parts: int) -> DataFrame:
    """The trees of every block of a partition's rows, one block per output row; stored, as each round reads them."""

    def trees(ids: pa.Table, vectors: list[np.ndarray]) -> pa.RecordBatch:
        v = padded(np.concatenate(vectors), parts)
        if np.abs(v).max(initial=0) >= LARGEST:
            raise ValueError(f"a component of {LARGEST // SCALE} or more")
        made = [Tree.build(np.ascontiguousarray(p)) for p in np.split(v, parts, axis=1)]
        pack = lambda name, kind: np.concatenate([getattr(t, name).astype(kind).ravel() for t in made]).tobytes()
        row = pa.StructArray.from_arrays([ids.column(c).combine_chunks() for c in ("vec_id", "label")], ["vec_id", "label"])
        columns = {"points": pack("points", "<i4"), "order": pack("order", "<i4"), "low": pack("low", "<i4"), "high": pack("high", "<i4"), "sums": pack("sums", "<i8")}
        return pa.RecordBatch.from_arrays([pa.ListArray.from_arrays([0, len(row)], row), *[pa.array([c]) for c in columns.values()]], ["rows", *columns])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, vectors, held = [], [], 0
        for batch in batches:
            for at in range(0, len(batch), BLOCK):
                part = batch.slice(at, BLOCK)
                ids.append(part.select(["vec_id", "label"]))
                vectors.append(part.column("v").flatten().to_numpy().reshape(len(part), width))
                held += len(part)
                if held >= BLOCK:
                    yield trees(pa.Table.from_batches(ids), vectors)
                    ids, vectors, held = [], [], 0
        if held:
            yield trees(pa.Table.from_batches(ids), vectors)

    return stored(rows.filter(F.size("v") == width).mapInArrow(run, block_schema(rows)), "vector-trees", **{"parquet.block.size": 16 << 20})


def opened(batch: pa.RecordBatch, width: int, parts: int) -> Iterator[tuple[pa.Array, list[Tree]]]:
    """(rows, trees by part position) of each block."""
    rows, cells = batch.column("rows"), [batch.column(c) for c in ("points", "order", "low", "high", "sums")]
    for i in range(len(batch)):
        n = len(rows[i].values)
        nodes = 2 ** (Tree.depth_of(n) + 1) - 1
        shapes = [("<i4", (parts, n, width)), ("<i4", (parts, n)), ("<i4", (parts, nodes, width)), ("<i4", (parts, nodes, width)), ("<i8", (parts, nodes, width))]
        arrays = [np.frombuffer(c[i].as_buffer(), kind).reshape(shape) for c, (kind, shape) in zip(cells, shapes, strict=True)]
        points, order, low, high, sums = arrays
        yield rows[i].values, [Tree(points[p].astype(np.int64), order[p], low[p].astype(np.int64), high[p].astype(np.int64), sums[p]) for p in range(parts)]


def lloyd_round(trees: DataFrame, books: np.ndarray) -> np.ndarray:
    """The codebooks (parts, entries, width) after one round; only their own size comes to the driver."""
    parts, entries, width = books.shape
    kinds = {"part": pa.int32(), "entry": pa.int32(), "place": pa.int32(), "total": pa.int64(), "n": pa.int64()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, counts = np.zeros_like(books), np.zeros((parts, entries), np.int64)
        for batch in batches:
            for _, made in opened(batch, width, parts):
                for p, tree in enumerate(made):
                    _, s, c = tree.nearest(books[p])
                    sums[p] += s
                    counts[p] += c
        p, e, j = (x.ravel() for x in np.indices(books.shape))
        used = counts[p, e] > 0
        cells = [p, e, j, sums.ravel(), counts[p, e]]
        yield pa.RecordBatch.from_arrays([pa.array(c[used]).cast(k) for c, k in zip(cells, kinds.values(), strict=True)], list(kinds))

    cells = trees.mapInArrow(run, "part int, entry int, place int, total long, n long")
    out = books.copy()
    for r in cells.groupBy("part", "entry", "place").agg(F.sum("total").alias("total"), F.sum("n").alias("n")).collect():
        out[r["part"], r["entry"], r["place"]] = r["total"] // r["n"]
    return out


def encoded(trees: DataFrame, rows: DataFrame, books: np.ndarray) -> DataFrame:
    """(vec_id, label, code, error): the nearest entries of every row's parts, and their squared distances summed."""
    parts, entries, width = books.shape
    schema = T.StructType([rows.schema["vec_id"], rows.schema["label"], T.StructField("code", T.StringType()), T.StructField("error", T.LongType())])
    digits = max(2, len(f"{entries - 1:x}"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for own, made in opened(batch, width, parts):
                codes, error = np.zeros((len(own), parts), np.int64), np.zeros(len(own), np.int64)
                for p, tree in enumerate(made):
                    labels, _, _ = tree.nearest(books[p])
                    codes[tree.order, p] = labels
                    error[tree.order] += ((tree.points - books[p][labels]) ** 2).sum(axis=1)
                text = ["".join(f"{x:0{digits}x}" for x in c) for c in codes.tolist()]
                yield pa.RecordBatch.from_arrays([*own.flatten(), pa.array(text, pa.string()), pa.array(error)], ["vec_id", "label", "code", "error"])

    return trees.mapInArrow(run, schema)


def train(trees: DataFrame, first: np.ndarray, parts: int, rounds: int) -> np.ndarray:
    """The codebooks (parts, entries, width) after the rounds, begun at the parts of the first vectors."""
    books = np.stack(np.split(padded(first, parts), parts, axis=1))
    for _ in range(rounds):
        after = lloyd_round(trees, books)
        if np.array_equal(after, books):
            break  # a fixed point: further rounds change nothing
        books = after
    return books


def books_digest(books: np.ndarray | None) -> str:
    return hashlib.sha256(",".join(map(str, [] if books is None else books.ravel().tolist())).encode()).hexdigest()


def vector_codes(vectors: DataFrame, *, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, vec_id: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """One row per kept row: vec_id, code, error, label_error, codebooks_sha256.

    Components become floor(4096 x); vectors are cut into `parts` equal parts, zeros added at the end where the length
    is no multiple. Dropped are vectors that are null or empty or hold a null or non-finite component, and vectors of another
    length than the kept one with the least id. Null ids come last among the first entries, equal ids by components;
    repeated rows are coded each; fewer rows than entries give fewer entries; an empty table gives no rows. A component
    of 16,384 or more fails. label_error sums the errors of equal labels, nulls together. Other columns are ignored.
    """
    rows = kept_vectors(vectors, vec_id, vector, label)
    first = first_entries(rows, entries)
    if first is None:
        books = None
        codes = rows.select("vec_id", "label", F.lit("").alias("code"), F.lit(0).cast("long").alias("error")).limit(0)
    else:
        trees = grown(rows, first.shape[1], parts)
        books = train(trees, first, parts, rounds)
        codes = stored(encoded(trees, rows, books), "vector-codes")
        forget(trees)
    sums = codes.groupBy("label").agg(F.sum("error").alias("label_error"))
    both = codes.alias("c").join(sums.alias("s"), F.col("c.label").eqNullSafe(F.col("s.label")))
    return both.select("c.vec_id", "c.code", "c.error", "s.label_error", F.lit(books_digest(books)).alias("codebooks_sha256"))
