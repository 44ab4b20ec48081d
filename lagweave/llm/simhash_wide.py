"""Near-dedup at a stated shingle similarity: SimHash fingerprints, prefix filtering for the rest, decided by the exact similarity.

Fingerprints linked by the pigeonring search of operator 9 are the first candidates: copies with few changes. At 0.8
some 15 % of the bits differ, so that no key of a fingerprint is sure to be shared; the pairs which the fingerprints
miss are found on the shingles themselves, where a bound holds.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import col, forget, packed, stored
from .components import components
from .lm_score import scrambled, word_hashes
from .simhash import BITS as SIM_BITS
from .simhash import link

MIXERS = np.random.default_rng(12).integers(0, 2**63, 32, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
#: Shingles are counted in 2^CELL_BITS cells, a byte each for the workers, added up in CELL_CHUNKS parts.
CELL_BITS, CELL_CHUNKS = 24, 256
#: Cells in a worker's memory before it hands them on, and steps of a doubling in which counts are told apart.
FLUSH, STEPS = 4_000_000, 8
#: Bits of a text's parities, and the columns that hold them.
BITS, PARITY = 256, ["p0", "p1", "p2", "p3"]
#: Texts that are hashed together: at most so many, of about so many bytes.
GROUP_TEXTS, GROUP_BYTES = 250, 1_000_000
#: A longer text is read in pieces of about so many bytes, which end between words.
CHUNK = 1_000_000
#: Rows named by (id, hash) are broadcast up to this many (some 64 bytes each), and joined by a shuffle beyond it.
BROADCAST_ROWS = 400_000
#: Shingles whose bits are counted at once.
UNPACKED = 65_536
#: Against rounding where a similarity times a size is whole.
EPS = 1e-9


def pieces(data: bytes) -> Iterator[bytes]:
    at = 0
    while at < len(data):
        end = min(at + CHUNK, len(data))
        while end < len(data) and data[end] not in b" \t\n\v\f\r":
            end += 1
        yield data[at:end]
        at = end


def grouped(texts: pa.Array) -> Iterator[tuple[int, list[bytes]]]:
    """(number of the first, texts in UTF-8) of whole texts that are hashed together; a null is the empty text."""
    part, size, first = [], 0, 0
    for i, t in enumerate(texts.cast(pa.binary())):
        data = t.as_py() or b""
        if part and (len(part) == GROUP_TEXTS or size + len(data) > GROUP_BYTES):
            yield first, part
            part, size, first = [], 0, i
        part.append(data)
        size += len(data)
    if part:
        yield first, part


def shingles(texts: list[bytes], n: int) -> tuple[np.ndarray, np.ndarray]:
    """(text number, 64-bit hash) of every run of n words, text by text; a text of fewer words, but not none, is one run."""
    if len(texts) == 1:
        words = [word_hashes(p)[0] for p in pieces(texts[0])]
        w = np.concatenate(words) if words else np.zeros(0, np.uint64)
        text = np.zeros(len(w), np.int64)
    else:
        w, first = word_hashes(b" ".join(texts))
        text = np.searchsorted(np.cumsum([len(t) + 1 for t in texts]), first, side="right")
    count = np.bincount(text, minlength=len(texts))
    ends = max(0, len(w) - n + 1)
    run = sum((w[i : ends + i] * MIXERS[i] for i in range(n)), np.zeros(ends, np.uint64))
    whole = text[:ends] == text[n - 1 :]
    text_of, run = text[:ends][whole], run[whole]
    short = np.flatnonzero((count > 0) & (count < n))
    if len(short):
        start, more = (np.cumsum(count) - count)[short], np.zeros(len(short), np.uint64)
        for i in range(n - 1):
            has = count[short] > i
            more[has] += w[start[has] + i] * MIXERS[i]
        text_of, run = np.concatenate([text_of, short]), np.concatenate([run, more])
        order = np.argsort(text_of, kind="stable")
        text_of, run = text_of[order], run[order]
    return text_of, scrambled(run)


def shingle_sets(texts: list[bytes], n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text number, shingle) of the distinct shingles, by text and hash, and one hash of each text's set (none: 0)."""
    text, run = shingles(texts, n)
    order = np.argsort(run)
    order = order[np.argsort(text[order].astype(np.uint8 if len(texts) <= 256 else np.int64), kind="stable")]
    text, run = text[order], run[order]
    new = np.ones(len(run), bool)
    new[1:] = (run[1:] != run[:-1]) | (text[1:] != text[:-1])
    text, run = text[new], run[new]
    node, there = np.zeros(len(texts), np.uint64), np.flatnonzero(np.bincount(text, minlength=len(texts)))
    if len(there):
        node[there] = scrambled(np.add.reduceat(scrambled(run), np.searchsorted(text, there)))
    return text, run, node


def prefixes(text: np.ndarray, run: np.ndarray, texts: int, rarity: np.ndarray, similarity: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(sizes, offsets, shingles): the first n - ceil(similarity * n) + 1 of each text's n shingles, rarest first.

    The order is the same for every text. Two sets at least so similar share one of these: were the first common
    shingle beyond either prefix, fewer than similarity * n could be common.
    """
    size = np.bincount(text, minlength=texts)
    level = rarity[cells(run, len(rarity))]
    order = np.argsort((text.astype(np.uint16) << np.uint16(8)) | level, kind="stable")  # GROUP_TEXTS and levels have 8 bits each
    length = np.where(size > 0, size - np.ceil(similarity * size - EPS).astype(np.int64) + 1, 0)
    place = np.arange(len(run)) - (np.cumsum(size) - size)[text]
    return size, np.concatenate([[0], np.cumsum(length)]), run[order][place < length[text]]


def cells(run: np.ndarray, total: int) -> np.ndarray:
    """The cell of each hash, by its first bits; total is a power of two."""
    return (run >> np.uint64(65 - total.bit_length())).astype(np.int64)


def parities(text: np.ndarray, run: np.ndarray, texts: int) -> list[np.ndarray]:
    """BITS bits of each text's set of shingles, 64 to an array: bit j is the parity of how many have hashes ending in j.

    Where two texts' bits differ, a shingle is in one of the sets alone: their sets differ in no fewer shingles than that.
    """
    odd = np.bincount(text * BITS + (run % np.uint64(BITS)).astype(np.int64), minlength=texts * BITS) & 1
    packed_bits = np.packbits(odd.astype(np.uint8).reshape(texts, BITS), axis=1, bitorder="little")
    return list(np.ascontiguousarray(packed_bits).view("<i8").T)


def fingerprints(text: np.ndarray, run: np.ndarray, texts: int) -> np.ndarray:
    """The SimHash of each text's set of shingles: a bit is set if it is in over half their hashes; none: 0."""
    sums = np.zeros((texts, SIM_BITS), np.int64)
    for at in range(0, len(run), UNPACKED):
        bits = np.unpackbits(run[at : at + UNPACKED].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        own, first = np.unique(text[at : at + UNPACKED], return_index=True)
        sums[own] += np.add.reduceat(bits, first, axis=0, dtype=np.int64)
    odd = 2 * sums > np.bincount(text, minlength=texts)[:, None]
    return np.packbits(odd, axis=1, bitorder="little").view("<i8").reshape(-1)


def fingerprint_pairs(nodes: DataFrame) -> DataFrame:
    """Pairs (a, b) of nodes (node, fp) for every link of their fingerprints, those of one fingerprint by its least node."""
    one = nodes.groupBy("fp").agg(F.min("node").alias("least"))
    same = nodes.join(one, "fp").filter("node <> least").select(F.col("least").alias("a"), F.col("node").alias("b"))
    ends = link(one.select("fp")).join(one.select(F.col("fp").alias("a"), F.col("least").alias("x")), "a").join(one.select(F.col("fp").alias("b"), F.col("least").alias("y")), "b")
    return same.union(ends.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))).distinct()


def near_enough(x: str, y: str, similarity: float) -> Column:
    """Whether two texts' parities allow them to be similar: at most (n + m)(1 - s) / (1 + s) shingles are in one set alone."""
    off = sum((F.bit_count(F.col(f"{x}.{b}").bitwiseXOR(F.col(f"{y}.{b}"))) for b in PARITY[1:]), F.bit_count(F.col(f"{x}.{PARITY[0]}").bitwiseXOR(F.col(f"{y}.{PARITY[0]}"))))
    return off <= (F.col(f"{x}.size") + F.col(f"{y}.size")) * ((1 - similarity) / (1 + similarity)) + EPS


def in_gaps(numbers: np.ndarray) -> bytes:
    """Sorted numbers as gaps of a byte each; 255 goes on in the next byte."""
    gaps = np.diff(numbers, prepend=0)
    out = np.full(int((gaps // 255).sum()) + len(gaps), 255, np.uint8)
    out[np.cumsum(gaps // 255 + 1) - 1] = gaps % 255
    return out.tobytes()


def of_gaps(data: bytes) -> np.ndarray:
    gaps = np.frombuffer(data, np.uint8)
    return np.cumsum(gaps, dtype=np.int64)[gaps != 255]


def rarities(docs: DataFrame, text: str, shingle: int) -> np.ndarray:
    """A byte for each cell of shingle hashes: floor(STEPS log2) of how often they come in all texts.

    It orders the shingles of a text, and no result depends on it; the table has the same size for any input. A task
    hands on its cells as a byte a shingle, and the parts of the cells are added up as they stream in.
    """
    total, width = 1 << CELL_BITS, (1 << CELL_BITS) // CELL_CHUNKS

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def flush() -> pa.RecordBatch:
            found = np.sort(np.concatenate(held)).astype(np.int64)
            cuts = np.searchsorted(found, np.arange(CELL_CHUNKS + 1) * width)
            rows = [(k, in_gaps(found[a:b] - k * width)) for k, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)) if a < b]
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array([k for k, _ in rows], pa.int32()), pa.array([g for _, g in rows], pa.binary())], ["part", "gaps"])

        for batch in batches:
            for _, part in grouped(batch.column(0)):
                held.append(cells(shingles(part, shingle)[1], total).astype(np.uint32))
                size += len(held[-1])
                if size > FLUSH:
                    yield flush()
                    size = 0
        if size:
            yield flush()

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for part, gaps in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                sums[part] = sums.get(part, 0) + np.bincount(of_gaps(gaps.as_py()), minlength=width)
        done = [np.minimum(255, np.floor(STEPS * np.log2(np.maximum(x, 1)))).astype(np.uint8).tobytes() for x in sums.values()]
        yield pa.RecordBatch.from_arrays([pa.array([*sums], pa.int32()), pa.array(done, pa.binary())], ["part", "levels"])

    parts = docs.select(col(text).alias("text")).mapInArrow(count, "part int, gaps binary")
    table = np.zeros(total, np.uint8)
    for r in parts.repartition("part").mapInArrow(add, "part int, levels binary").collect():  # CELL_CHUNKS rows, 2^CELL_BITS bytes in all
        table[r["part"] * width : (r["part"] + 1) * width] = np.frombuffer(r["levels"], np.uint8)
    return table


def with_prefixes(docs: DataFrame, doc_id: str, text: str, shingle: int, similarity: float) -> DataFrame:
    """(doc_id, tid, node, size, fp, p0 ..., keys): fp is the SimHash, node the hash of the shingle set, by which equal ones are one; keys its prefix."""
    shared = docs.sparkSession.sparkContext.broadcast(rarities(docs, text, shingle))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, part in grouped(batch.column(2)):
                which, runs, node = shingle_sets(part, shingle)
                size, offsets, keys = prefixes(which, runs, len(part), shared.value, similarity)
                keys = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(keys.view(np.int64)))
                rows = batch.slice(first, len(part))
                yield pa.RecordBatch.from_arrays([rows.column(0), rows.column(1), pa.array(node.view(np.int64)), pa.array(size, pa.int64()), pa.array(fingerprints(which, runs, len(part))), *map(pa.array, parities(which, runs, len(part))), keys], ["doc_id", "tid", "node", "size", "fp", *PARITY, "keys"])

    return named(docs, doc_id, text).mapInArrow(run, f"doc_id long, tid long, node long, size long, fp long, {', '.join(f'{p} long' for p in PARITY)}, keys array<long>")


def named(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    return docs.select(col(doc_id).cast("long").alias("doc_id"), F.xxhash64(col(text)).alias("tid"), col(text).alias("text"))


def same_row(a: str, b: str) -> Column:
    return F.col(f"{a}.doc_id").eqNullSafe(F.col(f"{b}.doc_id")) & (F.col(f"{a}.tid") == F.col(f"{b}.tid"))


def few(rows: DataFrame) -> DataFrame:
    """Stored rows, marked for broadcast if their number allows it."""
    return F.broadcast(rows) if rows.count() <= BROADCAST_ROWS else rows


def may_reach(n: Column, i: Column, m: Column, j: Column, similarity: float) -> Column:
    """Whether sets of n and m shingles can be similar enough, their first common one being at place i and j (from 0).

    One of the shared keys is the first common one, so a pair that is dropped at every other key stays there.
    """
    return (F.least(n - i, m - j) + EPS) * (1 + similarity) >= (n + m) * similarity


def verified(pairs: DataFrame, nodes: DataFrame, docs: DataFrame, doc_id: str, text: str, shingle: int, similarity: float) -> DataFrame:
    """The pairs (a, b) of nodes whose exact Jaccard similarity over all their shingles is at least `similarity`; stored."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, part in grouped(batch.column(1)):
                which, runs, _ = shingle_sets(part, shingle)
                offsets = np.searchsorted(which, np.arange(len(part) + 1))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, len(part)), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(runs.view(np.int64)))], ["node", "runs"])

    ends = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()
    wanted = stored(ends.join(nodes.select("node", "doc_id", "tid"), "node"), "near-wanted")
    texts = named(docs, doc_id, text).alias("t").join(few(wanted).alias("w"), same_row("t", "w"))
    texts = texts.groupBy("w.node").agg(F.first("text").alias("text"))
    sets = stored(texts.mapInArrow(run, "node long, runs array<long>"), "near-sets")
    left = sets.select(F.col("node").alias("a"), F.col("runs").alias("runs_a"))
    right = sets.select(F.col("node").alias("b"), F.col("runs").alias("runs_b"))
    both = pairs.join(left, "a").join(right, "b").withColumn("common", F.size(F.array_intersect("runs_a", "runs_b")))
    found = stored(both.filter(F.col("common") / (F.size("runs_a") + F.size("runs_b") - F.col("common")) >= similarity).select("a", "b"), "near-similar")
    forget(wanted, sets)
    return found


def similar_groups(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", shingle: int = 5, similarity: float = 0.8) -> DataFrame:
    """Every row's doc_id, tid, node, root: the component of texts linked at shingle similarity `similarity` or more; stored.

    Equal sets of shingles (all copies, all texts without words) are one node. Nodes that share a key, a shingle in both
    prefixes, are candidates, which no pair of that similarity misses; sizes and places prune them, and the exact
    similarity decides. Before that, nodes whose fingerprints the pigeonring search links are held against each other, and
    pairs decided there aren't again. First each key's members meet one of them only, that which shares most keys with others: a
    group of near copies has its middle there, and links to it at the cost of its size. Then the members of a key
    outside its largest component meet the others, so that no link is lost; pairs whose parities are too far apart end
    within that join, so texts of few words that share keys without being similar make no rows. Null ids and texts, empty and very long
    texts, repeated rows and empty tables have their groups like any other; words and sets of shingles are told apart
    by 64-bit hashes.
    """
    check = {"doc_id": doc_id, "text": text, "shingle": shingle, "similarity": similarity}
    rows = stored(with_prefixes(docs, **check), "near-rows")
    nodes = rows.groupBy("node").agg(*[F.first(c).alias(c) for c in ("doc_id", "tid", "size", "keys")])
    keys = nodes.select("node", "size", F.posexplode("keys").alias("at", "key"))
    place = F.shiftleft("size", 32).bitwiseOR(F.col("at").cast("long"))  # one row of three numbers moves for each key
    members = keys.select("key", "node", place.alias("place")).withColumn("n", F.count("*").over(Window.partitionBy("key"))).filter("n > 1")
    members = stored(members.select("key", "node", F.shiftright("place", 32).alias("size"), F.col("place").bitwiseAND(F.lit(2**32 - 1)).alias("at"), "n"), "near-members")
    first = rows.groupBy("node").agg(F.min(F.struct("doc_id", "tid")).alias("x")).select("node", "x.*")
    shares = members.groupBy("node").agg(F.sum("n").alias("shares"))
    ranked = stored(members.drop("n").join(shares, "node"), "near-ranked")
    middle = ranked.groupBy("key").agg(F.max(F.struct("shares", "node", "size", "at")).alias("m")).select("key", "m")
    reach = may_reach(F.col("size"), F.col("at"), F.col("m.size"), F.col("m.at"), similarity)
    meet = ranked.join(middle, "key").filter(F.col("node") != F.col("m.node")).filter(reach)
    meet = meet.select(F.least("m.node", "node").alias("a"), F.greatest("m.node", "node").alias("b")).distinct()
    alike = stored(fingerprint_pairs(stored(rows.filter("size > 0").groupBy("node").agg(F.first("fp").alias("fp")), "near-prints")), "near-alike")
    meet = stored(meet.union(alike).distinct(), "near-meet")
    stars = verified(meet, first, docs, **check)
    found = stored(components(stars), "near-found")
    label = stored(ranked.join(found, "node", "left").select("key", "node", "size", "at", F.coalesce("root", "node").alias("root")), "near-labels")
    sizes = label.groupBy("key", "root").agg(F.count("*").alias("n")).groupBy("key").agg(F.max(F.struct("n", "root")).alias("top"), F.count("*").alias("roots")).filter("roots > 1")
    bits = rows.groupBy("node").agg(*[F.first(p).alias(p) for p in PARITY])
    mixed = stored(label.join(sizes.select("key", F.col("top.root").alias("main")), "key").join(bits, "node"), "near-mixed")
    apart = mixed.filter("root <> main").alias("x").join(mixed.alias("y"), (F.col("x.key") == F.col("y.key")) & (F.col("x.root") != F.col("y.root")) & ((F.col("y.root") == F.col("y.main")) | (F.col("x.node") < F.col("y.node"))))
    apart = apart.filter(may_reach(F.col("x.size"), F.col("x.at"), F.col("y.size"), F.col("y.at"), similarity) & near_enough("x", "y", similarity))
    apart = apart.select(F.least("x.node", "y.node").alias("a"), F.greatest("x.node", "y.node").alias("b")).distinct()
    apart = stored(apart.join(meet, ["a", "b"], "left_anti"), "near-apart")
    more = verified(apart, first, docs, **check)
    if more.head(1):
        forget(found)
        found = stored(components(stars.union(more)), "near-found")
    out = rows.select("doc_id", "tid", "node").join(found, "node", "left")
    out = stored(out.select("doc_id", "tid", "node", F.coalesce("root", "node").alias("root")), "near-groups")
    forget(rows, members, ranked, alike, meet, stars, label, mixed, apart, more, found)
    return out


def keep_one(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """docs with one row of each component of similar texts: that with the least id (null ids last); columns unchanged."""
    groups = similar_groups(docs, doc_id=doc_id, text=text, **options)
    last = F.coalesce("doc_id", F.lit(2**63 - 1))
    keep = stored(groups.groupBy("root").agg(F.min(F.struct(last.alias("o"), "doc_id", "tid")).alias("k")), "near-keep")
    kept = F.col("doc_id").eqNullSafe(F.col("k.doc_id")) & (F.col("tid") == F.col("k.tid"))
    marked = groups.join(keep, "root").select("doc_id", "tid", kept.alias("kept")).groupBy("doc_id", "tid", "kept").agg(F.count("*").alias("n"))
    # what doesn't simply stay: rows of other texts of a group, and the row that stays where it is there more than once
    marked = stored(marked.filter("not kept or n > 1"), "near-marked")
    forget(groups, keep)
    away = few(marked)
    rows = docs.select(packed(docs), col(doc_id).cast("long").alias("doc_id"), F.xxhash64(col(text)).alias("tid"))
    rest = rows.alias("r").join(away.alias("m"), same_row("r", "m"), "left_anti").select("row.*")
    again = rows.alias("r").join(away.filter("kept").alias("m"), same_row("r", "m"), "left_semi")
    return rest.union(again.groupBy("doc_id", "tid").agg(F.first("row").alias("row")).select("row.*"))
