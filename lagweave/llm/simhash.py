"""SimHash near-dedup: fingerprints of word shingles, linked by pigeonring-filtered Hamming search."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import col, packed, stored
from .components import components

BITS, RADIUS = 64, 2
#: Three segments around the ring: (first bit, bits).
SEGMENTS = ((0, 22), (22, 21), (43, 21))
#: Buckets of at most this many fingerprints are searched by pairs; in larger ones fingerprints meet at their midpoints.
PAIRS_UP_TO = 64
CHUNK = 1 << 22


def word_chunks(data: bytes) -> Iterator[list[bytes]]:
    """The words of a text, from pieces of about CHUNK bytes that end between words."""
    at = 0
    while at < len(data):
        end = min(at + CHUNK, len(data))
        while end < len(data) and data[end] not in b" \t\n\v\f\r":
            end += 1
        yield data[at:end].split()
        at = end


def fingerprint(text: str | None, shingle: int, seed: int = 42) -> int:
    """Unsigned SimHash of a whole text: a bit is set if it is in over half the shingles' XXH64; no words: 0."""
    sums, n, tail = np.zeros(BITS, np.int64), 0, []
    digest = xxhash.xxh64_intdigest

    def add(shingles: Iterable[bytes]) -> int:
        h = np.array([digest(s, seed) for s in shingles], np.uint64)
        for i in range(0, len(h), 65536):
            sums[:] += np.unpackbits(h[i : i + 65536].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        return len(h)

    for words in word_chunks((text or "").encode("utf-8", "surrogatepass").lower()):
        words = tail + words
        n += add(map(b" ".join, zip(*(words[i:] for i in range(shingle)), strict=False)))
        tail = words[max(0, len(words) - shingle + 1) :]
    if not n and tail:
        n = add([b" ".join(tail)])
    bits = np.flatnonzero(2 * sums > n) if n else ()
    return sum(1 << int(b) for b in bits)


def with_fingerprints(docs: DataFrame, doc_id: str, text: str, shingle: int) -> DataFrame:
    """(doc_id, tid, fp): tid is a hash of the text that tells rows with one id apart."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.array([fingerprint(t.as_py(), shingle) for t in batch.column(2)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(fps, pa.int64())], ["doc_id", "tid", "fp"])

    rows = docs.select(col(doc_id).cast("long").alias("doc_id"), F.xxhash64(col(text)).alias("tid"), col(text).alias("text"))
    return rows.mapInArrow(run, "doc_id long, tid long, fp long")


def segment(x: Column, i: int) -> Column:
    first, bits = SEGMENTS[i % len(SEGMENTS)]
    return F.shiftrightunsigned(x, first).bitwiseAND(F.lit((1 << bits) - 1))


def halves(i: int) -> list[tuple[int, int]]:
    """(first bit, bits) of the two halves of a segment."""
    first, bits = SEGMENTS[i % len(SEGMENTS)]
    low = (bits + 1) // 2
    return [(first, low), (first + low, bits - low)]


def chain_keys(fps: DataFrame) -> DataFrame:
    """(key, start, half, fp): what two fingerprints must share for a chain that starts at segment `start`.

    Pigeonring: if all differences sum to at most 2 over 3 segments, then from some segment on, the first l segments
    differ in at most floor(2l/3) bits: 0, 1, 2. So the first is equal, and of the next, which differs in one bit at
    most, one half is equal: key = first segment and that half.
    """
    keys = []
    for i in range(len(SEGMENTS)):
        for h, (first, bits) in enumerate(halves(i + 1)):
            half = F.shiftrightunsigned("fp", first).bitwiseAND(F.lit((1 << bits) - 1))
            key = F.shiftleft(segment(F.col("fp"), i), 11).bitwiseOR(half).bitwiseOR(F.lit((2 * i + h) << 40))
            keys.append(F.struct(key.alias("key"), F.lit(i).alias("start"), F.lit(h).alias("half")))
    return fps.select("fp", F.explode(F.array(*keys)).alias("k")).select("k.*", "fp")


def chain_holds(x: Column, start: Column) -> Column:
    """Whether the differences x stay within the budgets 0, 1, 2 along the chain from segment `start`."""
    fits = F.lit(False)
    for i in range(len(SEGMENTS)):
        one = F.bit_count(segment(x, i))
        two = one + F.bit_count(segment(x, i + 1))
        fits = F.when(start == i, (one <= RADIUS // 3) & (two <= 2 * RADIUS // 3) & (F.bit_count(x) <= RADIUS)).otherwise(fits)
    return fits


def link(fps: DataFrame) -> DataFrame:
    """Edges (a, b) between distinct fingerprints at 2 or fewer differing bits, enough of them for every component.

    Buckets of one chain key are searched by pairs while small. In a larger one each fingerprint is sent to itself and
    to the points one free bit away: two lie within 2 exactly if they meet at such a point, where each links to the
    least. That is linear in the bucket, exact, and spreads a hot bucket over its points (33 or fewer meet at one).
    """
    keys = chain_keys(fps)
    sizes = keys.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1")
    members = stored(keys.join(sizes, "key"), "simhash-members")
    small = members.filter(F.col("n") <= PAIRS_UP_TO).select("key", "start", "fp")
    pairs = small.alias("x").join(small.alias("y"), (F.col("x.key") == F.col("y.key")) & (F.col("x.fp") < F.col("y.fp")) & chain_holds(F.col("x.fp").bitwiseXOR(F.col("y.fp")), F.col("x.start")))
    pairs = pairs.select(F.col("x.fp").alias("a"), F.col("y.fp").alias("b"))

    free = []
    for i in range(len(SEGMENTS)):
        for h, (first, bits) in enumerate(halves(i + 1)):
            fixed = {*range(SEGMENTS[i][0], sum(SEGMENTS[i])), *range(first, first + bits)}
            flips = [0] + [(1 << b) - (1 << 64 if b == 63 else 0) for b in range(BITS) if b not in fixed]
            free.append(((F.col("start") == i) & (F.col("half") == h), F.array(*[F.lit(f).cast("long") for f in flips])))
    flips = F.coalesce(*[F.when(c, a) for c, a in free])
    points = members.filter(F.col("n") > PAIRS_UP_TO).select("key", "fp", F.explode(flips).alias("flip"))
    met = points.groupBy("key", F.col("fp").bitwiseXOR(F.col("flip")).alias("z")).agg(F.collect_set("fp").alias("fps")).filter(F.size("fps") > 1)
    stars = met.select(F.array_min("fps").alias("a"), F.explode("fps").alias("b")).filter("a <> b")
    return pairs.union(stars).distinct()


def near_groups(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", shingle: int = 5) -> DataFrame:
    """Every row's fingerprint and component: doc_id, tid, fp, component_id (least doc_id reachable), root.

    Words are runs without ASCII white space, A-Z lower-cased; shingles repeat as often as they occur; a text of fewer
    words is one shingle; null, empty and blank texts have fingerprint 0, linked like any other. Texts of any length
    are read whole in pieces. Null ids count as none: a component of null ids only has a null id. Repeated rows share
    their component. Equal fingerprints are one node, so copies never make pairs.
    """
    rows = stored(with_fingerprints(docs, doc_id, text, shingle), "simhash-rows")
    fps = stored(rows.groupBy("fp").agg(F.min("doc_id").alias("least")), "simhash-fps")
    found = stored(components(stored(link(fps.select("fp")), "simhash-links")), "simhash-components")
    nodes = fps.join(found.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    ids = found.withColumnRenamed("node", "fp").join(fps, "fp").groupBy("root").agg(F.min("least").alias("first"))
    nodes = nodes.join(ids, "root", "left").select("fp", "root", F.coalesce("first", "least").alias("component_id"))
    return rows.join(nodes, "fp").select("doc_id", "tid", "fp", "component_id", "root")


def near_report(docs: DataFrame, **options) -> DataFrame:
    """near_groups as doc_id, fingerprint (16 hex digits), component_id."""
    return near_groups(docs, **options).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def near_dedup(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", shingle: int = 5) -> DataFrame:
    """docs with one row of each component, that with the least id; columns unchanged.

    Of repeated rows with that id one stays. A component without any id keeps all its rows, as none can be named.
    """
    groups = near_groups(docs, doc_id=doc_id, text=text, shingle=shingle)
    nameless = F.col("component_id").isNull()
    keep = groups.filter((F.col("doc_id") == F.col("component_id")) | nameless)
    named = keep.filter(~nameless).groupBy("doc_id", "root").agg(F.min("tid").alias("tid")).select("doc_id", "tid")
    keep = named.union(keep.filter(nameless).select("doc_id", "tid").distinct())
    rows = docs.select(packed(docs), col(doc_id).cast("long").alias("doc_id"), F.xxhash64(col(text)).alias("tid"))
    kept = rows.alias("r").join(keep.alias("k"), F.col("r.doc_id").eqNullSafe(F.col("k.doc_id")) & (F.col("r.tid") == F.col("k.tid")), "left_semi")
    some = kept.groupBy("doc_id", "tid").agg(F.first("row").alias("row")).filter("doc_id is not null")
    return some.select("row.*").union(kept.filter("doc_id is null").select("row.*"))
