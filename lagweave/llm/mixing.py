"""Mixing sources to target weights by capped water-filling (DataFrame functions only)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import WORD, col, in_order, packed, stored

BINS = 4096
HASH_BITS = 60


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def draw(doc_id: Column, text: Column, seed: str) -> Column:
    """A seeded 60-bit number of the id and the text: the first 15 hex digits of md5(seed:id:md5(text))."""
    named = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), F.md5(F.coalesce(text, F.lit("")).cast("binary")))
    return F.conv(F.substring(F.md5(named.cast("binary")), 1, 15), 16, 10).cast("long")


def source_key(source: Column) -> Column:
    return F.coalesce(F.concat(F.lit("s"), source), F.lit("n"))


def water_fill(sources: DataFrame, total: float) -> float:
    """The level at which sum(min(cap, weight * level)) is total, for stored rows (weight, cap).

    Each round clamps the sources that the level lifts above their cap and shares what is left among the others by
    weight. The clamped set only grows, so the rounds end; a round is one aggregate of two numbers.
    """
    level, clamped = 0.0, -1
    while True:
        over = F.col("cap") < F.col("weight") * level
        r = sources.agg(
            F.count(F.when(over, 1)).alias("n"),
            F.coalesce(F.sum(F.when(over, F.col("cap"))), F.lit(0.0)).alias("held"),
            F.coalesce(F.sum(F.when(~over, F.col("weight"))), F.lit(0.0)).alias("free"),
        ).first()
        if r["n"] == clamped:
            return level
        clamped = r["n"]
        if r["free"] <= 0:
            return float("inf")
        level = max(level, (total - r["held"]) / r["free"])


class Mix:
    """What a mix takes: `sizes` (doc_id, source, size, h) per document and `plan`, one row per source.

    plan: key, source_size, target, whole (repetitions of every document), cut_bin, cut and cut_rows: documents before
    `cut` in draw order are taken once more, and of those at `cut` so many. Documents with one id and text draw alike.
    """

    def __init__(self, sizes: DataFrame, plan: DataFrame):
        self.sizes, self.plan = sizes, plan

    def taken(self, rows: DataFrame) -> DataFrame:
        """rows (row, size, key, h, id) with source_size, target and copies; the plan has one row per source.

        Of rows that are alike at the cut, the first by a hash of the whole row are taken once more. They are counted
        by that hash and a random number of BINS, so equal rows may be many; which of them are taken makes no difference.
        """
        b, place = F.shiftright("h", HASH_BITS - 12), F.struct("h", "id")
        side = F.when(F.col("cut_bin") > b, 1).when(F.col("cut_bin") < b, -1).when(F.col("cut").isNull() | (place > F.col("cut")), -1).when(place < F.col("cut"), 1).otherwise(0)
        mine = rows.join(self.plan, "key").withColumn("side", side)
        clear = mine.filter("side <> 0").select("row", "size", "source_size", "target", (F.col("whole") + F.greatest("side", F.lit(0))).alias("copies"))
        alike = mine.filter("side = 0").withColumn("order", F.xxhash64("row")).withColumn("salt", F.pmod(F.monotonically_increasing_id(), F.lit(BINS)))
        some = alike.groupBy("key", "order", "salt").agg(F.count("*").alias("n"), *[F.first(c).alias(c) for c in ("row", "size", "source_size", "target", "whole", "cut_rows")])
        before = F.coalesce(F.sum("n").over(Window.partitionBy("key").orderBy("order", "salt").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        more = F.greatest(F.lit(0), F.least(F.col("n"), F.col("cut_rows") - before))
        some = some.withColumn("more", more).withColumn("part", F.explode(F.array(F.struct(F.col("more").alias("n"), F.lit(1).alias("plus")), F.struct((F.col("n") - F.col("more")).alias("n"), F.lit(0).alias("plus")))))
        some = some.filter("part.n > 0").withColumn("one", F.explode(F.array_repeat(F.lit(1), F.col("part.n").cast("int"))))
        return clear.union(some.select("row", "size", "source_size", "target", F.col("whole") + F.col("part.plus")))


def plan_mix(docs: DataFrame, *, share: float = 1.5, max_epochs: float = 2.0, weights: Sequence[float] = (3.0, 1.0, 2.0), seed: str = "mix-1", doc_id: str = "doc_id", text: str = "text", source: str = "source") -> Mix:
    """Plan a mix of `share` times all words.

    Sources in code-point order (null last) get the weights in turn. Targets stop at max_epochs times a source's size;
    the excess goes to the others by weight. A source takes every document floor(target/size) times and, for the
    fraction left, the documents that come first by seeded draw, up to the one whose middle passes the target, so
    words taken lie within half a document of the target, and no document is taken more often than max_epochs, rounded
    up. Null texts and texts without words have size 0. Null ids draw like an empty id; rows with one id and text draw
    alike and are counted as one row with a number, so any number of them may be taken. An empty table gives an empty
    plan. No group is collected: draws are summed in bins first, and only the bin in which a source's target falls is
    ordered.
    """
    sizes = stored(docs.select(col(doc_id).alias("doc_id"), col(source).alias("source"), words(col(text)).alias("size"), draw(col(doc_id), col(text), seed).alias("h")), "mix-sizes")
    per_source = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    ordered = in_order(per_source, [F.col("source").asc_nulls_last()], "mix-sources")
    turn = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("pos") % len(weights) + 1).cast("int"))
    ordered = ordered.select("source", "source_size", turn.alias("weight"), (F.col("source_size") * F.lit(float(max_epochs))).alias("cap"))
    total = ordered.agg(F.sum("source_size")).first()[0] or 0
    level = water_fill(ordered, share * total)
    lifted = F.least("cap", F.col("weight") * F.lit(level)) if level != float("inf") else F.col("cap")
    plan = ordered.select(source_key(F.col("source")).alias("key"), "source_size", lifted.alias("target"))
    plan = plan.withColumn("whole", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("int"))
    plan = plan.withColumn("left", F.col("target") - F.col("whole") * F.col("source_size"))

    keyed = sizes.select(source_key(F.col("source")).alias("key"), F.shiftright("h", HASH_BITS - 12).alias("bin"), "h", "doc_id", "size")
    bins = keyed.groupBy("key", "bin").agg(F.sum("size").alias("n"))
    up_to = Window.partitionBy("key").orderBy("bin").rowsBetween(Window.unboundedPreceding, Window.currentRow)  # BINS rows a source at most
    bins = bins.withColumn("upto", F.sum("n").over(up_to)).join(plan.filter("left > 0").select("key", "left"), "key").filter(F.col("upto") > F.col("left"))
    cut_bins = bins.groupBy("key").agg(F.min(F.struct("bin", (F.col("upto") - F.col("n")).alias("before"), "left")).alias("c")).select("key", "c.*")
    cut_bins = stored(cut_bins, "mix-cuts")
    inside = keyed.join(cut_bins, ["key", "bin"]).groupBy("key", "h", "doc_id").agg(F.count("*").alias("n"), F.first("size").alias("size"), F.first("before").alias("before"), F.first("left").alias("left"))
    first = Window.partitionBy("key").orderBy("h", "doc_id").rowsBetween(Window.unboundedPreceding, -1)
    missing = F.col("left") - F.col("before") - F.coalesce(F.sum(F.col("n") * F.col("size")).over(first), F.lit(0))
    fits = F.when(missing <= 0, 0).when(F.col("size") == 0, F.col("n")).otherwise(F.least(F.col("n"), F.ceil(missing / F.greatest("size", F.lit(1)) - 0.5)))
    inside = inside.select("key", F.struct("h", F.col("doc_id").alias("id")).alias("cut"), fits.cast("long").alias("cut_rows")).filter("cut_rows > 0")
    cuts = inside.groupBy("key").agg(F.max(F.struct("cut", "cut_rows")).alias("c")).select("key", "c.*")
    plan = plan.join(cut_bins.select("key", F.col("bin").alias("cut_bin")), "key", "left").join(cuts, "key", "left")
    plan = plan.select("key", "source_size", "target", "whole", F.coalesce(F.col("cut_bin"), F.when(F.col("left") > 0, BINS).otherwise(-1)).alias("cut_bin"), "cut", "cut_rows")
    return Mix(sizes, stored(plan, "mix-plan"))


def mix(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", source: str = "source", seed: str = "mix-1", **options) -> DataFrame:
    """docs with each row repeated as often as the mix takes it (not at all, once, or more); columns unchanged."""
    m = plan_mix(docs, doc_id=doc_id, text=text, source=source, seed=seed, **options)
    rows = docs.select(packed(docs), words(col(text)).alias("size"), source_key(col(source)).alias("key"), draw(col(doc_id), col(text), seed).alias("h"), col(doc_id).alias("id"))
    return m.taken(rows).filter("copies > 0").select("row", F.explode(F.array_repeat(F.lit(1), F.col("copies")))).select("row.*")


def mix_report(docs: DataFrame, **options) -> DataFrame:
    """One row per document: doc_id, size, source_size, target, taken (words, repetitions counted), copies."""
    m = plan_mix(docs, **options)
    rows = m.sizes.select(F.struct("doc_id").alias("row"), "size", source_key(F.col("source")).alias("key"), "h", F.col("doc_id").alias("id"))
    return m.taken(rows).select("row.doc_id", "size", "source_size", F.round("target", 6).alias("target"), (F.col("size") * F.col("copies")).cast("long").alias("taken"), F.col("copies").cast("long").alias("copies"))
