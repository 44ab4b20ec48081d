"""Exact dedup by batches: binary-fuse filters of immutable snapshots screen the digests of later batches."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import fusefilter
from .common import col, forget, id_remainder, lower_ascii, stored

PER_BUCKET = 65_536
#: Digests of duplicated texts up to this many are broadcast for the byte check (about 100 bytes each); beyond it they are joined.
BROADCAST_DIGESTS = 300_000


def normalised(text: Column) -> Column:
    return lower_ascii(F.coalesce(text, F.lit("")))


def digest(text: Column) -> Column:
    return F.sha2(normalised(text).cast("binary"), 256)


def key64(sha: Column) -> Column:
    """The first 60 bits of a digest, as a long."""
    return F.conv(F.substring(sha, 1, 15), 16, 10).cast("long")


def build_filters(groups: DataFrame, buckets: int) -> DataFrame:
    """(snapshot, bucket, filter) of rows (batch, digest): one static filter per snapshot and digest bucket."""

    def one(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"snapshot": [key[0]], "bucket": [key[1]], "filter": [fusefilter.build(rows["key"].to_numpy())]})

    rows = groups.select("batch", bucket(F.col("digest"), buckets).alias("bucket"), key64(F.col("digest")).alias("key"))
    return rows.groupBy("batch", "bucket").applyInPandas(one, "snapshot int, bucket long, filter binary")


def bucket(sha: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(sha), F.lit(buckets))


def screen(incoming: DataFrame, filters: DataFrame, buckets: int) -> DataFrame:
    """(snapshot, digest) of the incoming (batch, digest) rows that an earlier snapshot's filter lets through."""

    def one(rows: pd.DataFrame, found: pd.DataFrame) -> pd.DataFrame:
        if not len(rows) or not len(found):
            return pd.DataFrame({"snapshot": pd.Series(dtype="int32"), "digest": pd.Series(dtype=object)})
        return rows.loc[fusefilter.probe(found["filter"].iloc[0], rows["key"].to_numpy()), ["snapshot", "digest"]]

    earlier = incoming.filter("batch > 0").select("digest", F.explode(F.sequence(F.lit(0), F.col("batch") - 1)).alias("snapshot"))
    earlier = earlier.withColumn("bucket", bucket(F.col("digest"), buckets)).withColumn("key", key64(F.col("digest")))
    both = earlier.groupBy("snapshot", "bucket").cogroup(filters.groupBy("snapshot", "bucket"))
    return both.applyInPandas(one, "snapshot int, digest string")


def check_bytes(docs: DataFrame, text: Column, repeated: DataFrame) -> None:
    """Fail unless the texts behind every repeated digest are the same bytes.

    A digest's texts are equal if the least is the greatest. Tasks combine their own rows first, so a hot group moves
    as one row a task; texts whose digest is unique don't move while the repeated digests are few enough to broadcast.
    """
    few = repeated.count() <= BROADCAST_DIGESTS
    wanted = repeated.select("digest")
    rows = docs.select(digest(text).alias("digest"), normalised(text).alias("text"))
    rows = rows.join(F.broadcast(wanted) if few else wanted, "digest", "left_semi")
    bad = rows.groupBy("digest").agg(F.min("text").alias("least"), F.max("text").alias("most")).filter("least <> most")
    if bad.select("digest").head(1):
        raise ValueError("different texts share a SHA-256 digest")


def exact_dedup(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", batches: int = 3, batch: Column | None = None) -> DataFrame:
    """Every row's group of equal texts: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal if identical after lower-casing A-Z; null is the empty text. The row with the largest id stays (a
    null id is the smallest; of rows with the same id and text one stays). The rows arrive in batches (by crc32 of the
    id unless `batch`, an int column from 0, says otherwise); a finished batch is an immutable snapshot with a
    binary-fuse filter per digest bucket. Later digests that a filter lets through join the snapshot's exact groups,
    repeats within a batch are grouped on their own, and the bytes behind every repeated digest are compared.
    Very long texts are hashed whole; an empty table gives an empty result; other columns aren't read.
    """
    batch = F.coalesce(batch if batch is not None else id_remainder(col(doc_id), batches), F.lit(0)).cast("int")
    rows = stored(docs.select(col(doc_id).alias("doc_id"), batch.alias("batch"), digest(col(text)).alias("digest"), F.monotonically_increasing_id().alias("rid")), "dedup-digests")
    groups = stored(rows.groupBy("batch", "digest").agg(F.count("*").alias("n"), F.max(F.struct("doc_id", "rid")).alias("top")), "dedup-groups")
    last, total = groups.agg(F.max("batch"), F.count("*")).first()
    buckets = 1 + total // PER_BUCKET
    repeated = groups.filter("n > 1").select("digest")
    if last:
        filters = stored(build_filters(groups.filter(F.col("batch") < last), buckets), "dedup-filters")
        passed = screen(groups.select("batch", "digest"), filters, buckets)
        hits = passed.join(groups.select(F.col("batch").alias("snapshot"), "digest"), ["snapshot", "digest"]).select("digest")
        repeated = repeated.union(hits)
    repeated = stored(repeated.distinct(), "dedup-repeated")
    check_bytes(docs, col(text), repeated)
    merged = stored(groups.join(repeated, "digest", "left_semi").groupBy("digest").agg(F.sum("n").alias("group_size"), F.max("top").alias("top")), "dedup-merged")
    out = rows.join(merged, "digest", "left")  # two tables: the rows of a hot digest can be split
    alone = F.col("top").isNull()
    return out.select(
        "doc_id",
        F.when(alone, F.col("doc_id")).otherwise(F.col("top.doc_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        (alone | (F.col("rid") == F.col("top.rid"))).alias("kept"),
        F.col("digest").alias("text_sha256"),
    )
