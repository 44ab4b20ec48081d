"""Running profile over a stream of gene-profile records (NDJSON files that arrive in a folder)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..operators.collect import PROFILE, merged, moments, normalise, of_moments, replicates
from ..sources.profiles import RESULT, from_records
from ..sources.scratch import delete_path, names_in

#: Profiles that stay readable behind the newest one.
KEPT = 2


def read_record_stream(spark: SparkSession, path: str, max_files: int = 100) -> DataFrame:
    """Gene-profile rows of the records that appear under path."""
    return from_records(spark.readStream.schema(f"ID string, Results {RESULT}").option("maxFilesPerTrigger", max_files).json(path))


def spans(number: int) -> list[tuple[int, int]]:
    """The segments that make up batches 0 to number, both inclusive: one for each power of two in their count."""
    count, first, out = number + 1, 0, []
    for bit in reversed(range(count.bit_length())):
        if count >> bit & 1:
            out.append((first, first + (1 << bit) - 1))
            first += 1 << bit
    return out


def below(number: int) -> list[tuple[int, int]]:
    """The earlier segments that batch `number` completes to a larger one, itself left out."""
    return [s for s in spans(number - 1) if s[0] >= spans(number)[-1][0]] if number else []


def run_collector(rows: DataFrame, out: str, checkpoint: str, num_boot: int = 0) -> StreamingQuery:
    """Append the stream's gene rows to out/genes and keep the profile of all genes so far up to date.

    The state is the moments of segments of batches: a batch's own, merged with those segments that it completes to
    the next power of two. So a batch reads a number of small tables that grows with the logarithm of the batches, and
    earlier genes aren't read again. Everything is named after the batch's number: a batch that runs again replaces
    what it had written and counts once. Each batch's profile has a folder of its own; read_profile_now() takes the
    newest that is complete, so a reader never finds half of one.
    """

    def step(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        at = lambda s: f"{out}/moments/{s[0]:012d}-{s[1]:012d}"
        batch.write.mode("overwrite").parquet(f"{out}/genes/batch={number}")
        genes = spark.read.schema(batch.schema).parquet(f"{out}/genes/batch={number}")
        own = moments(replicates(genes, num_boot), PROFILE, "mean", "k")
        for s in below(number):
            own = own.unionByName(spark.read.parquet(at(s)))
        merged(own, PROFILE).write.mode("overwrite").parquet(at(spans(number)[-1]))
        whole = spark.read.parquet(*[at(s) for s in spans(number)])
        normalise(of_moments(merged(whole, PROFILE), PROFILE)).write.mode("overwrite").parquet(f"{out}/profile/{number:012d}")
        for name in names_in(spark, f"{out}/profile"):
            if int(name) < number - KEPT:
                delete_path(spark, f"{out}/profile/{name}")

    return rows.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def read_profile_now(spark: SparkSession, out: str) -> DataFrame:
    """The newest complete profile: that of the highest batch whose write has left its mark of success."""
    done = [n for n in sorted(names_in(spark, f"{out}/profile")) if "_SUCCESS" in names_in(spark, f"{out}/profile/{n}")]
    if not done:
        raise FileNotFoundError(f"no profile in {out} yet")
    return spark.read.parquet(f"{out}/profile/{done[-1]}")
