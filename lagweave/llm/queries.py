"""The driver's queries of the dealt operators, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read_table
from .decontaminate import contamination
from .exact_dedup import exact_dedup
from .language import identify
from .lm_score import score
from .mixing import mix_report
from .packing import pack
from .runs import digest, periodic_runs, planted
from .secrets import secrets
from .simhash import near_report
from .token_counts import token_counts
from .token_files import write_and_read
from .vector_codes import vector_codes
from .warc import archive_and_read


def op1_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(read_table(spark, sf_dir, "documents"))


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archive_and_read(read_table(spark, sf_dir, "pages"))


def op3_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_report(read_table(spark, sf_dir, "documents"))


def op4_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets(read_table(spark, sf_dir, "documents"))


def op5_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(read_table(spark, sf_dir, "documents"))


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(read_table(spark, sf_dir, "documents"))


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(read_table(spark, sf_dir, "documents"))


def op8_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return write_and_read(read_table(spark, sf_dir, "documents"))


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_report(read_table(spark, sf_dir, "documents"), shingle=3)


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes(read_table(spark, sf_dir, "embeddings"))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(periodic_runs(planted(read_table(spark, sf_dir, "documents"))))


def op13_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(read_table(spark, sf_dir, "documents"))


def secrets_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What op4_secrets finds by the base patterns alone, which SQL can say."""
    return op4_secrets(spark, sf_dir).select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256")


def lm_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The counts and the base score of op5_lm_score, which SQL can say."""
    return op5_lm_score(spark, sf_dir).select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", F.round("base_score", 6).alias("base_score"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"op1_language": op1_language, "op2_warc": op2_warc, "op3_mix": op3_mix, "op4_secrets": op4_secrets, "op5_lm_score": op5_lm_score, "op6_exact_dedup": op6_exact_dedup, "op7_token_counts": op7_token_counts, "op8_token_files": op8_token_files, "op9_simhash": op9_simhash, "op10_decontaminate": op10_decontaminate, "op11_vector_codes": op11_vector_codes, "op12_periodic_runs": op12_periodic_runs, "op13_packing": op13_packing, "secrets_base": secrets_base, "lm_base": lm_base}


def oracle_sql() -> dict[str, str]:
    from .oracles import SQL

    return dict(SQL)
