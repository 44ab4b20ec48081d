"""Whole programs: files in, profile or fit files out. `python -m lagweave.plans.apps PROGRAM --help`."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from ..operators import alignment as A
from ..operators import collect as K
from ..operators import fit as T
from ..operators import reads as R
from ..operators import tools as U
from ..operators import variants as V
from ..sources import alignments as X
from ..sources import profiles as S
from ..sources import reads as Q
from ..sources.scratch import stored


def kept(spark: SparkSession, gene_rows, out: str):
    """Write the gene profiles to out.json and go on from what was written."""
    S.write_records(gene_rows, f"{out}.json")
    return S.read_records(spark, f"{out}.json")


def xmfa(spark: SparkSession, path: str, out: str, max_corr_length: int = 300, num_boot: int = 1000) -> None:
    """One-clade alignment to out.json and out.csv."""
    rows = A.gene_profile(X.read_xmfa(spark, path), A.CodingOptions(max_corr_length=max_corr_length))
    S.write_profile(K.profile(kept(spark, rows, out), num_boot), f"{out}.csv")


def xmfa_2clades(spark: SparkSession, one: str, two: str, out: str, max_corr_length: int = 300, num_boot: int = 1000) -> None:
    """Two alignments to the profile between them."""
    o = A.CodingOptions(max_corr_length=max_corr_length, min_sequences=1)
    rows = A.clade_profile(X.read_xmfa(spark, one, 1), X.read_xmfa(spark, two, 1), o)
    S.write_profile(K.profile(kept(spark, rows, out), num_boot), f"{out}.csv")


def bam(spark: SparkSession, gff: str, path: str, out: str, num_boot: int = 1000, options: R.ReadOptions = R.ReadOptions()) -> None:
    """Reads and gene annotations to out.json and out.csv."""
    rows = R.read_profile(Q.read_reads(spark, path), Q.read_gff(spark, gff), options)
    profile = stored(K.profile(kept(spark, rows, out), num_boot), "read-profile")  # the scaling reads it more than once
    S.write_profile(K.scale_p4(profile), f"{out}.csv")


def pair(spark: SparkSession, path: str, out: str, second: str = "", max_corr_length: int = 300, codon_position: int = 4) -> None:
    """Every pair of genomes (or every genome and its mate in a second file) to out.csv."""
    mate = X.mates(X.read_fasta(spark, second)) if second else None
    rows = A.genome_pair_counts(X.read_xmfa(spark, path, 1), A.CodingOptions(max_corr_length=max_corr_length, codon_position=codon_position), mate)
    S.write_profile(K.pair_collect(rows), out, comments=False)


def vcf(spark: SparkSession, path: str, out: str, max_corr_length: int = 300, region_start: int = 1, region_end: int = 10**12) -> None:
    S.write_profile(V.site_profile(Q.read_vcf(spark, path), max_corr_length, region_start, region_end), out, comments=False)


def collect(spark: SparkSession, path: str, out: str, num_boot: int = 1000, corr_type: str = "P4") -> None:
    """Saved gene profiles to a profile with fresh bootstraps; P4 rows are scaled to P2."""
    rows = K.profile(S.read_records(spark, path), num_boot)
    if corr_type == "P4":
        rows = K.scale_p4(rows)
    S.write_profile(rows.filter(F.col("t").isin("Ks", "P2")), out)


def fit(spark: SparkSession, path: str, prefix: str, options: T.FitOptions = T.FitOptions()) -> None:
    """Profile to fit results, a report of `all`, residuals and bootstrap statistics."""
    data = T.fit_data(S.read_profile(spark, path), options)
    T.fit(data, options).write.mode("overwrite").parquet(f"{prefix}_fit.parquet")
    fitted = spark.read.parquet(f"{prefix}_fit.parquet")
    S.write_results(fitted, T.COLUMNS, f"{prefix}_fit_results.csv")
    S.lmfit_lines(fitted.filter("group = 'all'"), options.theta_init, options.f_init, options.phi_init).select("value").coalesce(1).write.mode("overwrite").text(f"{prefix}_lmfit_report.csv")
    order = T.COLUMNS[1:7]
    S.write_report(T.report(fitted, order), order, f"{prefix}_bootstrapping_report.txt")
    T.residuals(data.filter("group = 'all'"), fitted.filter("group = 'all'")).coalesce(1).write.mode("overwrite").option("header", True).csv(f"{prefix}_residuals.csv")


def fit_one(spark: SparkSession, path: str, prefix: str, options: T.FitOptions = T.FitOptions()) -> None:
    """Fit of `all` alone, by the method and within the evaluations of the options: results and residuals."""
    data = T.fit_data(S.read_profile(spark, path), options).filter("group = 'all'")
    fitted = stored(T.fit(data, options), "fitted")
    S.write_results(fitted, T.COLUMNS, f"{prefix}_fit_results.csv")
    T.residuals(data, fitted).filter("model = 'recombination'").select("x", "residual").coalesce(1).sortWithinPartitions("x").write.mode("overwrite").option("header", True).csv(f"{prefix}_residuals.csv")


def lmfit_report(spark: SparkSession, path: str, prefix: str, options: T.FitOptions = T.FitOptions()) -> None:
    """Report of the fit of `all`, from the options' initial values and within their bound of phi."""
    fitted = T.fit(T.fit_data(S.read_profile(spark, path), options).filter("group = 'all'"), options)
    S.lmfit_lines(fitted, options.theta_init, options.f_init, options.phi_init).select("value").coalesce(1).write.mode("overwrite").text(f"{prefix}_lmfit_report.csv")


def fit_compare(spark: SparkSession, path: str, prefix: str, options: T.FitOptions = T.FitOptions()) -> None:
    """Recombination model against the model without, for `all`, and the residuals of both."""
    data = stored(T.fit_data(S.read_profile(spark, path), options).filter("group = 'all'"), "fit-data")
    fitted = stored(T.fit(data, options), "fitted")
    T.compare(data, fitted).coalesce(1).write.mode("overwrite").option("header", True).csv(f"{prefix}_comparison.csv")
    both = T.residuals(data, fitted)
    for model in ("recombination", "zero"):
        both.filter(F.col("model") == model).select("x", "residual").coalesce(1).sortWithinPartitions("x").write.mode("overwrite").option("header", True).csv(f"{prefix}_{model}_residuals.csv")


def fit_collector(spark: SparkSession, root: str, out: str, json_suffix: str = "_XMFA_OUT.json", lmfit_suffix: str = "_XMFA_OUT_lmfit_report.csv") -> None:
    """Fit reports and gene profiles of root/cluster*/ to one table, and the missing reports to another."""
    files = S.read_lmfit(spark, f"{root}/cluster*/*{lmfit_suffix}").withColumn("path", F.regexp_extract("path", "([^/]+/[^/]+)$", 1))
    known = spark.read.format("binaryFile").load(f"{root}/cluster*/*").select(F.regexp_extract("path", "([^/]+)/[^/]+$", 1).alias("cluster")).distinct()
    found, failed = U.pair_files(known, files, json_suffix, lmfit_suffix)
    records = spark.read.schema(f"ID string, Results {S.RESULT}").json(f"{root}/cluster*/*{json_suffix}").withColumn("json", F.regexp_extract(F.input_file_name(), "([^/]+/[^/]+)$", 1))
    pairs = U.pair_statistics(records.select("json", F.explode("Results").alias("r")).select("json", F.col("r.Type").alias("type"), F.col("r.Lag").alias("lag"), F.col("r.N").alias("n")), ["json"])
    rows = found.join(pairs, "json", "left").join(files, "path").drop("json", "path")
    rows.withColumnRenamed("cluster", "ID").coalesce(1).write.mode("overwrite").option("header", True).csv(out)
    failed.select("cluster", "genome").coalesce(1).write.mode("overwrite").option("header", True).csv(f"{out}_lmfitfailed")


def distance_matrix(spark: SparkSession, path: str, out: str, by: str = "theta_pool") -> None:
    rows = spark.read.option("header", True).csv(path).withColumn(by, F.col(by).cast("double"))
    U.distance_matrix(rows, by).coalesce(1).write.mode("overwrite").option("header", True).csv(out)


def cluster(spark: SparkSession, path: str, prefix: str, corr_type: str = "P4", xmin: int = 3, xmax: int = 150) -> None:
    """Two k-means clusters of gene profiles: their records and their gene names."""
    rows = S.read_records(spark, path)
    groups = U.cluster_profiles(rows, corr_type=corr_type, xmin=xmin, xmax=xmax)
    for k in range(2):
        mine = groups.filter(F.col("cluster") == k).select("gene")
        S.write_records(rows.join(mine, "gene"), f"{prefix}_{k}.json")
        mine.write.mode("overwrite").text(f"{prefix}_{k}.txt")


PROGRAMS = {"xmfa": xmfa, "xmfa-2clades": xmfa_2clades, "bam": bam, "pair": pair, "vcf": vcf, "collect": collect, "fit": fit, "fit-one": fit_one, "lmfit-report": lmfit_report, "fit-compare": fit_compare, "fit-collector": fit_collector, "distance-matrix": distance_matrix, "cluster": cluster}


def main(argv: list[str] | None = None) -> None:
    """PROGRAM PATH... [--option value]: options are the program's arguments, those of reads and fits by their own names."""
    import inspect
    from dataclasses import fields

    parser = argparse.ArgumentParser(prog="lagweave", description=__doc__)
    programs = parser.add_subparsers(dest="program", required=True)
    for name, f in PROGRAMS.items():
        p = programs.add_parser(name, help=f.__doc__)
        for a in [*inspect.signature(f).parameters.values()][1:]:
            if a.name == "options":
                for o in fields(a.default):
                    value = getattr(a.default, o.name)
                    p.add_argument(f"--{o.name.replace('_', '-')}", type=type(value) if not isinstance(value, bool) else lambda s: s.lower() in ("1", "true", "yes"), default=value)
            elif a.default is inspect.Parameter.empty:
                p.add_argument(a.name)
            else:
                p.add_argument(f"--{a.name.replace('_', '-')}", type=type(a.default), default=a.default)
    given = vars(parser.parse_args(argv))
    f = PROGRAMS[given.pop("program")]
    options = inspect.signature(f).parameters.get("options")
    if options is not None:
        own = {o.name: given.pop(o.name) for o in fields(options.default)}
        given["options"] = type(options.default)(**own)
    f(SparkSession.builder.appName("lagweave").getOrCreate(), **given)


if __name__ == "__main__":
    main()
