"""Readers and writers of profiles and fit results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

RESULT = "array<struct<Lag:int,Mean:double,Variance:double,N:bigint,Type:string>>"
#: Comment lines ahead of a profile; readers skip them.
HEADER = (
    "# l: lag, the bases between the two sites",
    "# m: mean of the profile at that lag",
    "# v: variance of it over genes",
    "# n: genes that it is made from",
    "# t: Ks for the diversity of the sample, P2 for the profile",
    "# b: all, or the bootstrap's name",
)
#: The columns of a profile.
CSV = "l int, m double, v double, n long, t string, b string"


def to_records(profile: DataFrame) -> DataFrame:
    """(ID, Results): a gene's rows as one record, by type and lag."""
    variance = F.col("variance") if "variance" in profile.columns else F.lit(0.0)
    row = F.struct(F.col("type").alias("t"), F.col("lag").cast("int").alias("Lag"), F.col("mean").alias("Mean"), variance.alias("Variance"), F.col("n").alias("N"))
    genes = profile.groupBy("gene").agg(F.array_sort(F.collect_list(row)).alias("r"))
    each = F.transform("r", lambda x: F.struct(x["Lag"].alias("Lag"), x["Mean"].alias("Mean"), x["Variance"].alias("Variance"), x["N"].alias("N"), x["t"].alias("Type")))
    return genes.select(F.col("gene").alias("ID"), each.alias("Results"))


def from_records(records: DataFrame) -> DataFrame:
    """(gene, lag, mean, variance, n, type) of records; a record without results has no rows."""
    return records.select(F.col("ID").alias("gene"), F.explode("Results").alias("r")).select("gene", F.col("r.Lag").alias("lag"), F.col("r.Mean").alias("mean"), F.col("r.Variance").alias("variance"), F.col("r.N").alias("n"), F.col("r.Type").alias("type"))


def write_records(profile: DataFrame, path: str) -> None:
    """Gene profiles as NDJSON."""
    to_records(profile).write.mode("overwrite").json(path)


def read_records(spark: SparkSession, path: str) -> DataFrame:
    return from_records(spark.read.schema(f"ID string, Results {RESULT}").json(path))


def number(c: str) -> Column:
    """A double as CSV text, NaN as such."""
    return F.when(F.isnan(c), F.lit("NaN")).otherwise(F.col(c).cast("string"))


def write_profile(rows: DataFrame, path: str, comments: bool = True) -> None:
    """Profile rows as CSV text in one file, replicates together, `all` first; a profile is small: lags x replicates."""
    spark = rows.sparkSession
    lines = rows.select((F.col("b") != "all").cast("int").alias("k"), "b", (F.col("t") != "Ks").cast("int").alias("s"), "t", "l", F.concat_ws(",", F.col("l").cast("string"), number("m"), number("v"), F.col("n").cast("string"), "t", "b").alias("value"))
    head = spark.createDataFrame([(i, x) for i, x in enumerate([*(HEADER if comments else ()), "l,m,v,n,t,b"])], "l int, value string")
    head = head.select(F.lit(-1).alias("k"), F.lit("").alias("b"), F.lit(0).alias("s"), F.lit("").alias("t"), "l", "value")
    head.union(lines).coalesce(1).sortWithinPartitions("k", "b", "s", "t", "l").select("value").write.mode("overwrite").text(path)


def read_profile(spark: SparkSession, path: str) -> DataFrame:
    """Profile rows of CSV text: comment lines and the header row are skipped."""
    return spark.read.schema(CSV).option("comment", "#").option("mode", "DROPMALFORMED").csv(path).filter("l is not null")


def read_gene_csv(spark: SparkSession, path: str) -> DataFrame:
    """Gene-level CSV with a header row that starts with lag: lag, m, n, v, t, b."""
    rows = spark.read.schema("lag int, mean double, n long, variance double, type string, gene string").option("comment", "#").option("mode", "DROPMALFORMED").csv(path)
    return rows.filter("lag is not null")


def write_results(fitted: DataFrame, columns: list[str], path: str) -> None:
    """Fit results as CSV with a header, NA where a value is missing."""
    cells = [F.coalesce(F.col(c).cast("string"), F.lit("NA")).alias(c) for c in columns]
    fitted.select(*cells).coalesce(1).sortWithinPartitions("group").write.mode("overwrite").option("header", True).csv(path)


def report_text(report: DataFrame, order: list[str]) -> DataFrame:
    """(param, value): a block of text per parameter; bootstrap statistics from 10 replicates on; ratio is gamma/mu."""
    g = lambda c: F.format_string("%g", F.col(c))
    # fixed values: the labels of the report's lines
    boots = [F.concat(F.lit(f"bootstrapping {label} = "), g(c)) for label, c in (("mean", "mean"), ("standard deviation", "std"))]
    boots.append(F.concat(F.lit("bootstrapping size = "), F.col("size").cast("string")))
    boots += [F.concat(F.lit(f"bootstrapping {label} = "), g(c)) for label, c in (("median", "median"), ("lower bound (5%)", "lower"), ("upper bound (95%)", "upper"))]
    name = F.when(F.col("param") == "ratio", "gamma/mu").otherwise(F.col("param"))
    lines = [F.concat(F.lit("["), name, F.lit("]")), F.when(F.col("value").isNotNull(), F.concat(F.lit("value = "), g("value")))]
    lines += [F.when(F.col("size") >= 10, x) for x in boots]
    place = F.array_position(F.array(*[F.lit(p) for p in order]), F.col("param"))
    return report.select("param", place.alias("place"), F.concat(F.concat_ws("\n", *lines), F.lit("\n")).alias("value"))


def write_report(report: DataFrame, order: list[str], path: str) -> None:
    report_text(report, order).coalesce(1).sortWithinPartitions("place").select("value").write.mode("overwrite").text(path)


#: The columns of a fit's own report.
LMFIT = ["d_s", "theta_s", "f", "phi_s", "theta_p", "phi_p", "c", "d_theta_p", "d_theta_s", "chisq", "red-chisq"]


def lmfit_lines(fitted: DataFrame, theta_init: float, f_init: float, phi_init: float) -> DataFrame:
    """(group, value): the eleven rows of a fit's own report as one text."""
    s = lambda c: F.col(c).cast("string")
    # fixed values: the names of the report's rows
    pairs = [("fit_success", F.when(F.col("success"), "True").otherwise("False")), ("function_evals", s("nfev")), ("data_points", s("ndata")), ("variables", F.lit("3")), ("message", F.lit("")), ("thetaS (init)", F.lit(str(theta_init))), ("f (init)", F.lit(str(f_init))), ("phiS (init)", F.lit(str(phi_init)))]
    lines = [F.concat(F.lit(f"{k},"), v) for k, v in pairs] + [F.lit('""'), F.lit(",".join(LMFIT))]
    values = ["d_sample", "theta_s", "fbar", "phi_s", "theta_pool", "phi_pool", "c", "d_pool", "d_clonal", "chisq", "redchi"]
    return fitted.select("group", F.concat_ws("\n", *lines, F.concat_ws(",", *[s(v) for v in values])).alias("value"))


def read_lmfit(spark: SparkSession, path: str) -> DataFrame:
    """(path, fit_success, nfev, datapoints, then the eleven values as text) of fit reports, one file a row."""
    files = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.split(F.regexp_replace("value", "\r", ""), "\n").alias("r"))
    second = lambda k: F.split(F.try_element_at("r", F.lit(k)), ",")[1]
    last = F.split(F.try_element_at("r", F.lit(11)), ",")
    names = ["ds", "thetaS", "f", "phiS", "thetaP", "phiP", "c", "dp", "dc", "chisq", "red-chisq"]
    return files.select("path", second(1).alias("fit_success"), second(2).alias("nfev"), second(3).alias("datapoints"), *[F.try_element_at(last, F.lit(i + 1)).alias(n) for i, n in enumerate(names)])


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """(line): trimmed lines."""
    return spark.read.text(path).select(F.trim("value").alias("line"))
