"""Tools around profiles: distance matrix, k-means of gene profiles, pair counts, file pairing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import stored


def distances(results: DataFrame, by: str = "theta_pool") -> DataFrame:
    """(a, b, value) of rows named a_vs_b, both ways round, with 0 on the diagonal."""
    pairs = results.filter(F.contains("group", F.lit("_vs_"))).select(F.split_part("group", F.lit("_vs_"), F.lit(1)).alias("a"), F.split_part("group", F.lit("_vs_"), F.lit(2)).alias("b"), F.col(by).alias("value"))
    cell = lambda x, y, v: F.struct(F.col(x).alias("a"), F.col(y).alias("b"), v.alias("value"))
    four = F.array(cell("a", "b", F.col("value")), cell("b", "a", F.col("value")), cell("a", "a", F.lit(0.0)), cell("b", "b", F.lit(0.0)))
    cells = pairs.select(F.explode(four).alias("c")).select("c.*")
    return cells.groupBy("a", "b").agg(F.first(F.when(F.col("a") == F.col("b"), 0.0).otherwise(F.col("value"))).alias("value"))


def distance_matrix(results: DataFrame, by: str = "theta_pool") -> DataFrame:
    """The square matrix of distances(): one row and one column per name, null where a pair is missing."""
    rows = stored(distances(results, by), "distances")  # a row a pair of names, read for the columns and for the cells
    names = sorted(r["a"] for r in rows.select("a").distinct().collect())  # the matrix's columns
    return rows.groupBy(F.col("a").alias("isolate")).pivot("b", names).agg(F.first("value")).orderBy("isolate")


def profile_vectors(profile: DataFrame, corr_type: str = "P4", xmin: int = 3, xmax: int = 150) -> DataFrame:
    """(gene, features): the P2 mean at lag 0, then corr_type means at the lags xmin to below xmax in steps of 3."""
    lags = range(xmin, xmax, 3)
    at = lambda kind, lag: F.coalesce(F.max(F.when((F.col("type") == kind) & (F.col("lag") == lag) & (F.col("n") > 0), F.col("mean"))), F.lit(0.0))
    return profile.groupBy("gene").agg(F.array(at("P2", 0), *[at(corr_type, lag) for lag in lags]).alias("features"))


#: Vectors are clustered in whole millionths, so that sums and distances are exact.
UNITS = 1_000_000


def draw(seed: int, k: int, name: Column) -> Column:
    """A number in (0, 1) that depends on the seed, on k and on the name."""
    return (F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(str(seed)), F.lit(str(k)), name)), 1, 8), 16, 10).cast("double") + 0.5) / 4294967296.0


def far(v: Column, center: list[int]) -> Column:
    """Squared distance of an array of whole numbers to a center."""
    c = F.array(*[F.lit(x).cast("long") for x in center])
    return F.aggregate(F.zip_with(v, c, lambda a, b: (a - b) * (a - b)), F.lit(0).cast("long"), lambda s, x: s + x)


def first_centers(rows: DataFrame, k: int, seed: int) -> list[list[int]]:
    """Up to k rows (gene, v): the one of least draw, then each time one drawn in proportion to its distance to those there are.

    The largest of log(u) / distance is such a draw; rows at distance 0 have none, so equal rows give fewer centers.
    """
    first = rows.orderBy(draw(seed, 0, F.col("gene")), "gene").select("v").limit(1).collect()
    centers = [list(r["v"]) for r in first]
    while centers and len(centers) < k:
        near = F.least(*[far(F.col("v"), c) for c in centers]) if len(centers) > 1 else far(F.col("v"), centers[0])
        drawn = rows.withColumn("d", near).filter("d > 0")
        found = drawn.orderBy((F.log(draw(seed, len(centers), F.col("gene"))) / F.col("d")).desc(), "gene").select("v").limit(1).collect()
        if not found:
            break
        centers.append(list(found[0]["v"]))
    return centers


def assigned(rows: DataFrame, centers: list[list[int]]) -> DataFrame:
    """rows with `cluster`, the number of the nearest center, the lower one on ties."""
    nearest = F.array_min(F.array(*[F.struct(far(F.col("v"), c).alias("d"), F.lit(i).alias("i")) for i, c in enumerate(centers)]))
    return rows.withColumn("cluster", nearest["i"])


def cluster_profiles(profile: DataFrame, k: int = 2, seed: int = 0, rounds: int = 100, **options) -> DataFrame:
    """(gene, cluster): k-means of the gene profiles, the same on every run and every number of machines.

    Centers are drawn by hashes of the genes' names; a round assigns every gene to its nearest center and moves each
    center to the floored mean of its genes, one aggregate of k rows; a center without genes stays. It ends when no
    center moves, or after `rounds`. Only centers, k vectors, come to the driver.
    """
    vectors = profile_vectors(profile, **options).select("gene", F.transform("features", lambda x: F.round(x * UNITS).cast("long")).alias("v"))
    rows = stored(vectors, "profile-vectors")  # one short vector a gene, read once a round
    centers = first_centers(rows, k, seed)
    if not centers:
        return rows.select("gene", F.lit(0).alias("cluster"))
    places = range(len(centers[0]))
    for _ in range(rounds):
        sums = assigned(rows, centers).groupBy("cluster").agg(F.count("*").alias("n"), *[F.sum(F.get("v", F.lit(j))).alias(f"s{j}") for j in places]).collect()
        moved = [*centers]
        for r in sums:
            moved[r["cluster"]] = [r[f"s{j}"] // r["n"] for j in places]
        if moved == centers:
            break
        centers = moved
    return assigned(rows, centers).select("gene", "cluster")


def pair_statistics(profile: DataFrame, by: list[str] | None = None) -> DataFrame:
    """(by..., avg_pairs, stdev_pairs, num_genes): pairs per gene at lag 0, and their sample deviation."""
    rows = profile.filter("type = 'P2' and lag = 0")
    aggs = [F.avg("n").alias("avg_pairs"), F.stddev_samp("n").alias("stdev_pairs"), F.count("*").alias("num_genes")]
    return rows.groupBy(*by).agg(*aggs) if by else rows.agg(*aggs)


def pair_files(clusters: DataFrame, present: DataFrame, json_suffix: str = "_XMFA_OUT.json", lmfit_suffix: str = "_XMFA_OUT_lmfit_report.csv") -> tuple[DataFrame, DataFrame]:
    """(found, failed): the expected files cluster/cluster_CORE and _FLEX of clusters(cluster) whose fit report is among present(path)."""
    each = clusters.select("cluster", F.explode(F.array(F.lit("CORE"), F.lit("FLEX"))).alias("genome"))
    stem = F.concat("cluster", F.lit("/"), "cluster", F.lit("_"), "genome")
    each = each.select("cluster", "genome", F.concat(stem, F.lit(json_suffix)).alias("json"), F.concat(stem, F.lit(lmfit_suffix)).alias("path"))
    return each.join(present.select("path"), "path", "left_semi"), each.join(present.select("path"), "path", "left_anti")
