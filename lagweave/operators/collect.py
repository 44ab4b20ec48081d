"""Collecting gene profiles: mean and variance over genes, normalisation, Poisson bootstrap, q-factor."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Poisson(1) distribution function up to the count that a 32-bit uniform number can reach.
POISSON = [sum(math.exp(-1.0) / math.factorial(i) for i in range(k + 1)) for k in range(13)]


def population_variance(x: str) -> Column:
    return F.when(F.count(x) < 2, F.lit(float("nan"))).otherwise(F.var_pop(x))


def mean_variance(df: DataFrame, by: list[str], x: str, corrected: bool = False) -> DataFrame:
    """(by..., n, mean, variance): mean 0 of nothing, variance NaN of fewer than two values."""
    var = F.when(F.count(x) < 2, F.lit(float("nan"))).otherwise(F.var_samp(x)) if corrected else population_variance(x)
    return df.groupBy(*by).agg(F.count(x).alias("n"), F.coalesce(F.avg(x), F.lit(0.0)).alias("mean"), var.alias("variance"))


def poisson_weight(gene: Column, replicate: Column) -> Column:
    """Draw of Poisson(1), by inverse distribution function of the first 8 hex digits of md5(gene|replicate)."""
    u = F.conv(F.substring(F.md5(F.concat_ws("|", gene, replicate)), 1, 8), 16, 10).cast("double") / 4294967296.0
    k = F.lit(len(POISSON))
    for i in reversed(range(len(POISSON))):
        k = F.when(u < POISSON[i], i).otherwise(k)
    return k


def replicates(profile: DataFrame, num_boot: int, gene: str = "gene") -> DataFrame:
    """profile rows (type, lag, mean) per replicate b with weight k: all with 1, boot_0 ... with Poisson(1) draws per gene.

    A gene's rows travel as one array, so a gene's draw is made once; genes drawn 0 times go before the rows unfold.
    """
    genes = profile.groupBy(gene).agg(F.collect_list(F.struct("type", "lag", "mean")).alias("rows"))
    boots = F.transform(F.sequence(F.lit(0), F.lit(num_boot - 1)), lambda i: F.concat(F.lit("boot_"), i.cast("string"))) if num_boot else F.array().cast("array<string>")
    each = genes.select(F.col(gene).alias("gene"), "rows", F.explode(F.concat(F.array(F.lit("all")), boots)).alias("b"))
    each = each.withColumn("k", F.when(F.col("b") == "all", 1).otherwise(poisson_weight(F.col("gene").cast("string"), F.col("b")))).filter("k > 0")
    return each.select("gene", "b", "k", F.explode("rows").alias("r")).select("gene", "b", "k", "r.*")


STATE = ["n", "mean", "m2"]


def moments(df: DataFrame, by: list[str], x: str, weight: str | None = None) -> DataFrame:
    """(by..., n, mean, m2): number, mean and sum of squared deviations of x, each row `weight` (a whole number) times.

    Rows of one weight are summed up by Spark's own updating form of the variance, in which no squares of x are
    subtracted; the states of the weights, of which there are few, are then merged. Null x don't count.
    """
    keys = [*by, weight] if weight else by
    k = F.col(weight) if weight else F.lit(1)
    rows = df.filter(F.col(x).isNotNull()).groupBy(*keys).agg(F.count(x).alias("c"), F.avg(x).alias("mean"), F.var_pop(x).alias("v"))
    states = rows.select(*by, (k * F.col("c")).cast("long").alias("n"), "mean", (k * F.col("c") * F.col("v")).alias("m2")).filter("n > 0")
    return merged(states, by, 1) if weight else states


def joined_states(one: Column, two: Column) -> Column:
    """The state of two parts taken together, from their own: what their means differ by adds to the deviations."""
    n, gap = one["n"] + two["n"], two["mean"] - one["mean"]
    share = F.when(n > 0, two["n"] / n).otherwise(0.0)
    return F.struct(n.alias("n"), (one["mean"] + gap * share).alias("mean"), (one["m2"] + two["m2"] + gap * gap * share * one["n"]).alias("m2"))


def merged(states: DataFrame, by: list[str], parts: int = 64) -> DataFrame:
    """One state (by..., n, mean, m2) of any number of states of each group, whatever parts they were taken over.

    Equal states are counted first; the others are dealt to `parts` lists a group by a hash of themselves and joined
    pairwise within each, then the lists' states are. With one part, for few states a group, the lists are the groups.
    """
    start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0.0).alias("mean"), F.lit(0.0).alias("m2"))

    def level(df: DataFrame, keys: list[str]) -> DataFrame:
        lists = df.filter("n > 0").groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(*STATE))).alias("s"))
        return lists.select(*keys, F.aggregate("s", start, joined_states).alias("t")).select(*keys, "t.*")

    if parts == 1:
        return level(states, by)
    once = states.groupBy(*by, *STATE).agg(F.count("*").alias("times"))
    dealt = once.select(*by, F.pmod(F.xxhash64(*STATE), F.lit(parts)).alias("part"), (F.col("n") * F.col("times")).alias("n"), "mean", (F.col("m2") * F.col("times")).alias("m2"))
    return level(level(dealt, [*by, "part"]), by)


def of_moments(states: DataFrame, by: list[str], corrected: bool = False) -> DataFrame:
    """(by..., n, mean, variance) of states; the variance of fewer than two values is NaN."""
    over = F.col("n") - 1 if corrected else F.col("n")
    return states.select(*by, "n", "mean", F.when(F.col("n") < 2, F.lit(float("nan"))).otherwise(F.col("m2") / over).alias("variance"))


PROFILE = ["b", "type", "lag"]


def collect(weighted: DataFrame) -> DataFrame:
    """(b, type, lag, n, mean, variance) over rows (b, type, lag, mean, k): each gene counts k times."""
    return of_moments(moments(weighted, PROFILE, "mean", "k"), PROFILE)


def normalise(collected: DataFrame) -> DataFrame:
    """Profile rows (l, m, v, n, t, b): Ks is the P2 mean at lag 0; the others are over Ks (variances over its square).

    A replicate without P2 has no rows; one whose Ks is 0, or whose P2 lacks lag 0, has the Ks row alone.
    """
    zero = lambda r: (r["type"] == "P2") & (r["lag"] == 0)
    row = F.struct("type", "lag", "n", "mean", "variance")
    sets = collected.groupBy("b").agg(F.max(F.col("type") == "P2").alias("any"), F.collect_list(row).alias("rows")).filter("any")  # a row a type and lag
    at = F.try_element_at(F.filter("rows", zero), F.lit(1))
    sets = sets.select("b", "rows", F.coalesce(at["mean"], F.lit(0.0)).alias("ks"), F.coalesce(at["n"], F.lit(0)).alias("kn"), F.coalesce(at["variance"], F.lit(float("nan"))).alias("kv"))
    cell = lambda lag, m, v, n, t: F.struct(lag.cast("int").alias("l"), m.alias("m"), v.alias("v"), n.cast("long").alias("n"), t.alias("t"))
    first = F.array(cell(F.lit(0), F.col("ks"), F.col("kv"), F.col("kn"), F.lit("Ks")))
    kept = F.filter("rows", lambda r: ~zero(r) & (r["n"] > 0) & (F.col("ks") != 0))
    rest = F.transform(kept, lambda r: cell(r["lag"], r["mean"] / F.col("ks"), r["variance"] / (F.col("ks") * F.col("ks")), r["n"], r["type"]))
    return sets.select("b", F.explode(F.concat(first, rest)).alias("p")).select("p.*", "b")


def profile(gene_rows: DataFrame, num_boot: int = 1000, gene: str = "gene") -> DataFrame:
    """Gene profiles (gene, lag, mean, type, ...) to profile rows (l, m, v, n, t, b) with bootstraps over genes."""
    return normalise(collect(replicates(gene_rows, num_boot, gene)))


def pair_collect(pairs: DataFrame) -> DataFrame:
    """Profile rows of every genome pair and of all of them, from rows (pair, gene, lag, mean, type), or counted ones with `times`."""
    by = ["pair", "type", "lag"]
    if "times" in pairs.columns:
        same = pairs.groupBy(*by, "mean").agg(F.sum("times").alias("n"))
        each = merged(same.select(*by, "n", "mean", F.lit(0.0).alias("m2")), by)
    else:
        each = moments(pairs, by, "mean")
    sets = each.unionByName(merged(each, by[1:]).withColumn("pair", F.lit("all")))
    return normalise(of_moments(sets, by).withColumnRenamed("pair", "b"))


def q_factor(rows: DataFrame) -> DataFrame:
    """(b, q): median over lags 1 to 30 of P2/P4 where both are positive; 0 where there is none."""
    near = rows.filter((F.col("l") > 0) & (F.col("l") <= 30))
    both = near.groupBy("b", "l").agg(F.max(F.when(F.col("t") == "P2", F.col("m"))).alias("p2"), F.max(F.when(F.col("t") == "P4", F.col("m"))).alias("p4"))
    ratio = both.filter("p2 > 0 and p4 > 0").groupBy("b").agg(F.percentile(F.col("p2") / F.col("p4"), 0.5).alias("q"))
    return rows.select("b").distinct().join(ratio, "b", "left").select("b", F.coalesce("q", F.lit(0.0)).alias("q"))


def scale_p4(rows: DataFrame, kind: str = "P4") -> DataFrame:
    """Read profiles: Ks, and P4 beyond lag 0 times q (variance times its square), named P2."""
    kept = rows.filter((F.col("t") == "Ks") | ((F.col("t") == kind) & (F.col("l") > 0))).join(q_factor(rows), "b")
    p4 = F.col("t") == kind
    return kept.select("l", F.when(p4, F.col("m") * F.col("q")).otherwise(F.col("m")).alias("m"), F.when(p4, F.col("v") * F.col("q") * F.col("q")).otherwise(F.col("v")).alias("v"), "n", F.when(p4, F.lit("P2")).otherwise(F.col("t")).alias("t"), "b")
