import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from lagweave.functions import codons as C
from lagweave.functions import models as M
from lagweave.operators import alignment as A
from lagweave.operators import collect as K
from lagweave.operators import fit as T
from lagweave.operators import reads as R
from lagweave.operators import tools as U
from lagweave.operators import variants as V

CODE = {a + b + c: C.TABLE_11[16 * i + 4 * j + k] for i, a in enumerate("TCAG") for j, b in enumerate("TCAG") for k, c in enumerate("TCAG")}


def brute_profile(seqs, lags):
    """Sequence pairs of each class, one by one: {lag: (differing, all)}."""
    cut = [[s[i : i + 3] for i in range(0, len(s) - len(s) % 3, 3)] for s in seqs]
    out = {}
    for lag in range(lags):
        for i in range(max(0, len(cut[0]) - lag)):
            classes = {}
            for c in cut:
                if i + lag < len(c):
                    a, b = c[i], c[i + lag]
                    if not set(a + b) & {"-", "N"}:
                        classes.setdefault((CODE.get(a, "?"), CODE.get(b, "?")), []).append((a[2], b[2]))
            for pairs in classes.values():
                pairs = [p for p in pairs if set(p) <= set("ATGC")]
                for x, y in itertools.combinations(pairs, 2):
                    d, n = out.get(3 * lag, (0, 0))
                    out[3 * lag] = (d + (x[0] != y[0] and x[1] != y[1]), n + 1)
    return out


ALIGNMENT = {
    "g1": ["ATGAAATTTCCC", "ATGAAGTTCCCA", "ATGAAATTCCCG", "ATGNAATTTCC-"],
    "g2": ["TTTTTC", "TTCTTTAAA", "TTT", "tttTTC"],
    "g3": ["ATGATG"],
}


@pytest.fixture(scope="module")
def aln(spark):
    rows = [(g, "1", f"x{i}", i, s) for g, seqs in ALIGNMENT.items() for i, s in enumerate(seqs)]
    return spark.createDataFrame(rows, "gene string, pos string, genome string, seq_idx int, seq string")


def test_gene_profile_equals_pair_counting(aln):
    got = {(r.gene, r.lag): (round(r.mean * r.n), r.n) for r in A.gene_profile(aln, A.CodingOptions(max_corr_length=12)).collect()}
    want = {(g, lag): v for g, seqs in ALIGNMENT.items() if len(seqs) > 1 for lag, v in brute_profile(seqs, 4).items()}
    assert got == want


def test_order_of_later_sequences_makes_no_difference(aln):
    first = A.gene_profile(aln).collect()
    turned = aln.withColumn("seq_idx", F.when(F.col("seq_idx") > 0, 10 - F.col("seq_idx")).otherwise(0))
    assert sorted(map(tuple, first)) == sorted(map(tuple, A.gene_profile(turned).collect()))


def test_clades_meet_by_gene_and_position(spark, aln):
    two = spark.createDataFrame([("g1", "1", 0, "ATGAAATTTCCA", 0), ("g1", "1", 1, "ATGAAGTTCCCC", 0), ("g1", "2", 0, "ATGATG", 1), ("g1", "1", 0, "GGGGGG", 2), ("g9", "1", 0, "ATG", 3)], "gene string, pos string, seq_idx int, seq string, block int")
    rows = A.clade_profile(aln, two, A.CodingOptions(max_corr_length=6, min_sequences=1)).collect()
    assert {r.gene for r in rows} == {"g1"}
    lag0 = next(r for r in rows if r.lag == 0)
    n = d = 0
    for s in ALIGNMENT["g1"]:
        for t in ("ATGAAATTTCCA", "ATGAAGTTCCCC"):
            for i in range(0, 12, 3):
                a, b = s[i : i + 3], t[i : i + 3]
                if not set(a) & {"-", "N"} and CODE[a] == CODE[b]:
                    n, d = n + 1, d + (a[2] != b[2])
    assert (lag0.n, round(lag0.mean * lag0.n)) == (n, d)


def test_mean_and_variance(spark):
    df = spark.createDataFrame([("one", 1.0), *[("five", v) for v in (1.0, 1.0, 2.0, 4.0, 7.0)], ("none", None)], "g string, x double")
    got = {r.g: r for r in K.mean_variance(df, ["g"], "x").collect()}
    assert got["five"].mean == 3.0 and math.isclose(got["five"].variance, 5.2) and got["five"].n == 5
    assert got["one"].mean == 1.0 and math.isnan(got["one"].variance)
    assert got["none"].n == 0 and got["none"].mean == 0.0 and math.isnan(got["none"].variance)


def test_profile_normalises_by_ks(spark):
    rows = [("a", 0, 0.2, "P2"), ("b", 0, 0.4, "P2"), ("a", 3, 0.1, "P2"), ("b", 3, 0.3, "P2"), ("a", 3, 0.6, "P4")]
    df = spark.createDataFrame(rows, "gene string, lag int, mean double, type string")
    got = {(r.t, r.l): r for r in K.profile(df, 0).collect()}
    assert math.isclose(got["Ks", 0].m, 0.3) and math.isclose(got["P2", 3].m, 0.2 / 0.3) and got["P2", 3].n == 2
    assert math.isnan(got["P4", 3].v) and got["P4", 3].n == 1


@pytest.mark.parametrize("rows, want", [([("a", 3, 0.1, "P4")], []), ([("a", 3, 0.1, "P2")], [("Ks", 0.0)]), ([("a", 0, 0.0, "P2"), ("a", 3, 0.1, "P2")], [("Ks", 0.0)])])
def test_profiles_without_ks(spark, rows, want):
    df = spark.createDataFrame(rows, "gene string, lag int, mean double, type string")
    assert [(r.t, r.m) for r in K.profile(df, 0).collect()] == want


def test_poisson_draws_repeat_and_have_mean_one(spark):
    df = spark.range(4000).select(F.col("id").cast("string").alias("gene"))
    k = df.select(K.poisson_weight(F.col("gene"), F.lit("boot_0")).alias("k"))
    a, b = (sorted(r.k for r in k.collect()) for _ in range(2))
    assert a == b and abs(np.mean(a) - 1) < 0.06 and abs(np.var(a) - 1) < 0.12


def test_q_factor_is_the_median_ratio(spark):
    rows = [(l, m, 0.1, 1, t, "all") for l, m, t in [(3, 2.0, "P2"), (3, 1.0, "P4"), (6, 3.0, "P2"), (6, 1.0, "P4"), (33, 9.0, "P2"), (33, 1.0, "P4"), (0, 0.5, "Ks")]]
    df = spark.createDataFrame(rows, "l int, m double, v double, n int, t string, b string")
    assert K.q_factor(df).first().q == 2.5
    scaled = {r.l: r for r in K.scale_p4(df).collect()}
    assert scaled[3].m == 2.5 and scaled[3].t == "P2" and math.isclose(scaled[3].v, 0.625) and scaled[0].m == 0.5


def sam(name, pos, seq, cigar=None, mapq=60, qual=40, rname="c"):
    return (name, rname, pos, mapq, cigar or f"{len(seq)}M", seq, [qual] * len(seq) if isinstance(qual, int) else qual, 0)


READ = "qname string, rname string, pos int, mapq int, cigar string, seq string, qual array<int>, ordinal long"


def test_reads_are_laid_on_the_reference(spark):
    rows = [sam("s", 0, "aaCCGG", "2S4M"), sam("d", 0, "AACC", "2M2D2M"), sam("i", 0, "AACC", "2M1I1M"), sam("q", 0, "AACC", qual=[40, 10, 40, 40]), sam("x", 0, "AACC", "9M")]
    got = {r.qname: r.ref_seq for r in R.mapped(spark.createDataFrame(rows, READ), 30).collect()}
    assert got == {"s": "CCGG", "d": "AA--CC", "i": "", "q": "A-CC", "x": ""}


def test_reads_find_their_gene(spark):
    genes = spark.createDataFrame([("c", 1, 30, 1, "g1"), ("c", 25, 60, 1, "g2"), ("c", 5001, 9000, -1, "g3"), ("d", 1, 30, 1, "g4")], "seq_name string, start int, end int, strand int, gene string")
    reads = spark.createDataFrame([sam(str(p), p, "A", rname=c) for c, p in (("c", 0), ("c", 29), ("c", 30), ("c", 60), ("c", 5000), ("c", 8999), ("c", 9000), ("d", 3), ("e", 3))], READ)
    got = sorted((r.rname, r.pos, r.gene) for r in R.assign_genes(reads, genes).collect())
    assert got == [("c", 0, "g1"), ("c", 29, "g1"), ("c", 30, "g2"), ("c", 5000, "g3"), ("c", 8999, "g3"), ("d", 3, "g4")]


def test_reverse_strand_codons_and_quality_filter(spark):
    genes = spark.createDataFrame([("c", 1, 12, -1, "g")], "seq_name string, start int, end int, strand int, gene string")
    o = R.ReadOptions(min_read_length=6)
    reads = spark.createDataFrame([sam("a", 1, "AAACCCTTT"), sam("b", 0, "AAACCC", mapq=3), sam("c", 0, "AAACCC", "3M1I2M")], READ)
    assigned = R.assign_genes(R.good_reads(reads, o), genes)
    got = [(r.qname, r.gene_pos, r.codon) for r in R.read_codons(R.mapped(assigned, 30)).orderBy("gene_pos").collect()]
    assert got == [("a", 1, "GGT"), ("a", 2, "AAG")]


def test_lag_zero_counts_twice(spark):
    pile = spark.createDataFrame([("g", 1, 9, p, f"r{k}", c) for k, (a, b) in enumerate([("TTT", "TTC"), ("TTC", "TTT"), ("TTT", "TTT")]) for p, c in ((0, a), (1, b))], "gene string, start int, end int, gene_pos int, qname string, codon string")
    rows = {r.lag: r for r in R.p2_profile(pile, R.ReadOptions()).collect()}
    assert rows[0].n == 30 and rows[3].n == 3 and math.isclose(rows[3].mean, 1 / 3)
    once = {r.lag: r for r in R.p2_profile(pile, R.ReadOptions(dedupe_lag0=True)).collect()}
    assert once[0].n == 6


def test_site_pairs_equal_counting(spark):
    rng = np.random.default_rng(3)
    sites = [(c, int(p), list(rng.choice(list("01."), 70))) for c in "xy" for p in np.unique(rng.integers(1, 300, 40))]
    got = {r.l: r for r in V.site_profile(spark.createDataFrame(sites, "chrom string, pos long, gts array<string>"), 25).collect()}
    sums, counts = {}, {}
    for c, p, g in sites:
        for c2, p2, g2 in sites:
            if c == c2 and 0 <= p2 - p < 25:
                pairs = [(a, b) for a, b in zip(g, g2, strict=True) if "." not in (a, b)]
                n = len(pairs) * (len(pairs) - 1) // 2
                if n:
                    xy = sum(a[0] != b[0] and a[1] != b[1] for a, b in itertools.combinations(pairs, 2))
                    sums[p2 - p] = sums.get(p2 - p, 0) + xy / n
                    counts[p2 - p] = counts.get(p2 - p, 0) + 1
    assert {k: r.n for k, r in got.items()} == counts
    assert all(math.isclose(r.m, sums[k] / (counts[0] if k == 0 else sums[0])) for k, r in got.items())


@pytest.mark.parametrize("r1", ["const", "exp", "geom"])
def test_fit_recovers_known_parameters(r1):
    x = np.arange(3.0, 300.0, 3.0)
    for theta, phi, f, ds in ((1e-4, 1e-3, 400.0, 0.02), (5e-4, 3e-4, 900.0, 0.05)):
        y = M.model_curve(x, theta, phi, f, ds, r1)
        got = T.solve(x, y, ds, T.FitOptions(r1=r1))
        assert got["chisq"] < 1e-8 and got["ndata"] == 99
        if r1 == "const":
            assert np.allclose([got["theta_s"], got["phi_s"], got["fbar"]], [theta, phi, f], rtol=2e-2)


def test_fit_methods_agree_and_others_are_refused(spark):
    x = np.arange(3.0, 300.0, 3.0)
    y = M.model_curve(x, 5e-4, 3e-4, 900.0, 0.05) * (1 + 0.01 * np.sin(x))
    one, two = (T.solve(x, y, 0.05, T.FitOptions(method=m, starts=4)) for m in ("least_squares", "nelder"))
    assert math.isclose(one["chisq"], two["chisq"], rel_tol=1e-4) and one["nfev"] != two["nfev"]
    with pytest.raises(ValueError, match="method"):
        T.fit(spark.createDataFrame([], "group string, d_sample double, x array<double>, y array<double>"), T.FitOptions(method="guess"))


def test_fit_and_zero_model_by_group(spark):
    x = list(range(3, 300, 3))
    y = M.model_curve(np.array(x, float), 1e-4, 1e-3, 400.0, 0.02)
    rows = [(0, 0.02, 0.0, 9, "Ks", b) for b in ("all", "boot_0", "none")] + [(l, float(v), 0.0, 9, "P2", b) for b in ("all", "boot_0") for l, v in zip(x, y, strict=True)]
    data = T.fit_data(spark.createDataFrame(rows, "l int, m double, v double, n int, t string, b string"))
    fits = T.fit(data, T.FitOptions(starts=4))
    got = {r.group: r for r in T.fit_results(fits).collect()}
    assert set(got) == {"all", "boot_0"} and math.isclose(got["all"].theta_s, 1e-4, rel_tol=0.05)
    zero = {r.group: r for r in T.zero_model(data).collect()}
    assert math.isclose(zero["all"].chisq, float(((y - y.mean()) ** 2).sum()), rel_tol=1e-9) and math.isclose(zero["all"].theta_s, 0.02 / (1 - 4 / 3 * 0.02))
    both = T.compare(data, fits).filter("group = 'all'").collect()
    assert {r.model for r in both} == {"recombination", "zero"} and min(both, key=lambda r: r.aic).model == "recombination"


def test_distance_matrix_is_symmetric(spark):
    rows = spark.createDataFrame([("a_vs_b", 1.0), ("a_vs_c", 2.0), ("all", 9.0)], "group string, theta_pool double")
    got = {r.isolate: r for r in U.distance_matrix(rows).collect()}
    assert got["a"].b == got["b"].a == 1.0 and got["b"].b == 0.0 and got["b"].c is None


def test_options_are_checked():
    with pytest.raises(ValueError):
        C.codon_position(5)
    assert C.codon_position(4) == (2, True) and C.codon_position(1) == (0, False)
