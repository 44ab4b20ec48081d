"""BAM splits, merged moments, pair blocks, runs and zips, exact slopes, the caller's own statistics and rates, clusters."""

import itertools
import math
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lagweave.functions import dual
from lagweave.functions import models as M
from lagweave.functions import paircov as P
from lagweave.operators import alignment as A
from lagweave.operators import collect as K
from lagweave.operators import fit as T
from lagweave.operators import order as O
from lagweave.operators import tools as U
from lagweave.sources import bam as B
from lagweave.streaming import collector as S


def some_reads(n, seed=1):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        size = rng.choice([0, 1, 5, 72, 150])
        seq = "".join(rng.choice("ACGTN") for _ in range(size))
        out.append((f"r{rng.randrange(n)}", rng.randrange(4096), rng.choice(["c1", "c1", "c1", "c2", "*"]), rng.randrange(-1, 10**6), rng.randrange(255), f"{size}M" if size else "*", seq, [rng.randrange(42) for _ in range(size)] if rng.random() < 0.9 else [], i))
    return out


def test_bam_round_trip_in_any_number_of_splits(spark, tmp_path):
    rows = some_reads(3000)
    path = str(tmp_path / "b")
    B.write_bam(spark.createDataFrame(rows, B.READ).repartition(3), path)
    size = sum(f.stat().st_size for f in (tmp_path / "b").glob("*.bam"))
    keep = ["qname", "flag", "rname", "pos", "mapq", "cigar", "seq", "qual"]
    seen = None
    for splits in (1, 4, 16):
        got = B.read_bam(spark, path, -(-size // splits))
        assert got.rdd.getNumPartitions() >= splits
        found = [tuple(r) for r in got.orderBy("ordinal").collect()]
        assert sorted(map(repr, (r[:8] for r in found))) == sorted(map(repr, (tuple(r[:8]) for r in rows)))
        assert seen is None or found == seen
        seen = found
    # within a contig the files keep the order of the ordinals
    order = {c: [r[0] for r in seen if r[2] == c] for c in ("c1", "c2", "*")}
    assert order == {c: [r[0] for r in rows if r[2] == c] for c in order}
    assert B.read_bam(spark, path).select(*keep).count() == 3000
    B.write_bam(spark.createDataFrame(rows[:5], B.READ), path)  # replaces what was there
    assert B.read_bam(spark, path).count() == 5
    B.write_bam(spark.createDataFrame([], B.READ), str(tmp_path / "none"))
    assert B.read_bam(spark, str(tmp_path / "none")).count() == 0
    spark.dataSource.register(B.BamSource)
    assert spark.read.format("bam").load(path).count() == 5


class Task:
    def partitionId(self):
        return 0

    def taskAttemptId(self):
        return 0


@pytest.mark.parametrize("block", [40, 700, 60_000])
def test_every_split_begins_where_the_one_before_ends(tmp_path, monkeypatch, block):
    """Records that span many blocks, blocks that hold many records, splits without any."""
    monkeypatch.setattr(B.TaskContext, "get", staticmethod(Task))
    monkeypatch.setattr(B, "BLOCK", block)
    rows = some_reads(400, block)
    writer = B.BamWriter(str(tmp_path / "x"), [("c1", 10**6), ("c2", 10**6)], True)
    table = pa.Table.from_pylist([dict(zip(B.ARROW, r, strict=True)) for r in rows], schema=pa.schema(B.ARROW))
    done = writer.write(iter(table.to_batches(max_chunksize=50)))
    writer.commit([done])
    size = (tmp_path / "x" / "part-00000.bam").stat().st_size
    for splits in (1, 3, 17, 90):
        reader = B.BamReader([(done.final, size)], -(-size // splits))
        got = [tuple(r.values()) for p in reader.partitions() for b in reader.read(p) for r in b.to_pylist()]
        assert [g[:8] for g in got] == [tuple(r[:8]) for r in rows]
        assert [g[8] for g in got] == sorted({g[8] for g in got})


def test_a_split_that_begins_wrongly_is_noticed(tmp_path, monkeypatch):
    monkeypatch.setattr(B.TaskContext, "get", staticmethod(Task))
    writer = B.BamWriter(str(tmp_path / "x"), [("c1", 10**6), ("c2", 10**6)], True)
    monkeypatch.setattr(B, "BLOCK", 900)
    table = pa.Table.from_pylist([dict(zip(B.ARROW, r, strict=True)) for r in some_reads(300)], schema=pa.schema(B.ARROW))
    done = writer.write(iter(table.to_batches()))
    writer.commit([done])
    size = (tmp_path / "x" / "part-00000.bam").stat().st_size
    real = B.first_record
    monkeypatch.setattr(B, "first_record", lambda f, n, start, refs, first: (real(f, n, start, refs, first) or 0) + 1 if start else first)
    reader = B.BamReader([(done.final, size)], size // 3)
    with pytest.raises(ValueError, match="larger splits"):
        [*reader.read(reader.partitions()[0])]


def test_smallest_bins():
    """The format's own numbering: 1 + 8 + 64 ... bins above, each level eight times finer."""
    assert B.smallest_bin(0, 1) == 4681 and B.smallest_bin(0, 1 << 29) == 0 and B.smallest_bin(1 << 14, (1 << 14) + 5) == 4682
    assert B.smallest_bin(0, (1 << 14) + 1) == 585 and B.smallest_bin((1 << 26) - 1, (1 << 26) + 1) == 0


def test_moments_of_tiny_spreads(spark):
    rng = random.Random(1)
    values = [0.5 + rng.choice([-1e-9, 1e-9]) for _ in range(1000)]
    df = spark.createDataFrame([("a", v, rng.randrange(4)) for v in values], "g string, x double, k int")
    one = K.of_moments(K.moments(df, ["g"], "x"), ["g"]).first()
    assert one["n"] == 1000 and math.isclose(one["variance"], np.var(values), rel_tol=1e-6) and one["variance"] > 9e-19
    rows = df.collect()
    weighted = K.of_moments(K.moments(df, ["g"], "x", "k"), ["g"]).first()
    spread = [r.x for r in rows for _ in range(r.k)]
    assert weighted["n"] == len(spread) and math.isclose(weighted["variance"], np.var(spread), rel_tol=1e-6)


@pytest.mark.parametrize("parts", [1, 64])
def test_merging_any_parts_equals_the_whole(spark, parts):
    rng = random.Random(2)
    rows = [(rng.choice("ab"), rng.gauss(1e6, 1.0), i % 37) for i in range(600)] + [("c", 3.0, 0), ("d", None, 0)] + [("e", 1.0, i) for i in range(20)]
    df = spark.createDataFrame(rows, "g string, x double, part int")
    got = {r.g: r for r in K.of_moments(K.merged(K.moments(df, ["g", "part"], "x").drop("part"), ["g"], parts), ["g"]).collect()}
    for g in "ab":
        x = [r[1] for r in rows if r[0] == g]
        assert got[g].n == len(x) and math.isclose(got[g]["mean"], np.mean(x), rel_tol=1e-15) and math.isclose(got[g].variance, np.var(x), rel_tol=1e-9)
    assert got["c"].n == 1 and math.isnan(got["c"].variance) and "d" not in got and got["e"].n == 20 and got["e"].variance == 0
    corrected = {r.g: r.variance for r in K.of_moments(K.moments(df, ["g"], "x"), ["g"], corrected=True).collect()}
    assert math.isclose(corrected["a"], np.var([r[1] for r in rows if r[0] == "a"], ddof=1), rel_tol=1e-9)


def test_segments_of_a_stream_are_few_and_cover_all():
    for number in range(200):
        spans = S.spans(number)
        assert [i for a, b in spans for i in range(a, b + 1)] == [*range(number + 1)] and len(spans) <= 8
        own = [i for a, b in [*S.below(number), (number, number)] for i in range(a, b + 1)]
        assert own == [*range(spans[-1][0], number + 1)]
        assert all(s in S.spans(number - 1) for s in S.below(number))


def test_stream_profile_equals_the_batch_profile(spark, tmp_path):
    rng = random.Random(3)
    rows = [(f"g{i}", lag, rng.random(), 4, "P2") for i in range(11) for lag in (0, 3)]
    whole = spark.createDataFrame(rows, "gene string, lag int, mean double, n long, type string")
    from lagweave.sources.profiles import write_records

    for i in range(11):
        write_records(whole.filter(F.col("gene") == f"g{i}").coalesce(1), str(tmp_path / f"j/{i}"))
    stream = S.read_record_stream(spark, str(tmp_path / "j/*"), 1)
    out = str(tmp_path / "o")
    with pytest.raises(FileNotFoundError):
        S.read_profile_now(spark, out)
    S.run_collector(stream, out, str(tmp_path / "c"), 2).awaitTermination(300)
    tidy = lambda df: sorted((r.b, r.t, r.l, r.n, round(r.m, 12), round(r.v, 12)) for r in df.collect())
    assert tidy(S.read_profile_now(spark, out)) == tidy(K.profile(whole, 2))
    assert len([*(tmp_path / "o/profile").glob("0*")]) == S.KEPT + 1
    newest = max((tmp_path / "o/profile").glob("0*"))
    (newest / "_SUCCESS").unlink()  # as if the last write were under way
    assert S.read_profile_now(spark, out).count() > 0


def test_blocks_make_each_pair_once(spark):
    rng = random.Random(4)
    rows = [(g, i, f"x{i % 7}", [1]) for g, n in (("hot", 60), ("two", 2), ("one", 1)) for i in range(n)]
    df = spark.createDataFrame(rows, "gene string, seq_idx int, genome string, sites array<smallint>")
    both = A.pairs_within(df, 8)
    got = sorted((r.gene, *sorted((r.x.seq_idx, r.y.seq_idx))) for r in both.collect())
    assert got == sorted((g, a, b) for g, n in (("hot", 60), ("two", 2)) for a, b in itertools.combinations(range(n), 2))
    codes = "ATGAAATTTCCCGGGTAA"
    seqs = [("g", i, f"x{i}", "".join(rng.choice([codes[j : j + 3], codes[j : j + 2] + rng.choice("ACGT")]) for j in range(0, 18, 3)) * 15) for i in range(12)]
    aln = spark.createDataFrame([("g", 12, "short", "ATGA"), *seqs], "gene string, seq_idx int, genome string, seq string")
    o = A.CodingOptions(max_corr_length=240)
    tidy = lambda d: sorted(map(tuple, d.collect()))
    assert tidy(A.genome_pairs(aln, o, block=3)) == tidy(A.genome_pairs(aln, o))


@pytest.mark.parametrize("second", [True, False])
def test_words_of_flags_count_like_codons(spark, second):
    """Sequences longer than a word, lags beyond one, unequal lengths."""
    from lagweave.functions.codons import TABLE_11

    code = {a + b + c: TABLE_11[16 * i + 4 * j + k] for i, a in enumerate("TCAG") for j, b in enumerate("TCAG") for k, c in enumerate("TCAG")}
    rng = random.Random(5)
    cut = lambda s: [s[i : i + 3] for i in range(0, len(s) - len(s) % 3, 3)]
    seqs = ["".join(rng.choice("CG") + rng.choice("CT") + rng.choice("ACGTN") for _ in range(n)) for n in (100, 97, 33, 1)]
    aln = spark.createDataFrame([("g", i, f"x{i}", s) for i, s in enumerate(seqs)], "gene string, seq_idx int, genome string, seq string")
    got = {(r.pair, r.lag): (round(r["mean"] * r.n), r.n) for r in A.genome_pairs(aln, A.CodingOptions(max_corr_length=300), synonymous_second=second).collect()}
    want = {}
    for (i, s), (j, t) in itertools.combinations(enumerate(seqs), 2):
        x, y = cut(s), cut(t)
        n = min(len(x), len(y))
        alike = [code.get(x[k]) == code.get(y[k]) is not None for k in range(n)]
        differ = [x[k][2] != y[k][2] for k in range(n)]
        for lag in range(min(100, n)):
            good = [k for k in range(n - lag) if alike[k] and (alike[k + lag] or not second)]
            if good:
                want[f"x{i}_vs_x{j}", 3 * lag] = (sum(differ[k] and differ[k + lag] for k in good), len(good))
    assert got == want


def test_runs_and_numbers_over_many_stretches(spark):
    rng = random.Random(6)
    values = [v for _ in range(60) for v in [rng.choice(["a", "b", None])] * rng.choice([1, 1, 2, 40])]
    order = rng.sample(range(10**6), len(values))
    order.sort()
    df = spark.createDataFrame([*zip(values, order, strict=True)], "v string, o long").repartition(4)
    want, at = [], 0
    for k, (v, group) in enumerate(itertools.groupby(values)):
        n = len([*group])
        want.append((k, v, at, at + n - 1, n))
        at += n
    for stretch in (7, 10, 10**6):
        assert sorted(map(tuple, O.value_runs(df, "v", [F.col("o")], stretch).collect())) == want
    assert O.value_runs(df.limit(0), "v", [F.col("o")]).count() == 0
    numbers = [r.pos for r in O.numbered(df, [F.col("o")]).orderBy("o").collect()]
    assert numbers == [*range(len(values))]
    two = df.limit(5)
    got = O.zipped(df, two, [F.col("o")], [F.col("o").desc()]).collect()
    assert sorted(r.pos for r in got) == [0, 1, 2, 3, 4] and all(r.x.o == order[r.pos] for r in got)


def test_slopes_are_those_of_differences():
    x = np.arange(3.0, 300.0, 30.0)
    at = [3e-4, 900.0, 2e-4]
    for r1 in ("const", "exp", "geom", "zero"):
        curve = lambda p, r1=r1: M.model_curve(x, p[0], p[2], p[1], 0.05, r1)
        duals = [dual.Dual(np.array(v), [np.array(float(j == k)) for j in range(3)]) for k, v in enumerate(at)]
        got = curve(duals)
        for k in range(3):
            step = 1e-6 * at[k]
            up, down = ([v + s * step * (j == k) for j, v in enumerate(at)] for s in (1, -1))
            with np.errstate(all="ignore"):
                near = (curve(up) - curve(down)) / (2 * step)
            if np.isfinite(near).all():
                assert np.allclose(got.slopes[k], near, rtol=1e-4, atol=1e-9 * abs(near).max() + 1e-12), (r1, k)
    d = dual.Dual(np.array([2.0]), [np.array([1.0])])
    assert np.isclose((1 - 1 / d).slopes[0], 0.25) and np.isclose((3.0**np.array(2.0)), 9) and np.isclose(dual.power(d, d).slopes[0], 4 * (math.log(2) + 1))


def test_fits_side_by_side_are_those_alone():
    x = np.arange(3.0, 300.0, 3.0)
    rng = np.random.default_rng(1)
    sets = [(x[:n], M.model_curve(x, t, p, f, ds)[:n] * (1 + 0.01 * rng.standard_normal(n)), ds) for t, p, f, ds, n in ((1e-4, 1e-3, 400.0, 0.02, 99), (5e-4, 3e-4, 900.0, 0.05, 60), (2e-4, 2e-3, 100.0, 0.03, 4))]
    together = T.solve_many(*map(list, zip(*sets, strict=True)), T.FitOptions(starts=4))
    for one, (a, b, ds) in zip(together, sets, strict=True):
        alone = T.solve(a, b, ds, T.FitOptions(starts=4))
        assert math.isclose(one["chisq"], alone["chisq"], rel_tol=1e-8, abs_tol=1e-18) and one["ndata"] == len(a)
    assert T.solve_many([], [], [], T.FitOptions()) == []


@pytest.mark.parametrize("method", ["least_squares", "nelder"])
def test_the_number_of_evaluations_is_kept_to(method):
    x = np.arange(3.0, 300.0, 3.0)
    y = M.model_curve(x, 5e-4, 3e-4, 900.0, 0.05) * (1 + 0.01 * np.sin(x))
    few = T.solve(x, y, 0.05, T.FitOptions(method=method, starts=4, max_nfev=40))
    assert few["nfev"] <= 40 + 5 and not few["success"]
    many = T.solve(x, y, 0.05, T.FitOptions(method=method, starts=4))
    assert many["success"] and many["chisq"] <= few["chisq"]


def test_alternative_model_fits_its_own_curve(spark):
    x = np.arange(3.0, 300.0, 3.0)
    y = M.coalescent_curve(x, 2e-3, 1e-3, 0.08, 2e-3, 300.0, 0.03)
    df = spark.createDataFrame([("a", 0.03, x.tolist(), y.tolist()), ("b", None, [1.0], [1.0]), ("c", 0.1, [], [])], "group string, d_sample double, x array<double>, y array<double>")
    (r,) = T.fit_alternative(df).collect()
    assert r.group == "a" and r.chisq < 1e-4


def test_zero_model_step_by_step(spark):
    rows = [("a", 0.02, [0.3, 0.4]), ("b", 0.02, [0.8, 0.9]), ("c", 0.02, [-0.1, -0.3]), ("d", 0.02, [0.7499999999]), ("e", 0.02, [])]
    got = {r.group: r for r in T.fit_zero(spark.createDataFrame(rows, "group string, d_sample double, y array<double>")).collect()}
    m = 0.35
    assert math.isclose(got["a"].theta_s, m / (2 * (1 - 4 / 3 * m)), rel_tol=1e-12) and math.isclose(got["a"].chisq, 0.005) and got["a"].nfev > 2
    assert got["b"].theta_s is None and got["c"].theta_s == 0 and math.isclose(got["c"].chisq, 0.1)
    assert math.isclose(got["d"].theta_s, 0.7499999999 / (2 * (1 - 4 / 3 * 0.7499999999)), rel_tol=1e-5) and "e" not in got


def test_automatic_bins_are_numpys(spark):
    rng = np.random.default_rng(5)
    for values in (rng.normal(size=500), rng.exponential(size=77), np.array([1.0, 1.0, 1.0, 1.0, 9.0]), np.array([2.5]), np.round(rng.normal(size=200), 1)):
        df = spark.createDataFrame([("boot", float(v)) for v in values] + [("all", 1e9), ("boot", None), ("boot", math.nan)], "group string, v double")
        counts, edges = np.histogram(values, bins="auto")
        got = {(round(r.low, 9), r.n) for r in T.histogram(df, "v", "auto").collect()}
        if values.min() < values.max():
            assert got == {(round(e, 9), n) for e, n in zip(edges[:-1].tolist(), counts.tolist(), strict=True) if n}
        else:
            assert [n for _, n in got] == [len(values)]


def test_own_statistics_and_rates(spark):
    aln = spark.createDataFrame([("g", i, s) for i, s in enumerate(["ATGAAATTT", "ATGAAGTTC", "ATGAAATTC"])], "gene string, seq_idx int, seq string")
    both = lambda least=0: P.p11(least=least)
    tidy = lambda d: sorted(map(tuple, d.collect()))
    assert tidy(A.gene_profile(aln, statistic=both)) == tidy(A.gene_profile(aln))
    P.register_statistic("as p11", both)
    assert tidy(A.gene_profile(aln, statistic="as p11")) == tidy(A.gene_profile(aln))
    with pytest.raises(ValueError):
        P.register_statistic("p11", both)
    with pytest.raises(ValueError):
        A.gene_profile(aln, statistic="unknown")
    with pytest.raises(ValueError):
        M.register_r1("const", M.exp_r1)
    with pytest.raises(ValueError):
        T.fit(spark.createDataFrame([], "group string, d_sample double, x array<double>, y array<double>"), T.FitOptions(r1="unknown"))
    x = np.arange(3.0, 300.0, 3.0)
    rate = lambda x, f, phi, w=M.W: x * f / (x + f) * (w * phi)
    df = spark.createDataFrame([("a", 0.02, x.tolist(), M.model_curve(x, 1e-4, 1e-3, 400.0, 0.02, rate).tolist())], "group string, d_sample double, x array<double>, y array<double>")
    r = T.fit(df, T.FitOptions(r1=rate)).first()
    assert math.isclose(r.theta_s, 1e-4, rel_tol=1e-4) and math.isclose(r.fbar, 400.0, rel_tol=1e-4)


def test_clusters_repeat_and_part_what_is_apart(spark):
    rng = random.Random(8)
    rows = [(f"g{i}", lag, (0.1 if i % 2 else 0.6) + rng.random() / 50, 5, "P2") for i in range(40) for lag in (0, 3, 6)]
    df = spark.createDataFrame(rows, "gene string, lag int, mean double, n long, type string")
    one, two = (sorted(map(tuple, U.cluster_profiles(d, corr_type="P2").collect())) for d in (df, df.repartition(5)))
    assert one == two and len({c for g, c in one if int(g[1:]) % 2}) == 1 and len({c for _, c in one}) == 2
    same = spark.createDataFrame([(f"g{i}", 0, 0.5, 5, "P2") for i in range(4)], df.schema)
    assert {r.cluster for r in U.cluster_profiles(same, corr_type="P2").collect()} == {0}
    assert U.cluster_profiles(df.limit(0), corr_type="P2").count() == 0


def test_histogram_makes_its_values_once(spark):
    made = spark.sparkContext.accumulator(0)

    @F.udf("double")
    def value(i):
        made.add(1)
        return float(i)

    rows = spark.range(10).select(F.concat(F.lit("boot_"), F.col("id").cast("string")).alias("group"), value("id").alias("v"))
    got = sorted(tuple(r) for r in T.histogram(rows.union(spark.createDataFrame([("all", 99.0)], "group string, v double")), "v", 3).collect())
    assert got == [(0, 0.0, 3.0, 3), (1, 3.0, 6.0, 3), (2, 6.0, 9.0, 4)]
    assert made.value <= 20  # the filter on values and their column may each call it


def test_bam_records_are_made_and_read_a_batch_at_a_time(monkeypatch):
    """A batch's bytes and rows are those of its records one by one, with missing, odd and long cells."""
    rng = np.random.default_rng(3)
    rows = [(None, None, None, None, None, None, None, None, 0), ("", 4, "*", -1, 0, "*", "", [], 1), ("é", 16, "c2", 1 << 20, 255, "1M", "a", [0], 2), ("q", 0, "zz", 5, 9, "3M2D4S", "NRYxacg", [1] * 6, 3)]
    for k in range(40):
        n = int(rng.integers(0, 90))
        rows.append((f"r{k}", k, f"c{k % 3}", int(rng.integers(0, 1 << 28)), k, f"{n}M" if k % 3 else f"6S{k * 5000}N{n}M", "".join(rng.choice(list("ACGTN="), n)), [int(x) for x in rng.integers(0, 60, n)] if k % 5 else None, 4 + k))
    refs = {"c0": 0, "c1": 1, "c2": 2}
    batch = B.batch_of(rows).slice(0)
    bodies = [B.packed(row, refs) for row in batch.to_pylist()]
    real = B.packed
    monkeypatch.setattr(B, "packed", lambda *a: pytest.fail("a row by itself"))
    assert B.packed_batch(batch, refs) == b"".join(bodies)
    assert B.packed_batch(batch.slice(7, 20), refs) == b"".join(bodies[7:27])
    assert B.packed_batch(batch.slice(0, 0), refs) == b""
    places = [(100 + k, b[4:]) for k, b in enumerate(bodies)]
    assert B.decoded_batch(places, list(refs)).equals(B.batch_of([B.decoded(p, b, list(refs)) for p, b in places]))
    monkeypatch.setattr(B, "packed", real)
    odd = B.batch_of([("r", 0, "c0", 1, 9, "2M", "Aé", [3, 4], 0)])
    assert B.packed_batch(odd, refs) == B.packed(odd.to_pylist()[0], refs)
    with pytest.raises((ValueError, TypeError)):
        B.packed_batch(B.batch_of([("r", 0, "c0", 1, 9, "2M", "AC", [3, 400], 0)]), refs)
    with pytest.raises(ValueError):
        B.decoded_batch([(0, bodies[9][4:-3])], list(refs))
    assert pa.types.is_list(B.decoded_batch(places, list(refs)).column(7).type)
