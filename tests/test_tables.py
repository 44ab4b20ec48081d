"""Tables that tasks count over rows brought together by group: batches, hot groups and partitions change nothing but the cost."""

import itertools

import numpy as np
import pytest

from lagweave.functions import codons as C
from lagweave.operators import alignment as A
from lagweave.operators import tables as T

ALN = "gene string, pos string, genome string, seq_idx int, seq string"


def alignment(rng, genes, most):
    rows = []
    for g in range(genes):
        for k in range(int(rng.integers(1, most))):
            seq = "".join(rng.choice(list("ATGCATGC-N"), int(rng.integers(0, 25))))
            rows.append((f"g{g}", "1", f"x{k % 3}", k, seq))
    return rows


def amino(codon):
    return C.TABLE_11[16 * "TCAG".index(codon[0]) + 4 * "TCAG".index(codon[1]) + "TCAG".index(codon[2])]


def by_hand(rows, lags):
    """(gene, lag): (pairs that differ at both codons, pairs), sequence pair by sequence pair."""
    out = {}
    for gene in {r[0] for r in rows}:
        mine = sorted((r for r in rows if r[0] == gene), key=lambda r: r[3])
        reach = len(mine[0][4]) // 3
        for (x, y), lag in itertools.product(itertools.combinations([r[4] for r in mine], 2), range(lags)):
            for i in range(max(0, min(reach, len(x) // 3, len(y) // 3) - lag)):
                four = [s[3 * k : 3 * k + 3] for s in (x, y) for k in (i, i + lag)]
                if any(set(c) & set("-N") for c in four) or [amino(c) for c in four[:2]] != [amino(c) for c in four[2:]]:
                    continue
                d, n = out.get((gene, 3 * lag), (0, 0))
                out[gene, 3 * lag] = d + (four[0][2] != four[2][2] and four[1][2] != four[3][2]), n + 1
    return out


@pytest.mark.parametrize("hot", [10**9, 4])
def test_gene_profiles_equal_counting_pairs_in_any_partition(spark, monkeypatch, hot):
    """Partitions grow with the rows, and genes of more than HOT rows are dealt to several tasks and added up."""
    rows = alignment(np.random.default_rng(5), 12, 14)
    monkeypatch.setattr(T, "HOT", hot)
    monkeypatch.setattr(T, "PART_ROWS", 5)
    monkeypatch.setattr(T, "CHUNK", 7)
    df = spark.createDataFrame(rows, ALN)
    ready, _ = T.spread(df.select("gene", "seq_idx", "seq"), ["gene"], ["seq_idx"], "seq_idx")
    assert ready.rdd.getNumPartitions() == -(-len(rows) // 5)
    got = {(r.gene, r.lag): (round(r["mean"] * r.n), r.n) for r in A.gene_profile(df, A.CodingOptions(max_corr_length=9)).collect()}
    assert got == by_hand(rows, 3)


def test_letters_beyond_ascii_are_one_unknown_letter(spark):
    rows = [("g", "1", "a", 0, "AAéTTTCCC"), ("g", "1", "b", 1, "AAéTTTCCA")]
    got = {r.lag: (r["mean"], r.n) for r in A.gene_profile(spark.createDataFrame(rows, ALN), A.CodingOptions(max_corr_length=3)).collect()}
    assert got == {0: (0.5, 2)}


def test_clades_are_counted_in_one_pass_without_a_join(spark):
    df = spark.createDataFrame(alignment(np.random.default_rng(6), 5, 9), ALN)
    plan = A.clade_profile(df, df)._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan


def test_overlapping_genes_have_their_reads_each(spark):
    """A read is in every gene that holds its start if asked for; genes of one place are worked on once."""
    from lagweave.operators import reads as R

    genes = spark.createDataFrame([("c", 1, 9, 1, "a"), ("c", 1, 9, 1, "b"), ("c", 4, 12, -1, "d")], "seq_name string, start int, end int, strand int, gene string")
    rows = [(f"r{k}", "c", pos, 60, f"{len(seq)}M", seq, [40] * len(seq), k) for k, (pos, seq) in enumerate([(0, "TTTTTCTTG"), (0, "TTTTTTTTC"), (0, "TTC-TTTTA"), (3, "TTTTTC")])]
    reads = spark.createDataFrame(rows, "qname string, rname string, pos int, mapq int, cigar string, seq string, qual array<int>, ordinal long")
    o = R.ReadOptions(min_read_length=3, min_depth=0, overlapping=True)
    hit = R.assign_genes(reads, genes, True)
    assert sorted((r.qname, r.gene) for r in hit.collect()) == [("r0", "a"), ("r1", "a"), ("r2", "a"), ("r3", "a"), ("r3", "d")]
    got = {(r.gene, r.gene_pos): (r.depth, r.codons) for r in R.each_gene(R.pileup(R.read_tallies(reads, genes, o)), genes).collect()}
    own = {0: (3, 2), 1: (3, 2), 2: (4, 3)}  # a codon with a dash is none
    assert got == {(g, k): v for g in "ab" for k, v in own.items()} | {("d", 0): (1, 1), ("d", 1): (1, 1)}


def test_counted_pairs_are_the_rows_of_pairs_added_up_in_the_tasks(spark, monkeypatch):
    """Names beyond a word, unknown letters, hot genes, null names and ties of seq_idx; no row a pair leaves a task."""
    from lagweave.operators import collect as K
    from lagweave.operators import pairs as N

    rng = np.random.default_rng(8)
    rows = [(g, "1", None if k == 3 else f"x{k % 4}", k - (k == 6), "".join(rng.choice(list("TTCCCTGé-"), int(rng.integers(0, 400))))) for g, n in (("a", 9), ("b", 2), ("c", 1), ("hot", 30)) for k in range(n)]
    df = spark.createDataFrame(rows, ALN)
    o = A.CodingOptions(max_corr_length=300)
    want = {}
    for r in A.genome_pairs(df, o).collect():
        key = r.pair, r.lag, r["mean"], r.n
        want[key] = want.get(key, 0) + 1
    monkeypatch.setattr(N, "CHUNK", 50)
    monkeypatch.setattr(N, "CELLS", 500)
    monkeypatch.setattr(N, "HELD_ROWS", 4)
    counts = A.genome_pair_counts(df, o, block=7)
    got = {(r.pair, r.lag, r["mean"], r.n): r.times for r in counts.collect()}
    assert got == want
    tidy = lambda d: sorted((r.b, r.t, r.l, r.n, round(r.m, 12), None if np.isnan(r.v) else round(r.v, 12)) for r in d.collect())
    assert tidy(K.pair_collect(counts)) == tidy(K.pair_collect(A.genome_pairs(df, o)))
    plan = counts._jdf.queryExecution().executedPlan().toString()
    assert "Generate" in plan and "zip_with" not in plan  # rows go to blocks; pairs are never made as rows


@pytest.mark.parametrize("hot", [10**9, 4])
def test_genes_of_few_sequences_end_in_their_task(spark, monkeypatch, hot):
    """Rows without a sequence count towards the least number, as they did; no join asks for it, and like tables are one row."""
    monkeypatch.setattr(T, "HOT", hot)
    rows = [(g, "1", "x", k, "TTTCTTTT" + "CT"[k % 2] if k < n else None) for g, n, nulls in (("a", 2, 0), ("b", 1, 2), ("c", 5, 1), ("d", 2, 1)) for k in range(n + nulls)]
    df = spark.createDataFrame(rows, ALN)
    profile = A.gene_profile(df, A.CodingOptions(max_corr_length=3, min_sequences=3))
    assert sorted(r.gene for r in profile.collect()) == ["c", "d"]
    if hot > 4:
        assert "Join" not in profile._jdf.queryExecution().executedPlan().toString()
        counts = A.tables(df, A.CodingOptions(max_corr_length=3), ["gene"]).filter("gene = 'c'").collect()
        assert sum(r.times for r in counts) == 3 and len(counts) == 2  # codons 1 and 2 alike are one row, codon 3 has two letters


def test_alignment_is_made_by_one_shuffle(spark, monkeypatch, tmp_path):
    """Rows are numbered where those of a part already are, in partitions sized by the rows."""
    from lagweave.plans import derived as D

    spark.createDataFrame([(k % 3, k, 1) for k in range(9)], "l_partkey long, l_orderkey long, l_linenumber int").write.parquet(str(tmp_path / "lineitem.parquet"))
    monkeypatch.setattr(D, "stored", lambda df, name: df)
    plan = D.alignment(spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1


def test_blocks_to_zip_are_found_without_sorting_their_sequences(spark, monkeypatch):
    """A block's gene is that of its first sequence; the rows themselves go through a hash aggregate."""
    rows = [(1, "b", 2), (1, "a", 5), (1, "b", 7), (2, "c", 4), (2, None, 3), (3, "d", None), (4, "z", 1), (4, "y", 9)]
    df = spark.createDataFrame(rows, "block long, gene string, seq_idx int").repartition(3)
    monkeypatch.setattr(A, "zipped", lambda one, two, *order: one)
    got = A.zip_blocks(df, df)
    assert sorted(got.collect()) == [(1, "b"), (2, None), (3, None), (4, "z")]
    steps = [line for line in got._jdf.queryExecution().sparkPlan().toString().splitlines() if "Aggregate" in line]
    assert "HashAggregate" in steps[-1]  # the one over the rows


def mates_in_genes(spark):
    """Reads with mates and poor ends in genes that overlap, share a place or end in a hot one."""
    rng = np.random.default_rng(11)
    genes = spark.createDataFrame([("c", 1, 45, 1, "a"), ("c", 1, 45, 1, "b"), ("c", 31, 75, -1, "d"), ("e", 1, 30, 1, "far")], "seq_name string, start int, end int, strand int, gene string")
    rows = []
    for k in range(160):
        n = int(rng.integers(12, 40))
        seq, qual = "".join(rng.choice(list("TTTCCAGN-"), n)), [int(q) for q in rng.choice([10, 40, 40, 40, 40, 40], n)]
        rows.append((None if k % 40 == 0 else f"r{k // 2}", "ce"[k % 11 == 0], int(rng.integers(0, 45)), 60, f"{n}M", seq, qual, k))
    return spark.createDataFrame(rows, "qname string, rname string, pos int, mapq int, cigar string, seq string, qual array<int>, ordinal long"), genes


@pytest.mark.parametrize(("hot", "twin"), [(10**9, False), (10**9, True), (4, False)])
def test_whole_genes_end_in_their_tasks(spark, monkeypatch, hot, twin):
    """Piles, P2 and P4 equal those of the tables, which are stored for hot genes and for names of two places only."""
    from lagweave.operators import reads as R

    reads, genes = mates_in_genes(spark)
    if twin:
        genes = genes.union(spark.createDataFrame([("e", 4, 33, 1, "a")], genes.schema))
    o = R.ReadOptions(min_read_length=3, min_depth=1, min_coverage=0.2, max_corr_length=30, p2_lags=4, overlapping=True, min_allele_number=1)
    tally = R.read_tallies(reads, genes, o).cache()
    tidy = lambda df: sorted(tuple(round(x, 12) if isinstance(x, float) else x for x in r) for r in df.collect())
    want = [tidy(R.pileup(tally)), tidy(R.p2_of(tally, o)), tidy(R.p4_of(tally, o))]
    assert all(want)
    monkeypatch.setattr(T, "HOT", hot)
    monkeypatch.setattr(T, "CHUNK", 50)
    kept = []
    monkeypatch.setattr(R, "stored", lambda df, name: kept.append(name) or df)
    got = R.read_pileup(reads, genes, o), R.read_lags(reads, genes, o, ("P2",)), R.read_lags(reads, genes, o, ("P4",))
    assert [tidy(x) for x in got] == want
    assert tidy(R.read_lags(reads, genes, o)) == sorted(want[1] + want[2])
    assert bool(kept) == (hot == 4 or twin)


def test_reads_that_are_used_once_are_made_once_and_not_stored(spark, monkeypatch, tmp_path):
    """A filter on a read's length doesn't make its letters once more; only rows of genes are stored, before they are counted."""
    from lagweave.operators import reads as R
    from lagweave.plans import derived as D

    spark.createDataFrame([(k % 3, k, 1) for k in range(9)], "l_partkey long, l_orderkey long, l_linenumber int").write.parquet(str(tmp_path / "lineitem.parquet"))
    spark.createDataFrame([(k, "b") for k in range(3)], "p_partkey long, p_brand string").write.parquet(str(tmp_path / "part.parquet"))
    kept = []
    for m in (D, R):
        monkeypatch.setattr(m, "stored", lambda df, name: kept.append(name) or df)
    rows = R.gene_reads(D.reads(spark, str(tmp_path), once=True), D.genes(spark, str(tmp_path)), R.ReadOptions(overlapping=True))
    assert rows._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython [letters") == 1
    R.read_pileup(D.reads(spark, str(tmp_path), once=True), D.genes(spark, str(tmp_path)), R.ReadOptions(overlapping=True))
    assert kept == ["gene-reads"]
