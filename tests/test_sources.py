import gzip
import math
import struct
import zlib

import pyarrow as pa
from pyspark.sql import functions as F

from lagweave.operators import fit as T
from lagweave.operators.alignment import CodingOptions, gene_profile
from lagweave.sources import alignments as X
from lagweave.sources import bam as B
from lagweave.sources import profiles as S
from lagweave.sources import reads as R
from lagweave.streaming.collector import read_profile_now, read_record_stream, run_collector

XMFA = """>g1 1 a
ATG
AAA
>g1 1 b
ATGAAG
= some text
>g2 7 a
TTT
=
>g3 9 a
CCC
>g3 9 b
CCA
"""


def test_xmfa(spark, tmp_path):
    (tmp_path / "a.xmfa").write_text(XMFA)
    rows = X.read_xmfa(spark, str(tmp_path / "a.xmfa")).orderBy("block", "seq_idx").collect()
    assert [(r.gene, r.pos, r.genome, r.seq_idx, r.seq) for r in rows] == [("g1", "1", "a", 0, "ATGAAA"), ("g1", "1", "b", 1, "ATGAAG"), ("g3", "9", "a", 0, "CCC"), ("g3", "9", "b", 1, "CCA")]
    assert X.read_xmfa(spark, str(tmp_path / "a.xmfa"), min_sequences=1).select("gene").distinct().count() == 3
    assert X.count_blocks(spark, str(tmp_path / "a.xmfa")) == 2


def test_xmfa_round_trip(spark, tmp_path):
    aln = spark.createDataFrame([("g1", "1", "a", 0, "ATGAAA"), ("g1", "1", "b", 1, "ATGAAG"), ("g2", "5", "a", 0, "CC"), ("g2", "5", "b", 1, "CT")], "gene string, pos string, genome string, seq_idx int, seq string")
    X.write_xmfa(aln, str(tmp_path / "x"))
    assert sorted(map(tuple, X.read_xmfa(spark, str(tmp_path / "x")).select(*aln.columns).collect())) == sorted(map(tuple, aln.collect()))


def test_fasta_last_sequence_of_a_gene_wins(spark, tmp_path):
    (tmp_path / "m.fa").write_text(">g1 x m\nAT\nG\n>g2 x m\nCCC\n>g1 x n\nTTT\n")
    assert sorted((r.gene, r.seq, r.genome) for r in X.mates(X.read_fasta(spark, str(tmp_path / "m.fa"))).collect()) == [("g1", "TTT", "n"), ("g2", "CCC", "m")]


SAM = "@HD\tVN:1.0\nr1\t0\tc1\t5\t60\t2S3M\t*\t0\t0\tACGTA\tIII!I\nr2\t16\tc2\t1\t7\t*\t*\t0\t0\tNN\t*\n"


def test_sam(spark, tmp_path):
    (tmp_path / "r.sam").write_text(SAM)
    a, b = R.read_reads(spark, str(tmp_path / "r.sam")).orderBy("ordinal").collect()
    assert (a.qname, a.rname, a.pos, a.mapq, a.cigar, a.seq, a.qual) == ("r1", "c1", 4, 60, "2S3M", "ACGTA", [40, 40, 40, 0, 40]) and b.qual == []


def bam() -> bytes:
    names = b"".join(struct.pack("<i", len(n) + 1) + n + b"\0" + struct.pack("<i", 100) for n in (b"c1", b"c2"))
    out = b"BAM\x01" + struct.pack("<i", 3) + b"@HD" + struct.pack("<i", 2) + names
    for name, ref, pos, mapq, cigar, seq, qual in ((b"r1", 0, 4, 60, [(2, 4), (3, 0)], "ACGTA", bytes([40, 40, 40, 0, 40])), (b"r2", 1, 0, 7, [], "NN", b"\xff\xff")):
        codes = [B.BAM_BASES.index(c) for c in seq] + [0] * (len(seq) % 2)
        body = struct.pack("<iiBBHHHiiii", ref, pos, len(name) + 1, mapq, 0, len(cigar), 0, len(seq), -1, -1, 0) + name + b"\0"
        body += b"".join(struct.pack("<I", n << 4 | op) for n, op in cigar) + bytes(codes[i] << 4 | codes[i + 1] for i in range(0, len(codes), 2)) + qual
        out += struct.pack("<i", len(body)) + body
    return gzip.compress(out[:50]) + gzip.compress(out[50:]) + gzip.compress(b"")


def test_bam_reads_like_sam(spark, tmp_path):
    (tmp_path / "r.sam").write_text(SAM)
    (tmp_path / "r.bam").write_bytes(bam())
    keep = ["qname", "rname", "pos", "mapq", "cigar", "seq", "qual"]
    one, two = (R.read_reads(spark, str(tmp_path / f"r.{k}")).select(*keep).orderBy("qname").collect() for k in ("sam", "bam"))
    assert one == two


def bgzf(data, size):
    """Blocks with their own sizes in the subfield BC, as the format has them, and the empty block at the end."""
    out = b""
    for i in range(0, len(data) + size, size):
        d = zlib.compressobj(6, zlib.DEFLATED, -15)
        body = d.compress(data[i : i + size]) + d.flush()
        head = struct.pack("<4BI2BH2BHH", 31, 139, 8, 4, 0, 0, 255, 6, 66, 67, 2, len(body) + 25)
        out += head + body + struct.pack("<II", zlib.crc32(data[i : i + size]), len(data[i : i + size]))
    return out


def test_bam_blocks_are_read_by_their_size():
    whole = gzip.decompress(bam())
    inflated = lambda blocks: b"".join(d for _, d in B.blocks(pa.BufferReader(blocks), len(blocks)))
    records = lambda blocks: [body for _, body, _ in B.records(pa.BufferReader(blocks), len(blocks), 0, len(blocks))]
    for size in (1, 7, 60_000):
        blocks = bgzf(whole, size)
        assert B.block_size(memoryview(blocks)) == len(bgzf(whole[:size], size)) - len(bgzf(b"", size))
        assert inflated(blocks) == whole and records(blocks) == records(bam())
    large = bytes(range(256)) * 40_000
    assert inflated(bgzf(large, 60_000)) == large


def test_written_reads_genes_and_sites_are_read_back(spark, tmp_path):
    (tmp_path / "r.sam").write_text(SAM)
    reads = R.read_sam(spark, str(tmp_path / "r.sam")).filter("size(qual) > 0")
    R.write_sam(reads, str(tmp_path / "s"))
    keep = ["qname", "rname", "pos", "mapq", "cigar", "seq", "qual"]
    assert R.read_sam(spark, str(tmp_path / "s")).select(*keep).collect() == reads.select(*keep).collect()
    genes = spark.createDataFrame([("c", 1, 30, -1, "g1"), ("d", 5, 94, 1, "g2"), ("d", 7, 9, 0, "g3")], "seq_name string, start int, end int, strand int, gene string")
    R.write_gff(genes, str(tmp_path / "g"))
    assert sorted(R.read_gff(spark, str(tmp_path / "g")).drop("ordinal").collect()) == sorted(genes.collect())
    sites = spark.createDataFrame([("c", 5, ["0", "1", "."]), ("d", 7, ["1", "1", "0"])], "chrom string, pos long, gts array<string>")
    R.write_vcf(sites, str(tmp_path / "v"))
    assert sorted(R.read_vcf(spark, str(tmp_path / "v")).select("chrom", "pos", "gts").collect()) == sorted(sites.collect())


def test_gff_and_vcf(spark, tmp_path):
    (tmp_path / "g.gff").write_text("##gff-version 3\nc\tx\tCDS\t1\t30\t.\t-\t0\tID=g1;Name=n\nc\tx\tgene\t1\t30\t.\t+\t.\tID=g0\n")
    assert [(r.seq_name, r.start, r.end, r.strand, r.gene) for r in R.read_gff(spark, str(tmp_path / "g.gff")).collect()] == [("c", 1, 30, -1, "g1")]
    (tmp_path / "v.vcf").write_text("##x\n#CHROM\nc\t5\t.\tA\tT\t.\t.\t.\tGT:DP\t0|1:3\t1/.:2\nc\t6\t.\tAT\tT\t.\t.\t.\tGT\t0|1\t1\nd\t7\t.\tG\tC\t.\t.\t.\tGT\t0\t1")
    assert [(r.chrom, r.pos, r.gts) for r in R.read_vcf(spark, str(tmp_path / "v.vcf")).orderBy("pos").collect()] == [("c", 5, ["0", "1", "1", "."]), ("d", 7, ["0", "1"])]


def rows(spark):
    return spark.createDataFrame([("g1", 0, 0.5, 4, "P2"), ("g1", 3, 0.25, 4, "P2"), ("g2", 0, 0.1, 6, "P2")], "gene string, lag int, mean double, n long, type string")


def test_records_round_trip_and_streaming_profile(spark, tmp_path):
    S.write_records(rows(spark), str(tmp_path / "j"))
    back = S.read_records(spark, str(tmp_path / "j"))
    assert sorted(map(tuple, back.select("gene", "lag", "mean", "n", "type").collect())) == sorted(map(tuple, rows(spark).collect()))
    q = run_collector(read_record_stream(spark, str(tmp_path / "j")), str(tmp_path / "o"), str(tmp_path / "c"))
    q.awaitTermination(120)
    got = {(r.t, r.l): r.m for r in read_profile_now(spark, str(tmp_path / "o")).collect()}
    assert math.isclose(got["Ks", 0], 0.3) and math.isclose(got["P2", 3], 0.25 / 0.3)


def test_profile_csv_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(0, 0.5, float("nan"), 3, "Ks", "all"), (3, 0.25, 0.1, 3, "P2", "all"), (0, 0.4, 0.2, 3, "Ks", "boot_0")], S.CSV)
    S.write_profile(df, str(tmp_path / "p"))
    text = (next((tmp_path / "p").glob("part-*"))).read_text().splitlines()
    assert text[0].startswith("# l:") and text[6] == "l,m,v,n,t,b" and text[7].startswith("0,0.5,NaN,3,Ks,all")
    back = S.read_profile(spark, str(tmp_path / "p")).collect()
    assert len(back) == 3 and sum(math.isnan(r.v) for r in back) == 1


def test_report_text_and_lmfit_file(spark, tmp_path):
    df = spark.createDataFrame([("ratio", 2.0, 1.5, 0.5, 12, 1.4, 1.0, 2.5), ("c", 0.0, 1.5, 0.5, 3, 1.4, 1.0, 2.5)], "param string, value double, mean double, std double, size long, median double, lower double, upper double")
    got = {r.param: r.value for r in S.report_text(df, ["ratio", "c"]).collect()}
    assert got["ratio"].startswith("[gamma/mu]\nvalue = 2.0") and "bootstrapping size = 12" in got["ratio"] and "bootstrapping" not in got["c"] and "value = 0" in got["c"]
    fits = spark.createDataFrame([("all", *[0.5] * 11, True, 7, 99)], "group string, d_sample double, theta_s double, fbar double, phi_s double, theta_pool double, phi_pool double, c double, d_pool double, d_clonal double, chisq double, redchi double, success boolean, nfev long, ndata long")
    S.lmfit_lines(fits, 1e-5, 1000.0, 5e-5).select("value").write.text(str(tmp_path / "l"))
    r = S.read_lmfit(spark, str(tmp_path / "l")).first()
    assert (r.fit_success, r.nfev, r.datapoints, r.ds, r["red-chisq"]) == ("True", "7", "99", "0.5", "0.5")


def test_alignment_file_to_profile(spark, tmp_path):
    (tmp_path / "a.xmfa").write_text(XMFA)
    got = gene_profile(X.read_xmfa(spark, str(tmp_path / "a.xmfa")), CodingOptions(max_corr_length=6)).filter(F.col("lag") == 0)
    assert {(r.gene, r.n, r.mean) for r in got.collect()} == {("g1", 2, 0.5), ("g3", 1, 1.0)}


def test_programs_from_files_to_fits(spark, tmp_path):
    from lagweave.plans import apps

    (tmp_path / "a.xmfa").write_text(XMFA)
    out = str(tmp_path / "o")
    apps.xmfa(spark, str(tmp_path / "a.xmfa"), out, 6, 3)
    rows = S.read_profile(spark, f"{out}.csv").collect()
    assert {r.t for r in rows} == {"Ks"} | ({"P2"} if any(r.t == "P2" for r in rows) else set()) and any(r.b == "all" for r in rows)
    apps.xmfa_2clades(spark, str(tmp_path / "a.xmfa"), str(tmp_path / "a.xmfa"), str(tmp_path / "p"), 6, 0)
    apps.pair(spark, str(tmp_path / "a.xmfa"), str(tmp_path / "q"))
    assert S.read_profile(spark, str(tmp_path / "q")).filter("b = 'a_vs_b'").count() >= 1
    apps.collect(spark, f"{out}.json", str(tmp_path / "r"), 0, "P2")
    apps.fit(spark, f"{out}.csv", str(tmp_path / "f"))
    profile = [(0, 0.02, 0.0, 9, "Ks", "all")] + [(l, 0.4 + 0.3 / l, 0.0, 9, "P2", "all") for l in range(3, 100, 3)]
    S.write_profile(spark.createDataFrame(profile, S.CSV), str(tmp_path / "h"))
    apps.fit_compare(spark, str(tmp_path / "h"), str(tmp_path / "h"))
    apps.main(["fit-one", str(tmp_path / "h"), str(tmp_path / "one"), "--method", "nelder", "--starts", "2"])
    one = spark.read.option("header", True).csv(f"{tmp_path}/one_fit_results.csv").collect()
    assert [r.group for r in one] == ["all"] and float(one[0].theta_s) >= 0
    apps.lmfit_report(spark, str(tmp_path / "h"), str(tmp_path / "two"), T.FitOptions(phi_max=0.01, theta_init=1e-4))
    report = S.read_lmfit(spark, f"{tmp_path}/two_lmfit_report.csv").first()
    assert report.fit_success == "True" and 0 <= float(report.phiS) <= 0.01
    for model in ("recombination", "zero"):
        left = spark.read.option("header", True).schema("x double, residual double").csv(f"{tmp_path}/h_{model}_residuals.csv").collect()
        assert sorted(r.x for r in left) == [*map(float, range(3, 100, 3))] and all(math.isfinite(r.residual) for r in left)


def test_folders_without_a_scheme_are_on_the_default_file_system(spark):
    from lagweave.sources.scratch import qualified, shared_dir

    assert qualified(spark, "/a/b") == "file:///a/b" and qualified(spark, "file:///a/b") == "file:///a/b"
    assert shared_dir(spark).startswith("file:///")


def test_sam_parts_are_small_and_hold_the_reads_of_a_name_in_order(spark, tmp_path):
    """A hot contig fills several files, compressed; mates, of which the last counts, stay in order."""
    rows = [(f"r{k % 100}", 0, "hot", k, 60, "40M", "ACGT" * 10, [40] * 40, (k * 7919) % 3000) for k in range(3000)]
    reads = spark.createDataFrame(rows, B.READ).repartition(3)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # as this little would be one part
    try:
        R.write_sam(reads, str(tmp_path / "s"))
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    parts = list((tmp_path / "s").glob("part-*"))
    assert len(parts) > 1 and sum(p.stat().st_size for p in parts) < 100 * len(rows) / 3
    back = R.read_sam(spark, str(tmp_path / "s")).orderBy("ordinal").collect()
    of = lambda found: {q: [r.pos for r in found if r.qname == q] for q in {r.qname for r in found}}
    assert of(back) == of(reads.orderBy("ordinal").collect())
