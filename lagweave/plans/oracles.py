"""DuckDB SQL of the engine's queries: pairs of sequences are counted one by one, not in closed form."""

from __future__ import annotations

from ..functions.codons import TABLE_11
from .derived import ALIGNMENT_SQL, BASES, HEX

LAGS, BOOTS, CODONS, NONCODING_LAGS, SITE_LENGTH = 5, 20, 10, 4, 50

CODE = f"""
code AS (
  SELECT x.b || y.b || z.b AS codon, substr('{TABLE_11}', CAST(16 * x.i + 4 * y.i + z.i + 1 AS INTEGER), 1) AS aa
  FROM (VALUES ('T', 0), ('C', 1), ('A', 2), ('G', 3)) x(b, i), (VALUES ('T', 0), ('C', 1), ('A', 2), ('G', 3)) y(b, i), (VALUES ('T', 0), ('C', 1), ('A', 2), ('G', 3)) z(b, i)
)
"""

SITES = f"""
sized AS (SELECT *, min(CASE WHEN seq_idx = first_idx THEN len(seq) // 3 END) OVER (PARTITION BY gene GRP) AS first_n
          FROM (SELECT *, min(seq_idx) OVER (PARTITION BY gene GRP) AS first_idx FROM aln)),
cod AS (
  SELECT gene, genome, clade, seq_idx, first_n, i, substr(seq, CAST(3 * i + 1 AS INTEGER), 3) AS codon
  FROM sized, range(0, {CODONS}) t(i) WHERE i < len(seq) // 3
),
site AS (SELECT cod.*, coalesce(aa, '?') AS aa FROM cod LEFT JOIN code USING (codon)),
lagged AS (
  SELECT a.gene, a.clade, a.seq_idx, a.i, b.i - a.i AS l, a.aa || b.aa AS aa, substr(a.codon, POSITION, 1) AS x, substr(b.codon, POSITION, 1) AS y
  FROM site a JOIN site b ON a.gene = b.gene AND a.clade = b.clade AND a.seq_idx = b.seq_idx AND b.i >= a.i AND b.i - a.i < {LAGS}
  WHERE b.i < a.first_n GAP
)
"""
SYNONYMOUS = "AND NOT regexp_matches(a.codon, '[-N]') AND NOT regexp_matches(b.codon, '[-N]')"


def sites(position: int = 3, by_clade: bool = False, gaps: str = SYNONYMOUS) -> str:
    return SITES.replace("POSITION", str(position)).replace(" GRP", ", clade" if by_clade else "").replace("GAP", gaps)


HEAD = f"WITH {ALIGNMENT_SQL}, {CODE}"


def genes(test: str) -> str:
    """gp(gene, lag, mean, n, type): sequence pairs of a class that pass the test, over all of them."""
    return f"""
gp AS (
  SELECT p.gene, 3 * p.l AS lag, sum(CASE WHEN {test} THEN 1 ELSE 0 END) / count(*) AS mean, count(*) AS n, 'P2' AS type
  FROM lagged p JOIN lagged q ON p.gene = q.gene AND p.l = q.l AND p.i = q.i AND p.aa = q.aa AND p.seq_idx < q.seq_idx
  GROUP BY p.gene, p.l
)
"""


BOTH_DIFFER, BOTH_ALIKE = "p.x <> q.x AND p.y <> q.y", "p.x = q.x AND p.y = q.y"
GP = f"{HEAD}, {sites()}, {genes(BOTH_DIFFER)}"
OUT = "SELECT gene, CAST(lag AS BIGINT) AS lag, round(mean, 9) AS mean, CAST(n AS BIGINT) AS n, type FROM gp"

SQL: dict[str, str] = {
    "gene_profile": f"{GP} {OUT}",
    "json_roundtrip": f"{GP} {OUT}",
    "p00_profile": f"{HEAD}, {sites()}, {genes(BOTH_ALIKE)} {OUT}",
}

# every codon pair is one class; only bases of the alphabet make pairs
FIRST = sites(1, gaps="AND substr(a.codon, 1, 1) IN ('A','T','G','C') AND substr(b.codon, 1, 1) IN ('A','T','G','C')").replace("a.aa || b.aa AS aa", "'' AS aa")
SQL["first_base_profile"] = f"{HEAD}, {FIRST}, {genes(BOTH_DIFFER)} {OUT}"

SQL["noncoding_profile"] = f"""WITH {ALIGNMENT_SQL},
sized AS (SELECT *, min(CASE WHEN seq_idx = 0 THEN len(seq) END) OVER (PARTITION BY gene) AS first_n FROM aln),
base AS (SELECT gene, seq_idx, first_n, i, substr(seq, CAST(i + 1 AS INTEGER), 1) AS b FROM sized, range(0, 30) t(i) WHERE i < len(seq)),
lagged AS (
  SELECT a.gene, a.seq_idx, a.i, b.i - a.i AS l, '' AS aa, a.b AS x, b.b AS y
  FROM base a JOIN base b ON a.gene = b.gene AND a.seq_idx = b.seq_idx AND b.i >= a.i AND b.i - a.i < {NONCODING_LAGS}
  WHERE b.i < a.first_n AND a.b <> '-' AND b.b <> '-'
), {genes(BOTH_DIFFER).replace("3 * p.l", "p.l")} {OUT}"""


def collected(rows: str, boots: int) -> str:
    """prof(l, m, v, n, t, b) of rows(gene, lag, mean, type), with Poisson weights by the same hash."""
    steps, total, term = [], 0.0, 0.36787944117144233
    for k in range(13):
        total += term
        term /= k + 1
        steps.append(f"WHEN u < {total!r}::DOUBLE THEN {k}")
    return f"""
rep AS (SELECT 'all' AS b UNION ALL SELECT 'boot_' || i FROM range(0, {boots}) t(i)),
drawn AS (
  SELECT gene, b, CASE WHEN b = 'all' THEN 1 ELSE (CASE {" ".join(steps)} ELSE 13 END) END AS k
  FROM (SELECT gene, b, ('0x' || substr(md5(gene || '|' || b), 1, 8))::BIGINT / 4294967296.0::DOUBLE AS u FROM (SELECT DISTINCT gene FROM {rows}), rep)
),
unfolded AS (SELECT r.*, d.b FROM {rows} r JOIN drawn d USING (gene), range(0, 13) t(i) WHERE i < d.k),
coll AS (SELECT b, type, lag, count(*) AS n, avg(mean) AS mean, CASE WHEN count(*) > 1 THEN var_pop(mean) END AS variance FROM unfolded GROUP BY b, type, lag),
ks AS (
  SELECT b, coalesce(max(CASE WHEN lag = 0 THEN mean END), 0) AS m, max(CASE WHEN lag = 0 THEN variance END) AS v, coalesce(max(CASE WHEN lag = 0 THEN n END), 0) AS n
  FROM coll WHERE type = 'P2' GROUP BY b
),
prof AS (
  SELECT 0 AS l, m, v, n, 'Ks' AS t, b FROM ks
  UNION ALL
  SELECT c.lag, c.mean / ks.m, c.variance / (ks.m * ks.m), c.n, c.type, b FROM coll c JOIN ks USING (b) WHERE ks.m <> 0 AND NOT (c.type = 'P2' AND c.lag = 0)
)
"""


PROF = "SELECT CAST(l AS BIGINT) AS l, round(m, 9) AS m, round(v, 9) AS v, CAST(n AS BIGINT) AS n, t, b FROM prof"
SQL["profile_all"] = f"{GP}, {collected('gp', 0)} {PROF}"
SQL["profile_boot"] = f"{GP}, {collected('gp', BOOTS)} {PROF}"
SQL["gene_mean_variance"] = f"{GP} SELECT type, CAST(lag AS BIGINT) AS lag, count(*) AS n, round(avg(mean), 9) AS mean, round(CASE WHEN count(*) > 1 THEN var_pop(mean) END, 9) AS variance FROM gp GROUP BY type, lag"
SQL["pair_statistics"] = f"{GP} SELECT round(avg(n), 9) AS avg_pairs, round(stddev_samp(n), 9) AS stdev_pairs, count(*) AS num_genes FROM gp WHERE type = 'P2' AND lag = 0"

CLADES = f"{HEAD}, {sites(by_clade=True)}"
MET = "lagged p JOIN lagged q ON p.gene = q.gene AND p.l = q.l AND p.i = q.i AND p.aa = q.aa AND p.clade = 0 AND q.clade = 1"
for name, test in (("clade_profile", BOTH_DIFFER), ("clade_p00", BOTH_ALIKE)):
    SQL[name] = f"""{CLADES}
SELECT p.gene, CAST(3 * p.l AS BIGINT) AS lag, round(sum(CASE WHEN {test} THEN 1 ELSE 0 END) / count(*), 9) AS mean, count(*) AS n, 'P2' AS type FROM {MET} GROUP BY p.gene, p.l"""
SQL["clade_aps"] = f"""{CLADES},
met AS (SELECT p.gene, p.l, p.i, p.aa, count(*) AS pairs, count(DISTINCT p.x || p.y) AS cells FROM {MET} GROUP BY ALL)
SELECT gene, CAST(3 * l AS BIGINT) AS lag, round(sum(pairs) / sum(pairs * cells), 9) AS mean, CAST(sum(pairs * cells) AS BIGINT) AS n, 'P2' AS type FROM met GROUP BY gene, l"""

PAIRS = f"""{HEAD}, {sites()},
pairpos AS (
  SELECT a.gene, least(a.genome, b.genome) || '_vs_' || greatest(a.genome, b.genome) AS pair, a.seq_idx AS s, b.seq_idx AS t, a.i, substr(a.codon, 3, 1) <> substr(b.codon, 3, 1) AS dif
  FROM site a JOIN site b ON a.gene = b.gene AND a.seq_idx < b.seq_idx AND a.i = b.i AND a.aa = b.aa WHERE a.aa <> '?'
),
pairs AS (
  SELECT a.gene, a.pair, 3 * (b.i - a.i) AS lag, avg(CASE WHEN a.dif AND b.dif THEN 1.0 ELSE 0.0 END) AS mean, count(*) AS n, 'P2' AS type
  FROM pairpos a JOIN pairpos b ON a.gene = b.gene AND a.s = b.s AND a.t = b.t AND b.i >= a.i AND b.i - a.i < {LAGS} GROUP BY a.gene, a.pair, a.s, a.t, b.i - a.i
),
coll AS (
  SELECT pair AS b, type, lag, count(*) AS n, avg(mean) AS mean, CASE WHEN count(*) > 1 THEN var_pop(mean) END AS variance FROM pairs GROUP BY pair, type, lag
  UNION ALL
  SELECT 'all', type, lag, count(*), avg(mean), CASE WHEN count(*) > 1 THEN var_pop(mean) END FROM pairs GROUP BY type, lag
),
ks AS (SELECT b, max(CASE WHEN lag = 0 THEN mean END) AS m, max(CASE WHEN lag = 0 THEN variance END) AS v, max(CASE WHEN lag = 0 THEN n END) AS n FROM coll GROUP BY b),
prof AS (
  SELECT 0 AS l, coalesce(m, 0) AS m, v, coalesce(n, 0) AS n, 'Ks' AS t, b FROM ks
  UNION ALL
  SELECT c.lag, c.mean / ks.m, c.variance / (ks.m * ks.m), c.n, c.type, b FROM coll c JOIN ks USING (b) WHERE ks.m <> 0 AND c.lag <> 0
)
"""
SQL["pair_profile"] = f"{PAIRS} SELECT pair, CAST(lag AS BIGINT) AS lag, count(*) AS n_pairs, CAST(sum(n) AS BIGINT) AS codons, round(avg(mean), 9) AS mean FROM pairs GROUP BY pair, lag"
SQL["pair_collect"] = f"{PAIRS} {PROF}"
DIST = """dist AS (
  SELECT split_part(b, '_vs_', 1) AS a, split_part(b, '_vs_', 2) AS b, m AS value FROM prof WHERE t = 'Ks' AND contains(b, '_vs_')
), sym AS (
  SELECT a, b, value FROM dist WHERE a <> b UNION ALL SELECT b, a, value FROM dist WHERE a <> b
  UNION ALL SELECT DISTINCT a, a, 0.0 FROM (SELECT a FROM dist UNION SELECT b FROM dist)
)"""
SQL["genome_distances"] = f"{PAIRS}, {DIST} SELECT a, b, round(value, 9) AS value FROM sym"
NAMES = [f"g{i:02d}" for i in range(12)]
SQL["distance_matrix"] = f"{PAIRS}, {DIST} SELECT a AS isolate, {', '.join(f'''round(max(CASE WHEN b = '{n}' THEN value END), 9) AS {n}''' for n in NAMES)} FROM sym GROUP BY a"

READS = f"""WITH {CODE},
keys AS (SELECT DISTINCT l_partkey, l_orderkey, l_linenumber FROM lineitem),
raw AS (
  SELECT CAST(l_partkey AS VARCHAR) AS gene, l_partkey, l_orderkey, l_linenumber, p_brand AS rname, (l_partkey % 100000) * 100 + l_orderkey % 12 AS pos,
         CASE WHEN l_orderkey % 17 = 0 THEN 20 ELSE 60 END AS mapq, l_linenumber = 3 AS clipped,
         translate(md5('g' || l_partkey || '_0') || md5('g' || l_partkey || '_1') || md5('g' || l_partkey || '_2'), '{HEX}', '{BASES}') AS a,
         md5('m' || l_orderkey || '_' || l_linenumber || '_0') || md5('m' || l_orderkey || '_' || l_linenumber || '_1') || md5('m' || l_orderkey || '_' || l_linenumber || '_2') AS m,
         translate(md5('s' || l_orderkey || '_' || l_linenumber || '_0') || md5('s' || l_orderkey || '_' || l_linenumber || '_1') || md5('s' || l_orderkey || '_' || l_linenumber || '_2'), '{HEX}', '{BASES}') AS s,
         md5('q' || l_orderkey || '_' || l_linenumber) AS q
  FROM keys JOIN part ON p_partkey = l_partkey
),
laid AS (
  SELECT *, array_to_string(list_transform(range(CASE WHEN clipped THEN 6 ELSE 0 END, 72), lambda i:
    CASE WHEN substr(q, i % 32 + 1, 1) = 'f' THEN '-'
         WHEN substr(m, i + (CASE WHEN clipped THEN 1 ELSE l_orderkey % 12 + 1 END), 1) = '0' THEN substr(s, i + (CASE WHEN clipped THEN 1 ELSE l_orderkey % 12 + 1 END), 1)
         ELSE substr(a, i + (CASE WHEN clipped THEN 1 ELSE l_orderkey % 12 + 1 END), 1) END), '') AS ref_seq
  FROM raw WHERE mapq >= 30
),
hit AS (
  SELECT laid.l_orderkey, laid.l_linenumber, pos, ref_seq, CAST(g.p_partkey AS VARCHAR) AS gene, (g.p_partkey % 100000) * 100 AS start0, (g.p_partkey % 100000) * 100 + 90 AS stop, g.p_partkey % 4 = 0 AS minus
  FROM laid JOIN part g ON g.p_brand = laid.rname AND pos >= (g.p_partkey % 100000) * 100 AND pos < (g.p_partkey % 100000) * 100 + 90
),
cut AS (
  SELECT gene, start0, stop, l_orderkey, l_linenumber, (pos + j - start0) // 3 AS gene_pos,
         CASE WHEN minus THEN reverse(translate(substr(ref_seq, CAST(j + 1 AS INTEGER), 3), 'ACGT', 'TGCA')) ELSE substr(ref_seq, CAST(j + 1 AS INTEGER), 3) END AS codon
  FROM hit, range(0, 72) t(j) WHERE j + 3 <= len(ref_seq) AND (pos + j - start0) % 3 = 0 AND pos + j >= start0
),
pile0 AS (SELECT gene, start0, stop, gene_pos, l_orderkey AS read, arg_max(codon, l_linenumber) AS codon FROM cut WHERE NOT contains(codon, '-') GROUP BY ALL),
deep AS (SELECT gene FROM (SELECT gene, start0, stop, gene_pos, count(*) AS depth FROM pile0 GROUP BY ALL) GROUP BY gene, start0, stop HAVING count(CASE WHEN depth > 2 THEN 1 END) / (stop - start0) * 3.0 > 0.5),
pile AS (SELECT pile0.*, coalesce(aa, '?') AS aa FROM pile0 LEFT JOIN code USING (codon) WHERE gene IN (SELECT gene FROM deep)),
cells AS (
  SELECT a.gene, a.gene_pos AS i, b.gene_pos - a.gene_pos AS l, a.aa || b.aa AS aa, substr(a.codon, 3, 1) AS x, substr(b.codon, 3, 1) AS y,
         sum(CASE WHEN b.gene_pos = a.gene_pos THEN 2 ELSE 1 END) AS c
  FROM pile a JOIN pile b ON a.gene = b.gene AND a.read = b.read AND b.gene_pos >= a.gene_pos AND b.gene_pos - a.gene_pos < 10 GROUP BY ALL
),
sums AS (SELECT gene, i, l, aa, sum(c) AS t, sum(c * c) AS c2 FROM cells GROUP BY ALL HAVING sum(c) > 2),
rws AS (SELECT gene, i, l, aa, sum(r * r) AS r2 FROM (SELECT gene, i, l, aa, x, sum(c) AS r FROM cells GROUP BY ALL) GROUP BY ALL),
cls AS (SELECT gene, i, l, aa, sum(r * r) AS k2 FROM (SELECT gene, i, l, aa, y, sum(c) AS r FROM cells GROUP BY ALL) GROUP BY ALL),
xy AS (SELECT gene, i, l, sum((t * t - r2 - k2 + c2) / 2) AS xy, sum(t * (t - 1) / 2) AS n FROM sums JOIN rws USING (gene, i, l, aa) JOIN cls USING (gene, i, l, aa) GROUP BY ALL),
p2 AS (SELECT gene, 3 * l AS lag, sum(xy) / sum(n) AS mean, CAST(sum(n) AS BIGINT) AS n, 'P2' AS type FROM xy GROUP BY gene, l HAVING sum(n) > 0),
spot AS (SELECT gene, i, xy / n AS x FROM xy WHERE l = 0 AND n > 0),
p4 AS (SELECT a.gene, 3 * (b.i - a.i) AS lag, avg(a.x * b.x) AS mean, count(*) AS n, 'P4' AS type FROM spot a JOIN spot b ON a.gene = b.gene AND b.i >= a.i AND b.i - a.i < 20 GROUP BY a.gene, b.i - a.i),
rp AS (SELECT * FROM p2 UNION ALL SELECT * FROM p4)
"""
SQL["read_gene_join"] = f"{READS} SELECT gene, count(*) AS n_reads, CAST(min(pos) AS BIGINT) AS first_pos, CAST(max(pos) AS BIGINT) AS last_pos FROM hit GROUP BY gene"
SQL["pileup"] = f"{READS} SELECT gene, CAST(gene_pos AS BIGINT) AS gene_pos, count(*) AS depth, count(DISTINCT codon) AS codons FROM pile GROUP BY gene, gene_pos"
SQL["read_p2"] = f"{READS} SELECT gene, CAST(lag AS BIGINT) AS lag, round(mean, 9) AS mean, n, type FROM p2"
SQL["read_p4"] = f"{READS} SELECT gene, CAST(lag AS BIGINT) AS lag, round(mean, 9) AS mean, n, type FROM p4"
Q = f"""{READS}, {collected('rp', 5)},
ratio AS (SELECT b, a.m / c.m AS r FROM prof a JOIN prof c USING (b, l) WHERE a.t = 'P2' AND c.t = 'P4' AND l BETWEEN 1 AND 30 AND a.m > 0 AND c.m > 0),
q AS (SELECT b, coalesce((SELECT quantile_cont(r, 0.5) FROM ratio WHERE ratio.b = reps.b), 0.0) AS q FROM (SELECT DISTINCT b FROM prof) reps)
"""
SQL["q_factors"] = f"{Q} SELECT b, round(q, 9) AS q FROM q"
SQL["read_profile_scaled"] = f"""{Q}
SELECT CAST(l AS BIGINT) AS l, round(CASE WHEN t = 'P4' THEN m * q ELSE m END, 9) AS m, round(CASE WHEN t = 'P4' THEN v * q * q ELSE v END, 9) AS v, CAST(n AS BIGINT) AS n, CASE WHEN t = 'P4' THEN 'P2' ELSE t END AS t, b
FROM prof JOIN q USING (b) WHERE t = 'Ks' OR (t = 'P4' AND l > 0)"""

SQL["vcf_profile"] = f"""
WITH s AS (SELECT event_type AS chrom, event_id * 3 + 1 AS pos, translate(md5('v' || event_id), '{HEX}', '00000000111111..') AS g FROM events),
g AS (SELECT chrom, pos, k, substr(g, CAST(k AS INTEGER), 1) AS a FROM s, range(1, 33) t(k) WHERE substr(g, CAST(k AS INTEGER), 1) <> '.'),
c AS (
  SELECT x.chrom, x.pos AS p, y.pos - x.pos AS lag, count(*) AS t, count(CASE WHEN x.a = '0' AND y.a = '0' THEN 1 END) AS c00, count(CASE WHEN x.a = '0' AND y.a = '1' THEN 1 END) AS c01,
         count(CASE WHEN x.a = '1' AND y.a = '0' THEN 1 END) AS c10, count(CASE WHEN x.a = '1' AND y.a = '1' THEN 1 END) AS c11
  FROM g x JOIN g y ON x.chrom = y.chrom AND x.k = y.k AND y.pos >= x.pos AND y.pos - x.pos < {SITE_LENGTH} GROUP BY ALL
),
f AS (SELECT lag, (c00 * c11 + c01 * c10) / (t * (t - 1) / 2) AS p FROM c WHERE t > 1),
z AS (SELECT lag, sum(p) AS s, count(*) AS n FROM f GROUP BY lag)
SELECT CAST(lag AS BIGINT) AS l, round(CASE WHEN lag = 0 THEN s / n ELSE s / (SELECT s FROM z WHERE lag = 0) END, 9) AS m, 0.0::DOUBLE AS v, n, CASE WHEN lag = 0 THEN 'Ks' ELSE 'P2' END AS t, 'all' AS b FROM z"""

BOOT = f"{GP}, {collected('gp', BOOTS)}, ds AS (SELECT b, m AS d FROM prof WHERE t = 'Ks')"
SQL["fit_data"] = f"""{BOOT}
SELECT p.b AS "group", round(d, 9) AS d_sample, row_number() OVER (PARTITION BY p.b ORDER BY l) - 1 AS place, CAST(l AS DOUBLE) AS x, round(m, 9) AS y FROM prof p JOIN ds USING (b) WHERE t = 'P2' AND l BETWEEN 3 AND 9"""
ZERO = f"""{BOOT},
z AS (SELECT b, d, count(*) AS k, avg(m) AS d2, var_pop(m) AS v FROM prof JOIN ds USING (b) WHERE t = 'P2' AND l BETWEEN 3 AND 300 GROUP BY b, d),
zero AS (SELECT b AS "group", d AS d_sample, k AS ndata, d2, k * v AS chisq, CASE WHEN k > 1 THEN k * v / (k - 1) END AS redchi, k * ln(v) + 2 AS aic, d / (1 - 4.0::DOUBLE / 3 * d) AS theta_s FROM z)
"""
SQL["zero_model"] = f"""{ZERO}
SELECT "group", round(d_sample, 6) AS d_sample, ndata, round(d2, 6) AS d2, round(chisq, 6) AS chisq, round(redchi, 6) AS redchi, round(aic, 6) AS aic, round(theta_s, 6) AS theta_s, round(theta_s / (1 + 4.0::DOUBLE / 3 * theta_s), 6) AS d_clonal FROM zero"""
SQL["fit_report_stats"] = f"""{ZERO},
long AS (
  SELECT "group", 'd_sample' AS param, d_sample AS v FROM zero UNION ALL SELECT "group", 'theta_s', theta_s FROM zero
  UNION ALL SELECT "group", 'd_clonal', theta_s / (1 + 4.0::DOUBLE / 3 * theta_s) FROM zero
)
SELECT param, round(max(CASE WHEN "group" = 'all' THEN v END), 9) AS value, round(avg(v) FILTER ("group" <> 'all'), 9) AS mean, round(stddev_pop(v) FILTER ("group" <> 'all'), 9) AS std,
       count(*) FILTER ("group" <> 'all') AS size, round(quantile_cont(v, 0.5) FILTER ("group" <> 'all'), 9) AS median, round(quantile_cont(v, 0.05) FILTER ("group" <> 'all'), 9) AS lower, round(quantile_cont(v, 0.95) FILTER ("group" <> 'all'), 9) AS upper
FROM long GROUP BY param"""
SQL["histogram"] = f"""{ZERO},
v AS (SELECT theta_s AS v FROM zero WHERE "group" <> 'all'), lim AS (SELECT min(v) AS low, (max(v) - min(v)) / 5 AS width FROM v),
k AS (SELECT least(4, CAST(floor((v - low) / width) AS BIGINT)) AS bin, count(*) AS n FROM v, lim GROUP BY 1)
SELECT bin, round(low + bin * width, 9) AS low, round(low + (bin + 1) * width, 9) AS high, n FROM k, lim"""

CURVES = """WITH cv AS (
  SELECT CAST(s_suppkey AS VARCHAR) AS "group", 1e-4::DOUBLE * (1 + s_suppkey % 7) AS theta, 1e-4::DOUBLE * (1 + s_suppkey % 11) AS phi, 100.0::DOUBLE + 90 * (s_suppkey % 13) AS f, 0.005::DOUBLE + 0.001::DOUBLE * (s_suppkey % 17) AS ds, 2.0::DOUBLE / 3 AS w, 4.0::DOUBLE / 3 AS a
  FROM supplier
), pts AS (SELECT *, CAST(3 * i AS DOUBLE) AS x FROM cv, range(1, 100) t(i))"""
P2 = """2 * (r2 * theta + ds * r1 * (1 + r1 + r2 + a * theta)) * (r2 * pow(theta, 2) + pow(ds, 2) * (1 + r1 + r2 + a * theta) * (2 * pow(r1, 2) + r2 + 3 * r1 * r2 + pow(r2, 2) + a * (r1 + 2 * r2) * theta)
  - ds * theta * (2 * r2 + pow(r1 + r2, 2) + a * (r1 + 3 * r2) * theta)) / (pow(r1 + r2, 2) * (1 + 2 * r1 + r2 + 2 * a * theta) * (ds * (2 * r1 + a * theta) * (1 + r1 + r2 + a * theta) - theta * (r1 - r2 + a * theta))) / ds"""
SQL["model_curve"] = f"""{CURVES},
r AS (
  SELECT "group", x, theta, ds, a, 'const' AS kind, CASE WHEN x < f THEN w * phi * x ELSE w * phi * f END AS r1, w * phi * f AS top FROM pts
  UNION ALL SELECT "group", x, theta, ds, a, 'exp', w * phi * f * (1 - exp(-x / f)), w * phi * f FROM pts
  UNION ALL SELECT "group", x, theta, ds, a, 'geom', w * phi * f * (1 - pow(1 - 1 / f, x)), w * phi * f FROM pts
), v AS (SELECT "group", x, kind, {P2} AS p FROM (SELECT *, top - r1 AS r2 FROM r))
SELECT "group", x, round(max(CASE WHEN kind = 'const' THEN p END), 9) AS const, round(max(CASE WHEN kind = 'exp' THEN p END), 9) AS exp, round(max(CASE WHEN kind = 'geom' THEN p END), 9) AS geom FROM v GROUP BY "group", x"""
SQL["derived_params"] = f"""{CURVES},
p AS (SELECT *, (ds * (1 + phi * w * f + a * theta) - theta) / ((1 - a * ds) * (phi * w * f + a * theta) - a * ds) AS tp FROM cv)
SELECT "group", round(tp, 9) AS theta_pool, round(phi * tp / theta, 9) AS phi_pool, round(phi / theta, 9) AS ratio, round(phi * tp / theta * f, 9) AS rho, round(w * phi * f / (1 + w * phi * f + theta * a), 9) AS c, round(tp / (1 + a * tp), 9) AS d_pool, round(theta / (1 + a * theta), 9) AS d_clonal FROM p"""
SQL["coalescent_curve"] = f"""{CURVES},
c AS (
  SELECT "group", x, ds, a, w, theta, 2 * ds AS tp, 2 * phi AS pp,
         CASE WHEN x < f THEN 2 * phi * w * x / (1 + 2 * theta * a + phi * w * (f + x)) ELSE 2 * phi * w * x / (1 + 2 * theta * a + phi * w) END AS c1,
         CASE WHEN x < f THEN phi * w * (f - x) / (1 + 2 * theta * a + phi * w * (f + x)) ELSE 0 END AS c2
  FROM pts
)
SELECT "group", x, round((1 - c1 - c2) * (2 * theta / (1 + 2 * theta * a)) + c1 * (tp / (1 + tp * a)) + c2 * 2 * pow(tp / (1 + tp * a), 2) * (1 + tp * a + pp * w * x) / (1 + 2 * tp * a + 2 * pp * w * x) / ds, 9) AS p2 FROM c"""
SQL["file_pairing"] = """
SELECT 'cluster' || n_nationkey AS cluster, genome, n_nationkey % 2 = 0 AND genome = 'CORE' AS found FROM nation, (VALUES ('CORE'), ('FLEX')) g(genome)"""

# what was written to files and read back is what was written
for name, same in (("xmfa_files", "gene_profile"), ("json_files", "gene_profile"), ("sam_gff_files", "pileup"), ("bam_files", "pileup"), ("vcf_files", "vcf_profile"), ("profile_files", "profile_boot")):
    SQL[name] = SQL[same]
SQL["gff_files"] = """
SELECT p_brand AS seq_name, p_partkey % 100000 * 100 + 1 AS start, p_partkey % 100000 * 100 + 90 AS "end", CASE WHEN p_partkey % 4 = 0 THEN -1 ELSE 1 END AS strand, CAST(p_partkey AS VARCHAR) AS gene FROM part"""
SQL["vcf_region"] = SQL["vcf_profile"].replace("FROM events)", "FROM events WHERE event_id * 3 + 1 BETWEEN 1000 AND 20000)")
SQL["corrected_variance"] = SQL["gene_mean_variance"].replace("var_pop", "var_samp")
SQL["contig_counts"] = """
SELECT p_brand AS rname, count(*) AS n_reads FROM (SELECT DISTINCT l_partkey, l_orderkey, l_linenumber FROM lineitem) JOIN part ON p_partkey = l_partkey GROUP BY p_brand"""
SQL["zero_fit_files"] = f"""{ZERO}
SELECT "group", round(d_sample, 6) AS d_sample, round(theta_s, 6) AS theta_s, round(theta_s / (1 + 4.0::DOUBLE / 3 * theta_s), 6) AS d_clonal FROM zero"""
# the curves are exact, so every fit finds the parameters that they were made from
SQL["fit_recovery"] = """SELECT CAST(s_suppkey AS VARCHAR) AS "group", TRUE AS recovered, 0.0::DOUBLE AS chisq FROM supplier"""
SQL["fit_beats_grid"] = f"""{BOOT} SELECT b AS "group", TRUE AS beats FROM ds WHERE d > 0"""

SQL["merged_moments"] = f"""{GP}
SELECT type, CAST(lag AS BIGINT) AS lag, count(*) AS n, round(avg(mean), 9) AS mean, round(CASE WHEN count(*) > 1 THEN var_pop(mean) END, 9) AS variance,
       round(CASE WHEN count(*) > 1 THEN var_pop(0.5::DOUBLE + mean * 1e-9::DOUBLE) END * 1e18::DOUBLE, 4) AS tiny
FROM gp GROUP BY type, lag"""
# a run begins where the one before is of another contig; the runs before a row number it
SQL["contig_runs"] = """
WITH r AS (
  SELECT rname, row_number() OVER (ORDER BY k % 7 * 1000000000000000 + k, rname) - 1 AS pos
  FROM (SELECT p_brand AS rname, l_orderkey * 10 + l_linenumber AS k FROM (SELECT DISTINCT l_partkey, l_orderkey, l_linenumber FROM lineitem) JOIN part ON p_partkey = l_partkey)
), b AS (SELECT *, CASE WHEN rname IS DISTINCT FROM lag(rname) OVER (ORDER BY pos) OR pos = 0 THEN 1 ELSE 0 END AS new FROM r),
g AS (SELECT *, sum(new) OVER (ORDER BY pos ROWS UNBOUNDED PRECEDING) - 1 AS run FROM b)
SELECT CAST(run AS BIGINT) AS run, rname, min(pos) AS first, max(pos) AS last, count(*) AS n FROM g GROUP BY run, rname"""
SQL["mate_profile"] = f"""{HEAD}, {sites()},
mpos AS (
  SELECT a.gene, least(a.genome, b.genome) || '_vs_' || greatest(a.genome, b.genome) AS pair, b.seq_idx AS t, a.i, substr(a.codon, 3, 1) <> substr(b.codon, 3, 1) AS dif
  FROM site a JOIN site b ON a.gene = b.gene AND a.seq_idx = 0 AND a.i = b.i AND a.aa = b.aa WHERE a.aa <> '?'
), mates AS (
  SELECT a.gene, a.pair, 3 * (b.i - a.i) AS lag, avg(CASE WHEN a.dif AND b.dif THEN 1.0 ELSE 0.0 END) AS mean, count(*) AS n
  FROM mpos a JOIN mpos b ON a.gene = b.gene AND a.t = b.t AND b.i >= a.i AND b.i - a.i < {LAGS} GROUP BY a.gene, a.pair, a.t, b.i - a.i
)
SELECT pair, CAST(lag AS BIGINT) AS lag, count(*) AS n_pairs, CAST(sum(n) AS BIGINT) AS codons, round(avg(mean), 9) AS mean FROM mates GROUP BY pair, lag"""
ZIP = f"""
ones AS (SELECT gene, row_number() OVER (ORDER BY CAST(gene AS BIGINT)) - 1 AS pos FROM (SELECT DISTINCT gene FROM aln WHERE CAST(gene AS BIGINT) % 2 = 0)),
twos AS (SELECT gene, row_number() OVER (ORDER BY CAST(gene AS BIGINT)) - 1 AS pos FROM (SELECT DISTINCT gene FROM aln)),
zip AS (SELECT pos, o.gene AS gene_one, t.gene AS gene_two FROM ones o JOIN twos t USING (pos))
"""
SQL["zip_blocks"] = f"WITH {ALIGNMENT_SQL}, {ZIP} SELECT pos, gene_one, gene_two FROM zip"
# each block's own first sequence ends its codons, and so does the other's
SQL["zipped_profile"] = f"""{HEAD}, {ZIP}, {sites().replace("lagged AS (", "lagged AS MATERIALIZED (")},
pz AS MATERIALIZED (SELECT z.gene_one, z.gene_two, p.l, p.i, p.aa, p.x AS px, p.y AS py FROM zip z JOIN lagged p ON p.gene = z.gene_one),
xy AS (SELECT pz.gene_one AS gene, pz.l, px, py, q.x AS qx, q.y AS qy FROM pz JOIN lagged q ON q.gene = pz.gene_two AND q.l = pz.l AND q.i = pz.i AND q.aa = pz.aa)
SELECT gene, CAST(3 * l AS BIGINT) AS lag, round(sum(CASE WHEN px <> qx AND py <> qy THEN 1 ELSE 0 END) / count(*), 9) AS mean, count(*) AS n, 'P2' AS type FROM xy GROUP BY gene, l"""
SQL["user_statistic"] = f"{HEAD}, {sites()}, {genes('p.x <> q.x AND p.y = q.y')} {OUT}"


def significant(x: str, digits: int = 5) -> str:
    return f"CASE WHEN {x} = 0 THEN 0.0::DOUBLE ELSE round({x} * pow(10.0::DOUBLE, {digits - 1} - floor(log10(abs({x}))))) / pow(10.0::DOUBLE, {digits - 1} - floor(log10(abs({x})))) END"


SQL["user_r1"] = f"""{CURVES},
r AS (SELECT "group", theta, phi, f, ds, a, x, w * phi * x * f / (x + f) AS r1, w * phi * f - w * phi * x * f / (x + f) AS r2 FROM pts)
SELECT "group", round(sum({P2}), 6) AS sum, round({significant("any_value(theta)")}, 9) AS theta_s, round({significant("any_value(phi)")}, 9) AS phi_s, round({significant("any_value(f)")}, 9) AS f FROM r GROUP BY "group\""""
# the curves are exact: a fit finds what they were made from, and the other columns follow from that
KNOWN = f"""{CURVES}, known AS (
  SELECT *, (ds * (1 + phi * w * f + a * theta) - theta) / ((1 - a * ds) * (phi * w * f + a * theta) - a * ds) AS pool FROM cv
)"""
COLUMNS = {"d_sample": "ds", "theta_pool": "pool", "phi_pool": "phi * pool / theta", "ratio": "phi / theta", "fbar": "f", "c": "w * phi * f / (1 + w * phi * f + theta * a)", "d_pool": "pool / (1 + a * pool)", "d_clonal": "theta / (1 + a * theta)", "theta_s": "theta", "phi_s": "phi"}
SQL["fit_known"] = f"""{KNOWN} SELECT "group", {", ".join(f"round({significant(f'({x})')}, 12) AS {name}" for name, x in COLUMNS.items())} FROM known"""
SQL["compare_known"] = f"""{CURVES},
r AS (SELECT "group", theta, phi, f, ds, a, w, x, CASE WHEN x < f THEN w * phi * x ELSE w * phi * f END AS r1 FROM pts),
p AS (SELECT "group", ds, {P2} AS y FROM (SELECT *, w * phi * f - r1 AS r2 FROM r)),
z AS (SELECT "group", ds, count(*) AS k, var_pop(y) AS v FROM p GROUP BY "group", ds),
t AS (SELECT *, ds / (1 - 4.0::DOUBLE / 3 * ds) AS theta FROM z)
SELECT "group", k AS ndata, round(k * v, 9) AS chisq, round(k * v / (k - 1), 9) AS redchi, round(k * ln(v) + 2, 6) AS aic, round(theta, 9) AS theta_s, round(theta / (1 + 4.0::DOUBLE / 3 * theta), 9) AS d_clonal, 'recombination' AS best FROM t"""
SQL["zero_fit"] = f"""{ZERO},
s AS (SELECT *, CASE WHEN d2 <= 0 THEN 0.0::DOUBLE WHEN d2 * 4.0::DOUBLE / 3 < 1 THEN d2 / (2 * (1 - 4.0::DOUBLE / 3 * d2)) END AS t FROM zero)
SELECT "group", ndata, round(d_sample, 6) AS d_sample, round(t, 6) AS theta_s, round(CASE WHEN t IS NOT NULL THEN chisq + CASE WHEN d2 < 0 THEN ndata * d2 * d2 ELSE 0 END END, 6) AS chisq,
       round(CASE WHEN t IS NOT NULL THEN redchi END, 6) AS redchi, round(t / (1 + 4.0::DOUBLE / 3 * t), 6) AS d_clonal FROM s"""
SQL["histogram_auto"] = """
WITH v AS (SELECT CAST(s_acctbal AS DOUBLE) AS v FROM supplier WHERE s_acctbal IS NOT NULL),
m AS (SELECT count(*) AS n, min(v) AS low, max(v) AS high, quantile_cont(v, 0.75) - quantile_cont(v, 0.25) AS iqr FROM v),
k AS (SELECT *, CASE WHEN high <= low THEN 1 ELSE greatest(1, CAST(ceil((high - low) / least(greatest(2 * iqr / pow(n, 1.0::DOUBLE / 3), (high - low) / sqrt(n) / 2), (high - low) / (log2(n) + 1))) AS BIGINT)) END AS bins FROM m),
w AS (SELECT *, CASE WHEN high > low THEN (high - low) / bins ELSE 1.0::DOUBLE END AS width FROM k),
b AS (SELECT least(bins - 1, CAST(floor((v - low) / width) AS BIGINT)) AS bin, count(*) AS c FROM v, w GROUP BY 1)
SELECT bin, round(low + bin * width, 6) AS low, round(low + (bin + 1) * width, 6) AS high, c AS n FROM b, w"""


def kmeans_sql(rounds: int = 12, places: int = 50) -> str:
    """Hash-drawn centers and Lloyd rounds, unrolled, over (gene, j, x) in whole millionths."""
    u = lambda k: f"((CAST('0x' || substr(md5('0|{k}|' || gene), 1, 8) AS BIGINT) + 0.5::DOUBLE) / 4294967296.0::DOUBLE)"
    steps = [f"""names AS (SELECT DISTINCT gene FROM gp),
x AS (SELECT n.gene, j, CAST(coalesce(max(CASE WHEN g.lag = 3 * j THEN CAST(round(g.mean * 1000000) AS BIGINT) END), 0) AS BIGINT) AS x FROM names n CROSS JOIN range(0, {places}) t(j) LEFT JOIN gp g ON g.gene = n.gene AND g.lag = 3 * t.j GROUP BY n.gene, j),
f0 AS (SELECT gene FROM names ORDER BY {u(0)}, gene LIMIT 1),
d0 AS (SELECT a.gene, sum((a.x - b.x) * (a.x - b.x)) AS d FROM x a JOIN x b ON a.j = b.j AND b.gene = (SELECT gene FROM f0) GROUP BY a.gene),
f1 AS (SELECT gene FROM d0 WHERE d > 0 ORDER BY ln({u(1)}) / d DESC, gene LIMIT 1),
c0 AS (SELECT 0 AS i, j, x FROM x WHERE gene = (SELECT gene FROM f0) UNION ALL SELECT 1, j, x FROM x WHERE gene = (SELECT gene FROM f1))"""]
    for r in range(rounds + 1):
        steps.append(f"""e{r} AS (SELECT gene, i, sum((x.x - c.x) * (x.x - c.x)) AS d FROM x JOIN c{r} c USING (j) GROUP BY gene, i),
a{r} AS (SELECT gene, i FROM (SELECT *, row_number() OVER (PARTITION BY gene ORDER BY d, i) AS nr FROM e{r}) WHERE nr = 1)""")
        if r < rounds:
            steps.append(f"""m{r} AS (SELECT i, j, CAST(sum(x) AS BIGINT) AS s, count(*) AS n FROM a{r} JOIN x USING (gene) GROUP BY i, j),
c{r + 1} AS (SELECT c.i, c.j, CASE WHEN m.n IS NULL THEN c.x ELSE CAST((m.s - ((m.s % m.n) + m.n) % m.n) // m.n AS BIGINT) END AS x FROM c{r} c LEFT JOIN m{r} m ON c.i = m.i AND c.j = m.j)""")
    return f"{GP}, {', '.join(steps)} SELECT gene, CAST(i AS BIGINT) AS cluster FROM a{rounds}"


SQL["kmeans_profiles"] = kmeans_sql()

# what programs write is what their parts make
for name, same in (("xmfa_clade_files", "clade_profile"), ("pair_program", "pair_collect"), ("vcf_program", "vcf_profile"), ("bam_program", "read_profile_scaled")):
    SQL[name] = SQL[same]
SQL["block_counts"] = "SELECT count(DISTINCT l_partkey) AS blocks FROM lineitem"
SQL["clade_defaulted"] = f"""WITH c AS ({SQL["clade_profile"]}),
z AS (SELECT gene, max(CASE WHEN lag = 0 AND mean = 0 THEN n END) AS n FROM c GROUP BY gene)
SELECT c.gene, c.lag, CASE WHEN z.n IS NOT NULL THEN 0.0::DOUBLE ELSE c.mean END AS mean, coalesce(z.n, c.n) AS n, c.type FROM c JOIN z USING (gene)"""
SQL["gene_fit_data"] = f"""{GP},
d AS (SELECT gene, mean AS d FROM gp WHERE lag = 0)
SELECT p.gene AS "group", round(d, 9) AS d_sample, row_number() OVER (PARTITION BY p.gene ORDER BY p.lag) - 1 AS place, CAST(p.lag AS DOUBLE) AS x, round(p.mean, 9) AS y FROM gp p LEFT JOIN d USING (gene) WHERE p.lag BETWEEN 3 AND 9"""
LMFIT = {"ds": "ds", "thetaS": "theta", "f": "f", "phiS": "phi", "thetaP": "pool", "phiP": "phi * pool / theta", "c": "w * phi * f / (1 + w * phi * f + theta * a)", "dp": "pool / (1 + a * pool)", "dc": "theta / (1 + a * theta)"}
SQL["lmfit_files"] = f"""{KNOWN} SELECT "group", 'True' AS fit_success, 99 AS datapoints, {", ".join(f"round({significant(f'({x})')}, 12) AS {name}" for name, x in LMFIT.items())} FROM known"""
