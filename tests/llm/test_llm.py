import collections
import hashlib
import json
import math
import os
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from lagweave.llm import decontaminate as D
from lagweave.llm import exact_dedup as E
from lagweave.llm import fusefilter, language, lm_score, mixing, simhash, simhash_wide, token_counts, token_files, warc
from lagweave.llm import secrets as S
from lagweave.llm.components import components

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def lowered(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t or "")


def prose(rng, n, vocabulary=400, start=0):
    return " ".join(f"w{start + rng.randrange(vocabulary)}" for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    """Nulls, empty and long texts, ties, copies, near copies, a hot source, repeated rows and clashing ids."""
    rng = random.Random(4)
    base = prose(rng, 120)
    near = base.split()
    near[60] = "changed"
    out = [(i, prose(rng, rng.randrange(1, 60)), "en", "hot" if i % 3 else f"s{i % 4}", 1) for i in range(40)]
    out += [(100, base, "en", "hot", 1), (101, base.upper(), "en", "hot", 1), (102, " ".join(near), "en", "b", 1), (103, None, None, None, None), (104, "", "en", None, 0), (105, " \n ", "en", "b", 0)]
    out += [(106, prose(rng, 20000), "en", "hot", 1), (107, "one", "en", "b", 1), (107, "one", "en", "b", 1), (None, "nameless words here", "en", "b", 1), (108, base, "en", "c", 1)]
    return out


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, DOCS).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def clashing(docs):
    """The same rows with extra columns named like the operators' own."""
    return docs.select("*", F.lit(1).alias("size"), F.lit(2).alias("row"), F.lit("x").alias("key"), F.lit(3).alias("tid"), F.lit("a.b").alias("dot.ted"))


# 3 mixing


def test_mix_meets_targets_and_repeats(docs, rows):
    got = mixing.mix_report(docs).collect()
    assert len(got) == len(rows) and sorted(map(str, got)) == sorted(map(str, mixing.mix_report(docs.repartition(5)).collect()))
    size = collections.Counter()
    for _, t, _, s, _ in rows:
        size[s] += len(words(t))
    order = sorted((s for s in size if s is not None)) + [None]
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(order)}
    target, open_ = {}, set(order)
    total = 1.5 * sum(size.values())
    while True:
        level = (total - sum(2 * size[s] for s in order if s not in open_)) / max(1e-9, sum(weight[s] for s in open_))
        over = {s for s in open_ if weight[s] * level > 2 * size[s]}
        if not over:
            break
        open_ -= over
    target = {s: weight[s] * level if s in open_ else 2 * size[s] for s in order}
    by_source, largest, source = collections.Counter(), collections.Counter(), {}
    for i, t, _, s, _ in rows:
        source[i] = s
        largest[s] = max(largest[s], len(words(t)))
    for r in got:
        s = source[r.doc_id]
        assert r.source_size == size[s] and math.isclose(r.target, target[s], abs_tol=1e-5) and r.taken <= 2 * r.size
        by_source[s] += r.taken
    assert all(abs(by_source[s] - target[s]) <= largest[s] / 2 + 1e-6 for s in order)


def test_mix_keeps_columns_and_takes_as_reported(docs, empty):
    taken = collections.Counter(r.doc_id for r in mixing.mix(clashing(docs)).collect())
    report = collections.Counter()
    for r in mixing.mix_report(docs).collect():
        report[r.doc_id] += r.copies
    assert taken == +report
    assert mixing.mix(clashing(docs)).columns == clashing(docs).columns
    assert mixing.mix(empty).count() == 0 and mixing.mix_report(empty).count() == 0


@pytest.mark.parametrize("name", [7, None])
def test_mix_divides_rows_that_draw_alike(spark, name):
    """A source of one repeated row, one of repeated ids with different texts, and one that is taken twice as a whole."""
    made = [(name, "x " * 50, "en", "a", 1)] * 40 + [(name, "y " * (1 + k % 50), "en", "b", 1) for k in range(60)] + [(k, "z " * 20 if k % 2 else "", "en", "c", 1) for k in range(100, 400)]
    made += [(k, "q " * 100, "en", "d", 1) for k in range(1000, 1040)]
    docs = spark.createDataFrame(made, DOCS).repartition(3)
    report = mixing.mix_report(docs).collect()
    source = {name: "ab", **{k: "c" for k in range(100, 400)}, **{k: "d" for k in range(1000, 1040)}}
    by_target = collections.defaultdict(int)
    for r in report:
        by_target[r.source_size, r.target] += r.taken
        assert r.copies <= 2 and source[r.doc_id]
    assert len(report) == len(made) and len(by_target) == 4
    assert all(abs(taken - target) <= 50 for (_, target), taken in by_target.items())
    copies = collections.Counter()
    for r in report:
        copies[r.doc_id, r.size] += r.copies
    kept = mixing.mix(clashing(docs))
    assert collections.Counter((r.doc_id, len(words(r.text))) for r in kept.collect()) == +copies
    again = mixing.mix_report(docs.repartition(7)).collect()
    assert sorted(map(str, again)) == sorted(map(str, report))


# 6 exact dedup


def test_fuse_filter_has_no_false_negatives_and_few_false_positives():
    rng = np.random.default_rng(1)
    for n in (0, 1, 2, 50, 1000, 50_000):
        keys = rng.integers(0, 2**60, n).astype(np.uint64)
        blob = fusefilter.build(np.concatenate([keys, keys]))
        assert fusefilter.probe(blob, keys).all()
        others = rng.integers(2**60, 2**61, 20_000).astype(np.uint64)
        assert fusefilter.probe(blob, others).mean() < 0.02
        assert n < 1000 or len(blob) < 1.4 * n + 3000


def test_exact_dedup_equals_grouping(docs, rows, empty):
    groups = collections.defaultdict(list)
    for i, t, *_ in rows:
        groups[lowered(t)].append(-1 if i is None else i)
    got = E.exact_dedup(clashing(docs)).collect()
    assert len(got) == len(rows) and sum(r.kept for r in got) == len(groups)
    text = {i: lowered(t) for i, t, *_ in rows}
    for r in got:
        g = groups[text[r.doc_id]]
        assert (-1 if r.keep_id is None else r.keep_id) == max(g) and r.group_size == len(g)
        assert r.text_sha256 == hashlib.sha256(text[r.doc_id].encode()).hexdigest()
    assert E.exact_dedup(empty).count() == 0
    assert sorted(map(str, got)) == sorted(map(str, E.exact_dedup(docs, batches=1).collect()))


# 2 archive


def test_archive_round_trip(spark, tmp_path):
    pages = [(1, "http://a/", "same"), (2, "http://b/\r\nX: y", "same"), (3, None, None), (4, "u", ""), (5, "v", "é\r\n\r\nWARC/1.1\r\n"), (6, "v", "x" * 100_000), (6, "v", "x" * 100_000)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").withColumn("digest", F.lit("mine"))
    path = f"file://{tmp_path}/w"
    warc.write_archive(df, path)
    got = sorted(map(tuple, warc.read_index(spark, path).collect()), key=str)
    import base64

    digest = lambda h: base64.b32encode(hashlib.sha1((h or "").encode()).digest()).decode()
    assert [(r[0], r[1], r[2]) for r in got] == sorted([(i, len((h or "").encode()), digest(h)) for i, _, h in pages])
    kind = collections.defaultdict(list)
    for r in got:
        kind[r[0]].append((r[3], r[4]))
    assert kind[1] == [("revisit", 2)] and kind[2] == [("response", None)] and kind[3] == [("revisit", 4)] and sorted(kind[6], key=str) == [("response", None), ("revisit", 6)]
    assert spark.read.parquet(f"{path}/payloads").count() == 4
    warc.export_warc(spark, path, f"{tmp_path}/files")
    back = {(r.header, bytes(r.payload)) for r in warc.parse_warc(spark, f"{tmp_path}/files/part-*").collect()}
    recs = warc.records(spark, path).collect()
    assert {bytes(r.record) for r in recs} == {h.encode() + p + b"\r\n\r\n" for h, p in back} and len(recs) == 7
    warc.write_archive(df, path + "2", least_bytes=5)
    assert {r.record_type for r in warc.read_index(spark, path + "2").filter("page_id < 5").collect()} == {"response"}
    assert warc.archive_and_read(df.limit(0)).count() == 0


def test_hot_digests(spark):
    """Empty pages, and texts, that are most of the rows."""
    pages = [(k, "u", None if k % 2 else "") for k in range(400)] + [(1000 + k, "u", f"page {k % 30}") for k in range(90)]
    got = warc.archive_and_read(spark.createDataFrame(pages, "page_id long, url string, html string").repartition(5)).collect()
    assert len(got) == len(pages) and sum(r.record_type == "response" for r in got) == 31
    assert {r.refers_to for r in got if r.payload_bytes == 0} == {None, 399} and all(r.page_id == 399 for r in got if r.payload_bytes == 0 and r.refers_to is None)
    docs = spark.createDataFrame([(k, "Same" if k % 2 else "same", "en", "s", 1) for k in range(400)] + [(1000 + k, f"text {k % 30}", "en", "s", 1) for k in range(90)], DOCS).repartition(5)
    kept = {r.doc_id: r for r in E.exact_dedup(docs).collect()}
    assert sum(r.kept for r in kept.values()) == 31 and {(r.keep_id, r.group_size) for i, r in kept.items() if i < 400} == {(399, 400)}


def test_damaged_payload_fails(spark, tmp_path):
    path = f"file://{tmp_path}/w"
    warc.write_archive(spark.createDataFrame([(1, "u", "text")], "page_id long, url string, html string"), path)
    spark.read.parquet(f"{path}/payloads").select("digest", F.lit(b"other").alias("payload")).write.parquet(f"{path}/bad")
    spark.read.parquet(f"{path}/bad").write.mode("overwrite").parquet(f"{path}/payloads")
    with pytest.raises(Exception, match="damaged payload"):
        warc.read_index(spark, path).collect()


# 9 SimHash


def brute_fingerprint(t, n):
    w = words(lowered(t))
    runs = [" ".join(w[i : i + n]) for i in range(len(w) - n + 1)] or ([" ".join(w)] if w else [])
    hs = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in runs]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def brute_components(nodes, linked):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(nodes):
        for b in nodes[i + 1 :]:
            if linked(a, b):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {n: find(n) for n in nodes}


@pytest.mark.parametrize("most", [64, 2])
def test_links_lose_no_pair(spark, monkeypatch, most):
    monkeypatch.setattr(simhash, "PAIRS_UP_TO", most)
    rng = random.Random(7)
    fps = {0, -1 & (2**64 - 1)}
    for _ in range(40):
        x = rng.getrandbits(64)
        fps |= {x, *(x ^ 1 << rng.randrange(64) ^ 1 << rng.randrange(64) for _ in range(6)), x ^ 1 << 63, x ^ 7}
    signed = sorted(x - 2**64 if x >> 63 else x for x in fps)
    want = brute_components(signed, lambda a, b: ((a ^ b) & (2**64 - 1)).bit_count() <= 2)
    edges = simhash.link(spark.createDataFrame([(x,) for x in signed], "fp long"))
    assert all(((r.a ^ r.b) & (2**64 - 1)).bit_count() <= 2 for r in edges.collect())
    got = {r.node: r.root for r in components(edges).collect()}
    assert {n: got.get(n, n) for n in signed} == want


def test_simhash_groups_equal_brute_force(docs, rows, empty):
    got = simhash.near_report(clashing(docs), shingle=3).collect()
    assert len(got) == len(rows)
    fp = {i: brute_fingerprint(t, 3) for i, t, *_ in rows}
    assert all(int(r.fingerprint, 16) == fp[r.doc_id] for r in got)
    ids = sorted(i for i in fp if i is not None)
    want = brute_components(ids, lambda a, b: (fp[a] ^ fp[b]).bit_count() <= 2)
    assert {r.doc_id: r.component_id for r in got if r.doc_id is not None} == want
    kept = simhash.near_dedup(clashing(docs), shingle=3)
    assert kept.columns == clashing(docs).columns
    assert sorted(r.doc_id for r in kept.collect() if r.doc_id is not None) == sorted(set(want.values()))
    assert simhash.near_report(empty).count() == 0


def test_long_texts_read_in_pieces_are_read_whole(monkeypatch):
    text = prose(random.Random(1), 3000)
    whole, wide = simhash.fingerprint(text, 3), simhash_wide.shingle_sets([text.encode()], 5)
    monkeypatch.setattr(simhash, "CHUNK", 100)
    monkeypatch.setattr(simhash_wide, "CHUNK", 100)
    assert simhash.fingerprint(text, 3) == whole == brute_fingerprint(text, 3)
    assert all((a == b).all() for a, b in zip(simhash_wide.shingle_sets([text.encode()], 5), wide, strict=True))


def test_long_chains_of_edges_meet(spark):
    n = 300
    edges = spark.createDataFrame([(i, i + 1) for i in range(n)] + [(1000, 1000 + k) for k in range(1, 200)], "a long, b long")
    got = {r.node: r.root for r in components(edges).collect()}
    assert all(got[i] == 0 for i in range(n + 1)) and all(got[1000 + k] == 1000 for k in range(200))
    assert components(edges.limit(0)).count() == 0


def test_similar_texts_are_one_group(spark, docs, rows, empty):
    rng = random.Random(9)
    made = []
    for k in range(12):
        base = prose(rng, 300, 5000)
        for c in range(4):
            w = base.split()
            for _ in range(c):
                w[rng.randrange(len(w))] = f"new{k}{c}"
            made.append((1000 + 10 * k + c, " ".join(w), "en", "a", 1))
    kept = simhash_wide.keep_one(clashing(spark.createDataFrame(rows + made, DOCS)), shingle=5)
    ids = sorted(r.doc_id for r in kept.collect() if r.doc_id is not None)
    assert [i for i in ids if i >= 1000] == [1000 + 10 * k for k in range(12)]
    assert 100 in ids and not {101, 102, 108} & {*ids} and 103 in ids and not {104, 105} & {*ids} and ids.count(107) == 1 and {*range(40)} <= {*ids}
    assert kept.columns == clashing(docs).columns and simhash_wide.keep_one(empty).count() == 0


def brute_shingles(t, n=5):
    w = words(lowered(t))
    return {tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()


def test_shingle_sets_of_texts_together_and_alone():
    rng = random.Random(2)
    texts = [b"", b" \n", b"one", b"Two words", *[prose(rng, rng.randrange(1, 40), 5).encode() for _ in range(60)], b"x " * 30, b""]
    which, runs, node = simhash_wide.shingle_sets(texts, 5)
    assert np.bincount(which, minlength=len(texts)).tolist() == [len(brute_shingles(t.decode())) for t in texts]
    for i, t in enumerate(texts):
        _, alone, n = simhash_wide.shingle_sets([t], 5)
        assert (runs[which == i] == alone).all() and n[0] == node[i] and (len(alone) > 0) == (n[0] > 0)


def test_gaps_hold_the_cells():
    rng = np.random.default_rng(3)
    for most in (1, 3, 300, 65_536):
        cells = np.sort(rng.integers(0, most, 500))
        assert (simhash_wide.of_gaps(simhash_wide.in_gaps(cells)) == cells).all()
    assert len(simhash_wide.of_gaps(simhash_wide.in_gaps(np.zeros(0, np.int64)))) == 0


def test_rarities_count_all_texts(spark):
    texts = ["a b c d e"] * 40 + ["f g h i j k"] * 3 + [None, ""]
    table = simhash_wide.rarities(spark.createDataFrame([(i, t, "en", "s", 1) for i, t in enumerate(texts)], DOCS).repartition(3), "text", 5)
    cell = lambda t: simhash_wide.shingles([t], 5)[1] >> np.uint64(64 - simhash_wide.CELL_BITS)
    assert table[cell(b"a b c d e").astype(int)].tolist() == [math.floor(8 * math.log2(40))] and table[cell(b"f g h i j k").astype(int)].tolist() == [math.floor(8 * math.log2(3))] * 2
    assert (table > 0).sum() == 3


@pytest.mark.parametrize("bits", [simhash_wide.CELL_BITS, 8])
def test_similar_groups_equal_brute_force(spark, monkeypatch, bits):
    """Short texts, and long ones of few distinct words, with words added, replaced and repeated; common passages."""
    monkeypatch.setattr(simhash_wide, "CELL_BITS", bits)
    monkeypatch.setattr(simhash_wide, "FLUSH", 5000)
    rng = random.Random(21)
    passage, made = prose(rng, 12), ["", "one", "one two"]
    for n in range(6, 31):
        base = prose(rng, n).split()
        last, middle = [*base[:-1], "other"], [*base[: n // 2], "other", *base[n // 2 + 1 :]]
        made += [" ".join(x) for x in (base, [*base, "more"], last, middle, [*base, "more", "still"], base[2:])] + [passage + " " + prose(rng, n)]
    for k in range(6):
        base = prose(rng, 1500, 100, 1000 * k).split()
        made.append(" ".join(base))
        for at in (5, 20, 30, 34, 40, 60):
            w = base.copy()
            for i in rng.sample(range(len(w)), at):
                w[i] = f"w{1000 * k + rng.randrange(100)}"
            made.append(" ".join(w))
    sets = [brute_shingles(t) for t in made]
    alike = lambda a, b: a == b or 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])
    got = simhash_wide.similar_groups(spark.createDataFrame([(i, t, "en", "s", 1) for i, t in enumerate(made)], DOCS)).collect()
    least = {}
    for r in got:
        least[r.root] = min(least.get(r.root, r.doc_id), r.doc_id)
    assert {r.doc_id: least[r.root] for r in got} == brute_components(range(len(made)), alike)


def test_a_large_group_of_near_copies_costs_its_size(spark, monkeypatch):
    """1,500 copies of one text with 0 to 12 words changed: as many links as by brute force, but no pairs of all with all."""
    met = []
    whole = simhash_wide.verified
    monkeypatch.setattr(simhash_wide, "verified", lambda pairs, *a, **k: met.append(pairs.count()) or whole(pairs, *a, **k))
    rng = random.Random(31)
    base, made = prose(rng, 150, 3000).split(), []
    for _ in range(1500):
        w = base.copy()
        for _ in range(rng.randrange(13)):
            w[rng.randrange(len(w))] = f"x{rng.randrange(10**6)}"
        made.append(" ".join(w))
    got = simhash_wide.similar_groups(spark.createDataFrame([(i, t, "en", "s", 1) for i, t in enumerate(made)], DOCS)).collect()
    sets, names = [brute_shingles(t) for t in made], {}
    numbered = [np.array(sorted(names.setdefault(x, len(names)) for x in s)) for s in sets]
    there = np.zeros((len(made), len(names)), np.float32)
    for i, x in enumerate(numbered):
        there[i, x] = 1
    common, size = there @ there.T, there.sum(axis=1)
    alike = common / (size[:, None] + size - common) >= 0.8
    least = {}
    for r in got:
        least[r.root] = min(least.get(r.root, r.doc_id), r.doc_id)
    assert {r.doc_id: least[r.root] for r in got} == brute_components(range(len(made)), lambda a, b: alike[a, b])
    assert alike.sum() / 2 > 50_000 and sum(met) < 10 * len(made)


def test_texts_of_few_words_make_few_pairs(spark, monkeypatch):
    """Random texts of six words share keys without being similar: pairs to verify grow with the texts, and no link is lost."""
    counts, real = {}, simhash_wide.stored
    monkeypatch.setattr(simhash_wide, "stored", lambda df, name: counted(counts, name, real(df, name)))
    rng = random.Random(41)
    for n in (250, 1000):
        counts.clear()
        made = [prose(rng, 80, 6) for _ in range(n)]
        for k in range(0, n, 25):  # a copy with a word changed, and one of that
            w = made[k].split()
            for at in (20, 60):
                w[at] = "other"
                made.append(" ".join(w))
        got = simhash_wide.similar_groups(spark.createDataFrame([(i, t, "en", "s", 1) for i, t in enumerate(made)], DOCS)).collect()
        assert counts["near-apart"] + counts["near-meet"] < 12 * len(made) and counts["near-apart"] < len(made)
        if n == 250:
            sets = [brute_shingles(t) for t in made]
            least = {}
            for r in got:
                least[r.root] = min(least.get(r.root, r.doc_id), r.doc_id)
            assert {r.doc_id: least[r.root] for r in got} == brute_components(range(len(made)), lambda a, b: 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]))


def counted(counts, name, df):
    counts[name] = counts.get(name, 0) + df.count()
    return df


def test_parities_never_exceed_what_differs():
    rng = random.Random(43)
    texts = [prose(rng, n, 30).encode() for n in (0, 1, 4, 5, 40, 41, 300)] + [b"w1 w2 w3 w4 w5 w6", b"w1 w2 w3 w4 w5 w7"]
    which, run, _ = simhash_wide.shingle_sets(texts, 5)
    bits = np.stack(simhash_wide.parities(which, run, len(texts))).T
    sets = [{*run[which == i].tolist()} for i in range(len(texts))]
    for i in range(len(texts)):
        for j in range(len(texts)):
            off = sum(((x ^ y) & 0xFFFFFFFFFFFFFFFF).bit_count() for x, y in zip(bits[i].tolist(), bits[j].tolist(), strict=True))
            assert off <= len(sets[i] ^ sets[j]) and (off - len(sets[i] ^ sets[j])) % 2 == 0


# 10 decontamination


def brute_hits(t, items, n=10):
    tok = lambda s: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered(s))
    w, hit, named = tok(t), set(), set()
    for i, text in items:
        v = tok(text)
        for k in range(max(1, len(v) - n + 1) if v else 0):
            win = v[k : k + n]
            for s in range(len(w) - len(win) + 1):
                if w[s : s + len(win)] == win:
                    hit |= {*range(s, s + len(win))}
                    named.add(str(i))
    return len(w), len(hit), len(named), hashlib.sha256(",".join(sorted(named)).encode()).hexdigest(), bool(hit)


def test_contamination_equals_searching(spark, empty):
    rng = random.Random(11)
    items = [(i, prose(rng, 25, 30)) for i in range(6)] + [(6, "Short item"), (7, None), (8, "-- !"), (9, "a a a a a a a a a a a"), (10, prose(rng, 25, 30))]
    text = {i: t for i, t in items}
    made = [(0, None), (1, ""), (2, "x " + text[0].upper() + ", y"), (3, "the SHORT-item here, short item"), (4, "a " * 40), (5, "é" + " ".join(text[1].split()[3:16])), (6, " ".join(text[2].split()[:9])), (6, " ".join(text[2].split()[:9]))]
    made += [(10 + k, prose(rng, 200, 30) + " " + " ".join(text[k % 6].split()[k % 9 : k % 9 + 12])) for k in range(10)] + [(None, text[3]), (50, prose(rng, 5000, 30) + " " + text[4])]
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in made], DOCS)
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = D.contamination(clashing(docs), bench).collect()
    want = sorted((str(i), *brute_hits(t, items)) for i, t in made)
    assert sorted((str(r.doc_id), r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in got) == want
    kept = D.decontaminate(clashing(docs), bench)
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(str(i) for i, t in made if not brute_hits(t, items)[4]) and kept.columns == clashing(docs).columns
    assert D.contamination(empty, bench).count() == 0
    none = D.contamination(docs, bench.limit(0)).collect()
    assert len(none) == len(made) and not any(r.contaminated for r in none)
    near = spark.createDataFrame([(1, " ".join(text[0].split()[:12][::-1]), "en", "s", 1)], DOCS)
    assert D.contamination(near, bench).first().n_near >= 1


def test_near_passages_are_counted(spark, tmp_path):
    """A window whose rarest word is altered, or that has a word no document has; else every n words of a text with every window."""
    from lagweave.llm.queries import op10_decontaminate

    rng = random.Random(17)
    items = [(1, "common0 common1 common2 common3 rare common4 common5 common6 common7 common8"), (2, " ".join(f"p{k}" for k in range(9)) + " nowhere")]
    items += [(10 + k, prose(rng, 14, 25)) for k in range(6)]
    shuffled = [f"p{k}" for k in range(9)]
    rng.shuffle(shuffled)
    made = [(1, items[0][1].replace("rare", "altered")), (2, "rare alone"), (3, " ".join(shuffled)), (4, "p0 p1 p2 p3 p4 p5 p6"), (5, None)]
    for k in range(60):
        w = items[2 + k % 6][1].split()[k % 4 : k % 4 + 11]
        for _ in range(k % 5):
            w[rng.randrange(len(w))] = f"w{rng.randrange(30)}"
        made.append((10 + k, " ".join(rng.sample(w, len(w)) + prose(rng, 6, 30).split())))
    made += [(100 + k, " ".join(f"common{j}" for j in range(9) if j != k)) for k in range(9)]
    spark.createDataFrame([(i, t, "en", "s", 1) for i, t in made], DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = {r.doc_id: r for r in op10_decontaminate(spark, str(tmp_path)).collect()}
    assert {i: (got[i].n_near, got[i].contaminated) for i in range(1, 6)} == {1: (1, False), 2: (0, False), 3: (1, False), 4: (0, False), 5: (0, False)}
    assert all(got[100 + k].n_near == 1 for k in range(9))

    total, spread = 0, 0
    for i, t in made[5:65]:
        must, around = (sum(within(t.split(), v.split(), reach) for _, v in items) for reach in (10, 19))
        assert got[i].n_near == must
        total, spread = total + must, spread + around - must
    assert total > 20 and spread > 0


def within(w, v, reach):
    """Whether some `reach` consecutive words of w hold four fifths of the distinct words of a window of v."""
    wins = [{*v[k : k + 10]} for k in range(max(1, len(v) - 9))]
    return any(len({*w[i : i + reach]} & s) >= math.ceil(0.8 * len(s)) for s in wins for i in range(len(w)))


def test_paths_without_a_broadcast_find_the_same(spark, monkeypatch):
    """No table is broadcast, no shuffle carries a document's words, and documents longer than a stretch are cut right."""
    rng = random.Random(23)
    items = [(i, prose(rng, 14, 40)) for i in range(5)] + [(5, "w3"), (6, "w1 w1 w1"), (7, None)]
    made = [(k, prose(rng, 150, 40) + " " + " ".join(items[k % 5][1].split()[k % 4 : k % 4 + 10]) + " " + prose(rng, 40, 40)) for k in range(12)]
    made += [(20, None), (None, items[2][1]), (3, made[3][1]), (3, "w3 only"), (21, "")]
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in made], DOCS)
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = sorted(map(str, D.contamination(docs, bench).collect()))
    kept = sorted(map(str, D.decontaminate(docs, bench).collect()))
    for name in ("BROADCAST_CHARS", "BROADCAST_KEYS"):
        monkeypatch.setattr(D, name, 0)
    monkeypatch.setattr(D, "STRETCH", 16)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert sorted(map(str, D.contamination(docs, bench).collect())) == want
        assert sorted(map(str, D.decontaminate(docs, bench).collect())) == kept
        rows = D.tokenised(docs, "doc_id", "text")
        asked = spark.createDataFrame([("w3", True), ("w1", False)], "term string, wide boolean")
        plans, real = [], D.stored
        monkeypatch.setattr(D, "stored", lambda df, name: plans.append(df) or real(df, name))
        plans.append(D.found_places(rows, asked, 10))
        for df in plans:
            tree = df._jdf.queryExecution().executedPlan().toString().splitlines()
            for above, below in zip(tree, tree[1:], strict=False):
                if "Exchange" in above:
                    assert not re.search(r"\bw#", below), below
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


# 4 secrets


def brute_secrets(t):
    t, base, more = t or "", [], []
    assign = re.compile(S.ASSIGN.replace("(?i)", ""), re.I | re.A)
    base += [(m.start(), 0, m.end(), "assign") for m in assign.finditer(t) if len(m[2]) >= 8]
    base += [(m.start(), 1, m.end(), "access") for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 16]
    base += [(m.start(), 2, m.end(), "hex") for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 32]
    for k, c in enumerate(S.CLASSES):
        for m in re.finditer(c.pattern, t):
            if re.fullmatch(c.allow, m[0]):
                continue
            w, spans = m[0].lower() if c.lower else m[0], []
            for i in range(len(w) - c.width + 1):
                n = collections.Counter(w[i : i + c.width])
                if sum(round(v * math.log2(v) * 1e6) for v in n.values()) <= math.floor(c.width * (math.log2(c.width) - c.bits) * 1e6) and not re.search(c.phrase, m[0][i : i + c.width]):
                    if spans and spans[-1][1] >= i:
                        spans[-1][1] = i + c.width
                    else:
                        spans.append([i, i + c.width])
            more += [(m.start() + a, 3 + k, m.start() + b, c.kind) for a, b in spans]
    line = lambda v: ",".join(f"{k}:{a}:{b}" for a, _, b, k in sorted(v))
    return (*[sum(x[1] == k for x in base) for k in range(3)], hashlib.sha256(line(base).encode()).hexdigest(), line(base + more))


def test_secrets_equal_scanning(spark, empty):
    rng = random.Random(3)
    alphabet, parts = "abcdef0123456789ABCXYZ+/=_- \n\"':é𝕏.", ["password", "Secret", "TOKEN", "apikey", "api_key", "AKIA", "=", ":", " = ", "'", "ſecret"]
    made = [(i, "".join(rng.choice(parts) if rng.random() < 0.15 else rng.choice(alphabet) * rng.choice([1, 1, 3]) for _ in range(rng.randint(0, 200)))) for i in range(150)]
    made += [(900, None), (901, ""), (902, "".join(rng.choice("0123456789abcdef") for _ in range(3000))), (903, "password=abcdefgh " * 700), (904, "secret=token:abcdefghij"), (905, "0123456789" * 5), (906, "some_long_identifier_of_words"), (905, "0123456789" * 5)]
    made += [(907, "example/services/" + "".join(rng.choice("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789") for _ in range(60))), (908, "deadbeef" + "".join(rng.choice("0123456789abcdef") for _ in range(60)) + "12345678")]
    made += [(909, "token=abcdefgh1 " * 70_000)]
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in made], DOCS)
    got = S.secrets(clashing(docs)).collect()
    want = sorted((i, *brute_secrets(t)) for i, t in made)
    assert sorted((r.doc_id, r.n_assign, r.n_access, r.n_hex, r.base_sha256, r.spans) for r in got) == want
    assert sum(r.n_entropy for r in got) > 0 and next(r for r in got if r.doc_id == 906).n_entropy == 0
    assert all(r.n_entropy > 0 for r in got if r.doc_id in (907, 908))
    assert S.secrets(empty).count() == 0


# 5 language model


def brute_scores(rows, held):
    """(tokens, known tokens, base score, score) by row, with exact pair counts rounded as their levels are."""
    tok = lambda t: [*words(lowered(t)), None]
    train = [tok(t) for i, t, *_ in rows if not held(i)]
    c = collections.Counter(w for ts in train for w in ts)
    two = collections.Counter(p for ts in train for p in zip([None, *ts[:-1]], ts, strict=True))
    n, v = sum(c.values()), len(c)
    scale, out = n + 0.5 * (v + 1), []

    def one(a, b):
        q = math.floor(math.log2(two[a, b])) + 1 if two[a, b] else 0
        many = 0.75 * 2**q - 0.5 * (q == 1) if q else 0
        share = min(1, ((c[b] or 0.5) + 0.5) / scale)
        return math.log10((many + 20 * share) / (max(c[a] or 0.5, many) + 20))

    for i, t, *_ in rows:
        ts = tok(t)
        base = sum(math.log10((c[w] + 0.5) / scale) for w in ts)
        out.append((i, held(i), len(ts), sum(c[w] > 0 for w in ts), n, base, sum(one(a, b) for a, b in zip([None, *ts[:-1]], ts, strict=True))))
    return out


def ordered(found):
    return sorted((tuple(r) for r in found), key=lambda r: (str(r[0]), r[2], round(r[5], 6)))


@pytest.mark.parametrize("options", [{}, {"unit_bytes": 300}, {"per_shard": 100}, {"unit_bytes": 1, "per_shard": 1000}])
def test_scores_equal_exact_counts(docs, rows, options):
    """Any size of units and shards; a filter of so many bits has no false members here."""
    held = lambda i: zlib.crc32(b"" if i is None else str(i).encode()) % 5 == 1
    got, want = ordered(lm_score.score(clashing(docs), bits_per_key=256, **options).collect()), ordered(brute_scores(rows, held))
    assert len(got) == len(want)
    for g, w in zip(got, want, strict=True):
        assert g[:5] == w[:5] and math.isclose(g[5], w[5], rel_tol=1e-9) and math.isclose(g[6], w[6], rel_tol=1e-9)


def test_scores_with_false_members_stay_near(docs, rows, empty):
    held = lambda i: zlib.crc32(b"" if i is None else str(i).encode()) % 5 == 1
    for g, w in zip(ordered(lm_score.score(docs).collect()), ordered(brute_scores(rows, held)), strict=True):
        assert g[:5] == w[:5] and math.isclose(g[5], w[5], rel_tol=1e-9) and math.isclose(g[6], w[6], rel_tol=0.1, abs_tol=3)
    assert lm_score.score(empty).count() == 0
    assert lm_score.score(docs, held_out=F.lit(True)).filter("n_known > 0 or score > 0").count() == 0


def test_units_that_a_file_splits_are_scored_whole(spark, docs, rows):
    stored, asked = lm_score.in_units(docs.coalesce(1), "doc_id", "text", F.lit(False), 10**9).collect(), []
    df = spark.createDataFrame(stored, "unit long, place long, doc_id long, held_out boolean, text string")
    cut = df.repartitionByRange(2, "place").sortWithinPartitions("place")
    model = lm_score.model_of(df, "text", 8, 256)
    tokens, distinct = model.agg(F.sum("tokens"), F.sum("distinct")).first()
    for some in (df.coalesce(1), cut):
        q = lm_score.questions(some, 8)
        asked.append(q.select("first").distinct().count())
        found = lm_score.scored(some, lm_score.answers(q, model), tokens, distinct)
        got = ordered(found.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(tokens), "base_score", "score").collect())
        for g, w in zip(got, ordered(brute_scores(rows, lambda i: False)), strict=True):
            assert g[:5] == w[:5] and math.isclose(g[6], w[6], rel_tol=1e-9)
    assert asked == [1, 2]


def test_bloom_levels_never_undercount():
    rng = np.random.default_rng(2)
    h, c = np.unique(rng.integers(0, 2**63, 5000).astype(np.uint64)), rng.integers(1, 5000, 5000)
    blob = lm_score.build_shard(h, c[: len(h)])
    q = lm_score.probe_shard(blob, h)
    assert (q >= lm_score.levels(c[: len(h)])).all() and (q == lm_score.levels(c[: len(h)])).mean() > 0.9
    assert (lm_score.probe_shard(blob, rng.integers(0, 2**63, 5000).astype(np.uint64)) > 0).mean() < 0.06


# 1 language


def test_language_on_held_out_rows(spark, empty, rows):
    rng = random.Random(5)
    letters = {"aa": "abcdet", "bb": "bcdfgh", "cc": "eioulm", "dd": "äöüsnr", "ee": "zxywvk", "ff": "pqrsta"}
    made = [(k, " ".join("".join(rng.choices(letters[g], k=rng.randint(2, 7))) for _ in range(rng.randint(5, 60))), g, "s", 1) for k, g in enumerate(rng.choices([*letters], k=600))]
    made += [(9000, None, "aa", "s", 0), (9001, "12 34 !", "aa", "s", 0), (9002, "", None, "s", 0), (9003, "zxywvk " * 20000, None, "s", 0), (9003, "zxywvk " * 20000, None, "s", 0)]
    got = language.identify(clashing(spark.createDataFrame(made, DOCS))).collect()
    truth = {i: g for i, _, g, _, _ in made}
    out = [r.lang_pred == truth[r.doc_id] for r in got if r.held_out and r.doc_id < 9000]
    assert len(got) == len(made) and len(out) > 80 and np.mean(out) > 0.95 and all(0 <= r.score <= 1 for r in got)
    assert {r.doc_id: r.lang_pred for r in got if r.doc_id > 8999} == {9000: "und", 9001: "und", 9002: "und", 9003: "ee"}
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got)
    assert language.identify(empty).count() == 0
    one = language.identify(spark.createDataFrame(rows, DOCS)).filter("lang_pred not in ('en', 'und')")
    assert one.count() == 0
    kept = language.keep_identified(clashing(spark.createDataFrame(made, DOCS)))
    assert {r.doc_id for r in kept.filter("doc_id > 8999").collect()} == {9003} and kept.count() > 580


def test_chunks_count_the_same_ngrams(monkeypatch):
    text = "Ab, cdé  fg! " * 50
    whole = language.counts(text)
    monkeypatch.setattr(language, "CHUNK", 7)
    assert np.abs(language.counts(text) - whole).sum() <= 0.2 * whole.sum()


def test_codewords_are_apart():
    for k in (2, 4, 5, 9, 40):
        code = language.codewords(k).astype(int)
        apart = (code.shape[1] - code @ code.T) // 2 + 10**6 * np.eye(k, dtype=int)
        assert code.shape[0] == k and apart.min() >= max(1, code.shape[1] // 5)


# 7 token counts


def test_trie_counts_equal_single_words_and_the_library():
    from tokenizers import Tokenizer, models

    pieces = {"▁": -3.0, "a": -2.0, "b": -2.5, "ab": -3.0, "▁a": -2.2, "abc": -6.0, "c": -4.0, "▁abab": -4.1, "é": -5.0}
    m = token_counts.Unigram(pieces)
    lib = Tokenizer(models.Unigram([("<unk>", -50.0), *pieces.items()], unk_id=0))
    rng = random.Random(2)
    some = {"".join(rng.choices("abcé", k=rng.randint(1, 70))).encode() for _ in range(800)} | {"x日𝕏a".encode()}
    m.learn(some)
    for w in some:
        s = "▁" + w.decode()
        assert m.cache[w] == m.one(s)
        if not set("x日𝕏") & set(s):
            ids = lib.encode(s).ids
            assert math.isclose(sum([0.0, *pieces.values()][i] for i in ids), best(pieces, s))  # several segmentations have it here
    assert m.count([None, "", " a\tb ", "a" * 5000]) [:3] == [(0, 0), (0, 0), (2, m.one("▁a") + m.one("▁b"))]


def test_token_counts_equal_the_library_with_the_real_vocabulary(spark):
    """Words of all lengths; scores of real pieces differ, so that the best segmentation is one."""
    from tokenizers import Tokenizer, models

    m = token_counts.model()
    lib = Tokenizer(models.Unigram([("<unk>", -50.0), *m.pieces.items()], unk_id=0))
    rng, sf = random.Random(6), "/root/testdata/sf0.001/documents.parquet"
    texts = [r.text or "" for r in spark.read.parquet(sf).select("text").collect()] if os.path.isdir(os.path.dirname(sf)) else []
    some = {w for t in texts for w in words(t)}
    some |= {"".join(rng.choices("etaoinshrdlucmfwypvbgk", k=rng.randint(1, 200))) for _ in range(400)} | {"the" * 50, "international" * 9}
    some = {w for w in some if all(c in m.pieces for c in w)}
    m.learn({w.encode() for w in some})
    assert len(some) > 350 and all(m.cache[w.encode()] == len(lib.encode("▁" + w).ids) for w in some)


def test_cached_words_of_two_generations_count_the_same(monkeypatch):
    monkeypatch.setattr(token_counts, "CACHED_WORDS", 5)
    m = token_counts.Unigram(token_counts.model().pieces)
    texts = ["one two three four five six seven", "one eight nine ten", "one two eleven", "", "seven one"] * 3
    for t in texts:
        assert m.count([t]) == [(len(t.split()), sum(m.one("▁" + w) for w in t.split()))]


def best(pieces, s):
    top = [0.0] + [-math.inf] * len(s)
    for p in range(1, len(s) + 1):
        top[p] = max(top[k] + pieces[s[k:p]] for k in range(p) if s[k:p] in pieces)
    return top[-1]


def test_token_counts_query(docs, rows, empty):
    got = {r.doc_id: r for r in token_counts.token_counts(clashing(docs)).collect()}
    m = token_counts.model()
    for i, t, *_ in rows:
        assert (got[i].n_words, got[i].n_tokens) == (len(words(t)), sum(m.one("▁" + w) for w in words(t)))
    assert token_counts.token_counts(empty).count() == 0


# 8 token files


def test_files_hold_the_library_ids(spark, docs, rows, empty, tmp_path):
    import public_tokenizers
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(public_tokenizers.path(token_files.VOCABULARY))
    path = f"file://{tmp_path}/t"
    index = token_files.write_files(clashing(docs), path)
    got = token_files.with_starts(token_files.read_files(index.orderBy(F.rand(3)), path, with_ids=True), index).orderBy("start").collect()
    order = sorted(rows, key=lambda r: -1 if r[0] is None else r[0])
    start = 0
    for r, (i, t, *_) in zip(got, order, strict=True):
        ids = [*lib.encode(t or "", add_special_tokens=False).ids, 2]
        assert (r.doc_id, r.start, r.n_tokens, r.ids) == (i, start, len(ids), ids)
        assert r.ids_crc32 == zlib.crc32(np.array(ids, "<u4").tobytes())
        start += len(ids)
    assert token_files.write_and_read(empty).count() == 0


def test_words_of_the_cache_are_the_library_ids(monkeypatch):
    monkeypatch.setattr(token_files, "CACHED_WORDS", 20)
    enc = token_files.encoder(None)
    for t in ["a.", "x. y", "don't. it's", "<|endoftext|> a <|ENDOFTEXT|>", "", "  ", "\t a\n\r b.", "É. é, ß.", "a.. b,,", "AB.C,", "é .", *[f"word{i}. Word{i}, {i}" for i in range(60)]]:
        assert np.frombuffer(enc.encode(t), enc.kind).tolist() == enc.lib.encode(t, add_special_tokens=False).ids


def test_new_words_go_to_the_library_together():
    enc = token_files.Encoder()
    lib, handed = enc.lib, []

    class Counting:
        def encode_batch_fast(self, texts, **options):
            handed.extend(texts)
            return lib.encode_batch_fast(texts, **options)

    enc.lib = Counting()
    texts = [" ".join(f"new{k}word{i}" for i in range(100)) for k in range(20)]
    texts += ["# a#b ## #. x# $#, #", "\u0301 e\u0301 \u0301# \u0085 \u200b", "", " ", "a\x00b \x01 # .", "<|endoftext|> # a", "\uff03 don't# DON'T"]
    got = [*token_files.encoded(enc, pa.array([*texts, None]))]
    for t, ids in zip([*texts, ""], got, strict=True):
        assert np.frombuffer(ids, enc.kind).tolist() == lib.encode(t, add_special_tokens=False).ids, t
    assert len(handed) < 200  # of some 2,000 words


def test_plain_words_are_encoded_without_the_rules():
    enc = token_files.Encoder()
    lib, handed = enc.lib, []

    class Counting:
        def encode_batch_fast(self, texts, **options):
            handed.extend(texts)
            return lib.encode_batch_fast(texts, **options)

    enc.lib = Counting()
    name = lambda k: "".join("aéklßmnoÿt"[int(d)] for d in str(k))
    texts = [" ".join(name(k) + ["", ".", ",", "!!", "'", "#", "%%%"][k % 7] for k in range(s, s + 100)) for s in range(0, 3000, 100)]
    texts += ["a' 's x'll don't' ab``_ #", "÷ a÷ œuvre, e\u0301, ñ\u0301. ſ ß\u0338 <\u0338 a<\u0338", "É. aÉ, éa1 a.b é\u00a0é. ij ﬁn"]
    got = [*token_files.encoded(enc, pa.array(texts))]
    for t, ids in zip(texts, got, strict=True):
        assert np.frombuffer(ids, enc.kind).tolist() == lib.encode(t, add_special_tokens=False).ids, t
    assert len(handed) < 20  # of some 3,000 words


def test_other_vocabularies_go_to_the_library():
    import public_tokenizers

    enc = token_files.Encoder(public_tokenizers.path("byte_bpe_50k.json"))
    for t in ["One two.  Three\n\tfour", " lead", "", "É, ß"]:
        assert np.frombuffer(enc.encode(t), enc.kind).tolist() == enc.lib.encode(t, add_special_tokens=False).ids


def test_one_id_may_fill_several_files(spark):
    made = [(7, f"word{k} " * (k % 9), "en", "s", 1) for k in range(300)] + [(7, "same", "en", "s", 1)] * 50 + [(8, "last", "en", "s", 1)]
    got = sorted(token_files.write_and_read(spark.createDataFrame(made, DOCS).repartition(5)).collect(), key=lambda r: r.start)
    enc = token_files.encoder(None)
    assert [r.doc_id for r in got] == [7] * 350 + [8] and [r.start for r in got] == np.cumsum([0, *[r.n_tokens for r in got[:-1]]]).tolist()
    assert sorted(r.n_tokens for r in got) == sorted(len(enc.encode(t)) // 2 + 1 for _, t, *_ in made)


def test_damaged_frames_fail():
    data = token_files.frame(b"payload")
    assert token_files.unframe(data) == b"payload"
    for k in range(len(data)):
        with pytest.raises(ValueError):
            token_files.unframe(data[:k] + bytes([data[k] ^ 1]) + data[k + 1 :])


# pipeline


def test_pipeline_stages(spark, rows, tmp_path):
    import corpus_pipeline

    rng = random.Random(8)
    leak = prose(rng, 30, 9000)
    made = rows + [(500, "fine text " + leak, "en", "b", 1), (501, "1 2 3", "en", "b", 1)]
    spark.createDataFrame(made, DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, leak)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs, names = spark.read.parquet(f"{tmp_path}/documents.parquet"), [n for n, _ in corpus_pipeline.STAGES]
    kept = {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, str(tmp_path))
        assert k == len(names) - 1 or out.columns == docs.columns
        out.write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        kept[name] = [r.doc_id for r in docs.select("doc_id").collect()]
    assert names == ["language_id", "near_dedup", "decontaminate", "mix", "token_files"]
    assert not {103, 104, 105, 501} & {*kept["language_id"]} and {*range(40), 100, 500} <= {*kept["language_id"]}
    assert 100 in kept["near_dedup"] and not {101, 102, 108} & {*kept["near_dedup"]} and kept["near_dedup"].count(107) == 1
    assert 500 not in kept["decontaminate"] and len(kept["decontaminate"]) == len(kept["near_dedup"]) - 1
    assert sorted(map(str, kept["mix"])) == sorted(map(str, kept["token_files"]))
    assert json.dumps(sorted(str(r.doc_id) for r in corpus_pipeline.run(spark, str(tmp_path)).collect())) == json.dumps(sorted(map(str, kept["token_files"])))


def brute_mix(rows):
    """copies by id, of rows (id, text, source) with distinct ids: targets by water-filling, draws by hash."""
    size, text = collections.Counter(), {i: t or "" for i, t, _ in rows}
    for i, t, s in rows:
        size[s] += len(words(t))
    order = sorted(s for s in size if s is not None) + [None] * (None in size)
    weight, open_, total = {s: (3, 1, 2)[k % 3] for k, s in enumerate(order)}, {*order}, 1.5 * sum(size.values())
    while True:
        level = (total - sum(2 * size[s] for s in order if s not in open_)) / max(1e-9, sum(weight[s] for s in open_))
        over = {s for s in open_ if weight[s] * level > 2 * size[s]}
        if not over:
            break
        open_ -= over
    md5 = lambda x: hashlib.md5(x.encode()).hexdigest()
    copies = {}
    for s in order:
        target = weight[s] * level if s in open_ else 2 * size[s]
        whole = math.floor(target / size[s]) if size[s] else 0
        left, before = target - whole * size[s], 0
        for i in sorted((i for i, _, x in rows if x == s), key=lambda i: (int(md5(f"mix-1:{i}:{md5(text[i])}")[:15], 16), i)):
            n = len(words(text[i]))
            copies[i] = whole + (left > 0 and before + n / 2 < left)
            before += n
    return copies


def test_pipeline_equals_brute_force(spark, tmp_path):
    """What each stage keeps of its input, and the rows of run(): copies, near copies, leaks, sources, token ids."""
    import corpus_pipeline
    import public_tokenizers
    from tokenizers import Tokenizer

    rng = random.Random(41)
    leak = prose(rng, 30, 9000)
    made = [(i, prose(rng, rng.randrange(8, 90), 300), "en", "hot" if i % 3 else f"s{i % 4}", 1) for i in range(150)]
    for k in range(20):
        w = made[k][1].split()
        w[rng.randrange(len(w))] = "changed"
        made += [(200 + 3 * k, made[k][1].upper(), "en", "b", 1), (201 + 3 * k, " ".join(w), "en", "c", 1), (202 + 3 * k, made[k + 20][1] + " one more", "en", None, 1)]
    made += [(300 + k, prose(rng, 20) + " " + " ".join(leak.split()[k : k + 8 + k % 4]), "en", "b", 1) for k in range(12)] + [(400, "1 2 3", "en", "b", 1), (401, None, None, None, 0)]
    spark.createDataFrame(made, DOCS).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, leak)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    stages, docs, text, source = dict(corpus_pipeline.STAGES), spark.read.parquet(f"{tmp_path}/documents.parquet"), {r[0]: r[1] for r in made}, {r[0]: r[3] for r in made}

    def after(name, docs):
        stages[name](spark, docs, str(tmp_path)).write.parquet(f"{tmp_path}/{name}")
        return spark.read.parquet(f"{tmp_path}/{name}")

    docs = after("language_id", docs)
    ids = sorted(r.doc_id for r in docs.collect())
    assert {*text} - {*ids} == {400, 401}
    docs = after("near_dedup", docs)
    sets = {i: brute_shingles(text[i]) for i in ids}
    roots = brute_components(ids, lambda a, b: 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]))
    ids = sorted({*roots.values()})
    assert sorted(r.doc_id for r in docs.collect()) == ids and len(ids) < 200
    docs = after("decontaminate", docs)
    clean = [i for i in ids if not brute_hits(text[i], [(1, leak)])[4]]
    assert sorted(r.doc_id for r in docs.collect()) == clean and len(clean) < len(ids)
    docs = after("mix", docs)
    copies = brute_mix([(i, text[i], source[i]) for i in clean])
    assert collections.Counter(r.doc_id for r in docs.collect()) == +collections.Counter(copies)
    lib, start, want = Tokenizer.from_file(public_tokenizers.path(token_files.VOCABULARY)), 0, []
    for i in clean:
        for _ in range(copies[i]):
            found = [*lib.encode(text[i], add_special_tokens=False).ids, 2]
            want.append((i, start, len(found), zlib.crc32(np.array(found, "<u4").tobytes())))
            start += len(found)
    assert sorted(map(tuple, after("token_files", docs).collect())) == sorted(want)
    assert sorted(map(tuple, corpus_pipeline.run(spark, str(tmp_path)).collect())) == sorted(want)


def test_near_dedup_holds_linked_fingerprints_against_each_other(spark, monkeypatch):
    """The fingerprints are SimHashes of the shingles; near copies are found by them, and what they miss by prefixes."""
    rng = random.Random(11)
    base = [f"w{rng.randrange(10**6)}" for _ in range(400)]
    texts = [" ".join(base), " ".join([*base, "more"]), " ".join(f"v{rng.randrange(10**6)}" for _ in range(300)), "a b", None]
    which, runs, _ = simhash_wide.shingle_sets([(t or "").encode() for t in texts], 5)
    monkeypatch.setattr(simhash_wide, "UNPACKED", 7)
    got = simhash_wide.fingerprints(which, runs, len(texts))
    for k in range(len(texts)):
        mine = [int(r) for r in runs[which == k]]
        want = sum(1 << b for b in range(64) if 2 * sum(r >> b & 1 for r in mine) > len(mine))
        assert int(got[k]) % 2**64 == want
    nodes = spark.createDataFrame([(1, 0b1), (2, 0b111), (3, 0b1), (4, 0b1111 << 30)], "node long, fp long")
    assert sorted(map(tuple, simhash_wide.fingerprint_pairs(nodes).collect())) == [(1, 2), (1, 3)]
    held, real = [], simhash_wide.fingerprint_pairs
    monkeypatch.setattr(simhash_wide, "fingerprint_pairs", lambda nodes: held.append(nodes.count()) or real(nodes))
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string")
    assert sorted(r.doc_id for r in simhash_wide.keep_one(docs).collect()) == [0, 2, 3, 4] and held == [4]
