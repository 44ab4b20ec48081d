"""Operators 11 to 13 against brute force: vector codes, periodic runs, packing."""

import hashlib
import math
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from tokenizers import Tokenizer

from lagweave.llm import packing as P
from lagweave.llm import runs as R
from lagweave.llm import vector_codes as V

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def lloyd(rows, parts=8, entries=16, rounds=6):
    """Plain Lloyd rounds over (vec_id, vector, label) in Python integers."""
    kept = [r for r in rows if r[1] and all(x is not None and math.isfinite(x) for x in r[1])]
    kept = [(r[0], [math.floor(x * 4096) for x in r[1]], r[2]) for r in kept]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    kept = [(i, v + [0] * (-len(v) % parts), label) for i, v, label in kept if len(v) == len(kept[0][1])]
    w = len(kept[0][1]) // parts if kept else 0
    cut = lambda v, p: v[p * w : (p + 1) * w]
    books = [[cut(r[1], p) for r in kept[:entries]] for p in range(parts)]
    far = lambda x, y: sum((a - b) ** 2 for a, b in zip(x, y, strict=True))
    best = lambda x, book: min(range(len(book)), key=lambda e: (far(x, book[e]), e))
    for _ in range(rounds):
        for p in range(parts):
            own = defaultdict(list)
            for r in kept:
                own[best(cut(r[1], p), books[p])].append(cut(r[1], p))
            for e, members in own.items():
                books[p][e] = [sum(c) // len(members) for c in zip(*members, strict=True)]
    out, errors = [], defaultdict(int)
    for i, v, label in kept:
        codes = [best(cut(v, p), books[p]) for p in range(parts)]
        error = sum(far(cut(v, p), books[p][e]) for p, e in enumerate(codes))
        errors[label] += error
        out.append((i, "".join(f"{e:02x}" for e in codes), error, label))
    sha = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    return sorted(((i, c, e, errors[label], sha) for i, c, e, label in out), key=repr)


VECTORS = "vec_id long, embedding array<float>, label int"


def vectors(seed, n, width, grid=None):
    rng = random.Random(seed)
    one = lambda: rng.choice(grid) if grid else rng.uniform(-1, 1)
    return [(i, [float(np.float32(one())) for _ in range(width)], rng.choice([1, 1, 1, 2, None])) for i in range(n)]


@pytest.mark.parametrize("seed, n, width, grid", [(1, 90, 16, None), (2, 70, 8, [0.0, 0.25, -0.25]), (3, 9, 16, None), (4, 60, 11, [0.1, 0.2])])
def test_vector_codes_equal_plain_lloyd(spark, seed, n, width, grid):
    """Ties, fewer rows than entries and a width that parts don't divide among them."""
    rows = vectors(seed, n, width, grid)
    df = spark.createDataFrame(rows, VECTORS).repartition(3)
    assert sorted((tuple(r) for r in V.vector_codes(df).collect()), key=repr) == lloyd(rows)


def test_vector_codes_drop_and_keep_what_is_stated(spark):
    rows = vectors(5, 30, 8) + [(7, [0.5] * 8, 1), (7, [0.5] * 8, 1), (None, [0.25] * 8, None), (40, None, 1), (41, [None] * 8, 1), (42, [math.nan] * 8, 1), (43, [math.inf] * 8, 1), (44, [], 1), (45, [1.0] * 16, 1)]
    df = spark.createDataFrame(rows, VECTORS).selectExpr("vec_id", "embedding", "label", "1 AS v", "2 AS code", "3 AS rows")
    got = sorted((tuple(r) for r in V.vector_codes(df).collect()), key=repr)
    assert got == lloyd(rows) and len(got) == 33
    assert V.vector_codes(spark.createDataFrame([], VECTORS)).count() == 0
    with pytest.raises(Exception, match="16384 or more"):
        V.vector_codes(spark.createDataFrame([(1, [1e9] * 8, 1)], VECTORS)).collect()


def test_tree_assigns_like_every_distance_and_whole_nodes(monkeypatch):
    rng = np.random.default_rng(3)
    for n, width, spread in ((1, 3, 50), (500, 2, 4), (3000, 8, 1000), (700, 1, 5)):
        points = rng.integers(-spread, spread, (n, width)).astype(np.int64)
        entries = points[rng.integers(0, n, 16)]
        tree = V.Tree.build(points.copy())
        asked = []
        real = V.distances
        monkeypatch.setattr(V, "distances", lambda p, e: asked.append(len(p)) or real(p, e))
        labels, sums, counts = tree.nearest(entries)
        monkeypatch.undo()
        want = real(points, entries).argmin(axis=1)
        back = np.empty(n, int)
        back[tree.order] = labels
        assert (back == want).all() and counts.sum() == n
        assert all((sums[z] == points[want == z].sum(axis=0)).all() and counts[z] == (want == z).sum() for z in range(16))
        if (n, width) == (500, 2):
            assert sum(asked) < n  # whole subtrees were assigned by their sums


def brute_runs(w, least=24, periods=3):
    found = {}
    for q in range(1, len(w) // periods + 1):
        i = 0
        while i < len(w) - q:
            j = i
            while j < len(w) - q and w[j] == w[j + q]:
                j += 1
            if j + q - i >= max(least, periods * q) and j > i:
                found.setdefault((i, j + q), q)
            i = max(j, i + 1)
    return sorted((a, b - a, q) for (a, b), q in found.items())


def repetitive(rng, n):
    kind = rng.randrange(5)
    if kind == 0:
        return ["a"] * n
    if kind == 1:
        return [rng.choice("ab") for _ in range(n)]
    if kind == 2:
        block = [rng.choice("abc") for _ in range(rng.randrange(1, 30))]
        out = (block * n)[:n]
        for _ in range(rng.randrange(3)):
            out[rng.randrange(n)] = "x"
        return out
    out = []
    while len(out) < n:
        block = [f"w{rng.randrange(40)}" for _ in range(rng.randrange(1, 25))]
        out += block * rng.randrange(1, 6)
    return out


def test_runs_equal_brute_force():
    rng = random.Random(7)
    total = 0
    for _ in range(400):
        w = repetitive(rng, rng.randrange(1, 200))
        want = brute_runs(w)
        total += len(want)
        assert R.runs_of(w) == want, w
    assert total > 300
    assert R.runs_of([f"w{i}" for i in range(100)] * 2) == []  # two periods aren't three
    assert R.least_overlap(24, 3) == 16 and R.least_overlap(10, 4) == 8


def test_many_periods_are_asked_in_parts(monkeypatch):
    monkeypatch.setattr(R, "ASKED", 3)
    assert R.runs_of(["a"] * 100) == [(0, 100, 1)]


def digest_of(doc, text, plant):
    w = (text or "").encode().split()
    h = zlib.crc32(("" if doc is None else str(doc)).encode())
    n, g = len(w), h // 10
    if plant and h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    runs = brute_runs(w)
    best = min(runs, key=lambda r: (-r[1] / r[2], r[0], r[2])) if runs else None
    drop = {i for s, n_, q in runs for i in range(s + q, s + n_)}
    kept = b" ".join(x for i, x in enumerate(w) if i not in drop)
    lines = "".join(f"{s},{n_},{q}\n" for s, n_, q in runs)
    sha = lambda b: hashlib.sha256(b).hexdigest()
    own = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    return (doc, len(runs), *own, sha(lines.encode()), sha(kept))


def test_periodic_runs_query_equals_brute_force(spark):
    rng = random.Random(11)
    rows = [(i, " ".join(repetitive(rng, rng.randrange(1, 150))), "en", "hot", 1) for i in range(60)]
    rows += [(i, " ".join(f"w{rng.randrange(500)}" for _ in range(300)), "en", "a", 1) for i in range(60, 140)]
    rows += [(200, None, None, None, None), (201, "", "en", "a", 0), (202, " \n\t ", "en", "a", 0), (None, "a " * 50, "en", "a", 1), (203, "été  x y " * 30, "en", "a", 1)]
    rows += [(204, "\x0b".join(["b", "c"] * 20), "en", "a", 1)] * 2 + [(205, "z " * 30_000, "en", "a", 1), (206, "k l " * 12 + "m " * 30, "en", "a", 1)]
    df = spark.createDataFrame(rows, DOCS).selectExpr("*", "1 AS runs", "2 AS w", "3 AS h", "4 AS collapsed").repartition(3)
    for plant in (False, True):
        got = [tuple(r) for r in R.digest(R.periodic_runs(R.planted(df) if plant else df)).collect()]
        want = [digest_of(i, t, plant) for i, t, *_ in rows if i != 205]
        assert sorted((r for r in got if r[0] != 205), key=repr) == sorted(want, key=repr)
        assert [r[1:6] for r in got if r[0] == 205] == [(1, 0, 30_000, 1, 30_000_000)]
    assert sum(r[1] > 0 for r in got) > 40
    assert R.digest(R.periodic_runs(R.planted(spark.createDataFrame([], DOCS)))).count() == 0
    text = R.periodic_runs(spark.createDataFrame([(1, "a b " * 20 + "c", "", "", 1)], DOCS)).first()
    assert text["collapsed"] == "a b c" and [tuple(r) for r in text["runs"]] == [(0, 40, 2)]
    with pytest.raises(ValueError):
        R.periodic_runs(df, min_periods=2)


def library():
    import public_tokenizers

    return Tokenizer.from_file(public_tokenizers.path(P.VOCABULARY))


def test_fullest_is_the_best_subset_sum():
    rng = random.Random(3)
    for _ in range(300):
        lengths = [rng.randrange(1, 40) for _ in range(rng.randrange(0, 9))]
        counts = {n: lengths.count(n) for n in lengths}
        capacity = rng.randrange(1, 90)
        chosen = P.fullest(counts, capacity)
        sums = {0}
        for n in lengths:
            sums |= {s + n for s in sums}
        assert sum(chosen) == max(s for s in sums if s <= capacity)
        assert all(chosen.count(n) <= counts[n] for n in chosen)


def test_encoder_equals_the_library():
    rng = random.Random(5)
    bits = ["word", "It's", "it'll", " ", "  ", "\n", " \n ", "\t", " ", " ", "\x1f", "\x85", "12", "3.14", "<|endoftext|>", "été", "你好", "é", "!!", "'", "-", "\U0001f600", "A"]
    texts = ["".join(rng.choice(bits) + rng.choice(["", " ", " "]) for _ in range(rng.randrange(0, 40))) for _ in range(3000)]
    enc, lib = P.Encoder(), library()
    for t, e in zip(texts, lib.encode_batch(texts, add_special_tokens=False), strict=True):
        assert np.frombuffer(enc.encode(t), "<u4").tolist() == e.ids, t


def test_encoder_cache_has_two_bounded_generations(monkeypatch):
    monkeypatch.setattr(P, "CACHED", 50)
    enc, lib = P.Encoder(), library()
    for i in range(40):
        t = " ".join(f"v{i}x{j % 37}" for j in range(60))
        assert np.frombuffer(enc.encode(t), "<u4").tolist() == lib.encode(t, add_special_tokens=False).ids
        assert len(enc.young) < 200 and len(enc.old) < 200


def held_to(rows, got, capacity=1024):
    """The pieces tile every document and every sequence, and hold the library's ids; nothing is padded."""
    lib = library()
    ids = {}
    for i, t in rows:
        ids.setdefault(i, []).append(np.array([*lib.encode(t or "", add_special_tokens=False).ids, 0], "<u4"))
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for r in got:
        by_doc[r["doc_id"]].append(r)
        by_seq[r["sequence_id"]].append(r)
        assert any(zlib.crc32(x[r["start"] : r["start"] + r["length"]].tobytes()) == r["ids_crc32"] and len(x) == r["doc_tokens"] for x in ids[r["doc_id"]])
    assert by_doc.keys() == ids.keys()
    for i, copies in ids.items():
        assert sum(r["length"] for r in by_doc[i]) == sum(len(x) for x in copies)
        if len(copies) == 1:
            at = 0
            for r in sorted(by_doc[i], key=lambda r: r["start"]):
                assert r["start"] == at
                at += r["length"]
    for s in by_seq.values():
        at = 0
        for r in sorted(s, key=lambda r: r["offset"]):
            assert r["offset"] == at and r["length"] > 0
            at += r["length"]
        assert at == capacity or at < capacity and at & (at - 1) == 0


def test_packing_holds_every_id_once_without_padding(spark):
    rng = random.Random(9)
    text = lambda n: " ".join(rng.choice(["the", "quick,", "brown", "fox\n", "jumps", "über", "x1", "don't"]) for _ in range(n))
    rows = [(i, text(rng.choice([0, 1, 5, 40, 300, 800, 2500]))) for i in range(150)] + [(500, None), (501, ""), (None, text(70)), (502, text(30)), (502, text(31)), (503, "<|endoftext|> a  b "), (504, text(40_000))]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS start", "2 AS ids", "3 AS length").repartition(3)
    got = P.pack(df).collect()
    held_to(rows, got)
    assert sorted(map(tuple, got), key=repr) == sorted(map(tuple, P.pack(df).collect()), key=repr)
    with_ids = P.pack(df, with_ids=True).filter("length < 5").first()
    assert zlib.crc32(np.array(with_ids["ids"], "<u4").tobytes()) == with_ids["ids_crc32"]
    assert P.pack(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    held_to(rows, P.pack(df, capacity=64).collect(), 64)


def test_packing_over_several_pools(spark, monkeypatch):
    """The pool is emptied to its rest again and again; windows still have no slack."""
    out, total = [], 0
    monkeypatch.setattr(P, "POOL", 12)
    monkeypatch.setattr(P, "REST", 4)
    packer, rng = P.Packer(128, out.append), random.Random(2)
    for i in range(400):
        n = rng.randrange(1, 300)
        total += n
        packer.add(i, np.arange(n, dtype="<u4").tobytes())
        assert packer.size <= 13
    packer.end()
    sizes = [sum(p[2] for p in w) for w in out]
    assert sum(sizes) == total and packer.size == 0 and not packer.counts
    assert all(s == 128 or s & (s - 1) == 0 for s in sizes) and sum(s != 128 for s in sizes) <= 7


def test_a_stretch_is_looked_up_once_for_the_texts_encoded_together():
    """However often it comes, also where it must be learnt first."""
    enc, asked = P.Encoder(), []

    class Seen(dict):
        def get(self, key, *rest):
            asked.append(key)
            return super().get(key, *rest)

        __getitem__ = get

    enc.young = Seen()
    texts = ["one two, one two, one", "two, one\n one", "", " one", "one  two, x", "one two. Zwei"] * 3
    for _ in range(2):
        asked.clear()
        assert enc.encode_many(texts) == enc.plain(texts)
        assert all(asked.count(k) <= 3 for k in asked)
