import itertools
import random

from pyspark.sql import functions as F

from lagweave.functions import paircov as P


def draw(alphabet, rng, top=4):
    return {(a, b): rng.randint(0, top) for a in alphabet for b in alphabet}


def members(table, least=0):
    return [cell for cell, n in table.items() if n > least for _ in range(n)]


def brute(table, least, test):
    kept = members(table, least)
    return sum(test(x, y) for x, y in itertools.combinations(kept, 2)), len(kept) * (len(kept) - 1) // 2


def differ(x, y):
    return x[0] != y[0] and x[1] != y[1]


def test_closed_forms_equal_counting_of_pairs(spark):
    for alphabet in (P.BASES, P.BITS):
        rng, rows, want = random.Random(1), [], []
        for k in range(60):
            t = draw(alphabet, rng)
            rows.append((k, *[t[a, b] for a in alphabet for b in alphabet]))
            want.append((*brute(t, 0, differ), *brute(t, 1, differ), *brute(t, 0, lambda x, y: x == y)))
        df = spark.createDataFrame(rows, ["k", *P.cells(alphabet)])
        cols = [*P.p11(alphabet), *P.p11(alphabet, 1), *P.p00(alphabet)]
        got = [tuple(r) for r in df.orderBy("k").select(*[c.alias(f"c{i}") for i, c in enumerate(cols)]).collect()]
        assert got == want
        shares = [a / b for a, b, *_ in got if b]
        assert all(0 <= s <= 1 for s in shares)


def test_mate_statistics_equal_counting(spark):
    rng, rows, want = random.Random(2), [], []
    for k in range(30):
        x, y = draw(P.BASES, rng), draw(P.BASES, rng)
        rows.append((k, *[x[a, b] for a in P.BASES for b in P.BASES], *[y[a, b] for a in P.BASES for b in P.BASES]))
        pairs = list(itertools.product(members(x, 1), members(y, 1)))
        whole = sum(x.values()) * sum(y.values())
        kept = sum(n > 1 for n in x.values())
        want.append((sum(differ(p, q) for p, q in pairs), whole, sum(x[c] * y[c] for c in x), whole, len(pairs), whole * kept))
    df = spark.createDataFrame(rows, ["k", *P.cells(prefix="x_"), *P.cells(prefix="y_")])
    cols = [*P.mate_p11(least=1), *P.mate_p00(), *P.mate_p11_aps(least=1)]
    assert [tuple(r) for r in df.orderBy("k").select(*[c.alias(f"c{i}") for i, c in enumerate(cols)]).collect()] == want


def test_tables_add_up_and_ignore_foreign_letters(spark):
    df = spark.createDataFrame([("A", "T"), ("A", "T"), ("G", "N"), ("-", "A")], ["a", "b"])
    one = df.agg(*P.counts(F.col("a"), F.col("b")))
    two = one.union(one).agg(*P.append()).first()
    assert two["n_AT"] == 4 and sum(two) == 4
