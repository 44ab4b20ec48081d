"""Periodic runs of words: repeated k-gram masking, then Main-Lorentz over the segments that survive it."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD, col

MIN_LENGTH, MIN_PERIODS = 24, 3
BASE = np.uint64(0x9E3779B97F4A7C15)
#: Periods that are held against the words around a middle at a time.
ASKED = 20_000


def least_overlap(min_length: int, min_periods: int) -> int:
    """Every run repeats at least so many words one period on: the least of max(min_length, min_periods q) - q over q."""
    return min(max(min_length, min_periods * q) - q for q in range(1, min_length + 1))


def gram_hashes(ids: np.ndarray, k: int) -> np.ndarray:
    """A 64-bit hash of every k consecutive ids, by doubling; equal grams have equal hashes."""
    with np.errstate(over="ignore"):
        one = (ids.astype(np.uint64) + np.uint64(1)) * BASE
        one = (one ^ (one >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
        one ^= one >> np.uint64(29)
        out, size, power = one, 1, BASE
        for bit in bin(k)[3:]:
            out, size, power = out[:-size] * power + out[size:], 2 * size, power * power
            if bit == "1":
                out, size, power = out[:-1] * BASE + one[size:], size + 1, power * BASE
    return out


def segments(ids: np.ndarray, k: int) -> list[tuple[int, int]]:
    """Stretches of words that lie in a k-gram which occurs again in the document; a run lies within one of them."""
    if len(ids) <= k:
        return []
    _, group, count = np.unique(gram_hashes(ids, k), return_inverse=True, return_counts=True)
    start = np.flatnonzero(count[group] > 1)
    if not len(start):
        return []
    new = np.flatnonzero(np.diff(start) > k)  # grams that touch or overlap make one stretch
    return list(zip(start[np.r_[0, new + 1]].tolist(), (start[np.r_[new, len(start) - 1]] + k).tolist(), strict=True))


def prefix_lengths(s: list[int]) -> list[int]:
    """At each place, how many items agree with the beginning (the Z function); 0 at place 0."""
    n, left, right = len(s), 0, 0
    z = [0] * n
    for i in range(1, n):
        k = z[i - left] if i < right else 0
        if i + k >= right:
            k = max(0, right - i)
            while i + k < n and s[k] == s[i + k]:
                k += 1
            left, right = i, i + k
        z[i] = k
    return z


def hopeful(w: np.ndarray, m: int, lo: int, hi: int, periods: np.ndarray, k: int, forward: bool) -> np.ndarray:
    """Those periods whose k-word overlap around the middle isn't ruled out by the k words on either side of it."""
    if len(periods) > ASKED:
        return np.concatenate([hopeful(w, m, lo, hi, periods[i : i + ASKED], k, forward) for i in range(0, len(periods), ASKED)])
    at = np.arange(-k, k)[None, :] + (m if forward else m - 1)
    there = at + (periods if forward else -periods)[:, None]
    alike = (at >= lo) & (at < hi) & (there >= lo) & (there < hi)
    alike[alike] = w[np.broadcast_to(at, alike.shape)[alike]] == w[there[alike]]
    before = np.cumprod(alike[:, k - 1 :: -1], axis=1).sum(axis=1)
    after = np.cumprod(alike[:, k:], axis=1).sum(axis=1)
    return periods[before + after >= k]


def main_lorentz(w: np.ndarray, min_length: int = MIN_LENGTH, min_periods: int = MIN_PERIODS) -> list[tuple[int, int, int]]:
    """(start, length, period) of every maximal run of at least max(min_length, min_periods period) items, sorted.

    Each run crosses the middle of one node of the halving. There, two Z functions give for every period how far the
    repetition reaches to both sides; only periods whose repetition holds at the words next to the middle are asked.
    """
    k, found = least_overlap(min_length, min_periods), {}
    stack = [(0, len(w))]
    while stack:
        lo, hi = stack.pop()
        if hi - lo < min_length:
            continue
        m, most = (lo + hi) // 2, (hi - lo) // min_periods
        stack += [(lo, m), (m, hi)]
        right = np.flatnonzero(w[m + 1 : min(hi, m + 1 + most)] == w[m]) + 1  # one period on from the middle's right word
        left = np.flatnonzero(w[max(lo, m - 1 - most) : m - 1][::-1] == w[m - 1]) + 1  # one back from its left word
        right, left = hopeful(w, m, lo, hi, right, k, True), hopeful(w, m, lo, hi, left, k, False)
        if not len(right) and not len(left):
            continue
        u, v = w[lo:m].tolist(), w[m:hi].tolist()
        back = np.array(prefix_lengths([*u[::-1], -1, *v[::-1], *u[::-1]]))
        ahead = np.array(prefix_lengths([*v, -1, *u, *v]))
        nu, nv = len(u), len(v)
        for p, s, e in (
            (right, m - back[nu + 1 + nv - right], m + right + ahead[right]),
            (left, m - left - back[left], m + ahead[nv + 1 + nu - left]),
        ):
            good = e - s >= np.maximum(min_length, min_periods * p)
            for q, a, b in zip(p[good].tolist(), s[good].tolist(), e[good].tolist(), strict=True):
                if a == lo and a > 0 and w[a - 1] == w[a - 1 + q] or b == hi and b < len(w) and w[b] == w[b - q]:
                    continue  # goes on beyond this node: found whole at the one above
                found[a, b] = min(q, found.get((a, b), q))
    return sorted((a, b - a, q) for (a, b), q in found.items())


def runs_of(words: list, min_length: int = MIN_LENGTH, min_periods: int = MIN_PERIODS) -> list[tuple[int, int, int]]:
    """The runs of a list of words: (start, length, period)."""
    if len(words) < min_length:
        return []
    number: dict = {}
    ids = np.fromiter((number.setdefault(x, len(number)) for x in words), np.int64, len(words))
    out = []
    for a, b in segments(ids, least_overlap(min_length, min_periods)):
        out += [(a + s, n, q) for s, n, q in main_lorentz(ids[a:b], min_length, min_periods)]
    return out


def kept_words(words: list, runs: list[tuple[int, int, int]]) -> list:
    """words without those that a run holds after its first period."""
    if not runs:
        return words
    depth = np.zeros(len(words) + 1, np.int64)
    for start, n, q in runs:
        depth[start + q] += 1
        depth[start + n] -= 1
    return [words[i] for i in np.flatnonzero(depth.cumsum()[:-1] == 0).tolist()]


RUN = "array<struct<start: long, length: long, period: long>>"


def periodic_runs(docs: DataFrame, *, min_length: int = MIN_LENGTH, min_periods: int = MIN_PERIODS, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, runs (start, length, period; by start, then period) and the collapsed text.

    A run is a maximal stretch of words with smallest period q and length >= max(min_length, min_periods * q); the
    collapsed text holds the words outside runs and each run's first period, joined by single spaces. Null and empty
    texts have no runs and collapse to the empty string; repeated rows are treated each by itself. Nothing is shuffled;
    a task holds the words of one text at a time. min_periods is at least 3, where the two sides of a middle can't miss a run.
    """
    if min_periods < 3:
        raise ValueError("min_periods is at least 3")
    kind = pa.list_(pa.struct([pa.field(c, pa.int64()) for c in ("start", "length", "period")]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), 256):
                part, runs, collapsed = batch.slice(at, 256), [], []
                for t in part.column(1):
                    words = (t.as_py() or "").encode("utf-8", "surrogatepass").split()  # bytes split at ASCII white space only
                    runs.append(runs_of(words, min_length, min_periods))
                    collapsed.append(b" ".join(kept_words(words, runs[-1])))
                cells = [[dict(zip(("start", "length", "period"), r, strict=True)) for r in rs] for rs in runs]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(cells, kind), pa.array(collapsed, pa.binary()).cast(pa.string())], ["doc_id", "runs", "collapsed"])

    rows = docs.select(col(doc_id).alias("doc_id"), col(text).alias("text"))
    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, runs {RUN}, collapsed string")


def digest(found: DataFrame) -> DataFrame:
    """The contract's columns of periodic_runs(): counts, the run of greatest length/period, and the digests."""
    first: Column = F.array_sort("runs", lambda x, y: F.coalesce(
        F.nullif(F.signum((y["length"] * x["period"] - x["length"] * y["period"]).cast("double")).cast("int"), F.lit(0)),
        F.nullif(F.signum((x["start"] - y["start"]).cast("double")).cast("int"), F.lit(0)),
        F.signum((x["period"] - y["period"]).cast("double")).cast("int"),
    ))
    lines = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string"))), "\n")
    lines = F.when(F.size("runs") > 0, F.concat(lines, F.lit("\n"))).otherwise("")
    best = found.withColumn("best", F.when(F.size("runs") > 0, F.get(first, F.lit(0))))
    return best.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        "best.start",
        "best.length",
        "best.period",
        F.floor(1000 * F.col("best.length") / F.col("best.period")).cast("long").alias("exponent_milli"),
        F.sha2(lines.cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )


def planted(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, text) of docs, in which some texts repeat: with h = crc32 of the id, n words and g = h / 10, where h % 10
    is 0 the words from place a = g % n on repeat the p = 1 + (n - a) / (3 + g % 8) that begin there. Others are unchanged.
    """
    h = F.crc32(F.coalesce(col(doc_id).cast("string"), F.lit("")).cast("binary"))
    rows = docs.select(col(doc_id).alias("doc_id"), col(text).alias("text"), h.alias("h"), F.floor(h / 10).cast("long").alias("g"))
    words = F.when(F.col("h") % 10 == 0, F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(WORD), F.lit(0)))
    rows = rows.withColumn("w", words).withColumn("n", F.size("w").cast("long"))
    rows = rows.withColumn("a", F.when(F.col("n") > 0, F.col("g") % F.col("n")))
    rows = rows.withColumn("p", 1 + F.floor((F.col("n") - F.col("a")) / (3 + F.col("g") % 8)).cast("long"))
    block = F.slice("w", F.col("a").cast("int") + 1, F.col("p").cast("int"))
    copies = F.flatten(F.array_repeat(block, F.ceil((F.col("n") - F.col("a")) / F.col("p")).cast("int")))
    made = F.concat(F.slice("w", F.lit(1), F.col("a").cast("int")), F.slice(copies, F.lit(1), (F.col("n") - F.col("a")).cast("int")))
    return rows.select("doc_id", F.when(F.col("a").isNotNull(), F.array_join(made, " ")).otherwise(F.col("text")).alias("text"))
