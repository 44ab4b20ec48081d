"""Language-model scoring with a log-frequency Bloom filter of quantised n-gram counts.

The filter grows with the corpus, so no bound holds for a broadcast of all of it: it is cut into shards by hash, and
the distinct words and word pairs of a few megabytes of texts at a time (a unit) are sent to the shards that know them.
The answers come back to the unit, whose texts are then scored. Each text is read as often at any size.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import col, forget, id_remainder, stored

#: Counts are quantised to 1 + floor(log2 c). Each level is one key of the filter, of so many bits and probes.
BITS_PER_KEY, PROBES, LEVELS = 8, 5, 64
#: Training tokens of a shard, about; bytes of text of a unit, about.
PER_SHARD, UNIT_BYTES = 2_000_000, 8 << 20
#: Bytes of a pair's hash that are sent to its shard: two pairs of a shard are taken for one once in 2^40.
SENT = 5
#: Bytes that are hashed at once; distinct n-grams, and tokens, that a task counts before it hands them on.
PIECE, FLUSH, MOST = 1 << 20, 1_500_000, 1 << 31
PRIOR = 20.0
#: What a word that training does not have counts as in the smoothed score.
UNSEEN = 0.5

_RNG = np.random.default_rng(5)
TABLE = _RNG.integers(0, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
BASE = 0xD1342543DE82EF95
INVERSE = pow(BASE, -1, 2**64)
END, START = np.uint64(0xE4D0000000000001), np.uint64(0x57A2700000000001)


def powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


_POWERS: list[np.ndarray] = []


def scrambled(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def word_hashes(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(64-bit hash, first byte) of each run without ASCII white space, A-Z lower-cased."""
    b = np.frombuffer(data.lower(), np.uint8)
    if not _POWERS or len(_POWERS[0]) < len(b) + 1:
        _POWERS[:] = [powers(BASE, max(PIECE, len(b)) + 1), powers(INVERSE, max(PIECE, len(b)) + 1)]
    solid = np.concatenate([[False], (b != 32) & ((b < 9) | (b > 13)), [False]])
    edge = np.flatnonzero(solid[1:] != solid[:-1])
    first, last = edge[::2], edge[1::2]
    sums = np.concatenate([[np.uint64(0)], np.cumsum(TABLE[b] * _POWERS[0][: len(b)], dtype=np.uint64)])
    return scrambled((sums[last] - sums[first]) * _POWERS[1][first] + (last - first).astype(np.uint64)), first


def pieces(texts: list[str | None]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(text number, token hash, hash of the token before) in order, a few megabytes at a time; END ends each text."""
    part: list[tuple[int, bytes, bool]] = []
    size, before = 0, START

    def settle():
        nonlocal before
        data = b" ".join(x for _, x, _ in part)
        h, first = word_hashes(data)
        limits = np.cumsum([len(x) + 1 for _, x, _ in part])
        unit = np.searchsorted(limits, first, side="right")
        ends = np.array([last for _, _, last in part])
        closed = np.cumsum(ends) - ends  # ENDs before each unit
        total = len(h) + int(ends.sum())
        token, which = np.full(total, END, np.uint64), np.zeros(total, np.int64)
        owner = np.array([i for i, _, _ in part])
        at = np.arange(len(h)) + closed[unit]
        token[at], which[at] = h, owner[unit]
        stops = np.cumsum(np.bincount(unit, minlength=len(part)))[ends] + np.arange(int(ends.sum()))
        which[stops] = owner[ends]
        prev = np.concatenate([[before], token[:-1]]) if total else token
        prev[prev == END] = START
        if total:
            before = START if token[-1] == END else token[-1]
        part.clear()
        return which, token, prev

    for i, text in enumerate(texts):
        data = (text or "").encode("utf-8", "surrogatepass")
        at = 0
        while True:
            end = min(at + PIECE, len(data))
            while end < len(data) and data[end] not in b" \t\n\v\f\r":
                end += 1
            part.append((i, data[at:end], end == len(data)))
            size += end - at
            at = end
            if size >= PIECE:
                yield settle()
                size = 0
            if at == len(data):
                break
    if part:
        yield settle()


def pairs(prev: np.ndarray, token: np.ndarray) -> np.ndarray:
    return scrambled(prev * np.uint64(0x9E3779B97F4A7C15) + token)


def counted(hashes: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    if not hashes:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    h, c = np.concatenate(hashes), np.concatenate(counts)
    order = np.argsort(h, kind="stable")
    h, c = h[order], c[order]
    starts = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]])) if len(h) else np.zeros(0, int)
    return h[starts], np.add.reduceat(c, starts) if len(starts) else c


def shard_of(h: np.ndarray, shards: int) -> np.ndarray:
    """Hashes are dealt to shards by range, so sorted ones are in the order of their shards."""
    return ((h >> np.uint64(32)) * np.uint64(shards) >> np.uint64(32)).astype(np.int64)


def by_shard(h: np.ndarray, shards: int) -> np.ndarray:
    """Where each shard's part of the sorted hashes begins, and the end of the last."""
    return np.searchsorted(shard_of(h, shards), np.arange(shards + 1))


def sent(h: np.ndarray) -> bytes:
    """The last SENT bytes of each hash; the first ones name the shard."""
    return np.ascontiguousarray(h).view(np.uint8).reshape(-1, 8)[:, :SENT].tobytes()


def received(data: bytes) -> np.ndarray:
    h = np.zeros((len(data) // SENT, 8), np.uint8)
    h[:, :SENT] = np.frombuffer(data, np.uint8).reshape(-1, SENT)
    return h.view(np.uint64).ravel()


def numbers(x: np.ndarray) -> bytes:
    """Counts in 4 bytes each, or in 8 where that is too little; the first byte says which."""
    wide = x.max(initial=0) >= 2**32
    return (b"8" if wide else b"4") + x.astype("<u8" if wide else "<u4").tobytes()


def of_numbers(data: bytes) -> np.ndarray:
    return np.frombuffer(data, f"<u{data[:1].decode()}", offset=1)


def shard_counts(docs: DataFrame, text: str, shards: int) -> DataFrame:
    """(shard, pair, hashes, counts): each task's own counts of words and of word pairs, as arrays by shard."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple[list, list] = ([], [])
        size = seen = 0

        def flush() -> pa.RecordBatch:
            rows = []
            for pair, parts in enumerate(held):
                h, c = counted([h for h, _ in parts], [c for _, c in parts])
                cuts = by_shard(h, shards)
                rows += [(k, bool(pair), sent(h[i:j]) if pair else h[i:j].tobytes(), numbers(c[i:j])) for k, (i, j) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)) if i < j]
                parts.clear()
            columns = zip(*rows, strict=True) if rows else ((),) * 4
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, (pa.int32(), pa.bool_(), pa.binary(), pa.binary()), strict=True)], ["shard", "pair", "hashes", "counts"])

        for batch in batches:
            for _, token, prev in pieces(batch.column(0).to_pylist()):
                for parts, grams in zip(held, (token, pairs(prev, token)), strict=True):
                    parts.append(np.unique(grams, return_counts=True))
                    size += len(parts[-1][0])
                seen += len(token)
                if size > FLUSH or seen > MOST:
                    yield flush()
                    size = seen = 0
        if size:
            yield flush()

    return docs.select(col(text).alias("text")).mapInArrow(run, "shard int, pair boolean, hashes binary, counts binary")


def summed(parts: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, counts) of a shard's parts, all of words or all of pairs."""
    read = [received if pair else lambda x: np.frombuffer(x, np.uint64) for pair in parts["pair"]]
    return counted([f(x) for f, x in zip(read, parts["hashes"], strict=True)], [of_numbers(x).astype(np.int64) for x in parts["counts"]])


def levels(counts: np.ndarray) -> np.ndarray:
    return np.floor(np.log2(np.maximum(counts, 1))).astype(np.int64) + 1


def build_shard(h: np.ndarray, c: np.ndarray, bits_per_key: int = BITS_PER_KEY) -> bytes:
    """Bits of a log-frequency Bloom filter: n-gram h is in at the levels 1 to 1 + floor(log2 c)."""
    q = levels(c)
    bits = max(64, int(q.sum()) * bits_per_key)
    table = np.zeros((bits + 7) // 8 * 8, bool)
    for level in range(1, int(q.max(initial=0)) + 1):
        for k in range(PROBES):
            table[slot(h[q >= level], level, bits, k)] = True
    return bits.to_bytes(8, "little") + np.packbits(table, bitorder="little").tobytes()


def probe_shard(blob: bytes, h: np.ndarray) -> np.ndarray:
    """The quantised count of each n-gram: levels are probed upwards until one is missing; 0 if none is in."""
    bits, table = int.from_bytes(blob[:8], "little"), np.frombuffer(blob, np.uint8, offset=8)
    out, left = np.zeros(len(h), np.int64), np.arange(len(h))
    for level in range(1, LEVELS):
        for k in range(PROBES):
            if not len(left):
                return out
            place = slot(h[left], level, bits, k)
            left = left[(table[place >> np.uint64(3)] >> (place & np.uint64(7)).astype(np.uint8)) & 1 == 1]
        out[left] = level
    return out


def slot(h: np.ndarray, level: int, bits: int, k: int) -> np.ndarray:
    """Place k of (n-gram, level) in a shard of so many bits, by double hashing."""
    a = scrambled(h + np.uint64(level * 0xA0761D6478BD642F & (2**64 - 1)))
    return ((a + np.uint64(k) * (scrambled(a) | np.uint64(1))) >> np.uint64(11)) % np.uint64(bits)


MODEL = "shard int, tokens long, distinct long, words binary, counts binary, filter binary"


def model_of(train: DataFrame, text: str, shards: int, bits_per_key: int = BITS_PER_KEY) -> DataFrame:
    """(shard, tokens, distinct, words, counts, filter): a shard's exact word counts and its filter over the word pairs."""

    def merge(key: tuple, parts: pd.DataFrame) -> pd.DataFrame:
        words, counts = summed(parts[~parts["pair"]])
        blob = build_shard(*summed(parts[parts["pair"]]), bits_per_key)
        return pd.DataFrame([(key[0], int(counts.sum()), len(words), words.tobytes(), counts.astype("<i8").tobytes(), blob)], columns=MODEL.replace(",", "").split(" ")[::2])

    return shard_counts(train, text, shards).groupBy("shard").applyInPandas(merge, MODEL)


def in_units(docs: DataFrame, doc_id: str, text: str, held: Column, unit_bytes: int) -> DataFrame:
    """(unit, place, doc_id, held_out, text): whole texts in units of about unit_bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, unit, place, size = TaskContext.get().partitionId() << 32, 0, 0, 0
        for batch in batches:
            units, places = [], []
            for n in batch.column(0).to_pylist():
                if size and size + n > unit_bytes:
                    unit, place, size = unit + 1, 0, 0
                units.append(part + unit)
                places.append(place)
                place, size = place + 1, size + n + 1
            yield pa.RecordBatch.from_arrays([pa.array(units, pa.int64()), pa.array(places, pa.int64()), *batch.columns[1:]], ["unit", "place", "doc_id", "held_out", "text"])

    rows = docs.select(F.coalesce(F.octet_length(col(text)), F.lit(0)).alias("bytes"), col(doc_id).cast("long").alias("doc_id"), F.coalesce(held, F.lit(False)).alias("held_out"), col(text).alias("text"))
    return rows.mapInArrow(run, "unit long, place long, doc_id long, held_out boolean, text string")


def grams_of(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text numbers, tokens, pairs) of the texts in order."""
    parts = [*pieces(texts)]
    which, token, prev = (np.concatenate([p[i] for p in parts]) for i in range(3))
    return which, token, pairs(prev, token)


def questions(rows: DataFrame, shards: int) -> DataFrame:
    """(unit, first, last, shard, words, pairs): the distinct word and pair hashes of each run of a unit's rows.

    A unit whose rows a file split parts asks in two runs, from place `first` to place `last` each.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unit, first, held = None, 0, []

        def ask() -> pa.RecordBatch:
            _, token, pair = grams_of(held)
            words, grams = np.unique(token), np.unique(pair)
            cut, cuts = by_shard(words, shards), by_shard(grams, shards)
            there = np.flatnonzero((cut[1:] > cut[:-1]) | (cuts[1:] > cuts[:-1]))
            n = len(there)
            columns = [pa.array(np.full(n, x)) for x in (unit, first, first + len(held) - 1)] + [pa.array(there)]
            columns += [pa.array([f(h[c[k] : c[k + 1]]) for k in there], pa.binary()) for f, h, c in ((np.ndarray.tobytes, words, cut), (sent, grams, cuts))]
            return pa.RecordBatch.from_arrays(columns, ["unit", "first", "last", "shard", "words", "pairs"])

        for batch in batches:
            for u, p, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                if held and (u != unit or p != first + len(held)):
                    yield ask()
                    held.clear()
                if not held:
                    unit, first = u, p
                held.append(t.as_py())
        if held:
            yield ask()

    return rows.select("unit", "place", "text").mapInArrow(run, "unit long, first long, last long, shard long, words binary, pairs binary")


def answers(asked: DataFrame, model: DataFrame) -> DataFrame:
    """(unit, first, last, shard, counts, levels): the exact counts of the words, and the pairs' counts by the filter."""

    def one(rows: pd.DataFrame, found: pd.DataFrame) -> pd.DataFrame:
        if len(found):
            words, counts, blob = np.frombuffer(found["words"].iloc[0], np.uint64), np.frombuffer(found["counts"].iloc[0], "<i8"), found["filter"].iloc[0]
        else:
            words, counts, blob = np.zeros(0, np.uint64), np.zeros(0, np.int64), build_shard(np.zeros(0, np.uint64), np.zeros(0, np.int64))

        def count(h: np.ndarray) -> np.ndarray:
            if not len(words):
                return np.zeros(len(h), np.int64)
            at = np.minimum(np.searchsorted(words, h), len(words) - 1)
            return np.where(words[at] == h, counts[at], 0)

        out = rows[["unit", "first", "last", "shard"]].copy()
        out["counts"] = [numbers(count(np.frombuffer(x, np.uint64))) for x in rows["words"]]
        out["levels"] = [probe_shard(blob, received(x)).astype(np.uint8).tobytes() for x in rows["pairs"]]
        return out

    both = asked.groupBy("shard").cogroup(model.select(F.col("shard").cast("long").alias("shard"), "words", "counts", "filter").groupBy("shard"))
    return both.applyInPandas(one, "unit long, first long, last long, shard long, counts binary, levels binary")


def scored(rows: DataFrame, told: DataFrame, tokens: int, distinct: int) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, base_score, score) of the units' texts with the answers to their questions.

    A pair's count, known to a power of two, is smoothed with the word's share as prior; START counts as often as END,
    as each text has one of both.
    """
    scale = tokens + 0.5 * (distinct + 1)

    def one(texts: pa.Table, answered: pa.Table) -> pa.Table:
        done = []
        texts = texts.sort_by("place")
        for (first, last), part in answered.to_pandas().sort_values("shard").groupby(["first", "last"]):
            some = texts.slice(first, last + 1 - first)
            n = len(some)
            which, token, pair = grams_of(some.column("text").to_pylist())
            words, at = np.unique(token, return_inverse=True)
            counts = np.concatenate([of_numbers(x) for x in part["counts"]]).astype(float)
            q = np.frombuffer(b"".join(part["levels"]), np.uint8)[np.unique(pair, return_inverse=True)[1]].astype(np.int64)
            count = counts[at]
            smooth = np.where(count > 0, count, UNSEEN)
            before = np.concatenate([[counts[np.searchsorted(words, END)] or UNSEEN], smooth[:-1]])  # before a text's first word stands an END
            share = np.minimum(1.0, (smooth + 0.5) / scale)
            many = np.where(q > 0, 0.75 * 2.0**q - 0.5 * (q == 1), 0.0)
            p = np.log10((many + PRIOR * share) / (np.maximum(before, many) + PRIOR))
            sums = np.bincount(which, minlength=n), np.bincount(which, count > 0, n).astype(np.int64), np.bincount(which, np.log10((count + 0.5) / scale), n), np.bincount(which, p, n)
            done.append(pa.table([some.column("doc_id"), some.column("held_out"), *map(pa.array, sums)], ["doc_id", "held_out", "n_tokens", "n_known", "base_score", "score"]))
        return pa.concat_tables(done)

    both = rows.select("unit", "place", "doc_id", "held_out", "text").groupBy("unit").cogroup(told.groupBy("unit"))
    return both.applyInArrow(one, "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double")


def score(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", held_out: Column | None = None, mod: int = 5, out: int = 1, bits_per_key: int = BITS_PER_KEY, per_shard: int = PER_SHARD, unit_bytes: int = UNIT_BYTES) -> DataFrame:
    """Score every row under models of the rows that aren't held out (crc32 of the id mod `mod` is `out`).

    Tokens are words (A-Z lower-cased, runs without ASCII white space) and one end per text; null texts have the end
    alone. Returns doc_id, held_out, n_tokens, n_known (tokens that training has), train_tokens, base_score (unigram,
    add 0.5, exact counts) and score: log10 probability under word pairs, whose counts come from a log-frequency Bloom
    filter, smoothed with the words' exact shares. Words are told apart by 64-bit hashes. Counts cover all training
    texts. A hot word or pair goes to its shard once a unit. Null ids, repeated rows and very long texts (a unit of
    their own) are scored like any other; an empty training set makes every word unknown.
    """
    held = held_out if held_out is not None else id_remainder(col(doc_id), mod) == out
    rows = stored(in_units(docs, doc_id, text, held, unit_bytes), "lm-units")
    train = rows.filter("not held_out")
    size = train.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shards = max(8, math.ceil(size / 6 / per_shard))
    model = stored(model_of(train, "text", shards, bits_per_key), "lm-model")
    tokens, distinct = model.agg(F.sum("tokens"), F.sum("distinct")).first()
    tokens, distinct = tokens or 0, distinct or 0
    told = answers(questions(rows, shards), model)
    found = stored(scored(rows, told, tokens, distinct), "lm-scores")
    forget(rows, model)
    return found.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(tokens).cast("long").alias("train_tokens"), "base_score", "score")
