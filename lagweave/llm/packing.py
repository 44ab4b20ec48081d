"""Packing token sequences into rows of a fixed length by minimum bin slack."""

from __future__ import annotations

import os
import re
import zlib
from collections import defaultdict
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from .common import col

VOCABULARY = "byte_bpe_50k.json"
CAPACITY, END_ID = 1024, 0
#: Remainders that a task holds before it fills windows, and how many it then leaves to be matched with later ones.
POOL, REST = 1024, 256
#: Stretches in the younger of the cache's two generations.
CACHED = 600_000
#: Texts are encoded together up to so many, of about so many characters.
GROUP, GROUP_CHARS = 256, 1_000_000
#: Stretches that go to the library as one text.
LINES = 512
#: A byte-level BPE of this kind never joins text across a single space between two other characters: the space opens
#: the next piece. White space here is at least all that the vocabulary's own pattern counts as such.
CUT = re.compile(r"(?<=\S) (?=\S)")


#: White space beyond the space and the line feed.
OTHER_SPACE = [c for c in map(chr, range(0x3001)) if c.isspace() and c not in " \n"]


class Encoder:
    """The tokenizers library behind a cache of stretches between single spaces, for VOCABULARY; other files' texts go whole."""

    def __init__(self, path: str | None = None):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.cuts = path is None
        if path is None:
            import public_tokenizers

            path = public_tokenizers.path(VOCABULARY)
        self.lib = Tokenizer.from_file(path)
        self.feed = self.lib.token_to_id("\u010a")  # how the vocabulary writes a line feed
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def plain(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.lib.encode_batch(texts, add_special_tokens=False)]

    def learn(self, keys: set[str]) -> None:
        """Bring stretches into the younger generation, from the older one or by encoding them."""
        known = keys & self.old.keys()
        self.young.update((s, self.old[s]) for s in known)
        new = keys - known
        # a full stop or comma after a letter is a piece of its own, so what stands before it is encoded once
        stems = {s: s[:-1] for s in new if s[-1] in ".," and s[-2:-1].isalpha() and s[-2] < "\u0250"}
        self.encode_all({s for s in (*new.difference(stems), *stems.values(), "\n.", "\n,") if s not in self.young})
        for s, stem in stems.items():
            self.young[s] = self.young[stem] + self.young["\n" + s[-1]][4:]

    def encode_all(self, keys: set[str]) -> None:
        """Encode stretches; those without white space inside or at the end many at a time, a line each."""
        feed = np.array([self.feed], "<u4").tobytes()
        words, firsts, rest = [], [], []
        for k in keys:
            if k[-1].isspace() or k.rfind("\n") > 0:
                rest.append(k)
            elif k[0] == "\n":
                firsts.append(k)
            else:
                words.append(k)
        for before, named, head in ((" ", words, b""), ("", firsts, feed)):
            parts = [named[at : at + LINES] for at in range(0, len(named), LINES)]
            texts = [before + f"\n{before}".join(p if before else [k[1:] for k in p]) for p in parts]
            for part, e in zip(parts, self.lib.encode_batch_fast(texts, add_special_tokens=False), strict=True):
                ids = np.array(e.ids, "<u4")
                data = ids.tobytes()
                ends = 4 * np.append(np.flatnonzero(ids == self.feed), len(ids))
                starts = [0, *(ends[:-1] + 4).tolist()]
                self.young.update(zip(part, [head + data[i:j] for i, j in zip(starts, ends.tolist(), strict=True)], strict=True))
        for k, ids in zip(rest, self.plain([k[1:] if k[0] == "\n" else f" {k}" for k in rest]), strict=True):
            self.young[k] = feed + ids if k[0] == "\n" else ids

    def encode(self, text: str) -> bytes:
        return self.encode_many([text])[0]

    def encode_many(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit integers; what none of them has seen is learnt together.

        A text is taken as if a line feed came before it, whose id is dropped again.
        """
        if not self.cuts:
            return self.plain(texts)
        if len(self.young) > CACHED:
            self.young, self.old = {}, self.young
        listed = [keys_of(t) for t in texts]
        own = dict.fromkeys(chain.from_iterable(keys for keys in listed if keys is not None))  # these texts' stretches, few enough to lie close together
        own = dict(zip(own, map(self.young.get, own), strict=True))
        if missing := {s for s, ids in own.items() if ids is None}:
            self.learn(missing)
            own.update((s, self.young[s]) for s in missing)
        return [self.plain([t])[0] if keys is None else b"".join(map(own.__getitem__, keys))[4:] for t, keys in zip(texts, listed, strict=True)]


def keys_of(text: str) -> list[str] | None:
    """The stretches of a text, each as its key in the cache; None where it begins with white space or is empty.

    A key that begins with a line feed stands for it and what follows up to white space; any other for a space and what
    follows. In texts whose words are parted by single spaces and line feeds alone, those are all; in others what lies
    between two single spaces may hold other white space.
    """
    if not text or text[0].isspace():
        return None
    if "  " in text or "\n\n" in text or " \n" in text or "\n " in text or text[-1].isspace() or any(c in text for c in OTHER_SPACE):
        first, *rest = CUT.split(text)
        return [f"\n{first}", *rest]
    return f"\n{text}".replace("\n", " \n").split(" ")[1:]


_ENCODERS: dict[str | None, Encoder] = {}


def encoder(path: str | None) -> Encoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def fullest(counts: dict[int, int], capacity: int) -> list[int]:
    """The multiset of lengths, each used at most counts[length] times, whose sum is largest up to capacity.

    Bit s of a set says that some choice sums to s. Lengths are added from the longest down, a count in powers of two;
    the sets before each addition are kept, and walking back through them gives the choice. It ends early at a full sum.
    """
    full, reached, steps = (1 << (capacity + 1)) - 1, 1, []
    for length in sorted(counts, reverse=True):
        left, times = min(counts[length], capacity // length), 1
        while left:
            times = min(times, left)
            steps.append((reached, length, times))
            reached |= (reached << length * times) & full
            left, times = left - times, times * 2
        if reached >> capacity:
            break
    at, chosen = reached.bit_length() - 1, []
    for before, length, times in reversed(steps):
        if not before >> at & 1:
            chosen += [length] * times
            at -= length * times
    return chosen


class Packer:
    """Fills windows of `capacity` tokens from the pieces of one task's documents.

    Whole windows are cut off long documents. What remains of each, shorter than a window, waits in a pool by length.
    A window starts with the longest remainder and takes the choice from the pool that leaves least slack; if some is
    left, the longest of the pool is cut to fill it. What stays at the end, less than a window, is cut into sequences
    whose lengths are powers of two, which aren't padded.
    """

    def __init__(self, capacity: int, emit):
        self.capacity, self.emit = capacity, emit
        self.pool: dict[int, list[tuple]] = defaultdict(list)
        self.counts: dict[int, int] = {}
        self.size = self.tokens = 0

    def take(self, length: int) -> tuple:
        self.size -= 1
        self.tokens -= length
        self.counts[length] -= 1
        if not self.counts[length]:
            del self.counts[length]
        return self.pool[length].pop()

    def put(self, length: int, piece: tuple) -> None:
        self.size += 1
        self.tokens += length
        self.counts[length] = self.counts.get(length, 0) + 1
        self.pool[length].append(piece)

    def add(self, doc, ids: bytes) -> None:
        """A document: its whole windows go out, the rest waits."""
        n, total = self.capacity, len(ids) // 4
        for start in range(0, total - n + 1, n):
            self.emit([(doc, start, n, ids[4 * start : 4 * (start + n)], total)])
        if rest := total % n:
            self.put(rest, (doc, total - rest, ids[4 * (total - rest) :], total))
        if self.size >= POOL:
            self.fill(REST)

    def piece(self, length: int, want: int) -> tuple:
        """A piece of `want` tokens off a remainder of `length`; what is left of it goes back into the pool."""
        doc, start, ids, total = self.take(length)
        if want < length:
            self.put(length - want, (doc, start + want, ids[4 * want :], total))
        return doc, start, want, ids[: 4 * want], total

    def fill(self, rest: int) -> None:
        """Windows until at most `rest` remainders wait, or too few tokens for another one."""
        while self.size > rest and self.tokens >= self.capacity:
            longest = max(self.counts)
            window = [self.piece(longest, longest)]
            for length in fullest(self.counts, self.capacity - longest):
                window.append(self.piece(length, length))
            slack = self.capacity - sum(p[2] for p in window)
            if slack:
                window.append(self.piece(max(self.counts), slack))  # every remainder left is longer than the slack
            self.emit(window)

    def end(self) -> None:
        self.fill(0)
        left = self.tokens
        while left:
            size = room = 1 << left.bit_length() - 1
            window = []
            while room:
                length = max(self.counts)
                window.append(self.piece(length, min(length, room)))
                room -= window[-1][2]
            self.emit(window)
            left -= size


def grouped(batch: pa.RecordBatch) -> Iterator[tuple[list, list[str]]]:
    """(ids, texts) of rows that are encoded together; a null text is empty."""
    docs, texts, size = [], [], 0
    for doc, t in zip(batch.column(0), batch.column(1), strict=True):
        docs.append(doc.as_py())
        texts.append(t.as_py() or "")
        size += len(texts[-1])
        if len(texts) == GROUP or size > GROUP_CHARS:
            yield docs, texts
            docs, texts, size = [], [], 0
    if texts:
        yield docs, texts


PIECE = {"start": pa.int64(), "length": pa.int64(), "ids_crc32": pa.int64(), "doc_tokens": pa.int64(), "sequence_id": pa.int64(), "offset": pa.int64()}


def pack(docs: DataFrame, *, capacity: int = CAPACITY, end_id: int = END_ID, tokenizer: str | None = None, doc_id: str = "doc_id", text: str = "text", with_ids: bool = False) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, and ids if asked for.

    A document is its text's ids and end_id (null and empty texts: end_id alone). Each task packs its own rows in one
    pass, so nothing is shuffled, no more than a pool of short remainders is held, and a lost task is simply run again
    over the same rows. Every sequence is full but for the last few of a task, whose lengths are powers of two; there
    is no padding at all. sequence_id is the task's number times 2^33 and a running number. Repeated rows and null ids
    are packed each by itself.
    """
    if capacity < 1:
        raise ValueError("capacity is at least 1")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, first = encoder(tokenizer), TaskContext.get().partitionId() << 33
        end, rows, number = np.array([end_id], "<u4").tobytes(), [], 0
        kind = None

        def emit(window: list[tuple]) -> None:
            nonlocal number
            offset = 0
            for doc, start, length, ids, total in window:
                rows.append((doc, start, length, zlib.crc32(ids), total, first + number, offset, *[np.frombuffer(ids, "<u4").tolist()] * with_ids))
                offset += length
            number += 1

        def made() -> pa.RecordBatch:
            columns = zip(*rows, strict=True) if rows else [()] * (7 + with_ids)
            kinds = {"doc_id": kind, **PIECE} | ({"ids": pa.list_(pa.int64())} if with_ids else {})
            out = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds.values(), strict=True)], list(kinds))
            rows.clear()
            return out

        packer = Packer(capacity, emit)
        for batch in batches:
            kind = batch.schema.field(0).type
            for docs, texts in grouped(batch):
                for doc, ids in zip(docs, enc.encode_many(texts), strict=True):
                    packer.add(doc, ids + end)
                    if len(rows) >= 4096:
                        yield made()
        if kind is not None:
            packer.end()
            yield made()

    rows = docs.select(col(doc_id).alias("doc_id"), col(text).alias("text"))
    schema = f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long" + ", ids array<long>" * with_ids
    return rows.mapInArrow(run, schema)
