"""Token ids in length-delimited binary records with masked checksums, and an offset index for shuffled reads."""

from __future__ import annotations

import os
import re
import struct
import zlib
from collections.abc import Iterator
from itertools import chain, pairwise

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import col, new_path, stored

VOCABULARY = "word_bpe_49k.json"
END_ID = 2
#: A frame: length of the payload, its masked checksum, the payload, its masked checksum. A payload: doc_id, ids.
LENGTH, CHECK, DOC = struct.Struct("<Q"), struct.Struct("<I"), struct.Struct("<qB")
NO_ID = -(2**63)
#: Words in the younger of the cache's two generations.
CACHED_WORDS = 600_000
#: A word that the vocabulary keeps apart, between the words that go to the library as one text, of which there are so many.
MARK, TOGETHER = "#", 32
#: A word of letters that are small and composed in every Unicode, and the run of ASCII punctuation that ends it: the rules part the two there and nowhere else.
PLAIN = re.compile(rb"((?:[a-z]|\xc3[\x9f-\xb6\xb8-\xbf])+)([!-/:-@\[-`{-~]*)")
#: The letter that stands for each byte in the vocabulary: printable ones for themselves, the others from 256 on in order.
PRINTABLE = [*range(33, 127), *range(161, 173), *range(174, 256)]
BYTE_LETTERS = dict(zip([b for b in range(256) if b not in PRINTABLE], range(256, 512), strict=False))
#: Texts are encoded together up to so many, of about so many characters.
GROUP, GROUP_CHARS = 64, 500_000


def masked(data: bytes) -> int:
    """CRC-32, rotated and shifted so that a checksum of data that holds checksums stays useful."""
    c = zlib.crc32(data)
    return ((c >> 15 | c << 17) + 0xA282EAD8) & 0xFFFFFFFF


def frame(payload: bytes) -> bytes:
    size = LENGTH.pack(len(payload))
    return b"".join((size, CHECK.pack(masked(size)), payload, CHECK.pack(masked(payload))))


def unframe(data: bytes) -> bytes:
    """The payload of one whole frame; fails if a checksum or the length is wrong."""
    size = data[:8]
    (n,) = LENGTH.unpack(size)
    payload = data[12 : 12 + n]
    if CHECK.unpack(data[8:12])[0] != masked(size) or len(data) != n + 16 or CHECK.unpack(data[12 + n :])[0] != masked(payload):
        raise ValueError("damaged record")
    return payload


class Encoder:
    """The tokenizers library behind a cache of words.

    The vocabulary's rules never join text across a space or line feed and drop both, and lower-case what they read,
    so a text's ids are those of its words, with A-Z lower-cased. Plain words are one piece, which the library's model
    encodes without the rules, and a run of punctuation after it is another. Texts that hold a special token's string go to the library whole, and so do all texts under another
    vocabulary than VOCABULARY, whose rules aren't known.
    """

    def __init__(self, path: str | None = None):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.by_word = path is None or os.path.basename(path) == VOCABULARY
        if path is None:
            import public_tokenizers

            path = public_tokenizers.path(VOCABULARY)
        self.lib = Tokenizer.from_file(path)
        self.piece = self.lib.model.tokenize
        self.wide = self.lib.get_vocab_size() > 65536
        self.kind = "<u4" if self.wide else "<u2"
        self.words: dict[bytes, bytes] = {}
        self.older: dict[bytes, bytes] = {}

    def plain(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, self.kind).tobytes() for e in self.lib.encode_batch_fast(texts, add_special_tokens=False)]

    def listed(self, words: list[str]) -> list[bytes]:
        """The ids of each word. Those without MARK go to the library many at a time, parted by it, as it is a piece of its own."""
        mark, out = self.plain([MARK])[0], {w: None for w in words}
        own = [w for w in out if MARK not in w]
        parts = [own[at : at + TOGETHER] for at in range(0, len(own), TOGETHER)]
        for part, data in zip(parts, self.plain([f" {MARK} ".join(p) for p in parts]), strict=True):
            ends = np.flatnonzero(np.frombuffer(data, self.kind) == np.frombuffer(mark, self.kind)[0]) * len(mark)
            starts = [0, *(ends + len(mark)).tolist()]
            out.update(zip(part, [data[i:j] for i, j in zip(starts, [*ends.tolist(), len(data)], strict=True)], strict=True))
        rest = [w for w, ids in out.items() if ids is None]
        out.update(zip(rest, self.plain(rest), strict=True))
        return [out[w] for w in words]

    def pieces(self, words: list[bytes]) -> list[bytes]:
        """The ids of words of which each is one piece under the rules."""
        ids, ends = [], [0]
        for w in words:
            ids += [t.id for t in self.piece(w.decode() if w.isascii() else w.decode("latin-1").translate(BYTE_LETTERS))]
            ends.append(len(ids))
        data, size = np.array(ids, self.kind).tobytes(), 4 if self.wide else 2
        return [data[size * a : size * b] for a, b in pairwise(ends)]

    def learn(self, words: set[bytes]) -> None:
        """Bring words into the younger generation, from the older one or by encoding them."""
        known = words & self.older.keys()
        self.words.update((w, self.older[w]) for w in known)
        stems, others, ended = set(), set(), []
        for w in words - known:
            if m := PLAIN.fullmatch(w):
                stem, mark = m.groups()
                stems.add(stem)
                if mark:
                    others.add(mark)
                    ended.append((w, stem, mark))
            else:
                others.add(w)
        new = [w for w in stems if w not in self.words]
        self.words.update(zip(new, self.pieces(new), strict=True))
        new = [w for w in others if w not in self.words]
        self.words.update(zip(new, self.listed([w.decode("utf-8", "surrogatepass") for w in new]), strict=True))
        for w, stem, mark in ended:
            self.words[w] = self.words[stem] + self.words[mark]

    def encode(self, text: str) -> bytes:
        return self.encode_many([text])[0]

    def encode_many(self, texts: list[str]) -> list[bytes]:
        """The ids of each text; the words that none of them has seen are learnt together."""
        listed = [t.encode("utf-8", "surrogatepass").lower().replace(b"\n", b" ").split(b" ") if self.by_word and "<|" not in t else None for t in texts]
        words = {*chain.from_iterable(w for w in listed if w is not None)}
        if len(self.words) > CACHED_WORDS:
            self.words, self.older = {}, self.words
        if missing := words.difference(self.words):
            self.learn(missing)
        get = self.words.__getitem__
        return [self.plain([t])[0] if w is None else b"".join(map(get, w)) for t, w in zip(texts, listed, strict=True)]


def encoded(enc: Encoder, texts: pa.Array) -> Iterator[bytes]:
    """The ids of each text, groups of texts encoded together; null texts are empty."""
    group, chars = [], 0
    for t in texts:
        group.append(t.as_py() or "")
        chars += len(group[-1])
        if len(group) == GROUP or chars > GROUP_CHARS:
            yield from enc.encode_many(group)
            group, chars = [], 0
    yield from enc.encode_many(group)


_ENCODERS: dict[str | None, Encoder] = {}


def encoder(path: str | None) -> Encoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


INDEX = {"doc_id": pa.int64(), "part": pa.int32(), "file": pa.string(), "at": pa.int64(), "bytes": pa.int64(), "n_tokens": pa.int64(), "before": pa.int64()}


def record_batch(rows: list[tuple], kinds: dict[str, pa.DataType]) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else [()] * len(kinds)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds.values(), strict=True)], list(kinds))


def write_files(docs: DataFrame, path: str, *, doc_id: str = "doc_id", text: str = "text", tokenizer: str | None = None, end_id: int = END_ID) -> DataFrame:
    """Write every text's ids and end_id to path/data in ascending id order; the index of what was written.

    One file per range of ids, named after task and attempt; only a finished attempt's rows reach the index, so a lost
    executor's half file is never read. Index: doc_id, part, file, at and bytes of the frame, n_tokens, before (ids of
    the documents before it in its file). Null texts are empty; null ids come first; repeated ids follow each other by
    a hash of the text. An empty table makes an empty index.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        enc, part, out, at, before = encoder(tokenizer), task.partitionId(), None, 0, 0
        end = np.array([end_id], enc.kind).tobytes()
        where, root = fs.FileSystem.from_uri(path)
        name = f"{root}/data/part-{part:06d}-{task.taskAttemptId()}.bin"
        try:
            for batch in batches:
                rows = []
                for i, ids in zip(batch.column(0).to_pylist(), encoded(enc, batch.column(1)), strict=True):
                    ids += end
                    data = frame(payload_of(i, enc.wide, ids))
                    if out is None:
                        where.create_dir(f"{root}/data", recursive=True)
                        out = where.open_output_stream(name)
                    out.write(data)
                    n = len(ids) // len(end)
                    rows.append((i, part, name, at, len(data), n, before))
                    at, before = at + len(data), before + n
                yield record_batch(rows, INDEX)
        finally:
            if out is not None:
                out.close()

    rows = docs.select(col(doc_id).cast("long").alias("doc_id"), col(text).alias("text"))
    ordered = rows.repartitionByRange("doc_id", F.xxhash64("text")).sortWithinPartitions("doc_id", F.xxhash64("text"))  # one id may fill several files
    schema = "doc_id long, part int, file string, at long, bytes long, n_tokens long, before long"
    return stored(ordered.mapInArrow(run, schema), "token-index", f"{path}/index")


def payload_of(doc: int | None, wide: bool, ids: bytes) -> bytes:
    return DOC.pack(NO_ID if doc is None else doc, wide) + ids


def read_ids(payload: bytes) -> tuple[int | None, np.ndarray]:
    """(doc_id, ids as little-endian unsigned 32-bit integers) of a payload."""
    doc, wide = DOC.unpack_from(payload)
    return None if doc == NO_ID else doc, np.frombuffer(payload, "<u4" if wide else "<u2", offset=DOC.size).astype("<u4")


def read_files(index: DataFrame, path: str, *, with_ids: bool = False) -> DataFrame:
    """The records that index rows (in any order) point to: doc_id, part, before, n_tokens, ids_crc32, ids if asked for."""
    schema = "doc_id long, part int, before long, n_tokens long, ids_crc32 long" + ", ids array<long>" * with_ids
    kinds = {"doc_id": pa.int64(), "part": pa.int32(), "before": pa.int64(), "n_tokens": pa.int64(), "ids_crc32": pa.int64()} | ({"ids": pa.list_(pa.int64())} if with_ids else {})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where, _ = fs.FileSystem.from_uri(path)
        name, file = None, None
        for batch in batches:
            rows = []
            for doc, part, of, at, size, n, before in zip(*(batch.column(c).to_pylist() for c in INDEX), strict=True):
                if of != name:
                    if file:
                        file.close()
                    name, file = of, where.open_input_file(of)
                found, ids = read_ids(unframe(file.read_at(size, at)))
                if found != doc or len(ids) != n:
                    raise ValueError(f"the index doesn't fit {of} at {at}")
                rows.append((found, part, before, len(ids), zlib.crc32(ids.tobytes()), *[ids] * with_ids))
            yield record_batch(rows, kinds)

    return index.select(*INDEX).mapInArrow(run, schema)


def with_starts(rows: DataFrame, index: DataFrame) -> DataFrame:
    """rows with `start`, the ids of all documents before: sums of files, of which one row each meets in a task."""
    sums = index.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    ahead = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    first = sums.select("part", F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("first"))
    return rows.join(first, "part").withColumn("start", F.col("first") + F.col("before")).drop("first")


def write_and_read(docs: DataFrame, **options) -> DataFrame:
    """Write the token files of docs in the shared folder and read every record back: doc_id, start, n_tokens, ids_crc32."""
    path = new_path(docs.sparkSession, "tokens")
    index = write_files(docs, path, **options)
    return with_starts(read_files(index, path), index).select("doc_id", "start", "n_tokens", "ids_crc32")
