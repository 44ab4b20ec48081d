"""Unigram token counts: distinct words share a trie, and forward scores are computed once per shared prefix."""

from __future__ import annotations

import math
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import col
from .simhash import word_chunks

PIECES = "piece_bpe_32k.model"
#: Log-probability below that of the rarest piece which a character outside the vocabulary costs.
UNKNOWN = 10.0
#: Words of more characters go through the trie path by path, shorter ones depth by depth.
LONG = 48
#: Words that are laid out at once, and words in the younger of the cache's two generations.
WORDS_AT_ONCE, CACHED_WORDS = 32_768, 500_000
BASE = 0x9E3779B97F4A7C15 | 1


def pieces_of(path: str | None = None) -> dict[str, float]:
    """Log-probabilities of a public vocabulary's pieces by the Zipf rule: the piece of rank r has 1/(r + 2).

    The file ranks its pieces; control, unknown and byte pieces are left out.
    """
    from sentencepiece import SentencePieceProcessor

    if path is None:
        import public_tokenizers

        path = public_tokenizers.path(PIECES)
    sp = SentencePieceProcessor(model_file=path)
    names = [sp.id_to_piece(i) for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]
    return {p: -math.log(r + 2) for r, p in enumerate(names)}


class Unigram:
    """Best segmentations of words by a unigram model over pieces; characters outside count as their UTF-8 bytes."""

    def __init__(self, pieces: dict[str, float]):
        self.pieces = pieces
        self.most = max(map(len, pieces), default=1)
        self.unknown = min(pieces.values(), default=0.0) - UNKNOWN
        hashes = np.array([self.hash(p) for p in pieces], np.uint64)
        order = np.argsort(hashes)
        self.hashes, self.scores = hashes[order], np.array([*pieces.values()])[order]
        self.power = np.array([pow(BASE, k, 2**64) for k in range(self.most + 1)], np.uint64)
        self.cache: dict[bytes, int] = {}
        self.older: dict[bytes, int] = {}

    @staticmethod
    def hash(piece: str) -> int:
        h = 0
        for c in piece:
            h = (h * BASE + ord(c) + 1) % 2**64
        return h

    def one(self, word: str) -> int:
        """Tokens of the best segmentation of one word; of equal scores the one with the longer last piece."""
        return self.paths([word])[0]

    def paths(self, words: list[str]) -> list[int]:
        """Tokens of each of the words, which are sorted: the scores along a prefix that a word shares with the one before stay."""
        out, path = [], ""
        best, tokens = [0.0], [0]
        for word in words:
            shared = len(os.path.commonprefix((path, word)))
            del best[shared + 1 :], tokens[shared + 1 :]
            for p in range(shared + 1, len(word) + 1):
                top, n = -math.inf, 0
                for k in range(min(p, self.most), 0, -1):
                    piece = word[p - k : p]
                    score = self.pieces.get(piece)
                    if score is None and k == 1:
                        score, more = self.unknown, len(piece.encode("utf-8", "surrogatepass"))
                    else:
                        more = 1
                    if score is not None and best[p - k] + score > top:
                        top, n = best[p - k] + score, tokens[p - k] + more
                best.append(top)
                tokens.append(n)
            out.append(tokens[-1])
            path = word
        return out

    def many(self, words: list[str]) -> np.ndarray:
        """Tokens of each of the words, which are sorted, distinct and at most LONG characters long.

        Sorted words are a trie's paths: a prefix that a word shares with the word before it is the same node. Depth by
        depth, every new node takes the best over the pieces that end in it; a word's count is that of its last node.
        """
        size = np.array([len(w) for w in words])
        chars = np.zeros((len(words), size.max(initial=0)), np.uint64)
        chars[np.arange(chars.shape[1]) < size[:, None]] = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32)
        shared = np.zeros(len(words), int)
        shared[1:] = (np.cumprod(chars[1:] == chars[:-1], axis=1)).sum(axis=1)
        np.minimum(shared[1:], np.minimum(size[1:], size[:-1]), out=shared[1:])
        prefix = np.zeros((len(words), chars.shape[1] + 1), np.uint64)
        wide = np.ones_like(chars, np.int64)
        for limit in (0x7F, 0x7FF, 0xFFFF):
            wide += chars > limit
        for p in range(chars.shape[1]):
            prefix[:, p + 1] = prefix[:, p] * np.uint64(BASE) + chars[:, p] + np.uint64(1)
        node = np.zeros((chars.shape[1] + 1, len(words)), np.int64)  # by depth and word; the root is node 0 of depth 0
        best, tokens, out = [np.zeros(1)], [np.zeros(1, np.int64)], np.zeros(len(words), np.int64)
        for p in range(1, chars.shape[1] + 1):
            fresh = (size >= p) & (shared < p)
            node[p] = np.cumsum(fresh) - 1
            rows = np.flatnonzero(fresh)
            top, n = np.full(len(rows), -np.inf), np.zeros(len(rows), np.int64)
            for k in range(min(p, self.most), 0, -1):
                h = prefix[rows, p] - prefix[rows, p - k] * self.power[k]
                at = np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)
                known = self.hashes[at] == h
                score, more = np.where(known, self.scores[at], self.unknown if k == 1 else -np.inf), 1
                if k == 1:
                    more = np.where(known, 1, wide[rows, p - 1])
                before = node[p - k, rows]
                total = best[p - k][before] + score
                better = total > top
                top, n = np.where(better, total, top), np.where(better, tokens[p - k][before] + more, n)
            best.append(top)
            tokens.append(n)
            ends = np.flatnonzero(size == p)
            out[ends] = n[node[p, ends]]
        return out

    def learn(self, new: set[bytes]) -> None:
        """Count the tokens of words that aren't in the cache; a word begins with the piece mark of a space."""
        named = sorted(("▁" + w.decode("utf-8", "surrogatepass"), w) for w in new)
        short = [x for x in named if len(x[0]) <= LONG]
        for i in range(0, len(short), WORDS_AT_ONCE):
            part = short[i : i + WORDS_AT_ONCE]
            self.cache.update(zip((w for _, w in part), self.many([s for s, _ in part]).tolist(), strict=True))
        long = [x for x in named if len(x[0]) > LONG]
        self.cache.update(zip((w for _, w in long), self.paths([s for s, _ in long]), strict=True))

    def count(self, texts: list[str | None]) -> list[tuple[int, int]]:
        """(words, tokens) of each whole text, a few megabytes of words at a time."""
        out, held, weight = [[0, 0] for _ in texts], [], 0

        def settle() -> None:
            if len(self.cache) > CACHED_WORDS:
                self.cache, self.older = {}, self.cache
            if new := set().union(*(w for _, w in held)) - self.cache.keys():
                known = new & self.older.keys()
                self.cache.update((w, self.older[w]) for w in known)
                self.learn(new - known)
            for i, words in held:
                out[i][0] += len(words)
                out[i][1] += sum(map(self.cache.__getitem__, words))
            held.clear()

        for i, text in enumerate(texts):
            for words in word_chunks((text or "").encode("utf-8", "surrogatepass")):
                held.append((i, words))
                weight += len(words)
                if weight > 500_000:
                    settle()
                    weight = 0
        settle()
        return [(w, t) for w, t in out]


_MODELS: dict[str | None, Unigram] = {}


def model(path: str | None = None) -> Unigram:
    if path not in _MODELS:
        _MODELS[path] = Unigram(pieces_of(path))
    return _MODELS[path]


def token_counts(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", vocabulary: str | None = None) -> DataFrame:
    """Every row's doc_id, n_words and n_tokens under a unigram model over a public vocabulary's pieces.

    Words are runs without ASCII white space, case kept; each is marked as after a space and segmented on its own. Null
    and wordless texts have 0 of both. Rows are independent, so repeated rows, ties and hot groups move nothing;
    a word's count doesn't depend on which words it is counted with. Empty tables give empty results.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model(vocabulary)
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                n = m.count(part.column(1).to_pylist())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([w for w, _ in n], pa.int64()), pa.array([t for _, t in n], pa.int64())], ["doc_id", "n_words", "n_tokens"])

    rows = docs.select(col(doc_id).cast("long").alias("doc_id"), col(text).alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_words long, n_tokens long")
