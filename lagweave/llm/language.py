"""Language ID by error-correcting output codes over binary n-gram classifiers."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import col, id_remainder, packed

DIMS = 4096
ORDERS = (1, 2, 3)
#: Bound of the training sample: about this many labelled documents in all, shared evenly by the languages.
SAMPLE = 3000
#: Languages a code is made for; more distinct labels than this are an error.
MOST_LANGUAGES = 512
CHUNK = 1 << 20
HASHES = (np.uint32(0x9E3779B1), np.uint32(0x85EBCA77), np.uint32(0xC2B2AE3D))


def characters(text: str) -> np.ndarray:
    """Code points, lower-cased; every ASCII character but a letter becomes a space."""
    c = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    plain = (c < 128) & ~((c >= 97) & (c <= 122))
    return np.where(plain, np.uint32(32), c)


def counts(text: str) -> np.ndarray:
    """Hashed counts of the character n-grams of a whole text, a chunk at a time."""
    total = np.zeros(DIMS, np.int64)
    tail = np.array([32], np.uint32)
    most = max(ORDERS)
    for at in range(0, len(text), CHUNK):
        c = np.concatenate([tail, characters(text[at : at + CHUNK])])
        if at + CHUNK >= len(text):
            c = np.append(c, np.uint32(32))
        c = c[np.append(True, (c[1:] != 32) | (c[:-1] != 32))]  # runs of spaces count as one
        new = len(tail) if at else 0
        for order in ORDERS:
            first = max(0, new - order + 1)  # n-grams that end in this chunk
            h = np.full(max(0, len(c) - first - order + 1), order, np.uint32)
            for k in range(order):
                h = h * HASHES[k] + c[first + k : first + k + len(h)]
            h ^= h >> np.uint32(15)
            h *= HASHES[1]
            total += np.bincount(h >> np.uint32(20), minlength=DIMS)
        tail = c[-(most - 1) :]
    return total


def features(text: str) -> np.ndarray:
    """Square roots of n-gram frequencies: a vector of length 1."""
    n = counts(text)
    return np.sqrt(n / max(1, n.sum())).astype(np.float32)


def codewords(languages: int, seed: int = 7) -> np.ndarray:
    """Rows of +1 and -1, far apart: all dichotomies up to 5 languages, else the best of some random codes."""
    if languages <= 1:
        return np.zeros((languages, 0), np.int8)
    if languages <= 5:
        columns = range(1, 2 ** (languages - 1))
        return np.array([[1 if k == 0 or not c >> (k - 1) & 1 else -1 for c in columns] for k in range(languages)], np.int8)
    bits, rng, best, code = math.ceil(10 * math.log2(languages)), np.random.default_rng(seed), -1, None
    for _ in range(200):
        x = rng.choice(np.array([-1, 1], np.int8), (languages, bits))
        x[:, np.abs(x.sum(axis=0)) == languages] *= np.where(np.arange(languages) % 2, 1, -1)[:, None].astype(np.int8)
        apart = (bits - x.astype(int) @ x.T.astype(int)) // 2
        if (least := (apart + bits * np.eye(languages, dtype=int)).min()) > best:
            best, code = least, x
    return code


@dataclass
class Model:
    """languages, their codewords, a linear classifier per bit, and how well each bit serves each language."""

    languages: list[str]
    code: np.ndarray
    weights: np.ndarray
    bias: np.ndarray
    trust: np.ndarray

    def decode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(index of the nearest codeword, score, whether the two nearest are about as near) of each row."""
        if len(self.languages) == 1:
            return np.zeros(len(x), int), np.ones(len(x)), np.zeros(len(x), bool)
        f = x @ self.weights + self.bias
        loss = np.logaddexp(0, -f[:, None, :] * self.code[None]) / math.log(2)
        far = (loss * self.trust[None]).sum(axis=2)
        order = np.sort(far, axis=1)
        p = np.exp(-(far - order[:, :1]) * max(1.0, self.code.shape[1] / 2))
        gap = order[:, 1] - order[:, 0]
        return far.argmin(axis=1), 1 / p.sum(axis=1), gap < 0.05


def train(x: np.ndarray, y: np.ndarray, languages: list[str], rounds: int = 150, decay: float = 1e-5) -> Model:
    """Logistic classifiers of the code's bits by accelerated gradient descent; every language weighs the same."""
    code = codewords(len(languages))
    if not code.shape[1]:
        return Model(languages, code, np.zeros((DIMS, 0), np.float32), np.zeros(0, np.float32), np.zeros((len(languages), 0)))
    target = code[y].astype(np.float32)
    share = (1 / np.maximum(1, np.bincount(y, minlength=len(languages))))[y].astype(np.float32)
    share /= share.sum()
    w, b = np.zeros((DIMS, code.shape[1]), np.float32), np.zeros(code.shape[1], np.float32)
    vw, vb, rate = np.zeros_like(w), np.zeros_like(b), 4.0
    scale = np.float32(8.0)  # rows have length 1, so a larger input scale speeds the descent
    for _ in range(rounds):
        f = (x @ (w + 0.9 * vw)) * scale + b + 0.9 * vb
        g = -target / (1 + np.exp(np.clip(target * f, -30, 30))) * share[:, None]
        vw = 0.9 * vw - rate * ((x.T @ g) * scale + decay * w)
        vb = 0.9 * vb - rate * g.sum(axis=0)
        w, b = w + vw, b + vb
    right = ((x @ w) * scale + b) * target > 0
    trust = np.array([[(right[y == k, j].sum() + 1) / ((y == k).sum() + 2) for j in range(code.shape[1])] for k in range(len(languages))])
    return Model(languages, code, w * scale, b, trust / trust.sum(axis=1, keepdims=True))


def fit(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", held_out: Column | None = None, sample: int = SAMPLE) -> Model:
    """Train on labelled rows that aren't held out: about `sample` of them by a hash of the id, as many of each language."""
    rows = docs.filter(col(lang).isNotNull() & F.coalesce(col(text).rlike(r"\p{L}"), F.lit(False)))
    if held_out is not None:
        rows = rows.filter(~held_out)
    known = rows.groupBy(col(lang).alias("lang")).agg(F.count("*").alias("n")).limit(MOST_LANGUAGES + 1).collect()
    if len(known) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages")
    languages = sorted(r["lang"] for r in known)
    if not languages:
        return Model([], codewords(0), np.zeros((DIMS, 0), np.float32), np.zeros(0, np.float32), np.zeros((0, 0)))
    if len(languages) == 1:
        return train(np.zeros((0, DIMS), np.float32), np.zeros(0, int), languages)
    each = max(1, sample // len(languages))
    share = F.create_map(*[v for r in known for v in (F.lit(r["lang"]), F.lit(min(1.0, each / r["n"])))])
    draw = F.pmod(F.xxhash64(F.lit("language"), col(doc_id)), F.lit(1 << 30)) / (1 << 30)
    chosen = rows.filter(draw < share[col(lang)]).select(col(lang).alias("lang"), col(text).alias("text"))

    def sparse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, value = [], []
            for t in batch.column(1):
                v = features(t.as_py())
                at.append(i := np.flatnonzero(v).astype(np.int16))
                value.append(v[i].astype(np.float16).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([a.tobytes() for a in at], pa.binary()), pa.array(value, pa.binary())], ["lang", "at", "value"])

    got = chosen.mapInArrow(sparse, "lang string, at binary, value binary").collect()
    x = np.zeros((len(got), DIMS), np.float32)
    for row, r in zip(x, got, strict=True):
        row[np.frombuffer(r["at"], np.int16)] = np.frombuffer(r["value"], np.float16)
    place = {name: k for k, name in enumerate(languages)}
    order = sorted(range(len(got)), key=lambda i: (got[i]["lang"], got[i]["at"], got[i]["value"]))  # the same sums in any arrival order
    return train(x[order], np.array([place[got[i]["lang"]] for i in order], int), languages)


def predict(docs: DataFrame, model: Model, *, text: str = "text", keep: Column | None = None) -> DataFrame:
    """(row, lang_pred, score, ambiguous) of every row; row is `keep`, or all columns as a struct.

    A null text, one without a letter, and any text when nothing was learned give und with score 0, not ambiguous.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # languages x code bits and 4,096 x code bits numbers
    rows = docs.select((keep if keep is not None else packed(docs)).alias("row"), F.when(col(text).rlike(r"\p{L}"), col(text)).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        names = np.array([*m.languages, "und"], object)
        for batch in batches:
            at = [i for i, v in enumerate(batch.column(1).is_valid().to_pylist()) if v] if m.languages else []
            best, score, unsure = np.full(batch.num_rows, len(m.languages)), np.zeros(batch.num_rows), np.zeros(batch.num_rows, bool)
            for k in range(0, len(at), 256):
                part = at[k : k + 256]
                best[part], score[part], unsure[part] = m.decode(np.stack([features(batch.column(1)[i].as_py()) for i in part]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(names[best], pa.string()), pa.array(score), pa.array(unsure)], ["row", "lang_pred", "score", "ambiguous"])

    schema = T.StructType([rows.schema["row"], *T.StructType.fromDDL("lang_pred string, score double, ambiguous boolean")])
    return rows.mapInArrow(run, schema)


def identify(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", mod: int = 4, out: int = 2, sample: int = SAMPLE) -> DataFrame:
    """Learn from the labelled rows whose crc32(id) mod `mod` isn't `out` and predict every row.

    Returns doc_id, held_out, lang_pred, score (0 to 1), ambiguous (two codewords about as near). Whole texts are read,
    in chunks when very long. Repeated rows get equal predictions; an empty table gives an empty result.
    """
    held = id_remainder(col(doc_id), mod) == out
    model = fit(docs, doc_id=doc_id, text=text, lang=lang, held_out=held, sample=sample)
    found = predict(docs, model, text=text, keep=F.struct(col(doc_id).alias("doc_id"), held.alias("held_out")))
    return found.select("row.doc_id", "row.held_out", "lang_pred", "score", "ambiguous")


def keep_identified(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", sample: int = SAMPLE) -> DataFrame:
    """docs without the rows whose language can't be told: und, or ambiguous. Columns unchanged.

    With no labelled row there is nothing to tell languages by, and only texts without letters go.
    """
    model = fit(docs, doc_id=doc_id, text=text, lang=lang, sample=sample)
    if not model.languages:
        return docs.filter(col(text).rlike(r"\p{L}"))
    return predict(docs, model, text=text).filter("lang_pred <> 'und' and not ambiguous").select("row.*")
