"""Secret scans: three fixed patterns, and sliding-window entropy per character class (DataFrame functions only)."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import col

ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
#: A run too short to count can't hold a longer one, so the lengths asked for stand in the patterns.
ACCESS = "AKIA[A-Z0-9]{12,}"
HEX = "[0-9a-f]{32,}"
BLOCK = 256


@dataclass(frozen=True)
class EntropyClass:
    """Candidates are runs that `pattern` finds; windows of `width` characters count those of `alphabet`.

    A window is hot from `bits` of Shannon entropy on. Candidates that `allow` matches whole are left alone, and so are
    the windows in which `phrase` is found.
    """

    kind: str
    pattern: str
    alphabet: str
    lower: bool
    width: int
    bits: float
    allow: str
    phrase: str


CLASSES = (
    EntropyClass("entropy_hex", "[0-9A-Fa-f]{24,}", "0123456789abcdef", True, 20, 2.9, r"[0-9]+|[A-Fa-f]+|(.{1,8})\1+", "0123456789|12345678|abcdef01|deadbeef"),
    EntropyClass("entropy_base64", "[A-Za-z0-9+/_-]{20,}={0,2}", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_-=", False, 20, 3.9, r"[A-Za-z]?[a-z]+|[A-Z]+|[0-9_/+-]+|[A-Za-z]+(?:[_/-][A-Za-z]++)++|[0-9a-fA-F]{8}-(?:[0-9a-fA-F]{4}-){3}[0-9a-fA-F]{12}", "(?i)example|abcdefghij|0123456789"),
)


def prefix_sums(lengths: Column) -> Column:
    """Sums of all elements before each one, from the sums of blocks, the sums of those and so on: near linear."""
    add = lambda a: F.aggregate(a, F.lit(0), lambda s, x: s + x)

    def cut(a: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.floor((F.size(a) - 1) / BLOCK).cast("int")), lambda b: F.slice(a, b * BLOCK + 1, BLOCK))

    def within(blocks: Column, before: Column) -> Column:
        """The sums before each element, given those before each block."""
        return F.flatten(F.zip_with(blocks, before, lambda block, first: F.transform(block, lambda x, i: first + add(F.slice(block, F.lit(1), i)))))

    def bound(value: Column, use) -> Column:
        return F.element_at(F.transform(F.array(value), use), 1)

    def outer(blocks: Column) -> Column:
        wide = lambda sums: bound(cut(sums), lambda w: within(w, bound(F.transform(w, add), lambda t: F.transform(t, lambda x, i: add(F.slice(t, F.lit(1), i))))))
        return bound(bound(F.transform(blocks, add), wide), lambda before: within(blocks, before))

    return bound(cut(lengths), outer)


def places(text: Column, pattern: str, group: int = 0) -> Column:
    """array<start, end, part> of the leftmost non-overlapping matches, in code points; part is the group's text.

    split() leaves the text between the matches that regexp_extract_all() returns; their lengths give the places.
    """
    kind = "array<struct<start:int,end:int,part:string>>"
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    parts = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else found
    between = F.transform(F.slice(F.split(text, pattern, -1), F.lit(1), F.size(found)), F.length)
    lengths = F.transform(found, F.length)
    starts = F.zip_with(prefix_sums(F.zip_with(between, lengths, lambda a, b: a + b)), between, lambda a, b: a + b)
    spans = F.zip_with(F.arrays_zip(starts.alias("s"), lengths.alias("n")), parts, lambda x, p: F.struct(x["s"].alias("start"), (x["s"] + x["n"]).alias("end"), p.alias("part")))
    return F.when(text.rlike(pattern), spans.cast(kind)).otherwise(F.array().cast(kind))


def hot_spans(word: Column, c: EntropyClass) -> Column:
    """array<start, end> of the joined hot windows of one candidate.

    Entropy is log2(width) - sum(n log2 n) / width over the counts n of the window's characters. The sum is kept in
    whole millionths; the character that enters and the one that leaves change one count each.
    """
    term = [round(n * math.log2(n) * 1e6) if n else 0 for n in range(c.width + 3)]
    limit = math.floor(c.width * (math.log2(c.width) - c.bits) * 1e6)
    terms, size = F.array(*[F.lit(t) for t in term]), len(c.alphabet)
    chars = F.split(F.lower(word) if c.lower else word, "")
    codes = F.transform(F.filter(chars, lambda x: x != ""), lambda x: F.instr(F.lit(c.alphabet), x))
    zero = F.struct(
        F.array_repeat(F.lit(0), size).alias("counts"), F.lit(0).alias("sum"), F.lit(-1).alias("first"), F.lit(-1).alias("last"), F.array().cast("array<struct<start:int,end:int>>").alias("done")
    )

    allowed = word.rlike(c.phrase)

    def step(codes: Column, acc: Column, i: Column) -> Column:
        new = F.element_at(codes, i)
        old = F.when(i > c.width, F.element_at(codes, F.greatest(i - c.width, F.lit(1)))).otherwise(0)
        n = F.element_at(acc["counts"], new)
        m = F.when(i > c.width, F.element_at(acc["counts"], F.greatest(old, F.lit(1))) + F.when(old == new, 1).otherwise(0)).otherwise(1)
        total = acc["sum"] + F.element_at(terms, n + 2) - F.element_at(terms, n + 1) + F.when(i > c.width, F.element_at(terms, m) - F.element_at(terms, m + 1)).otherwise(0)
        counts = F.transform(acc["counts"], lambda x, k: x + F.when(k + 1 == new, 1).otherwise(0) - F.when(k + 1 == old, 1).otherwise(0))
        hot = (i >= c.width) & (total <= limit) & ~(allowed & F.substring(word, i - c.width + 1, F.lit(c.width)).rlike(c.phrase))
        joins = hot & (acc["last"] >= i - c.width)
        opens = hot & ~joins
        done = F.when(opens & (acc["last"] >= 0), F.array_append(acc["done"], F.struct(acc["first"].alias("start"), acc["last"].alias("end")))).otherwise(acc["done"])
        return F.struct(counts.alias("counts"), total.alias("sum"), F.when(opens, i - c.width).otherwise(acc["first"]).alias("first"), F.when(hot, i).otherwise(acc["last"]).alias("last"), done.alias("done"))

    def finish(acc: Column) -> Column:
        return F.when(acc["last"] >= 0, F.array_append(acc["done"], F.struct(acc["first"].alias("start"), acc["last"].alias("end")))).otherwise(acc["done"])

    one = F.transform(F.array(codes), lambda cs: F.aggregate(F.sequence(F.lit(1), F.size(cs)), zero, lambda acc, i: step(cs, acc, i), finish))
    return F.element_at(one, 1)


def marked(spans: Column, kind: str, order: int) -> Column:
    return F.transform(spans, lambda x: F.struct(x["start"].alias("start"), F.lit(order).alias("order"), x["end"].alias("end"), F.lit(kind).alias("kind")))


def entropy_spans(text: Column, c: EntropyClass, order: int) -> Column:
    allowed = lambda x: x["part"].rlike(f"^(?:{c.allow})$")
    kept = F.filter(places(text, c.pattern), lambda x: ~allowed(x))
    spans = F.flatten(F.transform(kept, lambda x: F.transform(hot_spans(x["part"], c), lambda s: F.struct((x["start"] + s["start"]).alias("start"), (x["start"] + s["end"]).alias("end")))))
    return F.when(text.rlike(c.pattern), marked(spans, c.kind, order)).otherwise(F.array().cast("array<struct<start:int,order:int,end:int,kind:string>>"))


def joined(spans: Column) -> Column:
    return F.array_join(F.transform(F.array_sort(spans), lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def scan(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Every row's doc_id and `found`: array<start, order, end, kind>, code points with exclusive ends.

    Kinds: assign, access and hex by pattern (leftmost matches, short ones dropped), entropy_hex and entropy_base64 by
    windows. Null texts are empty. Nothing moves between rows, so hot groups and repeated rows make no difference;
    long texts are read whole.
    """
    rows = docs.select(col(doc_id).alias("doc_id"), F.coalesce(col(text), F.lit("")).alias("text"))
    t = F.col("text")
    assign = F.filter(places(t, ASSIGN, 2), lambda x: F.length(x["part"]) >= 8)
    base = [marked(s, kind, i) for i, (kind, s) in enumerate((("assign", assign), ("access", places(t, ACCESS)), ("hex", places(t, HEX))))]
    more = [entropy_spans(t, c, len(base) + i) for i, c in enumerate(CLASSES)]
    return rows.select("doc_id", F.concat(*base, *more).alias("found"))


def secrets(docs: DataFrame, **names) -> DataFrame:
    """One row per row of docs: doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_entropy."""
    found = scan(docs, **names)
    count = lambda *kinds: F.size(F.filter("found", lambda x: x["kind"].isin(*kinds))).cast("long")
    base = F.filter("found", lambda x: x["order"] < 3)
    return found.select(
        "doc_id", count("assign").alias("n_assign"), count("access").alias("n_access"), count("hex").alias("n_hex"),
        F.sha2(joined(base).cast("binary"), 256).alias("base_sha256"), joined(F.col("found")).alias("spans"), count(*[c.kind for c in CLASSES]).alias("n_entropy"),
    )
