"""Benchmark decontamination by a positional inverted index (DataFrame functions only)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import col, forget, lower_ascii, packed, stored

#: Runs of digits, letters and all characters beyond ASCII.
TOKEN = r"[0-9A-Za-z\x{80}-\x{10FFFF}]++"
#: A benchmark-side table of at most this many characters is broadcast; a larger one is joined by a shuffle.
BROADCAST_CHARS = 16_000_000


def tokens(text: Column) -> Column:
    """The words of a text, A-Z lower-cased; null has none (an array without elements)."""
    found = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(TOKEN), F.lit(0))
    return F.transform(found, lower_ascii)


def tokenised(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """(doc_id, tid, w), stored: the words of every row, which the counts, the postings and the results all read."""
    return stored(docs.select(col(doc_id).alias("doc_id"), F.xxhash64(col(text)).alias("tid"), tokens(col(text)).alias("w")), "index-tokens")


def fits(df: DataFrame, *measured: str) -> bool:
    """Whether the measured string columns of df hold few enough characters for a broadcast."""
    chars = sum((F.coalesce(F.length(c), F.lit(0)) + 32 for c in measured), F.lit(0))
    return (df.agg(F.sum(chars)).first()[0] or 0) <= BROADCAST_CHARS


def small(df: DataFrame, *measured: str) -> DataFrame:
    """df, marked for broadcast if it fits."""
    return F.broadcast(df) if fits(df, *measured) else df


def windows_of(items: DataFrame, item_id: str, text: str, n: int) -> DataFrame:
    """(item_id, win, size): every run of n item words, joined by spaces; an item of fewer words, but not none, is one."""
    words = items.select(col(item_id).alias("item_id"), tokens(col(text)).alias("w")).filter(F.size("w") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.lit(1), F.size("w") - (n - 1)))
    wins = words.select("item_id", "w", F.explode(starts).alias("i")).select("item_id", F.slice("w", F.col("i"), F.lit(n)).alias("words"))
    return wins.select("item_id", F.array_join("words", " ").alias("win"), F.size("words").alias("size")).distinct()


class Index:
    """Postings of the training tokens that the windows ask for, with the plan of the windows' intersections.

    probes: wid (a hash of win), win, size, off1, term1, off2, term2: the two rarest words of each window all of whose
    words occur, the earlier place first where a word is repeated; term2 is null in a window of one word.
    close: win, term, need: the words by which proximity matches of each window are found, and how many must be met.
    postings: doc_id, tid, term, pos, first, around: the places of these words; around holds the tokens up to n - 1
    before and after, joined by spaces (the first of them at place `first`), where the word is a longer window's rarest
    or asked for by close.
    """

    def __init__(self, probes: DataFrame, close: DataFrame | None, postings: DataFrame):
        self.probes, self.close, self.postings = probes, close, postings


def build_index(rows: DataFrame, wins: DataFrame, n: int, near: float | None = 0.8) -> Index:
    """The index of tokenised rows for exact matches and, unless near is None, for proximity matches.

    Of a window's m distinct words at least k = ceil(near * m) are to be met, so one of any m - k + 1 is: the rarest ones
    are asked for, words that no document has among them. All asked for absent: no match is possible.
    """
    places = wins.select("win", "size").distinct().select("win", "size", F.posexplode(F.split("win", " ")).alias("off", "term"))
    places = stored(places, "index-places")
    vocabulary = small(places.select("term").distinct(), "term")
    counts = rows.select(F.explode("w").alias("term")).join(vocabulary, "term").groupBy("term").agg(F.count("*").alias("n"))
    counts = stored(counts, "index-counts")
    rarity = F.struct(F.coalesce("n", F.lit(0)).alias("n"), "off", "term")
    by_rarity = stored(places.join(counts, "term", "left").groupBy("win", "size").agg(F.array_sort(F.collect_list(rarity)).alias("p")), "index-rarity")
    whole = by_rarity.filter(F.element_at("p", 1)["n"] > 0)  # a window with a word that no document has can't occur
    probes = whole.select(F.xxhash64("win").alias("wid"), "win", "size", F.element_at("p", 1).alias("a"), F.when(F.size("p") > 1, F.try_element_at("p", F.lit(2))).alias("b"))
    probes = stored(probes.select("wid", "win", "size", F.col("a.off").alias("off1"), F.col("a.term").alias("term1"), F.col("b.off").alias("off2"), F.col("b.term").alias("term2")), "index-probes")
    wide = F.col("size") > 1  # the place of a window of one word says all
    asked, close = probes.select(F.explode_outer(F.array(F.struct(F.col("term1").alias("term"), wide.alias("wide")), F.struct(F.col("term2").alias("term"), F.lit(False).alias("wide")))).alias("x")).select("x.*"), None
    if near is not None:
        m = F.size("words")
        close = by_rarity.select("win", "size", F.array_distinct(F.transform("p", lambda x: x["term"])).alias("words")).withColumn("need", F.greatest(F.lit(1), F.ceil(m * near - 1e-9)).cast("int"))
        close = stored(close.select("win", "size", "need", F.explode(F.slice("words", F.lit(1), m - F.col("need") + 1)).alias("term")), "index-close")
        asked = asked.union(close.select("term", wide))
    asked = stored(asked.filter("term is not null").groupBy("term").agg(F.max("wide").alias("wide")), "index-asked")
    postings = stored(found_places(rows, asked, n), "index-postings")
    forget(asked)
    forget(places, counts, by_rarity)
    return Index(probes, close, postings)


#: Words of a stretch of a document from which the words around a place are cut, where places and documents are shuffled.
STRETCH = 512


def found_places(rows: DataFrame, asked: DataFrame, n: int) -> DataFrame:
    """doc_id, tid, term, pos, first, around: the places of the words asked for; around is null where it isn't asked for.

    While the words can be broadcast, a document's places are found, and what is around them cut, within its row. Beyond
    that, only (doc_id, tid, pos, term) of each word is shuffled to the word; the places found then meet the stretch
    of their document that holds all around them, so no row carries more than a stretch and no document is copied.
    """
    first = F.greatest(F.col("pos") - (n - 1), F.lit(0))
    wide = F.col("wide")
    if fits(asked, "term"):
        found = rows.select("doc_id", "tid", "w", F.posexplode("w").alias("pos", "term")).join(F.broadcast(asked), "term")
        around = F.array_join(F.slice("w", first + 1, F.col("pos") - first + n), " ")  # no lambda: it would copy w for each place
        return found.select("doc_id", "tid", "term", "pos", first.alias("first"), F.when(wide, around).alias("around"))
    found = rows.select("doc_id", "tid", F.posexplode("w").alias("pos", "term")).join(asked, "term")
    found = stored(found.select("doc_id", "tid", "term", "pos", first.alias("first"), "wide").distinct(), "index-places-found")
    cut = F.floor(F.col("pos") / STRETCH).cast("int")
    begin = F.greatest(F.lit(0), F.col("cut") * STRETCH - (n - 1))
    end = F.col("cut") * STRETCH + STRETCH + n - 1
    parts = rows.filter(F.size("w") > 0).select("doc_id", "tid", "w", F.explode(F.sequence(F.lit(0), F.floor((F.size("w") - 1) / STRETCH).cast("int"))).alias("cut"))
    parts = parts.select("doc_id", "tid", "cut", begin.alias("begin"), F.slice("w", begin + 1, end - begin).alias("part"))
    parts = parts.groupBy("doc_id", "tid", "cut").agg(F.first("begin").alias("begin"), F.first("part").alias("part"))  # repeated rows are one document
    x, y = found.filter("wide").withColumn("cut", cut).alias("x"), parts.alias("y")
    met = x.join(y, F.col("x.doc_id").eqNullSafe(F.col("y.doc_id")) & (F.col("x.tid") == F.col("y.tid")) & (F.col("x.cut") == F.col("y.cut")))
    around = F.array_join(F.slice("part", F.col("first") - F.col("begin") + 1, F.col("pos") - F.col("first") + n), " ")
    met = met.select("x.doc_id", "x.tid", "term", "pos", "first", around.alias("around"))
    return met.union(found.filter("not wide").select("doc_id", "tid", "term", "pos", "first", F.lit(None).cast("string")))


def search(index: Index, n: int) -> tuple[DataFrame, DataFrame | None]:
    """(exact, close): occurrences (doc_id, tid, win, start, size) and proximity matches (doc_id, tid, win).

    The list of a window's rarest word and that of its second rarest, each shifted by the word's offset to the start of
    the window, are intersected; the places that are in both are held against the whole phrase. A proximity match has
    enough of the window's distinct words, in any order, among some n consecutive words of the document: any n words
    that hold as many hold one of those asked for, so the n words from each place up to it are tried.
    """
    probes = small(index.probes, "win", "term1", "term2")
    one = index.postings.join(probes.withColumnRenamed("term1", "term"), "term")
    one = one.withColumn("start", F.col("pos") - F.col("off1")).filter("start >= 0")
    two = index.postings.select("doc_id", "tid", "term", "pos").join(probes.select("wid", F.col("term2").alias("term"), "off2"), "term")
    two = two.select("doc_id", "tid", "wid", (F.col("pos") - F.col("off2")).alias("start"))
    same = F.lit(True)
    for c in ("doc_id", "tid", "wid", "start"):
        same = same & F.col(f"x.{c}").eqNullSafe(F.col(f"y.{c}"))
    both = one.filter("term2 is not null").alias("x").join(two.alias("y"), same, "left_semi").union(one.filter("term2 is null"))
    phrase = F.array_join(F.slice(F.split("around", " "), F.greatest(F.lit(1), F.col("start") - F.col("first") + 1), F.col("size")), " ")
    exact = both.filter((F.col("size") == 1) | (phrase == F.col("win"))).select("doc_id", "tid", "win", "start", "size")
    close = None
    if index.close is not None:
        beside = index.postings.join(small(index.close, "win", "term"), "term")
        met = lambda words: F.size(F.array_intersect(words, F.split("win", " "))) >= F.col("need")
        beside = beside.filter((F.col("size") == 1) | met(F.split("around", " ")))  # few are left to be looked at in parts
        parts = beside.withColumn("begin", F.explode(F.sequence(F.lit(1), F.col("pos") - F.col("first") + 1)))
        close = parts.filter((F.col("size") == 1) | met(F.slice(F.split("around", " "), F.col("begin"), F.lit(n)))).select("doc_id", "tid", "win").distinct()
    return exact.distinct(), close


def hits(rows: DataFrame, items: DataFrame, *, n: int = 10, item_id: str = "item_id", item_text: str = "text", near: float | None = 0.8) -> DataFrame:
    """(doc_id, tid, n_hit, item_ids, n_near) of the tokenised rows in which a window of the items occurs, or nearly; near None: exact ones only."""
    wins = stored(windows_of(items, item_id, item_text, n), "index-windows")
    index = build_index(rows, wins, n, near)
    exact, close = search(index, n)
    exact = stored(exact, "index-exact")
    spans = exact.groupBy("doc_id", "tid", "start").agg(F.max(F.col("start") + F.col("size")).alias("end"))
    before = Window.partitionBy("doc_id", "tid").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)  # one document's hits
    new = F.greatest(F.lit(0), F.col("end") - F.greatest("start", F.coalesce(F.max("end").over(before), F.lit(0))))
    covered = spans.withColumn("new", new).groupBy("doc_id", "tid").agg(F.sum("new").alias("n_hit"))
    of = wins.select("win", "item_id")
    named = exact.select("doc_id", "tid", "win").distinct().join(of, "win").groupBy("doc_id", "tid").agg(F.collect_set("item_id").alias("item_ids"))
    parts = covered.unionByName(named, allowMissingColumns=True)
    if close is None:
        parts = parts.withColumn("n_near", F.lit(None).cast("long"))
    else:
        nearly = close.join(of, "win").select("doc_id", "tid", "item_id").distinct().groupBy("doc_id", "tid").agg(F.count("*").alias("n_near"))
        parts = parts.unionByName(nearly, allowMissingColumns=True)
    parts = parts.groupBy("doc_id", "tid").agg(F.max("n_hit").alias("n_hit"), F.first("item_ids", ignorenulls=True).alias("item_ids"), F.max("n_near").alias("n_near"))
    found = stored(parts, "index-hits")
    forget(wins, exact, index.probes, index.postings, *([index.close] if index.close is not None else []))
    return found


def contamination(docs: DataFrame, items: DataFrame, *, n: int = 10, doc_id: str = "doc_id", text: str = "text", **names) -> DataFrame:
    """One row per row of docs: doc_id, n_words, n_hit, n_items, items_sha256, contaminated, n_near.

    Words are runs of ASCII letters, digits and all other characters beyond ASCII, A-Z lower-cased. A window is n
    consecutive words of an item; a document word inside any occurrence of one is hit. Null and wordless texts have no
    words and no hits; repeated rows have the same figures each; items without words have no windows; an empty
    benchmark hits nothing. n_near counts the items with a window of whose distinct words four fifths or more stand
    among some n consecutive words, in any order, exact matches included. An item without an
    id hits words but has no name to count. Hot passages make as many postings as they have occurrences, spread by document.
    """
    rows = tokenised(docs, doc_id, text)
    found = hits(rows, items, n=n, **names)
    out = rows.select("doc_id", "tid", F.size("w").cast("long").alias("n_words")).alias("r").join(found.alias("f"), F.col("r.doc_id").eqNullSafe(F.col("f.doc_id")) & (F.col("r.tid") == F.col("f.tid")), "left")
    named = F.array_sort(F.transform(F.coalesce("item_ids", F.array()), lambda x: x.cast("string")))
    return out.select(
        "r.doc_id",
        "n_words",
        F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
        F.size(named).cast("long").alias("n_items"),
        F.sha2(F.array_join(named, ",").cast("binary"), 256).alias("items_sha256"),
        (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated"),
        F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
    )


#: Keys of contaminated documents (16 bytes each) are broadcast up to this many.
BROADCAST_KEYS = 1_000_000


def decontaminate(docs: DataFrame, items: DataFrame, *, n: int = 10, doc_id: str = "doc_id", text: str = "text", **names) -> DataFrame:
    """docs without the rows in which a window of the items occurs; columns unchanged."""
    words = tokenised(docs, doc_id, text)
    bad = hits(words, items, n=n, near=None, **names).filter("n_hit > 0").select("doc_id", "tid")
    forget(words)
    if bad.count() <= BROADCAST_KEYS:
        bad = F.broadcast(bad)
    rows = docs.select(packed(docs), col(doc_id).alias("doc_id"), F.xxhash64(col(text)).alias("tid"))
    return rows.alias("r").join(bad.alias("b"), F.col("r.doc_id").eqNullSafe(F.col("b.doc_id")) & (F.col("r.tid") == F.col("b.tid")), "left_anti").select("row.*")
