"""Benchmark decontamination by a distributed positional inverted index, in DataFrame operations alone.

Index: each task turns its documents into postings (term, document, position), keeps those of the terms that stand in test items, and writes them as a segment sorted by term,
so nothing is shuffled and a term's list lies together in each segment. A document also has one posting of END, whose position is its number of words.

Search: test items are cut into distinct windows of consecutive words. A window's terms are ranked by the length of their lists in the index, and lists are intersected from the rarest on:
places of the rarest term, less its offset, are possible starts; these are joined with the list of the second term at the offset between them; what is left is joined with the lists of all
other terms at once. Exact phrases are matches with every term in its own place. Proximity matches are those in which a term may stand up to `slack` places before or after its own, as told from the rarest term.

Joins are on (document, term, position), so no key is hot but the rarest term's in the first one, whose side of windows is small; Spark splits that join if it isn't.
The lists of the last step hold the commonest words; they are first reduced to documents that still have a start, by a table of 2**20 hash buckets at most.

Defined cases: null texts and those without words have no word and no hit; items without words have no window; items of fewer words than a window are one window; a null item id counts
as an item, written as nothing; repeated items are one item if their ids are equal; repeated documents each get their own, equal row, null ids are kept; an empty table of documents gives an empty
result, an empty table of items no hit; columns other than ids and texts are not read.
"""

from __future__ import annotations

from dataclasses import dataclass
from string import ascii_lowercase, ascii_uppercase

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .runtime import free, written

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Tables of the test side are broadcast up to so many bytes; beyond, Spark joins them by a shuffle.
BROADCAST_BYTES = 32 << 20
#: Hash buckets of documents, and rows of their table at most.
BUCKETS = 1 << 20
END = -1


def lowered(text: Column) -> Column:
    """A to Z in lower case, other letters as they are; lower() does just that where all is ASCII."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, ascii_uppercase, ascii_lowercase))


def words(text: Column) -> Column:
    return F.regexp_extract_all(lowered(F.coalesce(text, F.lit(""))), F.lit(WORD), F.lit(0))


def _sent(table: DataFrame, row_bytes: Column) -> DataFrame:
    """Marked for broadcast if all its rows together are of bounded size."""
    size = table.agg(F.coalesce(F.sum(row_bytes), F.lit(0))).first()[0]
    return F.broadcast(table) if size <= BROADCAST_BYTES else table


@dataclass(frozen=True)
class Windows:
    """Written tables: `of` (wid, item_id), `words` (wid, words), `terms` (term, id), which ends with the one of END."""

    of: DataFrame
    words: DataFrame
    terms: DataFrame

    def free(self) -> None:
        free(self.of, self.words, self.terms)


def windows(items: DataFrame, width: int, id_col: str = "item_id", text_col: str = "text") -> Windows:
    """Distinct windows of the items."""
    cut = items.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("item_id"), words(F.col(text_col)).alias("w")).filter(F.size("w") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.size("w") - (width - 1), F.lit(1)))
    every = written(cut.select("item_id", F.explode(F.transform(starts, lambda s: F.slice("w", s, width))).alias("words")).distinct(), "item-windows")
    distinct = written(every.select("words").distinct().withColumn("wid", F.monotonically_increasing_id()), "windows")
    of = written(every.join(distinct, "words").select("wid", "item_id"), "window-items")
    terms = distinct.select(F.explode("words").alias("term")).distinct().withColumn("id", F.monotonically_increasing_id())
    end = items.sparkSession.createDataFrame([("", END)], "term string, id long")  # no word is empty
    out = Windows(of, distinct, written(terms.unionByName(end), "terms"))
    free(every)
    return out


def document_key(doc_id: Column, text: Column) -> Column:
    """With doc_id, what tells rows apart that have equal ids or none; equal rows have equal results, so they may share it."""
    return F.xxhash64(doc_id.isNull(), text)


def index(docs: DataFrame, terms: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Postings of the terms: doc_id, key, term (its id) and pos, in segments sorted by term; written."""
    doc_id, text = F.col(id_col).cast("long"), F.col(text_col)
    rows = docs.select(doc_id.alias("doc_id"), document_key(doc_id, text).alias("key"), F.array_append(words(text), "").alias("w"))
    places = rows.select("doc_id", "key", F.posexplode("w").alias("pos", "word"))
    small = _sent(terms, F.octet_length("term") + 32)
    found = places.join(small, F.col("word") == F.col("term")).select("doc_id", "key", F.col("id").alias("term"), "pos")
    return written(found.sortWithinPartitions("term"), "postings")


def ranked(found: Windows, postings: DataFrame) -> DataFrame:
    """wid, width, rank, offset and term (id) of each window's words, the rarest first; windows with a word that no document has are left out. Written."""
    n = postings.groupBy("term").agg(F.count("*").alias("n"))
    each = found.words.select("wid", F.size("words").alias("width"), F.posexplode("words").alias("offset", "term"))
    known = each.join(found.terms, "term").drop("term").withColumnRenamed("id", "term").join(n, "term", "left")
    lists = known.groupBy("wid", "width").agg(F.sort_array(F.collect_list(F.struct("n", "offset", "term"))).alias("lists"), F.count("n").alias("there"))
    whole = lists.filter(F.col("there") == F.col("width"))
    return written(whole.select("wid", "width", F.posexplode("lists").alias("rank", "list")).select("wid", "width", "rank", "list.offset", "list.term"), "lists")


_DOCUMENT = ("doc", "key")
_START = (*_DOCUMENT, "wid", "start")


def _keyed(postings: DataFrame) -> DataFrame:
    return postings.select(F.coalesce("doc_id", F.lit(0)).alias("doc"), "key", "term", "pos")


def _needed(starts: DataFrame, lists: DataFrame, slack: int) -> DataFrame:
    """Where the lists' terms must stand for the starts to hold."""
    rows = starts.join(_sent(lists, F.lit(48)), "wid")
    place = F.col("start") + F.col("offset")
    shifted = rows.withColumn("shift", F.explode(F.sequence(F.lit(-slack), F.lit(slack)))) if slack else rows.withColumn("shift", F.lit(0))
    return shifted.select(*starts.columns, "rank", "term", "shift", (place + F.col("shift")).alias("pos"))


def matches(postings: DataFrame, lists: DataFrame, slack: int = 0) -> DataFrame:
    """doc, key, wid, start and exact of every match, written; start is where the window's first word stands, or would stand by the place of its rarest word; exact: every word is in its place."""
    if not 0 <= slack <= 8:
        raise ValueError("slack is 0 to 8")
    places = _keyed(postings)
    first = lists.filter("rank = 0").select("wid", "term", "offset")
    begun = places.join(_sent(first, F.lit(32)), "term").withColumn("start", F.col("pos") - F.col("offset"))
    begun = begun.filter("start >= 0") if not slack else begun
    starts = written(begun.select(*_DOCUMENT, "wid", "start"), "starts")
    second = lists.filter("rank = 1")
    needed = _needed(starts, second.select("wid", "rank", "offset", "term"), slack)
    listed = places.join(_sent(second.select("term").distinct(), F.lit(16)), "term", "left_semi")
    alone = lists.filter("width = 1").select("wid")
    one = starts.join(_sent(alone, F.lit(16)), "wid", "left_semi").select(*_START, F.lit(True).alias("exact")).distinct()
    both = needed.join(listed, [*_DOCUMENT, "term", "pos"]).groupBy(*_START).agg(F.bool_or(F.col("shift") == 0).alias("exact"))
    kept = written(one.unionByName(both), "two-terms")
    rest = lists.filter("rank > 1")
    bucket = F.pmod(F.xxhash64(*_DOCUMENT), F.lit(BUCKETS)).cast("int").alias("bucket")
    open_buckets = kept.select(bucket).distinct()  # BUCKETS rows at most
    needed = _needed(kept, rest.select("wid", "rank", "offset", "term"), slack)
    listed = places.join(F.broadcast(open_buckets), bucket == F.col("bucket"), "left_semi").join(_sent(rest.select("term").distinct(), F.lit(16)), "term", "left_semi")
    bit = F.expr("shiftleft(1L, rank)")
    seen = needed.join(listed, [*_DOCUMENT, "term", "pos"]).groupBy(*_START, "exact").agg(F.bit_or(bit).alias("seen"), F.bit_or(F.when(F.col("shift") == 0, bit).otherwise(F.lit(0).cast("long"))).alias("in_place"))
    width = lists.filter("rank = 0").select("wid", "width")
    full = seen.join(_sent(width, F.lit(32)), "wid").filter(F.bit_count("seen") == F.col("width") - 2).withColumn("exact", F.col("exact") & (F.bit_count("in_place") == F.col("width") - 2))
    short = kept.join(_sent(width.filter("width <= 2"), F.lit(32)), "wid", "left_semi")
    out = written(full.select(*_START, "exact").unionByName(short.select(*_START, "exact")), "matches")
    free(starts, kept)
    return out


def covered(spans: Column) -> Column:
    """Places in the union of the spans (first, after): an array of structs, in any order."""
    zero = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("end"))
    step = lambda a, s: F.struct((a["n"] + F.greatest(s["after"] - F.greatest(s["first"], a["end"]), F.lit(0))).cast("long").alias("n"), F.greatest(a["end"], s["after"]).cast("long").alias("end"))
    return F.aggregate(F.sort_array(spans), zero, step)["n"]


@dataclass(frozen=True)
class Contamination:
    """What is found: `documents`, one row each, and `matches` (doc, key, wid, start, exact) with the windows they are of."""

    documents: DataFrame
    matches: DataFrame
    windows: Windows


def contamination(docs: DataFrame, items: DataFrame, width: int = 10, slack: int = 0, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> Contamination:
    """doc_id, n_words, n_hit (words in an exact match), n_items (items with one), items_sha256, contaminated (n_hit > 0) and n_near (items with an exact or proximity match) of each document.

    width: words of a window, 62 at most.
    """
    if not 1 <= width <= 62:
        raise ValueError("width is 1 to 62")
    cut = windows(items, width, item_col, item_text)
    postings = index(docs, cut.terms, id_col, text_col)
    lists = ranked(cut, postings)
    found = matches(postings, lists, slack)
    sized = found.filter("exact").join(_sent(lists.filter("rank = 0").select("wid", "width"), F.lit(32)), "wid")
    spans = sized.groupBy(*_DOCUMENT, "start").agg(F.max(F.col("start") + F.col("width")).alias("after"))
    # A document has a span for each of its words at most, and an id for each item at most.
    hits = spans.groupBy(*_DOCUMENT).agg(covered(F.collect_list(F.struct(F.col("start").cast("long").alias("first"), F.col("after").cast("long").alias("after")))).alias("n_hit"))
    of = found.groupBy(*_DOCUMENT, "wid").agg(F.bool_or("exact").alias("exact")).join(_sent(cut.of, F.octet_length("item_id") + 32), "wid")
    ids = of.groupBy(*_DOCUMENT).agg(F.sort_array(F.collect_set(F.when(F.col("exact"), F.col("item_id")))).alias("ids"), F.count_distinct("item_id").alias("n_near"))
    told = ids.join(hits, list(_DOCUMENT), "left")
    every = postings.filter(F.col("term") == END).select("doc_id", F.coalesce("doc_id", F.lit(0)).alias("doc"), "key", F.col("pos").cast("long").alias("n_words"))
    n_hit = F.coalesce("n_hit", F.lit(0).cast("long"))
    ids = F.coalesce("ids", F.array().cast("array<string>"))
    out = every.join(told, list(_DOCUMENT), "left").select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.size(ids).cast("long").alias("n_items"), F.sha2(F.concat_ws(",", ids).cast("binary"), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"), F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
    )
    return Contamination(out, found, cut)
