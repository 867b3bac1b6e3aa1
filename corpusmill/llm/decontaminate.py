"""Benchmark decontamination: windows of normalised benchmark words found in documents.

The windows of all items form one hash set; each stands in it once, with the set of its items, and equal sets of items are
one. Each window names as its anchor its longest pair of adjacent words; a
two-bit filter over the anchors' hashes, a literal of bounded width, picks a document's candidate pairs in one pass. The
windows around a candidate are rendered as text and joined with the set on the text itself, which verifies each hit.
Spark broadcasts the set where it measures it as small and shuffles both sides otherwise.

Defined cases: null and empty texts have no words and no hits; an item of fewer words than a window is one window; an
item without words has none; equal items count one by one; overlapping occurrences count each word once; an empty
benchmark hits nothing; a document row is known by id and text, so repeated rows get equal results; other
columns, whatever their names, pass through `remove_spans` and `remove_documents`; an item without id counts as a hit, but
not among a document's items.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, columns_of, const_array, free, named, written

WINDOW = 10
#: The filter has 256 bits for an anchor, up to 2**26 bits (8 MB): a million anchors then let one word pair in a thousand
#: pass, ten million one in fourteen. What passes is verified, so this is cost alone.
MAP_BITS = (16, 26)
WORD_GAP = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def bench_words(c: Column) -> Column:
    """Words in their own case: A-Z are letters, so lower-casing them moves no boundary."""
    return F.filter(F.split(F.coalesce(c, F.lit("")), WORD_GAP), lambda w: w != "")


def pair_hash(a: Column, b: Column) -> Column:
    """Case is folded for all letters here: that may only add candidates."""
    return F.xxhash64(F.lower(a), F.lower(b))


def windows(benchmark: DataFrame, n: int = WINDOW) -> DataFrame:
    """(item_id, len, gram): every window of every item."""
    w = benchmark.select("item_id", bench_words(F.col("text")).alias("w")).filter(F.size("w") > 0)
    length = F.least(F.size("w"), F.lit(n))
    starts = F.sequence(F.lit(1), F.size("w") - length + 1)
    grams = w.withColumn("len", length).select("item_id", "len", F.explode(F.transform(starts, lambda i: F.array_join(F.slice("w", i, F.col("len")), " "))).alias("gram"))
    return grams.select("item_id", "len", ascii_lower(F.col("gram")).alias("gram")).distinct()


class Anchors:
    """The filter: a word and the next one (the word alone for one-word windows) may be some window's anchor."""

    def __init__(self, grams: DataFrame):
        w = F.split("gram", " ")
        longest = F.array_max(F.transform(F.sequence(F.lit(1), F.size(w) - 1), lambda i: F.struct((F.length(F.get(w, i - 1)) + F.length(F.get(w, i))).alias("n"), (-i).alias("at"))))
        pairs = grams.select("len", F.when(F.size(w) > 1, longest["at"]).otherwise(-1).alias("at"), w.alias("w"))
        h = pairs.select("len", pair_hash(F.get("w", -F.col("at") - 1), F.when(F.col("len") > 1, F.get("w", -F.col("at")))).alias("h")).distinct()
        self.lengths = sorted(r.len for r in h.select("len").distinct().collect())
        rows = h.groupBy("h").agg(F.min("len").alias("len"))
        self.bits = min(MAP_BITS[1], max(MAP_BITS[0], (256 * rows.count()).bit_length()))
        low = (1 << self.bits) - 1
        both = rows.select(F.explode(F.array(F.col("h").bitwiseAND(low), F.shiftrightunsigned("h", 32).bitwiseAND(low))).alias("b"))
        self.map = [0] * (1 << (self.bits - 6))
        for r in both.groupBy(F.shiftright("b", 6).alias("k")).agg(F.expr("bit_or(shiftleft(1L, cast(b & 63 as int))) as v")).collect():
            self.map[r.k] = r.v

    def has(self, h: Column) -> Column:
        table, low, six = const_array(self.map), F.lit((1 << self.bits) - 1), F.lit(63)

        def bit(x):
            return F.getbit(F.get(table, F.shiftright(x, 6).cast("int")), x.bitwiseAND(six).cast("int")) == 1

        return bit(h.bitwiseAND(low)) & bit(F.shiftrightunsigned(h, 32).bitwiseAND(low))


def scan(docs: DataFrame, anchors: Anchors) -> DataFrame:
    """(doc_id, tkey, n_words, near): for each candidate the words around it, `first` the place of the first."""
    w = F.split(F.coalesce("text", F.lit("")), WORD_GAP)
    rows = docs.select("doc_id", F.xxhash64("text").alias("tkey"), w.alias("w"))
    # split leaves an empty piece at either end only; no window has one
    blank = F.when(F.size("w") == 1, (F.get("w", F.lit(0)) == "").cast("long")).otherwise((F.element_at("w", 1) == "").cast("long") + (F.element_at("w", -1) == "").cast("long"))
    hits, most = [], max(anchors.lengths, default=1)
    if most > 1:
        hits.append(F.transform("w", lambda x, i: F.when(anchors.has(pair_hash(x, F.get("w", i + 1))), i)))
    if 1 in anchors.lengths:
        hits.append(F.transform("w", lambda x, i: F.when(anchors.has(pair_hash(x, F.lit(None).cast("string"))), i)))
    at = F.array_compact(F.concat(*hits)) if hits else F.array().cast("array<int>")
    rows = rows.select("doc_id", "tkey", "w", (F.size("w") - blank).cast("long").alias("n_words"), at.alias("at"))

    def around(i):
        first = F.greatest(i - most + 2, F.lit(0))
        return F.struct(first.alias("first"), F.slice("w", first + 1, F.lit(2 * most)).alias("w"))

    return rows.select("doc_id", "tkey", "n_words", F.transform("at", around).alias("near"))


def item_sets(grams: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(gram, len, items): each window once, with the digest of its items' set; and (items, item_ids): each such set once."""
    ids = F.array_sort(F.collect_set(F.col("item_id").cast("string")))
    of = grams.groupBy("gram", "len").agg(ids.alias("item_ids")).withColumn("items", F.sha2(F.to_json("item_ids"), 256))
    of = written(of, "bench-windows")
    return of.select("gram", "len", "items"), of.select("items", "item_ids").dropDuplicates(["items"])


def hits(scanned: DataFrame, grams: DataFrame, anchors: Anchors) -> DataFrame:
    """(doc_id, tkey, at, len, items): verified occurrences of `item_sets`' windows; `at` counts words from the text's first piece."""
    near = scanned.select("doc_id", "tkey", F.explode("near").alias("c")).select("doc_id", "tkey", "c.first", F.transform("c.w", ascii_lower).alias("w"))

    def windows_of(k):
        return F.transform(F.sequence(F.lit(1), F.size("w") - k + 1), lambda i: F.struct((F.col("first") + i).alias("at"), F.lit(k).alias("len"), F.array_join(F.slice("w", i, k), " ").alias("gram")))

    each = [windows_of(k) for k in anchors.lengths]
    each = [F.when(F.size("w") >= k, x).otherwise(F.array().cast("array<struct<at:int,len:int,gram:string>>")) for k, x in zip(anchors.lengths, each)]
    cand = near.select("doc_id", "tkey", F.explode(F.flatten(F.array(*each))).alias("c")).select("doc_id", "tkey", "c.at", "c.len", "c.gram")
    return cand.join(grams, ["gram", "len"]).select("doc_id", "tkey", "at", "len", "items")


def search(docs: DataFrame, benchmark: DataFrame, n: int = WINDOW) -> tuple[DataFrame, DataFrame | None, DataFrame]:
    """(every row's doc_id, tkey and n_words; the hits, or None where the benchmark has no words; the item sets)."""
    grams = written(windows(benchmark, n), "bench-grams")
    anchors = Anchors(grams)
    scanned = written(scan(docs, anchors), "bench-scan")
    by_window, sets = item_sets(grams)
    return scanned.select("doc_id", "tkey", "n_words"), hits(scanned, by_window, anchors) if anchors.lengths else None, sets


def report(docs: DataFrame, benchmark: DataFrame, n: int = WINDOW) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated."""
    rows, found, sets = search(docs, benchmark, n)
    zero, nothing = F.lit(0).cast("long"), F.sha2(F.lit(""), 256)
    if found is None:
        return rows.select("doc_id", "n_words", zero.alias("n_hit"), zero.alias("n_items"), nothing.alias("items_sha256"), F.lit(False).alias("contaminated"))
    found = found.groupBy("doc_id", "tkey").agg(F.collect_set("items").alias("sets"), F.array_sort(F.collect_set(F.struct("at", "len"))).alias("spans"))
    found = written(found.select("doc_id", "tkey", "sets", covered(F.col("spans")).alias("n_hit")), "bench-hits")
    # a document's words count once for all its sets, and its items once however many sets have them
    of = found.select("doc_id", "tkey", "n_hit", F.explode("sets").alias("items")).join(sets, "items")
    of = of.groupBy(F.col("doc_id").alias("_id"), F.col("tkey").alias("_tkey"), "n_hit").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("item_ids")))).alias("ids"))
    of = of.select("_id", "_tkey", "n_hit", F.size("ids").cast("long").alias("n_items"), F.sha2(F.array_join("ids", ","), 256).alias("items_sha256"))
    out = rows.join(of, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("tkey") == F.col("_tkey")), "left")
    return out.select("doc_id", "n_words", F.coalesce("n_hit", zero).alias("n_hit"), F.coalesce("n_items", zero).alias("n_items"), F.coalesce("items_sha256", nothing).alias("items_sha256"), (F.coalesce("n_hit", zero) > 0).alias("contaminated"))


def covered(spans: Column) -> Column:
    """Words under sorted (at, len) spans, overlaps once."""
    start = F.struct(F.lit(-1).cast("long").alias("end"), F.lit(0).cast("long").alias("n"))

    def add(acc, s):
        end = (s["at"] + s["len"]).cast("long")
        new = F.greatest(end - F.greatest(acc["end"], s["at"].cast("long")), F.lit(0).cast("long"))
        return F.struct(F.greatest(acc["end"], end).alias("end"), (acc["n"] + new).alias("n"))

    return F.aggregate(spans, start, add, lambda acc: acc["n"])


def _spans(docs: DataFrame, benchmark: DataFrame, n: int) -> DataFrame | None:
    """(id, tkey, hit words, words, spans), named as no column of docs is."""
    rows, found, _ = search(docs, benchmark, n)
    if found is None:
        return None
    found = found.groupBy("doc_id", "tkey").agg(F.array_sort(F.collect_set(F.struct("at", "len"))).alias("spans"))
    words = rows.groupBy(F.col("doc_id").alias("_i"), F.col("tkey").alias("_t")).agg(F.first("n_words").alias("n_words"))
    found = found.join(words, F.col("doc_id").eqNullSafe(F.col("_i")) & (F.col("tkey") == F.col("_t")))
    found = written(found.select("doc_id", "tkey", covered(F.col("spans")).alias("hit"), "n_words", "spans"), "bench-spans")
    return found.toDF(*free(docs, "_id", "_tkey", "_hit", "_words", "_spans"))


def _same(found: DataFrame) -> Column:
    i, k = found.columns[:2]
    return F.col("doc_id").eqNullSafe(named(i)) & (F.xxhash64("text") == named(k))


def remove_documents(docs: DataFrame, benchmark: DataFrame, n: int = WINDOW, most: float = 0.0) -> DataFrame:
    """docs without those of which more than a share `most` of the words is hit."""
    found = _spans(docs, benchmark, n)
    if found is None:
        return docs
    hit, words = map(named, found.columns[2:4])
    bad = found.filter(hit > F.lit(most) * words).select(*found.columns[:2])
    return docs.join(bad, _same(found), "left_anti")


def remove_spans(docs: DataFrame, benchmark: DataFrame, n: int = WINDOW, most: float = 1.0) -> DataFrame:
    """docs without the hit words and what stood before each; documents of which more than a share `most` is hit go."""
    found = _spans(docs, benchmark, n)
    if found is None:
        return docs
    hit, words, spans = map(named, found.columns[2:5])
    word = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
    rows = docs.join(found, _same(found), "left")
    rows = rows.filter(hit.isNull() | (hit <= F.lit(most) * words))
    gaps, word_, lead, new = free(rows, "_gaps", "_word", "_lead", "_new")
    some = spans.isNotNull()  # only these texts are split
    first = (F.get(F.split("text", WORD_GAP), F.lit(0)) == "").cast("int")  # places count an empty first piece
    rows = rows.withColumns({gaps: F.when(some, F.split("text", word)), word_: F.when(some, F.regexp_extract_all("text", F.lit(word), 0)), lead: F.when(some, first)})
    held = F.flatten(F.transform(spans, lambda s: F.sequence(s["at"] - F.col(lead) - 1, s["at"] - F.col(lead) + s["len"] - 2)))  # at counts from 1
    left = F.array_except(F.sequence(F.lit(0), F.size(word_) - 1), held)
    text = F.concat(F.array_join(F.transform(left, lambda i: F.concat(F.get(gaps, i), F.get(word_, i))), ""), F.element_at(gaps, -1))
    return rows.withColumn(new, F.when(some, text).otherwise(F.col("text"))).select(*columns_of(docs, F.col(new)))
