"""SimHash near-dedup with deletion-variant signatures.

64-bit fingerprints over word shingles. They are cut into so few segments that of two fingerprints within the distance
some set of segments differs by one bit at most; each set is indexed once for every bit of it left out, so such pairs
meet in an equality join, where the distance is verified. Of the keys that a pair shares, only the first emits it.

Copies share a fingerprint and are joined by it, never paired. Links go through alternating star contraction, a table
in the shared folder for each round, so nothing but two numbers a round reaches the driver: tables that grow with the input
are joined by shuffle and sort (the hint `merge`), since Spark would build those of a few MB on the driver to broadcast them.

Defined cases: null, empty and blank texts have fingerprint zero and are linked like others; a text of fewer words
than a shingle is one shingle; repeated rows get equal results; ids may repeat or be null (a component of null ids
only has a null id); an empty table gives no rows; other columns pass through `keep_one`.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import columns_of, const_array, free, written

SHINGLE = 4
DISTANCE = 4
SEED = 42
BLOCK = 1 << 16


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """Signed 64-bit fingerprint of a text."""
    import numpy as np
    from xxhash import xxh64_intdigest

    words = (text or "").encode().lower().split()  # of bytes: A-Z and ASCII white space only
    if not words:
        return 0
    line, n = b" ".join(words), len(words)
    width = np.fromiter(map(len, words), np.int64, n)
    end = np.cumsum(width + 1) - 1
    if n >= shingle:
        first, last = (end - width)[: n - shingle + 1].tolist(), end[shingle - 1 :].tolist()
    else:
        first, last = [0], [len(line)]
    ones = np.zeros(64, np.int64)
    for at in range(0, len(first), BLOCK):
        h = np.array([xxh64_intdigest(line[a:b], SEED) for a, b in zip(first[at : at + BLOCK], last[at : at + BLOCK])], np.uint64)
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(first), bitorder="little").view(np.int64)[0])


def _fingerprints(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for texts in batches:
        known: dict = {}
        yield pd.Series([known[t] if t in known else known.setdefault(t, fingerprint(t)) for t in texts], dtype="int64")


def with_fingerprint(docs: DataFrame, text: str = "text", name: str = "fp") -> DataFrame:
    return docs.withColumn(name, F.pandas_udf(_fingerprints, "long")(F.coalesce(F.col(text), F.lit(""))))


def signature_plan(distance: int = DISTANCE, rows: int = 0) -> tuple[list[int], list[tuple[int, int]]]:
    """(masks of segment sets, (set, bit left out) of each key).

    With `distance` errors over m segments, some c of them hold one error at most; c is 1 for the fewest segments.
    More segments in larger sets give longer keys, which more fingerprints need: the first plan whose keys
    outnumber them is taken. Any plan finds all pairs.
    """
    for m in range(distance // 2 + 1, 9):
        c = _surely(m, distance)
        if c < 1:
            continue
        width = [64 // m + (i < 64 % m) for i in range(m)]
        masks, at = [], 0
        for x in width:
            masks.append(((1 << x) - 1) << at)
            at += x
        sets = [sum(x) for x in combinations(masks, c)]
        if min(x.bit_count() for x in sets) - 1 >= rows.bit_length() or m == 8:
            break
    return sets, [(i, b) for i, x in enumerate(sets) for b in range(64) if x >> b & 1]


def _surely(m: int, distance: int) -> int:
    """The most segments of m that must exist with one error among them, however `distance` errors fall."""
    worst = m

    def deal(left: int, least: int, got: list[int]) -> None:
        nonlocal worst
        if len(got) == m:
            if left == 0:
                run, n = 0, 0
                for x in got:  # ascending
                    run += x
                    n += run <= 1
                worst = min(worst, n)
            return
        for x in range(least, left + 1):
            deal(left - x, x, [*got, x])

    deal(distance, 0, [])
    return worst


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def links(fps: DataFrame, distance: int = DISTANCE, rows: int | None = None) -> DataFrame:
    """(fp) distinct to (a, b), a < b: all pairs within the distance, each once."""
    sets, keys = signature_plan(distance, fps.count() if rows is None else rows)
    masks, wild = const_array([_signed(sets[i]) for i, _ in keys]), const_array([_signed(1 << b) for _, b in keys])
    first = {i: min(k for k, (j, _) in enumerate(keys) if j == i) for i in range(len(sets))}
    of_set, lead = const_array([i for i, _ in keys], "int"), const_array([int(k == first[i]) for k, (i, _) in enumerate(keys)], "int")
    index = fps.select("fp", F.explode(F.sequence(F.lit(0), F.lit(len(keys) - 1))).alias("tag"))
    left_out = lambda fp, tag: fp.bitwiseAND(F.get(masks, tag)).bitwiseAND(F.bitwise_not(F.get(wild, tag)))
    a = index.select(F.col("fp").alias("a"), F.col("tag").alias("t"), left_out(F.col("fp"), F.col("tag")).alias("k"))
    b = index.select(F.col("fp").alias("b"), F.col("tag").alias("u"), left_out(F.col("fp"), F.col("tag")).alias("l"))
    x, tag = F.col("a").bitwiseXOR(F.col("b")), F.col("t")
    inside = x.bitwiseAND(F.get(masks, tag))
    is_first = ((inside == 0) & (F.get(lead, tag) == 1)) | (inside == F.get(wild, tag))
    for i, mask in enumerate(sets[:-1]):
        is_first &= (F.get(of_set, tag) <= i) | (F.bit_count(x.bitwiseAND(F.lit(_signed(mask)))) > 1)
    verified = (F.col("a") < F.col("b")) & (F.bit_count(x) <= distance) & is_first
    return a.join(b.hint("merge"), (F.col("t") == F.col("u")) & (F.col("k") == F.col("l")) & verified).select("a", "b")


def contract(edges: DataFrame, rounds: int = 64) -> DataFrame:
    """(a, b) links to (node, root), root the smallest node of the component, by large-star and small-star."""
    e = written(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct(), "star")
    mark = lambda t: t.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
    seen = mark(e)
    for _ in range(rounds):
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m"))
        large = both.join(low.hint("merge"), "u").filter("v > u").select(F.col("v").alias("u"), F.least("m", "u").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low.hint("merge"), "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = written(small.unionByName(low.select("u", F.col("m").alias("v"))).distinct(), "star")
        seen, before = mark(e), seen
        if seen == before:
            return e.select(F.col("u").alias("node"), F.col("v").alias("root"))
    raise RuntimeError(f"no fixed point in {rounds} rounds")


def components(docs: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """(doc_id, tkey, fp, component_id, root); tkey is a hash of the text, for a join back, root some fingerprint of the component."""
    rows = written(with_fingerprint(docs.select("doc_id", "text")).select("doc_id", F.xxhash64("text").alias("tkey"), "fp"), "simhash")
    ids = written(rows.groupBy("fp").agg(F.min("doc_id").alias("id")), "simhash-ids")
    root = contract(links(ids.select("fp"), distance))
    linked = root.unionByName(root.select(F.col("root").alias("node"), "root").distinct())
    linked = linked.join(ids.hint("merge"), F.col("node") == ids.fp).select("node", "root", "id")
    least = linked.groupBy("root").agg(F.min("id").alias("low"))
    linked = linked.join(least.hint("merge"), "root").select("node", "low", "root")
    by_fp = ids.join(linked.hint("merge"), ids.fp == F.col("node"), "left").select(ids.fp.alias("_fp"), F.when(F.col("node").isNull(), F.col("id")).otherwise(F.col("low")).alias("component_id"), F.coalesce("root", ids.fp).alias("root"))
    by_fp = written(by_fp, "simhash-roots")  # a plain table on either side of the join, so Spark can split a hot fingerprint
    return rows.join(by_fp.hint("merge"), rows.fp == F.col("_fp")).select("doc_id", "tkey", "fp", "component_id", "root")


def report(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id."""
    return components(docs).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def one_of_each(docs: DataFrame, found: DataFrame) -> DataFrame:
    """docs with one row of each component of found (doc_id, tkey, root): that of the smallest id, null last."""
    i, k = free(docs, "_id", "_tkey")
    keep = found.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "tkey")).alias("k")).select(F.col("k.doc_id").alias(i), F.col("k.tkey").alias(k))
    rows = docs.join(keep.hint("merge"), F.col("doc_id").eqNullSafe(F.col(i)) & (F.xxhash64("text") == F.col(k)))
    return rows.dropDuplicates([i, k]).select(*columns_of(docs))


def keep_one(docs: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """docs with one row of each component: that of the smallest id, null last."""
    return one_of_each(docs, written(components(docs, distance), "simhash-groups"))
