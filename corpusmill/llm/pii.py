"""Personal data, and terms that give it away, by corpus co-occurrence.

Emails, network addresses, payment cards and telephone numbers are found by pattern in every text: the protected
entities. How strongly a term reveals an entity is their pointwise mutual information over the different texts of the
corpus: with n texts, of which n(e) hold the entity, n(t) the term and n(t, e) both,
log2(n n(t, e) / (n(t) n(e))). It is at most the entity's information, log2(n / n(e)), which a term reaches that occurs
wherever the entity does and nowhere else. A term in an entity's text is removed where it discloses at least `REMOVE` of that
information and generalised from `GENERALISE` up, if at least `SUPPORT` different texts hold both. Copies of a text
count once in all four numbers.

Terms are the text's words without the marks around them, in lower case; words that a pattern's span touches are none.
Every word of a text counts with every entity of it, however far apart. n(t, e) is at most n(t) and n(e), so pairs that by these two
cannot reach `SUPPORT` or `GENERALISE` are never made.

Spans are kind:start:end in code points, end exclusive; the method's kinds are `general` and `remove`. They never
overlap pattern spans.

Defined cases: null and empty texts have no spans; repeated rows get equal spans; matches that fail a kind's test are
dropped and not tried again; words may be of any length; a null id is an id; an empty table gives no rows; other columns,
whatever their names, pass through `sanitise`.
"""

from __future__ import annotations

import sys
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE, columns_of, const_array, free, named, written

KINDS = ("email", "ip", "card", "phone")
#: Words before and after an entity that are near it: all of its text.
NEAR = sys.maxsize
SUPPORT = 3
CUT = 4096
MOST_BITS = 1 << 21
GENERALISE, REMOVE = 0.6, 0.9
ALL_KINDS = (*KINDS, "general", "remove")
#: Each finds the leftmost matches of its plain form, but in linear time: a run of characters is tried from its start (or
#: where the last match ended) only, and possessive parts do not back off where that cannot help.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
BYTE = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"
SPAN = "struct<kind:int,start:int,end:int>"
WORD = r"[^\x20\x09-\x0D]+"
#: The marks at a word's start and end. Runs of marks inside a word are not tried from each of their places.
EDGES = r"(?<![^\x20\x09-\x0D])[^\p{L}\p{N}\x20\x09-\x0D]++|(?<=[\p{L}\p{N}])[^\p{L}\p{N}\x20\x09-\x0D]++(?![^\x20\x09-\x0D])"


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def _luhn(m: Column) -> Column:
    d = F.regexp_extract_all(m, F.lit("[0-9]"), F.lit(0))

    def add(acc, x):
        v = x.cast("int") * F.when(acc["odd"], 2).otherwise(1)
        return F.struct((acc["sum"] + v - F.when(v > 9, 9).otherwise(0)).alias("sum"), (~acc["odd"]).alias("odd"))

    return F.aggregate(F.reverse(d), F.struct(F.lit(0).alias("sum"), F.lit(False).alias("odd")), add, lambda a: a["sum"] % 10 == 0)


def _accepted(kind: str, m: Column) -> Column:
    if kind == "ip":
        return m.rlike(rf"^{BYTE}(?:\.{BYTE}){{3}}$")
    n = F.length(_digits(m))
    if kind == "card":
        return F.when(n.between(14, 19), _luhn(m)).otherwise(F.lit(False))
    return n.between(10, 15) if kind == "phone" else F.lit(True)


def _before(values: Column, op: Callable[[Column, Column], Column]) -> Column:
    """For each value, op over all before it, from 0. It runs over blocks of values, then over the blocks, so many values
    in one text cost little more than their number. op: sum or maximum."""
    size = 256

    def run(items, value):
        empty = F.struct(F.array().cast("array<int>").alias("at"), F.lit(0).alias("n"))
        return F.aggregate(items, empty, lambda a, x: F.struct(F.concat(a["at"], F.array(a["n"])).alias("at"), op(a["n"], value(x)).alias("n")))

    blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(values) - 1) / size).cast("int")), lambda b: run(F.slice(values, b * size + 1, F.lit(size)), lambda x: x))
    starts = F.flatten(F.element_at(F.transform(F.array(blocks), lambda bs: F.zip_with(bs, run(bs, lambda b: b["n"])["at"], lambda b, o: F.transform(b["at"], lambda x: op(x, o)))), 1))
    return F.when(F.size(values) == 0, F.array().cast("array<int>")).otherwise(starts)


def _ends(gaps: Column, found: Column) -> Column:
    """(start, g, m) of each match: where it starts, the length of what stands before it, its own length."""
    length = F.zip_with(F.slice(gaps, 1, F.size(found)), found, lambda g, m: F.struct(F.length(g).alias("g"), F.length(m).alias("m")))
    starts = _before(F.transform(length, lambda x: x["g"] + x["m"]), lambda a, b: a + b)
    return F.zip_with(starts, length, lambda s, x: F.struct((s + x["g"]).alias("start"), x["g"].alias("g"), x["m"].alias("m")))


def _rank(points: Column, marks: Column, ties: bool) -> Column:
    """For each of the ascending points, how many marks are smaller (with ties: or equal), by sorting both together."""
    p, m = (1, 0) if ties else (0, 1)
    both = F.sort_array(F.concat(F.transform(points, lambda x: x.cast("long") * 2 + p), F.transform(marks, lambda x: x.cast("long") * 2 + m)))
    placed = F.filter(F.transform(both, lambda x, j: F.struct(x.alias("x"), j.alias("j"))), lambda y: y["x"] % 2 == p)
    return F.transform(placed, lambda y, i: y["j"] - i)


def with_base_spans(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with _spans: array of (kind, start, end, value) in order; kind counts from 0 as listed in KINDS."""
    made = docs
    for k in KINDS:
        made = made.withColumn(f"_m_{k}", F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(PATTERNS[k]), F.lit(0)))
    for k in KINDS:
        # the text is split only where something was found
        made = made.withColumn(f"_g_{k}", F.when(F.size(f"_m_{k}") > 0, F.split(text, PATTERNS[k])).otherwise(F.array().cast("array<string>")))
    for k in KINDS:
        made = made.withColumn(f"_s_{k}", _ends(F.col(f"_g_{k}"), F.col(f"_m_{k}")))
    each = []
    for i, k in enumerate(KINDS):
        pairs = F.arrays_zip(F.col(f"_s_{k}").alias("s"), F.col(f"_m_{k}").alias("m"))
        each.append(_spans_of(pairs, i, k))
    made = made.withColumn("_spans", F.array_sort(F.concat(*each), _by_place))
    return made.select(*docs.columns, "_spans")


def _spans_of(pairs: Column, i: int, kind: str) -> Column:
    kept = F.filter(pairs, lambda p: _accepted(kind, p["m"]))
    return F.transform(kept, lambda p: F.struct(F.lit(i).alias("kind"), p["s"]["start"].alias("start"), (p["s"]["start"] + p["s"]["m"]).alias("end"), p["m"].alias("value")))


def _by_place(a: Column, b: Column) -> Column:
    x, y = a["start"] * 8 + a["kind"], b["start"] * 8 + b["kind"]
    return F.when(x < y, -1).when(x > y, 1).otherwise(0)


def rendered(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    names = F.array(*map(F.lit, ALL_KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def stripped(c: Column) -> Column:
    """Words in lower case without the marks around them."""
    return F.regexp_replace(F.lower(c), EDGES, "")


def with_terms(found: DataFrame) -> DataFrame:
    """found (text, _spans) with _terms: (start, end, hash of the term) of each word that no span touches, where the text has spans."""
    rows = found.withColumn("_t", F.when(F.size("_spans") > 0, F.col("text")))
    rows = rows.withColumn("_w", F.regexp_extract_all("_t", F.lit(WORD), F.lit(0)))
    rows = rows.withColumn("_at", _ends(F.split("_t", WORD), F.col("_w")))
    begins, stops = F.transform("_spans", lambda s: s["start"]), F.transform("_spans", lambda s: s["end"])
    begun = _rank(F.transform("_at", lambda a: a["start"] + a["m"]), begins, False)
    over = _rank(F.transform("_at", lambda a: a["start"]), stops, True)
    # no span touches a word before whose end as many spans began as have ended at its start
    words = F.filter(F.arrays_zip(F.col("_at").alias("a"), F.col("_w").alias("w"), begun.alias("b"), over.alias("o")), lambda x: x["b"] == x["o"])
    made = F.transform(words, lambda x: F.struct(x["a"]["start"].alias("start"), (x["a"]["start"] + x["a"]["m"]).alias("end"), stripped(x["w"]).alias("w")))
    rows = rows.withColumn("_free", F.filter(made, lambda x: F.length(x["w"]) > 1))
    return rows.withColumn("_terms", F.transform("_free", lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), F.xxhash64(x["w"]).alias("t")))).drop("_t", "_w", "_at", "_free")


def _marked(keys: DataFrame) -> Column:
    """Whether tkey is, or shares a bit with, one of the keys (tkey): a bit filter of 64 bits a key or more, up to MOST_BITS."""
    size = min(MOST_BITS, max(64, 1 << (64 * keys.count()).bit_length()))
    place, bit = F.floor(F.pmod("tkey", F.lit(size)) / 64).cast("int"), F.expr("shiftleft(1L, cast(pmod(tkey, 64) as int))")
    bits = [0] * (size // 64)
    for r in keys.groupBy(place.alias("at")).agg(F.bit_or(bit).alias("bits")).collect():
        bits[r["at"]] = r["bits"]
    return F.get(const_array(bits), place).bitwiseAND(bit) != 0


def disclosures(docs: DataFrame, base: DataFrame) -> DataFrame:
    """(tkey, t, share): hashes of the terms of each text that give away one of its entities, with the largest share of an
    entity's information that they disclose, if that is GENERALISE or more."""
    copies = written(base.groupBy("tkey").agg(F.count("*").alias("rows")), "pii-copies")
    n = copies.count()
    held = written(base.select("tkey", F.explode("_spans").alias("s")).select("tkey", F.xxhash64("s.kind", "s.value").alias("entity")).distinct(), "pii-held")
    entity = held.groupBy("entity").agg(F.count("*").alias("n_e")).filter(F.col("n_e") >= SUPPORT).withColumnRenamed("entity", "_e")
    held = written(held.join(entity, F.col("entity") == F.col("_e")).select("tkey", "entity", "n_e"), "pii-entities")
    words = base.join(held.select("tkey").distinct(), "tkey", "left_semi").select("tkey", F.explode(F.array_distinct(F.transform("_terms", lambda x: x["t"]))).alias("t"))
    words = written(words.distinct(), "pii-words")
    info = F.log2(F.lit(float(max(n, 2))) / F.least(F.col("n_e"), F.lit(max(n - 1, 1))))
    enough = lambda n_te, n_t: F.log2(n_te * float(n) / (F.col("n_e") * n_t)) >= GENERALISE * info - 1e-9
    # of all texts with a term no fewer hold it than of those with entities, and of these no fewer than hold both
    most = held.agg(F.max("n_e")).first()[0] or SUPPORT
    among = words.groupBy("t").agg(F.count("*").alias("n_w")).filter(F.col("n_w") >= SUPPORT)
    among = among.withColumn("n_e", F.lit(most)).filter(enough(F.least("n_e", "n_w"), F.col("n_w"))).drop("n_e")
    both = held.join(words.join(among, "t"), "tkey").filter(enough(F.least("n_e", "n_w"), F.col("n_w")))
    pairs = both.groupBy("entity", "t", "n_e", "n_w").agg(F.count("*").alias("n_te")).filter(F.col("n_te") >= SUPPORT)
    pairs = written(pairs.filter(enough(F.col("n_te"), F.col("n_w"))).drop("n_w"), "pii-pairs")
    asked = written(pairs.select("t").distinct(), "pii-terms")
    every = F.array_distinct(F.split(stripped(F.coalesce("text", F.lit(""))), SPACE))
    every = docs.select(F.xxhash64("text").alias("tkey"), F.explode(every).alias("w")).select("tkey", F.xxhash64("w").alias("t"))
    # a text that has no copies counts where it is read; only texts that may have some are told apart
    one = F.when(_marked(copies.filter("rows > 1").select("tkey")), F.col("tkey"))
    term = every.join(asked, "t", "left_semi").select("t", one.alias("copied")).groupBy("t")
    term = term.agg((F.count_distinct("copied") + F.count(F.when(F.col("copied").isNull(), 1))).alias("n_t"))
    share = F.log2(F.col("n_te") * float(n) / (F.col("n_e") * F.col("n_t"))) / info
    told = pairs.join(term, "t").select("entity", "t", share.alias("share")).filter(F.col("share") >= GENERALISE)
    told = written(told, "pii-told")
    hits = words.join(told, "t").join(held.select("tkey", "entity"), ["tkey", "entity"])
    return hits.groupBy("tkey", "t").agg(F.max("share").alias("share"))


def spans(docs: DataFrame) -> DataFrame:
    """(doc_id, tkey, _spans, _more): pattern spans of every row, and the method's."""
    found = with_terms(with_base_spans(docs.select("doc_id", F.xxhash64("text").alias("tkey"), "text")))
    base = written(found.drop("text"), "pii-base")  # the texts are matched once
    told = written(disclosures(docs, base).withColumnsRenamed({"tkey": "_k", "t": "_t"}), "pii-hits")
    near = base.join(told.select("_k").distinct(), F.col("tkey") == F.col("_k"), "left_semi").select("doc_id", "tkey", F.explode("_terms").alias("x"))
    hits = near.select("doc_id", "tkey", "x.*").distinct().join(told, (F.col("tkey") == F.col("_k")) & (F.col("t") == F.col("_t")))
    kind = F.when(F.col("share") >= REMOVE, len(KINDS) + 1).otherwise(len(KINDS))
    more = hits.groupBy(F.col("doc_id").alias("_id"), F.col("tkey").alias("_k")).agg(F.collect_list(F.struct(kind.alias("kind"), "start", "end")).alias("_more"))
    out = base.drop("_terms").join(more, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("tkey") == F.col("_k")), "left")
    return out.select("doc_id", "tkey", "_spans", F.coalesce("_more", F.array().cast(f"array<{SPAN}>")).alias("_more"))


def report(docs: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans."""
    base = F.transform("_spans", lambda s: F.struct(s["kind"], s["start"], s["end"]))
    count = lambda i: F.size(F.filter("_spans", lambda s: s["kind"] == i)).cast("long")
    both = F.array_sort(F.concat(base, "_more"), _by_place)
    return spans(docs).select("doc_id", *[count(i).alias(f"n_{k}") for i, k in enumerate(KINDS)], F.sha2(rendered(base), 256).alias("base_sha256"), rendered(both).alias("spans"))


def _cut(blocks: Column, low: Column, high: Column) -> Column:
    """Characters low to high of the text whose blocks of CUT characters these are: a cut out of the whole text would
    walk it from its start for every span."""
    each = F.sequence(F.floor(low / CUT).cast("int"), F.floor((high - 1) / CUT).cast("int"))
    parts = F.transform(each, lambda b: F.substring(F.get(blocks, b), F.greatest(low - b * CUT, F.lit(0)) + 1, high - F.greatest(b * CUT, low)))
    return F.when(high > low, F.array_join(parts, "")).otherwise(F.lit(""))


def sanitise(docs: DataFrame) -> DataFrame:
    """docs with entities replaced by their kind in brackets, generalised terms by what they are ([NUMBER], [NAME] where
    they begin with a capital, else [WORD]), and removed terms gone."""
    i, k, s, m, every, blocks, out = free(docs, "_id", "_tkey", "_spans", "_more", "_all", "_blocks", "_new")
    found = spans(docs).dropDuplicates(["doc_id", "tkey"]).toDF(i, k, s, m)
    rows = docs.join(found, F.col("doc_id").eqNullSafe(named(i)) & (F.xxhash64("text") == named(k)), "left")
    base = F.transform(s, lambda x: F.struct(x["kind"], x["start"], x["end"]))
    rows = rows.withColumn(every, F.array_sort(F.concat(base, named(m)), _by_place))
    held = F.when(F.size(every) > 0, F.col("text"))
    rows = rows.withColumn(blocks, F.regexp_extract_all(held, F.lit(f"(?s).{{1,{CUT}}}"), F.lit(0)))
    marks = F.array(*[F.lit(f"[{x.upper()}]") for x in KINDS])

    def mark(x: Column) -> Column:
        word = _cut(F.col(blocks), x["start"], x["end"])
        kind = F.when(word.rlike(r"\p{N}"), "[NUMBER]").when(word.rlike(r"^[^\p{L}]*\p{Lu}"), "[NAME]").otherwise("[WORD]")
        return F.when(x["kind"] < len(KINDS), F.get(marks, x["kind"])).when(x["kind"] == len(KINDS), kind).otherwise("")

    # kinds may overlap: what is behind the last end is not written again
    upto = _before(F.transform(every, lambda x: x["end"]), F.greatest)
    pieces = F.zip_with(every, upto, lambda x, at: F.when(x["start"] >= at, F.concat(_cut(F.col(blocks), at, x["start"]), mark(x))).otherwise(""))
    last = F.array_max(F.transform(every, lambda x: x["end"]))
    text = F.when(F.size(every) > 0, F.concat(F.array_join(pieces, ""), _cut(F.col(blocks), last, F.length("text")))).otherwise(F.col("text"))
    return rows.withColumn(out, text).select(*columns_of(docs, F.col(out)))
