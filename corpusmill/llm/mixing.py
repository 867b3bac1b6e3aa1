"""Mixing sources to target weights by hash-threshold histograms.

Each document has a fixed 60-bit hash. Words are summed by source and leading hash bits; where the running sum of a
source crosses its budget lies the boundary bucket, and only its documents are summed again by the next bits. Below the
threshold found so, documents are taken once more than above it. Nothing is sorted, and a larger budget takes
a superset of what a smaller one takes.

Defined cases: a null text has size 0; a null source is a source of its own, last in order; documents of one hash
(equal ids) are taken together; a budget is met from below, and what the first document beyond it leaves open goes to
smaller ones; a document, one without words too, is taken at most as often as its source's target asks for, rounded up; an
empty table gives no rows; all columns, whatever their names, pass through `mix`.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import columns_of, free, n_words, written

LEVELS = (12,) * 5  # bits: no source has more than 4096 buckets at once
BITS = sum(LEVELS)
EPOCHS = 3
WEIGHTS = (1, 2, 3)


def mix_hash(key: Column) -> Column:
    return F.conv(F.substring(F.md5(F.coalesce(key.cast("string"), F.lit("")).cast("binary")), 1, 15), 16, 10).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, epochs: int = EPOCHS) -> DataFrame:
    """(source, source_size) to (source, source_size, target): shares of all words by weight, none above
    `epochs` times its source; what a capped source leaves is shared again.

    In order of cap over weight the capped sources come first, so running sums find them in one pass. The
    table has a row per source.
    """
    order = W.orderBy(F.col("source").asc_nulls_last())
    w = F.get(F.array(*map(F.lit, weights)), (F.row_number().over(order) - 1) % len(weights)).cast("long")
    t = sizes.withColumn("w", w).withColumn("cap", F.col("source_size") * epochs)
    by = W.orderBy(F.col("cap") / F.col("w"), F.col("source").asc_nulls_last())
    before = by.rowsBetween(W.unboundedPreceding, -1)
    after = by.rowsBetween(W.currentRow, W.unboundedFollowing)
    whole = W.partitionBy()
    t = t.withColumns({"total": F.sum("source_size").over(whole), "taken_before": F.coalesce(F.sum("cap").over(before), F.lit(0)), "w_left": F.sum("w").over(after)})
    t = t.withColumn("capped", F.col("cap") * F.col("w_left") <= F.col("w") * (F.col("total") - F.col("taken_before")))
    left = F.sum(F.when(F.col("capped"), 0).otherwise(F.col("w"))).over(whole)
    rest = F.col("total") - F.sum(F.when(F.col("capped"), F.col("cap")).otherwise(0)).over(whole)
    t = t.withColumns({"w_open": left, "rest": rest})
    target = F.when(F.col("capped"), F.col("cap").cast("double")).otherwise((F.col("w") * F.col("rest")).cast("double") / F.col("w_open").cast("double"))
    return t.select("source", "source_size", target.alias("target"))


def cuts_for(sized: DataFrame, budgets: DataFrame) -> DataFrame:
    """(source, budget) to (source, cut): documents with a hash below cut have `budget` words at most, and as many as
    whole hashes allow. sized: (source, h, size)."""
    left, cuts, shift, done = sized, budgets.withColumn("cut", F.lit(0).cast("long")), BITS, []
    for bits in LEVELS:
        last = shift - bits == 0
        shift -= bits
        bucket = F.shiftright("h", shift)
        hist = left.groupBy("source", bucket.alias("b")).agg(F.sum("size").alias("n"), F.count("*").alias("docs"))
        run = W.partitionBy("source").orderBy("b")
        hist = hist.withColumn("upto", F.sum("n").over(run))
        c = cuts.select(F.col("source").alias("_s"), F.col("budget").alias("_budget"))
        edge = hist.join(c, hist.source.eqNullSafe(F.col("_s"))).filter(F.col("upto") > F.col("_budget")).groupBy("_s").agg(F.min(F.struct("b", (F.col("upto") - F.col("n")).alias("before"), "docs")).alias("e"))
        # where no bucket goes over, all of this level is below the cut
        past = F.shiftleft(F.shiftright("cut", shift + bits) + 1, shift + bits)
        cuts = cuts.join(edge, cuts.source.eqNullSafe(F.col("_s")), "left").select("source", (F.col("budget") - F.coalesce("e.before", F.lit(0))).alias("budget"), F.coalesce(F.shiftleft(F.col("e.b"), shift), past).alias("cut"), F.col("e.b").alias("b"), F.col("e.docs").alias("docs"))
        cuts = written(cuts, "mix-cuts")
        # a boundary bucket of one document is refined already: that document goes over the budget
        open_ = F.lit(not last) & F.col("b").isNotNull() & (F.col("docs") > 1)
        done.append(cuts.filter(~open_).select("source", "cut"))
        cuts = cuts.filter(open_)
        if last or not cuts.take(1):
            break
        at = cuts.select(F.col("source").alias("_s"), F.col("b").alias("_b"))
        left = written(left.join(at, left.source.eqNullSafe(F.col("_s")) & (bucket == F.col("_b")), "left_semi"), "mix-left")
        cuts = cuts.drop("b", "docs")
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out


def thresholds(sized: DataFrame, targets: DataFrame) -> DataFrame:
    """targets with `base` (whole epochs of every document), `cut` (hashes below it are taken once more) and, for the
    words that the first document beyond the cut leaves open, `gap` and `cut2`: documents of at most `gap` words with
    a hash below cut2 are taken too."""
    full = F.floor(F.col("target") / F.greatest(F.col("source_size"), F.lit(1)))
    t = targets.withColumn("base", full.cast("long")).withColumn("budget", F.col("target") - F.col("base") * F.col("source_size"))
    rows = sized.select("source", "h", "size")
    t = _with_cut(t, cuts_for(rows, t.select("source", "budget")), "cut")
    key = lambda x: x.select(F.col("source").alias("_s"), *[F.col(c).alias(f"_{c}") for c in x.columns if c != "source"])
    below = rows.join(key(t.select("source", "cut")), F.col("source").eqNullSafe(F.col("_s"))).filter("h < _cut").groupBy("source").agg(F.sum("size").alias("got"))
    t = t.join(key(below), F.col("source").eqNullSafe(F.col("_s")), "left").drop("_s").withColumn("gap", F.col("budget") - F.coalesce("_got", F.lit(0))).drop("_got")
    t = written(t, "mix-gaps")
    small = rows.join(key(t.select("source", "cut", "gap")), F.col("source").eqNullSafe(F.col("_s"))).filter("h >= _cut and size <= _gap")
    small = written(small.select("source", "h", "size"), "mix-small")
    t = _with_cut(t, cuts_for(small, t.select("source", F.col("gap").alias("budget"))), "cut2")
    return t.select("source", "source_size", "target", "base", "cut", "gap", "cut2")


def _with_cut(t: DataFrame, cuts: DataFrame, name: str) -> DataFrame:
    c = cuts.select(F.col("source").alias("_s"), F.col("cut").alias(name))
    return t.join(c, F.col("source").eqNullSafe(F.col("_s")), "left").drop("_s")


def plan(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The sized documents (doc_id, source, size, h) and the thresholds by source."""
    sized = written(docs.select("doc_id", "source", n_words(F.col("text")).alias("size"), mix_hash(F.col("doc_id")).alias("h")), "mix-sizes")
    totals = written(sized.groupBy("source").agg(F.sum("size").alias("source_size")), "mix-sources")
    return sized, written(thresholds(sized, source_targets(totals)), "mix-plan")


def with_plan(rows: DataFrame, cuts: DataFrame) -> DataFrame:
    """The plan has a row per source. Spark broadcasts it if it measures it as small, else it splits hot sources."""
    return rows.join(cuts.withColumnRenamed("source", "_s"), F.col("source").eqNullSafe(F.col("_s")), "left").drop("_s")


TIMES = "least(base + if(h < cut or (size <= gap and h < cut2), 1, 0), greatest(ceil(target / greatest(source_size, 1)), 1))"


def taken(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, size, source_size, target, taken."""
    sized, cuts = plan(docs)
    return with_plan(sized, cuts).select("doc_id", "size", "source_size", "target", F.expr(f"cast(size * ({TIMES}) as bigint)").alias("taken"))


def mix(docs: DataFrame) -> DataFrame:
    """The documents as the mix takes them, repeats as repeated rows."""
    _, cuts = plan(docs)
    made = ("base", "cut", "gap", "cut2", "target", "source_size", "h", "size")
    src, times, n, *own = free(docs, "_src", "_times", "_n", *(f"_{c}" for c in made))
    of = dict(zip(made, own))
    cuts = cuts.select(F.col("source").alias(src), *[F.col(c).alias(of[c]) for c in made[:6]])
    rows = docs.join(cuts, F.col("source").eqNullSafe(F.col(src)), "left").withColumns({of["h"]: mix_hash(F.col("doc_id")), of["size"]: n_words(F.col("text"))})
    rows = rows.withColumn(times, F.expr(re.sub(r"\b(" + "|".join(made) + r")\b", lambda m: of[m[0]], TIMES)).cast("long")).filter(F.col(times) > 0)
    return rows.withColumn(n, F.explode(F.sequence(F.lit(1).cast("long"), F.col(times)))).select(*columns_of(docs))
