"""Retrieval metrics. Ranked lists are marked as relevant by one join and reduced by query; nothing is collected.

`relevant` is (query_id, chunk_id). Queries with neither results nor relevant chunks are unknown here.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import round4

KS = (1, 3, 5, 10)


def marked(results: DataFrame, relevant: DataFrame) -> DataFrame:
    """results with hit (relevant), again (a relevant chunk seen before) and hits (relevant results so far)."""
    rel = relevant.select("query_id", "chunk_id").distinct().withColumn("hit", F.lit(True))
    rows = results.join(rel, ["query_id", "chunk_id"], "left").withColumn("hit", F.coalesce("hit", F.lit(False)))
    seen = F.row_number().over(W.partitionBy("query_id", "chunk_id").orderBy("rank")) > 1
    so_far = F.sum(F.col("hit").cast("int")).over(W.partitionBy("query_id").orderBy("rank").rowsBetween(W.unboundedPreceding, 0))
    return rows.withColumn("again", seen & F.col("hit")).withColumn("hits", so_far)


def ideal(n: Column) -> Column:
    """Discounted gain of n relevant results in front."""
    return F.aggregate(F.sequence(F.lit(1), F.greatest(n, F.lit(1)).cast("int")), F.lit(0.0), lambda s, r: s + F.when(r <= n, 1 / F.log2(r + 1.0)).otherwise(0.0))


def _gain() -> Column:
    return 1 / F.log2(F.col("rank") + 1.0)


def per_query(results: DataFrame, relevant: DataFrame, ks: tuple[int, ...] = KS, total: DataFrame | None = None) -> DataFrame:
    """(query_id, metric, k, value): recall, precision, ndcg, f1 and hit at each k; mrr and ap with k null.

    Where all pairs of relevant are many, `total` (query_id, total) counts them for every query that has one, and `relevant` may be
    those among the results.
    """
    rows = marked(results, relevant)
    new = F.col("hit") & ~F.col("again")
    aggs = [F.min(F.when(F.col("hit"), F.col("rank"))).alias("first"), F.sum(F.when(F.col("hit"), F.col("hits") / F.col("rank")).otherwise(0.0)).alias("ap")]
    for k in ks:
        inside = new & (F.col("rank") <= k)
        aggs += [F.sum(inside.cast("int")).alias(f"n{k}"), F.sum(F.when(inside, _gain()).otherwise(0.0)).alias(f"g{k}")]
    found = rows.groupBy("query_id").agg(*aggs)
    if total is None:
        total = relevant.select("query_id", "chunk_id").distinct().groupBy("query_id").agg(F.count("*").alias("total"))
    q = found.join(total, "query_id", "full").withColumn("total", F.coalesce("total", F.lit(0)))
    n = lambda k: F.coalesce(f"n{k}", F.lit(0))
    value = lambda name, k, v: F.struct(F.lit(name).alias("metric"), F.lit(k).cast("int").alias("k"), F.coalesce(v, F.lit(0.0)).cast("double").alias("value"))
    some = F.col("total") > 0
    out = [value("mrr", None, 1 / F.col("first")), value("ap", None, F.when(some, F.col("ap") / F.col("total")))]
    for k in ks:
        recall, precision = F.when(some, n(k) / F.col("total")).otherwise(0.0), n(k) / F.lit(k)
        best = ideal(F.least("total", F.lit(k)))
        out += [
            value("recall", k, recall), value("precision", k, precision), value("ndcg", k, F.when(best > 0, F.col(f"g{k}") / best)),
            value("f1", k, F.when(recall + precision > 0, 2 * precision * recall / (precision + recall))), value("hit", k, (n(k) > 0).cast("double")),
        ]
    return q.select("query_id", F.inline(F.array(*out)))


def aggregated(values: DataFrame) -> DataFrame:
    """(metric, k, value, query_count): means over all queries."""
    return values.groupBy("metric", "k").agg(F.avg("value").alias("value"), F.count("*").alias("query_count"))


#: The evaluation's metrics: other formulas than above, after judgments and not a set of relevant chunks.
EVAL = ("mrr", "ndcg_5", "ndcg_10", "recall_5", "precision_5", "hit_rate_5", "hit_rate_10", "map")


def judged(results: DataFrame, judgments: DataFrame) -> DataFrame:
    """(query, domain, rank, ...) with `relevant`: the last judgment of (query, rank) by seq; unjudged is not relevant."""
    last = judgments.groupBy("query", "rank").agg(F.max_by("relevant", "seq").alias("relevant"))
    return results.join(last, ["query", "rank"], "left").withColumn("relevant", F.coalesce("relevant", F.lit(False)))


def eval_per_query(rows: DataFrame) -> DataFrame:
    """One row per (query, domain): results judged relevant count as all that there are."""
    r, rel = F.col("rank"), F.col("relevant")
    so_far = F.sum(rel.cast("int")).over(W.partitionBy("query", "domain").orderBy("rank").rowsBetween(W.unboundedPreceding, 0))
    rows = rows.withColumn("_n", so_far)
    n_in = lambda k: F.sum((rel & (r <= k)).cast("int"))
    ndcg = lambda k: F.sum(F.when(rel & (r <= k), _gain()).otherwise(0.0))
    q = rows.groupBy("query", "domain").agg(
        F.min(F.when(rel, r)).alias("_first"), F.sum(rel.cast("int")).alias("relevant_count"), F.count("*").alias("total_results"), n_in(5).alias("_n5"), n_in(10).alias("_n10"),
        ndcg(5).alias("_g5"), ndcg(10).alias("_g10"), F.sum(F.when(rel, F.col("_n") / r).otherwise(0.0)).alias("_ap"), F.max("latency_s").alias("latency_s"),
    )
    over = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    return q.select(
        "query", "domain", F.coalesce(1 / F.col("_first"), F.lit(0.0)).alias("mrr"), over(F.col("_g5"), ideal(F.col("_n5"))).alias("ndcg_5"), over(F.col("_g10"), ideal(F.col("_n10"))).alias("ndcg_10"),
        (F.col("_n5") / F.greatest("relevant_count", F.lit(1))).alias("recall_5"), over(F.col("_n5"), F.least("total_results", F.lit(5))).alias("precision_5"),
        (F.col("_n5") > 0).cast("double").alias("hit_rate_5"), (F.col("_n10") > 0).cast("double").alias("hit_rate_10"), over(F.col("_ap"), F.col("relevant_count")).alias("map"),
        "relevant_count", "total_results", "latency_s",
    )


def eval_aggregate(queries: DataFrame) -> DataFrame:
    """A row for each domain and one for all (domain null), in one pass over grouping sets; four digits."""
    means = [round4(F.avg(m)).alias(m) for m in EVAL]
    return queries.rollup("domain").agg(F.count("*").alias("num_queries"), *means, round4(F.avg("latency_s")).alias("mean_latency_s"))


def compared(baseline: DataFrame, candidate: DataFrame) -> DataFrame:
    """(metric, baseline, candidate, delta, arrow) of two aggregates, both of one row."""
    long = lambda t, name: t.select(F.inline(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).alias(name)) for m in EVAL])))
    delta = F.col("candidate") - F.col("baseline")
    rows = long(baseline, "baseline").join(long(candidate, "candidate"), "metric")
    return rows.withColumn("delta", round4(delta)).withColumn("arrow", F.when(delta > 0.001, "^").when(delta < -0.001, "v").otherwise("="))


def gate(aggregate: DataFrame, min_mrr: float = 0.5, min_hit: float = 0.7) -> DataFrame:
    """(metric, value, least): what fails the gate."""
    checks = F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).alias("value"), F.lit(float(x)).alias("least")) for m, x in (("mrr", min_mrr), ("hit_rate_5", min_hit))])
    return aggregate.select(F.inline(checks)).filter("value < least")


def kendall_tau(pairs: DataFrame) -> DataFrame:
    """(query_id, id, x, y) to (query_id, tau): concordant less discordant over both, ties left out, 1 where there are none.

    Lists are short; a query's pairs are made inside its own row.
    """
    rows = pairs.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("id", "x", "y"))).alias("p"))
    sign = lambda a, b: F.signum((a["x"] - b["x"]) * (a["y"] - b["y"]))
    signs = F.flatten(F.transform("p", lambda a: F.transform(F.filter("p", lambda b: b["id"] > a["id"]), lambda b: sign(a, b))))
    rows = rows.select("query_id", signs.alias("s"))
    c, d = F.size(F.filter("s", lambda x: x > 0)), F.size(F.filter("s", lambda x: x < 0))
    return rows.select("query_id", F.when(c + d > 0, (c - d) / (c + d)).otherwise(1.0).alias("tau"))
