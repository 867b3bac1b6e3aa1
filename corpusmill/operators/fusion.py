"""Fusion of ranked lists. Sources are stacked and summed by query and chunk: one shuffle, and no outer join."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .ranking import DIGITS, ranked

#: Below this a spread counts as none.
FLAT = 1.1920929e-07
RRF_K = 60
CANDIDATES = 50


def min_max(score: Column, over) -> Column:
    low, spread = F.min(score).over(over), F.max(score).over(over) - F.min(score).over(over)
    return F.when(spread < FLAT, 1.0).otherwise((score - low) / spread)


def z_score(score: Column, over) -> Column:
    std = F.stddev_pop(score).over(over)
    return F.when(std < FLAT, 0.0).otherwise((score - F.avg(score).over(over)) / std)


def by_query():
    return W.partitionBy("query_id")


def _summed(parts: list[DataFrame]) -> DataFrame:
    return ranked(reduce(DataFrame.unionByName, parts).groupBy("query_id", "chunk_id").agg(F.sum("part").alias("score")))


def _parts(lists: list[DataFrame], value) -> list[DataFrame]:
    return [x.select("query_id", "chunk_id", value(i).alias("part")) for i, x in enumerate(lists)]


def rrf(dense: DataFrame, sparse: DataFrame, k: float = RRF_K) -> DataFrame:
    return _summed(_parts([dense, sparse], lambda _: 1 / (F.col("rank") + F.lit(float(k)))))


def linear(dense: DataFrame, sparse: DataFrame, weight: float = 0.5) -> DataFrame:
    """weight times the dense list's min-max score and the rest times the sparse one's; an absent score is 0."""
    w = (weight, 1 - weight)
    return _summed(_parts([dense, sparse], lambda i: min_max(F.col("score"), by_query()) * w[i]))


convex = linear


def dbsf(dense: DataFrame, sparse: DataFrame) -> DataFrame:
    """Sums of z-scores."""
    return _summed(_parts([dense, sparse], lambda _: z_score(F.col("score"), by_query())))


def union(dense: DataFrame, sparse: DataFrame) -> DataFrame:
    """All results, the dense ones first in their order; scores are as they were."""
    both = dense.select("query_id", "chunk_id", F.lit(0).alias("source"), "rank", "score").unionByName(sparse.select("query_id", "chunk_id", F.lit(1).alias("source"), "rank", "score"))
    first = both.groupBy("query_id", "chunk_id").agg(F.min(F.struct("source", "rank", "score")).alias("f"))
    order = by_query().orderBy("f.source", "f.rank", "chunk_id")
    return first.select("query_id", "chunk_id", F.row_number().over(order).alias("rank"), F.col("f.score").alias("score"))


def intersection(dense: DataFrame, sparse: DataFrame) -> DataFrame:
    """Results of both lists, with the mean score."""
    both = dense.select("query_id", "chunk_id", "score").join(sparse.select("query_id", "chunk_id", F.col("score").alias("other")), ["query_id", "chunk_id"])
    return ranked(both.select("query_id", "chunk_id", ((F.col("score") + F.col("other")) / 2).alias("score")), digits=DIGITS + 1)


def three_way(dense: DataFrame, sparse: DataFrame, multi: DataFrame, weights: tuple[float, float, float] = (0.4, 0.3, 0.3)) -> DataFrame:
    return _summed(_parts([dense, sparse, multi], lambda i: min_max(F.col("score"), by_query()) * weights[i]))


STRATEGIES = {"rrf": rrf, "linear": linear, "convex": convex, "dbsf": dbsf, "union": union, "intersection": intersection}


def strategy(name: str):
    """The strategies that a command line may name."""
    if name not in ("rrf", "linear", "dbsf"):
        raise ValueError(f"unknown fusion strategy {name!r}")
    return STRATEGIES[name]


def fuse(name: str, dense: DataFrame, sparse: DataFrame, **options) -> DataFrame:
    """Two lists by strategy; three_way on two lists is rrf."""
    return rrf(dense, sparse) if name == "three_way" else STRATEGIES[name](dense, sparse, **options)


def fuse_three(name: str, dense: DataFrame, sparse: DataFrame, multi: DataFrame, **options) -> DataFrame:
    """Three lists at once by three_way, or two after two by any other strategy."""
    if name == "three_way":
        return three_way(dense, sparse, multi, **options)
    return fuse(name, fuse(name, dense, sparse, **options), multi, **options)


def hybrid(dense: DataFrame, sparse: DataFrame, k: int = 10, name: str = "rrf", **options) -> DataFrame:
    """The k best after fusion, with the scores of both sources."""
    top = fuse(name, dense, sparse, **options).filter(F.col("rank") <= k)
    scores = dense.select("query_id", "chunk_id", F.col("score").alias("dense_score"), F.lit(None).cast("double").alias("sparse_score"))
    scores = scores.unionByName(sparse.select("query_id", "chunk_id", F.lit(None).cast("double").alias("dense_score"), F.col("score").alias("sparse_score")))
    scores = scores.groupBy("query_id", "chunk_id").agg(F.max("dense_score").alias("dense_score"), F.max("sparse_score").alias("sparse_score"))
    return top.join(scores, ["query_id", "chunk_id"], "left").select("query_id", "chunk_id", "rank", "score", "dense_score", "sparse_score")
