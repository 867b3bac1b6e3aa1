"""Ranked lists: (query_id, chunk_id, rank, score), rank from 1, by score and then by chunk_id.

Every retriever makes one, every fusion and reranker takes and makes one. Scores are rounded before they are ranked, so
the order in which partial sums meet cannot change a rank.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

DIGITS = 6


def rounded(score: Column, digits: int = DIGITS) -> Column:
    return F.round(score, digits) + F.lit(0.0)


def ranked(scores: DataFrame, k: int | None = None, *carry: str, digits: int = DIGITS) -> DataFrame:
    """(query_id, chunk_id, score) to a ranked list of the k best; `carry` names columns to keep. The limit is applied in
    each partition before the shuffle."""
    order = W.partitionBy("query_id").orderBy(F.col("score").desc(), F.col("chunk_id"))
    scores = scores.withColumn("score", rounded(F.col("score"), digits)).withColumn("rank", F.row_number().over(order))
    return (scores if k is None else scores.filter(F.col("rank") <= k)).select("query_id", "chunk_id", "rank", "score", *carry)


def best_score() -> Column:
    """The most refined score that a result has."""
    return F.coalesce("rerank_score", "fused_score", "multivector_score", "dense_score", "sparse_score", F.lit(0.0))
