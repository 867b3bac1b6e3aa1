"""Rerankers: (query_id, chunk_id, query, content, ...) to a ranked list by a new score."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions.let import let
from .ranking import ranked


def lexical_score(query: Column, content: Column, exact: float = 0.3, coverage: float = 0.5, position: float = 0.2, ignore_case: bool = True) -> Column:
    """Whole query in the content, share of its terms that occur as substrings, and how early they do; 0 without terms."""
    q, c = (F.lower(query), F.lower(content)) if ignore_case else (query, content)

    def places(s: Column) -> Column:
        at = F.filter(F.transform(F.filter(F.split(s["q"], X.WHITE), lambda w: w != ""), lambda t: F.struct(X.byte_find(s["c"], t).alias("at"))), lambda p: p.isNotNull())
        return F.struct(F.contains(s["c"], s["q"]).cast("double").alias("whole"), at["at"].alias("at"))

    def score(s: Column) -> Column:
        n = F.size(s["at"])
        early = F.aggregate(s["at"], F.lit(0.0), lambda a, p: a + F.when(p.isNotNull(), 1.0 / (1.0 + p / 100.0)).otherwise(0.0))
        return F.when(n > 0, s["whole"] * exact + F.size(F.array_compact(s["at"])) / n * coverage + early / n * position).otherwise(0.0)

    return F.coalesce(let(let(F.struct(q.alias("q"), c.alias("c")), places), score), F.lit(0.0))


def overlap_score(query: Column, content: Column) -> Column:
    """Share of the query's distinct tokens that the content has."""
    q, c = F.array_distinct(X.white_tokens(query)), X.white_tokens(content)
    return F.when(F.size(q) > 0, F.size(F.array_intersect(q, c)) / F.size(q)).otherwise(0.0)


def composite_score(parts: list[tuple[Column, float]]) -> Column | None:
    """Weighted sum of scores, a missing one counting 0; None without parts."""
    total = None
    for score, weight in parts:
        part = F.coalesce(score, F.lit(0.0)) * weight
        total = part if total is None else total + part
    return total


def rerank(candidates: DataFrame, score: Column | None, k: int) -> DataFrame:
    """The k best by score; without a score the k first as they stand."""
    if score is None:
        return candidates.filter(F.col("rank") <= k).select("query_id", "chunk_id", "rank", "score")
    return ranked(candidates.withColumn("score", score), k)


def candidates(found: DataFrame, queries: DataFrame, chunks: DataFrame, pool: int) -> DataFrame:
    """The first `pool` results of each query with query and content."""
    rows = found.filter(F.col("rank") <= pool)
    rows = rows.join(chunks.select("chunk_id", "content"), "chunk_id")
    return rows.join(queries.select("query_id", F.col("text").alias("query")), "query_id")
