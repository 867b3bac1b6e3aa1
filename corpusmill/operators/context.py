"""Context assembly: results to chunks within a token budget, with citations.

Input: (query_id, chunk_id, doc_id, rank, score, content, title).
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as X

BUDGET = 4096


def sequential(results: DataFrame, budget: int = BUDGET, cite: bool = True) -> DataFrame:
    """Results in order up to the first that does not fit, with citation_id and the tokens so far. Sums only grow, so what fits is
    a running sum within the budget."""
    so_far = F.sum(X.token_estimate(F.col("content"))).over(W.partitionBy("query_id").orderBy("rank").rowsBetween(W.unboundedPreceding, 0))
    kept = results.withColumn("running_tokens", so_far).filter(F.col("running_tokens") <= budget)
    return kept.withColumn("citation_id", F.col("rank") if cite else F.lit(0))


interleaved = sequential


def grouped(results: DataFrame, budget: int = BUDGET, cite: bool = True) -> DataFrame:
    """Document by document, in the order of their best ranks. Within a document the first chunk that does not fit ends it; the
    next document goes on with what is left. A query's results are few: those that its retriever ranked."""
    tokens = results.withColumns({"_t": X.token_estimate(F.col("content")), "_first": F.min("rank").over(W.partitionBy("query_id", "doc_id"))})
    rows = tokens.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("_first", "rank", "_t", "chunk_id"))).alias("r"))

    @F.pandas_udf("array<struct<rank:int,citation_id:int,running_tokens:long>>")
    def fits(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for lists in batches:
            out = []
            for items in lists:
                used, ended, kept = 0, None, []
                for x in items:
                    if x["_first"] == ended:
                        continue
                    if used + x["_t"] > budget:
                        ended = x["_first"]
                        continue
                    used += x["_t"]
                    kept.append({"rank": x["rank"], "citation_id": len(kept) + 1 if cite else 0, "running_tokens": used})
                out.append(kept)
            yield pd.Series(out, dtype="object")

    kept = rows.select("query_id", F.inline(fits("r")))
    return results.join(kept, ["query_id", "rank"])


def rendered(kept: DataFrame) -> DataFrame:
    """(query_id, context, plain, citations, total_tokens): texts with their numbers, without, and the list of titles."""
    items = F.array_sort(F.collect_list(F.struct("citation_id", "rank", "content", "title")))
    rows = kept.groupBy("query_id").agg(items.alias("c"), F.sum(X.token_estimate(F.col("content"))).alias("total_tokens"))
    number = lambda x: F.concat(F.lit("["), x["citation_id"].cast("string"), F.lit("]"))
    join = lambda f, by: F.array_join(F.transform("c", f), by)
    return rows.select(
        "query_id", join(lambda x: F.concat_ws(" ", x["content"], number(x)), "\n\n").alias("context"), join(lambda x: x["content"], "\n\n").alias("plain"),
        join(lambda x: F.concat_ws(" ", number(x), F.coalesce(x["title"], F.lit("Untitled"))), "\n").alias("citations"), "total_tokens",
    )
