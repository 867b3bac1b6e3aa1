"""Exact vector search of a query batch against all vectors.

Queries come in blocks of bounded size. A block goes to the tasks with the code; each Arrow batch of vectors meets it in tiles of
bounded size, and a task keeps the k best for each query and no more (`topk`). So memory follows queries and k, and what is
shuffled follows queries, k and tasks, not the number of pairs, whose products remain the work.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import vectors as V
from . import topk as K
from .ranking import ranked

#: Values in a block of query vectors: 32 MB.
BLOCK_VALUES = 1 << 22


def checked(vectors: DataFrame, dimension: int) -> DataFrame:
    """(chunk_id, vec) with `valid`: there is a vector of this dimension without nulls."""
    return vectors.withColumn("valid", F.coalesce((F.size("vec") == dimension) & ~F.exists("vec", lambda x: x.isNull()), F.lit(False)))


def top_in_task(batches: Iterator[pd.DataFrame], ids: list, queries: np.ndarray, k: int, metric: str) -> Iterator[pd.DataFrame]:
    """A task's k best rows for each query."""
    ready = V.unit_rows if metric == "cosine" else lambda m: m
    score = V.METRICS["dot" if metric == "cosine" else metric]
    queries, (step, width) = ready(queries), K.TILE
    starts = range(0, len(queries), step)
    best = [K.Best(len(queries[i : i + step]), k) for i in starts]
    for b in batches:
        if not len(b):
            continue
        vectors, chunk = ready(V.matrix(b["vec"])), b["chunk_id"].to_numpy()
        for j in range(0, len(b), width):
            for i, own in zip(starts, best):
                own.add(score(queries[i : i + step], vectors[j : j + width]), chunk[j : j + width])
    for i, own in zip(starts, best):
        if (rows := own.rows(ids[i : i + step])) is not None:
            yield rows


def search(vectors: DataFrame, queries: DataFrame, k: int = 10, metric: str = "cosine") -> DataFrame:
    """(chunk_id, vec) and (query_id, vec) to a ranked list. euclidean scores are negative distances.

    Vectors whose length differs from the queries' are an error; rows without a vector are left out.
    """
    if metric not in V.METRICS:
        raise ValueError(f"unknown metric {metric!r}")
    kinds = {f.name: f.dataType.simpleString() for f in [*vectors.schema.fields, *queries.schema.fields]}
    schema = f"query_id {kinds['query_id']}, chunk_id {kinds['chunk_id']}, score double"
    rows = K.dealt(vectors.filter(F.col("vec").isNotNull()).select("chunk_id", "vec"), "chunk_id").select("chunk_id", F.col("vec").cast("array<double>").alias("vec"))
    parts, ids, block, width = [], [], [], 0

    def close() -> None:
        if ids:
            q = np.array(block, np.float64)
            parts.append(rows.mapInPandas(lambda b, i=list(ids), q=q: top_in_task(b, i, q, k, metric), schema))
            ids.clear()
            block.clear()

    for r in queries.filter(F.col("vec").isNotNull()).select("query_id", F.col("vec").cast("array<double>").alias("vec")).orderBy("query_id").toLocalIterator():
        width = width or len(r.vec)
        if len(r.vec) != width:
            raise ValueError(f"query {r.query_id} has {len(r.vec)} values, not {width}")
        ids.append(r.query_id)
        block.append(r.vec)
        if len(block) * width >= BLOCK_VALUES or len(block) >= K.BLOCK_QUERIES:
            close()
    close()
    if not parts:
        return vectors.sparkSession.createDataFrame([], schema.replace("score", "rank int, score"))
    return ranked(reduce(DataFrame.unionByName, parts), k)
