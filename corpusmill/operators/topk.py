"""The k best rows of each query inside a task.

Scores are made in tiles of bounded size, and only those that can still be among the k best are kept. So a task's memory follows its
queries and k, not the number of pairs, and what leaves it is k rows for each query.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from .ranking import DIGITS

#: Queries and rows of a tile of scores: 8 MB.
TILE = 256, 4096
#: Queries in a block, which a task holds with the k best of each.
BLOCK_QUERIES = 1 << 15
TASKS_A_CORE = 2


def dealt(rows: DataFrame, key: str) -> DataFrame:
    """Rows by key to a few tasks for each core: every task makes k rows for each query."""
    return rows.repartition(max(rows.sparkSession.sparkContext.defaultParallelism, 1) * TASKS_A_CORE, key)


class Best:
    """The k best of some queries, by rounded score and then by id. NaN counts as the best, as Spark orders it; -inf is no score."""

    def __init__(self, queries: int, k: int):
        self.n, self.k = queries, k
        self.least = np.full(queries, -np.inf)
        self.open = True
        self.row, self.score, self.id, self.size = [], [], [], 0

    def add(self, scores: np.ndarray, ids: np.ndarray) -> None:
        """Scores [queries, ids] before rounding."""
        if not scores.size:
            return
        least = self.least
        if self.open and scores.shape[1] > self.k:
            least = np.maximum(least, _key(np.partition(scores, scores.shape[1] - self.k, axis=1)[:, -self.k]))
        # a score below the least by less than half a digit may round up to it
        at = np.flatnonzero(~(scores < (least - 10.0**-DIGITS)[:, None]))
        if not len(at):
            return
        row, column = np.divmod(at, scores.shape[1])
        score = np.round(scores.ravel()[at], DIGITS) + 0.0
        held = ~(score < self.least[row]) & ~np.isneginf(score)
        self.row.append(row[held])
        self.score.append(score[held])
        self.id.append(ids[column[held]])
        self.size += int(held.sum())
        if self.open or self.size > 2 * self.n * self.k + TILE[1]:
            self._cut()

    def _cut(self) -> None:
        if not self.size:
            return
        row, score, ids = np.concatenate(self.row), np.concatenate(self.score), np.concatenate(self.id)
        order = np.lexsort((ids if ids.dtype != object else np.unique(ids, return_inverse=True)[1], -_key(score), row))
        row = row[order]
        first = np.searchsorted(row, np.arange(self.n))
        place = np.arange(len(row)) - first[row]
        kept = order[place < self.k]
        last = place == self.k - 1
        self.least[row[last]] = _key(score[order[last]])
        self.open = bool(np.isneginf(self.least).any())
        self.row, self.score, self.id, self.size = [row[place < self.k]], [score[kept]], [ids[kept]], len(kept)

    def rows(self, ids: list) -> pd.DataFrame | None:
        self._cut()
        if not self.size:
            return None
        return pd.DataFrame({"query_id": np.array(ids)[self.row[0]], "chunk_id": self.id[0], "score": self.score[0]})


def _key(score: np.ndarray) -> np.ndarray:
    return np.where(np.isnan(score), np.inf, score)


def runs(sizes: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Ranges of neighbours of `most` in all, or of a single one."""
    start = held = 0
    for i, n in enumerate(sizes):
        if i > start and held + n > most:
            yield start, i
            start, held = i, 0
        held += n
    if len(sizes) > start:
        yield start, len(sizes)


def _even(counts: np.ndarray) -> int:
    """The count that all have, if it is a small one, or 0."""
    return int(counts[0]) if len(counts) and counts[0] <= 16 and (counts == counts[0]).all() else 0


def best_of_tokens(products: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """[x, tokens of all chunks] to [x, chunks]: each chunk's best token. Every chunk has one at least."""
    if n := _even(counts):
        out = products[:, ::n].copy()
        for i in range(1, n):
            np.maximum(out, products[:, i::n], out=out)
        return out
    return np.maximum.reduceat(products, np.concatenate([[0], np.cumsum(counts)[:-1]]), axis=1)


def sum_of_tokens(best: np.ndarray, counts: np.ndarray, partial: bool = False) -> np.ndarray:
    """[tokens of all queries, chunks] to [queries, chunks]. With `partial`, tokens at -inf add nothing, and a chunk that no token
    has met stays at -inf."""
    starts = np.concatenate([[0], np.cumsum(counts)[:-1]])
    if not partial or not np.isneginf(best).any():
        return np.add.reduceat(best, starts, axis=0)
    met = np.maximum.reduceat(best, starts, axis=0)
    return np.where(np.isneginf(met), -np.inf, np.add.reduceat(np.where(np.isneginf(best), 0.0, best), starts, axis=0))
