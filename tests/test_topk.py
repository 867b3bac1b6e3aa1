"""The k best of each query in tiles of bounded size (F2, F4, F5, F7 and F10 to F23 of FINDINGS_r03)."""

import tracemalloc

import numpy as np
import pandas as pd
import pytest

from corpusmill.operators import dense as D
from corpusmill.operators import metrics as M
from corpusmill.operators import multivector as MV
from corpusmill.operators import topk as K


def peak(rows) -> float:
    tracemalloc.start()
    try:
        n = sum(len(x) for x in rows)
        return n, tracemalloc.get_traced_memory()[1] / 1e6
    finally:
        tracemalloc.stop()


@pytest.mark.parametrize("metric", ["cosine", "dot", "euclidean"])
def test_dense_memory_follows_queries(metric):
    rng = np.random.default_rng(1)
    batch = pd.DataFrame({"chunk_id": np.arange(10_000), "vec": list(rng.normal(size=(10_000, 4)))})
    n, mb = peak(D.top_in_task(iter([batch, batch.assign(chunk_id=batch["chunk_id"] + 10_000)]), list(range(3000)), rng.normal(size=(3000, 4)), 10, metric))
    assert n == 30_000 and mb < 100, mb  # all scores of a batch are 240 MB


def test_maxsim_memory_follows_queries():
    rng = np.random.default_rng(1)
    batch = pd.DataFrame({"chunk_id": np.arange(10_000), "tokens": list(rng.normal(size=(10_000, 4, 2)))})
    n, mb = peak(MV._best_of_chunks(iter([batch]), 10, list(range(500)), rng.normal(size=(2000, 2)), np.full(500, 4)))
    assert n == 5000 and mb < 100, mb  # all products of a batch are 640 MB


@pytest.mark.parametrize("names", [np.arange, lambda n: np.array([f"c{i:03}" for i in range(n)], object)])
def test_best_is_a_whole_sort(names):
    """Ties by id over many batches, missing scores, NaN, fewer rows than k."""
    rng = np.random.default_rng(3)
    ids, score = names(600), rng.integers(0, 40, (5, 600)) / 7 + rng.uniform(-1, 1, (5, 600)) * 1e-8
    score[1] = 1.0
    score[2, :597] = -np.inf
    score[3, [5, 500]] = np.nan
    for k in (1, 7, 700):
        best = K.Best(5, k)
        for at in np.array_split(rng.permutation(600), 9):
            best.add(score[:, at], ids[at])
        got = best.rows(list("abcde"))
        for q, name in enumerate("abcde"):
            key = np.where(np.isnan(score[q]), np.inf, np.round(score[q], 6))
            want = [i for i in sorted(range(600), key=lambda i: (-key[i], ids[i])) if key[i] > -np.inf][:k]
            mine = got[got.query_id == name]
            assert list(mine.chunk_id) == [ids[i] for i in want] and np.array_equal(mine.score, np.round(score[q, want], 6) + 0.0, equal_nan=True)


def test_inverted_search_makes_no_row_for_a_pair_of_tokens(spark):
    rng = np.random.default_rng(4)
    rows = [(i, t, rng.normal(size=4).tolist()) for i in range(80) for t in range(1 + i % 3)]
    tokens = spark.createDataFrame(rows, "chunk_id int, token_idx int, vec array<double>")
    index = MV.MultiVectorIndex.build(tokens, MV.Codec.train(tokens, 4, 4))
    found = index.search(tokens.filter("chunk_id < 9").withColumnRenamed("chunk_id", "query_id"), MV.SearchConfig(k=5, nprobe=2, threshold=0.1))
    assert "Join" not in found._jdf.queryExecution().optimizedPlan().toString()
    # the same from the lists, pair by pair
    codec, score = index.codec, {}
    held = [(r.centroid_id, r.chunk_id, codec.weights[np.arange(4), codec.unpack(np.frombuffer(r.packed, np.uint8)[None])[0]]) for r in index.lists.collect()]
    for q, t, vec in (r for r in rows if r[0] < 9):
        near = np.round(np.array(vec) @ codec.centroids.T, 9)
        probed, best = [c for c in np.argsort(-near, kind="stable")[:2] if near[c] >= 0.1], {}
        for c, chunk, x in held:
            if c in probed:
                best[chunk] = max(best.get(chunk, -np.inf), near[c] + np.array(vec) @ x)
        for chunk, s in best.items():
            score[q, chunk] = score.get((q, chunk), 0.0) + s
    want = {q: [c for _, c in sorted((-round(s, 6), c) for (p, c), s in score.items() if p == q)[:5]] for q in range(9)}
    got = {q: [] for q in range(9)}
    for r in found.orderBy("query_id", "rank").collect():
        got[r.query_id].append(r.chunk_id)
    assert got == want and any(got.values())


def test_relevant_pairs_are_counted_by_label(spark):
    """All pairs of a label need not be given."""
    results = spark.createDataFrame([(0, 7, 1), (0, 8, 2)], "query_id int, chunk_id int, rank int")
    relevant = spark.createDataFrame([(0, 8)], "query_id int, chunk_id int")
    total = spark.createDataFrame([(0, 4), (1, 2)], "query_id int, total int")
    got = {(r.query_id, r.metric, r.k): r.value for r in M.per_query(results, relevant, (2,), total).collect()}
    assert got[0, "recall", 2] == 0.25 and got[0, "ap", None] == 0.125 and got[1, "recall", 2] == 0.0
