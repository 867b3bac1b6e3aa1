import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest

from corpusmill.llm import toxicity

DOCS = "doc_id long, text string, lang string, score string, evidence string"


def fixture():
    rnd = random.Random(6)
    clean = [f"calm{i}" for i in range(80)]
    foul = [f"nasty{i}" for i in range(12)]
    docs, labels = [], []
    for i in range(600):
        bad = i % 6 == 0
        w = [rnd.choice(clean) for _ in range(40)] + [rnd.choice(foul) for _ in range(3)] * bad
        docs.append((i, " ".join(w)))
        if i % 4:
            labels.append((i, int(bad)))
    docs += [(900, None), (901, ""), (902, "unseen words only"), (903, "calm1 " * 50000 + "nasty1 nasty2"), (None, "no id"), (3, docs[3][1]), (3, "another text of id three")]
    labels += [(900, 0), (901, 0), (1, None), (None, 1), (5000, 1), (3, 0), (3, 1)]
    return [(*d, "en", "clash", "clash") for d in docs], labels


def test_scores(spark):
    docs, labels = fixture()
    d, lab = spark.createDataFrame(docs, DOCS).repartition(4), spark.createDataFrame(labels, "doc_id long, toxic int")
    got = toxicity.report(d, lab).collect()
    assert len(got) == len(docs)
    for r in got:
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5)
        if r.doc_id is not None:
            assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
    held = [(r.predicted, int(r.doc_id % 6 == 0)) for r in got if r.held_out and r.doc_id is not None and r.doc_id < 600 and r.doc_id != 3]
    assert sum(a == b for a, b in held) / len(held) > 0.97
    assert any(r.evidence and r.evidence[0].label == 1 for r in got)
    assert all(zlib.crc32(str(e.doc_id).encode()) % 5 for r in got for e in r.evidence)


def test_neighbours_are_exact(spark):
    docs, labels = fixture()
    d = spark.createDataFrame(docs, DOCS)
    index = toxicity.learn(d, spark.createDataFrame(labels, "doc_id long, toxic int"))
    texts = {}
    for i, t, *_ in docs:
        texts[i] = min(texts.get(i, t) or "", t or "") if i in texts else t
    sample = {i for i, y in labels if y is not None and i in texts and zlib.crc32(str(i).encode()) % 5}
    held = Counter(t for i in sample for t in toxicity.terms(texts[i]))
    df = Counter(t for _, x, *_ in docs for t in toxicity.terms(x))

    def vector(text):
        w = {t: n * (math.log((1 + len(docs)) / (1 + df[t])) + 0.1) for t, n in toxicity.terms(text).items() if held[t] >= toxicity.SUPPORT}
        norm = math.sqrt(sum(x * x for x in w.values()))
        return {t: x / norm for t, x in w.items()}

    own = {int(i): vector(texts[int(i)]) for i in index.ids}
    assert set(own) == {i for i in sample if vector(texts[i])}
    for text in [docs[0][1], docs[1][1], docs[603][1], "calm5 nasty3 unknown", "nasty1 " * 9 + "calm2 calm3"]:
        at, cos = index.nearest(*index.vector(text))
        v = vector(text)
        full = {i: sum(v.get(t, 0) * x for t, x in e.items()) for i, e in own.items()}
        best = sorted(full.values(), reverse=True)[: toxicity.K]
        assert np.allclose(cos, [x for x in best if x > 0], atol=1e-5)
        assert np.allclose([full[int(index.ids[k])] for k in at], cos, atol=1e-5)


@pytest.mark.parametrize("seed", range(4))
def test_bounds_lose_no_neighbour(seed):
    """Many examples and short steps, so lists are left out and blocks are passed over."""
    rnd = np.random.default_rng(seed)
    vocab, n = [f"w{i:03}" for i in range(300)], 900
    make = lambda: (lambda t: (t, rnd.integers(1, 9, len(t))))(np.unique((rnd.random(rnd.integers(1, 60)) ** 3 * 300).astype(int)))
    idf = rnd.random(300) * 5 + 0.1
    examples = [(i, int(rnd.random() < 0.2), *make()) for i in range(n)]
    index = toxicity.Index(vocab, idf, examples, (1.0, 1.0))
    dense = np.zeros((n, 300))
    for k in range(n):
        t, w = index.own(k)
        dense[k, t] = w
    step, toxicity.STEP = toxicity.STEP, 256
    try:
        for k in range(0, n, 9):
            t, w = index.own(k)
            cos = dense @ dense[k]
            cos[k] = -1
            at, got = index.nearest(t, w, skip=k)
            assert k not in at and np.allclose(got, np.sort(cos)[::-1][: len(got)], atol=1e-5) and (len(got) == toxicity.K or (cos > 1e-6).sum() == len(got))
    finally:
        toxicity.STEP = step


def test_vectors_are_tf_idf():
    idf = np.array([1.0, 2.0])
    index = toxicity.Index(["aa", "bb"], idf, [(1, 1, [0, 1], [2, 1]), (2, 0, [0], [1])], (1.0, 1.0))
    t, w = index.vector("aa bb aa")
    raw = [2 * 1.0, 2.0]
    assert t.tolist() == [0, 1] and np.allclose(w, np.array(raw) / math.hypot(*raw))


def test_without_labels(spark):
    docs, labels = fixture()
    d = spark.createDataFrame(docs, DOCS)
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert {r.score for r in toxicity.report(d, none).collect()} == {0.0}
    assert toxicity.report(d.limit(0), spark.createDataFrame(labels, "doc_id long, toxic int")).collect() == []
