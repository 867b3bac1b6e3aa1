import numpy as np

from corpusmill.llm import toxicity


def test_near_examples_are_not_read_whole_where_lists_are_shorter(monkeypatch):
    """Of each text the rows of all near examples, long ones most often, used to be read: 120,000 entries a text on check_s."""
    rnd = np.random.default_rng(5)
    vocab, n = [f"w{i:04}" for i in range(2000)], 900
    make = lambda size: (lambda t: (t, rnd.integers(1, 5, len(t))))(np.unique(rnd.integers(0, 2000, size)))
    index = toxicity.Index(vocab, rnd.random(2000) * 5 + 0.1, [(i, int(rnd.random() < 0.2), *make(100)) for i in range(n)], (1.0, 1.0))
    dense = np.zeros((n, 2000))
    for k in range(n):
        t, w = index.own(k)
        dense[k, t] = w
    lists, read = toxicity._lists, []

    def seen(ptr, keys):
        out = lists(ptr, keys)
        read.append(len(out[0]))
        return out

    monkeypatch.setattr(toxicity, "_lists", seen)
    monkeypatch.setattr(toxicity, "STEP", 64)
    index._frequent()
    for _ in range(50):
        t, counts = make(6)
        t, w = index._vector(t, counts.astype(float))
        read.clear()
        at, got = index.nearest(t, w)
        cos = dense[:, t] @ w
        assert np.allclose(got, np.sort(cos)[::-1][: len(got)], atol=1e-6) and np.allclose(cos[at], got, atol=1e-6)
        assert len(got) == toxicity.K
        assert sum(read) <= 3 * (index.list[t + 1] - index.list[t]).sum()
