import hashlib
import random
import re

import numpy as np
import pytest

from corpusmill.llm import substrings

SCHEMA = "doc_id long, text string, id string, _key string, _at string"


def brute(rows, n=13):
    """(id, n_words, n_removed, sha) by the definition."""
    words = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for _, t in rows]
    rank = lambda i: (i is None, i or 0)
    low = {}
    for (i, _), w in zip(rows, words):
        for at in range(len(w) - n + 1):
            g = tuple(w[at : at + n])
            low[g] = min(low.get(g, rank(i)), rank(i))
    out = []
    for (i, _), w in zip(rows, words):
        gone = set()
        for at in range(len(w) - n + 1):
            if low[tuple(w[at : at + n])] < rank(i):
                gone |= set(range(at, at + n))
        kept = [x for k, x in enumerate(w) if k not in gone]
        out.append((i, len(w), len(gone), hashlib.sha256(" ".join(kept).encode()).hexdigest()))
    return sorted(out, key=str)


def fixture():
    rnd = random.Random(11)
    word = lambda: rnd.choice(["a", "b", "é", "the", "x" * 40, *(f"w{i}" for i in range(300))])
    passages = [[word() for _ in range(n)] for n in (12, 13, 14, 60, 200)]
    rows = []
    for i in range(150):
        w = [word() for _ in range(rnd.choice([0, 5, 13, 80]))]
        for _ in range(rnd.choice([0, 1, 2])):
            at = rnd.randint(0, len(w))
            w[at:at] = rnd.choice(passages)
        rows.append((i * 3 % 150, rnd.choice([" ", "\n", "  \t"]).join(w)))
    rows += [(1000 + i, rows[5][1]) for i in range(40)]  # copies
    rows += [(2000 + i, "same " * 30) for i in range(3)] + [(3000, None), (3001, ""), (3002, " \n"), (None, rows[7][1]), (None, "z " * 20), (4000, "a b " * 20000), (rows[3][0], rows[3][1]), (4001, " ".join(["q"] * 13 + ["r"] + ["q"] * 13))]
    return rows


@pytest.mark.parametrize("block", [1 << 9, 8 << 20])
def test_report_matches_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(substrings, "BLOCK", block)
    rows = fixture()
    df = spark.createDataFrame([(i, t, "clash", "clash", "clash") for i, t in rows], SCHEMA).repartition(6)
    assert sorted((tuple(r) for r in substrings.report(df).collect()), key=str) == brute(rows)


def test_words_decide_where_symbols_do_not(spark, monkeypatch):
    """With every suffix below one node, all windows are candidates and the words alone settle them."""
    monkeypatch.setattr(substrings, "_codes", lambda flat: np.zeros(len(flat) - 13, np.uint64))
    rows = fixture()[:120]
    df = spark.createDataFrame([(i, t, "", "", "") for i, t in rows], SCHEMA).repartition(3)
    assert sorted((tuple(r) for r in substrings.report(df).collect()), key=str) == brute(rows)


def test_long_prefixes_are_split_by_path(spark, monkeypatch):
    monkeypatch.setattr(substrings, "CAPACITY", 100)
    monkeypatch.setattr(substrings, "TABLES", 3)
    monkeypatch.setattr(substrings, "max", lambda *x: 100 if x[0] == 20_000 else max(*x), raising=False)
    rows = fixture()
    df = spark.createDataFrame([(i, t, "", "", "") for i, t in rows], SCHEMA).repartition(3)
    plan = substrings.plan_prefixes(df)
    assert len(plan.tables) <= 3 and any((p > 1).any() for p in plan.parts)
    assert sorted((tuple(r) for r in substrings.report(df).collect()), key=str) == brute(rows)


def test_deep_nodes():
    """Nodes by neighbours' common symbols, against common prefixes of all pairs."""
    rng = np.random.default_rng(1)
    codes = np.concatenate([rng.integers(0, 4, (300, 12)) * (np.arange(12) < 6) @ (16 ** np.arange(11, -1, -1))]).astype(np.uint64)
    for least in (3, 6, 12):
        order, node = substrings.deep_nodes(codes, least)
        top = (codes >> np.uint64(4 * (12 - least)))[order]
        assert all((top[i] == top[j]) == (node[i] == node[j]) for i in range(0, 300, 7) for j in range(0, 300, 5))


def test_maximal_repeats_match_brute_force(spark):
    rows = [r for r in fixture() if r[0] is not None and r[0] < 500]
    df = spark.createDataFrame([(i, t, "", "", "") for i, t in rows], SCHEMA)
    words = [(t or "").split() for _, t in rows]
    low = {}
    for (i, _), w in zip(rows, words):
        for at in range(len(w) - 12):
            low[tuple(w[at : at + 13])] = min(low.get(tuple(w[at : at + 13]), i), i)
    want = set()
    for (i, _), w in zip(rows, words):
        hit = sorted(at for at in range(len(w) - 12) if low[tuple(w[at : at + 13])] < i)
        runs = []
        for at in hit:
            if runs and at - runs[-1][1] <= 13:
                runs[-1][1] = at
            else:
                runs.append([at, at])
        want |= {(i, a, b - a + 13) for a, b in runs}
    assert {(r.doc_id, r.start, r.length) for r in substrings.maximal_repeats(df).collect()} == want


def test_prefixes_split(spark):
    p = substrings.Prefixes(10)
    assert p.grow({0: 5, 1: 100, 2: 5})
    assert not p.grow({(1 << substrings.BUCKETS) + 3: 4})
    assert p.groups >= 1 and len(p.tables) == 2


def test_operators_and_empty(spark):
    rows = fixture()
    df = spark.createDataFrame([(i, t, "clash", "clash", "clash") for i, t in rows], SCHEMA)
    out = substrings.remove_repeats(df)
    assert out.columns == df.columns and out.count() == len(rows)
    want = {(i, s) for i, _, _, s in brute(rows)}
    digest = lambda t: hashlib.sha256(" ".join(re.findall(r"[^\x20\x09-\x0D]+", t or "")).encode()).hexdigest()
    assert {(r.doc_id, digest(r.text)) for r in out.collect()} == want
    spans = substrings.maximal_repeats(df).collect()
    assert spans and all(r.length >= 13 for r in spans)
    empty = df.limit(0)
    assert substrings.report(empty).collect() == [] and substrings.remove_repeats(empty).collect() == []
    short = spark.createDataFrame([(1, "few words", "", "", "")], SCHEMA)
    assert [tuple(r)[:3] for r in substrings.report(short).collect()] == [(1, 2, 0)]
