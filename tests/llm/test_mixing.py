import random
import re
from fractions import Fraction

from corpusmill.llm import mixing

SCHEMA = "doc_id long, text string, source string, size string, target string"


def fixture():
    rnd = random.Random(2)
    sources = ["a"] * 30 + ["b"] * 6 + ["é"] * 3 + [None, "Z", "empty"]
    rows = []
    for i in range(900):
        s = rnd.choice(sources)
        n = 0 if s == "empty" else rnd.choice([1, 5, 40, 300])
        rows.append((i, " ".join("w" for _ in range(n)), s))
    rows += [(2000, None, "a"), (2001, "", "b"), (2002, " \t x\ty ", "b"), (5, "dup of id", "a"), (None, "no id", "a"), (2003, "big " * 30000, "Z")]
    return [(*r, "clash", "clash") for r in rows]


def targets(sizes):
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: (1, 2, 3)[i % 3] for i, s in enumerate(order)}
    total, capped = sum(sizes.values()), set()
    while True:
        rest = total - sum(3 * sizes[s] for s in capped)
        open_ = sum(w[s] for s in order if s not in capped)
        t = {s: Fraction(3 * sizes[s]) if s in capped else Fraction(w[s] * rest, open_) for s in order}
        over = {s for s in order if s not in capped and t[s] > 3 * sizes[s]}
        if not over:
            return t
        capped |= over


def test_taken(spark):
    rows = fixture()
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    got = mixing.taken(df).collect()
    assert len(got) == len(rows)
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    sizes, of = {}, {}
    for i, t, s, *_ in rows:
        sizes[s] = sizes.get(s, 0) + size(t)
    want = targets(sizes)
    assert sorted((r.doc_id is None, r.doc_id or 0, r.size) for r in got) == sorted((i is None, i or 0, size(t)) for i, t, *_ in rows)
    by_size = {}
    for i, t, s, *_ in rows:
        of[i, size(t)] = s
    for r in got:
        s = of[r.doc_id, r.size]
        assert r.source_size == sizes[s] and abs(r.target - float(want[s])) < 1e-6 * max(1, float(want[s]))
        assert 0 <= r.taken <= 3 * r.size and (r.size == 0 or r.taken % r.size == 0)
        by_size.setdefault(s, []).append(r)
    for s, rs in by_size.items():
        took = sum(r.taken for r in rs)
        base = float(want[s]) // max(sizes[s], 1)
        left = [r.size for r in rs if r.size and r.taken <= base * r.size]  # no such document fits into what is open
        assert took <= float(want[s]) + 1e-6 and float(want[s]) - took <= max([1e-6, *left]), (s, took, float(want[s]))
    again = mixing.taken(df.repartition(3)).collect()
    key = lambda r: (r.doc_id is None, r.doc_id or 0, r.size, r.taken)
    assert sorted(map(key, got)) == sorted(map(key, again))
    mixed = mixing.mix(df)
    assert mixed.columns == df.columns
    count = {}
    for r in mixed.collect():
        count[r.doc_id, size(r.text)] = count.get((r.doc_id, size(r.text)), 0) + 1
    assert all(count.get((r.doc_id, r.size), 0) * r.size == r.taken for r in got)


def test_empty(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert mixing.taken(df).collect() == [] and mixing.mix(df).collect() == []
    blank = spark.createDataFrame([(1, None, "a", "", ""), (2, "", None, "", "")], SCHEMA)
    assert {(r.doc_id, r.taken, r.target) for r in mixing.taken(blank).collect()} == {(1, 0, 0.0), (2, 0, 0.0)}
