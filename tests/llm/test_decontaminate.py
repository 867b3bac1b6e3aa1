import hashlib
import random
import re

from corpusmill.llm import decontaminate

DOCS = "doc_id long, text string, item_id string, n_words string"
BENCH = "item_id long, text string, doc_id string"
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(t):
    return re.findall(WORD, "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))


def hits(docs, items, n=10):
    grams = {}
    for i, t in items:
        w = words(t)
        k = min(n, len(w))
        for at in range(len(w) - k + 1 if k else 0):
            grams.setdefault(tuple(w[at : at + k]), set()).add(i)
    out = []
    for i, t in docs:
        w, hit, found = words(t), set(), set()
        for k in {len(g) for g in grams}:
            for at in range(len(w) - k + 1):
                if (g := tuple(w[at : at + k])) in grams:
                    hit |= set(range(at, at + k))
                    found |= grams[g]
        out.append((i, w, hit, found))
    return out


def fixture():
    rnd = random.Random(9)
    vocab = ["The", "É", "of", "end", "IT", *(f"w{i}" for i in range(400))]
    text = lambda n: " ".join(rnd.choice(vocab) for _ in range(n))
    items = [(i, text(rnd.choice([10, 11, 25]))) for i in range(30)] + [(100, "tiny one"), (101, "Solo"), (102, None), (103, ""), (104, "... --"), (105, None), (3, "x1 y1 z1 q1 r1 s1 t1 u1 v1 k1")]
    items.append((106, items[4][1]))
    docs = []
    for i in range(200):
        parts = [text(rnd.choice([0, 3, 60]))]
        if i % 3 == 0:
            t = rnd.choice(items)[1] or ""
            parts += [t.upper() if i % 2 else t.replace(" ", ", "), text(4)]
        if i % 7 == 0:
            parts.append("a tiny, ONE here")
        docs.append((i, "-".join(parts) if i % 5 == 0 else " ".join(parts)))
    docs += [(900, None), (901, ""), (902, "!!"), (903, "solo"), (904, "word " * 30000 + items[0][1]), (None, items[1][1]), (905, "ſolo K ÉND"), (docs[6][0], docs[6][1]), (906, ". " + items[2][1] + " ."), (907, " ".join([items[3][1]] * 3))]
    return docs, items


def frames(spark):
    docs, items = fixture()
    return spark.createDataFrame([(i, t, "clash", "clash") for i, t in docs], DOCS).repartition(4), spark.createDataFrame([(i, t, "clash") for i, t in items], BENCH), docs, items


def test_report_matches_brute_force(spark):
    d, b, docs, items = frames(spark)
    want = {(i, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(map(str, found))).encode()).hexdigest(), bool(hit)) for i, w, hit, found in hits(docs, items)}
    got = decontaminate.report(d, b).collect()
    assert len(got) == len(docs) and {tuple(r) for r in got} == want


def test_removal(spark):
    d, b, docs, items = frames(spark)
    found = hits(docs, items)
    kept = decontaminate.remove_documents(d, b)
    assert kept.columns == d.columns
    assert sorted((r.doc_id for r in kept.collect()), key=str) == sorted((i for i, _, hit, _ in found if not hit), key=str)
    half = decontaminate.remove_spans(d, b, most=0.5)
    assert half.columns == d.columns
    got = {}
    for r in half.collect():
        got.setdefault(r.doc_id, []).append(words(r.text))
    want = {}
    for i, w, hit, _ in found:
        if len(hit) <= 0.5 * len(w):
            want.setdefault(i, []).append([x for k, x in enumerate(w) if k not in hit])
    assert got == want
    clean = {i: t for (i, t), (_, _, hit, _) in zip(docs, found) if not hit}
    assert all(r.text == clean[r.doc_id] for r in half.collect() if r.doc_id in clean)


def test_empty(spark):
    d, b, docs, _ = frames(spark)
    assert decontaminate.report(d.limit(0), b).collect() == []
    none = decontaminate.report(d, b.limit(0)).collect()
    assert len(none) == len(docs) and not any(r.contaminated for r in none)
    assert decontaminate.remove_spans(d, b.limit(0)).count() == len(docs)
    assert decontaminate.remove_spans(d.limit(0), b).count() == 0
