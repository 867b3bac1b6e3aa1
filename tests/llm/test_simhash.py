import random

from pyspark.sql import types as T
from xxhash import xxh64_intdigest

from corpusmill.llm import simhash

SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("fp", T.StringType())])


def brute_fingerprint(text):
    import re

    t = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    if not w:
        return 0
    grams = [" ".join(w[i : i + 4]) for i in range(len(w) - 3)] or [" ".join(w)]
    hs = [xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def brute_components(rows):
    fps = [brute_fingerprint(r[1]) for r in rows]
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 4:
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    low = {}
    for i, r in enumerate(rows):
        if r[0] is not None:
            low[find(i)] = min(low.get(find(i), r[0]), r[0])
    return {(r[0], f"{fps[i]:016x}", low.get(find(i))) for i, r in enumerate(rows)}


def fixture():
    rnd = random.Random(7)
    vocab = ["wort", "Éa", "le", "THE", "of", "x" * 30] + [f"w{i}" for i in range(200)]
    rows, n = [], 0
    for _ in range(60):
        base = [rnd.choice(vocab) for _ in range(rnd.choice([3, 5, 60, 200]))]
        for _ in range(rnd.choice([1, 1, 2, 6])):
            w = list(base)
            if len(w) > 50:
                w[rnd.randrange(len(w))] = "changed"
            rows.append((n, " ".join(w)))
            n += 1
    rows += [(1000, None), (1001, ""), (1002, " \t\n"), (1003, "a b"), (3, rows[3][1]), (None, "no id here at all"), (1004, "long " * 40000), (1005, "\x1f\x85  b c d e")]
    return [(*r, "en", None, "clash") for r in rows]


def test_components_match_brute_force(spark):
    rows = fixture()
    got = simhash.report(spark.createDataFrame(rows, SCHEMA)).collect()
    assert len(got) == len(rows)
    assert {tuple(r) for r in got} == brute_components(rows)


def test_any_plan_finds_all_links(spark):
    rnd = random.Random(1)
    fps = {rnd.getrandbits(64) for _ in range(50)}
    for f in list(fps):
        for _ in range(6):
            fps.add(f ^ sum(1 << b for b in rnd.sample(range(64), rnd.randrange(1, 6))))
    fps = [x - (1 << 64) if x >> 63 else x for x in fps]
    want = {(min(a, b), max(a, b)) for a in fps for b in fps if a != b and ((a ^ b) & (2**64 - 1)).bit_count() <= 4}
    df = spark.createDataFrame([(x,) for x in fps], "fp long").repartition(4)
    for rows in (10, 1 << 22):
        got = [tuple(r) for r in simhash.links(df, 4, rows).collect()]
        assert len(got) == len(set(got)) and set(got) == want


def test_keep_one(spark):
    rows = fixture()
    df = spark.createDataFrame(rows, SCHEMA)
    kept = simhash.keep_one(df)
    assert kept.columns == df.columns
    got = kept.collect()
    groups = {c for _, _, c in brute_components(rows)}
    assert len(got) == len(groups) and {r.doc_id for r in got} == groups


def test_empty(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert simhash.report(df).collect() == [] and simhash.keep_one(df).collect() == []


def test_null_ids_stay_apart(spark):
    texts = ["one text about ships and the sea they sail on", "quite another text of mountains and snow up high", "one text about ships and the sea they sail on"]
    df = spark.createDataFrame([(None, t, "en", None, "x") for t in texts], SCHEMA)
    assert sorted(r.text for r in simhash.keep_one(df).collect()) == sorted(set(texts))
    assert {r.component_id for r in simhash.report(df).collect()} == {None}
