import numpy as np

from corpusmill.llm import audio


def prints(rng, n, common=False):
    """(class_key, class_id, ints, keys): some classes hold a noisy piece of another; with `common`, all hold one integer."""
    out = []
    for k in range(n):
        x = rng.integers(-(2**31), 2**31, int(rng.integers(1, 60)), dtype=np.int64).astype(np.int32)
        if k % 3 == 2:
            y = np.array(out[rng.integers(0, k)][2], np.int32)
            noise = (rng.random((len(y), 32)) < 0.08) @ (1 << np.arange(32, dtype=np.int64))
            x = np.concatenate([x[:7], y ^ noise.astype(np.uint32).view(np.int32)])
        if common:
            x[len(x) // 2] = 12345
        out.append((f"k{k}", None if k == 9 else k, x.tolist(), sorted(rng.choice(len(x), max(1, len(x) * 3 // 4), replace=False).tolist()) if not common else list(range(len(x)))))
    return out


def brute(asked, every):
    out = set()
    for ka, ia, x, px in asked:
        for kb, ib, y, py in every:
            x, y = np.array(x, np.int32), np.array(y, np.int32)
            met = {q - p for p in px for q in py if ka != kb and any((int(x[p]) ^ int(y[q])) & m == 0 for m in audio.PARTS)}
            got = [(*audio.stretch(x, y, z), z) for z in sorted(met, key=lambda z: (abs(z), -z))]
            good = [g for g in got if g[1] >= audio.LEAST and g[2] <= audio.MOST_ERROR]
            if good:
                best = max(good, key=lambda g: g[1] * (audio.MOST_ERROR * 1.25 - g[2]))
                out.add((ka, ia, kb, ib, best[3], *best[:3]))
    return out


def made(df):
    """Rows that each operator of df's plan made when it ran."""
    out, todo = [], [df._jdf.queryExecution().executedPlan()]
    while todo:
        node = todo.pop()
        kind = node.getClass().getSimpleName()
        if kind == "AdaptiveSparkPlanExec":
            todo.append(node.executedPlan())
            continue
        if kind.endswith("QueryStageExec"):
            todo.append(node.plan())
            continue
        if node.metrics().contains("numOutputRows"):
            out.append((node.metrics().apply("numOutputRows").value(), kind))
        children = node.children()
        todo += [children.apply(k) for k in range(children.size())]
    return out


SCHEMA = "class_key string, class_id long, ints array<int>, keys array<int>"


def test_cells_find_what_brute_force_finds(spark, monkeypatch):
    for k, v in (("INTS", 400), ("LEAST_CELLS", 3), ("MATCHES", 64), ("CELLS", 500)):
        monkeypatch.setattr(audio, k, v, raising=False)
    rows = prints(np.random.default_rng(2), 120)
    every = spark.createDataFrame(rows, SCHEMA)
    got = audio.align(every.filter("substring(class_key, 2) % 4 = 1 or class_key in ('k9', 'k11')"), every).collect()
    want = brute([r for r in rows if int(r[0][1:]) % 4 == 1 or r[0] in ("k9", "k11")], rows)
    assert len(want) > 15 and {tuple(r) for r in got} == want and len(got) == len(want)


def test_pairs_that_only_share_a_key_are_no_rows(spark):
    """A join made a row for each: 3,404,695 on check_l and 128,980 on check_s."""
    rows = prints(np.random.default_rng(4), 400, common=True)
    every = spark.createDataFrame(rows, SCHEMA)
    df = audio.align(every.filter("class_id % 2 = 0"), every)
    assert len(df.collect()) > 20
    assert max(made(df)) < (30_000, ""), max(made(df))
