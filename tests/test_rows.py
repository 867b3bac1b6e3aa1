"""Queries that SQL cannot express, row by row against plain Python written from the definitions."""

import hashlib
import math
import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusmill.functions.stem import terms as stem_terms
from corpusmill.operators import multivector as MV
from corpusmill.operators import store as ST
from corpusmill.operators.embed import MockEmbedder, TfIdf
from corpusmill.operators.sparse import SparseIndex
from corpusmill.plans import registry
from corpusmill.plans import retrieval_queries as RQ
from corpusmill.plans.evaluation_queries import results
from corpusmill.plans.pipeline import Config, Pipeline

SF = "/root/testdata/sf0.001"
md5 = lambda t: hashlib.md5(t.encode()).hexdigest()


def table(name, columns="*"):
    return duckdb.sql(f"SELECT {columns} FROM read_parquet('{SF}/{name}.parquet')").fetchall()


def shown(df):
    return sorted(tuple(r) for r in df.select("doc_id", "position", "start_offset", "end_offset", "content_md5").collect())


def split(text, size, overlap, seps, level=0):
    """Recursive splitting, by recursion and on lists."""
    if len(text.encode()) <= size:
        return [text]
    while level < len(seps) and seps[level] not in text:
        level += 1
    if level == len(seps):
        step, out, at = size - overlap, [], 0
        while True:
            out.append(text[at : at + size])
            at += step
            if at + overlap >= len(text):
                return out
    sep, out, current = seps[level], [], ""
    parts = text.split(sep)
    for p in parts:
        joined = current + sep + p if current else p
        if len(joined.encode()) <= size:
            current = joined
        elif current:
            out.append([current])
            current = p
        else:
            out.append(split(p, size, overlap, seps, level + 1))
    if current:
        out.append(split(current, size, overlap, seps, level + 1))
    return [x for run in out for x in run]


def placed(text, size, overlap):
    """Chunks with what they repeat of the piece before, and where they are found."""
    raw, pieces, rows, at = text.encode(), split(text, size, overlap, ("\n\n", "\n", ". ", " ")), [], 0
    for k, piece in enumerate(pieces):
        lead = b""
        if k and overlap:
            before = pieces[k - 1].encode()
            lead = before[max(len(before) - overlap, 0) :]
            while len(before) > overlap and lead and 0x80 <= lead[0] < 0xC0:
                lead = lead[1:]
        chunk = lead + piece.encode()
        while at < len(raw) and 0x80 <= raw[at] < 0xC0:
            at += 1
        at = min(at, len(raw))
        where = raw.find(chunk, at)
        at = where if where >= 0 else at
        rows.append((chunk.decode(), at, at + len(chunk)))
        at += 1
    return rows


def test_recursive(spark):
    want = [(i, k, a, b, md5(c)) for i, t in table("documents", "doc_id, text") if t for k, (c, a, b) in enumerate(placed(t, 512, 50))]
    assert shown(registry.QUERIES["d2_recursive"](spark, SF)) == sorted(want)


def test_structural(spark):
    want = []
    for i, t in table("documents", "doc_id, text"):
        if not t:
            continue
        lines = [f"# {x}" if k % 3 == 0 else x for k, x in enumerate(t.split("\n"))]
        whole, parts = "\n".join(lines), [[]]
        for x in lines:
            if re.match(r"[^\S\n]*#+[^\S\n]*[^\s#]", x):
                parts.append([])
            parts[-1].append(x)
        out = []
        for p in ("\n".join(x).strip() for x in parts):
            if not p:
                continue
            at = max(whole.encode().find(p.encode()), 0)
            out += [(p, at, at + len(p.encode()))] if len(p.encode()) <= 400 else placed(p, 400, 50)
        want += [(i, k, a, b, md5(c)) for k, (c, a, b) in enumerate(out)]
    assert shown(registry.QUERIES["d5_structural"](spark, SF)) == sorted(want)


def test_semantic(spark):
    """Over the sentences and vectors that other tests hold."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", F.col("text").alias("content")).filter("length(content) > 0")
    from corpusmill.functions import text as X

    rows = docs.select("doc_id", "content", X.sentences(F.col("content"), before_capital=False).alias("s")).withColumn("v", F.transform("s", lambda x: F.when(F.length(x) > 0, MockEmbedder(32).column(x)))).collect()
    want = []
    for r in rows:
        vec = dict(zip(r.s, MockEmbedder(32).embed_batch(list(r.s))))
        groups = []
        for s in r.s:
            if groups:
                a, b = vec[groups[-1][0]], vec[s]
                cos = 0.0 if a is None or b is None else float(np.dot(a, b)) / math.sqrt(float(np.dot(a, a)) * float(np.dot(b, b)))
                if cos >= 0.1 and sum(len(x.encode()) for x in groups[-1]) + len(s.encode()) <= 500:
                    groups[-1].append(s)
                    continue
            groups.append([s])
        for k, g in enumerate(groups):
            c = " ".join(g)
            at = max(r.content.encode().find(c.encode()), 0)
            want.append((r.doc_id, k, at, at + len(c.encode()), md5(c)))
    assert shown(registry.QUERIES["d6_semantic"](spark, SF)) == sorted(want)


def timed(target, least, overlap):
    """Chunks of the conversations' cues."""
    tracks, want = defaultdict(list), []
    for conv, turn, text in table("conversations", "conv_id, turn, text"):
        tracks[conv].append((turn, turn * 20.0, turn * 20.0 + 18, text or ""))
    for conv, cues in tracks.items():
        cues.sort()
        if not " ".join(c[3] for c in cues):
            continue
        out, now, start = [], [], cues[0][1]
        for c in cues:
            if now and c[2] - start >= target:
                out.append(now)
                now = [x for x in now if x[1] >= c[1] - overlap]
                start = now[0][1] if now else c[1]
            now = now + [c]
        if out and now[-1][2] - start < least:
            out[-1] = out[-1] + now
        else:
            out.append(now)
        for k, g in enumerate(out):
            want.append((conv, k, int(g[0][1]), int(g[-1][2]), md5(" ".join(x[3] for x in g))))
    return sorted(want)


def test_timestamp(spark):
    assert shown(registry.QUERIES["d7_timestamp"](spark, SF)) == timed(60.0, 10.0, 25.0)


def test_auto(spark):
    assert shown(registry.QUERIES["d9_auto"](spark, SF)) == timed(60.0, 10.0, 5.0)


def test_grouped(spark):
    rows = defaultdict(list)
    for r in results(spark, SF).collect():
        rows[r.query_id].append(r)
    want = set()
    for q, rs in rows.items():
        first = {}
        for r in sorted(rs, key=lambda r: r["rank"]):
            first.setdefault(r.doc_id, r["rank"])
        used, n, stopped = 0, 0, set()
        for r in sorted(rs, key=lambda r: (first[r.doc_id], r["rank"])):
            t = len(r.content.encode()) // 4
            if r.doc_id in stopped or used + t > 2000:
                stopped.add(r.doc_id)
                continue
            used, n = used + t, n + 1
            want.add((q, r.chunk_id, n, used))
    assert {tuple(r) for r in registry.QUERIES["m2_grouped"](spark, SF).collect()} == want and want


def ranked(scores, k):
    return [(i, n + 1, s) for n, (s, i) in enumerate(sorted((-round(s, 6), i) for i, s in scores.items())[:k])]


def found_text(docs, queries):
    """(query, chunk, rank): all tokens as phrases of stems, by BM25 over phrases."""
    avg, by = sum(len(w) for w in docs.values()) / len(docs), set()
    for q, text in queries:
        tf = []
        for token in text.split():
            phrase = list(stem_terms(token.replace('"', "")) or [])
            if phrase:
                n = len(phrase)
                tf.append({i: c for i, w in docs.items() if phrase[0] in w and (c := sum(w[k : k + n] == phrase for k in range(len(w) - n + 1)))})
        score = {}
        for i in set.intersection(*map(set, tf)) if tf else set():
            score[i] = sum(max(math.log((len(docs) - len(t) + 0.5) / (len(t) + 0.5)), 1e-6) * t[i] * 2.2 / (t[i] + 1.2 * (0.25 + 0.75 * len(docs[i]) / avg)) for t in tf)
        by |= {(q, i, n) for i, n, _ in ranked(score, 10)}
    return by


def test_full_text(spark):
    docs = {i: list(stem_terms(t) or []) for i, t in table("documents", "doc_id, text")}
    passages = table("benchmark", "item_id, text")
    got = {(r.query_id, r.chunk_id, r["rank"]) for r in registry.QUERIES["c9_full_text"](spark, SF).collect()}
    assert got == found_text(docs, passages) and got
    short = [(q, " ".join(t.split()[1:3])) for q, t in passages]
    rows = ST.full_text(ST.FullText.build(RQ.chunks(spark, SF)), spark.createDataFrame(short, "query_id long, text string"), 10).collect()
    got = {(r.query_id, r.chunk_id, r["rank"]) for r in rows}
    assert got == found_text(docs, short) and len(got) > 20


def test_pipeline_contexts(spark):
    """Sentence chunks, dense and sparse lists, fusion, reranking and assembly again, from the pipeline's own tables in plain Python."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", F.col("text").alias("content"), F.col("source").alias("title"))
    config = Config(MockEmbedder(64), None, "sentence")
    p = Pipeline.index(docs, config)
    queries = spark.read.parquet(f"{SF}/benchmark.parquet").select(F.col("item_id").alias("query_id"), "text").filter("query_id < 5")
    chunks = {r.chunk_id: r for r in p.chunks.collect()}
    vec = {r.chunk_id: np.array(r.vec) for r in p.vectors.collect() if r.vec is not None}
    posts = defaultdict(dict)
    for r in p.sparse.postings.collect():
        posts[r.term][r.chunk_id] = (r.tf, r.dl)
    got = {r.query_id: r for r in p.contexts(queries, 5).collect()}
    qv = {r.query_id: np.array(r.vec) for r in p._query_vectors(queries).collect()}
    from corpusmill.functions import text as X

    for r in queries.select("query_id", X.tokens(F.col("text")).alias("w")).collect():
        dense = ranked({c: float(v @ qv[r.query_id]) / math.sqrt(float(v @ v) * float(qv[r.query_id] @ qv[r.query_id])) for c, v in vec.items()}, config.candidates)
        score = defaultdict(float)
        for t, n in Counter(r.w).items():
            for c, (tf, dl) in posts[t].items():
                score[c] += n * math.log((p.sparse.n - len(posts[t]) + 0.5) / (len(posts[t]) + 0.5) + 1) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / p.sparse.avgdl))
        fused = defaultdict(float)
        for lst in (dense, ranked(score, config.candidates)):
            for c, n, _ in lst:
                fused[c] += 1 / (60 + n)
        best, used, parts = ranked(fused, 5), 0, []
        for c, n, _ in best:
            used += len(chunks[c].content.encode()) // 4
            if used > config.budget:
                break
            parts.append(f"{chunks[c].content} [{n}]")
        assert got[r.query_id].context == "\n\n".join(parts)


def test_pipeline_query_is_its_operators(spark):
    rows = registry.QUERIES["m22_pipeline"](spark, SF).collect()
    assert len(rows) == len(table("benchmark")) and all(r.total_tokens <= 4096 and "[1]" in r.context for r in rows)


def test_trained_search_recall(spark):
    """The trained index against exact search, its queries being those divisible by 50."""
    lists, asked = RQ.token_lists(spark, SF)
    exact, got = defaultdict(set), defaultdict(set)
    for r in MV.exact_search(lists, asked, 10).collect():
        exact[r.query_id].add(r.chunk_id)
    for r in registry.QUERIES["j14_trained_search"](spark, SF).collect():
        got[r.query_id].add(r.chunk_id)
    assert set(exact) == {i for i, in table("embeddings", "vec_id") if i % 50 == 0}
    recall = sum(len(exact[q] & got[q]) for q in exact) / sum(map(len, exact.values()))
    assert recall >= 0.9, recall


@pytest.mark.parametrize("n", [1, 3, 4, 5, 257])
def test_buckets_match_sorted_lists(spark, n):
    rng = np.random.default_rng(n)
    x = rng.normal(size=(n, 3)).round(2)
    rows = MV.learn_buckets(spark.createDataFrame([(v.tolist(),) for v in x], "vec array<double>").repartition(3), 2).orderBy("dim").collect()
    for d, r in enumerate(rows):
        v, at = np.sort(x[:, d]), [i * n // 4 for i in range(5)]
        assert r.cutoffs == [v[min(at[i], n - 1)] for i in (1, 2, 3)]
        assert np.allclose(r.weights, [v[at[i] : min(max(at[i + 1], at[i] + 1), n)].mean() for i in range(4)])


def test_saved_indexes(spark, tmp_path):
    docs = spark.createDataFrame([("a", "Ownership gives memory safety.", "A"), ("b", "Soup is best when hot. Hot soup.", "B"), ("c", "", None)], "doc_id string, content string, title string")
    q = spark.createDataFrame([(0, "hot soup"), (1, "memory")], "query_id int, text string")
    p = Pipeline.index(docs, Config(MockEmbedder(16), None))
    again = Pipeline.load(spark, p.save(f"{tmp_path}/p", "lz4"), p.config)
    for mode in ("dense", "sparse", "hybrid"):
        assert sorted(map(tuple, p.retrieve(q, 3, mode).collect())) == sorted(map(tuple, again.retrieve(q, 3, mode).collect()))
    index = SparseIndex.build(p.chunks.select("chunk_id", "content"), 2.0, 0.5, stopwords=[])
    loaded = SparseIndex.load(spark, index.save(f"{tmp_path}/s"))
    assert (loaded.k1, loaded.b, loaded.options, loaded.n, loaded.avgdl) == (2.0, 0.5, {"stopwords": []}, index.n, index.avgdl)
    fts = ST.FullText.build(p.chunks)
    assert sorted(map(tuple, ST.full_text(fts, q).collect())) == sorted(map(tuple, ST.full_text(ST.FullText.load(spark, fts.save(f"{tmp_path}/f")), q).collect()))
    rng = np.random.default_rng(2)
    tokens = spark.createDataFrame([(i, t, rng.normal(size=4).tolist()) for i in range(40) for t in range(3)], "chunk_id int, token_idx int, vec array<double>")
    mv = MV.MultiVectorIndex.build(tokens, MV.Codec.train(tokens, 4, 2))
    asked = tokens.filter("chunk_id < 4").withColumnRenamed("chunk_id", "query_id")
    back = MV.MultiVectorIndex.load(spark, mv.save(f"{tmp_path}/m"))
    assert sorted(map(tuple, mv.search(asked, MV.SearchConfig(threshold=-1.0)).collect())) == sorted(map(tuple, back.search(asked, MV.SearchConfig(threshold=-1.0)).collect()))


def test_store_search_follows_changes(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(ST, "FILE_ROWS", 2)
    store = ST.Store(spark, f"{tmp_path}/s", slots=2).initialise()
    put = lambda rows: store.insert(
        spark.createDataFrame([(i, None, i, t, None) for i, t in rows], "doc_id string, title string, source string, content string, metadata string"),
        spark.createDataFrame([(i, f"{i}#0", 0, t) for i, t in rows], "doc_id string, chunk_id string, position int, content string"),
    )
    hits = lambda text: {r.chunk_id for r in store.search(spark.createDataFrame([(0, text)], "query_id int, text string")).collect()}
    put([(f"d{k}", f"common words and number{k}") for k in range(9)])
    assert hits("common") == {f"d{k}#0" for k in range(9)} and hits("number3") == {"d3#0"} and len(store) == 9
    put([("d3", "another text")])
    assert hits("number3") == set() and hits("another") == {"d3#0"}
    store.remove(spark.createDataFrame([("d3",)], "doc_id string"))
    assert hits("another") == set() and len(store) == 8
    got = store.get_chunk(spark.createDataFrame([("d1#0",), ("d3#0",)], "chunk_id string")).collect()
    assert [(r.chunk_id, r.content) for r in got] == [("d1#0", "common words and number1")]
    store.optimise()
    assert len(store) == 8 and hits("common") == {f"d{k}#0" for k in range(9) if k != 3}


def test_tf_idf_weights(spark):
    texts = {1: "a a b c", 2: "b c zz", 3: "", 4: "zz yy", 5: None}
    docs = spark.createDataFrame(list(texts.items()), "doc_id int, content string")
    model = TfIdf.fit(docs, 3)
    idf = {r.term: r.idf for r in model.vocabulary.collect()}
    want = {}
    for i, t in texts.items():
        w = (t or "").split()
        v = {x: n / len(w) * idf[x] for x, n in Counter(w).items() if x in idf}
        norm = math.sqrt(sum(x * x for x in v.values()))
        want |= {(i, x): y / norm for x, y in v.items()}
    got = {(r.doc_id, r.term): r.weight for r in model.weights(docs, "doc_id").collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)
