import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusmill.functions import stem, text as X
from corpusmill.functions.let import running_sums
from corpusmill.operators import context, dense, evaluate, fusion, metrics, multivector as MV, preprocess, rerank, store
from corpusmill.operators.embed import MockEmbedder, TfIdf, create, embedded
from corpusmill.operators.sparse import SparseIndex


def ranked(spark, rows):
    return spark.createDataFrame([(0, c, i + 1, float(s)) for i, (c, s) in enumerate(rows)], "query_id int, chunk_id int, rank int, score double")


def scores(df):
    return {r.chunk_id: round(r.score, 4) for r in df.collect()}


def test_fusions(spark):
    d, s = ranked(spark, [(1, 0.9), (2, 0.5), (3, 0.1)]), ranked(spark, [(2, 10), (4, 6)])
    assert scores(fusion.rrf(d, s)) == {1: round(1 / 61, 4), 2: round(1 / 62 + 1 / 61, 4), 3: round(1 / 63, 4), 4: round(1 / 62, 4)}
    assert scores(fusion.linear(d, s, 0.5)) == {1: 0.5, 2: 0.75, 3: 0.0, 4: 0.0}
    assert [r.chunk_id for r in fusion.union(d, s).orderBy("rank").collect()] == [1, 2, 3, 4]
    assert scores(fusion.intersection(d, s)) == {2: 5.25}
    flat = ranked(spark, [(7, 1), (8, 1)])
    assert scores(fusion.linear(flat, flat.limit(0), 1.0)) == {7: 1.0, 8: 1.0}
    assert scores(fusion.dbsf(flat, flat.limit(0))) == {7: 0.0, 8: 0.0}
    three = fusion.fuse_three("three_way", d, s, flat)
    assert scores(three)[7] == 0.3
    assert fusion.fuse_three("rrf", d, s, flat).count() == 6
    with pytest.raises(ValueError):
        fusion.strategy("convex")
    one = fusion.hybrid(d, s, 2).orderBy("rank").collect()
    assert [(r.chunk_id, r.dense_score, r.sparse_score) for r in one] == [(2, 0.5, 10.0), (1, 0.9, None)]


def test_metrics_golden(spark):
    results = ranked(spark, [(i, 1 / i) for i in range(1, 11)])
    relevant = spark.createDataFrame([(0, i) for i in (1, 3, 5, 7)], "query_id int, chunk_id int")
    got = {(r.metric, r.k): round(r.value, 4) for r in metrics.per_query(results, relevant).collect()}
    assert got["ap", None] == 0.7095 and got["mrr", None] == 1.0
    assert [got["ndcg", k] for k in (1, 3, 5, 10)] == [1.0, 0.7039, 0.7366, 0.8667]
    assert [got["recall", k] for k in (1, 3, 5, 10)] == [0.25, 0.5, 0.75, 1.0]
    assert [got["precision", k] for k in (1, 3, 5, 10)] == [1.0, 0.6667, 0.6, 0.4]
    none = metrics.per_query(results, relevant.limit(0)).filter("value <> 0").count()
    assert none == 0
    # a query without results counts with zeros
    more = relevant.unionByName(spark.createDataFrame([(1, 1)], "query_id int, chunk_id int"))
    agg = {(r.metric, r.k): r for r in metrics.aggregated(metrics.per_query(results, more)).collect()}
    assert agg["mrr", None].value == 0.5 and agg["mrr", None].query_count == 2


def test_sparse_cases(spark):
    chunks = spark.createDataFrame([(1, "alpha beta"), (2, "beta beta gamma"), (3, None), (4, "the of")], "chunk_id int, content string")
    index = SparseIndex.build(chunks)
    assert index.n == 4 and index.avgdl == 5 / 4
    q = spark.createDataFrame([(0, "beta beta alpha"), (1, "nothing"), (2, None)], "query_id int, text string")
    got = index.search(q).orderBy("rank").collect()
    assert {r.query_id for r in got} == {0} and [r.chunk_id for r in got] == [1, 2]
    w = lambda tf, dl, df: math.log((4 - df + 0.5) / (df + 0.5) + 1) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / 1.25))
    assert abs(got[0].score - (2 * w(1, 2, 2) + w(1, 2, 1))) < 1e-5
    assert index.without(spark.createDataFrame([(1,)], "chunk_id int")).search(q).count() == 1
    assert SparseIndex.build(chunks.limit(0)).search(q).count() == 0


def test_dense_cases(spark):
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 2.0]), (3, [0.0, 0.0]), (4, None)], "chunk_id int, vec array<double>")
    q = spark.createDataFrame([(0, [1.0, 1.0])], "query_id int, vec array<double>")
    assert [(r.chunk_id, round(r.score, 4)) for r in dense.search(v, q, 3).orderBy("rank").collect()] == [(1, 0.7071), (2, 0.7071), (3, 0.0)]
    assert [r.chunk_id for r in dense.search(v, q, 1, "dot").collect()] == [2]
    assert dense.search(v, q.limit(0)).count() == 0
    assert dense.search(v.limit(0), q).count() == 0
    assert [r.valid for r in dense.checked(v, 2).orderBy("chunk_id").collect()] == [True, True, True, False]
    with pytest.raises(ValueError):
        dense.search(v, q, 3, "manhattan")


def test_multivector(spark):
    rng = np.random.default_rng(5)
    rows = [(i, [[float(x) for x in rng.normal(size=4)] for _ in range(rng.integers(1, 6))]) for i in range(60)] + [(99, [])]
    chunks = spark.createDataFrame(rows, "chunk_id int, tokens array<array<double>>")
    queries = chunks.filter("chunk_id < 3").withColumnRenamed("chunk_id", "query_id")
    exact = {(r.query_id, r.chunk_id): r.score for r in MV.exact_search(chunks, queries, 100).collect()}
    of = dict(rows)
    for (q, c), s in exact.items():
        want = sum(max((float(np.dot(a, b)) for b in of[c]), default=0.0) for a in of[q])
        assert abs(s - want) < 1e-5
    tokens = MV.exploded(chunks)
    codec = MV.Codec.train(tokens, 4, 4)
    x = np.array([v for _, t in rows for v in t])
    own, codes = codec.encode(x)
    assert (codec.unpack(codec.pack(codes)) == codes).all()
    index = MV.MultiVectorIndex.build(tokens, codec)
    everything = MV.SearchConfig(k=100, nprobe=4, threshold=-1e9, bound=10**6)
    got = {(r.query_id, r.chunk_id): r.score for r in index.search(MV.exploded(queries, "query_id"), everything).collect()}
    near = codec.centroids[own] + codec.weights[np.arange(4), codes]
    where = {}
    at = 0
    for c, t in rows:
        where[c] = near[at : at + len(t)]
        at += len(t)
    for (q, c), s in got.items():
        assert abs(s - sum((where[c] @ np.array(a)).max() for a in of[q])) < 1e-5
    assert len(got) == 3 * 60 and index.memory_bytes() > 0
    with pytest.raises(ValueError):
        MV.Codec.train(tokens, 1000, 4)
    with pytest.raises(ValueError):
        MV.SearchConfig(nprobe=0)


def test_rerank_and_preprocess(spark):
    rows = spark.createDataFrame([(0, 1, 1, 1.0, "Fast search", "a fast SEARCH engine"), (0, 2, 2, 0.5, "Fast search", "fast search"), (0, 3, 3, 0.1, "Fast search", "nothing"), (0, 4, 4, 0.0, "", "x")], "query_id int, chunk_id int, rank int, score double, query string, content string")
    s = {r.chunk_id: r.s for r in rows.select("chunk_id", rerank.lexical_score(F.col("query"), F.col("content")).alias("s")).collect()}
    assert s[3] == 0 and s[4] == 0
    assert abs(s[2] - (0.3 + 0.5 + 0.2 * (1 + 1 / 1.05) / 2)) < 1e-9
    assert [r.chunk_id for r in rerank.rerank(rows, None, 2).orderBy("rank").collect()] == [1, 2]
    q = spark.createDataFrame([("how do I fix an error vs a bug",), ("hello",), ("",)], "q string")
    got = q.select(preprocess.analysis(F.col("q")).alias("a"), preprocess.synonym_expansions(F.col("q")).alias("s"), preprocess.multi_query(F.col("q"), preprocess.keyword_expansions(F.col("q")), 2).alias("m")).collect()
    assert got[0].a.intent == "Troubleshooting" and got[1].a.intent == "Unknown" and got[1].a.confidence == 0.3
    assert got[0].s == ["how do I fix an exception vs a bug", "how do I fix an failure vs a bug"]
    assert got[0].m == ["how do I fix an error vs a bug", "fix error bug"] and got[1].m == ["hello", "hello hello"]


def test_context(spark):
    rows = spark.createDataFrame([(0, c, d, r, 1.0, "x" * n, t) for c, d, r, n, t in [(1, 1, 1, 40, "A"), (2, 2, 2, 200, None), (3, 1, 3, 40, "A"), (4, 2, 4, 8, None)]], "query_id int, chunk_id int, doc_id int, rank int, score double, content string, title string")
    assert [r.chunk_id for r in context.sequential(rows, 30).collect()] == [1]
    g = context.grouped(rows, 30).orderBy("citation_id").collect()
    assert [r.chunk_id for r in g] == [1, 3]
    assert [r.chunk_id for r in context.grouped(rows, 75).orderBy("citation_id").collect()] == [1, 3, 2, 4]
    out = context.rendered(context.sequential(rows, 1000)).first()
    assert out.citations == "[1] A\n[2] Untitled\n[3] A\n[4] Untitled" and out.total_tokens == 72 and out.context.startswith("x" * 40 + " [1]\n\n")
    assert context.rendered(context.sequential(rows, 1000, cite=False)).first().context.count("[0]") == 4


def test_embedders(spark):
    docs = spark.createDataFrame([("a", "red red blue"), ("b", "red green"), ("c", ""), ("d", None)], "chunk_id string, content string")
    model = TfIdf.fit(docs, 2)
    vocab = {r.term: (r.idx, round(r.idf, 4)) for r in model.vocabulary.collect()}
    assert vocab == {"red": (0, round(math.log(2) + 1, 4)), "blue": (1, round(math.log(4) + 1, 4))}
    v = {r.chunk_id: r.vec for r in model.embed(docs).collect()}
    assert abs(sum(x * x for x in v["a"]) - 1) < 1e-9 and v["c"] == [0, 0] and v["b"] == [1, 0]

    class Plain:
        dimension = 2
        document_prefix = "doc: "

        def embed_batch(self, t):
            return [[float(len(x)), 0.0] for x in t]

    got = {r.chunk_id: r.vec for r in embedded(docs, Plain()).collect()}
    assert got["a"] == [17.0, 0.0] and got["c"] is None and got["d"] is None
    m = embedded(docs, MockEmbedder(8)).collect()
    assert abs(sum(x * x for x in m[0].vec) - 1) < 1e-9 and m[2].vec is None
    with pytest.raises(ValueError):
        create("onnx")


def test_text_functions(spark):
    one = spark.range(1)
    val = lambda c: one.select(c.alias("v")).first().v
    L = F.lit
    assert val(X.tokens(L("The quick-brown FOX's a é 42"))) == ["quick", "brown", "fox", "é", "42"]
    assert val(X.display_time(L(3661.5))) == "1:01:02" and val(X.display_time(L(-3.0))) == "0:00"
    assert val(X.srt_time(L(3661.0005))) == "01:01:01,001"
    assert val(X.parse_time(L("01:02,5"))) == 62.5 and val(X.parse_time(L("1:2:3:4"))) is None
    assert val(X.course_dir(L("/data/courses/rust-x/a/b.srt"))) == "rust-x" and val(X.course_dir(L("a/b"))) == "unknown" and val(X.course_dir(L("x/y/courses"))) == "x"
    assert val(X.domain(L("AWS-Lambda-python"))) == "aws"
    assert val(X.frame_time(L("/x/frame_12.5s.png"))) == 12.5
    assert val(X.header(L("  ## Head # "))) == "Head #" and val(X.header(L("##"))) is None
    assert val(running_sums(F.sequence(L(1), L(1000)))) == [i * (i + 1) // 2 for i in range(1000)]
    assert [stem.stem(w) for w in "caresses ponies relational hopping falling happy agreed conditional electrical adjustment".split()] == "caress poni relat hop fall happi agre condit electr adjust".split()


def test_judging(spark):
    pairs = spark.createDataFrame([("q", "a"), ("q", "b"), ("q", "a")], "query string, content string")
    key = pairs.limit(1).select(evaluate.cache_key(F.col("query"), F.col("content")).alias("key"), F.lit(True).alias("relevant"), F.lit("kept").alias("reasoning"), F.lit("m").alias("model"))
    ask = lambda q, c: F.when(c == "b", '{"relevant": false, "reasoning": "no"}').otherwise(F.lit("unasked"))
    rows, cache = evaluate.judge(pairs, key, ask)
    assert sorted((r.content, r.relevant, r.reasoning) for r in rows.collect()) == [("a", True, "kept"), ("a", True, "kept"), ("b", False, "no")]
    assert cache.count() == 2


def test_store(spark, tmp_path):
    st = store.Store(spark, str(tmp_path / "s"), slots=4).initialise()
    assert st.get("schema_version") == store.SCHEMA_VERSION
    docs = spark.createDataFrame([("a", None, "p1", "Running dogs run", None), ("b", None, "p2", "A dog ran far-away home", None)], store.DOCUMENT.replace(", chunk_count long", ""))
    chunks = docs.select("doc_id", F.concat("doc_id", F.lit("#0")).alias("chunk_id"), F.lit(0).alias("position"), "content")
    st.insert(docs, chunks, store.fingerprints(docs.select(F.col("source").alias("path"), "content")))
    assert tuple(st.stats().first()) == (2, 2, 2)
    q = spark.createDataFrame([(0, "dogs"), (1, "far-away"), (2, "away-far"), (3, "dog missing"), (4, '"'), (5, None)], "query_id int, text string")
    got = {(r.query_id, r.chunk_id) for r in st.search(q).collect()}
    assert got == {(0, "a#0"), (0, "b#0"), (1, "b#0")}
    st.insert(docs.filter("doc_id = 'a'").withColumn("content", F.lit("new")), chunks.limit(0))
    assert tuple(st.stats().first()) == (2, 1, 2)
    assert st.remove_by_source(spark.createDataFrame([("p2",), ("zz",)], "source string")) == 1
    assert [r.doc_id for r in st.documents.read().collect()] == ["a"]
    st.remove(docs.select("doc_id"))
    st.optimise()
    assert tuple(st.stats().first()) == (0, 0, 0)
