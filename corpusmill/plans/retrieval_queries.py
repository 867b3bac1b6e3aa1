"""Queries of sparse, dense, hybrid and multi-vector retrieval and of reranking."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import dense as D
from ..operators import embed as E
from ..operators import fusion as FU
from ..operators import metrics as M
from ..operators import multivector as MV
from ..operators import ranking as RK
from ..operators import rerank as R
from ..operators import store as ST
from ..operators.sparse import SparseIndex
from ..sources.tables import saved_once, stored, table
from . import sql as Q
from .pipeline import Config, Pipeline
from .registry import query

CHUNKS = FU.CANDIDATES


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("chunk_id"), F.col("text").alias("content"))


def asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text")


def vectors(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """All vectors, and those that serve as queries: every one whose id is divisible by 50, numbered from 0."""
    v = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("chunk_id"), F.col("embedding").alias("vec"))
    return v, v.filter(F.col("chunk_id") % Q.EVERY == 0).select(F.expr(f"chunk_id div {Q.EVERY}").alias("query_id"), "vec")


def sparse_index(spark: SparkSession, sf_dir: str) -> SparseIndex:
    """The index of a table's documents: built by the first query of a session that needs it, loaded by the others."""
    return saved_once(spark, f"sparse-index-{sf_dir}", lambda path: SparseIndex.build(chunks(spark, sf_dir)).save(path), lambda path: SparseIndex.load(spark, path))


def sparse_list(spark, sf_dir, k=CHUNKS) -> DataFrame:
    return sparse_index(spark, sf_dir).search(asked(spark, sf_dir), k)


def dense_list(spark, sf_dir, k=CHUNKS, metric="cosine") -> DataFrame:
    return D.search(*vectors(spark, sf_dir), k, metric)


def both(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """The dense and the sparse list, each computed once."""
    return stored(dense_list(spark, sf_dir), "dense"), stored(sparse_list(spark, sf_dir), "sparse")


# ---- sparse


@query(f"SELECT term, count(*) AS df, sum(tf)::BIGINT AS total FROM (SELECT id, t AS term, count(*) AS tf FROM {Q.tokens('documents', 'doc_id', 'text')} GROUP BY ALL) GROUP BY term")
def g1_term_stats(spark, sf_dir):
    return SparseIndex.build(chunks(spark, sf_dir)).postings.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("total"))


@query(f"WITH {Q.POSTINGS} SELECT * FROM {Q.top('(' + Q.BM25 + ')', 10)}")
def g3_bm25_topk(spark, sf_dir):
    return sparse_list(spark, sf_dir, 10)


@query(f"WITH {Q.POSTINGS.replace('FROM documents)', 'FROM documents WHERE doc_id % 5 <> 0)').replace('FROM documents) WHERE', 'FROM documents WHERE doc_id % 5 <> 0) WHERE')} SELECT * FROM {Q.top('(' + Q.BM25 + ')', 10)}")
def g4_bm25_removed(spark, sf_dir):
    c = chunks(spark, sf_dir)
    return SparseIndex.build(c).without(c.filter("chunk_id % 5 = 0").select("chunk_id")).search(asked(spark, sf_dir), 10)


@query(f"WITH {Q.POSTINGS}, r AS (SELECT * FROM {Q.top('(' + Q.BM25 + ')', 5)}) SELECT query_id, chunk_id, rank, score, md5(text) AS content_md5 FROM r JOIN documents ON chunk_id = doc_id")
def g6_sparse_retriever(spark, sf_dir):
    return sparse_list(spark, sf_dir, 5).join(chunks(spark, sf_dir), "chunk_id").select("query_id", "chunk_id", "rank", "score", F.md5("content").alias("content_md5"))


@query(
    f"WITH {Q.POSTINGS.replace(' AND t NOT IN (' + Q.listed(Q.STOPWORDS) + ')', '')} SELECT * FROM "
    + Q.top("(" + Q.BM25.replace("2.2::DOUBLE", "3.0::DOUBLE").replace("1.2::DOUBLE", "2.0::DOUBLE").replace("0.25::DOUBLE", "0.5::DOUBLE").replace("0.75::DOUBLE", "0.5::DOUBLE") + ")", 10)
)
def g5_parameters(spark, sf_dir):
    """Other k1 and b, and no stopwords."""
    return SparseIndex.build(chunks(spark, sf_dir), 2.0, 0.5, stopwords=[]).search(asked(spark, sf_dir), 10)


# ---- dense


@query("SELECT vec_id % 3 AS part, count(*) AS n, count(*) FILTER (vec_id % 3 <> 0) AS valid FROM embeddings GROUP BY 1")
def h1_checked(spark, sf_dir):
    v, _ = vectors(spark, sf_dir)
    part = (F.col("chunk_id") % 3).alias("part")
    rows = D.checked(v.withColumn("vec", F.when(part == 0, F.slice("vec", 1, 60)).otherwise(F.col("vec"))), 64)
    return rows.groupBy(part).agg(F.count("*").alias("n"), F.count_if("valid").alias("valid"))


def _dense_sql(metric: str) -> str:
    return f"WITH {Q.VECTORS} SELECT * FROM {Q.top('(' + Q.vector_scores(metric) + ')', 10)}"


@query(_dense_sql("cosine"))
def h2_cosine_topk(spark, sf_dir):
    return dense_list(spark, sf_dir, 10)


@query(_dense_sql("dot"))
def h2_dot_topk(spark, sf_dir):
    return dense_list(spark, sf_dir, 10, "dot")


@query(_dense_sql("euclidean"))
def h2_euclidean_topk(spark, sf_dir):
    return dense_list(spark, sf_dir, 10, "euclidean")


@query(f"WITH {Q.VECTORS} SELECT query_id, chunk_id, rank, score, md5(text) AS content_md5 FROM {Q.top('(' + Q.vector_scores() + ')', 5)} JOIN documents ON chunk_id = doc_id")
def h4_dense_retriever(spark, sf_dir):
    return dense_list(spark, sf_dir, 5).join(chunks(spark, sf_dir), "chunk_id").select("query_id", "chunk_id", "rank", "score", F.md5("content").alias("content_md5"))


@query("SELECT vec_id AS chunk_id, round(list_sum(embedding::DOUBLE[]), 6) AS total FROM embeddings WHERE vec_id % 10 = 3 AND vec_id % 4 <> 1")
def h3_get_and_remove(spark, sf_dir):
    """A store without some vectors, asked for others by id."""
    v, _ = vectors(spark, sf_dir)
    left = ST.without(v, v.filter("chunk_id % 4 = 1").select("chunk_id"), "chunk_id")
    got = left.join(v.filter("chunk_id % 10 = 3").select("chunk_id"), "chunk_id", "left_semi")
    return got.select("chunk_id", F.round(F.aggregate("vec", F.lit(0.0), lambda s, x: s + x.cast("double")), 6).alias("total"))


# ---- fusion


def _fusion_sql(body: str) -> str:
    return f"WITH {Q.lists()} SELECT * FROM {body}"


@query(_fusion_sql(Q.fused("SELECT query_id, chunk_id, 1 / (60::DOUBLE + rank) AS part FROM d UNION ALL SELECT query_id, chunk_id, 1 / (60::DOUBLE + rank) FROM s")))
def i4_rrf(spark, sf_dir):
    return FU.rrf(*both(spark, sf_dir))


@query(_fusion_sql(Q.fused(f"{Q.min_max('d', 0.7)} UNION ALL {Q.min_max('s', 0.3)}")))
def i5_linear(spark, sf_dir):
    return FU.linear(*both(spark, sf_dir), 0.7)


@query(_fusion_sql(Q.fused(f"{Q.min_max('d', 0.2)} UNION ALL {Q.min_max('s', 0.8)}")))
def i6_convex(spark, sf_dir):
    return FU.fuse("convex", *both(spark, sf_dir), weight=0.2)


_Z = "SELECT query_id, chunk_id, CASE WHEN stddev_pop(score) OVER z < 1.1920929e-7 THEN 0.0::DOUBLE ELSE (score - avg(score) OVER z) / stddev_pop(score) OVER z END AS part FROM {} WINDOW z AS (PARTITION BY query_id)"


@query(_fusion_sql(Q.fused(f"{_Z.format('d')} UNION ALL {_Z.format('s')}")))
def i7_dbsf(spark, sf_dir):
    return FU.dbsf(*both(spark, sf_dir))


@query(
    _fusion_sql(
        "(SELECT query_id, chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY f.a, f.b)::INT AS rank, f.c AS score FROM (SELECT query_id, chunk_id, min({a: src, b: rank, c: score}) AS f FROM "
        "(SELECT 0 AS src, * FROM d UNION ALL SELECT 1, * FROM s) GROUP BY ALL))"
    )
)
def i8_union(spark, sf_dir):
    return FU.union(*both(spark, sf_dir))


@query(_fusion_sql(Q.top("(SELECT query_id, chunk_id, round((d.score + s.score) / 2, 7) AS score FROM d JOIN s USING (query_id, chunk_id))")))
def i9_intersection(spark, sf_dir):
    return FU.intersection(*both(spark, sf_dir))


@query(_fusion_sql(Q.fused(f"{Q.min_max('d', 0.4)} UNION ALL {Q.min_max('s', 0.3)} UNION ALL {Q.min_max('e', 0.3)}")).replace(" SELECT * FROM", f", e AS {Q.top('(' + Q.vector_scores('euclidean') + ')', 50)} SELECT * FROM", 1))
def i10_three_way(spark, sf_dir):
    return FU.three_way(*both(spark, sf_dir), dense_list(spark, sf_dir, metric="euclidean"))


_HYBRID = f"r AS (SELECT * FROM {Q.fused('SELECT query_id, chunk_id, 1 / (60::DOUBLE + rank) AS part FROM d UNION ALL SELECT query_id, chunk_id, 1 / (60::DOUBLE + rank) FROM s')} WHERE rank <= 10)"
_CARRIED = "SELECT r.*, d.score AS dense_score, s.score AS sparse_score FROM r LEFT JOIN d ON r.query_id = d.query_id AND r.chunk_id = d.chunk_id LEFT JOIN s ON r.query_id = s.query_id AND r.chunk_id = s.chunk_id"


def hybrid_list(spark, sf_dir, k=10):
    return FU.hybrid(*both(spark, sf_dir), k)


@query(f"WITH {Q.lists()}, {_HYBRID} {_CARRIED}")
def i2_hybrid(spark, sf_dir):
    return hybrid_list(spark, sf_dir)


@query(f"WITH {Q.lists()}, {_HYBRID}, c AS ({_CARRIED}) SELECT query_id, chunk_id, CASE WHEN rank % 3 = 0 THEN score ELSE coalesce(dense_score, sparse_score) END AS best FROM c")
def i14_best_score(spark, sf_dir):
    none = F.lit(None).cast("double")
    rows = hybrid_list(spark, sf_dir).withColumns({"rerank_score": none, "multivector_score": none, "fused_score": F.when(F.col("rank") % 3 == 0, F.col("score"))})
    return rows.select("query_id", "chunk_id", RK.best_score().alias("best"))


# ---- multi-vector: a 64-value vector as four tokens of 16


def token_lists(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    v, _ = vectors(spark, sf_dir)
    cut = F.transform(F.sequence(F.lit(0), F.lit(3)), lambda i: F.slice("vec", i * 16 + 1, F.lit(16)))
    v = v.select("chunk_id", cut.alias("tokens"))
    return v, v.filter(F.col("chunk_id") % Q.EVERY == 0).withColumnRenamed("chunk_id", "query_id")


_T = "t AS (SELECT vec_id, label, i, e[i * 16 + 1 : i * 16 + 16] AS x FROM (SELECT *, unnest(range(0, 4)) AS i FROM v))"


@query(f"WITH {Q.VECTORS}, {_T}, m AS (SELECT a.vec_id AS query_id, b.vec_id AS chunk_id, a.i, max(list_dot_product(a.x, b.x)) AS m FROM t a, t b WHERE a.vec_id % 50 = 0 GROUP BY ALL) SELECT * FROM {Q.top('(SELECT query_id, chunk_id, round(sum(m), 6) + 0.0::DOUBLE AS score FROM m GROUP BY ALL)', 10)}")
def j3_maxsim(spark, sf_dir):
    return MV.exact_search(*token_lists(spark, sf_dir), 10)


_CENTROIDS = "c AS (SELECT label AS centroid_id, list(m ORDER BY k) AS c FROM (SELECT label, k, round(avg(x[k]), 6) AS m FROM (SELECT label, x, unnest(range(1, 17)) AS k FROM t WHERE i = 0) GROUP BY label, k) GROUP BY label)"


def fixed_codec(spark, sf_dir, nbits=2) -> tuple[MV.Codec, DataFrame]:
    """A codec whose centroids are the labels' mean first tokens, with buckets learned on every residual; and the tokens."""
    lists, _ = token_lists(spark, sf_dir)
    tokens = MV.exploded(lists)
    labels = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("chunk_id"), "label")
    means = tokens.filter("token_idx = 0").join(labels, "chunk_id").select("label", F.posexplode("vec").alias("k", "x")).groupBy("label", "k").agg(F.round(F.avg(F.col("x").cast("double")), 6).alias("m"))
    got = means.groupBy("label").agg(F.array_sort(F.collect_list(F.struct("k", "m"))).alias("c")).orderBy("label").collect()  # a row per label
    centroids = np.array([[x.m for x in r.c] for r in got])
    codec = MV.Codec(centroids, np.zeros((16, (1 << nbits) - 1)), np.zeros((16, 1 << nbits)), nbits)
    buckets = MV.learn_buckets(residuals(tokens, centroids).select("vec"), nbits).orderBy("dim").collect()  # a row per dimension
    codec.cutoffs, codec.weights = np.array([r.cutoffs for r in buckets]), np.array([r.weights for r in buckets])
    return codec, tokens


def residuals(tokens: DataFrame, centroids: np.ndarray) -> DataFrame:
    """tokens with centroid_id and vec as the difference from it."""

    @F.pandas_udf("centroid_id int, vec array<double>")
    def rest(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for b in batches:
            x = np.array(b.tolist(), np.float64)
            own = MV.nearest(x, centroids)
            yield pd.DataFrame({"centroid_id": own.astype(np.int32), "vec": list(x - centroids[own])})

    return tokens.withColumn("r", rest(F.col("vec").cast("array<double>"))).select("chunk_id", "token_idx", "r.*")


_NEAR = "n AS (SELECT vec_id, i, x, arg_min(centroid_id, (d, centroid_id)) AS centroid_id FROM (SELECT t.vec_id, t.i, t.x, c.centroid_id, round(list_sum(list_transform(list_zip(t.x, c.c), lambda z: (z[1] - z[2]) * (z[1] - z[2]))), 9) AS d FROM t, c) GROUP BY vec_id, i, x)"
_RES = "r AS (SELECT n.vec_id, n.i, k, n.x[k] - c.c[k] AS y FROM (SELECT *, unnest(range(1, 17)) AS k FROM n) n JOIN c USING (centroid_id))"
_BUCKETS = "o AS (SELECT k, list(y ORDER BY y) AS y FROM r GROUP BY k), b AS (SELECT k, list_transform([1, 2, 3], lambda g: y[(g * len(y)) // 4 + 1]) AS cutoffs, list_transform([0, 1, 2, 3], lambda g: list_avg(y[(g * len(y)) // 4 + 1 : ((g + 1) * len(y)) // 4])) AS weights FROM o)"


@query(f"WITH {Q.VECTORS}, {_T}, {_CENTROIDS}, {_NEAR} SELECT vec_id AS chunk_id, i::INT AS token_idx, centroid_id::INT AS centroid_id FROM n")
def j5_nearest_centroid(spark, sf_dir):
    codec, tokens = fixed_codec(spark, sf_dir)
    return residuals(tokens, codec.centroids).select("chunk_id", "token_idx", "centroid_id")


@query(f"WITH {Q.VECTORS}, {_T}, {_CENTROIDS}, {_NEAR}, {_RES}, {_BUCKETS} SELECT (k - 1)::INT AS dim, round(cutoffs[1], 6) AS c1, round(cutoffs[2], 6) AS c2, round(cutoffs[3], 6) AS c3, round(weights[1], 6) AS w1, round(weights[2], 6) AS w2, round(weights[3], 6) AS w3, round(weights[4], 6) AS w4 FROM b")
def j6_buckets(spark, sf_dir):
    codec, tokens = fixed_codec(spark, sf_dir)
    b = MV.learn_buckets(residuals(tokens, codec.centroids).select("vec"), 2)
    at = lambda c, i: F.round(F.get(c, F.lit(i)), 6)
    return b.select("dim", *[at("cutoffs", i).alias(f"c{i + 1}") for i in range(3)], *[at("weights", i).alias(f"w{i + 1}") for i in range(4)])


@query(f"WITH {Q.VECTORS}, {_T}, {_CENTROIDS}, {_NEAR}, {_RES}, {_BUCKETS} SELECT vec_id AS chunk_id, i::INT AS token_idx, string_agg(len(list_filter(cutoffs, lambda z: y >= z))::VARCHAR, '' ORDER BY k) AS codes FROM r JOIN b USING (k) GROUP BY vec_id, i")
def j7_codes(spark, sf_dir):
    codec, tokens = fixed_codec(spark, sf_dir)
    lists = MV.MultiVectorIndex.build(tokens, codec).lists
    byte = lambda d: F.conv(F.substr(F.hex("packed"), F.floor(d / 4).cast("int") * 2 + 1, F.lit(2)), 16, 10).cast("int")
    codes = F.transform(F.sequence(F.lit(0), F.lit(15)), lambda d: F.floor(byte(d) / F.pow(F.lit(4), d % 4)).cast("int") % 4)
    codes = F.transform(codes, lambda x: x.cast("string"))
    return lists.select("chunk_id", "token_idx", F.array_join(codes, "").alias("codes"))


_PROBES = "g AS (SELECT vec_id AS query_id, i AS token_idx, centroid_id, s FROM (SELECT t.vec_id, t.i, c.centroid_id, round(list_dot_product(t.x, c.c), 9) AS s, row_number() OVER (PARTITION BY t.vec_id, t.i ORDER BY round(list_dot_product(t.x, c.c), 9) DESC, c.centroid_id) AS place FROM t, c WHERE t.vec_id % 50 = 0) WHERE place <= 3 AND s >= 0.01), h AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY token_idx, s DESC, centroid_id) AS n FROM g WHERE token_idx < 3) WHERE n <= 8)"
PROBES = MV.SearchConfig(k=10, nprobe=3, threshold=0.01, bound=8, t_prime=3)


@query(f"WITH {Q.VECTORS}, {_T}, {_CENTROIDS}, {_PROBES} SELECT query_id, token_idx::INT AS token_idx, centroid_id::INT AS centroid_id, round(s, 6) AS score FROM h")
def j10_centroids(spark, sf_dir):
    codec, tokens = fixed_codec(spark, sf_dir)
    asked_ = tokens.filter(F.col("chunk_id") % Q.EVERY == 0).withColumnRenamed("chunk_id", "query_id")
    return MV.MultiVectorIndex(codec, None).probes(asked_, PROBES).select("query_id", "token_idx", "centroid_id", F.round("centroid_score", 6).alias("score"))


@query(
    f"WITH {Q.VECTORS}, {_T}, {_CENTROIDS}, {_NEAR}, {_RES}, {_BUCKETS}, {_PROBES}, k AS (SELECT r.vec_id, r.i, list(b.weights[1 + len(list_filter(b.cutoffs, lambda z: r.y >= z))] ORDER BY r.k) AS y FROM r JOIN b USING (k) GROUP BY r.vec_id, r.i), "
    "p AS (SELECT h.query_id, h.token_idx, k.vec_id AS chunk_id, max(h.s + list_dot_product(t.x, k.y)) AS m FROM h JOIN t ON t.vec_id = h.query_id AND t.i = h.token_idx JOIN n ON n.centroid_id = h.centroid_id JOIN k ON k.vec_id = n.vec_id AND k.i = n.i GROUP BY ALL) "
    f"SELECT * FROM {Q.top('(SELECT query_id, chunk_id, round(sum(m), 6) AS score FROM p GROUP BY ALL)', 10)}"
)
def j12_inverted_search(spark, sf_dir):
    codec, tokens = fixed_codec(spark, sf_dir)
    return MV.MultiVectorIndex.build(tokens, codec).search(tokens.filter(F.col("chunk_id") % Q.EVERY == 0).withColumnRenamed("chunk_id", "query_id"), PROBES)


@query()
def j14_trained_search(spark, sf_dir):
    lists, asked_ = token_lists(spark, sf_dir)
    tokens = MV.exploded(lists)
    index = MV.MultiVectorIndex.build(tokens, MV.Codec.train(tokens, 8, 4))
    return MV.MultiVectorRetriever(index, lists, MV.SearchConfig(threshold=-1.0, nprobe=6)).retrieve(asked_, 10)


@query(
    f"WITH {Q.VECTORS}, a AS {Q.top('(' + Q.vector_scores() + ')', 20)}, b AS {Q.top('(' + Q.vector_scores('dot') + ')', 20)}, z AS (SELECT a.query_id, a.chunk_id, a.rank::DOUBLE AS x, CASE WHEN a.rank % 4 = 0 THEN -b.score ELSE b.score END AS y FROM a JOIN b USING (query_id, chunk_id)), "
    "w AS (SELECT query_id, sign((a.x - b.x) * (a.y - b.y)) AS s FROM z a JOIN z b USING (query_id) WHERE a.chunk_id < b.chunk_id) SELECT query_id, round((count(*) FILTER (s > 0) - count(*) FILTER (s < 0))::DOUBLE / count(*) FILTER (s <> 0), 6) AS tau FROM w GROUP BY query_id"
)
def j16_kendall(spark, sf_dir):
    a, b = dense_list(spark, sf_dir, 20), dense_list(spark, sf_dir, 20, "dot")
    rows = a.join(b.select("query_id", "chunk_id", F.col("score").alias("y")), ["query_id", "chunk_id"])
    rows = rows.select("query_id", F.col("chunk_id").alias("id"), F.col("rank").cast("double").alias("x"), F.when(F.col("rank") % 4 == 0, -F.col("y")).otherwise(F.col("y")).alias("y"))
    return M.kendall_tau(rows).select("query_id", F.round("tau", 6).alias("tau"))


# ---- rerankers: a query is a whole passage

_POOL = f"WITH {Q.POSTINGS}, s AS {Q.top('(' + Q.BM25 + ')', 20)}, x AS (SELECT s.*, lower(b.q) AS q1, lower(d.text) AS c1 FROM s JOIN (SELECT item_id, text AS q FROM benchmark) b ON s.query_id = b.item_id JOIN documents d ON s.chunk_id = d.doc_id)"
_TERMS = r"list_filter(regexp_split_to_array(q1, '[\s\p{Z}]+'), lambda w: w <> '')"
_LEX = (
    f"(SELECT query_id, chunk_id, 0.3::DOUBLE * contains(c1, q1)::INT + 0.5::DOUBLE * len(list_filter({_TERMS}, lambda w: contains(c1, w))) / len({_TERMS}) + 0.2::DOUBLE * "
    f"coalesce(list_sum(list_transform(list_filter({_TERMS}, lambda w: contains(c1, w)), lambda w: 1 / (1 + octet_length(encode(substr(c1, 1, strpos(c1, w) - 1))) / 100::DOUBLE))), 0) / len({_TERMS}) AS v FROM x)"
)
_OVER = rf"(SELECT query_id, chunk_id, len(list_intersect(list_distinct({_TERMS}), regexp_split_to_array(c1, '[\s\p{{Z}}]+')))::DOUBLE / len(list_distinct({_TERMS})) AS v FROM x)"


def pool(spark, sf_dir) -> DataFrame:
    return R.candidates(sparse_list(spark, sf_dir, 20), asked(spark, sf_dir), chunks(spark, sf_dir), 20)


@query(f"{_POOL} SELECT * FROM {Q.top(f'(SELECT query_id, chunk_id, round(v, 6) AS score FROM {_LEX})', 10)}")
def k1_lexical(spark, sf_dir):
    return R.rerank(pool(spark, sf_dir), R.lexical_score(F.col("query"), F.col("content")), 10)


@query(f"{_POOL} SELECT * FROM {Q.top(f'(SELECT query_id, chunk_id, round(v, 6) AS score FROM {_OVER})', 10)}")
def k2_overlap(spark, sf_dir):
    return R.rerank(pool(spark, sf_dir), R.overlap_score(F.col("query"), F.col("content")), 10)


@query(f"{_POOL} SELECT * FROM {Q.top(f'(SELECT query_id, chunk_id, round(0.6::DOUBLE * a.v + 0.4::DOUBLE * b.v, 6) AS score FROM {_LEX} a JOIN {_OVER} b USING (query_id, chunk_id))', 10)}")
def k3_composite(spark, sf_dir):
    q, c = F.col("query"), F.col("content")
    return R.rerank(pool(spark, sf_dir), R.composite_score([(R.lexical_score(q, c), 0.6), (R.overlap_score(q, c), 0.4)]), 10)


@query(f"WITH {Q.POSTINGS} SELECT * FROM {Q.top('(' + Q.BM25 + ')', 5)}")
def k4_noop(spark, sf_dir):
    return R.rerank(pool(spark, sf_dir), R.composite_score([]), 5)


@query("SELECT d::INT AS dim, b::INT AS nbits, ((d * b + 7) // 8)::INT AS packed FROM (SELECT unnest([16, 63, 128]) AS d), (SELECT unnest([2, 4]) AS b)")
def j15_packed_sizes(spark, sf_dir):
    rows = [(d, b, MV.Codec(np.zeros((1, d)), np.zeros((d, 1)), np.zeros((d, 1)), b).packed_size) for d in (16, 63, 128) for b in (2, 4)]
    return spark.createDataFrame(rows, "dim int, nbits int, packed int")


@query(f"{_POOL.replace('20)', '9)')} SELECT * FROM {Q.top(f'(SELECT query_id, chunk_id, round(v, 6) AS score FROM {_LEX})', 3)}")
def k5_pool(spark, sf_dir):
    """Three times as many candidates as are kept."""
    return R.rerank(R.candidates(sparse_list(spark, sf_dir, 20), asked(spark, sf_dir), chunks(spark, sf_dir), 9), R.lexical_score(F.col("query"), F.col("content")), 3)


@query()
def m22_pipeline(spark, sf_dir):
    """Chunks, vectors and postings of all documents, then contexts for the benchmark's passages."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("content"), F.col("source").alias("title"))
    config = Config(E.MockEmbedder(64), lambda q, c: R.lexical_score(q, c), "sentence")
    return Pipeline.index(docs, config).contexts(asked(spark, sf_dir), 5)
