"""Command line: index, query, info, demo, transcribe, extract-frames, eval (sample, generate, retrieve, judge, metrics, compare, gate).

What needs a model takes it as module:function, which is imported: an embedder (an object with `dimension` and `embed_batch`), a
question writer (content to answer), a judge (query and content to answer), a frame extractor (video bytes to frame paths).
"""

from __future__ import annotations

import argparse
import importlib
import json
import sys
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import chunk as C
from ..operators import embed as E
from ..operators import evaluate as EV
from ..operators import metrics as M
from ..operators import rerank as R
from ..operators import store as ST
from ..operators.preprocess import hyde_text
from ..operators.sparse import SparseIndex
from ..sources import files as S
from ..sources.tables import exists, stored
from .pipeline import Config, Pipeline

RESULT = "query string, domain string, course string, latency_s double, results array<struct<content:string,source:string,score:double,title:string,start_secs:double,end_secs:double>>"
JUDGMENT = "query string, rank int, relevant boolean, reasoning string, source string, score double"


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="corpusmill")
    sub = p.add_subparsers(dest="command", required=True)
    i = sub.add_parser("index", help="files to chunk tables, with a manifest")
    i.add_argument("path")
    i.add_argument("--output", required=True)
    i.add_argument("--chunk-size", type=int, default=512)
    i.add_argument("--chunk-overlap", type=int, default=50)
    i.add_argument("--strategy", default="auto", choices=["auto", "fixed", "recursive", "sentence", "paragraph", "structural", "timestamp"])
    i.add_argument("--no-recursive", action="store_true")
    i.add_argument("--exclude", action="append", default=[])
    i.add_argument("--dedup", action="store_true")
    i.add_argument("--embedder", default="hash", help="hash, tfidf or module:object")
    i.add_argument("--dimension", type=int, default=384)
    i.add_argument("--compression", default="zstd", choices=["zstd", "lz4", "snappy", "gzip", "none"])
    q = sub.add_parser("query", help="search an index")
    q.add_argument("text")
    q.add_argument("--index", required=True)
    q.add_argument("--top-k", type=int, default=5)
    q.add_argument("--mode", default="hybrid", choices=["dense", "sparse", "hybrid"])
    q.add_argument("--fusion", default="rrf", choices=["rrf", "linear", "dbsf"])
    q.add_argument("--format", default="text", choices=["text", "json"])
    q.add_argument("--rerank", action="store_true")
    q.add_argument("--hyde", action="store_true")
    n = sub.add_parser("info", help="sizes of an index")
    n.add_argument("index")
    d = sub.add_parser("demo", help="index and query three short texts")
    d.add_argument("--query", default="memory safety")
    t = sub.add_parser("transcribe", help="list media that have no sidecar and are not in the manifest")
    t.add_argument("path")
    t.add_argument("--manifest")
    x = sub.add_parser("extract-frames", help="frames of the videos that have none yet")
    x.add_argument("path")
    x.add_argument("--extractor", required=True)
    x.add_argument("--no-recursive", action="store_true")
    x.add_argument("--skip-existing", action="store_true")
    x.add_argument("--dry-run", action="store_true")
    x.add_argument("--exclude", action="append", default=[])
    e = sub.add_parser("eval").add_subparsers(dest="what", required=True)
    s = e.add_parser("sample")
    s.add_argument("--index", required=True)
    s.add_argument("--output", required=True)
    s.add_argument("--size", type=int, default=EV.SAMPLE)
    s.add_argument("--seed", type=int, default=EV.SEED)
    w = e.add_parser("generate", help="questions for sampled chunks")
    w.add_argument("--index", required=True)
    w.add_argument("--output", required=True)
    w.add_argument("--model", required=True)
    w.add_argument("--size", type=int, default=EV.SAMPLE)
    w.add_argument("--seed", type=int, default=EV.SEED)
    r = e.add_parser("retrieve", help="results of an index for questions")
    r.add_argument("--index", required=True)
    r.add_argument("--queries", required=True)
    r.add_argument("--output", required=True)
    r.add_argument("--top-k", type=int, default=10)
    r.add_argument("--mode", default="hybrid", choices=["dense", "sparse", "hybrid"])
    r.add_argument("--fusion", default="rrf", choices=["rrf", "linear", "dbsf"])
    j = e.add_parser("judge", help="relevance of results")
    j.add_argument("--results", required=True)
    j.add_argument("--output", required=True)
    j.add_argument("--model", required=True)
    j.add_argument("--cache")
    m = e.add_parser("metrics")
    m.add_argument("--results", required=True)
    m.add_argument("--judgments", required=True)
    m.add_argument("--output")
    c = e.add_parser("compare")
    c.add_argument("baseline")
    c.add_argument("candidate")
    g = e.add_parser("gate")
    g.add_argument("results")
    g.add_argument("--min-mrr", type=float, default=0.5)
    g.add_argument("--min-hit5", type=float, default=0.7)
    return p


def _index(spark: SparkSession, a) -> None:
    files = S.discover(spark, a.path, not a.no_recursive, a.exclude, tuple(S.Loaders().extensions))
    docs = S.Loaders().load(spark, a.path, not a.no_recursive, a.exclude)
    options = {"size": a.chunk_size, "overlap": a.chunk_overlap} if a.strategy in ("fixed", "recursive") else {}
    chunks = C.chunk(docs.filter("error is null"), a.strategy, **options)
    if a.dedup:
        chunks = C.first_of_equal(chunks)
    meta = docs.select("doc_id", "title", "source")
    chunks.join(meta, "doc_id").write.mode("overwrite").option("compression", a.compression).parquet(f"{a.output}/chunks")
    chunks = spark.read.parquet(f"{a.output}/chunks")
    embedder, vectors = _vectors(chunks, a.embedder, a.dimension)
    vectors.write.mode("overwrite").option("compression", a.compression).parquet(f"{a.output}/vectors")
    if isinstance(embedder, E.TfIdf):
        embedder.vocabulary.coalesce(1).write.mode("overwrite").parquet(f"{a.output}/vocabulary")
    SparseIndex.build(chunks.select("chunk_id", "content")).save(f"{a.output}/sparse", a.compression, "overwrite")
    n = chunks.count()
    about = {"embedder": a.embedder, "dimension": embedder.dimension, "n": n}
    spark.createDataFrame([(json.dumps(about),)], "value string").coalesce(1).write.mode("overwrite").text(f"{a.output}/embedder")
    ST.manifest(files, n).write.mode("overwrite").text(f"{a.output}/manifest")
    bad = docs.filter("error is not null").count()
    print(f"{n} chunks of {docs.count()} documents; {bad} could not be read")


def imported(name: str):
    """module:attribute; a class is made without arguments."""
    module, _, attribute = name.partition(":")
    found = getattr(importlib.import_module(module), attribute)
    return found() if isinstance(found, type) else found


def _vectors(chunks: DataFrame, name: str, dimension: int) -> tuple[object, DataFrame]:
    if name == "tfidf":
        fitted = E.TfIdf.fit(chunks.withColumn("doc_id", F.col("chunk_id")), dimension)
        return fitted, fitted.embed(chunks)
    embedder = E.MockEmbedder(dimension) if name == "hash" else imported(name)
    return embedder, E.embedded(chunks, embedder).select("chunk_id", "vec")


def opened(spark: SparkSession, path: str, reranker: Callable | None = None, fusion: str = "rrf") -> Pipeline:
    """The index in a folder, with the embedder it was made with."""
    about = json.loads(spark.read.text(f"{path}/embedder").first().value)
    if about["embedder"] == "tfidf":
        embedder = E.TfIdf(spark.read.parquet(f"{path}/vocabulary"), about["dimension"], about["n"])
    else:
        embedder = E.MockEmbedder(about["dimension"]) if about["embedder"] == "hash" else imported(about["embedder"])
    return Pipeline.load(spark, path, Config(embedder, reranker, fusion=fusion))


def _query(spark: SparkSession, a) -> None:
    p = opened(spark, a.index, (lambda q, c: R.lexical_score(q, c)) if a.rerank else None, a.fusion)
    queries = spark.createDataFrame([(0, a.text)], "query_id int, text string")
    if a.hyde:
        queries = queries.withColumn("text", hyde_text(F.col("text")))
    found = p.query(queries, a.top_k, a.mode, pool=3).withColumns({"source": F.col("doc_id"), **{c: F.lit(None).cast("double") for c in ("start_secs", "end_secs")}})
    show = ST.results_json(found).select("rank", F.col("json").alias("line")) if a.format == "json" else ST.results_text(found).select("rank", "line")
    for r in show.orderBy("rank").collect():  # top-k rows
        print(r.line)


def _asks(name: str) -> Callable:
    """A function of texts to an answer, as a column function."""
    model = imported(name)

    @F.pandas_udf("string")
    def run(*texts: pd.Series) -> pd.Series:
        return pd.Series([model(*x) for x in zip(*texts)], dtype="object")

    return run


def retrieved(p: Pipeline, queries: DataFrame, k: int, mode: str) -> DataFrame:
    """(query, domain, course) to RESULT rows, a query without results too. A batch has no latency of its own: it is null."""
    asked = queries.select(F.xxhash64("query", "domain", "course").alias("query_id"), "query", "domain", "course").dropDuplicates(["query_id"])
    found = p.query(asked.select("query_id", F.col("query").alias("text")), k, mode)
    one = F.struct("rank", "content", F.col("doc_id").alias("source"), "score", "title", F.lit(None).cast("double").alias("start_secs"), F.lit(None).cast("double").alias("end_secs"))
    lists = found.groupBy("query_id").agg(F.array_sort(F.collect_list(one)).alias("r"))  # k rows at most
    rows = asked.join(lists, "query_id", "left")
    of = F.transform(F.coalesce("r", F.array().cast(lists.schema["r"].dataType)), lambda x: x.dropFields("rank"))
    return rows.select("query", "domain", "course", F.lit(None).cast("double").alias("latency_s"), of.alias("results"))


def judged(spark: SparkSession, results: DataFrame, ask: Callable, cache: DataFrame, model: str) -> tuple[DataFrame, DataFrame]:
    """JUDGMENT rows of RESULT rows, and the cache with what was asked."""
    rows = results.select("query", F.posexplode("results").alias("rank", "r")).select("query", (F.col("rank") + 1).alias("rank"), "r.content", "r.source", "r.score")
    done, known = EV.judge(rows, cache, ask, model)
    return done.filter("relevant is not null").select("query", "rank", "relevant", "reasoning", "source", "score"), known


def _frames(spark: SparkSession, a) -> None:
    files = S.discover(spark, a.path, not a.no_recursive, a.exclude, S.VIDEO)
    todo = S.without_frames(spark, files, a.path) if a.skip_existing else files.select("path")
    paths = [r.path for r in todo.orderBy("path").toLocalIterator()]
    if a.dry_run or not paths:
        print("\n".join(paths))
        return
    for r in S.extracted_frames(spark, paths, imported(a.extractor)).orderBy("path").toLocalIterator():
        print(f"{r.path}: {r.error or f'{len(r.value or [])} frames'}")


def read_eval(spark: SparkSession, results: str, judgments: str) -> DataFrame:
    """Per-query metrics of JSON lines; a line that cannot be read is an error."""
    read = lambda path, schema: spark.read.schema(schema).option("mode", "FAILFAST").json(path)
    rows = read(results, RESULT).select("query", "domain", "latency_s", F.posexplode("results").alias("rank", "r")).withColumn("rank", F.col("rank") + 1)
    # the last line of a file holds, and of files the last by name: places of bytes, whatever way files are split
    j = read(judgments, JUDGMENT)
    at = F.struct(F.col("_metadata.file_path"), F.col("_metadata.file_block_start"), F.monotonically_increasing_id())
    j = j.select("*", at.alias("seq"))
    return M.eval_per_query(M.judged(rows, j))


def _eval(spark: SparkSession, a) -> int:
    if a.what == "sample":
        EV.sample(spark.read.parquet(f"{a.index}/chunks"), a.size, seed=a.seed).write.mode("overwrite").json(a.output)
    elif a.what == "generate":
        some = EV.sample(spark.read.parquet(f"{a.index}/chunks"), a.size, seed=a.seed)
        EV.ground_truth(some, _asks(a.model)).select("query", F.col("content").alias("chunk_content"), F.col("source").alias("chunk_source"), "domain", "course").write.mode("overwrite").json(a.output)
    elif a.what == "retrieve":
        queries = spark.read.schema("query string, domain string, course string").json(a.queries).filter("query is not null")
        retrieved(opened(spark, a.index, None, a.fusion), queries, a.top_k, a.mode).write.mode("overwrite").json(a.output)
    elif a.what == "judge":
        kinds = "key string, relevant boolean, reasoning string, model string"
        known = spark.read.schema(kinds).json(a.cache) if a.cache and exists(spark, a.cache) else spark.createDataFrame([], kinds)
        done, after = judged(spark, spark.read.schema(RESULT).json(a.results), _asks(a.model), known, a.model)
        after = stored(after, "judge-cache")
        done, _ = judged(spark, spark.read.schema(RESULT).json(a.results), _asks(a.model), after, a.model)
        done.write.mode("overwrite").json(a.output)
        if a.cache:
            after.write.mode("overwrite").json(a.cache)
    elif a.what == "metrics":
        agg = M.eval_aggregate(read_eval(spark, a.results, a.judgments))
        for r in EV.summary(agg).collect():  # a row per domain
            print(r.line)
        if a.output:
            agg.write.mode("overwrite").json(a.output)
    else:
        whole = lambda path: spark.read.json(path).filter("domain is null") if "domain" in spark.read.json(path).columns else spark.read.json(path)
        if a.what == "compare":
            M.compared(whole(a.baseline), whole(a.candidate)).show(truncate=False)
        else:
            failed = M.gate(whole(a.results), a.min_mrr, a.min_hit5).collect()
            for r in failed:
                print(f"{r.metric} {r.value:.4f} is below {r.least}")
            return int(bool(failed))
    return 0


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    a = parser().parse_args(argv)
    spark = spark or SparkSession.builder.appName("corpusmill").getOrCreate()
    if a.command == "index":
        _index(spark, a)
    elif a.command == "query":
        _query(spark, a)
    elif a.command == "info":
        spark.read.parquet(f"{a.index}/chunks").agg(F.count_distinct("doc_id").alias("documents"), F.count("*").alias("chunks"), F.sum(F.octet_length("content")).alias("bytes")).show()
    elif a.command == "extract-frames":
        _frames(spark, a)
    elif a.command == "transcribe":
        files = S.discover(spark, a.path)
        known = spark.read.schema("path string, status string").json(a.manifest) if a.manifest else spark.createDataFrame([], "path string, status string")
        S.to_transcribe(files.filter(F.col("extension").isin(*S.MEDIA)).select("path"), files, known).show(truncate=False)
    elif a.command == "demo":
        rows = [("a", "Memory safety without a garbage collector is what ownership gives.", "One"), ("b", "Vector search ranks texts by the angle between embeddings.", "Two"), ("c", "Soup is best when it is hot.", "Three")]
        p = Pipeline.index(spark.createDataFrame(rows, "doc_id string, content string, title string"), Config(E.MockEmbedder(64), lambda q, c: R.lexical_score(q, c)))
        p.contexts(spark.createDataFrame([(0, a.query)], "query_id int, text string"), 2).show(truncate=False)
    else:
        return _eval(spark, a)
    return 0


if __name__ == "__main__":
    sys.exit(main())
