"""The retrieval pipeline: documents to an index, query batches to ranked results and contexts. Everything is a DataFrame."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import chunk as C
from ..operators import context as CX
from ..operators import dense as D
from ..operators import embed as E
from ..operators import fusion as FU
from ..operators import rerank as R
from ..operators.sparse import SparseIndex
from ..sources.tables import stored


@dataclass
class Config:
    embedder: object
    reranker: object  # column function (query, content) -> score, or None to keep the order
    strategy: str = "recursive"
    chunk_options: dict = field(default_factory=dict)
    fusion: str = "rrf"
    candidates: int = FU.CANDIDATES
    metric: str = "cosine"
    budget: int = CX.BUDGET
    cite: bool = True
    dedup: bool = False

    def __post_init__(self) -> None:
        if self.embedder is None:
            raise ValueError("a pipeline needs an embedder")
        if self.fusion not in FU.STRATEGIES:
            raise ValueError(f"unknown fusion strategy {self.fusion!r}")


@dataclass
class Pipeline:
    config: Config
    chunks: DataFrame
    vectors: DataFrame
    sparse: SparseIndex

    @classmethod
    def index(cls, docs: DataFrame, config: Config) -> Pipeline:
        """docs: (doc_id, content, title). Chunks, vectors and postings are written once, from the same chunks."""
        chunks = C.chunk(docs, config.strategy, **config.chunk_options)
        if config.dedup:
            chunks = C.first_of_equal(chunks)
        chunks = stored(chunks.join(docs.select("doc_id", "title"), "doc_id") if "title" in docs.columns else chunks.withColumn("title", F.lit(None).cast("string")), "chunks")
        vectors = config.embedder.embed(chunks) if isinstance(config.embedder, E.TfIdf) else E.embedded(chunks, config.embedder).select("chunk_id", "vec")
        return cls(config, chunks, stored(vectors, "vectors"), SparseIndex.build(chunks.select("chunk_id", "content")))

    def save(self, path: str, codec: str = "zstd") -> str:
        """Chunks, vectors and postings, as `load` reads them."""
        self.chunks.write.option("compression", codec).parquet(f"{path}/chunks")
        self.vectors.write.option("compression", codec).parquet(f"{path}/vectors")
        self.sparse.save(f"{path}/sparse", codec)
        return path

    @classmethod
    def load(cls, spark: SparkSession, path: str, config: Config) -> Pipeline:
        return cls(config, spark.read.parquet(f"{path}/chunks"), spark.read.parquet(f"{path}/vectors"), SparseIndex.load(spark, f"{path}/sparse"))

    def _query_vectors(self, queries: DataFrame) -> DataFrame:
        if isinstance(self.config.embedder, E.TfIdf):
            return self.config.embedder.embed(queries.withColumnRenamed("text", "content"), "query_id")
        return E.embedded(queries, self.config.embedder, "text", query=True).select("query_id", "vec")

    def dense(self, queries: DataFrame, k: int) -> DataFrame:
        return D.search(self.vectors, self._query_vectors(queries), k, self.config.metric)

    def retrieve(self, queries: DataFrame, k: int = 10, mode: str = "hybrid") -> DataFrame:
        """(query_id, text) to (query_id, chunk_id, rank, score, dense_score, sparse_score)."""
        n = self.config.candidates
        none = F.lit(None).cast("double")
        if mode == "dense":
            return self.dense(queries, k).withColumns({"dense_score": F.col("score"), "sparse_score": none})
        if mode == "sparse":
            return self.sparse.search(queries, k).withColumns({"dense_score": none, "sparse_score": F.col("score")})
        if mode != "hybrid":
            raise ValueError(f"unknown mode {mode!r}")
        return FU.hybrid(self.dense(queries, n), self.sparse.search(queries, n), k, self.config.fusion)

    def query(self, queries: DataFrame, k: int = 10, mode: str = "hybrid", pool: int = 2) -> DataFrame:
        """The k best of `pool` times as many, reranked, with their chunks."""
        found = stored(self.retrieve(queries, pool * k if self.config.reranker else k, mode), "retrieved")
        if self.config.reranker:
            rows = R.candidates(found, queries, self.chunks, pool * k)
            found = R.rerank(rows, self.config.reranker(F.col("query"), F.col("content")), k)
        return found.join(self.chunks.select("chunk_id", "doc_id", "content", "title"), "chunk_id")

    def contexts(self, queries: DataFrame, k: int = 10, strategy: str = "sequential") -> DataFrame:
        """(query_id, context, plain, citations, total_tokens)."""
        assemble = {"sequential": CX.sequential, "interleaved": CX.interleaved, "grouped": CX.grouped}[strategy]
        return CX.rendered(assemble(self.query(queries, k), self.config.budget, self.config.cite))
