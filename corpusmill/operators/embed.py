"""Embedders. An embedder has `dimension` and `embed_batch(list[str]) -> list[vector | None]`; `embedded` runs it in Arrow batches.

The TF-IDF embedder is DataFrame code throughout: its vocabulary is a table of at most `dimension` rows, stored with the
index, so that queries and chunks share axes.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions import vectors as V

BATCH = 256


class MockEmbedder:
    """Deterministic unit vectors of the text's hash."""

    def __init__(self, dimension: int = 384, query_prefix: str = "", document_prefix: str = "", unit: bool = True):
        self.dimension, self.query_prefix, self.document_prefix, self.unit = dimension, query_prefix, document_prefix, unit

    def column(self, text: Column) -> Column:
        """The same kind of vector without Python: null for an empty text."""
        return V.hash_embedding(text, self.dimension, self.unit)

    def embed_batch(self, texts: list[str]) -> list:
        import zlib

        out = []
        for t in texts:
            v = np.random.default_rng(zlib.crc32(t.encode())).uniform(-1, 1, self.dimension) if t else None
            out.append(v if v is None or not self.unit else v / np.linalg.norm(v))
        return out


def embedded(df: DataFrame, embedder, text: str = "content", name: str = "vec", query: bool = False) -> DataFrame:
    """df with the vector of its text, prefixed as the embedder asks for queries or documents. Empty texts get null, so rows and
    vectors stay together."""
    prefix = getattr(embedder, "query_prefix" if query else "document_prefix", "")
    c = F.when(F.length(text) > 0, F.concat(F.lit(prefix), F.col(text)))
    if hasattr(embedder, "column"):
        return df.withColumn(name, embedder.column(c))

    @F.pandas_udf("array<double>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for b in batches:
            out: list = [None] * len(b)
            some = [i for i, t in enumerate(b) if t]
            for at in range(0, len(some), BATCH):
                part = some[at : at + BATCH]
                for i, v in zip(part, embedder.embed_batch([b.iloc[i] for i in part])):
                    out[i] = v
            yield pd.Series(out, dtype="object")

    return df.withColumn(name, run(c))


@dataclass
class TfIdf:
    """vocabulary (term, idx, idf): the `dimension` terms of most documents, n documents in all."""

    vocabulary: DataFrame
    dimension: int
    n: int

    @classmethod
    def fit(cls, docs: DataFrame, dimension: int = 384) -> TfIdf:
        n = docs.count()
        if not n:
            raise ValueError("no documents to learn from")
        df = docs.select(F.explode(F.array_distinct(X.white_tokens(F.col("content")))).alias("term")).groupBy("term").agg(F.count("*").alias("df"))
        top = df.orderBy(F.col("df").desc(), "term").limit(dimension)
        idx = F.row_number().over(W.orderBy(F.col("df").desc(), "term")) - 1  # over `dimension` rows
        return cls(top.select("term", idx.alias("idx"), (F.log(F.lit(float(n)) / F.col("df")) + 1).alias("idf")), dimension, n)

    def weights(self, docs: DataFrame, key: str = "chunk_id") -> DataFrame:
        """(key, term, idx, weight): vectors of length 1, by term; texts without a known term have none."""
        # `dimension` rows at most, so they go into the plan, and a document's weights come from its row alone
        known = self.vocabulary.orderBy("idx").collect()
        if not known:
            return docs.select(key, F.lit("").alias("term"), F.lit(0).alias("idx"), F.lit(0.0).alias("weight")).limit(0)
        terms, idf = F.array(*[F.lit(r.term) for r in known]), F.array(*[F.lit(r.idf) for r in known])
        at = F.map_from_arrays(terms, F.sequence(F.lit(0), F.lit(len(known) - 1)))
        w = X.white_tokens(F.col("content"))
        rows = docs.select(key, w.alias("w")).select(key, F.size("w").alias("n"), F.sort_array(F.filter(F.transform("w", lambda x: F.try_element_at(at, x)), lambda i: i.isNotNull())).alias("i"))
        rows = rows.filter(F.size("i") > 0).withColumn("d", F.array_distinct("i")).withColumn("p", F.transform("d", lambda d: F.array_position("i", d)))
        c = F.transform("p", lambda p, j: F.coalesce(F.get("p", j + 1), F.size("i") + 1) - p)  # equal ones stand together
        rows = rows.withColumn("x", F.zip_with("d", c, lambda d, k: k / F.col("n") * F.get(idf, d)))
        norm = F.sqrt(F.aggregate("x", F.lit(0.0), lambda s, x: s + x * x))
        rows = rows.withColumn("norm", norm).select(key, "norm", F.inline(F.arrays_zip("d", "x")))
        return rows.select(key, F.get(terms, F.col("d")).alias("term"), F.col("d").alias("idx"), (F.col("x") / F.col("norm")).alias("weight"))

    def embed(self, docs: DataFrame, key: str = "chunk_id") -> DataFrame:
        """(key, vec): dense vectors; zeros where no term is known."""
        packed = self.weights(docs, key).groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("idx", "weight"))).alias("m"))
        axes = F.sequence(F.lit(0), F.lit(self.dimension - 1))
        rows = docs.select(key).join(packed, key, "left")
        return rows.select(key, F.transform(axes, lambda i: F.coalesce(F.try_element_at(F.coalesce("m", F.create_map().cast("map<int,double>")), i), F.lit(0.0))).alias("vec"))


def create(kind: str, dimension: int = 384, documents: DataFrame | None = None, model=None):
    """By name: mock, tfidf (fitted on the documents) or an injected model."""
    if kind == "mock":
        return MockEmbedder(dimension)
    if kind == "tfidf":
        if documents is None:
            raise ValueError("the tfidf embedder learns from documents")
        return TfIdf.fit(documents, dimension)
    if model is None:
        raise ValueError(f"embedder {kind!r} needs a model with dimension and embed_batch")
    return model
