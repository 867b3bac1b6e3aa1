"""Toxicity from the nearest labelled examples.

Labelled examples are TF-IDF vectors over all terms that `SUPPORT` of them hold; words, and the first letters of longer
words, are terms, and a count is a weight as it is. Each term has an inverted list of the examples that hold it, and with it
the largest weight in each block of `BLOCK` examples; the lists of the most frequent terms are kept as rows and summed first.
A text's other terms are taken by falling share in the best possible score:
their lists are summed until what all terms left could add lies below the K-th best sum, so no example that was not met can be
among the `K` nearest; of those met, only examples whose sum and the bound of their block for the terms left reach
that far are scored in full, after the lists left where these are shorter than such examples. So the neighbours by cosine are exact. (A term that fewer examples hold would lengthen a text's
vector, thus scale all its cosines alike; within an example it counts as noise.)
Votes, weighted by squared cosine, give a raw score, which a curve learned leave-one-out on the examples turns into
a probability. The neighbours are returned as evidence.

Examples are a sample of `EXAMPLES` rows of each label at most, those of the smallest hashes. Document frequencies cover
all documents, and every whole text is scored.

Defined cases: null and empty texts, and those without a term, get the share of label 1 among such examples; an id
with several labels counts by their mean, halves as 1; without labelled rows all score 0; ties between neighbours go
to the earlier example; an empty table gives no rows; repeated rows get equal scores; other columns pass through
`with_toxicity`, but for one named like what it makes.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import written
from .langid import enough, fold_remainder, hash_bound

EXAMPLES = (1500, 3000)  # label 1, label 0
SUPPORT = 3
K = 25
BLOCK = 64
STEM = 5
STEP = 8192  # list entries that are summed between two looks at the bound
GATHER = 32  # frequent terms' rows that are summed at once
TEXTS = 64  # texts whose most frequent terms are summed in one product
WORD = re.compile(r"[^\W\d_]+")
NO_LETTER = {c: " " for c in range(128) if not WORD.match(chr(c))}


def split(text: str | None) -> list[str]:
    """The words in lower case. An ASCII text has them between characters that are no letters, which is found faster."""
    low = (text or "").lower()
    return low.translate(NO_LETTER).split() if low.isascii() else WORD.findall(low)


def terms(text: str | None) -> Counter:
    """Counts of words; of longer words also, marked, of the first letters."""
    words = Counter(split(text))
    stems: Counter = Counter()
    for w, n in words.items():
        if len(w) > STEM:
            stems["^" + w[:STEM]] += n
    return words + stems


def _lists(ptr: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of all entries of these keys' lists, and the lists' lengths."""
    n = ptr[keys + 1] - ptr[keys]
    return np.repeat(ptr[keys] - np.cumsum(n) + n, n) + np.arange(n.sum()), n


def _pointers(sorted_keys: np.ndarray, n: int) -> np.ndarray:
    return np.searchsorted(sorted_keys, np.arange(n + 1))


class Index:
    """Block-max inverted lists of the examples, and what turns votes into scores."""

    def __init__(self, vocab: list[str], idf: np.ndarray, examples: list[tuple[int, int, np.ndarray, np.ndarray]], rate: tuple[float, float]):
        """examples: (id, label, terms, counts). rate: label 1's and label 0's share of all labelled rows over their share here."""
        self.at = {v: i for i, v in enumerate(vocab)}
        self.idf = idf
        rows = [(i, y, *self._vector(np.asarray(t, np.int64), np.asarray(c, np.float64))) for i, y, t, c in examples if len(t)]
        # examples with the same strongest term stand together, which tightens the blocks' bounds
        rows.sort(key=lambda r: (int(r[2][r[3].argmax()]), r[0]))
        self.ids, self.y = np.array([r[0] for r in rows], np.int64), np.array([r[1] for r in rows], np.float64)
        size = np.array([len(r[2]) for r in rows], np.int64)
        self.row = np.concatenate([[0], np.cumsum(size)]).astype(np.int64)
        none = np.zeros(0)
        self.term, self.weights = np.concatenate([none, *[r[2] for r in rows]]).astype(np.int32), np.concatenate([none, *[r[3] for r in rows]]).astype(np.float32)
        order = np.argsort(self.term, kind="stable")
        self.list = _pointers(self.term[order], len(vocab))
        self.who, self.impact = np.repeat(np.arange(len(rows), dtype=np.int32), size)[order], self.weights[order]
        block = self.who // BLOCK
        key = self.term[order].astype(np.int64) * (len(rows) // BLOCK + 1) + block
        head = np.flatnonzero(np.diff(key, prepend=-1))
        self.block_list = _pointers(self.term[order][head], len(vocab))
        self.block, self.block_top = block[head], np.maximum.reduceat(self.impact, head) if len(head) else self.impact
        self.top = np.zeros(len(vocab), np.float32)
        np.maximum.at(self.top, self.term, self.weights)
        self.weight = np.where(self.y == 1, *rate)
        bare = [(y, rate[0] if y else rate[1]) for _, y, t, _ in examples if not len(t)]
        self.empty = sum(y * w for y, w in bare) / sum(w for _, w in bare) if bare else float(np.average(self.y, weights=self.weight)) if len(rows) else 0.0
        self.curve = (np.array([0.0, 1.0]), np.array([0.0, 1.0]))
        self._rows: tuple[np.ndarray, np.ndarray] | None = None  # made where it is used

    def _vector(self, t: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        w = counts * self.idf[t]
        norm = math.sqrt(float(w @ w))
        return t, w / norm if norm else w

    def encoded(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        """The text's terms, ascending, and their counts."""
        return encode(self.at, text)

    def vector(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        t, n = self.encoded(text)
        return self._vector(t, n)

    def own(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Example k's vector."""
        part = slice(self.row[k], self.row[k + 1])
        return self.term[part].astype(np.int64), self.weights[part].astype(np.float64)

    def _frequent(self) -> tuple[np.ndarray, np.ndarray]:
        """Lists of a thirty-second of all examples or more, as rows, the longest first: which row a term has, or -1; and the rows."""
        if self._rows is None:
            n = np.diff(self.list)
            some = np.flatnonzero(n >= max(64, len(self.y) // 32))
            some = some[np.argsort(-n[some], kind="stable")]
            self._head = int((n[some] >= len(self.y) // 10).sum())
            often, rows = np.full(len(n), -1, np.int32), np.zeros((len(some), len(self.y)), np.float32)
            often[some] = np.arange(len(some))
            at, size = _lists(self.list, some)
            rows[np.repeat(np.arange(len(some)), size), self.who[at]] = self.impact[at]
            self._rows, self._part = (often, rows), np.zeros((GATHER, len(self.y)), np.float32)
        return self._rows

    def _listed(self, t: np.ndarray, w: np.ndarray) -> np.ndarray:
        """Each example's sum over the lists of these terms."""
        at, n = _lists(self.list, t)
        return np.bincount(self.who[at], self.impact[at] * np.repeat(w, n), len(self.y))

    def heads(self, vectors: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        """For each vector, each example's sum over the terms that a tenth of the examples hold."""
        often, rows = self._frequent()
        w = np.zeros((len(vectors), self._head), np.float32)
        for k, (t, x) in enumerate(vectors):
            f = often[t]
            here = (f >= 0) & (f < self._head)
            w[k, f[here]] = x[here]
        return w @ rows[: self._head]

    def nearest(self, t: np.ndarray, w: np.ndarray, skip: int = -1, head: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """The K nearest examples and their cosines, best first. head: the vector's row of `heads`."""
        often, rows = self._frequent()
        first = self.heads([(t, w)])[0] if head is None else head
        f = often[t]
        whole, often, heavy, t, w = (t, w), f[f >= 0], w[f >= 0], t[f < 0], w[f < 0]
        other = often >= self._head
        left, x = often[other], heavy[other].astype(np.float32)
        for k in range(0, len(left), GATHER):
            part = np.take(rows, left[k : k + GATHER], axis=0, out=self._part[: len(left[k : k + GATHER])], mode="clip")
            first += x[k : k + GATHER] @ part
        near, light = self._met(first, t, w)
        near = near[near != skip]
        if not len(near):
            return near, np.zeros(0)
        if light is not None:  # only the frequent terms' sums, in single precision, are taken again
            cos = (heavy @ rows[often[:, None], near] + light[near]).round(7)
        else:
            mine = np.zeros(len(self.top))
            mine[whole[0]] = whole[1]
            at, n = _lists(self.row, near)
            cos = np.add.reduceat(mine[self.term[at]] * self.weights[at], np.cumsum(n) - n).round(7)
        best = np.lexsort((near, -cos))[:K]
        best = best[cos[best] > 0]
        return near[best], cos[best]

    def _met(self, first: np.ndarray, t: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray | None]:
        """With these sums and terms left, the examples that may be among the K nearest; and the terms' sums if all lists were read."""
        slack = 1e-5

        def least_of(got: np.ndarray) -> float:  # one of those K + 1 may be skipped
            return float(np.partition(got, -K - 1)[-K - 1]) if len(got) > K + 1 else 0.0

        def all_read(light: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            got = first + light
            return np.flatnonzero((got >= least_of(got) - slack) & (got > 0)), light

        size = self.list[t + 1] - self.list[t]
        if size.sum() <= 2 * STEP:  # bounds would cost more than they save
            return all_read(self._listed(t, w))
        most = w * self.top[t]
        by = np.argsort(-most, kind="stable")
        t, w, most, entries = t[by], w[by], most[by], np.cumsum(size[by])
        rest = np.append(np.cumsum(most[::-1])[::-1], 0.0)
        light, got, done, least = np.zeros(len(first)), first, 0, least_of(first)
        while done < len(t) and (rest[done] >= least - slack):
            upto = max(int(np.searchsorted(entries, (entries[done - 1] if done else 0) + STEP)), done + 1)
            light += self._listed(t[done:upto], w[done:upto])
            got, done = first + light, upto
            least = least_of(got)
        if done == len(t):
            return all_read(light)
        at, n = _lists(self.block_list, t[done:])
        bound = got + np.bincount(self.block[at], self.block_top[at] * np.repeat(w[done:], n), len(got) // BLOCK + 1)[np.arange(len(got)) // BLOCK]
        near = np.flatnonzero((bound >= least - slack) & (got > 0) if least > slack else bound > 0)
        if (self.row[near + 1] - self.row[near]).sum() > entries[-1] - (entries[done - 1] if done else 0):
            # the lists left are shorter than the rows of the examples met: with them few examples stay
            return all_read(light + self._listed(t[done:], w[done:]))
        return near, None

    def votes(self, at: np.ndarray, cos: np.ndarray) -> tuple[float, float]:
        """Share of label 1 in the votes, and their sum."""
        v = cos.astype(np.float64) ** 2 * self.weight[at]
        total = float(v.sum())
        return (float(v @ self.y[at]) / total if total else 0.0), total

    def score(self, text: str | None) -> tuple[float, list[dict]]:
        return self.scores([text])[0]

    def scores(self, texts: list[str | None]) -> list[tuple[float, list[dict]]]:
        out = []
        for k in range(0, len(texts), TEXTS):
            vectors = [self.vector(t) for t in texts[k : k + TEXTS]]
            out += [self._scored(t, w, head) for (t, w), head in zip(vectors, self.heads(vectors))]
        return out

    def _scored(self, t: np.ndarray, w: np.ndarray, head: np.ndarray) -> tuple[float, list[dict]]:
        if not len(t) or not len(self.y):
            return self.empty, []
        at, cos = self.nearest(t, w, head=head)
        if not len(at):
            return self.empty, []
        raw, _ = self.votes(at, cos)
        evidence = [{"doc_id": int(self.ids[i]), "similarity": float(c), "label": int(self.y[i])} for i, c in zip(at[:3], cos[:3])]
        return float(np.interp(raw, *self.curve)), evidence


def _monotone(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pooled adjacent violators: a rising curve from raw score to the weighted share of y."""
    order = np.argsort(x, kind="stable")
    pools: list[list[float]] = []
    for i in order:
        pools.append([x[i] * w[i], y[i] * w[i], w[i]])
        while len(pools) > 1 and pools[-2][1] * pools[-1][2] >= pools[-1][1] * pools[-2][2]:
            last = pools.pop()
            pools[-1] = [a + b for a, b in zip(pools[-1], last)]
    xs = np.array([0.0] + [p[0] / p[2] for p in pools] + [1.0])
    ys = np.array([p[1] / p[2] for p in pools])
    return xs, np.concatenate([ys[:1], ys, ys[-1:]])


def labelled(documents: DataFrame, labels: DataFrame) -> tuple[DataFrame, tuple[int, int]]:
    """The sample (doc_id, label, text) and the counts of label 1 and 0 among all rows that may be learned from."""
    rows = labels.filter(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & (fold_remainder(F.col("doc_id"), 5) != 0))
    rows = rows.groupBy("doc_id").agg((F.avg("toxic") >= 0.5).cast("int").alias("label"))
    rows = written(rows, "toxic-rows")
    n = {r.label: r.n for r in rows.groupBy("label").agg(F.count("*").alias("n")).collect()}
    order = W.partitionBy("label").orderBy(F.xxhash64("doc_id"), "doc_id")
    by_label = lambda one, zero: F.when(F.col("label") == 1, F.lit(one)).otherwise(F.lit(zero))
    # hardly more rows than are wanted lie below the bound: what is ordered follows the sample, not the table
    share = by_label(enough(EXAMPLES[0]) / max(n.get(1, 0), 1), enough(EXAMPLES[1]) / max(n.get(0, 0), 1))
    low = rows.filter(F.xxhash64("doc_id") < hash_bound(share))
    ids = low.withColumn("_n", F.row_number().over(order)).filter(F.col("_n") <= by_label(*EXAMPLES))
    ids = written(ids.select(F.col("doc_id").alias("_id"), "label"), "toxic-sample")
    texts = documents.select("doc_id", "text").join(ids, F.col("doc_id") == F.col("_id")).select("doc_id", "label", "text")
    return texts, (n.get(1, 0), n.get(0, 0))


def encode(at: dict[str, int], text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of the text's terms, ascending, and their counts."""
    words = split(text)
    found = np.array([*map(at.get, words, repeat(-1)), *map(at.get, ["^" + w[:STEM] for w in words if len(w) > STEM], repeat(-1))], np.int64)
    t, n = np.unique(found[found >= 0], return_counts=True)
    return t, n.astype(np.float64)


def learn(documents: DataFrame, labels: DataFrame) -> Index:
    texts, (ones, zeros) = labelled(documents, labels)

    def counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for t in b["text"]:
                yield pd.DataFrame({"term": [*terms(t)]}, dtype="object")

    # an id may stand for several rows: the example is its first by text
    once = written(texts.groupBy("doc_id", "label").agg(F.min("text").alias("text")), "toxic-texts")
    size = {r.label: r.n for r in once.groupBy("label").agg(F.count("*").alias("n")).collect()}
    if not size.get(1) or not size.get(0):
        index = Index([], np.zeros(0), [], (1.0, 1.0))
        index.empty = 1.0 if size.get(1) else 0.0
        return index
    held = once.mapInPandas(counted, "term string").groupBy("term").agg(F.count("*").alias("n")).filter(F.col("n") >= SUPPORT)
    vocab = sorted(held.select("term").toPandas()["term"])
    at = {v: i for i, v in enumerate(vocab)}

    def encoded(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            got = [encode(at, t) for t in b["text"]]
            yield pd.DataFrame({"doc_id": b["doc_id"], "label": b["label"], "t": [t.astype(np.int32) for t, _ in got], "n": [n.astype(np.int32) for _, n in got]})

    df, n = frequencies(documents, vocab)
    idf = np.log((1 + n) / (1 + df)) + 0.1
    picked = once.mapInPandas(encoded, "doc_id long, label int, t array<int>, n array<int>").toPandas().sort_values("doc_id")
    rate = (ones / (ones + zeros) / (size[1] / (size[1] + size[0])), zeros / (ones + zeros) / (size[0] / (size[1] + size[0])))
    index = Index(vocab, idf, list(zip(picked["doc_id"], picked["label"], picked["t"], picked["n"])), rate)
    if len(index.y):
        index.curve = _monotone(raw_scores(documents.sparkSession, index), index.y, index.weight)
    return index


def raw_scores(spark: SparkSession, index: Index) -> np.ndarray:
    """Each example's share of votes by the others."""

    def raw(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"k": b["id"], "raw": [index.votes(*index.nearest(*index.own(k), skip=k))[0] for k in b["id"]]})

    got = spark.range(len(index.y), numPartitions=max(1, len(index.y) // 100)).mapInPandas(raw, "k long, raw double").toPandas()
    return got.sort_values("k")["raw"].to_numpy(np.float64)


def frequencies(documents: DataFrame, vocab: list[str]) -> tuple[np.ndarray, int]:
    """Documents that hold each term, over all documents; and the number of documents."""
    at = {v: i for i, v in enumerate(vocab)}

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n, docs = np.zeros(len(at), np.int64), 0
        for b in batches:
            for text in b["text"]:
                docs += 1
                words = set(split(text))
                found = {*map(at.get, words), *map(at.get, {"^" + w[:STEM] for w in words if len(w) > STEM})}
                found.discard(None)
                n[list(found)] += 1
        k = np.flatnonzero(n)
        yield pd.DataFrame({"k": np.concatenate([[-1], k]), "n": np.concatenate([[docs], n[k]])})

    got = documents.select("text").mapInPandas(count, "k int, n long").groupBy("k").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros(len(vocab) + 1)
    out[got["k"].to_numpy(np.int64) + 1] = got["n"]
    return out[1:], int(out[0])


def scorer(index: Index) -> Column:
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            got = index.scores(list(texts))
            yield pd.DataFrame({"score": [s for s, _ in got], "evidence": [e for _, e in got]})

    return F.pandas_udf(score, "score double, evidence array<struct<doc_id: long, similarity: double, label: int>>")


def with_toxicity(docs: DataFrame, index: Index) -> DataFrame:
    """docs with toxicity, a struct of score and evidence."""
    return docs.withColumn("toxicity", scorer(index)(F.col("text")))


def report(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted, evidence."""
    out = with_toxicity(documents.select("doc_id", "text"), learn(documents, labels))
    score = F.col("toxicity.score")
    return out.select("doc_id", (fold_remainder(F.col("doc_id"), 5) == 0).alias("held_out"), score.alias("score"), (score >= 0.5).cast("int").alias("predicted"), F.col("toxicity.evidence").alias("evidence"))
