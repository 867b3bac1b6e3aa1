"""Language identification by prediction by partial matching (PPM).

For each language a context tree over bytes, of order 3, with method C escape probabilities: a symbol seen in a context
has its share of count over count plus distinct symbols; the rest goes to the next shorter context, without the symbols
already excluded, and in the end to all 256 bytes alike. Statistics are frozen after learning, so the code length of every
byte after every context is computed once and a text's length in bits is a sum of look-ups. The language with the
shortest code wins; the score is its share of the likelihoods.

Each byte that some learned text holds has a symbol of its own. Bytes that none holds share one in tables, at the code
length of one such byte.

Learning takes `PER_LANG` different texts of each language at most, those of the smallest hashes, each whole. Everything
else covers all documents and whole texts.

Defined cases: a text that is null or has no letter is `und` with score 0; with no labelled rows all are `und`;
rows without lang are not learned from; ties go to the first language by name; an empty table gives no
rows; other columns pass through `with_language`, but for columns named like the two it makes. Letters are those of the
Unicode classes L: number signs such as fractions and Roman numerals are none.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import columns_of, free, written

PER_LANG = 400
ORDER = 3
CHUNK = 1 << 20
LETTER = re.compile(r"[^\W\d_]")


def has_letter(text: str | None) -> bool:
    return bool(text) and any(m[0].isalpha() for m in LETTER.finditer(text))


#: Every byte for itself: the codes that are counted before the symbols are known.
BYTES = np.arange(256, dtype=np.int64)


def _codes(raw: bytes, fold: np.ndarray = BYTES, width: int = 8) -> np.ndarray:
    """Order-4 codes (context and symbol, `width` bits each) of all bytes; the text is taken to follow white space."""
    c = np.full(len(raw) + ORDER, fold[32], np.int32 if 4 * width < 32 else np.int64)
    c[ORDER:] = fold[np.frombuffer(raw, np.uint8)]
    return (c[:-3] << 3 * width) | (c[1:-2] << 2 * width) | (c[2:-1] << width) | c[3:]


class Model:
    """Each language's context tree, as tables that lead from a context to its row of code lengths."""

    def __init__(self, counts: dict[str, tuple[np.ndarray, np.ndarray]]):
        """counts: each language's order-4 codes of bytes, and how often each occurs."""
        self.langs = sorted(counts)
        seen = np.unique(np.concatenate([[32], *[k & 255 for k, _ in counts.values()]]))
        self.fold, self.width = np.full(256, len(seen)), len(seen).bit_length()
        self.fold[seen] = np.arange(len(seen))
        self.trees = []
        for lang in self.langs:
            keys, n = counts[lang]
            code = sum(self.fold[keys >> 8 * i & 255] << self.width * i for i in range(4))
            self.trees.append(_tree(code, n, self.width, len(seen)))

    def lengths(self, texts: list[str]) -> np.ndarray:
        """Bits of each text under each language. Texts are joined so that many short ones take few passes."""
        out = np.zeros((len(texts), len(self.langs)))
        pieces: list[tuple[int, np.ndarray]] = []
        size = 0
        for i, t in enumerate(texts):
            codes = _codes(t.encode("utf-8", "replace"), self.fold, self.width)
            for at in range(0, len(codes), CHUNK):
                part = codes[at : at + CHUNK]
                if size + len(part) > CHUNK:
                    self._add(out, pieces)
                    pieces, size = [], 0
                pieces.append((i, part))
                size += len(part)
        self._add(out, pieces)
        return out

    def _add(self, out: np.ndarray, pieces: list[tuple[int, np.ndarray]]) -> None:
        if not pieces:
            return
        codes = np.concatenate([p for _, p in pieces])
        at = np.cumsum([0] + [len(p) for _, p in pieces[:-1]])
        who = [i for i, _ in pieces]
        w = self.width
        first, two, symbol = codes >> 3 * w, codes >> w & ((1 << 2 * w) - 1), codes & ((1 << w) - 1)
        for k, (pair, rows, bits) in enumerate(self.trees):
            cost = bits[(rows[(pair[two] << w) + first] << w) + symbol]
            np.add.at(out[:, k], who, np.add.reduceat(cost, at, dtype=np.float64))

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        at = [i for i, t in enumerate(texts) if has_letter(t)] if self.langs else []
        langs, scores = ["und"] * len(texts), [0.0] * len(texts)
        if at:
            bits = self.lengths([texts[i] for i in at])
            best = bits.argmin(1)
            share = 1 / np.exp2(np.maximum(bits.min(1)[:, None] - bits, -1000)).sum(1)
            for i, b, s in zip(at, best, share):
                langs[i], scores[i] = self.langs[b], float(s)
        return langs, scores


def _tree(keys: np.ndarray, n: np.ndarray, width: int, known: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Counts by order-4 code to (number of the last two symbols, row by that number and the symbol before, code lengths):
    the probability row of a context is its own symbols' shares and, for the others, the escape probability times the
    shorter context's row without those."""
    size = 1 << width

    def seen(order: int) -> tuple[np.ndarray, np.ndarray]:
        """Contexts of `order` symbols and their counts of each symbol."""
        code = keys & ((1 << width * (order + 1)) - 1)
        ctx, at = np.unique(code >> width, return_inverse=True)
        counts = np.zeros((len(ctx), size))
        np.add.at(counts, (at, code & (size - 1)), n)
        return ctx, counts

    def shares(counts: np.ndarray, shorter: np.ndarray) -> np.ndarray:
        total, kinds = counts.sum(1, keepdims=True), (counts > 0).sum(1, keepdims=True)
        others = np.where(counts > 0, 0, shorter)
        left = others.sum(1, keepdims=True)
        escape = np.where(left > 0, kinds / (total + kinds), 0)
        own = counts / np.where(left > 0, total + kinds, total)
        return own + escape * others / np.where(left > 0, left, 1)

    even = np.zeros((1, size))
    even[0, :known], even[0, known] = 1 / 256, (256 - known) / 256
    table = [shares(seen(0)[1], even)]
    one, counts = seen(1)
    table.append(shares(counts, table[0]))
    row_of_one = np.zeros(size, np.int32)  # of contexts never seen: the row of the longest shorter one that was
    row_of_one[one] = 1 + np.arange(len(one))
    two, counts = seen(2)
    table.append(shares(counts, np.concatenate(table)[row_of_one[two & (size - 1)]]))
    # the last two symbols to a number; two that were never seen count as the last one
    pair = np.tile(len(two) + np.arange(size, dtype=np.int32), size)
    pair[two] = np.arange(len(two))
    rows = np.zeros((len(two) + size, size), np.int32)
    rows[: len(two)] = (1 + len(one) + np.arange(len(two)))[:, None]
    rows[len(two) :] = row_of_one[:, None]
    three, counts = seen(3)
    last, first = pair[three & (size * size - 1)], three >> 2 * width
    table.append(shares(counts, np.concatenate(table)[rows[last, first]]))
    rows[last, first] = 1 + len(one) + len(two) + np.arange(len(three))
    whole = np.concatenate(table)
    whole[:, known] /= max(256 - known, 1)
    return pair, rows.ravel(), -np.log2(np.maximum(whole, 1e-12)).astype(np.float32).ravel()


def fold_remainder(doc_id: Column, n: int) -> Column:
    """crc32 of the id as text, modulo n."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % n


def enough(n: int) -> float:
    """So many rows must be expected below a random bound that n are surely there."""
    return n + 8 * n**0.5


def hash_bound(share: Column) -> Column:
    """The 64-bit hash, as a double, below which this share of all hashes lies."""
    return F.least(share, F.lit(1.0)) * float(1 << 64) - float(1 << 63)


def learn(labelled: DataFrame, per_lang: int = PER_LANG) -> Model:
    """A model from (doc_id, text, lang). Texts are counted on the executors; the driver gets counts by code."""
    rows = labelled.filter(F.col("lang").isNotNull() & F.col("text").isNotNull()).select("lang", "text", F.xxhash64("text").alias("h"))
    # from a language's number of texts follows the hash below which enough, and hardly more, of them lie
    bounds = rows.groupBy("lang").agg((1.3 * enough(per_lang) / F.approx_count_distinct("h")).alias("share")).select("lang", hash_bound(F.col("share")).alias("low")).collect()
    if not bounds:
        return Model({})
    # a row per language, as the model itself has a table per language; the texts need no join
    bound = F.create_map(*[F.lit(x) for r in bounds for x in (r.lang, r.low)])
    low = rows.filter(F.col("h") < F.try_element_at(bound, F.col("lang"))).groupBy("lang", "h").agg(F.min("text").alias("text"))
    texts = low.withColumn("_n", F.row_number().over(W.partitionBy("lang").orderBy("h"))).filter(F.col("_n") <= per_lang).select("lang", "text")
    texts = written(texts, "lang-sample").repartition(F.xxhash64("text"))

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for lang, text in zip(b["lang"], b["text"]):
                k, n = np.unique(_codes(text.encode("utf-8", "replace")), return_counts=True)
                yield pd.DataFrame({"lang": lang, "k": k, "n": n.astype(np.int64)})

    got = texts.mapInPandas(count, "lang string, k long, n long").groupBy("lang", "k").agg(F.sum("n").alias("n")).toPandas()
    return Model({str(lang): (g["k"].to_numpy(np.int64), g["n"].to_numpy(np.float64)) for lang, g in got.groupby("lang")})


def predictor(model: Model) -> Callable[[Column], Column]:
    """A column function from text to struct(lang_pred, score)."""
    @F.pandas_udf("lang_pred string, score double")
    def predict(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            langs, scores = model.predict(list(texts))
            yield pd.DataFrame({"lang_pred": langs, "score": scores})

    return predict


def with_language(docs: DataFrame, model: Model) -> DataFrame:
    """docs with lang_pred and score."""
    (p,) = free(docs, "_p")
    out = docs.withColumn(p, predictor(model)(F.col("text")))
    return out.withColumns({"lang_pred": F.col(f"{p}.lang_pred"), "score": F.col(f"{p}.score")}).drop(p)


def training_rows(docs: DataFrame) -> DataFrame:
    return docs.filter(fold_remainder(F.col("doc_id"), 4) != 2).select("doc_id", "text", "lang")


def report(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score."""
    out = with_language(docs.select("doc_id", "text"), learn(training_rows(docs)))
    return out.select("doc_id", (fold_remainder(F.col("doc_id"), 4) == 2).alias("held_out"), "lang_pred", "score")


def keep_known(docs: DataFrame, model: Model, least: float = 0.3) -> DataFrame:
    """docs of which the text has a language; others go. The columns stay as they are."""
    (p,) = free(docs, "_p")
    out = docs.withColumn(p, predictor(model)(F.col("text")))
    return out.filter((F.col(f"{p}.lang_pred") != "und") & (F.col(f"{p}.score") >= least)).select(*columns_of(docs))
