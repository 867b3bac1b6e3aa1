"""Chroma audio fingerprints, and the alignment of recordings by them.

A recording's spectrum is folded into twelve pitch classes per frame. Filters over the integral image of these frames compare
two areas each; the logarithm of their ratio gives two bits, and the sixteen filters a packed 32-bit integer per frame. Two
recordings are aligned where integers agree: every integer but those of silence, and of a run of equal ones the first, gives four
keys, each three of its four bytes, so bits may be wrong in the fourth. Keys that two recordings share vote for an offset (in tasks
that hold a cell of either side), and every offset voted for is verified by bit errors: the stretch along it with the fewest errors must be LEAST integers long, with
at most MOST_ERROR of its bits wrong.

Recordings of equal fingerprints form a class, and classes are aligned, not copies: links are rows between class
representatives, and each recording has its class.

Defined cases: null, empty, undecodable and very short audio has no integers, is its own class by that (all such form
one) and links with nothing; silent stretches have no keys; ids may repeat or be null (a null id is not asked for, and is
last of its class; classes are told apart by `class_key`, not by id); an empty table gives no rows; other columns pass through `with_fingerprint` unless named like what it makes.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import written

RATE = 11_025
FRAME, HOP = 4096, 1365
LOW, HIGH = 55.0, 3520.0
SPAN = 16  # frames under the filters
STEP = 0.25  # log ratios beyond this, either way, are the outer two of four classes
PARTS = (0x00FFFFFF, 0xFF00FFFF, 0xFFFF00FF, 0xFFFFFF00)  # bytes of an integer that make a key
LEAST, MOST_ERROR = 16, 0.2
LONG = 1 << 21  # samples that are transformed at once
INTS, LEAST_CELLS = 200_000, 24
MATCHES, CELLS = 1 << 20, 1 << 19  # shared keys, and integers compared, at once


def decode(raw: bytes | None, rate: int = RATE) -> np.ndarray:
    """Samples at RATE, one channel, of 16-bit PCM: a WAV file, or bare samples at `rate`."""
    raw = raw or b""
    channels = 1
    if raw[:4] == b"RIFF" and raw[8:12] == b"WAVE":
        at, body = 12, b""
        while at + 8 <= len(raw):
            name, size = raw[at : at + 4], int.from_bytes(raw[at + 4 : at + 8], "little")
            part = raw[at + 8 : at + 8 + size]
            if name == b"fmt " and len(part) >= 16:
                kind, channels, rate, bits = (int.from_bytes(part[a:b], "little") for a, b in ((0, 2), (2, 4), (4, 8), (14, 16)))
                if kind != 1 or bits != 16 or not channels or not rate:
                    return np.zeros(0, np.float32)
            elif name == b"data":
                body = part
            at += 8 + size + size % 2
        raw = body
    x = np.frombuffer(raw[: len(raw) // (2 * channels) * 2 * channels], "<i2").astype(np.float32)
    x = x.reshape(-1, channels).mean(1) if channels > 1 else x
    if rate != RATE and len(x):
        x = np.interp(np.arange(int(len(x) * RATE / rate)) * (rate / RATE), np.arange(len(x)), x).astype(np.float32)
    return x / 32768


@lru_cache(maxsize=1)
def _fold() -> tuple[np.ndarray, np.ndarray]:
    """The window, and which pitch class each frequency of a frame belongs to (12: none)."""
    f = np.fft.rfftfreq(FRAME, 1 / RATE)
    inside = (f >= LOW) & (f <= HIGH)
    note = np.full(len(f), 12)
    note[inside] = np.round(12 * np.log2(f[inside] / 440)).astype(int) % 12
    return np.hanning(FRAME).astype(np.float32), np.eye(13)[note][:, :12].astype(np.float32)


def chroma(x: np.ndarray) -> np.ndarray:
    """Frames of twelve energies, each frame of length 1 or, in silence, 0."""
    n = max((len(x) - FRAME) // HOP + 1, 0)
    window, fold = _fold()
    out = np.zeros((n, 12), np.float32)
    for at in range(0, n, LONG // FRAME):
        frames = np.lib.stride_tricks.sliding_window_view(x, FRAME)[at * HOP : (min(at + LONG // FRAME, n) - 1) * HOP + 1 : HOP]
        out[at : at + len(frames)] = np.abs(np.fft.rfft(frames * window, axis=1)).astype(np.float32) ** 2 @ fold
    smooth = np.stack([np.convolve(out[:, k], (0.25, 0.75, 1, 0.75, 0.25), "same") for k in range(12)], 1) if n else out
    norm = np.linalg.norm(smooth, axis=1, keepdims=True)
    return np.where(norm > 1e-4, smooth / np.maximum(norm, 1e-12), 0)


def _filters() -> list[tuple[list, list]]:
    """Sixteen pairs of areas, each area a list of (first frame, first pitch, frames, pitches); pitches go round the octave."""
    out = []
    for k in range(16):
        pitch, high, wide = 5 * k % 12, (2, 4, 6)[k % 3], (16, 8, 12, 4)[k // 4]
        t = (SPAN - wide) // 2
        half, up = wide // 2, high // 2
        kind = k % 4
        if kind == 0:  # lower against upper pitches
            pair = [(t, pitch, wide, up)], [(t, pitch + up, wide, up)]
        elif kind == 1:  # before against after
            pair = [(t, pitch, half, high)], [(t + half, pitch, half, high)]
        elif kind == 2:  # a checkerboard
            pair = [(t, pitch, half, up), (t + half, pitch + up, half, up)], [(t + half, pitch, half, up), (t, pitch + up, half, up)]
        else:  # two pitch bands half an octave apart
            pair = [(t, pitch, wide, up)], [(t, pitch + 6, wide, up)]
        out.append(pair)
    return out


FILTERS = _filters()


def fingerprint(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The packed integers, one per frame from which SPAN frames follow, and which of them are of silence."""
    c = chroma(x)
    n = len(c) - SPAN + 1
    if n < 1:
        return np.zeros(0, np.uint32), np.zeros(0, bool)
    image = np.zeros((len(c) + 1, 25))
    image[1:, 1:] = np.hstack([c, c]).cumsum(0).cumsum(1)

    def area(t: int, p: int, wide: int, high: int) -> np.ndarray:
        return image[t + wide : t + wide + n, p + high] - image[t : t + n, p + high] - image[t + wide : t + wide + n, p] + image[t : t + n, p]

    packed = np.zeros(n, np.uint32)
    for k, (a, b) in enumerate(FILTERS):
        ratio = np.log((0.1 + sum(area(*x) for x in a)) / (0.1 + sum(area(*x) for x in b)))
        rank = (ratio > -STEP).astype(np.uint32) + (ratio > 0) + (ratio > STEP)
        packed |= (rank ^ (rank >> 1)).astype(np.uint32) << np.uint32(2 * k)  # neighbours differ by one bit
    return packed, area(0, 0, SPAN, 12) <= 0


def key_places(packed: np.ndarray, silent: np.ndarray) -> np.ndarray:
    """Where an integer is not silence and not the one before."""
    return np.flatnonzero(~silent & np.concatenate([[True], packed[1:] != packed[:-1]])) if len(packed) else np.zeros(0, np.int64)


def _fingerprints(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    for b in batches:
        got = [fingerprint(decode(raw)) for raw in b]
        yield pd.DataFrame({"ints": [p.view(np.int32) for p, _ in got], "keys": [key_places(p, s).astype(np.int32) for p, s in got]})


BATCHES = {"spark.sql.execution.arrow.maxRecordsPerBatch": "32", "spark.sql.execution.arrow.maxBytesPerBatch": str(32 << 20)}


@contextmanager
def few_at_once(spark: SparkSession) -> Iterator[None]:
    """While it lasts, what is planned sends recordings to Python in small batches: ten thousand of them fill no memory."""
    before = {k: spark.conf.get(k, None) for k in BATCHES}
    for k, v in BATCHES.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def with_fingerprint(df: DataFrame, audio: str = "audio", name: str = "fp") -> DataFrame:
    """df with fp: struct(ints, keys), the integers and the places of the keys. Plan and run it under `few_at_once`."""
    return df.withColumn(name, F.pandas_udf(_fingerprints, "ints array<int>, keys array<int>")(F.col(audio)))


def stretch(a: np.ndarray, b: np.ndarray, offset: int) -> tuple[int, int, float]:
    """Of a against b, a's place i standing over b's i + offset: (start in a, length, error) of the best stretch."""
    low, high = max(0, -offset), min(len(a), len(b) - offset)
    if high <= low:
        return 0, 0, 1.0
    wrong = np.bitwise_count(a[low:high] ^ b[low + offset : high + offset]).astype(np.int64)
    run = np.concatenate([[0], np.cumsum(32 * MOST_ERROR * 1.25 - wrong)])
    before = np.minimum.accumulate(run)
    end = int((run - before).argmax())
    start = int(run[: end + 1].argmin())
    n = end - start
    return low + start, n, float(wrong[start:end].sum() / (32 * n)) if n else 1.0


class Prints:
    """Fingerprints end to end: ints of row k are flat[first[k]:][:size[k]]; and each key's row, place and values by part."""

    def __init__(self, ints: list, keys: list):
        none = np.zeros(0, np.int32)
        self.size, n = np.array([len(x) for x in ints], np.int64), np.array([len(x) for x in keys], np.int64)
        self.flat, self.first = np.concatenate([none, *ints]).astype(np.int32), np.cumsum(self.size) - self.size
        row, at = np.repeat(np.arange(len(keys)), n), np.concatenate([none, *keys]).astype(np.int64)
        whole = self.flat[self.first[row] + at].view(np.uint32).astype(np.uint64)
        self.key = np.stack([(np.uint64(i) << np.uint64(32)) | (whole & np.uint64(m)) for i, m in enumerate(PARTS)], 1).ravel()
        self.row, self.at = np.repeat(row, len(PARTS)), np.repeat(at, len(PARTS))


def votes(a: Prints, b: Prints) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Rows of a and b that share a key, and the offset; some MATCHES at a time, so an offset may come again."""
    order = np.argsort(a.key, kind="stable")
    own = a.key[order]
    left = np.searchsorted(own, b.key)
    n = np.searchsorted(own, b.key, "right") - left
    some = np.flatnonzero(n)
    upto = np.cumsum(n[some])
    most = int(a.size.max(initial=0))
    wide = most + int(b.size.max(initial=0)) + 1
    at = 0
    while at < len(some):
        end = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + MATCHES, "right")))
        k = some[at:end]
        x = order[np.repeat(left[k] - np.cumsum(n[k]) + n[k], n[k]) + np.arange(n[k].sum())]
        y = np.repeat(k, n[k])
        code = np.unique((b.row[y] * len(a.size) + a.row[x]) * wide + b.at[y] - a.at[x] + most)
        pair, offset = code // wide, code % wide - most
        yield pair % len(a.size), pair // len(a.size), offset
        at = end


def stretches(a: Prints, b: Prints, i: np.ndarray, j: np.ndarray, offset: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """`stretch` of a's rows i against b's rows j, each at its offset: starts, lengths, errors."""
    low = np.maximum(0, -offset)
    n = np.minimum(a.size[i], b.size[j] - offset) - low
    start, length, error = np.zeros(len(i), np.int64), np.zeros(len(i), np.int64), np.ones(len(i))
    by = np.argsort(n, kind="stable")
    by = by[np.searchsorted(n[by], 1) :]
    at = 0
    while at < len(by):  # by size, so little is padded
        end = max(at + 1, at + CELLS // int(n[by[at]] + 1))
        end = max(at + 1, at + CELLS // int(n[by[min(end, len(by)) - 1]] + 1))
        k = by[at:end]
        at = end
        col = np.arange(int(n[k].max()))
        inside = col < n[k][:, None]
        x = np.where(inside, (a.first[i[k]] + low[k])[:, None] + col, 0)
        y = np.where(inside, (b.first[j[k]] + low[k] + offset[k])[:, None] + col, 0)
        wrong = np.bitwise_count(a.flat[x] ^ b.flat[y]).astype(np.int64)
        run = np.zeros((len(k), len(col) + 1))
        np.cumsum(32 * MOST_ERROR * 1.25 - wrong, axis=1, out=run[:, 1:])
        run[:, 1:][~inside] = -np.inf
        last = (run - np.minimum.accumulate(np.where(run == -np.inf, np.inf, run), axis=1)).argmax(1)
        begin = np.where(np.arange(len(col) + 1) <= last[:, None], run, np.inf).argmin(1)
        sums = np.concatenate([np.zeros((len(k), 1), np.int64), np.cumsum(wrong, axis=1)], axis=1)
        here, m = np.arange(len(k)), last - begin
        start[k], length[k] = low[k] + begin, m
        error[k] = np.where(m > 0, (sums[here, last] - sums[here, begin]) / np.maximum(32 * m, 1), 1.0)
    return start, length, error


LINK = "class_key string, class_id long, match_key string, match_id long, offset int, start int, length int, error double"


def _links(asked: pd.DataFrame, every: pd.DataFrame) -> pd.DataFrame:
    """Of each two classes that share keys, the offset of the best stretch: the longest with the fewest errors."""
    a, b = (Prints(list(c["ints"]), list(c["keys"])) for c in (asked, every))
    same = {k: n for n, k in enumerate(asked["class_key"])}
    itself = np.array([same.get(k, -1) for k in every["class_key"]], np.int64)
    got = [np.zeros((6, 0))]
    for i, j, offset in votes(a, b):
        low = np.maximum(0, -offset)
        long = (np.minimum(a.size[i], b.size[j] - offset) - low >= LEAST) & (itself[j] != i)  # no shorter overlap has such a stretch
        i, j, offset = i[long], j[long], offset[long]
        start, n, error = stretches(a, b, i, j, offset)
        good = (n >= LEAST) & (error <= MOST_ERROR)
        got.append(np.stack([x[good] for x in (i, j, offset, start, n, error)]))
    i, j, offset, start, n, error = np.concatenate(got, axis=1)
    order = np.lexsort((-offset, np.abs(offset), -n * (MOST_ERROR * 1.25 - error), j, i))
    best = order[np.flatnonzero((np.diff(i[order], prepend=-1) != 0) | (np.diff(j[order], prepend=-1) != 0))]
    i, j = i[best].astype(np.int64), j[best].astype(np.int64)
    ids = {"class_key": asked["class_key"].to_numpy()[i], "class_id": asked["class_id"].astype("Int64").array[i], "match_key": every["class_key"].to_numpy()[j], "match_id": every["class_id"].astype("Int64").array[j]}
    return pd.DataFrame(ids | {"offset": offset[best].astype(np.int32), "start": start[best].astype(np.int32), "length": n[best].astype(np.int32), "error": error[best]})


def classes(recordings: DataFrame) -> DataFrame:
    """(id, fp) to (class_key, class_id, ints, keys, members): a row for each different fingerprint."""
    of = recordings.groupBy(F.col("fp.ints").alias("ints"), F.col("fp.keys").alias("keys")).agg(F.min("id").alias("class_id"), F.count("*").alias("members"))
    return of.withColumn("class_key", class_key(F.col("ints")))


def class_key(ints: Column) -> Column:
    return F.md5(F.array_join(F.transform(ints, lambda x: x.cast("string")), ",").cast("binary"))


def align(asked: DataFrame, every: DataFrame) -> DataFrame:
    """Classes against classes: (class_key, class_id, match_key, match_id, offset, start, length, error), a row for each pair that aligns.

    Both sides are dealt to cells of some INTS integers, and every cell of asked classes meets every cell of classes in one task,
    which looks up shared keys and verifies. So rows are classes and links, never the pairs that only share a key.
    """
    ints = lambda c: c.agg(F.sum(F.size("ints"))).first()[0] or 0
    wide, deep = -(-ints(asked) // INTS) or 1, max(LEAST_CELLS, -(-ints(every) // INTS))
    cell = lambda n: F.pmod(F.xxhash64("class_key"), F.lit(n))
    each = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
    columns = [F.col("class_id").cast("long").alias("class_id"), *[F.col(c).alias(c) for c in ("class_key", "ints", "keys")]]
    a = asked.select(*columns, cell(wide).alias("across"), each(deep).alias("down"))
    b = every.select(*columns, each(wide).alias("across"), cell(deep).alias("down"))
    return a.groupBy("across", "down").cogroup(b.groupBy("across", "down")).applyInPandas(_links, LINK)


def report(recordings: DataFrame, every_nth: int = 50) -> DataFrame:
    """(id, audio) to (id, n_ints, fingerprint_crc32, class_id, class_key, match_id, match_key, offset, length, error).

    A row for each recording, with no match; and for each class that holds a recording whose id is divisible by
    every_nth, a row (id: the class's) for each other class that aligns with it.
    """
    with few_at_once(recordings.sparkSession):
        fps = written(with_fingerprint(recordings.select("id", "audio")).select("id", "fp", class_key(F.col("fp.ints")).alias("k")), "audio-fp")
    every = written(classes(fps), "audio-classes")
    asked = every.join(fps.filter(F.col("id") % every_nth == 0).select("k").distinct(), F.col("class_key") == F.col("k"), "left_semi")
    found = align(asked.filter(F.size("ints") > 0), every.filter(F.size("ints") > 0))
    none = lambda kind: F.lit(None).cast(kind)
    own = fps.select("id", F.col("fp.ints").alias("ints"), "k").join(every.select("class_key", "class_id"), F.col("k") == F.col("class_key"))
    crc = F.crc32(F.array_join(F.transform("ints", lambda x: x.cast("string")), ",").cast("binary"))
    own = own.select("id", F.size("ints").alias("n_ints"), crc.alias("fingerprint_crc32"), "class_id", "class_key", none("bigint").alias("match_id"), none("string").alias("match_key"), none("int").alias("offset"), none("int").alias("length"), none("double").alias("error"))
    links = found.select(F.col("class_id").alias("id"), none("int").alias("n_ints"), none("bigint").alias("fingerprint_crc32"), "class_id", "class_key", F.col("match_id").cast("bigint").alias("match_id"), "match_key", "offset", "length", "error")
    return own.unionByName(links)


def melodies(vectors: DataFrame) -> DataFrame:
    """(vec_id, embedding) to (id, audio): since no table holds audio, each vector is played, a tone a value.

    Every seventh row plays its first 20 tones and then a passage of the row that `report` asks for among its fifty.
    """
    v = vectors.select(F.col("vec_id").alias("id"), "embedding", (F.floor(F.col("vec_id") / 50) * 50).alias("_quoted"))
    quoted = v.filter(F.col("id") % 50 == 0).select(F.col("id").alias("_q"), F.slice("embedding", 5, 44).alias("_passage")).dropDuplicates(["_q"])
    v = v.join(quoted, (F.col("id") % 7 == 3) & (F.col("_quoted") == F.col("_q")), "left")
    tones = F.when(F.col("_passage").isNull(), F.col("embedding")).otherwise(F.concat(F.slice("embedding", 1, 20), F.col("_passage")))

    def play(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        t = np.arange(HOP) / RATE
        fade = np.minimum(1, np.minimum(np.arange(HOP), np.arange(HOP)[::-1]) / 64)
        table = np.array([[(np.sin(2 * np.pi * f * t) + 0.4 * np.sin(4 * np.pi * f * t)) * fade * 12000] for f in 220 * 2 ** (np.arange(12) / 12)]).reshape(12, -1).astype("<i2")
        for b in batches:
            yield pd.Series([None if x is None else table[(np.clip((np.asarray(x, np.float64) * 8 + 2) * 3, 0, 11.999)).astype(int)].tobytes() for x in b], dtype="object")

    return v.select("id", F.pandas_udf(play, "binary")(tones).alias("audio"))
