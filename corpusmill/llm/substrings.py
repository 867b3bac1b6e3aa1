"""Exact substring dedup over words by prefix-partitioned suffix trees.

Suffixes start at words. Each word has a symbol, four bits of its hash, and a suffix is the string of its first `DEEP`
symbols. Counting passes over the corpus find variable-length word prefixes, each standing for few enough suffixes: prefixes
that stand for too many get one word longer, or, at `LONGEST` words or `TABLES` tables, are split by the whole
string. Prefixes are packed into groups that fit one task's memory, every suffix goes to the group of its prefix, and each
group builds its subtree: suffixes in order, the common prefixes of neighbours, and from these the deep internal nodes, those
of the repeats. Whatever stands below a deep node in two documents is a candidate; the candidates' words are then read, and a
window is removed if a document of a smaller id has the same words (their 96-bit digest). Neighbouring removed
windows join into maximal repeats.

Before the shuffle each block of texts settles its own repeats, comparing them word by word: of equal windows only those in the
block's smallest document go to the tree, so a copy or passage that a third of all documents share sends one document's
suffixes a block.

Defined cases: null, empty and blank texts have no words; texts shorter than a window lose nothing; repeats within one
document alone stay; rows of equal id and text get equal results and rows of one id do not count against each
other; a null id comes after all others; overlapping windows remove a word once; an empty table gives no
rows; other columns, whatever their names, pass through `remove_repeats`.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import columns_of, free, named, written

WINDOW = 13
DEEP = 12  # symbols of a suffix: 48 bits
BUCKETS = 12  # bits of a prefix word that tell prefixes apart
LONGEST, TABLES = 5, 1024
CAPACITY = 1_500_000
LEAST_GROUPS = 48
BLOCK = 6 << 20
CHUNK = 1 << 20
LAST_ID = (1 << 63) - 1
_BASE = np.uint64(0x9E3779B97F4A7C55)
_A = np.uint64(0xD6E8FEB86659FD93)
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * _A
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xFF51AFD7ED558CCD)
    return h ^ (h >> np.uint64(32))


class Words:
    """Hashes of the words of a byte string: differences of a running polynomial sum."""

    def __init__(self):
        self.power = self.inverse = np.zeros(0, np.uint64)

    def _reach(self, n: int) -> None:
        if len(self.power) < n:
            one = np.ones(1, np.uint64)
            self.power = np.cumprod(np.concatenate([one, np.full(n - 1, _BASE)]))
            self.inverse = np.cumprod(np.concatenate([one, np.full(n - 1, np.uint64(pow(int(_BASE), -1, 1 << 64)))]))

    def __call__(self, raw: bytes) -> np.ndarray:
        out, at = [], 0
        while at < len(raw):
            end = at + CHUNK
            if end < len(raw):  # to the next white space
                while end < len(raw) and not _SPACE[raw[end]]:
                    end += 1
            out.append(self._chunk(np.frombuffer(raw, np.uint8)[at:end]))
            at = end
        return np.concatenate(out) if out else np.zeros(0, np.uint64)

    def _chunk(self, b: np.ndarray) -> np.ndarray:
        self._reach(len(b) + 1)
        edge = np.diff(np.concatenate([[True], _SPACE[b], [True]]).astype(np.int8))
        first, last = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
        run = np.zeros(len(b) + 1, np.uint64)
        np.cumsum((b.astype(np.uint64) + np.uint64(1)) * self.power[: len(b)], out=run[1:])
        return mixed((run[last] - run[first]) * self.inverse[first] + (last - first).astype(np.uint64))


class Prefixes:
    """Variable-length prefixes as tables by depth: a bucket's entry is its first group, or the table one word deeper.
    What they hold is bounded by TABLES, whatever the corpus."""

    def __init__(self, capacity: int):
        self.capacity, self.depth, self.open, self.groups, self.room = capacity, [1], [0], 0, 0
        self.tables, self.parts = [np.full(1 << BUCKETS, -1, np.int32)], [np.ones(1 << BUCKETS, np.int32)]

    def table_of(self, words: np.ndarray, starts: np.ndarray, codes: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """For the suffixes at these starts: the group (or -1) and the last table reached with its bucket, as one number."""
        n, tables, parts = len(starts), np.concatenate(self.tables), np.concatenate(self.parts)
        at, group = np.zeros(n, np.int32), np.full(n, -1, np.int32)
        todo, bucket = np.arange(n, dtype=np.int32), np.zeros(n, np.int32)
        for d in range(LONGEST):
            b = (words[starts[todo] + d] >> np.uint64(64 - BUCKETS)).astype(np.int32)
            bucket[todo] = b
            flat = tables[(at[todo] << BUCKETS) + b]
            group[todo[flat >= 0]] = flat[flat >= 0]
            deeper = flat <= -2
            at[todo[deeper]] = -2 - flat[deeper]
            todo = todo[deeper]
            if not len(todo):
                break
        place = (at << BUCKETS) + bucket
        if codes is not None and (parts > 1).any():
            group += (mixed(codes.copy()) % parts[place].astype(np.uint64)).astype(np.int32)
        return group, place

    def grow(self, counts: dict[int, int]) -> bool:
        """Settles the open tables by their buckets' counts; True if new tables are open."""
        opened = []
        for t in self.open:
            n = [counts.get((t << BUCKETS) + b, 0) for b in range(1 << BUCKETS)]
            for b in range(1 << BUCKETS):
                if n[b] > self.capacity:
                    if self.depth[t] < LONGEST and len(self.tables) < TABLES:
                        self.tables[t][b] = -2 - len(self.tables)
                        opened.append(len(self.tables))
                        self.tables.append(np.full(1 << BUCKETS, -1, np.int32))
                        self.parts.append(np.ones(1 << BUCKETS, np.int32))
                        self.depth.append(self.depth[t] + 1)
                    else:
                        self.tables[t][b], self.parts[t][b] = self.groups, -(-n[b] // self.capacity)
                        self.groups, self.room = self.groups + int(self.parts[t][b]), 0
                    continue
                if self.groups == 0 or n[b] > self.room:
                    self.groups, self.room = self.groups + 1, self.capacity
                self.room -= n[b]
                self.tables[t][b] = self.groups - 1
        self.open = opened
        return bool(opened)


def _blocks(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[list[int], list[int], list[np.ndarray]]]:
    """Blocks of distinct rows as (ids, keys, hashes of words)."""
    hashed = Words()
    ids, keys, words, size = [], [], [], 0
    seen: set = set()
    for batch in batches:
        for i, k, text in zip(batch["doc_id"], batch["tkey"], batch["text"]):
            i = int(i)
            if not text or (i, k) in seen:
                continue
            seen.add((i, k))
            raw = text.encode("utf-8", "replace")
            if size and size + len(raw) > BLOCK:
                yield ids, keys, words
                ids, keys, words, size = [], [], [], 0
                seen = {(i, k)}
            w = hashed(raw)
            if len(w) >= WINDOW:
                ids.append(i)
                keys.append(int(k))
                words.append(w)
                size += len(raw)
    if ids:
        yield ids, keys, words


def _windows(words: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All words, the places where a window starts, and each place's number of its document."""
    n = np.array([len(w) for w in words])
    flat = np.concatenate([*words, np.zeros(WINDOW, np.uint64)])
    windows, before = n - WINDOW + 1, np.cumsum(n) - n  # no document is shorter than a window
    doc = np.repeat(np.arange(len(words), dtype=np.int32), windows)
    at = np.arange(len(doc), dtype=np.int32) + (before - (np.cumsum(windows) - windows)).astype(np.int32)[doc]
    return flat, at, doc


def _rows(docs: DataFrame) -> DataFrame:
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST_ID)).alias("doc_id"), F.xxhash64("text").alias("tkey"), "text")


def plan_prefixes(docs: DataFrame) -> Prefixes:
    """The prefixes' tables, by one pass over all texts for each length that is needed."""
    prefixes = Prefixes(0)
    while True:

        def count(batches: Iterator[pd.DataFrame], p: Prefixes = prefixes) -> Iterator[pd.DataFrame]:
            total = np.zeros(len(p.tables) << BUCKETS, np.int64)
            for _, _, words in _blocks(batches):
                flat, at, _ = _windows(words)
                group, bucket = p.table_of(flat, at)
                total += np.bincount(bucket[group < 0], minlength=len(total))
            k = np.flatnonzero(total)
            yield pd.DataFrame({"k": k, "n": total[k]})

        got = _rows(docs).mapInPandas(count, "k long, n long").groupBy("k").agg(F.sum("n").alias("n")).collect()
        counts = {r.k: r.n for r in got}
        if not prefixes.capacity:
            prefixes.capacity = max(20_000, min(CAPACITY, sum(counts.values()) // LEAST_GROUPS))
        if not prefixes.grow(counts):
            return prefixes


def _codes(flat: np.ndarray) -> np.ndarray:
    """The first DEEP symbols of the suffix at each word, the first one leading."""
    n = len(flat) - WINDOW
    symbols = flat >> np.uint64(60)
    h = symbols[:n].copy()
    for k in range(1, DEEP):
        h <<= np.uint64(4)
        h |= symbols[k : k + n]
    return h


def deep_nodes(codes: np.ndarray, least: int = DEEP) -> tuple[np.ndarray, np.ndarray]:
    """The suffixes' order and, for each in order, its node: the highest internal node of the tree that is `least` symbols
    deep or more. Neighbours in order are below one such node if they have so many symbols in common."""
    order = np.argsort(codes, kind="stable")
    apart = codes[order]
    apart = apart[1:] ^ apart[:-1]
    new = apart >> np.uint64(4 * (DEEP - least)) != 0
    return order, np.concatenate([[0], np.cumsum(new)]) if len(codes) else np.zeros(0, np.int64)


def _settled(codes: np.ndarray, flat: np.ndarray, at: np.ndarray, ids: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Whether each suffix's window stands, word for word, in a smaller document of this block too."""
    order, node = deep_nodes(codes)
    rank = ids[doc[order]]
    # the first of a node by id, then by place, stands for it
    by = np.lexsort((rank, node))
    order, rank = order[by], rank[by]
    head = np.flatnonzero(np.diff(node, prepend=-1))
    size = np.diff(np.append(head, len(node)))
    first, low = np.repeat(order[head], size), np.repeat(rank[head], size)
    far = np.flatnonzero(rank > low)
    mine, other = order[far], first[far]
    same = np.ones(len(far), bool)
    for k in range(WINDOW):
        same &= flat[at[mine] + k] == flat[at[other] + k]
    out = np.zeros(len(codes), bool)
    out[mine[same]] = True
    return out


def _suffixes(batches: Iterator[pd.DataFrame], prefixes: Prefixes) -> Iterator[pd.DataFrame]:
    """Each block's suffixes, packed by group: ids, keys and counts of its documents, steps between places, codes. And
    what the block settles itself, which passes through some group as the row's id, key and places."""
    for ids, keys, words in _blocks(batches):
        flat, at, doc = _windows(words)
        code, ids, keys = _codes(flat)[at], np.array(ids, np.int64), np.array(keys, np.int64)
        gone = _settled(code, flat, at, ids, doc)
        first = np.concatenate([[0], np.cumsum([len(w) for w in words])])
        out: dict[str, list] = {"gid": [], "tree": [], "blob": [], "id": [], "key": []}
        settled = np.flatnonzero(gone)
        for part in np.split(settled, np.flatnonzero(np.diff(doc[settled])) + 1) if len(settled) else []:
            k = doc[part[0]]
            out["gid"].append(((int(ids[k]) * 0x9E3779B1) ^ int(keys[k])) % prefixes.groups)  # by id too: copies share a key
            out["tree"].append(False)
            out["blob"].append((at[part] - first[k]).astype(np.int32).tobytes())
            out["id"].append(ids[k])
            out["key"].append(keys[k])
        sent = np.flatnonzero(~gone)
        group, _ = prefixes.table_of(flat, at[sent], code[sent])
        del flat
        for part in _parts(group):
            i = sent[part]
            out["gid"].append(group[part[0]])
            out["tree"].append(True)
            out["blob"].append(_pack(at[i], doc[i], code[i].view(np.uint8).reshape(-1, 8)[:, :6], ids, keys, first))
            out["id"].append(0)
            out["key"].append(0)
        yield pd.DataFrame(out)


def _parts(group: np.ndarray) -> list[np.ndarray]:
    """Places by group, in order."""
    by = np.argsort(group, kind="stable")
    return np.split(by, np.flatnonzero(np.diff(group[by])) + 1) if len(by) else []


def _pack(at: np.ndarray, doc: np.ndarray, path: np.ndarray, ids: np.ndarray, keys: np.ndarray, first: np.ndarray) -> bytes:
    """path: bytes of each suffix."""
    who, n = np.unique(doc, return_counts=True)
    step = np.diff(at, prepend=0)
    far = (step >= 255) | (step < 0)
    head = np.array([len(who), len(at), far.sum()], np.int64)
    parts = (head, ids[who], keys[who], first[who].astype(np.int32), n.astype(np.int32), step[far].astype(np.int32), np.where(far, 255, step).astype(np.uint8), path)
    return b"".join(x.tobytes() for x in parts)


def _unpack(blob: bytes, width: int) -> tuple[np.ndarray, ...]:
    """(ids, keys, places, paths of `width` bytes)"""
    docs, rows, far = np.frombuffer(blob, np.int64, 3).tolist()
    at = 24

    def take(kind, n):
        nonlocal at
        x = np.frombuffer(blob, kind, n, at)
        at += x.nbytes
        return x

    ids, keys, first, n, long_steps = take(np.int64, docs), take(np.int64, docs), take(np.int32, docs), take(np.int32, docs), take(np.int32, far)
    step = take(np.uint8, rows).astype(np.int64)
    step[step == 255] = long_steps
    who = np.repeat(np.arange(docs), n)
    return ids[who], keys[who], (np.cumsum(step) - first[who]).astype(np.int32), take(np.uint8, rows * width).reshape(-1, width)


def _gathered(blobs: list[bytes], width: int) -> list[np.ndarray]:
    trees = [_unpack(b, width) for b in blobs]
    kinds = (np.int64, np.int64, np.int32, np.uint8)
    return [np.concatenate(x) for x in zip(*trees)] if trees else [np.zeros((0, width) if k is np.uint8 else 0, k) for k in kinds]


def _by_row(ids: np.ndarray, keys: np.ndarray, at: np.ndarray) -> pd.DataFrame:
    """(id, key, at): the places of each document row, ascending."""
    order = np.lexsort((at, keys, ids))
    ids, keys, at = ids[order], keys[order], at[order]
    cut = np.flatnonzero((np.diff(ids) != 0) | (np.diff(keys) != 0)) + 1
    first = np.concatenate([[0], cut]).astype(int) if len(ids) else np.zeros(0, int)
    return pd.DataFrame({"id": ids[first], "key": keys[first], "at": pd.Series([np.unique(a) for a in np.split(at, cut)] if len(ids) else [], dtype="object")})


def _subtree(group: pd.DataFrame) -> pd.DataFrame:
    """The candidates of one group, and what its blocks settled: a row for each document row and kind."""
    ids, keys, at, path = _gathered([b for b, tree in zip(group["blob"], group["tree"]) if tree], 6)
    codes = np.zeros((len(path), 8), np.uint8)
    codes[:, :6] = path
    del path
    order, node = deep_nodes(codes.view(np.uint64).ravel())
    del codes
    # below a node of one document alone nothing repeats
    i = ids[order]
    head = np.flatnonzero(np.diff(node, prepend=-1))
    several = (np.minimum.reduceat(i, head) != np.maximum.reduceat(i, head))[node] if len(i) else np.zeros(0, bool)
    order = order[several]
    found = _by_row(ids[order], keys[order], at[order]).assign(settled=False)
    own = [(i, k, np.frombuffer(b, np.int32)) for b, i, k, tree in zip(group["blob"], group["id"], group["key"], group["tree"]) if not tree]
    if own:
        n = [len(a) for *_, a in own]
        rest = _by_row(np.repeat([i for i, *_ in own], n), np.repeat([k for _, k, _ in own], n), np.concatenate([a for *_, a in own]))
        found = pd.concat([found, rest.assign(settled=True)], ignore_index=True)
    return found


def _digests(batches: Iterator[pd.DataFrame], groups: int) -> Iterator[pd.DataFrame]:
    """(id, key, text, at) to the 96-bit digests of the words of these windows, packed by group."""
    from xxhash import xxh3_128_digest

    for b in batches:
        ids, keys, at, doc, out = b["id"].to_numpy(np.int64), b["key"].to_numpy(np.int64), [], [], []
        for k, (text, a) in enumerate(zip(b["text"], b["at"])):
            words = text.encode("utf-8", "replace").split()
            line, end = b" ".join(words), np.cumsum([len(w) + 1 for w in words])
            a = np.unique(a)
            start = np.where(a > 0, end[a - 1], 0).tolist()
            out += [xxh3_128_digest(line[x:y])[:12] for x, y in zip(start, (end[a + WINDOW - 1] - 1).tolist())]
            at.append(a.astype(np.int64))
            doc.append(np.full(len(a), k))
        if not out:
            continue
        path = np.frombuffer(b"".join(out), np.uint8).reshape(-1, 12)
        at, doc = np.concatenate(at), np.concatenate(doc)
        group = (path[:, :4].copy().view(np.uint32).ravel() % np.uint32(groups)).astype(np.int64)
        first = np.zeros(len(b), np.int64)
        parts = _parts(group)
        yield pd.DataFrame({"gid": [group[p[0]] for p in parts], "blob": [_pack(at[p], doc[p], path[p], ids, keys, first) for p in parts]})


def _proven(group: pd.DataFrame) -> pd.DataFrame:
    """The windows whose words a smaller document has."""
    ids, keys, at, path = _gathered(list(group["blob"]), 12)
    whole = np.zeros((len(path), 16), np.uint8)
    whole[:, :12] = path
    whole = whole.view(np.uint64)
    order = np.lexsort((ids, whole[:, 1], whole[:, 0]))
    new = (np.diff(whole[order, 0], prepend=0) != 0) | (np.diff(whole[order, 1], prepend=0) != 0)
    new[:1] = True
    rank, head = ids[order], np.flatnonzero(new)
    low = np.repeat(rank[head], np.diff(np.append(head, len(rank)))) if len(rank) else rank
    gone = order[rank > low]
    return _by_row(ids[gone], keys[gone], at[gone])


def _key(docs: DataFrame, i: str, k: str):
    return (F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST_ID)) == named(i)) & (F.xxhash64("text") == named(k))


def places(docs: DataFrame) -> DataFrame:
    """(id, key, at): for each row with repeats, arrays of the words where a removed window starts. A null id is LAST_ID."""
    prefixes = plan_prefixes(docs)
    if not prefixes.groups:
        return docs.sparkSession.createDataFrame([], "id long, key long, at array<int>")
    packed = _rows(docs).mapInPandas(lambda b: _suffixes(b, prefixes), "gid long, tree boolean, blob binary, id long, key long")
    found = written(packed.groupBy("gid").applyInPandas(_subtree, "id long, key long, at array<int>, settled boolean"), "substring-candidates", release=True)
    sure, open_ = found.filter("settled").drop("settled"), found.filter("not settled")
    total = open_.agg(F.sum(F.size("at"))).first()[0] or 0
    groups = max(LEAST_GROUPS, -(-total // CAPACITY))
    at = open_.groupBy("id", "key").agg(F.flatten(F.collect_list("at")).alias("at"))
    texts = docs.select("doc_id", "text").join(at, _key(docs, "id", "key")).dropDuplicates(["id", "key"]).select("id", "key", "text", "at")
    digests = texts.mapInPandas(lambda b: _digests(b, groups), "gid long, blob binary")
    proven = digests.groupBy("gid").applyInPandas(_proven, "id long, key long, at array<int>")
    return written(proven.unionByName(sure), "substring-places", release=True)


def _covered(at: np.ndarray | None, n: int) -> np.ndarray:
    """Which of n words lie in a window that starts at one of the places."""
    depth = np.zeros(n + WINDOW + 1, np.int64)
    if at is not None and len(at):
        at = np.unique(at)
        depth[at] += 1
        depth[at + WINDOW] -= 1
    return np.cumsum(depth)[:n] > 0


def with_places(docs: DataFrame, name: str) -> DataFrame:
    """docs with the places of all groups, or null, under a name that docs does not have."""
    i, k = free(docs, "_id", "_key")
    found = places(docs).groupBy(F.col("id").alias(i), F.col("key").alias(k)).agg(F.flatten(F.collect_list("at")).alias(name))
    return docs.join(found, _key(docs, i, k), "left").drop(i, k)


def report(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256."""

    def cut(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for texts, at in batches:
            out = []
            for text, a in zip(texts, at):
                words = (text or "").encode("utf-8", "replace").split()
                gone = _covered(a, len(words))
                kept = [w for w, g in zip(words, gone.tolist()) if not g] if a is not None else words
                out.append((len(words), len(words) - len(kept), hashlib.sha256(b" ".join(kept)).hexdigest()))
            yield pd.DataFrame(out, columns=["n_words", "n_removed", "kept_sha256"])

    out = with_places(docs.select("doc_id", "text"), "_at")
    return out.select("doc_id", F.pandas_udf(cut, "n_words long, n_removed long, kept_sha256 string")("text", "_at").alias("r")).select("doc_id", "r.*")


def maximal_repeats(docs: DataFrame) -> DataFrame:
    """(doc_id, key, start, length), in words: the removed repeats, neighbouring windows joined."""

    def joined(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for i, k, at in zip(b["id"], b["key"], b["_at"]):
                a = np.unique(at)
                new = np.flatnonzero(np.diff(a) > WINDOW) + 1
                start, end = a[np.concatenate([[0], new])], a[np.concatenate([new - 1, [len(a) - 1]])] + WINDOW
                yield pd.DataFrame({"doc_id": i, "key": k, "start": start, "length": end - start})

    found = places(docs).groupBy("id", "key").agg(F.flatten(F.collect_list("at")).alias("_at"))
    return found.mapInPandas(joined, "doc_id long, key long, start int, length int")


def remove_repeats(docs: DataFrame) -> DataFrame:
    """docs without the repeated words; a text that lost some is its other words, joined by one space."""

    def cut(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for texts, at in batches:
            out = []
            for text, a in zip(texts, at):
                if a is not None and text:
                    words = text.encode("utf-8", "replace").split()
                    text = b" ".join(w for w, g in zip(words, _covered(a, len(words)).tolist()) if not g).decode()
                out.append(text)
            yield pd.Series(out, dtype="object")

    at, new = free(docs, "_at", "_new")
    out = with_places(docs, at).withColumn(new, F.pandas_udf(cut, "string")(F.col("text"), F.col(at)))
    return out.select(*columns_of(docs, F.col(new)))
