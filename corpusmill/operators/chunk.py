"""Chunkers: documents (doc_id, content) to chunks (chunk_id, doc_id, position, content, start_offset, end_offset).

Offsets are UTF-8 bytes, of time chunks whole seconds. A chunk's id is its document's and its position, so reruns and ties
agree. Documents that are null or empty give no chunk; `skipped` counts them. Fixed, sentence, paragraph and structural
chunks are column expressions; the recursive, semantic and time chunkers fold over a document and run in Arrow batches.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions.let import let, running_sums

CHUNK = "array<struct<content:string,start_offset:long,end_offset:long>>"
SEPARATORS = ("\n\n", "\n", ". ", " ")


def _named(df: DataFrame) -> DataFrame:
    return df.withColumn("chunk_id", F.concat_ws("#", F.col("doc_id").cast("string"), F.col("position").cast("string")))


def _inline(docs: DataFrame, chunks: Column) -> DataFrame:
    """One row for each struct of `chunks`, in order."""
    rows = docs.select("doc_id", F.posexplode(chunks).alias("position", "c"))
    return _named(rows.select("doc_id", "position", "c.*"))


def with_content(docs: DataFrame) -> DataFrame:
    return docs.filter(F.length("content") > 0)


def skipped(docs: DataFrame) -> DataFrame:
    """(skipped): documents without content."""
    return docs.agg(F.count_if(F.coalesce(F.length("content"), F.lit(0)) == 0).alias("skipped"))


def _positive(**sizes: int) -> None:
    for name, n in sizes.items():
        if n < 1:
            raise ValueError(f"{name} must be 1 or more, not {n}")


def fixed_size(docs: DataFrame, size: int = 512, overlap: int = 50) -> DataFrame:
    """Windows of `size` characters, each `size - overlap` after the last, up to the one that reaches the end."""
    _positive(size=size)
    step = max(size - overlap, 1)
    n = F.length("content")
    count = F.when(n <= size, 1).otherwise(1 + F.ceil((n - size) / step)).cast("int")
    # the text is walked once, into pieces of a step each; a window is some neighbouring pieces
    pieces = F.regexp_extract_all("content", F.lit(f"(?s).{{1,{step}}}"), F.lit(0))
    parts = -(-size // step)

    def windows(s: Column) -> Column:
        text = lambda i: F.substr(F.array_join(F.slice(s["p"], i + 1, F.lit(parts)), ""), F.lit(1), F.lit(size))
        return F.transform(F.sequence(F.lit(0), count - 1), lambda i: F.struct(text(i).alias("content"), F.get(s["at"], i).alias("start_offset")))

    placed = let(pieces, lambda p: F.struct(p.alias("p"), running_sums(F.transform(p, lambda x: F.octet_length(x))).alias("at")))
    rows = with_content(docs).select("doc_id", F.posexplode(let(placed, windows)).alias("position", "c"))
    return _named(rows.select("doc_id", "position", "c.content", "c.start_offset", (F.col("c.start_offset") + F.octet_length("c.content")).alias("end_offset")))


def _grouped(parts: Column, most: int, step: int, joint: str) -> Column:
    groups = lambda p: F.transform(F.sequence(F.lit(0), F.size(p) - 1, F.lit(step)), lambda i: F.array_join(F.slice(p, i + 1, F.lit(most)), joint))
    return let(parts, lambda p: F.when(F.size(p) > 0, groups(p)))


def _found(docs: DataFrame, texts: Column) -> DataFrame:
    """Chunks of texts; each starts at its first occurrence in the content, or at 0 where it is not a piece of it."""
    rows = with_content(docs).select("doc_id", F.col("content").alias("_all"), F.posexplode(texts).alias("position", "content"))
    at = F.coalesce(X.byte_find(F.col("_all"), F.col("content")), F.lit(0)).cast("long")
    return _named(rows.select("doc_id", "position", "content", at.alias("start_offset"), (at + F.octet_length("content")).alias("end_offset")))


def by_sentence(docs: DataFrame, most: int = 5, overlap: int = 1) -> DataFrame:
    """Groups of `most` sentences joined by a space, each group `most - overlap` sentences on; short tails repeat."""
    _positive(most=most)
    return _found(docs, _grouped(X.sentences(F.col("content")), most, max(most - overlap, 1), " "))


def by_paragraph(docs: DataFrame, most: int = 1) -> DataFrame:
    """Groups of `most` paragraphs; blank lines part them."""
    _positive(most=most)
    parts = F.filter(F.transform(F.split("content", "\n\n"), X.stripped), lambda p: p != "")
    return _found(docs, _grouped(parts, most, most, "\n\n"))


HEADER_LINE = r"(?U)(?m)(?=^[^\S\n]*#++[^\S\n]*\S)"


def sections(docs: DataFrame, respect_headers: bool = True) -> DataFrame:
    """(doc_id, section, header, content): text from one header line to the next, trimmed."""
    body = F.regexp_replace("content", "\r\n", "\n") if respect_headers else F.col("content")
    parts = F.filter(F.transform(F.split(body, HEADER_LINE), X.stripped), lambda p: p != "") if respect_headers else F.array(body)
    rows = with_content(docs).select("doc_id", F.col("content").alias("_all"), F.posexplode(parts).alias("section", "content"))
    head = X.header(F.substring_index("content", "\n", 1)) if respect_headers else F.lit(None).cast("string")
    return rows.withColumn("header", head)


def structural(docs: DataFrame, respect_headers: bool = True, most: int = 1000) -> DataFrame:
    """A chunk for each section, with its header; larger sections are cut recursively, with offsets in the section."""
    _positive(most=most)
    rows = sections(docs, respect_headers)
    large = F.octet_length("content") > most
    at = F.coalesce(X.byte_find(F.col("_all"), F.col("content")), F.lit(0)).cast("long")
    whole = F.array(F.struct("content", at.alias("start_offset"), (at + F.octet_length("content")).alias("end_offset")))
    rows = rows.withColumn("_cut", _recursive_udf(most, min(50, most - 1), SEPARATORS, False)(F.when(large, F.col("content"))))
    rows = rows.select("doc_id", "section", "header", F.posexplode(F.when(large, F.col("_cut")).otherwise(whole)).alias("_i", "c"))
    by_doc = rows.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("section", "_i", "header", "c"))).alias("all"))
    out = by_doc.select("doc_id", F.posexplode("all").alias("position", "x"))
    return _named(out.select("doc_id", "position", "x.c.*", F.when(F.col("x.header").isNull(), F.array().cast("array<string>")).otherwise(F.array("x.header")).alias("headers")))


def _pieces(text: str, size: int, overlap: int, separators: tuple[str, ...], strict: bool) -> Iterator[str]:
    """Parts of at most `size` bytes, cut at the first separator that helps and packed greedily.

    A part that is too large by itself is cut by the next separators if nothing waits before it, or if it comes last; else it
    stays whole, unless `strict`.
    """
    work: list[tuple[str, int, bool]] = [(text, 0, True)]  # text, level, may be cut
    while work:
        t, level, cut = work.pop()
        if len(t.encode()) <= size or not cut:
            yield t
            continue
        while level < len(separators) and separators[level] not in t:
            level += 1
        if level == len(separators):
            step = size - overlap
            yield from (t[i : i + size] for i in range(0, max(len(t) - overlap, 1), step))
            continue
        sep = separators[level]
        gap, parts = len(sep.encode()), t.split(sep)
        runs: list[tuple[str, int, bool]] = []
        waiting, used = [], 0
        for p in parts:
            n = len(p.encode())
            if waiting and used + gap + n <= size:
                waiting.append(p)
                used += gap + n
                continue
            if waiting:
                runs.append((sep.join(waiting), level + 1, strict))
                waiting, used = [p], n
            elif n > size:
                runs.append((p, level + 1, True))
            else:
                waiting, used = [p], n
            if not used:  # an empty part does not wait
                waiting = []
        if waiting:
            runs.append((sep.join(waiting), level + 1, True))
        work.extend(reversed(runs))


def recursive_chunks(text: str, size: int = 512, overlap: int = 50, separators: tuple[str, ...] = SEPARATORS, strict: bool = False) -> list[dict]:
    """Pieces, each after the last `overlap` bytes of the piece before; a start is the next occurrence in the text, or
    where the search began if there is none."""
    raw = text.encode()
    boundary = lambda b, i: next((j for j in range(min(i, len(b)), len(b)) if b[j] & 0xC0 != 0x80), len(b))
    out, at, before = [], 0, b""
    for piece in _pieces(text, size, overlap, separators, strict):
        own = piece.encode()
        chunk = before[boundary(before, len(before) - overlap) if len(before) > overlap else 0 :] + own if overlap and out else own
        at = boundary(raw, at)
        found = raw.find(chunk, at)
        at = found if found >= 0 else at
        out.append({"content": chunk.decode(), "start_offset": at, "end_offset": at + len(chunk)})
        at, before = boundary(raw, at + 1), own
    return out


def _recursive_udf(size: int, overlap: int, separators: tuple[str, ...], strict: bool) -> Callable[[Column], Column]:
    @F.pandas_udf(CHUNK)
    def cut(texts: pd.Series) -> pd.Series:
        return pd.Series([recursive_chunks(t, size, overlap, separators, strict) if t else None for t in texts], dtype="object")

    return cut


def recursive(docs: DataFrame, size: int = 512, overlap: int = 50, separators: tuple[str, ...] = SEPARATORS, strict: bool = False) -> DataFrame:
    _positive(size=size)
    if not 0 <= overlap < size:
        raise ValueError(f"overlap must be less than the size {size}, not {overlap}")
    return _inline(with_content(docs), _recursive_udf(size, overlap, tuple(separators), strict)(F.col("content")))


def semantic(docs: DataFrame, embedder, threshold: float = 0.5, most: int = 1000) -> DataFrame:
    """Neighbouring sentences, until one is less similar than `threshold` to the chunk's first, or the chunk's sentences
    would be over `most` bytes. A sentence that cannot be embedded is similar to nothing."""
    import numpy as np

    def groups(sents: list[str]) -> list[str]:
        got = embedder.embed_batch(list(sents))
        v = np.array([np.zeros(embedder.dimension) if x is None else x for x in got], np.float64).reshape(len(sents), -1)
        n = np.linalg.norm(v, axis=1)
        out, first, size = [], 0, 0
        for i, s in enumerate(sents):
            width = len(s.encode())
            if i > first:
                alike = v[first] @ v[i] / (n[first] * n[i]) if n[first] * n[i] > 0 else 0.0
                if alike < threshold or size + width > most:
                    out.append(" ".join(sents[first:i]))
                    first, size = i, 0
            size += width
        return [*out, " ".join(sents[first:])]

    @F.pandas_udf("array<string>")
    def cut(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for b in batches:
            yield pd.Series([groups(list(s)) if s is not None and len(s) else [] for s in b], dtype="object")

    return _found(docs, cut(X.sentences(F.col("content"), before_capital=False)))


TIMED = "array<struct<content:string,start_offset:long,end_offset:long,start_secs:double,end_secs:double,cue_count:int>>"


def time_chunks(cues: list, target: float, least: float, overlap: float) -> list[dict]:
    """Cues gathered until one would end `target` seconds or more after the chunk's start. The next chunk begins with the
    cues of the last `overlap` seconds. A last chunk of under `least` seconds is appended to the one before, whose
    cue count stays as it was."""
    held: list[int] = []
    made: list[list[int]] = []
    start = cues[0]["start_secs"]
    for i, c in enumerate(cues):
        if held and c["end_secs"] - start >= target:
            made.append(held)
            held = [j for j in held if cues[j]["start_secs"] >= c["start_secs"] - overlap]
            start = cues[held[0]]["start_secs"] if held else c["start_secs"]
        held = [*held, i]
    text = lambda js: " ".join(cues[j]["text"] for j in js)
    short = bool(made) and cues[held[-1]]["end_secs"] - start < least
    out = []
    for js in made if short else [*made, held]:
        out.append({"content": text(js), "start_secs": cues[js[0]]["start_secs"], "end_secs": cues[js[-1]]["end_secs"], "cue_count": len(js)})
    if short:
        out[-1] |= {"content": f"{out[-1]['content']} {text(held)}", "end_secs": cues[held[-1]]["end_secs"]}
    return [x | {"start_offset": int(max(x["start_secs"], 0)), "end_offset": int(max(x["end_secs"], 0))} for x in out]


def by_time(docs: DataFrame, target: float = 60.0, least: float = 10.0, overlap: float = 5.0) -> DataFrame:
    """Chunks of documents with `cues`; those without cues are cut recursively (512, 50)."""

    @F.pandas_udf(TIMED)
    def cut(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for b in batches:
            yield pd.Series([time_chunks(list(c), target, least, overlap) if c is not None and len(c) else None for c in b], dtype="object")

    has = F.size("cues") > 0
    rows = with_content(docs)
    plain = _recursive_udf(512, 50, SEPARATORS, False)(F.when(~F.coalesce(has, F.lit(False)), F.col("content")))
    padded = F.transform("_plain", lambda c: F.struct(c["content"], c["start_offset"], c["end_offset"], F.lit(None).cast("double").alias("start_secs"), F.lit(None).cast("double").alias("end_secs"), F.lit(None).cast("int").alias("cue_count")))
    rows = rows.withColumns({"_timed": cut("cues"), "_plain": plain})
    out = _inline(rows, F.coalesce("_timed", padded.cast(TIMED)))
    return out.withColumns({"start_display": X.display_time(F.col("start_secs")), "end_display": X.display_time(F.col("end_secs"))})


def chunk(docs: DataFrame, strategy: str = "auto", **options) -> DataFrame:
    """By name. `auto` takes time chunks where the documents have cues and recursive ones otherwise."""
    named = {"fixed": fixed_size, "recursive": recursive, "sentence": by_sentence, "paragraph": by_paragraph, "structural": structural, "semantic": semantic, "timestamp": by_time}
    if strategy == "auto":
        return by_time(docs, **options) if "cues" in docs.columns else recursive(docs, **options)
    if strategy not in named:
        raise ValueError(f"unknown strategy {strategy!r}")
    return named[strategy](docs, **options)


def estimates(docs: DataFrame, size: int = 512, overlap: int = 50, most_sentences: int = 5, overlap_sentences: int = 1, most_paragraphs: int = 1, target: float = 60.0) -> DataFrame:
    """(doc_id, fixed, recursive, sentence, paragraph, structural, semantic, timestamp): how many chunks to expect."""
    c = F.col("content")
    n, octets, some = F.length(c), F.octet_length(c), F.coalesce(F.length(c), F.lit(0)) > 0
    up = lambda x, by: F.ceil(x / by).cast("long")
    paragraphs = F.size(F.filter(F.split(c, "\n\n"), lambda p: X.stripped(p) != ""))
    heads = F.size(F.filter(F.transform(F.split(F.regexp_replace(c, "\r\n", "\n"), HEADER_LINE), X.stripped), lambda p: p != ""))
    length = F.coalesce(F.col("duration_secs") if "duration_secs" in docs.columns else F.lit(None).cast("double"), F.lit(0.0))
    each = {
        "fixed": up(n, max(size - overlap, 1)), "recursive": up(octets, size - overlap) if size > overlap else F.lit(1), "sentence": up(F.size(X.sentences(c)), max(most_sentences - overlap_sentences, 1)),
        "paragraph": up(paragraphs, most_paragraphs), "structural": F.greatest(heads, F.lit(1)), "semantic": F.floor((F.size(X.sentences(c, False)) + 2) / 3),
        "timestamp": F.when(length > 0, up(length, target)).otherwise(1),
    }
    return docs.select("doc_id", *[F.when(some, e).otherwise(0).cast("long").alias(k) for k, e in each.items()])


def first_of_equal(chunks: DataFrame, order: tuple[str, ...] = ("doc_id", "position")) -> DataFrame:
    """Chunks without those whose content came before, in `order`. Copies meet in a partial aggregate, so one text that
    stands for a third of all chunks is as cheap as any other."""
    rest = [c for c in chunks.columns if c not in order]
    first = chunks.groupBy(F.md5("content").alias("_h")).agg(F.min_by(F.struct(*order, *rest), F.struct(*order)).alias("c"))
    return first.select(*[F.col("c")[c].alias(c) for c in chunks.columns])
