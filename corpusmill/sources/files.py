"""Files to documents: discovery, exclusion, loaders by extension, sidecars and resumable transcription.

Paths are listed and read by Spark's own readers, so any store that Spark reads will do. Loading never stops at a bad
file: it has `error` set and no content. OCR, speech recognition and frame extraction are injected callables that run in
Arrow batches on the executors.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X
from . import subtitles as S

TEXT, SUBTITLE, IMAGE = ("txt", "md"), ("srt", "vtt"), ("png", "jpg", "jpeg", "tiff", "bmp", "webp")
# Media that can be transcribed.
MEDIA = ("mp4", "mkv", "avi", "mov", "webm", "flv", "wmv", "mp3", "wav", "flac", "ogg", "m4a", "aac", "wma")
VIDEO = MEDIA[:7]
SIDECARS = ("srt", "vtt")
DOCUMENT = "doc_id string, content string, title string, source string, format string, duration_secs double, cues array<struct<index:int,start_secs:double,end_secs:double,text:string>>, frame_time_secs double, language string, error string"


def glob_regex(pattern: str) -> str:
    """A glob as a regular expression for whole paths: * and ** match anything, **/ also nothing, ? one character, [] and {} choices."""
    out, depth, i = "", 0, 0
    while i < len(pattern):
        c = pattern[i]
        if pattern.startswith("**/", i):
            out, i = out + "(?:.*/)?", i + 3
            continue
        if c == "*":
            out, i = out + ".*", i + 1
            continue
        if c == "[":
            end = pattern.find("]", i + 2)
            if end < 0:
                raise ValueError(f"invalid exclude pattern {pattern!r}")
            body = pattern[i + 1 : end]
            out += "[" + ("^" + body[1:] if body[0] in "!^" else body).replace("\\", r"\\") + "]"
            i = end
        elif c == "{":
            out, depth = out + "(?:", depth + 1
        elif c == "}" and depth:
            out, depth = out + ")", depth - 1
        elif c == "," and depth:
            out += "|"
        else:
            out += "." if c == "?" else re.escape(c)
        i += 1
    if depth:
        raise ValueError(f"invalid exclude pattern {pattern!r}")
    return f"(?s)^{out}$"


def excluded(path: Column, patterns: list[str]) -> Column:
    """True where any pattern matches the path or, for directories, a leading part of it."""
    each = [path.rlike(glob_regex(p)) | path.rlike(glob_regex(p)[:-1] + "/.*$") for p in patterns]
    return reduce(lambda a, b: a | b, each, F.lit(False))


def discover(spark: SparkSession, root: str, recursive: bool = True, exclude: list[str] | None = None, accept: tuple[str, ...] | None = None) -> DataFrame:
    """(path, extension, length), sorted by path; contents are not read."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).load(root).select("path", "length")
    found = found.withColumn("extension", X.file_extension(F.col("path")))
    if exclude:
        found = found.filter(~excluded(F.col("path"), exclude))
    if accept is not None:
        found = found.filter(F.col("extension").isin(*accept))
    return found.orderBy("path")


def classified(files: DataFrame) -> DataFrame:
    """(extension, n); files without extension are `other`."""
    ext = F.when(F.col("extension") == "", "other").otherwise(F.col("extension"))
    return files.groupBy(ext.alias("extension")).agg(F.count("*").alias("n"))


def with_sidecar(media: DataFrame, files: DataFrame) -> DataFrame:
    """media (path) with sidecar: the subtitle file of the same stem, .srt before .vtt, or null."""
    stem = lambda c: F.regexp_replace(c, r"\.[^./]*$", "")
    side = files.filter(F.col("extension").isin(*SIDECARS)).groupBy(stem(F.col("path")).alias("_stem")).agg(F.min_by("path", F.struct(F.col("extension") != "srt", "path")).alias("sidecar"))
    return media.join(side, stem(media["path"]) == F.col("_stem"), "left").drop("_stem")


def to_transcribe(media: DataFrame, files: DataFrame, manifest: DataFrame) -> DataFrame:
    """Media without a sidecar that the manifest (path, status) has not as completed."""
    open_ = with_sidecar(media, files).filter(F.col("sidecar").isNull()).drop("sidecar")
    return open_.join(manifest.filter("status = 'completed'").select("path").distinct(), "path", "left_anti")


def _as_documents(df: DataFrame, **columns: Column) -> DataFrame:
    kinds = [x.split(" ", 1) for x in re.split(r", (?=\w+ )", DOCUMENT)]
    return df.select(*[columns.get(n, F.lit(None)).cast(t).alias(n) for n, t in kinds])


def _whole(spark: SparkSession, paths: list[str] | str) -> DataFrame:
    rows = spark.read.text(paths, wholetext=True)
    return rows.select("value", F.col("_metadata.file_path").alias("path"))


def load_text(spark: SparkSession, paths: list[str] | str) -> DataFrame:
    path = F.col("path")
    return _as_documents(_whole(spark, paths), doc_id=path, content=F.col("value"), title=X.file_stem(path), source=path, format=X.file_extension(path))


def load_subtitles(spark: SparkSession, paths: list[str] | str) -> DataFrame:
    path, t = F.col("path"), F.col("t")
    rows = _whole(spark, paths).withColumn("t", S.parsed(F.col("value")))
    return _as_documents(
        rows, doc_id=path, content=S.plain_text(t["cues"]), title=X.file_stem(path), source=path, format=t["format"], duration_secs=S.duration(t["cues"]), cues=t["cues"],
        error=F.when(t.isNull(), "no valid cues"),
    )


def _applied(spark: SparkSession, paths: list[str] | str, f: Callable[[bytes], object], kind: str) -> DataFrame:
    """path, value, error: f over each file's bytes; what f raises is the row's error."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for path, raw in zip(b["path"], b["content"]):
                try:
                    value, error = f(raw), None
                except Exception as e:  # a bad file must not end the job
                    value, error = None, f"{type(e).__name__}: {e}"
                yield pd.DataFrame({"path": [path], "value": pd.Series([value], dtype="object"), "error": pd.Series([error], dtype="object")})

    rows = spark.read.format("binaryFile").load(paths).select("path", "content")
    return rows.mapInPandas(run, f"path string, value {kind}, error string")


def load_images(spark: SparkSession, paths: list[str] | str, ocr: Callable[[bytes], str]) -> DataFrame:
    path = F.col("path")
    rows = _applied(spark, paths, ocr, "string")
    return _as_documents(rows, doc_id=path, content=X.stripped(F.col("value")), title=X.file_stem(path), source=path, format=X.file_extension(path), frame_time_secs=X.frame_time(path), error=F.col("error"))


def load_media(spark: SparkSession, paths: list[str] | str, transcribe: Callable[[bytes], dict]) -> DataFrame:
    """transcribe: bytes to {"cues": [...], "language": ...}. For media with a sidecar load that with load_subtitles."""
    path = F.col("path")
    rows = _applied(spark, paths, transcribe, f"struct<cues:array<{S.CUE}>,language:string>")
    v = F.col("value")
    return _as_documents(rows, doc_id=path, content=S.plain_text(v["cues"]), title=X.file_stem(path), source=path, format=X.file_extension(path), duration_secs=S.duration(v["cues"]), cues=v["cues"], language=v["language"], error=F.col("error"))


def extracted_frames(spark: SparkSession, paths: list[str] | str, extract: Callable[[bytes], list[str]]) -> DataFrame:
    """(path, value: frame paths, error): an injected frame extractor over video files."""
    return _applied(spark, paths, extract, "array<string>")


def frame_folder(path: Column) -> Column:
    """Where a video's frames are: a folder beside it, named as it is, with -frames."""
    return F.concat(F.regexp_replace(path, r"\.[^./]*$", ""), F.lit("-frames"))


def without_frames(spark: SparkSession, videos: DataFrame, root: str) -> DataFrame:
    """(path) of videos whose frame folder holds no image."""
    images = discover(spark, root, True, None, IMAGE).select(F.regexp_replace("path", "/[^/]*$", "").alias("_folder")).distinct()
    return videos.select("path").join(images, frame_folder(F.col("path")) == F.col("_folder"), "left_anti")


class Loaders:
    """Loaders by extension; later ones do not replace earlier ones."""

    def __init__(self):
        self.of: list[tuple[tuple[str, ...], Callable]] = []
        self.register(TEXT, load_text).register(SUBTITLE, load_subtitles)

    def register(self, extensions: tuple[str, ...], load: Callable) -> Loaders:
        self.of.append((tuple(e.lower() for e in extensions), load))
        return self

    @property
    def extensions(self) -> list[str]:
        return sorted({e for es, _ in self.of for e in es})

    def loader(self, extension: str) -> Callable | None:
        return next((f for es, f in self.of if extension.lower() in es), None)

    def load(self, spark: SparkSession, root: str, recursive: bool = True, exclude: list[str] | None = None) -> DataFrame:
        """All files of known extensions below root, one read per loader."""
        files = discover(spark, root, recursive, exclude, tuple(self.extensions))
        parts = []
        for es, f in self.of:
            reader = files.filter(F.col("extension").isin(*es)).select("path")
            paths = [r.path for r in reader.toLocalIterator()]
            if paths:
                parts.append(f(spark, paths))
        if not parts:
            raise ValueError(f"no supported files below {root}")
        return reduce(lambda a, b: a.unionByName(b), parts)
