"""SRT and WebVTT as columns: a text becomes an array of cues, and cues become a text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions.let import let

CUE = "struct<index:int,start_secs:double,end_secs:double,text:string>"


def _lines(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(c, "^﻿", ""), "\r\n?", "\n")


def is_vtt(c: Column) -> Column:
    return F.regexp_replace(c, "^﻿", "").startswith("WEBVTT")


def without_tags(c: Column) -> Column:
    """Without <...>, what follows an unclosed <, and stray >."""
    return F.replace(F.regexp_replace(c, "<[^>]*(?:>|$)", ""), F.lit(">"), F.lit(""))


def _time(c: Column, separator: str) -> Column:
    c = F.replace(c, F.lit(separator), F.lit("."))
    return F.when(~F.contains(c, F.lit(",")), X.parse_time(c))


def parsed(c: Column) -> Column:
    """struct(format, cues); null where the text has no cue or any cue a bad time.

    A block is a cue if a line of it has an arrow: the times stand there, the text follows. Cues without text go, and
    the others count from 0.
    """
    body = _lines(c)
    after = F.when(F.contains(body, F.lit("\n\n")), F.regexp_replace(body, r"(?s)^.*?\n\n", "")).otherwise("")
    return let(F.when(is_vtt(c), _struct("vtt", F.split(after, "\n\n"))).otherwise(_struct("srt", F.split(body, "\n\n"))), _track)


def _struct(kind: str, blocks: Column) -> Column:
    return F.struct(F.lit(kind).alias("format"), blocks.alias("blocks"))


def _track(t: Column) -> Column:
    vtt = t["format"] == "vtt"

    def cue(s: Column) -> Column:
        lines, at = s["lines"], s["at"]
        times = F.try_element_at(lines, at)
        text = F.array_join(F.slice(lines, at + 1, F.size(lines)), "\n")
        text = X.stripped(F.when(vtt, without_tags(text)).otherwise(text))
        start = X.stripped(F.substring_index(times, "-->", 1))
        end = F.regexp_extract(F.regexp_replace(times, "^.*?-->", ""), r"(?U)(\S+)", 1)
        pick = lambda x: F.when(vtt, _time(x, ".")).otherwise(_time(x, ","))
        return F.when((at > 0) & (vtt | (F.size(lines) >= 2)), F.struct(pick(start).alias("start_secs"), pick(end).alias("end_secs"), text.alias("text")))

    def placed(lines: Column) -> Column:
        return F.struct(lines.alias("lines"), F.array_position(F.transform(lines, lambda x: F.contains(x, F.lit("-->"))), True).cast("int").alias("at"))

    def checked(found: Column) -> Column:
        bad = F.exists(found, lambda x: x["start_secs"].isNull() | x["end_secs"].isNull())
        cues = F.transform(F.filter(found, lambda x: x["text"] != ""), lambda x, i: F.struct(i.alias("index"), x["start_secs"], x["end_secs"], x["text"]).cast(CUE))
        return F.when(~bad & (F.size(cues) > 0), cues)

    blocks = F.filter(t["blocks"], lambda b: X.stripped(b) != "")
    found = F.transform(blocks, lambda b: let(let(F.split(F.regexp_replace(b, r"\n$", ""), "\n"), placed), cue))
    cues = let(F.filter(found, lambda x: x.isNotNull()), checked)
    return let(cues, lambda x: F.when(x.isNotNull(), F.struct(t["format"].alias("format"), x.alias("cues"))))


def to_srt(cues: Column) -> Column:
    """Cues numbered from 1, a blank line after each but the last."""
    one = lambda c, i: F.concat(
        (i + 1).cast("string"), F.lit("\n"), X.srt_time(c["start_secs"]), F.lit(" --> "), X.srt_time(c["end_secs"]), F.lit("\n"), c["text"], F.lit("\n")
    )
    return F.array_join(F.transform(cues, one), "\n")


def duration(cues: Column) -> Column:
    """End of the last cue; 0 without cues."""
    return F.coalesce(F.try_element_at(cues, F.lit(-1))["end_secs"], F.lit(0.0))


def plain_text(cues: Column) -> Column:
    return F.array_join(F.transform(cues, lambda c: c["text"]), " ")


def overlaps(start: Column, end: Column, low: Column, high: Column) -> Column:
    return (end > low) & (start < high)


def cues_in_ranges(cues, ranges, width: float = 60.0):
    """(track, start_secs, end_secs, ...) and (track, range_id, low, high) to the pairs that overlap.

    Both sides are cut at multiples of `width` and meet by track and bin, in an equi-join; a pair counts in the first bin
    that it shares. So a track that holds most cues is spread over its bins.
    """
    bins = lambda a, b: F.explode(F.sequence(F.floor(F.col(a) / width), F.floor(F.col(b) / width)))
    c = cues.filter("end_secs >= start_secs").withColumn("_bin", bins("start_secs", "end_secs"))
    r = ranges.filter("high >= low").withColumn("_bin", bins("low", "high"))
    both = c.join(r, ["track", "_bin"]).filter(overlaps(F.col("start_secs"), F.col("end_secs"), F.col("low"), F.col("high")))
    return both.filter(F.col("_bin") == F.floor(F.greatest("start_secs", "low") / width)).drop("_bin")
