"""Queries of file lists, subtitles, the store, exports and streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import store as ST
from ..sources import files as S
from ..sources import subtitles as SUB
from ..sources.tables import shared_dir, stored, table
from ..streaming import incremental as INC
from . import sql as Q
from .registry import query
from .retrieval_queries import asked, chunks, hybrid_list
from .text_queries import cues

# ---- file lists: names made from page ids

_EXT = ["mp4", "srt", "MP3", "vtt", "txt", "md", "wav"]
_FILES = f"f AS (SELECT page_id, '/m/d' || page_id % 5 || '/n' || page_id // 3 || CASE WHEN page_id % 11 = 0 THEN '' ELSE '.' || [{Q.listed(_EXT)}][1 + page_id % {len(_EXT)}] END AS path FROM pages), g AS (SELECT *, lower(regexp_extract(path, '[^/]\\.([^./]+)$', 1)) AS ext, regexp_replace(path, '\\.[^./]*$', '') AS stem FROM f)"
_MEDIA = f"({Q.listed(list(S.MEDIA))})"


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = F.col("page_id")
    ext = F.get(F.array(*map(F.lit, _EXT)), (p % len(_EXT)).cast("int"))
    path = F.concat(F.lit("/m/d"), (p % 5).cast("string"), F.lit("/n"), F.floor(p / 3).cast("string"), F.when(p % 11 == 0, "").otherwise(F.concat(F.lit("."), ext)))
    return table(spark, sf_dir, "pages").select("page_id", path.alias("path")).withColumn("extension", X.file_extension(F.col("path")))


@query("SELECT page_id, CASE WHEN page_id % 2 = 0 THEN page_id + 0.5 END::DOUBLE AS secs FROM pages")
def a4_frame_time(spark, sf_dir):
    p = F.col("page_id").cast("string")
    return table(spark, sf_dir, "pages").select("page_id", X.frame_time(F.when(F.col("page_id") % 2 == 0, F.concat(F.lit("/x/frame_"), p, F.lit(".5s.png"))).otherwise(F.concat(F.lit("/x/shot_"), p, F.lit(".png")))).alias("secs"))


@query(f"WITH {_FILES} SELECT m.path, (SELECT arg_min(s.path, (s.ext <> 'srt', s.path)) FROM g s WHERE s.stem = m.stem AND s.ext IN ('srt', 'vtt')) AS sidecar FROM (SELECT DISTINCT path, stem FROM g WHERE ext IN {_MEDIA}) m")
def a10_sidecar(spark, sf_dir):
    f = files(spark, sf_dir)
    return S.with_sidecar(f.filter(F.col("extension").isin(*S.MEDIA)).select("path").distinct(), f)


@query(f"WITH {_FILES} SELECT path, count(*) AS n FROM g WHERE NOT (path LIKE '%.md' OR path LIKE '/m/d1/%' OR regexp_matches(path, '^.*/n1[0-9]\\.(srt|vtt)$')) GROUP BY path")
def a12_excluded(spark, sf_dir):
    f = files(spark, sf_dir)
    return f.filter(~S.excluded(F.col("path"), ["*.md", "/m/d1", "**/n1[0-9].{srt,vtt}"])).groupBy("path").agg(F.count("*").alias("n"))


@query(f"WITH {_FILES} SELECT CASE WHEN ext = '' THEN 'other' ELSE ext END AS extension, count(*) AS n FROM g GROUP BY 1")
def a13_classified(spark, sf_dir):
    return S.classified(files(spark, sf_dir))


@query(f"WITH {_FILES} SELECT DISTINCT path FROM g WHERE ext IN {_MEDIA} AND stem NOT IN (SELECT stem FROM g WHERE ext IN ('srt', 'vtt')) AND page_id % 4 <> 0 AND path NOT IN (SELECT path FROM g WHERE page_id % 4 = 0)")
def a16_to_transcribe(spark, sf_dir):
    f = files(spark, sf_dir)
    done = f.select("path", F.when(F.col("page_id") % 4 == 0, "completed").otherwise("failed").alias("status"))
    return S.to_transcribe(f.filter(F.col("extension").isin(*S.MEDIA)).select("path").distinct(), f, done)


# ---- subtitles: conversations as cues, rendered and read again

_SRT_TIME = "printf('%02d:%02d:%02d,%03d', m // 3600000, m // 60000 % 60, m // 1000 % 60, m % 1000)"
_CLEAN = r"regexp_replace(regexp_replace(text, '\s+', ' ', 'g'), '^ | $', '', 'g')"
_C = f"c AS (SELECT conv_id, turn, {_CLEAN} AS x FROM conversations)"


def _tracks(spark, sf_dir) -> DataFrame:
    clean = lambda t: F.regexp_replace(F.regexp_replace(t, r"\s+", " "), "^ | $", "")
    rows = cues(spark, sf_dir)
    return rows.select(F.col("doc_id").alias("conv_id"), F.transform("cues", lambda c: F.struct(c["index"], c["start_secs"], c["end_secs"], clean(c["text"]).alias("text"))).alias("cues"))


@query(
    f"WITH {_C}, t AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn, x) AS i FROM c), u AS (SELECT *, (turn * 20000)::BIGINT AS m FROM t), "
    f"w AS (SELECT conv_id, i, i || chr(10) || {_SRT_TIME} || ' --> ' || {_SRT_TIME.replace('m ', '(m + 18000) ')} || chr(10) || x || chr(10) AS b FROM u) SELECT conv_id, string_agg(b, chr(10) ORDER BY i) AS srt FROM w GROUP BY conv_id"
)
def b5_to_srt(spark, sf_dir):
    return _tracks(spark, sf_dir).select("conv_id", SUB.to_srt(F.col("cues")).alias("srt"))


_PARSED = f"WITH {_C}, t AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn, x) - 1 AS i FROM c WHERE x <> '') SELECT conv_id, i::INT AS index, turn * 20.0::DOUBLE AS start_secs, turn * 20.0::DOUBLE + 18 AS end_secs, md5(x) AS text_md5 FROM t"


def _cue_rows(df: DataFrame) -> DataFrame:
    return df.select("conv_id", F.inline("t.cues")).select("conv_id", "index", "start_secs", "end_secs", F.md5("text").alias("text_md5"))


@query(_PARSED)
def a6_parse_srt(spark, sf_dir):
    srt = F.concat(F.lit("﻿"), F.regexp_replace(SUB.to_srt(F.col("cues")), "\n", "\r\n"), F.lit("\r\n\r\nnoise\r\n"))
    return _cue_rows(_tracks(spark, sf_dir).withColumn("t", SUB.parsed(srt)))


@query(_PARSED)
def a7_parse_vtt(spark, sf_dir):
    one = lambda c: F.concat(F.lit("id\n"), F.replace(SUB.X.srt_time(c["start_secs"]), F.lit(","), F.lit(".")), F.lit(" --> "), F.replace(SUB.X.srt_time(c["end_secs"]), F.lit(","), F.lit(".")), F.lit(" align:start\n<v A>"), c["text"], F.lit("</v>"))
    vtt = F.concat(F.lit("WEBVTT\nKind: captions\n\n"), F.array_join(F.transform("cues", one), "\n\n"))
    rows = _tracks(spark, sf_dir).withColumn("cues", F.filter("cues", lambda c: ~c["text"].rlike("[<>]|-->") | F.lit(True)))
    return _cue_rows(rows.withColumn("t", SUB.parsed(vtt)))


@query("SELECT c.conv_id, c.turn, r.k AS range_id FROM conversations c JOIN (SELECT DISTINCT conv_id, k FROM conversations, (SELECT unnest(range(0, 4)) AS k)) r USING (conv_id) WHERE c.turn * 20 + 18 > r.k * 37 AND c.turn * 20 < r.k * 37 + 45")
def m20_cue_overlap(spark, sf_dir):
    conv = table(spark, sf_dir, "conversations")
    c = conv.select(F.col("conv_id").alias("track"), "turn", (F.col("turn") * 20.0).alias("start_secs"), (F.col("turn") * 20.0 + 18).alias("end_secs"))
    r = conv.select(F.col("conv_id").alias("track")).distinct().select("track", F.explode(F.sequence(F.lit(0), F.lit(3))).alias("k"))
    r = r.select("track", F.col("k").cast("long").alias("range_id"), (F.col("k") * 37.0).alias("low"), (F.col("k") * 37.0 + 45).alias("high"))
    return SUB.cues_in_ranges(c, r).select(F.col("track").alias("conv_id"), "turn", "range_id")


@query(f"WITH {_C} SELECT conv_id, max(turn) * 20.0::DOUBLE + 18 AS duration, md5(string_agg(x, ' ' ORDER BY turn, x)) AS text_md5 FROM c GROUP BY conv_id")
def m21_track(spark, sf_dir):
    return _tracks(spark, sf_dir).select("conv_id", SUB.duration(F.col("cues")).alias("duration"), F.md5(SUB.plain_text(F.col("cues"))).alias("text_md5"))


# ---- the store

_OLD = "old AS (SELECT doc_id, CASE WHEN doc_id % 11 = 0 THEN text || '!' ELSE text END AS text FROM documents WHERE doc_id % 7 <> 0), new AS (SELECT doc_id, text FROM documents WHERE doc_id % 5 <> 0)"


def _versions(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("path"), F.coalesce("text", F.lit("")).alias("content"), F.col("doc_id").alias("i"))
    old = d.filter("i % 7 <> 0").withColumn("content", F.when(F.col("i") % 11 == 0, F.concat("content", F.lit("!"))).otherwise(F.col("content")))
    return old.select("path", "content"), d.filter("i % 5 <> 0").select("path", "content")


@query(f"WITH {_OLD} SELECT coalesce(o.doc_id, n.doc_id)::VARCHAR AS path, CASE WHEN o.doc_id IS NULL THEN 'new' WHEN n.doc_id IS NULL THEN 'deleted' WHEN sha256(o.text) = sha256(n.text) THEN 'unchanged' ELSE 'changed' END AS status FROM old o FULL JOIN new n USING (doc_id)")
def c13_fingerprint_diff(spark, sf_dir):
    old, new = _versions(spark, sf_dir)
    return ST.diff(ST.fingerprints(new), ST.fingerprints(old))


@query(f"WITH {_OLD} SELECT n.doc_id::VARCHAR AS path, o.doc_id IS NULL OR sha256(o.text) <> sha256(n.text) AS needed FROM new n LEFT JOIN old o USING (doc_id)")
def c5_needs_reindex(spark, sf_dir):
    old, new = _versions(spark, sf_dir)
    return ST.needs_reindex(ST.fingerprints(new), ST.fingerprints(old))


@query("SELECT doc_id::VARCHAR AS path, sha256(text) AS hash FROM documents")
def c12_fingerprints(spark, sf_dir):
    return ST.fingerprints(table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("path"), F.col("text").alias("content")))


@query(f"WITH {_OLD} SELECT doc_id::VARCHAR AS path, md5(text) AS content_md5 FROM new UNION ALL SELECT doc_id::VARCHAR, md5(text) FROM old WHERE doc_id NOT IN (SELECT doc_id FROM new)")
def c2_replace(spark, sf_dir):
    old, new = _versions(spark, sf_dir)
    return ST.replaced(old, new, "path").select("path", F.md5("content").alias("content_md5"))


@query(f"WITH {_OLD} SELECT doc_id::VARCHAR AS path FROM old WHERE doc_id NOT IN (SELECT doc_id FROM new)")
def c3_remove(spark, sf_dir):
    old, new = _versions(spark, sf_dir)
    return ST.without(old, new, "path").select("path")


def _rows(df: DataFrame) -> DataFrame:
    return df.select(F.col("path").alias("doc_id"), F.lit(None).cast("string").alias("title"), F.col("path").alias("source"), "content", F.lit(None).cast("string").alias("metadata"))


def _store(spark) -> ST.Store:
    import uuid

    return ST.Store(spark, f"{shared_dir(spark).rstrip('/')}/store-{uuid.uuid4().hex}", slots=8).initialise()


@query(f"WITH {_OLD}, n AS (SELECT * FROM new WHERE text <> '') SELECT count(*) AS documents, (SELECT sum(CASE WHEN length(text) <= 800 THEN 1 ELSE 1 + ceil((length(text) - 800) / 800.0) END)::BIGINT FROM n) AS chunks, count(*) AS fingerprints FROM n")
def c14_incremental(spark, sf_dir):
    """A first version indexed, then a second against it: what the store holds at the end."""
    old, new = _versions(spark, sf_dir)
    store = _store(spark)
    for version in (old, new):
        INC.index_changes(store, version.filter("content <> ''"), "fixed", size=800, overlap=0)
    return store.stats()


@query(f"WITH {_OLD} SELECT doc_id::VARCHAR AS doc_id, md5(text) AS content_md5, chunk_count FROM (SELECT doc_id, text, 1 AS chunk_count FROM old WHERE doc_id % 3 <> 0 AND text <> '')")
def c4_remove_by_source(spark, sf_dir):
    old, _ = _versions(spark, sf_dir)
    old = old.filter("content <> ''")
    store = _store(spark)
    store.insert(_rows(old), old.select(F.col("path").alias("doc_id"), F.concat("path", F.lit("#0")).alias("chunk_id"), F.lit(0).alias("position"), "content"), ST.fingerprints(old))
    store.remove_by_source(old.filter("cast(path as long) % 3 = 0").select(F.col("path").alias("source")))
    return store.documents.read().select("doc_id", F.md5("content").alias("content_md5"), F.col("chunk_count").cast("int").alias("chunk_count"))


@query("SELECT count(*) AS documents, count(*) AS chunks, 0 AS fingerprints, '2.0.0' AS schema_version FROM documents WHERE coalesce(text, '') <> ''")
def c7_stats(spark, sf_dir):
    old = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("path"), F.col("text").alias("content")).filter("content <> ''")
    store = _store(spark)
    store.insert(_rows(old), old.select(F.col("path").alias("doc_id"), F.concat("path", F.lit("#0")).alias("chunk_id"), F.lit(0).alias("position"), "content"))
    return store.stats().withColumn("schema_version", F.lit(store.get("schema_version")))


@query()
def c9_full_text(spark, sf_dir):
    return ST.full_text(ST.FullText.build(chunks(spark, sf_dir)), asked(spark, sf_dir), 10)


# ---- exports


@query(f"WITH {_FILES}, b AS (SELECT ext, count(*) AS n FROM g GROUP BY ext) SELECT '{{\"version\":\"{ST.SCHEMA_VERSION}\",\"file_count\":' || sum(n) || ',\"chunk_count\":7,\"format_counts\":{{' || string_agg('\"' || ext || '\":' || n, ',' ORDER BY ext) || '}}}}' AS manifest FROM b")
def b2_manifest(spark, sf_dir):
    return ST.manifest(files(spark, sf_dir), 7)


@query("SELECT coalesce(source, 'unknown') AS doc_id, md5(string_agg(text, chr(10) ORDER BY doc_id)) AS content_md5, count(*) AS chunk_count FROM (SELECT doc_id, CASE WHEN doc_id % 9 > 0 THEN source END AS source, coalesce(text, '') AS text FROM documents) GROUP BY 1")
def b3_by_source(spark, sf_dir):
    c = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("chunk_id"), F.when(F.col("doc_id") % 9 > 0, F.col("source")).alias("source"), F.coalesce("text", F.lit("")).alias("content"))
    return ST.by_source(c).select("doc_id", F.md5("content").alias("content_md5"), "chunk_count")


@query("SELECT conv_id, turn, '{\"rank\":' || (turn + 1) || ',\"score\":0.5,\"content\":\"c\",' || CASE WHEN turn % 2 = 0 THEN '\"title\":\"t\",' ELSE '' END || '\"source\":\"s' || conv_id || '\"' || CASE WHEN turn % 3 = 0 THEN ',\"start_secs\":' || turn || '.5,\"end_secs\":' || turn + 1 || '.5' ELSE '' END || '}' AS json FROM conversations")
def b6_results_json(spark, sf_dir):
    t = F.col("turn")
    timed = lambda x: F.when(t % 3 == 0, x + 0.5)
    rows = table(spark, sf_dir, "conversations").select(
        "conv_id", "turn", F.col("conv_id").alias("query_id"), (t + 1).alias("rank"), F.lit(0.5).alias("score"), F.lit("c").alias("content"), F.when(t % 2 == 0, "t").alias("title"),
        F.concat(F.lit("s"), F.col("conv_id").cast("string")).alias("source"), timed(t).alias("start_secs"), timed(t + 1).alias("end_secs"),
    )
    return ST.results_json(rows).select(F.col("query_id").alias("conv_id"), (F.col("rank") - 1).alias("turn"), "json")


# ---- streams


@query("SELECT event_type, epoch(time_bucket(INTERVAL '1 hour', ts))::BIGINT AS start, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def s1_tumbling(spark, sf_dir):
    return INC.windowed_counts(table(spark, sf_dir, "events")).select("event_type", F.unix_timestamp("start").alias("start"), "n", F.round("total", 4).alias("total"))


@query("SELECT user_id, count(*) AS sessions, sum(n)::BIGINT AS events FROM (SELECT user_id, s, count(*) AS n FROM (SELECT user_id, ts, sum(CASE WHEN before IS NULL OR ts - before >= INTERVAL '30 minutes' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts) AS s FROM (SELECT user_id, ts, lag(ts) OVER (PARTITION BY user_id ORDER BY ts) AS before FROM events)) GROUP BY ALL) GROUP BY user_id")
def s2_sessions(spark, sf_dir):
    return INC.sessions(table(spark, sf_dir, "events")).groupBy("user_id").agg(F.count("*").alias("sessions"), F.sum("n").alias("events"))


@query("SELECT count(*) AS documents, sum(CASE WHEN length(text) <= 800 THEN 1 ELSE 1 + ceil((length(text) - 800) / 800.0) END)::BIGINT AS chunks, count(*) AS fingerprints FROM documents WHERE text <> ''")
def s3_index_stream(spark, sf_dir):
    """The documents table as a stream of files into a store, to its end."""
    import uuid

    store = _store(spark)
    rows = spark.readStream.schema(table(spark, sf_dir, "documents").schema).parquet(f"{sf_dir}/documents.parquet*")
    rows = rows.filter("text <> ''").select(F.col("doc_id").cast("string").alias("path"), F.col("text").alias("content"))
    INC.index_stream(spark, rows, store, f"{shared_dir(spark).rstrip('/')}/stream-{uuid.uuid4().hex}", "fixed", size=800, overlap=0).awaitTermination()
    return store.stats()
