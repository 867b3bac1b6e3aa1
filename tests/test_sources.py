import sys

import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from corpusmill.operators import store as ST
from corpusmill.plans import cli
from corpusmill.sources import files as S
from corpusmill.sources import subtitles as SUB
from corpusmill.streaming import incremental as INC

SRT = "1\r\n00:00:01,000 --> 00:00:02,500\r\nHello\r\nthere\r\n\r\nnoise\r\n\r\n2\r\n00:00:03,000 --> 00:00:04,000\r\n\r\n\r\n3\r\n00:01:00,000 --> 00:01:02,000\r\nBye\r\n"
VTT = "WEBVTT\nnote\n\nid\n00:01.000 --> 00:02.000 align:left\n<b>Hi</b> a > b <i\n\n00:00:05.000 --> 00:00:06.000\nyo"


def parse(spark, *texts):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    return [r.p for r in rows.select("i", SUB.parsed(F.col("t")).alias("p")).orderBy("i").collect()]


def test_parsing(spark):
    srt, vtt, none, bad, empty, null, bom = parse(spark, SRT, VTT, "no cue here", SRT.replace("00:01:00,000", "xx"), "", None, "﻿" + SRT)
    assert [(c["index"], c.start_secs, c.end_secs, c.text) for c in srt.cues] == [(0, 1.0, 2.5, "Hello\nthere"), (1, 60.0, 62.0, "Bye")] and srt.format == "srt"
    assert [(c.start_secs, c.text) for c in vtt.cues] == [(1.0, "Hi a  b"), (5.0, "yo")] and vtt.format == "vtt"
    assert none is None and bad is None and empty is None and null is None and bom == srt


def test_loaders_and_discovery(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    for name, text in {"a.txt": "Alpha text", "b.md": "# Beta", "sub/c.srt": SRT, "sub/d.vtt": "WEBVTT", "e.mp4": "x", "e.srt": SRT, "e.vtt": VTT, "f.mp3": "x", "g.bin": "x", "skip.txt": "no"}.items():
        (tmp_path / name).write_text(text)
    files = S.discover(spark, str(tmp_path), exclude=["**/skip.*"])
    assert [r.path.rsplit("/", 1)[1] for r in files.collect()] == ["a.txt", "b.md", "e.mp4", "e.srt", "e.vtt", "f.mp3", "g.bin", "c.srt", "d.vtt"]
    assert S.discover(spark, str(tmp_path), recursive=False).count() == 8
    docs = {r.title: r for r in S.Loaders().load(spark, str(tmp_path), exclude=["**/skip.*"]).collect() if not r.source.endswith("e.vtt")}
    assert docs["a"].content == "Alpha text" and docs["c"].content == "Hello\nthere Bye" and docs["c"].duration_secs == 62.0 and docs["d"].error
    media = files.filter(F.col("extension").isin(*S.MEDIA)).select("path")
    side = {r.path.rsplit("/", 1)[1]: r.sidecar for r in S.with_sidecar(media, files).collect()}
    assert side["e.mp4"].endswith("e.srt") and side["f.mp3"] is None
    todo = S.to_transcribe(media, files, spark.createDataFrame([], "path string, status string"))
    assert [r.path.rsplit("/", 1)[1] for r in todo.collect()] == ["f.mp3"]

    def hear(raw):
        if raw == b"x":
            return {"cues": [{"index": 0, "start_secs": 0.0, "end_secs": 1.5, "text": "heard"}], "language": "en"}
        raise OSError("unreadable")

    got = S.load_media(spark, [str(tmp_path / "f.mp3"), str(tmp_path / "a.txt")], hear).orderBy("source").collect()
    assert got[0].error == "OSError: unreadable" and got[1].content == "heard" and got[1].language == "en"
    assert S.load_images(spark, [str(tmp_path / "g.bin")], lambda raw: " seen ").first().content == "seen"
    assert {r.extension: r.n for r in S.classified(files).collect()}["srt"] == 2
    with pytest.raises(ValueError):
        S.glob_regex("a[b")


def test_globs(spark):
    rows = spark.createDataFrame([("/a/b/c.txt",), ("/a/x.md",), ("x.md",)], "p string")
    hit = lambda *g: [r.p for r in rows.filter(S.excluded(F.col("p"), list(g))).collect()]
    assert hit("**/*.md") == ["/a/x.md", "x.md"] and hit("/a/b") == ["/a/b/c.txt"] and hit("*.{txt,rs}") == ["/a/b/c.txt"] and hit("/a/[!y].md") == ["/a/x.md"] and hit("?.md") == ["x.md"]


def test_incremental_and_stream(spark, tmp_path):
    store = ST.Store(spark, str(tmp_path / "s"), slots=2).initialise()
    one = spark.createDataFrame([("a", "first text"), ("b", "second text")], "path string, content string")
    two = spark.createDataFrame([("b", "second text, changed"), ("c", "third")], "path string, content string")
    assert {r.status: r.n for r in INC.index_changes(store, one, "fixed", size=100, overlap=0).collect()} == {"new": 2}
    assert {r.status: r.n for r in INC.index_changes(store, two, "fixed", size=100, overlap=0).collect()} == {"new": 1, "changed": 1, "deleted": 1}
    assert {r.doc_id: r.content for r in store.chunks.read().collect()} == {"b": "second text, changed", "c": "third"}
    source = str(tmp_path / "in")
    spark.createDataFrame([("c", "third, streamed", 2), ("c", "old", 1), ("d", "fourth", 1)], "path string, content string, seq int").coalesce(1).write.parquet(source)
    stream = spark.readStream.schema("path string, content string, seq int").parquet(source)
    for _ in range(2):  # the second run finds nothing new
        INC.index_stream(spark, stream, store, str(tmp_path / "cp"), "fixed", size=100, overlap=0).awaitTermination()
    assert {r.doc_id: r.content for r in store.documents.read().collect()} == {"b": "second text, changed", "c": "third, streamed", "d": "fourth"}


def test_streamed_windows(spark, tmp_path):
    rows = spark.createDataFrame([("2024-01-01 00:10:00", "x", 1.0), ("2024-01-01 00:50:00", "x", 2.0), ("2024-01-01 01:10:00", "y", 3.0), ("2024-01-03 00:00:00", "z", 1.0)], "ts string, event_type string, value double")
    rows.withColumn("ts", F.col("ts").cast("timestamp")).coalesce(1).write.parquet(str(tmp_path / "e"))
    stream = spark.readStream.schema("ts timestamp, event_type string, value double").parquet(str(tmp_path / "e"))
    q = INC.windowed_counts(stream).writeStream.format("memory").queryName("windows").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted((r.event_type, r.n) for r in spark.table("windows").collect()) == [("x", 2), ("y", 1)]
    batch = spark.read.parquet(str(tmp_path / "e"))
    assert INC.windowed_counts(batch, "1 hour", "30 minutes").agg(F.sum("n")).first()[0] == 8


def test_cli(spark, tmp_path, capsys):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text("Ownership gives memory safety. " * 5)
    (tmp_path / "in" / "b.txt").write_text("Soup is best when hot. " * 5)
    out = str(tmp_path / "ix")
    assert cli.main(["index", str(tmp_path / "in"), "--output", out, "--chunk-size", "80", "--chunk-overlap", "0", "--dedup"], spark) == 0
    assert cli.main(["query", "memory safety", "--index", out, "--mode", "sparse", "--top-k", "1", "--format", "json"], spark) == 0
    assert "memory safety" in capsys.readouterr().out
    assert cli.main(["query", "hot soup", "--index", out, "--rerank", "--hyde"], spark) == 0
    assert cli.main(["info", out], spark) == 0
    assert cli.main(["demo"], spark) == 0
    (tmp_path / "r.jsonl").write_text('{"query":"q","domain":"d","course":"c","latency_s":0.5,"results":[{"content":"a","score":1.0},{"content":"b","score":0.5}]}\n')
    (tmp_path / "j.jsonl").write_text('{"query":"q","rank":2,"relevant":true,"reasoning":""}\n')
    assert cli.main(["eval", "metrics", "--results", str(tmp_path / "r.jsonl"), "--judgments", str(tmp_path / "j.jsonl"), "--output", str(tmp_path / "m")], spark) == 0
    assert "MRR=0.5000" in capsys.readouterr().out
    assert cli.main(["eval", "gate", str(tmp_path / "m"), "--min-mrr", "0.6"], spark) == 1
    assert cli.main(["eval", "gate", str(tmp_path / "m"), "--min-mrr", "0.4"], spark) == 0
    assert cli.main(["eval", "compare", str(tmp_path / "m"), str(tmp_path / "m")], spark) == 0


def ask(content):
    return "what is it" if "safety" in content else "SKIP"


def judge(query, content):
    return '{"relevant": true, "reasoning": "says so"}' if "safety" in content else "not relevant"


def frames(raw):
    if raw == b"bad":
        raise ValueError("no video")
    return ["f1.png"] * len(raw)


def test_cli_evaluation(spark, tmp_path, capsys):
    cloudpickle.register_pickle_by_value(sys.modules[__name__])  # executors cannot import a test
    (tmp_path / "in").mkdir()
    words = " ".join(f"word{i}" for i in range(60))
    for name in "abc":
        (tmp_path / "in" / f"{name}.txt").write_text(f"Ownership gives memory safety {name}. {words}")
    (tmp_path / "in" / "d.txt").write_text(f"Soup is best when hot. {words} soup")
    out, at = str(tmp_path / "ix"), lambda x: str(tmp_path / x)
    for embedder in ("tfidf", "hash"):
        assert cli.main(["index", at("in"), "--output", out, "--embedder", embedder, "--dimension", "32", "--compression", "lz4"], spark) == 0
        assert cli.main(["query", "memory safety", "--index", out, "--mode", "dense"], spark) == 0
    assert cli.main(["eval", "generate", "--index", out, "--output", at("gt"), "--model", f"{__name__}:ask"], spark) == 0
    made = spark.read.json(at("gt")).collect()
    assert made and {r["query"] for r in made} == {"what is it?"}
    (tmp_path / "q.jsonl").write_text('{"query":"memory safety","domain":"d","course":"c"}\n{"query":"zzz","domain":"d","course":"c"}\n')
    assert cli.main(["eval", "retrieve", "--index", out, "--queries", at("q.jsonl"), "--output", at("res"), "--top-k", "3", "--mode", "sparse"], spark) == 0
    found = {r["query"]: r.results for r in spark.read.schema(cli.RESULT).json(at("res")).collect()}
    assert len(found["memory safety"]) == 3 and found["zzz"] == [] and "safety" in found["memory safety"][0].content
    for _ in range(2):
        assert cli.main(["eval", "judge", "--results", at("res"), "--output", at("jud"), "--model", f"{__name__}:judge", "--cache", at("cache")], spark) == 0
    judged = spark.read.schema(cli.JUDGMENT).json(at("jud")).collect()
    assert {(r["query"], r["rank"], r.relevant) for r in judged} == {("memory safety", n, True) for n in (1, 2, 3)}
    assert spark.read.json(at("cache")).count() == 3
    assert cli.main(["eval", "metrics", "--results", at("res"), "--judgments", at("jud")], spark) == 0
    capsys.readouterr()
    for name, body in (("v.mp4", b"xx"), ("w.mkv", b"bad"), ("old.mov", b"x")):
        (tmp_path / "in" / name).write_bytes(body)
    (tmp_path / "in" / "old-frames").mkdir()
    (tmp_path / "in" / "old-frames" / "frame_1.png").write_bytes(b"png")
    assert cli.main(["extract-frames", at("in"), "--extractor", f"{__name__}:frames", "--skip-existing"], spark) == 0
    shown = capsys.readouterr().out
    assert "v.mp4: 2 frames" in shown and "w.mkv: ValueError" in shown and "old.mov" not in shown
    assert cli.main(["extract-frames", at("in"), "--extractor", f"{__name__}:frames", "--dry-run"], spark) == 0
    assert "old.mov" in capsys.readouterr().out
