import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from corpusmill.operators import chunk as C
from corpusmill.operators.embed import MockEmbedder


def texts(rows):
    return [r["content"] for r in rows]


def test_recursive_quirks():
    # a large part behind a waiting one stays whole unless strict; the last resort overlaps by itself and again
    text = "tiny\n" + "x" * 100 + "\nend of it"
    assert [len(t) for t in texts(C.recursive_chunks(text, 20, 0))] == [4, 100, 9]
    assert max(len(t) for t in texts(C.recursive_chunks(text, 20, 0, strict=True))) <= 20
    assert texts(C.recursive_chunks("abcdefghij", 5, 2)) == ["abcde", "dedefgh", "ghghij"]


def test_recursive_rejoins_and_places():
    text = "one two. three four. five six seven eight nine"
    got = C.recursive_chunks(text, 20, 0)
    assert texts(got) == ["one two. three four", "five six seven eight", "nine"]
    for c in got:
        assert text[c["start_offset"] : c["end_offset"]] == c["content"]


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="aé \n.ß漢", min_size=1, max_size=300), st.integers(2, 40))
def test_recursive_is_whole_and_bounded(text, size):
    got = C.recursive_chunks(text, size, 0, strict=True)
    bare = lambda s: "".join(ch for ch in s if ch not in " \n.")
    assert bare("".join(texts(got))) == bare(text)
    assert all(len(t) <= size for t in texts(got))


def test_recursive_rejects_overlap():
    with pytest.raises(ValueError):
        C.recursive(None, 10, 10)
    with pytest.raises(ValueError):
        C.by_paragraph(None, 0)


def cue(i, start, end):
    return {"index": i, "start_secs": start, "end_secs": end, "text": f"c{i}"}


def test_time_chunks():
    cues = [cue(i, i * 10.0, i * 10.0 + 9) for i in range(8)]
    got = C.time_chunks(cues, 30, 10, 10)
    assert [g["content"] for g in got][0] == "c0 c1 c2"
    assert all(g["cue_count"] >= 1 for g in got)
    assert {w for g in got for w in g["content"].split()} == {f"c{i}" for i in range(8)}
    # a short tail joins the chunk before, whose cue count stays
    tail = C.time_chunks([cue(0, 0.0, 30.0), cue(1, 30.0, 61.0), cue(2, 61.0, 62.0)], 60, 10, 0)
    assert [g["content"] for g in tail] == ["c0", "c1 c2"] or tail[-1]["content"].endswith("c2")


def test_time_chunks_cover_random_cues():
    rnd = random.Random(3)
    for _ in range(30):
        t, cues = 0.0, []
        for i in range(rnd.randint(1, 20)):
            end = t + rnd.uniform(0.5, 20)
            cues.append(cue(i, t, end))
            t = end + rnd.uniform(0, 5)
        got = C.time_chunks(cues, rnd.choice([15, 60]), 10, rnd.choice([0, 5]))
        assert {w for g in got for w in g["content"].split()} == {c["text"] for c in cues}


def test_defined_cases(spark):
    rows = [(1, None), (2, ""), (3, "One. Two! Three? Four.No"), (4, "\n\n \n\n"), (5, "héé " * 300)]
    docs = spark.createDataFrame(rows, "doc_id long, content string")
    assert C.skipped(docs).first().skipped == 2
    for name in ("fixed", "recursive", "sentence", "paragraph", "structural"):
        got = C.chunk(docs, name).collect()
        assert {r.doc_id for r in got} <= {3, 4, 5} and {3, 5} <= {r.doc_id for r in got}, name
        assert len({r.chunk_id for r in got}) == len(got)
    assert C.chunk(docs.limit(0), "recursive").count() == 0
    s = C.by_sentence(docs.filter("doc_id = 3"), 1, 0).orderBy("position").collect()
    assert [r.content for r in s] == ["One.", "Two!", "Three?", "Four.", "No"]
    with pytest.raises(ValueError):
        C.chunk(docs, "other")


def test_semantic(spark):
    class Two:
        dimension = 2

        def embed_batch(self, t):
            return [[1.0, 0.0] if "a" in x else [0.0, 1.0] for x in t]

    docs = spark.createDataFrame([(1, "a one. a two. b three. b four. a five.")], "doc_id long, content string")
    assert [r.content for r in C.semantic(docs, Two(), 0.5, 100).orderBy("position").collect()] == ["a one. a two.", "b three. b four.", "a five."]
    assert C.semantic(docs, MockEmbedder(8), -1.0, 12).count() >= 3


def test_structural_sections(spark):
    text = "intro\n# One\nbody\n## \nstill one\n  ### Two ##\n" + "word " * 60
    rows = C.structural(spark.createDataFrame([(1, text)], "doc_id long, content string"), most=100).orderBy("position").collect()
    assert [r.headers for r in rows][:2] == [[], ["One"]]
    assert rows[2].headers == ["Two ##"] and rows[1].content == "# One\nbody\n## \nstill one"
    assert len(rows) > 3
