import contextlib
import io

from corpusmill.llm import simhash


def plan(df):
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        df.explain()
    return out.getvalue()


def test_nothing_that_grows_is_broadcast(spark, monkeypatch):
    """Whatever Spark takes a table's size for, the driver builds none of the tables of the links, groups and results."""
    made, written = [], simhash.written
    monkeypatch.setattr(simhash, "written", lambda df, name, *a, **k: (made.append(plan(df)), written(df, name, *a, **k))[1])
    docs = spark.createDataFrame([(i, f"text of {i % 7} some words and {i % 3} others") for i in range(40)], "doc_id long, text string")
    made.append(plan(simhash.report(docs)))
    made.append(plan(simhash.keep_one(docs)))
    assert len(made) > 8 and any("SortMergeJoin" in p for p in made)
    assert not any("Broadcast" in p for p in made)
