import glob
import time

from corpusmill.llm import common, substrings


def shuffled(spark):
    dirs = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()
    return {p for d in dirs for p in glob.glob(f"{d}/**/shuffle_*.data", recursive=True)}


def test_finished_steps_leave_no_shuffle_files(spark, monkeypatch):
    """They used to stay until the driver happened to collect its garbage: 2.33 GB on 0.51 GB by the check."""
    monkeypatch.setattr(common.gc, "collect", lambda *a: 0)
    monkeypatch.setattr(substrings, "settle", lambda s: None, raising=False)
    line = " ".join(f"w{i}" for i in range(40))
    df = spark.createDataFrame([(i, f"a{i} b{i} {line} c{i}") for i in range(200)], "doc_id long, text string").repartition(4)
    df = common.written(df, "disk-test")
    made = []
    write = substrings.written

    def seen(out, name, **kind):
        before = shuffled(spark)
        out = write(out, name, **kind)
        until = time.time() + 10  # files are deleted in the background
        while (left := shuffled(spark) - before) and time.time() < until:
            time.sleep(0.2)
        made.append((name, left))
        return out

    monkeypatch.setattr(substrings, "written", seen)
    assert substrings.places(df).agg({"id": "max"}).first()[0] == 199
    assert made == [("substring-candidates", set()), ("substring-places", set())]
