"""Helpers shared by the operators: word splitting, ASCII lower-casing, shared-folder tables."""

from __future__ import annotations

import gc
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SPACE = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share. One of this machine is set only where the session names none and runs on it alone, as in tests."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = tempfile.mkdtemp(prefix="corpusmill-")
        spark.sparkContext.setCheckpointDir(found)
    return found


_scopes: list[list[str]] = []


@contextmanager
def intermediates(spark: SparkSession) -> Iterator[None]:
    """Tables that `written` makes inside are deleted at the end, but for those kept: write what is needed before."""
    _scopes.append([])
    try:
        yield
    finally:
        for path in _scopes.pop():
            p = spark._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


RELEASE = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def written(df: DataFrame, name: str, keep: bool = False, release: bool = False) -> DataFrame:
    """df as a Parquet table in the shared folder: lineage ends there, so a lost executor costs one read. With `release`,
    Spark deletes the shuffle files when the table is there, without waiting for the driver to collect garbage."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(RELEASE, "false")
    spark.conf.set(RELEASE, str(release or before == "true").lower())
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(RELEASE, before)
    if _scopes and not keep:
        _scopes[-1].append(path)
    return spark.read.schema(df.schema).parquet(path)


def settle(spark: SparkSession) -> None:
    """Between steps of one operator: collects garbage on the driver, whereupon Spark deletes the shuffle files of the steps
    that are done with."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def free(df: DataFrame, *names: str) -> list[str]:
    """The names, with underscores in front where df already has such a column."""
    have, out = {x.lower() for x in df.columns}, []
    for name in names:
        while name.lower() in have:
            name = "_" + name
        have.add(name.lower())
        out.append(name)
    return out


def named(column: str) -> Column:
    """The column of exactly this name, whatever characters are in it."""
    return F.col("`" + column.replace("`", "``") + "`")


def columns_of(df: DataFrame, text: Column | None = None) -> list[Column]:
    """df's columns by name; with `text`, that in place of the column text."""
    return [text.alias(c) if text is not None and c.lower() == "text" else named(c) for c in df.columns]


def ascii_lower(c: Column) -> Column:
    """A-Z to a-z and nothing else. lower() does the same, and faster, where no other letter would change."""
    rest = F.regexp_replace(c, r"[\x00-\x7F]+", "")
    return F.when(F.lower(rest) == rest, F.lower(c)).otherwise(F.translate(c, UPPER, LOWER))


def words(c: Column) -> Column:
    """Runs of anything but ASCII white space; null has none."""
    return F.filter(F.split(F.coalesce(c, F.lit("")), SPACE), lambda w: w != "")


def n_words(c: Column) -> Column:
    """size(words(c)) without the filter: split leaves an empty piece only at either end."""
    parts = F.split(c, SPACE)
    ends = lambda at: (F.element_at(parts, at) == "").cast("long")
    n = F.size(parts).cast("long") - ends(1) - ends(-1)
    return F.when(c.isNull() | (c == ""), F.lit(0).cast("long")).otherwise(n)


def const_array(values: list[int], kind: str = "bigint") -> Column:
    """A literal array. Spark parses the text once, while planning."""
    return F.from_json(F.lit("[" + ",".join(map(str, values)) + "]"), f"array<{kind}>")
