"""Parquet tables: inputs by name, intermediate results and indexes in the folder all executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable
from typing import Any

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; a local folder only where the session names none and runs on this machine alone, as in tests."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = tempfile.mkdtemp(prefix="corpusmill-")
        spark.sparkContext.setCheckpointDir(found)
    return found


def stored(df: DataFrame, name: str, *cluster: str) -> DataFrame:
    """df written once and read back; rows equal in the `cluster` columns stand together, but for large groups, which are split.

    Lineage ends there: a lost executor costs one read, and nothing is computed twice.
    """
    path = f"{shared_dir(df.sparkSession).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    if cluster:
        df = df.hint("rebalance", *cluster).sortWithinPartitions(*cluster)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


_saved: dict[tuple[str, str], str] = {}


def exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def saved_once(spark: SparkSession, name: str, save: Callable[[str], Any], load: Callable[[str], Any]) -> Any:
    """What `load` reads from the folder that `save` filled for this name, once in an application."""
    key = (spark.sparkContext.applicationId, name)
    if key not in _saved or not exists(spark, _saved[key]):
        path = f"{shared_dir(spark).rstrip('/')}/saved-{uuid.uuid4().hex}"
        save(path)
        _saved[key] = path
    return load(_saved[key])
