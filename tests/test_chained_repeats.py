"""l8_chained on a query whose first keywords repeat (F3 of FINDINGS_r03)."""

import os

from conftest import TABLES, same

from corpusmill.plans import registry

SF = "/root/testdata/sf0.001"


def test_repeated_keywords(spark, tmp_path):
    for t in TABLES:
        if t != "conversations":
            os.symlink(f"{SF}/{t}.parquet", tmp_path / f"{t}.parquet")
    rows = [(3, 3, "user", "Que que ciones tion"), (4, 3, "user", "tell"), (5, 3, "user", "tell tell"), (6, 0, "user", "")]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").coalesce(1).toPandas().to_parquet(tmp_path / "conversations.parquet")
    missing, extra, n = same(registry.QUERIES["l8_chained"](spark, str(tmp_path)), registry.SQL["l8_chained"], str(tmp_path))
    assert not missing and not extra and n == 4
