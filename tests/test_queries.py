"""Every registered query of the library against its SQL, on the smallest tables."""

import pytest
from conftest import same

from corpusmill.plans import registry

SF = "/root/testdata/sf0.001"
#: Against plain Python, row by row: test_rows.py.
ROWS_ONLY = {"d2_recursive", "d5_structural", "d6_semantic", "d7_timestamp", "d9_auto", "m2_grouped", "m22_pipeline", "c9_full_text", "j14_trained_search"}


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, name):
    df = registry.QUERIES[name](spark, SF)
    if name in ROWS_ONLY:
        assert name not in registry.SQL
        assert df.count() > 0
    else:
        missing, extra, n = same(df, registry.SQL[name], SF)
        assert not missing and not extra and n > 0


def test_entry(spark):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert e.entry(spark).columns == ["query_id", "chunk_id", "rank", "score", "dense_score", "sparse_score"]


def test_imports_without_session_or_llm(tmp_path):
    import os
    import shutil
    import subprocess
    import sys

    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    shutil.copytree(os.path.join(root, "corpusmill"), tmp_path / "corpusmill", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(os.path.join(root, "__spark_entry__.py"), tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert len(q) > 80 and not [n for n in q if n.startswith('op') or n == 'pipeline']; e.oracle_sql()"
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    assert subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True).returncode == 0
