"""Every registered query of the reference operators against its SQL."""

from __future__ import annotations

import pytest
from compare import differences, duck

from quillspark.plans import catalog

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query_equals_sql(spark, con, name):
    assert differences(catalog.queries()[name](spark, SF), con, catalog.oracle_sql()[name]) == []


def test_entry_imports_without_the_llm_folders():
    """The entry module works where the subpackage and its pipeline aren't there."""
    import subprocess
    import sys
    import tempfile
    from pathlib import Path
    from shutil import copytree, ignore_patterns

    root = Path(__file__).parent.parent
    with tempfile.TemporaryDirectory() as d:
        copytree(root, f"{d}/r", ignore=ignore_patterns("llm", "corpus_pipeline.py", ".git", "__pycache__"))
        code = "import __spark_entry__ as e; q = e.queries(); assert 'hybrid_rrf_topk' in q and not any(n.startswith('op') for n in q) and set(e.oracle_sql()) <= set(q)"
        subprocess.run([sys.executable, "-c", code], cwd=f"{d}/r", check=True, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": ""})


def test_entry(spark):
    import __spark_entry__

    df = __spark_entry__.entry(spark)
    assert df.columns == ["question_id", "id", "sources", "score", "rank"] and df.count() > 0
