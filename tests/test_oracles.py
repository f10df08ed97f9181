"""Every query with SQL gives what DuckDB gives, here on the smallest tables; those without SQL give rows with their columns."""

import pytest
from compare import difference

from sparkfold import plans

QUERIES, ORACLES = plans.queries(), plans.oracle_sql()


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_against_oracle(spark, sf_dir, name):
    assert difference(spark, sf_dir, name, QUERIES[name], ORACLES[name]) == ""


def test_every_query_has_an_oracle():
    assert set(QUERIES) == set(ORACLES)


def test_entry_without_the_training_data_package(tmp_path):
    """The driver contract holds in a copy that lacks the llm folders and the pipeline."""
    import shutil
    import subprocess
    import sys
    from pathlib import Path

    root = Path(__file__).resolve().parent.parent
    shutil.copytree(root / "sparkfold", tmp_path / "sparkfold", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(root / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q, o = e.queries(), e.oracle_sql(); assert 'doc_entropy' in q and 'pipeline' not in q and set(o) <= set(q); print(len(q))"
    done = subprocess.run([sys.executable, "-B", "-c", code], cwd=tmp_path, capture_output=True, text=True)
    assert done.returncode == 0 and int(done.stdout.split()[-1]) == len(QUERIES), done.stderr
