import pytest
from parity import same

from querylens.plans import catalog

QUERIES, SQL = catalog.queries(), catalog.oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, sf_dir, name):
    same(spark, sf_dir, QUERIES[name], SQL[name])


@pytest.mark.parametrize("name", ["all_lexical_features", "wide_features", "drift_report", "platt", "isotonic"])
def test_query_gives_rows(spark, sf_dir, name):
    assert QUERIES[name](spark, sf_dir).count() > 0


def test_entry_points_import():
    import __spark_entry__

    assert set(SQL) <= set(__spark_entry__.oracle_sql()) and set(QUERIES) <= set(__spark_entry__.queries())


def test_entry_points_without_the_llm_folders(tmp_path):
    """The package without ``llm``, with corpus_pipeline.py or not, still gives all other queries."""
    import shutil
    import subprocess
    import sys
    from pathlib import Path

    top = Path(__file__).resolve().parent.parent
    shutil.copytree(top / "querylens", tmp_path / "querylens", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    for name in ("__spark_entry__.py", "corpus_pipeline.py"):
        if (top / name).exists():
            shutil.copy(top / name, tmp_path / name)
    code = "import __spark_entry__ as e; print(*sorted(e.queries())); print(*sorted(e.oracle_sql()))"
    for _ in range(2):
        said = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": str(tmp_path)}, capture_output=True, text=True, check=True).stdout.split("\n")
        assert (said[0].split(), said[1].split()) == (sorted(QUERIES), sorted(SQL))
        (tmp_path / "corpus_pipeline.py").unlink(missing_ok=True)
