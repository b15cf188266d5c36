import importlib
import subprocess
import sys
from pathlib import Path

REPO = Path(__file__).resolve().parents[1]


def test_queries_and_oracles_fit():
    entry = importlib.import_module("__spark_entry__")
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry_runs(spark):
    assert importlib.import_module("__spark_entry__").entry(spark).count() > 0


def test_works_without_the_training_data_operators(tmp_path):
    """A copy without those folders still imports and lists the other queries."""
    import shutil

    copy = tmp_path / "copy"
    shutil.copytree(REPO, copy, ignore=shutil.ignore_patterns(".git", "llm", "corpus_pipeline.py", "__pycache__", "spark-warehouse"))
    code = "import __spark_entry__ as e; q = e.queries(); assert 'pa_fit' in q and 'pipeline' not in q and not any(n.startswith('op') for n in q)"
    subprocess.run([sys.executable, "-c", code], cwd=copy, check=True, timeout=120)
    # the other tests can be collected there, and those without tables pass
    run = lambda *args: subprocess.run([sys.executable, "-m", "pytest", "-q", "-p", "no:cacheprovider", *args], cwd=copy, check=True, timeout=300)
    run("tests", "--collect-only")
    run("tests/test_star.py", "tests/test_entry.py::test_queries_and_oracles_fit")
