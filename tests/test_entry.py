"""The entry points with and without the training-data part."""

import os
import shutil
import subprocess
import sys

import __spark_entry__
from cardloom.plans.registry import ORACLES, QUERIES

HERE = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_all_queries_are_named_alike():
    assert QUERIES.keys() <= __spark_entry__.queries().keys()
    assert __spark_entry__.oracle_sql().keys() <= __spark_entry__.queries().keys()


def test_the_rest_works_without_the_training_data_part(tmp_path):
    """In a copy: the subpackage and its tests deleted, with the pipeline and without it."""
    copy = tmp_path / "copy"
    shutil.copytree(HERE, copy, ignore=shutil.ignore_patterns(".git", "llm", "__pycache__", ".pytest_cache"))
    tell = "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()))"
    for there in (True, False):
        if not there:
            (copy / "corpus_pipeline.py").unlink(missing_ok=True)
        run = subprocess.run([sys.executable, "-c", tell], cwd=copy, capture_output=True, text=True, env=os.environ | {"PYTHONPATH": ""}, timeout=120)
        assert run.returncode == 0, run.stderr
        assert run.stdout.split() == [str(len(QUERIES)), str(len(ORACLES))]
