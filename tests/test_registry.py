"""Every registered query with SQL gives what DuckDB gives; the entry imports without the llm folders too."""

import subprocess
import sys
import tempfile
from pathlib import Path

import pytest

import __spark_entry__ as entry
from tests.oracle import SMALL, same

ROOT = Path(entry.__file__).resolve().parent


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_query_equals_its_sql(spark, name):
    same(entry.queries()[name](spark, SMALL), entry.oracle_sql()[name], SMALL)


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry(spark):
    assert entry.entry(spark).count() > 0


@pytest.mark.parametrize("files", [("mentionforge", "__spark_entry__.py", "corpus_pipeline.py", "tests"), ("mentionforge", "__spark_entry__.py", "tests")])
def test_entry_without_the_llm_folders(files):
    """The rest loads, and its tests are collected, where both llm folders are gone, with corpus_pipeline.py there or not."""
    with tempfile.TemporaryDirectory() as d:
        for p in files:
            subprocess.run(["cp", "-r", ROOT / p, d], check=True)
        for p in ("mentionforge/llm", "tests/llm"):
            subprocess.run(["rm", "-rf", f"{d}/{p}"], check=True)
        env = {"PATH": "/usr/bin:/bin", "PYTHONPATH": d, "PYTHONDONTWRITEBYTECODE": "1"}
        code = "import __spark_entry__ as e; q = e.queries(); assert q and set(e.oracle_sql()) <= set(q); assert not any(k.startswith('op1_') or k == 'pipeline' for k in q)"
        subprocess.run([sys.executable, "-c", code], cwd=d, check=True, env=env)
        subprocess.run([sys.executable, "-m", "pytest", "--collect-only", "-q", "-p", "no:cacheprovider", "tests"], cwd=d, check=True, env=env, stdout=subprocess.DEVNULL)
