"""Every query of the library against its SQL, and the driver's contract."""

import os
import shutil
import subprocess
import sys
from collections import Counter
from pathlib import Path

import duckdb
import pytest

import turnstone.plans.more_queries  # noqa: F401
import turnstone.plans.parser_queries  # noqa: F401
from turnstone.plans.queries import ORACLES, QUERIES

DATA = "/root/testdata/sf0.001"
ROOT = Path(__file__).resolve().parents[1]


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for path in Path(DATA).glob("*.parquet"):
        c.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    return c


def plain(row):
    return tuple(repr(float(x)) if isinstance(x, (int, float)) and not isinstance(x, bool) else str(x)[:10] if hasattr(x, "year") else x for x in row)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, con, name):
    got = QUERIES[name](spark, DATA)
    want = con.execute(ORACLES[name])
    names = [d[0] for d in want.description]
    assert sorted(names) == sorted(got.columns)
    assert Counter(map(plain, got.select(names).collect())) == Counter(map(plain, want.fetchall()))


def test_entry_and_queries(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0 and set(e.oracle_sql()) <= set(e.queries())


@pytest.mark.parametrize("gone", [("turnstone/llm", "tests/llm"), ("turnstone/llm", "tests/llm", "corpus_pipeline.py"), ("corpus_pipeline.py",)])
def test_library_stands_without_the_training_operators(tmp_path, gone):
    """The driver's functions and every module import from a copy that lacks the folders, the pipeline, or both."""
    shutil.copytree(ROOT, tmp_path / "repo", ignore=shutil.ignore_patterns(".git", "__pycache__", ".pytest_cache"))
    for name in gone:
        path = tmp_path / "repo" / name
        shutil.rmtree(path) if path.is_dir() else path.unlink(missing_ok=True)
    code = "import __spark_entry__ as e, turnstone.cli, turnstone.plans.engine, turnstone.render.html; q, o = e.queries(), e.oracle_sql(); assert set(o) <= set(q); print(len(q), sum(k.startswith('op') or k == 'pipeline' for k in q))"
    run = subprocess.run([sys.executable, "-c", code], cwd=tmp_path / "repo", capture_output=True, text=True, env=os.environ | {"PYTHONPATH": ""})
    assert run.returncode == 0, run.stderr
    n, training = map(int, run.stdout.split())
    assert n >= len(QUERIES) and training == (10 if (ROOT / "turnstone/llm").exists() and gone == ("corpus_pipeline.py",) else 0)


def test_nothing_else_imports_the_training_operators():
    for path in (ROOT / "turnstone").rglob("*.py"):
        if "llm" not in path.parts:
            assert "turnstone.llm" not in path.read_text()
