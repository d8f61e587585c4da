import importlib.util
import os
import shutil
import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry

ROOT = Path(__file__).resolve().parent.parent
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SF = "/root/testdata/sf0.001"


def plain(v):
    if isinstance(v, float):
        return repr(round(v, 5) + 0.0)
    return repr(list(map(plain, v))) if isinstance(v, (list, tuple)) else repr(v)


def test_flagship(spark):
    assert entry.entry(spark).count() == 12


@pytest.mark.parametrize("name", sorted(n for n in entry.oracle_sql() if not n.startswith("op") and n != "pipeline"))
def test_oracle(spark, name):
    db = duckdb.connect()
    for t in TABLES:
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    df = entry.queries()[name](spark, SF)
    cols = sorted(df.columns)
    found = db.execute(entry.oracle_sql()[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == cols
    want = sorted(tuple(plain(r[names.index(c)]) for c in cols) for r in found.fetchall())
    assert sorted(tuple(plain(r[c]) for c in cols) for r in df.collect()) == want


def test_rows_only_queries(spark):
    for name in sorted(set(entry.queries()) - set(entry.oracle_sql())):
        if not name.startswith("op") and name != "pipeline":
            assert entry.queries()[name](spark, SF).count() > 0


def test_works_without_the_llm_folders(tmp_path):
    """In a copy without the folders (or with nothing but compiled files in them) all other queries are there."""
    copy = tmp_path / "copy"
    shutil.copytree(ROOT, copy, ignore=shutil.ignore_patterns(".git", "__pycache__", "llm", "corpus_pipeline.py"))
    code = "import __spark_entry__ as e; q = e.queries(); assert not any(n.startswith('op') or n == 'pipeline' for n in q) and len(q) > 80; import glyphmeter; assert glyphmeter.__file__.startswith({!r})".format(str(copy))
    run = lambda code: subprocess.run([sys.executable, "-c", code], cwd=copy, capture_output=True, text=True, env=os.environ | {"PYTHONPATH": ""})
    assert run(code).returncode == 0
    found = subprocess.run([sys.executable, "-m", "pytest", "--collect-only", "-q", "tests"], cwd=copy, capture_output=True, text=True, env=os.environ | {"PYTHONPATH": ""})
    assert found.returncode == 0, found.stdout
    (copy / "glyphmeter" / "llm" / "__pycache__").mkdir(parents=True)
    shutil.copy(ROOT / "corpus_pipeline.py", copy) if (ROOT / "corpus_pipeline.py").exists() else None
    assert run(code).returncode == 0


def test_a_missing_library_is_an_error(tmp_path):
    if importlib.util.find_spec("glyphmeter.llm") is None:
        pytest.skip("nothing optional here")
    code = "import sys; sys.modules['zstandard'] = None; import __spark_entry__"
    assert b"zstandard" in subprocess.run([sys.executable, "-c", code], cwd=ROOT, capture_output=True).stderr


def test_nothing_else_imports_llm():
    for p in (ROOT / "glyphmeter").rglob("*.py"):
        if "llm" not in p.parts:
            assert "glyphmeter.llm" not in p.read_text(encoding="utf-8")
