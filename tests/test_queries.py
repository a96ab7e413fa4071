"""Every query against its SQL, at the smallest size."""

import shutil
import subprocess
import sys
from pathlib import Path

import pytest

import __spark_entry__ as entry

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    import duckdb

    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return c


def plain(value):
    return round(float(value), 9) if isinstance(value, (int, float)) and not isinstance(value, bool) else str(value)


@pytest.mark.parametrize("name", sorted(n for n in entry.queries() if n.startswith("q_")))
def test_query(spark, duck, name):
    df = entry.queries()[name](spark, DATA)
    columns = sorted(df.columns)
    ours = sorted(tuple(plain(r[c]) for c in columns) for r in df.collect())
    theirs = duck.sql(entry.oracle_sql()[name])
    assert sorted(theirs.columns) == columns
    at = [theirs.columns.index(c) for c in columns]
    assert ours == sorted(tuple(plain(r[k]) for k in at) for r in theirs.fetchall())


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_without_the_optional_package(tmp_path):
    """A copy of the repository without the subpackage and its tests: the rest imports, and has its queries."""
    root = Path(entry.__file__).parent
    shutil.copytree(root / "firmlake", tmp_path / "firmlake", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(root / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; assert e.queries() and all(n.startswith('q_') for n in e.queries()) and set(e.oracle_sql()) <= set(e.queries())"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, timeout=120)
