import duckdb
import pytest

import __spark_entry__
from quizloom.plans import catalogue, stored  # noqa: F401 (adds its own queries)

from .conftest import TINY

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{TINY}/{t}.parquet'")
    return con


def plain(rows):
    return sorted(((tuple(round(x, 9) if isinstance(x, float) else x for x in r)) for r in rows), key=str)


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query_against_its_sql(spark, duck, name):
    df = catalogue.QUERIES[name](spark, TINY)
    rel = duck.sql(catalogue.ORACLES[name])
    columns = sorted(df.columns)
    assert columns == sorted(rel.columns)
    want = duck.sql(f"SELECT {', '.join(chr(34) + c + chr(34) for c in columns)} FROM ({catalogue.ORACLES[name]})").fetchall()
    assert plain(df.select(*columns).collect()) == plain(want)


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_nothing_else_imports_the_optional_subpackage():
    from pathlib import Path

    root = Path(catalogue.__file__).parent.parent
    for p in root.rglob("*.py"):
        if "llm" not in p.relative_to(root).parts:
            assert "llm" not in p.read_text(encoding="utf-8"), p


def test_registry_needs_no_session():
    """The queries can be listed before Spark is started."""
    import subprocess
    import sys
    from pathlib import Path

    root = Path(__spark_entry__.__file__).parent
    said = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()))"], cwd=root, capture_output=True, text=True, check=True)
    assert int(said.stdout.split()[0]) >= int(said.stdout.split()[1]) > 40
