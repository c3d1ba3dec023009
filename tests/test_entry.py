import subprocess
import sys
from pathlib import Path

import __spark_entry__ as entry
import pytest

from contactloom.plans import catalog

SMALL = "/root/testdata/sf0.001"
have_data = pytest.mark.skipif(not Path(SMALL).exists(), reason="the driver's tables are not here")


@have_data
def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_oracles_are_of_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@have_data
@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_against_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for p in Path(SMALL).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    df = catalog.QUERIES[name](spark, SMALL)
    columns = sorted(df.columns)
    key = lambda rows: sorted(repr([round(v, 6) if isinstance(v, float) else v for v in r]) for r in rows)
    expected = con.execute(f"SELECT {', '.join(columns)} FROM ({catalog.ORACLES[name]})").fetchall()
    assert key(tuple(r) for r in df.select(*columns).collect()) == key(expected)


def test_core_stands_alone():
    code = "import sys; sys.modules['contactloom.llm'] = None; import __spark_entry__ as e; assert e.queries() and e.oracle_sql(); assert not any(k.startswith('op1_') for k in e.queries()); import contactloom.cli, contactloom.streaming.pages"
    subprocess.run([sys.executable, "-c", code], check=True, cwd=Path(__file__).parents[1])
