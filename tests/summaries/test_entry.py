"""The registered queries: they stand without the training-data folder, and give what their SQL gives."""

import os
import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

from tallyforge.plans import QUERIES, SQL

ROOT = Path(__file__).resolve().parents[2]
DATA = "/root/testdata/sf0.001"
TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events"]


def test_entry_without_the_training_data_folder(tmp_path):
    for p in ("tallyforge", "__spark_entry__.py"):
        subprocess.run(["cp", "-r", ROOT / p, tmp_path], check=True)
    subprocess.run(["rm", "-rf", tmp_path / "tallyforge/llm"], check=True)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'theta_bounds' in q and 'pipeline' not in q and not any(k.startswith('op') for k in q); assert set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env=os.environ | {"PYTHONPATH": str(tmp_path)})


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{DATA}/{t}.parquet')")
    return con


def text(v):
    return "null" if v is None else f"{v:.9g}" if isinstance(v, float) else str(v)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_its_sql(spark, duck, name):
    if not os.path.isdir(DATA):
        pytest.skip("no test tables here")
    df = QUERIES[name](spark, DATA)
    cols = sorted(df.columns)
    got = sorted(tuple(text(v) for v in r) for r in df.select(cols).collect())
    if name not in SQL:
        return
    rel = duck.execute(SQL[name])
    names = [d[0] for d in rel.description]
    assert sorted(names) == cols
    at = [names.index(c) for c in cols]
    assert got == sorted(tuple(text(r[i]) for i in at) for r in rel.fetchall())
