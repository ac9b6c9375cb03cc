import importlib.util
import os
import subprocess
import sys

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry
from spanloom.plans import catalogue

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return c


def plain(df):
    df = df[sorted(df.columns)]
    value = lambda v: None if v is None or pd.isna(v) else float(v) if isinstance(v, float) else v.item() if hasattr(v, "item") else v
    return sorted(repr(tuple(value(v) for v in r)) for r in df.astype(object).itertuples(index=False))


@pytest.mark.parametrize("name", sorted(catalogue.ORACLE_SQL))
def test_query_equals_sql(spark, duck, name):
    got, want = catalogue.QUERIES[name](spark, SF).toPandas(), duck.execute(catalogue.ORACLE_SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert [x.replace(".0,", ",").replace(".0)", ")") for x in plain(got)] == [x.replace(".0,", ",").replace(".0)", ")") for x in plain(want)]


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry_imports_without_the_training_data_folders(tmp_path):
    here = os.path.dirname(entry.__file__)
    for name in ("__spark_entry__.py", "spanloom"):
        os.symlink(os.path.join(here, name), tmp_path / name) if name.endswith(".py") else subprocess.run(["cp", "-r", os.path.join(here, name), tmp_path / name], check=True)
    subprocess.run(["rm", "-rf", tmp_path / "spanloom" / "llm"], check=True)
    os.remove(tmp_path / "__spark_entry__.py")
    subprocess.run(["cp", os.path.join(here, "__spark_entry__.py"), tmp_path], check=True)
    code = "import __spark_entry__ as e; assert 'island_fdr' in e.queries() and not any(k.startswith('op') for k in e.queries()); e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env=os.environ | {"PYTHONPATH": str(tmp_path)})
    assert importlib.util.find_spec("spanloom") is not None
