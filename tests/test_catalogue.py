"""Every registered query of the engine against its SQL, run by DuckDB on the same tables."""

import importlib.util
import os

import duckdb
import pytest

from tessera.plans import catalogue


def normal(rows):
    def one(v):
        if v is None or isinstance(v, float) and v != v:
            return "null"
        if isinstance(v, bool) or not isinstance(v, (int, float)):
            return str(v)
        return f"{float(v):.9g}"

    return sorted(tuple(one(v.item() if hasattr(v, "item") else v) for v in r) for r in rows)


@pytest.fixture(scope="module")
def duck(small):
    con = duckdb.connect()
    for f in os.listdir(small):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM read_parquet('{small}/{f}')")
    return con


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query(spark, duck, small, name):
    got = catalogue.QUERIES[name](spark, small)
    columns = sorted(got.columns)
    expected = duck.execute(catalogue.ORACLE_SQL[name])
    assert sorted(d[0] for d in expected.description) == columns
    order = [[d[0] for d in expected.description].index(c) for c in columns]
    assert normal(tuple(r[c] for c in columns) for r in got.collect()) == normal(tuple(r[i] for i in order) for r in expected.fetchall())


def test_product_and_drillthrough_over_whole_tables(spark, duck, small):
    rows, orders = duck.execute("SELECT count(*), count(DISTINCT l_orderkey) FROM lineitem").fetchone()
    assert catalogue.QUERIES["agg_product"](spark, small).count() == orders
    assert catalogue.QUERIES["drillthrough_rows"](spark, small).count() == rows


def test_entry_module(spark):
    spec = importlib.util.spec_from_file_location("entry", os.path.join(os.path.dirname(__file__), "..", "__spark_entry__.py"))
    m = importlib.util.module_from_spec(spec)
    spec.loader.exec_module(m)
    assert set(m.oracle_sql()) <= set(m.queries())
    assert m.entry(spark).count() == 5
