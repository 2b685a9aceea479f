"""Every query of the catalogue against its SQL in DuckDB, and the shape of the driver contract."""

import os

import duckdb
import pytest

from docfathom.plans import catalog, oracle

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def rows(columns, found):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted([columns[i] for i in order] and [repr(tuple(round(r[i], 6) if isinstance(r[i], float) else r[i] for i in order)) for r in found])


@pytest.mark.parametrize("name", sorted(oracle.ORACLE_SQL))
def test_query(spark, db, name):
    got = catalog.QUERIES[name](spark, SF)
    want = db.execute(oracle.ORACLE_SQL[name])
    columns = [c[0] for c in want.description]
    assert sorted(columns) == sorted(got.columns)
    assert rows(got.columns, [tuple(r) for r in got.collect()]) == rows(columns, want.fetchall())


def test_all_have_sql():
    assert set(catalog.QUERIES) == set(oracle.ORACLE_SQL)


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_nothing_imports_the_llm_subpackage():
    import docfathom

    top = os.path.dirname(docfathom.__file__)
    for folder, _, names in os.walk(top):
        if os.path.basename(folder) == "llm":
            continue
        for n in names:
            if n.endswith(".py"):
                with open(os.path.join(folder, n), encoding="utf-8") as f:
                    assert "llm" not in f.read(), n


def test_plans(spark):
    """Filters reach the scan, only needed columns are read, and a top-k does not sort everything."""
    plan = catalog.chunks_by_source(spark, SF)._jdf.queryExecution().toString()
    assert "PushedFilters: [IsNotNull(source), EqualTo(source,src3)]" in plan
    plan = catalog.list_sources(spark, SF)._jdf.queryExecution().toString()
    assert "ReadSchema: struct<source:string>" in plan
    from docfathom.operators import vector

    plan = vector.nearest(catalog.vectors(spark, SF), [0.0] * 64, 5)._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan
