"""Every registered query against its SQL statement on the smallest scale factor."""
import importlib

import duckdb
import pytest

from check import TABLES, rows_of
from lamella.plans import REGISTRY

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


@pytest.mark.parametrize("name", sorted(REGISTRY))
def test_query(spark, duck, name):
    q = REGISTRY[name]
    df = q.run(spark, SF)
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    if q.oracle is None:
        assert len(set(df.columns)) == len(df.columns)
        return
    res = duck.execute(q.oracle)
    want = rows_of([d[0] for d in res.description], res.fetchall())
    assert got == want


def test_entry_contract(spark):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert e.entry(spark).limit(1).count() == 1


@pytest.mark.parametrize("name,module,source", [("membrane_windows", "lamella.sources.tables", "pixels"), ("runs_replay", "lamella.plans.label_runs", "strokes"),
                                                ("runs_crop_report", "lamella.plans.volumes", "after")])
def test_a_query_builds_its_largest_table_once(spark, monkeypatch, name, module, source):
    at, calls = importlib.import_module(module), []
    build = getattr(at, source)
    monkeypatch.setattr(at, source, lambda *a: (calls.append(a), build(*a))[1])
    REGISTRY[name].run(spark, "/root/testdata/sf0.001")
    assert len(calls) == 1


def test_tile_evidence_paints_its_labels_once(spark):
    plan = REGISTRY["runs_tile_evidence"].run(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "l_orderkey" not in plan  # everything is read from the painted runs
