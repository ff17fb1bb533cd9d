"""A key that holds a third of all rows: same results as SQL, so hot groups are split correctly."""
import tempfile

import duckdb
import pytest

from check import TABLES, rows_of
from lamella.plans import REGISTRY

SF = "/root/testdata/sf0.001"
HOT = {
    "events": "SELECT * REPLACE (CASE WHEN event_id % 3 = 0 THEN 7 ELSE user_id END AS user_id) FROM src",
    "lineitem": "SELECT * REPLACE (CASE WHEN l_orderkey % 3 = 0 THEN 11 ELSE l_partkey END AS l_partkey, CASE WHEN l_orderkey % 3 = 0 THEN 5 ELSE l_suppkey END AS l_suppkey) FROM src",
    "conversations": "SELECT * EXCLUDE (rn) REPLACE (CASE WHEN rn % 3 = 0 THEN 3 ELSE conv_id END AS conv_id, CASE WHEN rn % 3 = 0 THEN 1000 + rn ELSE turn END AS turn) FROM (SELECT *, row_number() OVER (ORDER BY conv_id, turn) AS rn FROM src)",
}


@pytest.fixture(scope="module")
def hot():
    d, con = tempfile.mkdtemp(prefix="lamella-hot-", dir="/tmp"), duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE OR REPLACE VIEW src AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
        con.execute(f"COPY ({HOT.get(t, 'SELECT * FROM src')}) TO '{d}/{t}.parquet' (FORMAT parquet)")
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{d}/{t}.parquet')")
    return d, con


@pytest.mark.parametrize("name", ["block_report", "brightness_walk", "refchain_asof", "export_codes", "patch_leak_check", "last_writer", "conflicts", "review_status", "stream_alert_dedup"])
def test_hot_key(spark, hot, name):
    d, con = hot
    df = REGISTRY[name].run(spark, d)
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    res = con.execute(REGISTRY[name].oracle)
    assert got == rows_of([c[0] for c in res.description], res.fetchall())
