"""Versions of a table, writers that meet, and what a broken writer leaves."""
import os

import pytest

from lamella.sources import snapshots as N


def rows(spark, *blocks):
    return spark.createDataFrame([(1, "d", b, v) for b, v in blocks], "run_id int, dataset_id string, block_id string, v int")


def at(spark, root, version=None):
    return sorted((r.block_id, r.v) for r in N.snapshot(spark, root, version).collect())


def test_versions_and_conflicts(spark, scratch):
    root = scratch + "/t"
    with pytest.raises(ValueError):
        N.snapshot(spark, root)
    assert N.commit(rows(spark, ("a", 1), ("b", 1), ("b", 2)), root) == 1
    assert N.commit(rows(spark, ("b", 5)), root) == 2
    assert N.commit(rows(spark, ("c", 7)), root, parent=1) == 3  # a writer that has not seen version 2, on another block
    with pytest.raises(N.Conflict):
        N.commit(rows(spark, ("b", 9)), root, parent=1)
    assert at(spark, root, 1) == [("a", 1), ("b", 1), ("b", 2)]
    assert at(spark, root, 2) == [("a", 1), ("b", 5)]
    assert at(spark, root) == [("a", 1), ("b", 5), ("c", 7)]
    assert N.compact(spark, root) == 4 and at(spark, root) == at(spark, root, 3)
    assert N.commit(rows(spark, ("a", 8)), root) == 5 and at(spark, root) == [("a", 8), ("b", 5), ("c", 7)]
    with pytest.raises(N.Conflict):  # a full commit replaces all that came after its parent
        N.commit(rows(spark, ("z", 1)), root, parent=4, full=True)
    assert [e["version"] for e in N.history(spark, root)] == [1, 2, 3, 4, 5]


def test_the_log_entry_of_a_version_is_written_once(spark, scratch):
    root = scratch + "/t"
    N.commit(rows(spark, ("a", 1)), root)
    assert not N._create(spark, f"{root}/log/{1:012d}.json", "{}")
    rows(spark, ("a", 99)).write.parquet(f"{root}/data/broken")  # no log entry names it
    assert at(spark, root) == [("a", 1)] and os.path.isdir(f"{root}/data/broken")
