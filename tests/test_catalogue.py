"""Registered checks, and batch inference over plan items."""
from pyspark.sql import functions as F

from lamella.operators import catalogue as C
from lamella.operators.delivery import run_model
from lamella.params import Config


def test_a_registered_check_runs_with_overrides(spark):
    C.register_check(C.Check("too_dark", "dark", lambda d, p: d.select("block_id", "z", (F.col("mean") / p["ref"]).alias("score"), F.lit(None).cast("string").alias("note")), params={"ref": 0.5}))
    s = spark.createDataFrame([("b", 0, 0.5), ("b", 1, 0.05)], "block_id string, z long, mean double")
    got = {r.z: (r.score, r.sev) for r in C.run_registered(s).collect()}
    assert got == {0: (1.0, 0), 1: (0.1, 4)}
    strict = {r.z: r.sev for r in C.run_registered(s, Config({"params": {"too_dark": {"ref": 1.0}}, "thresholds": {"too_dark": {"high": 0.55}}})).collect()}
    assert strict == {0: 3, 1: 4}
    assert C.run_registered(s, Config({"checks_enabled": ["crack"]})) is None
    assert C.checks_catalog(spark).where("name = 'too_dark' OR name = 'crack'").count() == 2


def test_model_runs_per_item_and_survives_failures(spark):
    def divided(batch):
        if (batch["n"] == 0).any():
            raise ValueError("division by zero")
        return (100 / batch["n"]).to_frame("v")

    items = spark.createDataFrame([(0, "b", 4), (1, "b", 0), (2, "b", 5)], "i long, block_id string, n long")
    got = {r.i: (r.v, r.state) for r in run_model(items, divided, "v double", ["i", "block_id"]).collect()}
    assert got == {0: (25.0, "ok"), 1: (None, "fail"), 2: (20.0, "ok")}
