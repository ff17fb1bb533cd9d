"""The entry point from another folder, without and with the optional subpackage; the archive for clusters."""
import os
import shutil
import subprocess
import sys
import zipfile

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
CODE = """
import sys
sys.path.insert(0, {root!r})
import __spark_entry__ as e
assert ("op9_bpe_automaton" in e.queries()) == {llm}, "subpackage"
assert ("pipeline" in e.queries()) == {llm}
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").getOrCreate()
print("ROWS", e.queries()["contamination_scores"](spark, "/root/testdata/sf0.001").count())
"""


def run(root, llm, cwd):
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", CODE.format(root=root, llm=llm)], cwd=cwd, env=env, capture_output=True, text=True, timeout=300)
    assert "ROWS 500" in done.stdout, done.stderr[-2000:]


def test_queries_run_from_another_folder(scratch):
    run(ROOT, os.path.isdir(os.path.join(ROOT, "lamella", "llm")), scratch)


def test_entry_without_the_optional_parts(scratch):
    copy = os.path.join(scratch, "repo")
    shutil.copytree(ROOT, copy, ignore=shutil.ignore_patterns(".git", "llm", "corpus_pipeline.py", "__pycache__"))
    run(copy, False, scratch)


def test_archive_holds_the_package(spark):
    from lamella.deploy import ship

    with zipfile.ZipFile(ship(spark)) as z:
        assert {"lamella/__init__.py", "lamella/functions/kernels.py"} <= set(z.namelist())
