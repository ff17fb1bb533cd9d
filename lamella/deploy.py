"""Making the package known to Python workers."""
from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import SparkSession

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def reach(spark: SparkSession) -> None:
    """Workers that see the driver's file system (local mode, shared folders) find the package where the driver has it."""
    env = spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if ROOT not in paths:
        env["PYTHONPATH"] = os.pathsep.join([ROOT, *paths])


def ship(spark: SparkSession) -> str:
    """Send the package to all executors of a cluster where it is not installed; returns the archive's path."""
    path = os.path.join(tempfile.mkdtemp(prefix="lamella-ship-"), "lamella.zip")
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for folder, _, names in os.walk(os.path.join(ROOT, "lamella")):
            for name in names:
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    z.write(full, os.path.relpath(full, ROOT))
    spark.sparkContext.addPyFile(path)
    return path
