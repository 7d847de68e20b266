"""Session settings and shipping the package to executors."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import SparkSession

#: Settings the engine is written for. None of them is needed for right results.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
}

_shipped: set[str] = set()


def build(master: str = "local[*]", **settings: str) -> SparkSession:
    b = SparkSession.builder.master(master).appName("quorumlake")
    for k, v in (SETTINGS | settings).items():
        b = b.config(k, v)
    return b.getOrCreate()


def ship(spark: SparkSession) -> None:
    """Makes the package importable on executors that don't have the repository on their path; once per application."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    _shipped.add(app)
    root = os.path.dirname(os.path.abspath(__file__))
    path = os.path.join(tempfile.mkdtemp(prefix="quorumlake-"), "quorumlake.zip")
    with zipfile.ZipFile(path, "w") as z:
        for folder, _, names in os.walk(root):
            for name in names:
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    z.write(full, os.path.join("quorumlake", os.path.relpath(full, root)))
    spark.sparkContext.addPyFile(path)
