"""A Spark session with the settings this engine expects."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession


def session(app: str = "alarmloom", master: str | None = None, **conf: str) -> SparkSession:
    """Time zone UTC (stored times have no zone), adaptive plans, Arrow; anything else is left to the cluster."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        # stored frames that nothing refers to any more are deleted
        "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
    }
    return builder.config(map=settings | conf).getOrCreate()


def ship(spark: SparkSession) -> None:
    """Sends this package to the Python workers of a session that was not started where they find it; once a session."""
    root = Path(__file__).resolve().parent
    known = spark._jvm.System.getenv("PYTHONPATH") or ""
    sc = spark.sparkContext
    if str(root.parent) in known.split(os.pathsep) or getattr(sc, "_alarmloom_shipped", False):
        return
    # Spark's file server hands it on, so a folder of the driver alone will do
    archive = os.path.join(os.path.realpath(tempfile.mkdtemp(prefix="alarmloom-ship-")), "alarmloom.zip")
    with zipfile.ZipFile(archive, "w") as out:
        for file in sorted(root.rglob("*.py")):
            out.write(file, file.relative_to(root.parent))
    sc.addPyFile(archive)
    sc._alarmloom_shipped = True
