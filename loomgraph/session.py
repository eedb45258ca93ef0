"""Sessions, and shipping this package to Python workers."""

from __future__ import annotations

import os
import shutil
import tempfile

from pyspark.sql import SparkSession

_SHIPPED: set[str] = set()


def local_session(cpus: int | str = "*", partitions: int = 8, app: str = "loomgraph", **conf: str) -> SparkSession:
    """A local session for tests and the bench; a cluster's own session is used as it is."""
    builder = SparkSession.builder.master(f"local[{cpus}]").appName(app)
    base = {
        "spark.sql.shuffle.partitions": str(partitions), "spark.sql.session.timeZone": "UTC", "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false", "spark.driver.memory": "8g", "spark.sql.adaptive.enabled": "true",
    }
    for key, value in (base | conf).items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ship(spark: SparkSession) -> None:
    """Send this package to the executors once a context, so that Python workers can import it wherever they start."""
    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED:
        return
    here = os.path.dirname(os.path.abspath(__file__))
    with tempfile.TemporaryDirectory() as tmp:
        stage = os.path.join(tmp, "stage")
        shutil.copytree(here, os.path.join(stage, os.path.basename(here)), ignore=shutil.ignore_patterns("__pycache__"))
        keep = tempfile.mkdtemp(prefix="loomgraph-ship-")
        archive = shutil.make_archive(os.path.join(keep, "loomgraph"), "zip", stage)
    sc.addPyFile(archive)
    _SHIPPED.add(sc.applicationId)
