"""Session settings and shared scratch folders."""

from __future__ import annotations

import os
import sys
import tempfile
import uuid

from pyspark import cloudpickle
from pyspark.sql import SparkSession


def ship(module: str) -> None:
    """Send a module's functions to the executors by value, so that the package need not be installed there."""
    cloudpickle.register_pickle_by_value(sys.modules[module])


def local_session(app: str = "opsframe", cores: str | None = None) -> SparkSession:
    """A local session for tests and the bench. On a cluster, use the session it provides."""
    cores = cores or os.environ.get("BENCH_CPUS", "8")
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(cores) if cores != "*" else "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh folder that every executor can reach.

    The cluster names its shared folder in ``spark.checkpoint.dir``. Only a local session may leave it unset, and then
    gets a temporary folder: on a cluster each executor would see its own.
    """
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        if not spark.conf.get("spark.master", "").startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        return os.path.join(tempfile.mkdtemp(prefix="run-", dir="/tmp"), name)
    return f"{shared.rstrip('/')}/{name}-{uuid.uuid4().hex}"

