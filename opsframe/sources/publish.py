"""Datasets that are replaced all or nothing.

Each replacement is written to a folder of its own below ``versions``. When that is complete, a job of one row adds a file
to ``published``, which Spark's commit puts there by one rename: that file is the pointer. Readers follow the newest one,
so a job that is killed, fails or is repeated leaves the copy before it readable, and a reader keeps the copy it began
with. Only Spark's readers and writers are used, so any store that they reach will do.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from opsframe.sources import files

POINTER = "n BIGINT, version STRING"


def pointers(spark: SparkSession, path: str) -> DataFrame | None:
    """The replacements so far, the newest with the largest ``n``; None if there are none."""
    try:
        return spark.read.schema(POINTER).json(f"{path}/published")
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def _newest(spark: SparkSession, path: str) -> tuple[int, str] | None:
    known = pointers(spark, path)
    found = known.orderBy(F.desc("n"), F.desc("version")).first() if known is not None else None
    return (found["n"], found["version"]) if found else None


def current(spark: SparkSession, path: str) -> str:
    """The folder of the newest complete copy; ``path`` itself where nothing has been published."""
    found = _newest(spark, path)
    return f"{path}/versions/{found[1]}" if found else path


def publish(spark: SparkSession, path: str, write: Callable[[str], None]) -> str:
    """Let ``write`` fill a new folder, and make that the copy that readers see. Of two at the same time, one stays."""
    version = uuid.uuid4().hex
    write(f"{path}/versions/{version}")
    newest = _newest(spark, path)
    pointer = spark.range(1).select(F.lit(newest[0] + 1 if newest else 0).cast("bigint").alias("n"), F.lit(version).alias("version"))
    pointer.write.mode("append").json(f"{path}/published")
    return f"{path}/versions/{version}"


def retire(spark: SparkSession, path: str, keep: int = 2) -> int:
    """Delete all copies but the newest ``keep``, also those that never became complete; how many went.

    Not while another job writes or still reads an older copy.
    """
    known = pointers(spark, path)
    newest = known.orderBy(F.desc("n"), F.desc("version")).limit(max(keep, 1)).collect() if known is not None else []
    kept = {row["version"] for row in newest}
    gone = [entry for entry in files.entries(f"{path}/versions") if entry[3] and entry[2] not in kept]
    for _, folder, *_ in gone:
        system, place = files.file_system(folder)
        system.delete_dir(place)
    return len(gone)
