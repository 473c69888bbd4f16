"""Step outcomes of runs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def all_steps_done(steps: DataFrame) -> DataFrame:
    """Is a run complete, and how many of its steps are in each state?"""
    status = F.col("status")
    counts = [
        F.count(F.when(status == name, 1)).alias(name) for name in ("done", "failed", "running", "pending")
    ]
    done = F.min(F.coalesce(status == "done", F.lit(False)))
    return steps.groupBy("run_id").agg(done.alias("complete"), *counts)


def collect_errors(steps: DataFrame) -> DataFrame:
    """Errors of all runs, one row each (``run_id, pos, error``); a run of any length is as many rows."""
    return steps.filter(F.col("error").isNotNull()).select("run_id", "pos", "error")


def error_texts(steps: DataFrame) -> DataFrame:
    """Errors of a run in order, joined by newlines; null where a run has none.

    The text is one value, so a run must fit into a row (2 GB); ``collect_errors`` has no such bound.
    """
    listed = F.array_sort(F.collect_list(F.when(F.col("error").isNotNull(), F.struct("pos", "error"))))
    text = F.array_join(F.transform(listed, lambda row: row["error"]), "\n")
    return steps.groupBy("run_id").agg(F.nullif(text, F.lit("")).alias("errors"))


def until_first_failure(steps: DataFrame) -> DataFrame:
    """Steps of a sequential run: executed up to and including the first failure, later ones pending.

    The first failure of a run is found by aggregation and joined back, so a long run is not held in one task.
    """
    failed = steps.filter(F.col("status") == "failed").groupBy("run_id").agg(F.min("pos").alias("_failed"))
    executed = F.col("_failed").isNull() | (F.col("pos") <= F.col("_failed"))
    joined = steps.join(failed, "run_id", "left")
    return joined.select(*steps.columns, F.when(executed, "executed").otherwise("pending").alias("execution"))
