"""Host telemetry: counter differences and missing readings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from opsframe.functions import scalars as S
from opsframe.operators.ordered import CHUNK, Fold, running


def cpu_delta(samples: DataFrame, width: int = CHUNK) -> DataFrame:
    """CPU percent between consecutive samples of a host; the first sample has none."""
    before = {"_busy": Fold("lag", F.col("busy")), "_total": Fold("lag", F.col("total"))}
    rows = running(samples, ["host"], "seq", before, width)
    spent = F.nullif(F.col("total") - F.col("_total"), F.lit(0))
    percent = S.round1((F.col("busy") - F.col("_busy")) * 100 / spent)
    return rows.select(*samples.columns, percent.alias("cpu_percent"))


def fill_forward(samples: DataFrame, column: str = "reading", width: int = CHUNK) -> DataFrame:
    """A missing reading takes the last valid one of its host."""
    filled = {"filled": Fold("last", F.col(column))}
    return running(samples, ["host"], "seq", filled, width)
