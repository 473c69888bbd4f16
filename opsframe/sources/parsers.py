"""Parsers of collected port and process listings. Inputs are numbered lines: ``line_no, line``."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from opsframe.functions import scalars as S
from opsframe.plans import schemas


def parse_netstat(lines: DataFrame, by: Sequence[str] = ("file",)) -> DataFrame:
    """Listening ports and their pids from a whitespace-separated table; the first usable row of a port wins."""
    fields = lines.select(*by, "line_no", S.split_fields(F.col("line")).alias("_f"))
    rows = fields.filter((F.size("_f") >= 5) & (F.col("_f")[3] == "LISTENING")).select(
        *by,
        "line_no",
        S.to_int(F.regexp_extract(F.col("_f")[1], r":(\d+)\z", 1)).alias("port"),
        S.to_int(F.col("_f")[4]).alias("pid"),
    )
    usable = rows.filter(F.col("port").isNotNull() & F.col("pid").isNotNull())
    return usable.groupBy(*by, "port").agg(F.min_by("pid", "line_no").alias("pid"))


def parse_lsof(lines: DataFrame, by: Sequence[str] = ("port",)) -> DataFrame:
    """Owner from tagged lines (``p`` pid, ``c`` command); the last line of each tag wins."""
    tag, rest = F.substring("line", 1, 1), F.substring(F.col("line"), F.lit(2), F.length("line"))
    pid = S.to_int(F.when(tag == "p", rest))
    rows = lines.select(*by, "line_no", pid.alias("_pid"), F.when(tag == "c", rest).alias("_name"))

    def last(column: str):
        return F.max_by(column, F.when(F.col(column).isNotNull(), F.col("line_no")))

    return rows.groupBy(*by).agg(
        F.coalesce(last("_pid"), F.lit(0)).alias("pid"), F.coalesce(last("_name"), F.lit("")).alias("name")
    )


def parse_tasklist(lines: DataFrame, column: str = "line") -> DataFrame:
    """Process names by pid from CSV rows; lines that are blank, ``INFO:`` or without a numeric pid hold none."""
    text = F.btrim(F.col(column), F.lit(" \t\r\n\x0b\x0c"))
    rows = lines.filter((text != "") & ~text.startswith("INFO:"))
    parsed = rows.select(F.from_csv(text, schemas.TASKLIST).alias("_p"))
    named = parsed.select(S.to_int(F.col("_p.pid")).alias("pid"), F.col("_p.image").alias("image"))
    return named.filter(F.col("pid").isNotNull())
