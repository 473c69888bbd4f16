"""What the operators share: words, tables in the shared folder, and documents cleaned of nulls."""

from __future__ import annotations

from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from opsframe.plans.session import scratch, ship
from opsframe.sources import files

SPACE = r"[\x20\x09-\x0D]+"
SPACE_CHARS = " \t\n\x0b\x0c\r"


def words(text: Column) -> Column:
    """Words: runs of characters outside 0x20 and 0x09-0x0D; none for null or blank texts."""
    bare = F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACE_CHARS))
    return F.when(F.length(bare) == 0, F.array().cast("array<string>")).otherwise(F.split(bare, SPACE))


# Folders that operators of this session have asked for, in the order in which they were made.
_MADE: list[str] = []


def shared_folder(spark: SparkSession, name: str) -> str:
    """A fresh folder below ``spark.checkpoint.dir`` (see ``scratch``)."""
    _MADE.append(scratch(spark, name))
    return _MADE[-1]


def folders_made() -> int:
    return len(_MADE)


def drop_folders(begin: int, end: int) -> None:
    """Delete the folders with these numbers, once nothing is read from them any more. Stores that Arrow can't open keep them."""
    for folder in _MADE[begin:end]:
        try:
            system, place = files.file_system(folder)
            if system.get_file_info(place).type == fs.FileType.Directory:
                system.delete_dir(place)
        except (OSError, ValueError, NotImplementedError):
            continue


def settle(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a table in the shared folder: computed once, and still there when executors are lost."""
    path = shared_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def numbered(df: DataFrame, name: str, column: str) -> DataFrame:
    """``df``, written once, with consecutive numbers from 0 in ``column``.

    Rows are counted per task, and the tasks' first numbers (one row for each) joined to them, so no task sees all rows.
    """
    placed = settle(df.withColumn("_at", F.monotonically_increasing_id()), name)
    task, place = F.shiftright("_at", 33).alias("_task"), F.col("_at").bitwiseAND((1 << 33) - 1)
    counts = sorted(placed.groupBy(task).count().collect())
    begins = [(row["_task"], sum(x["count"] for x in counts[:k])) for k, row in enumerate(counts)]
    firsts = df.sparkSession.createDataFrame(begins, "_task BIGINT, _first BIGINT")
    joined = placed.withColumn("_task", task).join(F.broadcast(firsts), "_task")  # one row per task
    return joined.withColumn(column, F.col("_first") + place).drop("_at", "_task", "_first")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


__all__ = [
    "SPACE", "SPACE_CHARS", "drop_folders", "folders_made", "numbered", "settle", "shared_folder", "ship", "table", "words",
]
