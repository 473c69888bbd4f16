"""State between micro-batches as a log of segments.

Batch ``n`` adds one segment with the rows it changed. ``fan`` segments of a level become one of the next level, so after
``n`` batches there are at most ``(fan - 1) * log(n)`` of them, a row is written again once for each level, and what a
batch writes follows the batch and not the state. Which segments make up the state before a batch follows from the batch
number alone: there is no list of them to keep, and a batch that runs again after a crash reads and replaces the same
ones. Merged segments go when the next batch begins, since the batch that merged them is committed by then.
"""

from __future__ import annotations

from collections.abc import Callable

from pyarrow import fs
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from opsframe.sources import files

FAN = 8


class Segments:
    """``merge(rows, whole)`` brings rows of several segments together, the result in the same columns.

    ``whole`` says that they begin with the first batch, so that there is nothing older. ``schema`` may be left out where
    nobody asks for the state before the first batch.
    """

    def __init__(
        self,
        spark: SparkSession,
        path: str,
        schema: str | None,
        merge: Callable[[DataFrame, bool], DataFrame],
        fan: int = FAN,
    ):
        self.spark, self.path, self.schema, self.merge, self.fan = spark, path, schema, merge, fan
        self.last: int | None = None

    def spans(self, n: int) -> list[tuple[int, int]]:
        """(level, first batch) of the segments that hold the batches before ``n``."""
        level, at, found = 0, 0, []
        while self.fan ** (level + 1) <= n:
            level += 1
        while at < n:
            while self.fan**level > n - at:
                level -= 1
            found.append((level, at))
            at += self.fan**level
        return found

    def place(self, level: int, first: int) -> str:
        return f"{self.path}/level={level}/from={first}"

    def _parts(self, level: int, first: int) -> list[str]:
        """The segments that a merged one is made of."""
        step = self.fan ** (level - 1)
        return [self.place(level - 1, first + k * step) for k in range(self.fan)]

    def _read(self, paths: list[str]) -> DataFrame:
        reader = self.spark.read if self.schema is None else self.spark.read.schema(self.schema)
        return reader.parquet(*paths)

    def before(self, n: int) -> DataFrame:
        """The state before batch ``n``."""
        if n == 0:
            return self.spark.createDataFrame([], self.schema)
        return self.merge(self._read([self.place(*span) for span in self.spans(n)]), True)

    def write(self, n: int, rows: DataFrame) -> None:
        """Add what batch ``n`` changed."""
        level = 1
        while n and n % self.fan**level == 0:
            for path in self._parts(level, n - self.fan**level):
                _delete(path)
            level += 1
        rows.write.mode("overwrite").parquet(self.place(0, n))
        level = 1
        while (n + 1) % self.fan**level == 0:
            first = n + 1 - self.fan**level
            merged = self.merge(self._read(self._parts(level, first)), first == 0)
            merged.write.mode("overwrite").parquet(self.place(level, first))
            level += 1
        mark = self.spark.range(1).select(F.lit(n).alias("batch"))
        mark.write.mode("overwrite").parquet(f"{self.path}/written/{n % 2}")
        self.last = n

    def now(self) -> DataFrame:
        """The state after the last batch, also of an earlier run."""
        if self.last is None:
            try:
                marks = self.spark.read.schema("batch INT").parquet(f"{self.path}/written/*")
                self.last = marks.agg(F.max("batch")).first()[0]
            except AnalysisException as error:  # nothing has been written yet
                if error.getCondition() != "PATH_NOT_FOUND":
                    raise
        return self.before(0 if self.last is None else self.last + 1)


def _delete(folder: str) -> None:
    system, place = files.file_system(folder)
    if system.get_file_info(place).type == fs.FileType.Directory:
        system.delete_dir(place)
