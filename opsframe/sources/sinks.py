"""Sinks. Appends rest on the commit of Spark's jobs; replacements are published by a pointer (``publish``)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from opsframe.functions import scalars as S
from opsframe.operators.logs import format_file_line
from opsframe.sources import publish


def write_log_files(lines: DataFrame, path: str, rebalance: bool = False) -> None:
    """Append formatted lines, one folder per service.

    Each task writes its own files and nothing is shuffled. With many tasks and services that makes many small
    files; ``rebalance`` shuffles the lines by service into files of a good size, a large service into several.
    """
    if rebalance:
        lines = lines.hint("rebalance", "service")
    line = format_file_line(F.col("ts"), F.col("level"), F.col("stream"), F.col("text"))
    lines.select("service", line.alias("value")).write.partitionBy("service").mode("append").text(path)


def put_overwrite(dataset: DataFrame, path: str) -> None:
    """Land a dataset (one text column) in place of an earlier copy, which stays until the new one is complete."""
    rows = dataset.select(F.col(dataset.columns[0]).alias("value"))
    publish.publish(dataset.sparkSession, path, lambda folder: rows.write.text(folder))


def write_word_counts(counts: DataFrame, path: str) -> None:
    """``word<TAB>count`` parts in place of an earlier run's, which stay until the new ones are complete."""
    put_overwrite(counts.select(F.concat_ws("\t", "word", "count").alias("value")), path)


def parse_word_counts(lines: DataFrame, column: str = "text") -> DataFrame:
    """Word counts back from their parts."""
    parts = F.split(column, "\t")
    return lines.select(parts[0].alias("word"), parts[1].cast("bigint").alias("count"))


def write_settings(settings: DataFrame, path: str) -> None:
    """One settings document per host and line, all or nothing."""
    def write(folder: str) -> None:
        settings.write.option("ignoreNullFields", True).json(folder)

    publish.publish(settings.sparkSession, path, write)


def fill_properties(properties: DataFrame, uri: Column) -> DataFrame:
    return properties.withColumn("value", S.template_fill(F.col("value"), uri))


# Properties in one file: an XML file is read whole by one task, and these are some 15 MB.
FILE_PROPERTIES = 100_000


def write_properties(properties: DataFrame, path: str, by: str = "file", most: int = FILE_PROPERTIES) -> None:
    """Property XML files, one folder per file name, of at most ``most`` properties each."""
    writer = properties.write.mode("overwrite").format("xml").option("maxRecordsPerFile", most)
    writer.option("rootTag", "configuration").option("rowTag", "property").partitionBy(by).save(path)
