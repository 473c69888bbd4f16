"""Word counts: built-in form, user programs over pipes, and user Python functions."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.udtf import UserDefinedTableFunction

from opsframe.operators import pipes
from opsframe.plans.session import ship

ship(__name__)


def words(lines: DataFrame, text: str = "text") -> DataFrame:
    """One row per token; tokens are separated by whitespace and kept as they are."""
    return lines.select(F.explode(F.split(text, r"\s+")).alias("word")).filter(F.col("word") != "")


def word_count(lines: DataFrame, text: str = "text") -> DataFrame:
    """Occurrences of each word. Counted per map task before the shuffle."""
    return words(lines, text).groupBy("word").agg(F.count("*").alias("count"))


def top_words(counts: DataFrame, k: int = 20) -> DataFrame:
    """The ``k`` most frequent words; equal counts come in descending word order."""
    return counts.orderBy(F.desc("count"), F.desc("word")).limit(k)


def head_preview(df: DataFrame, order: list[str], n: int = 20) -> DataFrame:
    """First ``n`` rows in the given order."""
    return df.orderBy(*order).limit(n)


def trial_run(df: DataFrame, order: list[str], pipeline: Callable[[DataFrame], DataFrame], n: int = 20) -> DataFrame:
    """What a pipeline makes of the first ``n`` input rows in the given order."""
    return pipeline(head_preview(df, order, n))


def pipe_mapreduce(
    lines: DataFrame, mapper: str, reducer: str, combiner: str | None = None, partitions: int | None = None
) -> DataFrame:
    """Run user programs over lines: ``mapper`` and ``reducer`` are shell commands.

    The mapper gets each line on its standard input and prints ``key<TAB>value``. Its output is partitioned and
    sorted by key on disk, so a reducer gets each key's lines together, as a stream. ``combiner`` is a reducer
    that may also run over parts of a map task's own output (sums, counts, extremes): with it a frequent key arrives
    as one line per part. The job fails if any program ends with a status other than 0. The programs must be
    reachable from every executor. Null lines are empty lines.
    """
    mapping = pipes.piped(mapper) if combiner is None else pipes.mapped_and_combined(mapper, combiner)
    mapped = lines.select(F.col(lines.columns[0]).cast("string")).mapInArrow(mapping, "line STRING")
    key = F.substring_index("line", "\t", 1)
    keyed = mapped.withColumn("_key", key)
    shuffled = keyed.repartition(partitions, "_key") if partitions else keyed.repartition("_key")
    reduced = shuffled.sortWithinPartitions("_key").select("line").mapInArrow(pipes.piped(reducer), "line STRING")
    value = F.substring(F.col("line"), F.length(key) + 2, F.length("line"))
    return reduced.select(key.alias("key"), value.alias("value"))


MapFunction = Callable[[pd.Series], pd.DataFrame]
ReduceFunction = Callable[[pd.DataFrame], pd.DataFrame]
GroupFunction = Callable[[Iterator[pd.DataFrame]], pd.DataFrame]

# Rows that a map task gathers before it passes them on, how many reduced parts may have before they are reduced together
# (they may double since the last time as well), and characters that a mapper gets at once.
GATHER = 200_000
MERGE = 50_000
SLICE_CHARS = 8_000_000


def slices(lines: pd.Series) -> Iterator[pd.Series]:
    """A batch of lines in parts of bounded text size; a longer line is a part of its own."""
    until = lines.str.len().fillna(0).cumsum() // SLICE_CHARS
    for _, part in lines.groupby(until, sort=False):
        yield part


def map_reduce_udf(
    lines: DataFrame, mapper: MapFunction, reducer: ReduceFunction, schema: str = "key STRING, value BIGINT"
) -> DataFrame:
    """The same contract with Python functions over Arrow batches; the first column of ``schema`` is the key.

    ``mapper`` turns a batch of lines into rows. ``reducer`` is an associative function from rows of any number
    of keys to one row per key. It runs in the map tasks, on each part alone and on the parts together when their rows
    have doubled, so a frequent key leaves each task as a few rows; and again on the rows of each partition, sorted by
    key, where only the last key of a batch is carried on.
    """
    text = lines.columns[0]

    def gather(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parts, reduced, held = [], 0, 0  # rows that the last reduction left, rows that there are now
        for batch in batches:
            for part in slices(batch[text]):
                parts.append(reducer(mapper(part)))
                held += len(parts[-1])
                if held > 2 * reduced + MERGE:
                    parts = [reducer(pd.concat(parts, ignore_index=True))]
                    reduced = held = len(parts[0])
                    if held > GATHER:
                        yield parts[0]
                        parts, reduced, held = [], 0, 0
        if parts:
            yield reducer(pd.concat(parts, ignore_index=True))

    def finish(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        carried = None
        for batch in batches:
            if not len(batch):
                continue
            rows = batch if carried is None else pd.concat([carried, batch], ignore_index=True)
            open_key = rows[key] == rows[key].iloc[-1]
            carried = reducer(rows[open_key])
            if not open_key.all():
                yield reducer(rows[~open_key])
        if carried is not None:
            yield carried

    mapped = lines.select(text).mapInPandas(gather, schema)
    key = mapped.columns[0]
    return mapped.repartition(key).sortWithinPartitions(key).mapInPandas(finish, schema)


def map_group_udf(
    lines: DataFrame, mapper: MapFunction, reducer: GroupFunction, schema: str = "key STRING, value BIGINT"
) -> DataFrame:
    """For a reducer that is not associative: it gets the rows of one key as an iterator of batches.

    A key streams through one task and never has to fit in memory, but a frequent key makes a long task: prefer
    ``map_reduce_udf`` where the reducer allows it.
    """
    text = lines.columns[0]

    def emit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for part in slices(batch[text]):
                yield mapper(part)

    def finish(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        yield reducer(batches)

    mapped = lines.select(text).mapInPandas(emit, schema)
    return mapped.groupBy(mapped.columns[0]).applyInPandas(finish, schema)


# Fixed value: the ASCII whitespace that separates words.
WHITESPACE = "[ \t\n\x0b\f\r]+"


def emit_ones(lines: pd.Series) -> pd.DataFrame:
    """(word, 1) for each token of a batch of lines."""
    tokens = lines.str.split(WHITESPACE, regex=True).explode().dropna()
    return pd.DataFrame({"key": tokens[tokens != ""].astype(str).to_numpy(), "value": 1})


def sum_rows(rows: pd.DataFrame) -> pd.DataFrame:
    """Sum per key."""
    return rows.groupby("key", as_index=False, sort=False)["value"].sum()


def sum_batches(batches: Iterator[pd.DataFrame]) -> pd.DataFrame:
    """Sum of one key's batches."""
    key, total = None, 0
    for batch in batches:
        key, total = batch["key"].iloc[0], total + int(batch["value"].sum())
    return pd.DataFrame({"key": [key], "value": [total]})


class _EmitWords:
    def eval(self, line: str):
        for token in re.split(WHITESPACE, line or ""):
            if token:
                yield token, 1


def register_functions(spark: SparkSession) -> UserDefinedTableFunction:
    """Make ``emit_words(line)`` callable as a table function in SQL."""
    emit_words = F.udtf(_EmitWords, returnType="key STRING, value BIGINT")
    spark.udtf.register("emit_words", emit_words)
    return emit_words
