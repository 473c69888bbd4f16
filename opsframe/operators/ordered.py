"""Ordered state over keys of any size: running values, newest rows, latest values.

A window over a whole key would put that key into one task, and one service may hold a third of all rows.
``running`` instead works in chunks of the sequence: a window inside each (key, chunk), one summary row per
chunk, and a second, far smaller window over the summaries that carries state from chunk to chunk.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Sequence numbers per window task, which bounds the rows of a task.
CHUNK = 1_000_000
# Rows that a task is dealt where they are counted first. Shuffled rows are small and may be millions in the 64 MB that
# Spark gives a task, which then holds them unpacked in its sorts.
TASK_ROWS = 250_000
# Tasks that unbounded map tasks deal to. For more, each would sort what it writes, in its memory.
MOST_TASKS = 200
# Groups that the newest rows of one key are split into before the last step.
SALTS = 512


@dataclass(frozen=True)
class Fold:
    """A value carried along the rows of a key.

    ``sum``: running total up to this row. ``last``: last non-null value up to this row.
    ``lag``: value of the row before, null values included. With ``before``, a sum or last value leaves this
    row out.
    """

    kind: str
    column: Column
    before: bool = False


@dataclass(frozen=True)
class Extent:
    """What is known of a sequence before it is run through; by default nothing.

    ``tasks``: how many tasks its rows are dealt to; by default, as many as Spark makes of its shuffle partitions.
    ``single``: all numbers are in one chunk, so that nothing is carried.
    """

    tasks: int | None = None
    single: bool = False


def extent(df: DataFrame, order: str, width: int = CHUNK, per_task: int = TASK_ROWS) -> Extent:
    """Count the rows of a sequence and its chunks, in one pass over ``order``."""
    chunk = F.call_function("div", F.col(order), F.lit(width))
    counts = F.count("*").alias("rows"), F.count(order).alias("numbered")
    seen = df.agg(*counts, F.min(chunk).alias("lowest"), F.max(chunk).alias("highest")).first()
    tasks = math.ceil(seen.rows / per_task)
    single = seen.numbered == seen.rows and seen.lowest == seen.highest
    return Extent(tasks if tasks > 1 else None, single)


def dealt(df: DataFrame, keys: Sequence[str], per_task: int, most: int = MOST_TASKS) -> DataFrame:
    """The rows, with those of a key in one partition and about ``per_task`` in each, as far as ``most`` of them allow."""
    tasks = min(math.ceil(df.count() / per_task), most)
    return df.repartition(tasks, *keys) if tasks > 1 else df


def running(
    df: DataFrame,
    keys: Sequence[str],
    order: str,
    folds: Mapping[str, Fold],
    width: int = CHUNK,
    backwards: bool = False,
    levels: int = 1,
    known: Extent | None = None,
    chunks: str | None = None,
) -> DataFrame:
    """Add one column per fold, computed along ``order`` within ``keys``.

    ``order`` is an integer sequence, unique within its keys; keys are not null. No task holds more than
    ``width`` rows of a key; the summaries are at most one row per ``width`` numbers. ``backwards`` folds from
    the highest number down.

    For a sequence with few rows per ``width`` numbers (timestamps, say) take a larger width, or ``levels=2``:
    the summaries are then summed up in chunks in their turn, which leaves at most a few million rows to the last
    window for any 64-bit sequence and the default width.

    ``known`` is the ``extent`` of ``df`` for this width, or nothing. ``chunks`` names a column for the chunk: rows of a
    (key, chunk) are in one partition of the result.
    """
    known = known or Extent()
    chunk = f"_chunk{levels}"
    inputs = {name: f"_in_{name}" for name in folds}
    rows = df.select(
        "*",
        F.call_function("div", F.col(order), F.lit(width)).alias(chunk),
        *[fold.column.alias(inputs[name]) for name, fold in folds.items()],
    )

    # In one chunk, the keys alone say which rows belong together, also to what follows.
    together = list(keys) if known.single else [*keys, chunk]
    tasks = known.tasks
    if tasks and not known.single:  # with fewer than its own, Spark would shuffle the rows once more for the join
        tasks = max(tasks, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    spread = rows.repartition(tasks, *together) if tasks else rows
    if known.single:
        joined = spread.select("*", *[F.lit(None).alias(f"_carry_{name}") for name in folds])
    else:
        joined = _carried(rows, spread, keys, order, folds, width, backwards, levels)

    inside = W.partitionBy(*together).orderBy(F.col(order).desc() if backwards else F.col(order).asc())
    out = []
    for name, fold in folds.items():
        value, carry = F.col(inputs[name]), F.col(f"_carry_{name}")
        so_far = inside.rowsBetween(W.unboundedPreceding, -1 if fold.before else W.currentRow)
        if fold.kind == "sum":
            # A null means that there was no value at all so far.
            local = F.sum(value).over(so_far)
            combined = F.coalesce(local + carry, local, carry)
        elif fold.kind == "last":
            combined = F.coalesce(F.last(value, ignorenulls=True).over(so_far), carry)
        else:
            first = F.lag(F.lit(True)).over(inside).isNull()
            combined = F.when(first, carry).otherwise(F.lag(value).over(inside))
        out.append(combined.alias(name))
    kept = [F.col(chunk).alias(chunks)] if chunks else []
    return joined.select(*[F.col(column) for column in df.columns], *kept, *out)


def _carried(
    rows: DataFrame,
    spread: DataFrame,
    keys: Sequence[str],
    order: str,
    folds: Mapping[str, Fold],
    width: int,
    backwards: bool,
    levels: int,
) -> DataFrame:
    """The spread rows with what earlier chunks hand to theirs, from summaries of the rows as they came."""
    chunk = f"_chunk{levels}"
    newest = F.min_by if backwards else F.max_by
    totals = []
    for name, fold in folds.items():
        value = F.col(f"_in_{name}")
        if fold.kind == "sum":
            total = F.sum(value)
        elif fold.kind == "last":
            total = newest(value, F.when(value.isNotNull(), F.col(order)))
        elif fold.kind == "lag":
            total = newest(value, F.col(order))
        else:
            raise ValueError(f"unknown fold: {fold.kind}")
        totals.append(total.alias(name))
    summaries = rows.groupBy(*keys, chunk).agg(*totals)

    if levels > 1:
        above = {f"_carry_{name}": Fold(fold.kind, F.col(name), before=True) for name, fold in folds.items()}
        carried = running(summaries, keys, chunk, above, width, backwards, levels - 1)
    else:
        across = W.partitionBy(*keys).orderBy(F.col(chunk).desc() if backwards else F.col(chunk).asc())
        before = across.rowsBetween(W.unboundedPreceding, -1)
        carries = {
            "sum": lambda name: F.sum(name).over(before),
            "last": lambda name: F.last(name, ignorenulls=True).over(before),
            "lag": lambda name: F.lag(name).over(across),
        }
        found = [carries[fold.kind](name).alias(f"_carry_{name}") for name, fold in folds.items()]
        # Only what lies in several chunks has something to carry: a key within one needs nothing from here.
        begun = F.lag(F.lit(True)).over(across).isNotNull()
        carried = summaries.select(*keys, chunk, *found, begun.alias("_begun")).filter("_begun").drop("_begun")
    carried = carried.select(
        *[F.col(key).alias(f"_key_{key}") for key in [*keys, chunk]], *[f"_carry_{name}" for name in folds]
    )
    # Plain equality, so that the window below finds its partitioning already there.
    same = reduce(and_, [F.col(key) == F.col(f"_key_{key}") for key in [*keys, chunk]])
    return spread.join(carried, same, "left")


def newest_rows(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], n: int, salts: int = SALTS
) -> DataFrame:
    """The ``n`` rows of each key that come last in ``order``.

    First per key and group of input partitions, then per key over what is left. Each map task sends at most
    ``n`` rows per key (Catalyst pushes the limit below the shuffle) and no task of the last step gets more
    than ``n * salts`` rows per key.
    """
    newest_first = [F.col(column).desc() for column in order]
    salted = df.withColumn("_salt", F.spark_partition_id() % salts)
    for by in ([*keys, "_salt"], list(keys)):
        rank = F.row_number().over(W.partitionBy(*by).orderBy(*newest_first))
        salted = salted.withColumn("_rank", rank).filter(F.col("_rank") <= n).drop("_rank")
    return salted.drop("_salt")


def latest_by(df: DataFrame, keys: Sequence[str], order: str, also: Sequence[Column] = ()) -> DataFrame:
    """The row of each key with the highest ``order`` (unique within the key): the last write wins.

    Aggregates before the shuffle, so a hot key sends one row per map task. With fixed-width columns the
    aggregation needs no sort. ``also`` are more aggregates of the key, added as columns.
    """
    others = [field for field in df.schema.fields if field.name not in keys]
    if all(isinstance(field.dataType, _FIXED) for field in others):
        picked = [F.max_by(field.name, order).alias(field.name) for field in others]
        rows = df.groupBy(*keys).agg(*picked, *also)
    else:
        whole = F.max_by(F.struct(*[field.name for field in others]), order).alias("_row")
        rows = df.groupBy(*keys).agg(whole, *also).select("*", "_row.*").drop("_row")
    extra = [name for name in rows.columns if name not in df.columns]
    return rows.select(*df.columns, *extra)


_FIXED = (
    T.BooleanType,
    T.ByteType,
    T.ShortType,
    T.IntegerType,
    T.LongType,
    T.FloatType,
    T.DoubleType,
    T.DateType,
    T.TimestampType,
    T.TimestampNTZType,
)
