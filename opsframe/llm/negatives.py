"""Hard negatives by a secondary sort: pairs keyed by (anchor, descending score, id), read as a stream.

Anchors are the rows that ``is_anchor`` marks. Of an anchor's rows in order of score (an integer inner product; ties by
the smaller id), the first ``positives`` of its label open a window of scores each, and each window takes the first
``negatives`` rows of other labels in it. Scores fall along the stream, so a window opens before its first negative
comes, and the iterator keeps no more than an anchor's open windows: neither an anchor's pairs nor its negatives meet in
memory. At equal scores positives come first, because a positive of score 0 takes negatives of score 0.

Pairs are scored in blocks: anchors in blocks of ``ANCHORS`` rows that go to all tasks, against all rows where these lie,
so rows are never shuffled or copied. Before the shuffle each task reduces its own rows without loss: for positives to
an anchor's first few, then, once the windows are known, to the first few of each window. Both are exact, since what is
not among the first of its own task can't be among the first of all. What goes to the driver is one block of anchors
and its windows at a time. The number of blocks grows with the anchors, as every anchor is compared with every row.

Nulls: a row with a null id, label or vector, or any null or non-finite component, takes no part. Rows that repeat an id
each count, as anchors too; rows with the anchor's own id are not its positives. Components become floor(256 x); vectors
of unequal length are compared as if the shorter went on in zeros. Scores are exact; where one is beyond a 64-bit integer,
the nearest 64-bit integer stands for it. Equal vectors tie by id. An empty table gives an empty result; other columns
are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from opsframe.llm.common import numbered, settle, shared_folder, ship

ship(__name__)

ANCHORS = 4_096  # anchors that are scored at once
CELLS = 1 << 21  # scores that a task holds at once
SCALE = 256
LEAST, MOST = -(2**63), 2**63 - 1
EXACT = 2.0**53  # whole numbers below it are exact as doubles

PAIRS = "anchor_no BIGINT, anchor_id BIGINT, score BIGINT, negative BOOLEAN, vec_id BIGINT"
FOUND = "anchor_id BIGINT, positive_id BIGINT, rank INT, negative_id BIGINT, positive_score BIGINT, negative_score BIGINT"


def usable(vectors: DataFrame, label: Column) -> DataFrame:
    """(vec_id, label, embedding) of the rows that may take part; ``decoded`` looks at their components."""
    rows = vectors.select(F.col("vec_id").cast("bigint").alias("vec_id"), label.cast("bigint").alias("label"), "embedding")
    return rows.na.drop(subset=["vec_id", "label", "embedding"])


def decoded(ids: pa.Array, labels: pa.Array, vectors: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ids, labels and vectors without the rows that have a null or non-finite component.

    Vectors are rows of floor(256 x), short ones with zeros behind them: doubles, or Python integers where 256 x is too
    large for a double.
    """
    values = vectors.flatten()
    flat = values.to_numpy(zero_copy_only=False).astype(np.float64)  # null: NaN
    n = np.asarray(vectors.value_lengths()).astype(np.int64)
    bad = np.append(0, np.cumsum(~np.isfinite(flat)))
    ends = np.cumsum(n)
    keep = bad[ends] == bad[ends - n]
    wide = int(n[keep].max(initial=0))
    flat = flat[np.repeat(keep, n)]
    with np.errstate(over="ignore"):
        scaled = np.floor(SCALE * flat)
    if not np.isfinite(scaled).all():
        scaled = np.array([int(x) if np.isfinite(x) else int(y) * SCALE for x, y in zip(scaled.tolist(), flat.tolist())], object)
    matrix = np.zeros((int(keep.sum()), wide), scaled.dtype)
    matrix[np.arange(wide)[None, :] < n[keep][:, None]] = scaled
    return np.asarray(ids)[keep].astype(np.int64), np.asarray(labels)[keep].astype(np.int64), matrix


def doubles(matrix: np.ndarray) -> np.ndarray:
    """As doubles, the nearest to what is too large for one."""
    return np.clip(matrix, -1e300, 1e300).astype(np.float64) if matrix.dtype == object else matrix


def scores(rows: np.ndarray, anchors: np.ndarray) -> np.ndarray:
    """Inner products of all rows with all anchors as 64-bit integers, exact or at the end of their range."""
    wide = min(rows.shape[1], anchors.shape[1])
    rows, anchors = rows[:, :wide], anchors[:, :wide]
    a, b = doubles(rows), doubles(anchors)
    with np.errstate(all="ignore"):
        out = (a @ b.T).astype(np.int64)
        bound = wide * np.abs(a).max(axis=1, initial=0.0)[:, None] * np.abs(b).max(axis=1, initial=0.0)[None, :]
    for r, c in np.argwhere(bound >= EXACT).tolist():  # rare: only what is too large for exact doubles
        total = sum(int(x) * int(y) for x, y in zip(rows[r].tolist(), anchors[c].tolist()))
        out[r, c] = min(max(total, LEAST), MOST)
    return out


def window(score: int) -> tuple[int, int]:
    """The scores n with 30 score <= 100 n <= 90 score (none if the first is above the second)."""
    return -(-3 * score // 10), 9 * score // 10


class Best:
    """The first ``keep`` pairs of each group by falling score and rising id, over blocks of pairs."""

    def __init__(self, groups: int, keep: int):
        self.keep = keep
        self.pairs = np.zeros((4, 0), np.int64)  # group, score, id, and the row's place in its task
        self.least = np.full(groups, LEAST, np.int64)  # a pair below it is not among the first

    def add(self, group: np.ndarray, score: np.ndarray, ids: np.ndarray, at: np.ndarray) -> None:
        if not len(group):
            return
        group, score, ids, at = np.concatenate([self.pairs, np.stack([group, score, ids, at])], axis=1)
        order = np.lexsort((at, ids, ~score, group))  # ~x falls as x rises, without an overflow
        place = np.arange(len(order)) - np.searchsorted(group[order], group[order])
        order, last = order[place < self.keep], order[place == self.keep - 1]
        self.pairs = np.stack([group, score, ids, at])[:, order]
        self.least[group[last]] = score[last]


def blocks(batches: Iterator[pa.RecordBatch], anchors: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Ids, labels, vectors and places of batches (vec_id, label, embedding), as many rows as ``CELLS`` allows."""
    step, seen = max(1, CELLS // max(anchors, 1)), 0
    for batch in batches:
        for begin in range(0, len(batch), step):
            ids, labels, matrix = decoded(*batch.slice(begin, step).columns)
            yield ids, labels, matrix, seen + np.arange(len(ids))
            seen += len(ids)


def first_positives(rows: DataFrame, block, keep: int) -> DataFrame:
    """For each anchor of a broadcast block the first positives of each task."""

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        no, ids, labels, matrix = block.value
        best = Best(len(no), keep)
        for row_ids, row_labels, row_matrix, at in blocks(batches, len(no)):
            got = scores(row_matrix, matrix)
            fit = (row_labels[:, None] == labels[None, :]) & (row_ids[:, None] != ids[None, :]) & (got >= best.least[None, :])
            r, a = np.nonzero(fit)
            best.add(a, got[r, a], row_ids[r], at[r])
        yield pairs(no, ids, best.pairs, False)

    return rows.mapInArrow(score, PAIRS)


def first_negatives(rows: DataFrame, block, windows, keep: int) -> DataFrame:
    """For each window of the anchors of a block the first negatives of each task; a row in several windows comes once."""

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        no, ids, labels, matrix = block.value
        low, high = windows.value  # by window and anchor
        best = [Best(len(no), keep) for _ in range(len(low))]
        lowest, highest = low.min(axis=0, initial=MOST), high.max(axis=0, initial=LEAST)
        for row_ids, row_labels, row_matrix, at in blocks(batches, len(no)):
            got = scores(row_matrix, matrix)
            r, a = np.nonzero((row_labels[:, None] != labels[None, :]) & (got >= lowest[None, :]) & (got <= highest[None, :]))
            value = got[r, a]
            for k, own in enumerate(best):
                fit = (value >= low[k][a]) & (value <= high[k][a]) & (value >= own.least[a])
                own.add(a[fit], value[fit], row_ids[r[fit]], at[r[fit]])
        yield pairs(no, ids, np.unique(np.concatenate([own.pairs for own in best], axis=1), axis=1), True)

    return rows.mapInArrow(score, PAIRS)


def pairs(no: np.ndarray, ids: np.ndarray, best: np.ndarray, negative: bool) -> pa.RecordBatch:
    anchor, value, row, _ = best
    columns = [pa.array(no[anchor]), pa.array(ids[anchor]), pa.array(value), pa.array(np.full(len(row), negative)), pa.array(row)]
    return pa.RecordBatch.from_arrays(columns, ["anchor_no", "anchor_id", "score", "negative", "vec_id"])


def stream(negatives: int, positives: int):
    """The iterator over pairs in order of (anchor, descending score, positives first, id)."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, opened, seen = None, [], 0  # windows of the current anchor: [id, score, low, high, negatives so far]
        for batch in batches:
            out = []
            for no, anchor, value, negative, row in zip(*(column.to_pylist() for column in batch.columns)):
                if no != current:
                    current, opened, seen = no, [], 0
                if not negative:
                    if seen < positives:
                        opened.append([row, value, *window(value), 0])
                        seen += 1
                    continue
                done = False
                for own in opened:
                    if own[2] <= value <= own[3]:
                        own[4] += 1
                        out.append((anchor, own[0], own[4], row, own[1], value))
                    done |= own[4] >= negatives or value < own[2]
                if done:  # a full window, or one that the falling scores have left
                    opened = [own for own in opened if own[4] < negatives and value >= own[2]]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out)], names=NAMES).cast(KINDS)

    return emit


NAMES = ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
KINDS = pa.schema([(name, pa.int32() if name == "rank" else pa.int64()) for name in NAMES])


def hard_negatives(
    vectors: DataFrame,
    is_anchor: Column,
    label: Column | str = "label",
    positives: int = 5,
    negatives: int = 10,
    anchors_at_once: int = ANCHORS,
) -> DataFrame:
    """Rows (anchor_id, positive_id, rank, negative_id, positive_score, negative_score); ``rank`` counts from 1."""
    spark = vectors.sparkSession
    rows = usable(vectors, F.col(label) if isinstance(label, str) else label)
    anchors = numbered(rows.filter(is_anchor), "anchors", "no")
    place = shared_folder(spark, "pairs")
    spark.createDataFrame([], PAIRS).write.parquet(place)
    for first in range(0, anchors.count(), anchors_at_once):
        own = anchors.filter((F.col("no") >= first) & (F.col("no") < first + anchors_at_once)).orderBy("no").toArrow()
        numbers = own["no"].combine_chunks()
        # Places of rows stand for ids here, so that rows without finite components drop out of all three alike.
        at, labels, matrix = decoded(pa.array(np.arange(len(own))), own["label"].combine_chunks(), own["embedding"].combine_chunks())
        no, ids = np.asarray(numbers)[at].astype(np.int64), np.asarray(own["vec_id"].combine_chunks())[at].astype(np.int64)
        block = spark.sparkContext.broadcast((no, ids, labels, matrix))
        rank = F.row_number().over(Window.partitionBy("anchor_no").orderBy(F.desc("score"), "vec_id"))
        close = first_positives(rows, block, positives).withColumn("_rank", rank).filter(F.col("_rank") <= positives)
        close = settle(close, "positives")
        low, high = np.full((positives, len(no)), MOST, np.int64), np.full((positives, len(no)), LEAST, np.int64)
        for number, score, k in close.select("anchor_no", "score", "_rank").toLocalIterator():  # positives of one block
            a = int(np.searchsorted(no, number))
            low[k - 1, a], high[k - 1, a] = window(score)
        windows = spark.sparkContext.broadcast((low, high))
        far = first_negatives(rows, block, windows, negatives)
        close.drop("_rank").unionByName(far).write.mode("append").parquet(place)
        block.unpersist()
        windows.unpersist()
    found = spark.read.schema(PAIRS).parquet(place)
    ordered = found.repartition("anchor_no").sortWithinPartitions("anchor_no", F.desc("score"), "negative", "vec_id")
    return ordered.mapInArrow(stream(negatives, positives), FOUND)
