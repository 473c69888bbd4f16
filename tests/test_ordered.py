"""Ordered state: the chunked form equals a plain loop, whatever the chunk width, order of rows or hot key."""

import random

import pytest
from pyspark.sql import functions as F

from opsframe.operators.ordered import Extent, Fold, dealt, extent, latest_by, newest_rows, running


def rows_with_a_hot_key(n=400, seed=5):
    """Half of the rows belong to one key; sequences have gaps; some values are missing."""
    rng = random.Random(seed)
    rows, seq = [], 0
    for _ in range(n):
        seq += rng.choice([1, 1, 1, 2, 40])
        key = "hot" if rng.random() < 0.5 else f"k{rng.randrange(20)}"
        rows.append((key, seq, rng.choice([None, rng.randrange(100)])))
    rng.shuffle(rows)
    return rows


def by_hand(rows, backwards):
    state, out = {}, {}
    for key, seq, value in sorted(rows, key=lambda r: r[1], reverse=backwards):
        total, last, before = state.get(key, (None, None, None))
        if value is not None:
            total, last = (total or 0) + value, value
        out[(key, seq)] = (total, last, before)
        state[key] = (total, last, value)
    return out


@pytest.mark.parametrize("width", [1, 7, 100, 1_000_000])
@pytest.mark.parametrize("backwards", [False, True])
@pytest.mark.parametrize("levels", [1, 2])
def test_running(spark, width, backwards, levels):
    rows = rows_with_a_hot_key()
    df = spark.createDataFrame(rows, "k STRING, seq BIGINT, v BIGINT").repartition(5)
    value = F.col("v")
    folds = {"total": Fold("sum", value), "last": Fold("last", value), "before": Fold("lag", value)}
    got = running(df, ["k"], "seq", folds, width, backwards, levels).collect()
    assert {(r.k, r.seq): (r.total, r.last, r.before) for r in got} == by_hand(rows, backwards)
    assert len(got) == len(rows)


@pytest.mark.parametrize("n", [1, 3, 1000])
@pytest.mark.parametrize("salts", [1, 4])
def test_newest_rows(spark, n, salts):
    rows = rows_with_a_hot_key()
    df = spark.createDataFrame(rows, "k STRING, seq BIGINT, v BIGINT").repartition(9)
    got = {(r.k, r.seq) for r in newest_rows(df, ["k"], ["seq"], n, salts).collect()}
    want = set()
    for key in {r[0] for r in rows}:
        want |= {(key, seq) for seq in sorted((r[1] for r in rows if r[0] == key), reverse=True)[:n]}
    assert got == want


def test_newest_rows_limits_before_the_shuffle(spark):
    df = spark.createDataFrame(rows_with_a_hot_key(), "k STRING, seq BIGINT, v BIGINT")
    plan = newest_rows(df, ["k"], ["seq"], 3)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Partial") == 2 and plan.count("WindowGroupLimit") == 4


def test_latest_by(spark):
    fixed = spark.createDataFrame([("a", 1, 5), ("a", 3, None), ("a", 2, 7), ("b", 1, 1)], "id STRING, seq INT, v INT")
    assert {tuple(r) for r in latest_by(fixed, ["id"], "seq").collect()} == {("a", 3, None), ("b", 1, 1)}
    assert "SortAggregate" not in latest_by(fixed, ["id"], "seq")._jdf.queryExecution().executedPlan().toString()
    text = spark.createDataFrame([("a", 1, "x"), ("a", 2, None)], "id STRING, seq INT, v STRING")
    assert [tuple(r) for r in latest_by(text, ["id"], "seq").collect()] == [("a", 2, None)]


def test_a_hot_key_is_spread_over_tasks(spark):
    """Half of the rows have one key, and still no task gets half of them."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        df = spark.range(40_000).select(
            F.when(F.col("id") % 2 == 0, "hot").otherwise(F.concat(F.lit("k"), F.col("id") % 50)).alias("k"),
            F.col("id").alias("seq"),
        )
        done = running(df, ["k"], "seq", {"n": Fold("sum", F.lit(1))}, 500)
        shares = [r["count"] for r in done.groupBy(F.spark_partition_id()).count().collect()]
        assert sum(shares) == 40_000 and max(shares) < 10_000
        assert done.filter("k = 'hot'").agg(F.max("n")).first()[0] == 20_000
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


@pytest.mark.parametrize("width", [7, 100, 1_000_000])
def test_running_over_a_counted_sequence(spark, width):
    rows = rows_with_a_hot_key()
    df = spark.createDataFrame(rows, "k STRING, seq BIGINT, v BIGINT").repartition(5)
    known = extent(df, "seq", width, per_task=30)
    assert known == Extent(14, width == 1_000_000)
    value = F.col("v")
    folds = {"total": Fold("sum", value), "last": Fold("last", value), "before": Fold("lag", value)}
    for backwards in (False, True):
        got = running(df, ["k"], "seq", folds, width, backwards, known=known, chunks="chunk")
        assert {(r.k, r.seq): (r.total, r.last, r.before) for r in got.collect()} == by_hand(rows, backwards)
        places = got.select("k", "chunk", F.spark_partition_id()).distinct().collect()
        assert len(places) == len({(r.k, r.chunk) for r in places})
        assert got.select(F.spark_partition_id()).distinct().count() > 5
    # Fewer tasks than shuffle partitions would be shuffled once more where the join is a merge join.
    few = running(df, ["k"], "seq", folds, width, known=Extent(2, known.single))
    tasks = 2 if known.single else int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert f", {tasks}), REPARTITION_BY_NUM" in few._jdf.queryExecution().executedPlan().toString()


def test_rows_are_dealt_by_their_number(spark):
    df = spark.range(1000).select((F.col("id") % 100).alias("k"), "id")
    for per_task, most, tasks in [(50, 200, 20), (50, 8, 8), (1000, 200, None)]:
        got = dealt(df, ["k"], per_task, most)
        assert got.rdd.getNumPartitions() == (tasks or df.rdd.getNumPartitions())
        assert got.agg(F.count("*"), F.sum("id")).first()[:] == (1000, 499500)
        if tasks:
            assert got.select("k", F.spark_partition_id()).distinct().count() == 100
