"""Streams: one file per micro-batch gives the batch result, also across restarts and repeated batches."""

import os

import pytest
from pyspark.sql import functions as F

from opsframe.operators import logs, status
from opsframe.plans import registry, views
from opsframe.streaming import live
from opsframe.streaming.segments import Segments

FILES = 6


def cut(spark, sf_dir, place, view):
    """A view of the events cut into files in the order of its sequence, and a stream of one file per batch."""
    full = registry.Inputs(spark, sf_dir)[view]
    total = full.count()
    for n in range(FILES):
        part = full.filter((F.col("seq") >= n * total // FILES) & (F.col("seq") < (n + 1) * total // FILES))
        part.coalesce(1).write.mode("append").parquet(f"{place}/in")
    # One batch per file, in the order of writing.
    stream = spark.readStream.schema(full.schema).option("maxFilesPerTrigger", 1).parquet(f"{place}/in")
    return full, stream


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_ring_buffer(spark, sf_dir, place):
    full, stream = cut(spark, sf_dir, place, "log_lines")
    running, state = live.ring_buffer(stream, f"{place}/q", 20)
    running.awaitTermination()
    assert state.last == FILES - 1
    assert rows(state.now()) == rows(logs.ring_buffer(full, 20))


def test_latest_status(spark, sf_dir, place):
    full, stream = cut(spark, sf_dir, place, "status")
    live.latest_status(stream.select("id", "seq", "running", "pid"), f"{place}/q").awaitTermination()
    want = status.latest_status(full.select("id", "seq", "running", "pid"))
    assert rows(live.read_latest(spark, f"{place}/q")) == rows(want)


def test_log_levels_and_follow(spark, sf_dir, place):
    full, stream = cut(spark, sf_dir, place, "log_lines")
    live.to_table(live.log_levels(stream, "error"), f"{place}/c1", f"{place}/o1").awaitTermination()
    want = logs.console_filter(logs.classify_level(full), "error")
    assert rows(spark.read.parquet(f"{place}/o1")) == rows(want)
    live.follow(stream, f"{place}/f")[0].awaitTermination()
    assert rows(spark.read.parquet(f"{place}/f/out").drop("batch")) == rows(full)


def test_follow_takes_only_new_lines(spark, place):
    kinds = "service STRING, seq BIGINT, ts TIMESTAMP_NTZ"
    put = lambda *seqs: spark.createDataFrame(
        [("a", n) for n in seqs], "service STRING, seq BIGINT"
    ).withColumn("ts", F.timestamp_seconds(F.lit(1_700_000_000) + F.col("seq")).cast("timestamp_ntz")).coalesce(
        1
    ).write.mode("append").parquet(f"{place}/in")
    put(1, 2, 3)
    for more in ((), (3, 4), ()):
        if more:
            put(*more)
        stream = spark.readStream.schema(kinds).parquet(f"{place}/in")
        live.follow(stream, place)[0].awaitTermination()
    assert sorted(r.seq for r in spark.read.parquet(f"{place}/out").collect()) == [1, 2, 3, 4]


def test_follow_loses_no_late_service(spark, place):
    kinds = "service STRING, seq BIGINT, ts TIMESTAMP_NTZ"
    for service, second in (("a", 60), ("b", 5)):
        line = spark.sql(f"SELECT '{service}' AS service, 1L AS seq, timestamp_ntz'2024-01-01' + INTERVAL {second} SECOND AS ts")
        line.write.mode("append").parquet(f"{place}/in")
        running, state = live.follow(spark.readStream.schema(kinds).parquet(f"{place}/in"), place)
        running.awaitTermination()
    assert sorted(r.service for r in spark.read.parquet(f"{place}/out").collect()) == ["a", "b"]
    # A restart without new lines still knows the state.
    _, again = live.follow(spark.readStream.schema(kinds).parquet(f"{place}/in"), place)
    assert again.now().count() == 2


@pytest.mark.parametrize("width", [5, 1_000_000])
def test_state_flips(spark, sf_dir, place, width):
    full, stream = cut(spark, sf_dir, place, "status")
    running, _ = live.state_flips(stream, f"{place}/q", width=width)
    running.awaitTermination()
    want = status.state_flips(full.select("id", "seq", "running"))
    assert rows(spark.read.parquet(f"{place}/q/out").drop("batch")) == rows(want)


def test_first_match(spark, sf_dir, place):
    full, stream = cut(spark, sf_dir, place, "log_lines")
    match = F.regexp_extract("text", r"token=(\w+)", 1)
    restart = F.col("text").startswith("arrancado con PID 1")
    running, _ = live.first_match(stream, f"{place}/q", match, restart)
    running.awaitTermination()
    want = logs.first_match_wins(full, match, restart)
    assert rows(spark.read.parquet(f"{place}/q/out").drop("batch")) == rows(want)


@pytest.mark.parametrize("budget", [3600, 6 * 3600])
def test_time_to_healthy(spark, sf_dir, place, budget):
    full, stream = cut(spark, sf_dir, place, "status")
    running, state = live.time_to_healthy(stream, f"{place}/q", budget)
    running.awaitTermination()
    want = {(r.id, r.seq): (r.outcome, r.seconds) for r in status.time_to_healthy(full, budget).collect()}
    got = {(r.id, r.seq): (r.outcome, r.seconds) for r in spark.read.parquet(f"{place}/q/out").collect()}
    still = {(r.id, r.seq) for r in state.now().collect()}
    assert not still & set(got)
    assert set(got) | still == set(want)
    assert all(want[key] == value for key, value in got.items())
    assert all(want[key] == ("timeout", None) for key in still)
    assert any(value[0] == "timeout" for value in got.values())


def test_tick_windows(spark, sf_dir, place):
    full, stream = cut(spark, sf_dir, place, "telemetry")
    samples = stream.select("ts", "host", F.col("used_bytes").alias("value"))
    live.tick_windows(samples, place, every="1 day").awaitTermination()
    assert rows(live.read_ticks(spark, place)) == rows(day_windows(full))


def day_windows(full):
    day = F.date_trunc("day", "ts").cast("timestamp_ntz")
    return full.groupBy(day.alias("start"), "host").agg(
        F.max_by("used_bytes", "ts").alias("last"),
        (F.sum("used_bytes") / F.count("used_bytes")).alias("mean"),
        F.max("used_bytes").alias("largest"),
    )


def test_late_rows_correct_their_windows(spark, sf_dir, place):
    full = registry.Inputs(spark, sf_dir)["telemetry"]
    middle = full.selectExpr("percentile_approx(unix_seconds(cast(ts AS timestamp)), 0.5)").first()[0]
    older = F.unix_seconds(F.col("ts").cast("timestamp")) < middle
    # The newer half of all rows first, then the other, which is hours older, and in the same windows in part.
    for part in (full.filter(~older), full.filter(older)):
        part.write.mode("append").parquet(f"{place}/in")
        stream = spark.readStream.schema(full.schema).option("maxFilesPerTrigger", 3).parquet(f"{place}/in")
        samples = stream.select("ts", "host", F.col("used_bytes").alias("value"))
        live.tick_windows(samples, place, every="1 day").awaitTermination()
    assert rows(live.read_ticks(spark, place)) == rows(day_windows(full))


def test_latest_and_newest_take_rows_in_any_order(spark, sf_dir, place):
    full = registry.Inputs(spark, sf_dir)["status"].select("id", "seq", "running", "pid")
    half = full.count() // 2
    for part in (F.col("seq") >= half, F.col("seq") < half):
        full.filter(part).write.mode("append").parquet(f"{place}/in")
        stream = spark.readStream.schema(full.schema).option("maxFilesPerTrigger", 1).parquet(f"{place}/in")
        live.latest_status(stream, f"{place}/q").awaitTermination()
    assert rows(live.read_latest(spark, f"{place}/q")) == rows(status.latest_status(full))


def test_segments_hold_what_was_written(spark, place):
    schema = "k BIGINT, v BIGINT"
    merge = lambda rows, whole: rows.groupBy("k").agg(F.max("v").alias("v"))
    state = Segments(spark, place, schema, merge, fan=2)
    want, sizes = {}, []
    for n in range(13):
        assert {r.k: r.v for r in state.before(n).collect()} == want
        for _ in range(2 if n in (3, 7, 8) else 1):  # a batch that runs again
            state.write(n, spark.createDataFrame([(n % 5, n), (100 + n, n)], schema))
        want |= {n % 5: n, 100 + n: n}
        sizes.append(len(state.spans(n + 1)))
    assert {r.k: r.v for r in Segments(spark, place, schema, merge, fan=2).now().collect()} == want
    assert max(sizes) <= 4
    assert [len(Segments(spark, place, schema, merge).spans(n)) <= 7 * 4 for n in (1, 63, 64, 1_000, 4_095)] == [True] * 5
    # Merged parts are gone once the next batch has begun.
    there = sorted(os.path.join(level, first) for level in os.listdir(place) for first in os.listdir(f"{place}/{level}"))
    assert len([x for x in there if x.startswith("level=")]) <= len(state.spans(13)) + 4


def test_a_batch_writes_what_it_changed(spark, place):
    many = spark.range(20_000).select(F.concat(F.lit("h"), "id").alias("id"), F.col("id").alias("seq"), F.lit(True).alias("running"))
    many.coalesce(1).write.parquet(f"{place}/in")
    few = many.limit(3).withColumn("seq", F.col("seq") + 100_000).withColumn("running", F.lit(False))

    def run():
        stream = spark.readStream.schema(many.schema).parquet(f"{place}/in")
        live.state_flips(stream, f"{place}/q")[0].awaitTermination()

    run()
    few.coalesce(1).write.mode("append").parquet(f"{place}/in")
    run()
    assert spark.read.parquet(f"{place}/q/state/level=0/from=0").count() == 20_000
    assert spark.read.parquet(f"{place}/q/state/level=0/from=1").count() == 3
    assert spark.read.parquet(f"{place}/q/out").count() == 20_003


def test_time_to_healthy_in_three_runs(spark, sf_dir, place):
    full = registry.Inputs(spark, sf_dir)["status"].select("id", "seq", "sample_ts", "is_start", "running", "healthy")
    total, budget = full.count(), 3600
    for n in range(3):
        part = full.filter((F.col("seq") >= n * total // 3) & (F.col("seq") < (n + 1) * total // 3))
        part.coalesce(1).write.mode("append").parquet(f"{place}/in")
        stream = spark.readStream.schema(full.schema).parquet(f"{place}/in")
        running, state = live.time_to_healthy(stream, f"{place}/q", budget)
        running.awaitTermination()
    want = {(r.id, r.seq): (r.outcome, r.seconds) for r in status.time_to_healthy(full, budget).collect()}
    decided = spark.read.parquet(f"{place}/q/out").collect()
    got = {(r.id, r.seq): (r.outcome, r.seconds) for r in decided}
    still = {(r.id, r.seq) for r in state.now().collect()}
    assert len(decided) == len(got) and not still & set(got) and set(got) | still == set(want)
    assert all(want[key] == value for key, value in got.items())
    # What a batch keeps is what it opens and closes, not all that is open.
    first, second = (spark.read.parquet(f"{place}/q/state/level=0/from={n}") for n in (0, 1))
    assert first.filter("closed").count() == 0 and second.filter("closed").count() <= first.count()


def test_fan_out(spark, sf_dir, place):
    full, stream = cut(spark, sf_dir, place, "log_lines")
    extra = F.when(F.col("text").startswith("[heal]"), "repair")
    sinks = F.array_compact(F.array(F.when(F.col("service") == "purchase", "ex-7").otherwise(F.col("service")), extra))
    live.fan_out(stream.withColumn("topics", F.transform(sinks, live.topic_of)), f"{place}/q").awaitTermination()
    assert spark.read.parquet(f"{place}/q/log").count() == full.count()
    wanted = {
        "service:error:log": "service = 'error'",
        "exercise:7:log": "service = 'purchase'",
        "service:repair:log": "text LIKE '[heal]%'",
    }
    for topic, where in wanted.items():
        delivered, until = live.subscribe(spark, f"{place}/q", topic)
        assert rows(delivered.select("seq", "text")) == rows(full.filter(where).select("seq", "text"))
        assert until == FILES - 1 and live.subscribe(spark, f"{place}/q", topic, until) == (None, until)
    assert live.subscribe(spark, f"{place}/q", "service:none:log") == (None, -1)


def test_a_subscriber_reads_on_after_restarts(spark, place):
    kinds = "service STRING, seq BIGINT, topics ARRAY<STRING>"
    got, until = [], -1
    for n in range(4):
        rows_ = [("a", 2 * n, ["x", "y", "x"]), ("a", 2 * n + 1, ["y"] if n % 2 else None)]
        spark.createDataFrame(rows_, kinds).coalesce(1).write.mode("append").parquet(f"{place}/in")
        live.fan_out(spark.readStream.schema(kinds).parquet(f"{place}/in"), f"{place}/q").awaitTermination()
        if n == 2:  # without its commit the batch is delivered once more
            for commit in ("2", ".2.crc"):
                os.remove(f"{place}/q/checkpoint/commits/{commit}")
            live.fan_out(spark.readStream.schema(kinds).parquet(f"{place}/in"), f"{place}/q").awaitTermination()
        if n != 1:
            found, until = live.subscribe(spark, f"{place}/q", "y", until)
            got += [r.seq for r in found.collect()]
    assert sorted(got) == [0, 2, 3, 4, 6, 7]


def test_a_restart_goes_on_and_a_repeated_batch_changes_nothing(spark, sf_dir, place):
    full = registry.Inputs(spark, sf_dir)["status"].select("id", "seq", "running")
    half = full.count() // 2

    def run():
        stream = spark.readStream.schema(full.schema).parquet(f"{place}/in")
        live.state_flips(stream, f"{place}/q")[0].awaitTermination()
        return rows(spark.read.parquet(f"{place}/q/out").drop("batch"))

    full.filter(F.col("seq") < half).coalesce(1).write.mode("append").parquet(f"{place}/in")
    run()
    full.filter(F.col("seq") >= half).coalesce(1).write.mode("append").parquet(f"{place}/in")
    want = rows(status.state_flips(full))
    assert run() == want
    # Without its commit the last batch runs once more.
    commits = f"{place}/q/checkpoint/commits"
    for commit in ("1", ".1.crc"):
        os.remove(os.path.join(commits, commit))
    assert run() == want


def test_views_have_the_same_rows_in_sql(spark, sf_dir):
    for name in ("telemetry", "steps"):
        by_text = views.select(spark, sf_dir, views.VIEWS[name])
        assert rows(by_text) == rows(views.view(spark, sf_dir, name).select(*by_text.columns))
