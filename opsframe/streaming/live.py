"""Streaming forms of the log, status and telemetry operators.

Stateless forms use Spark's own streaming operators. Forms that follow an order within a key (newest rows, flips, first
matches, time to healthy) run the batch operator on each micro-batch together with the state that its keys have: a hot
key is then split as in the batch form, where a keyed state function would put it into one Python task. State is a log
of segments (``segments``), outputs are written per batch id, so a replayed batch replaces its own output and what a
batch writes follows the batch. No micro-batch is cached. For the ordered forms, batches of a key are expected in the
order of its sequence; latest status, newest rows and tick windows take rows however late.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from opsframe.operators import logs, status
from opsframe.operators.ordered import CHUNK, latest_by, newest_rows
from opsframe.streaming.segments import Segments

# Period of the samples, and how late a row may come where a deadline has to be called.
TICK = "2 seconds"
LATENESS_SECONDS = 10

# Process what is there and stop. ``{"processingTime": "2 seconds"}`` goes on until the query is stopped.
ONCE = {"availableNow": True}


def schema_of(df: DataFrame) -> str:
    return ", ".join(f"`{name}` {kind}" for name, kind in df.dtypes)


def each_batch(
    stream: DataFrame, checkpoint: str, step: Callable[[DataFrame, int], None], trigger: Mapping = ONCE
) -> StreamingQuery:
    """Run a function on each micro-batch."""
    return stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(**trigger).start()


def to_table(stream: DataFrame, checkpoint: str, path: str, trigger: Mapping = ONCE) -> StreamingQuery:
    """Append a stream's rows to a table folder."""
    writer = stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint)
    return writer.outputMode("append").trigger(**trigger).start()


def _put(rows: DataFrame, out: str, batch: int) -> None:
    rows.write.mode("overwrite").parquet(f"{out}/batch={batch}")


def log_levels(lines: DataFrame, threshold: str = "all", query: str = "") -> DataFrame:
    """Lines classed and filtered as they arrive."""
    return logs.console_filter(logs.classify_level(lines), threshold, query)


def ring_buffer(
    lines: DataFrame, place: str, n: int = logs.RING_SIZE, trigger: Mapping = ONCE
) -> tuple[StreamingQuery, Segments]:
    """Newest ``n`` lines per service, kept up to date; a segment has the newest of its own batches."""
    size = n if n > 0 else logs.RING_SIZE

    def newest(rows: DataFrame, whole: bool = True) -> DataFrame:
        return newest_rows(rows, ["service"], ["ts", "seq"], size)

    state = Segments(lines.sparkSession, f"{place}/state", schema_of(lines), newest)

    def step(batch: DataFrame, number: int) -> None:
        state.write(number, newest(batch))

    return each_batch(lines, f"{place}/checkpoint", step, trigger), state


def _latest(rows: DataFrame, whole: bool = True) -> DataFrame:
    return latest_by(rows, ["id"], "seq")


def latest_status(samples: DataFrame, place: str, trigger: Mapping = ONCE) -> StreamingQuery:
    """Latest status per id: each batch adds the latest of its own ids. ``read_latest`` gives the table."""
    state = Segments(samples.sparkSession, f"{place}/state", schema_of(samples), _latest)

    def step(batch: DataFrame, number: int) -> None:
        state.write(number, _latest(batch))

    return each_batch(samples, f"{place}/checkpoint", step, trigger)


def read_latest(spark: SparkSession, place: str) -> DataFrame:
    return Segments(spark, f"{place}/state", None, _latest).now()


def tick_windows(
    samples: DataFrame, place: str, value: str = "value", every: str = TICK, trigger: Mapping = ONCE
) -> StreamingQuery:
    """Last, mean and largest value per host and tick, of samples (ts, host, value); ``read_ticks`` gives the table.

    Each batch adds its partial values per window and host. They are brought together when they are read, so a row
    corrects its window however late it comes.
    """
    state = Segments(samples.sparkSession, f"{place}/state", None, _ticks)

    def step(batch: DataFrame, number: int) -> None:
        timed = batch.withColumn("_ts", F.col("ts").cast("timestamp"))
        partial = timed.groupBy(F.window("_ts", every).alias("_window"), "host").agg(
            F.max_by(value, "_ts").alias("last"),
            F.max("_ts").alias("last_ts"),
            F.count(value).alias("samples"),
            F.sum(value).alias("total"),
            F.max(value).alias("largest"),
        )
        start = F.col("_window.start").cast("timestamp_ntz").alias("start")
        state.write(number, partial.select(start, *[c for c in partial.columns if c != "_window"]))

    return each_batch(samples, f"{place}/checkpoint", step, trigger)


def _ticks(partial: DataFrame, whole: bool = True) -> DataFrame:
    return partial.groupBy("start", "host").agg(
        F.max_by("last", "last_ts").alias("last"),
        F.max("last_ts").alias("last_ts"),
        F.sum("samples").alias("samples"),
        F.sum("total").alias("total"),
        F.max("largest").alias("largest"),
    )


def read_ticks(spark: SparkSession, place: str) -> DataFrame:
    """All windows: start, host, last, mean, largest."""
    ticks = Segments(spark, f"{place}/state", None, _ticks).now()
    return ticks.select("start", "host", "last", (F.col("total") / F.col("samples")).alias("mean"), "largest")


OPEN_STARTS = "id STRING, seq BIGINT, sample_ts TIMESTAMP_NTZ, opened BOOLEAN, closed BOOLEAN"


def _open_starts(rows: DataFrame, whole: bool) -> DataFrame:
    """A start that is opened and closed among the rows is gone; a close waits for its opening in an older segment."""
    found = rows.groupBy("id", "seq", "sample_ts").agg(F.max("opened").alias("opened"), F.max("closed").alias("closed"))
    return found.filter(~F.col("closed")) if whole else found.filter(~(F.col("opened") & F.col("closed")))


def time_to_healthy(
    samples: DataFrame,
    place: str,
    budget_seconds: int,
    lateness_seconds: int = LATENESS_SECONDS,
    width: int = CHUNK,
    trigger: Mapping = ONCE,
) -> tuple[StreamingQuery, Segments]:
    """Outcome of each start (``{place}/out``) as soon as it is certain; the state holds the starts still open.

    A batch looks at the open starts of its own ids and at those that are due, and writes what opens and what closes. A
    start times out when the samples' time has passed its deadline by the lateness.
    """
    spark = samples.sparkSession
    state = Segments(spark, f"{place}/state", OPEN_STARTS, _open_starts)
    grace = F.expr(f"INTERVAL {budget_seconds + lateness_seconds} SECOND")

    def step(batch: DataFrame, number: int) -> None:
        rows = batch.select("id", "seq", "sample_ts", "is_start", "running", "healthy")
        clock = F.lit(rows.agg(F.max("sample_ts").alias("ts")).first()["ts"]).cast("timestamp_ntz")
        ids = rows.select("id").distinct().withColumn("_seen", F.lit(True))
        due = F.coalesce(F.col("sample_ts") + grace < clock, F.lit(False))
        touched = state.before(number).join(ids, "id", "left").filter(F.col("_seen").isNotNull() | due)
        none = F.lit(None).cast("boolean")
        marks = touched.select("id", "seq", "sample_ts", F.lit(True).alias("is_start"), none.alias("running"), none.alias("healthy"))
        known = F.lit(True).alias("_known")
        results = status.time_to_healthy(rows.unionByName(marks), budget_seconds, width)
        certain = (F.col("outcome") != "timeout") | (F.col("since") + grace < clock)
        results = results.withColumn("_certain", F.coalesce(certain, F.lit(False)))
        # Worked out once, and there to be read by both of the tables below.
        work = f"{place}/work/{number % 2}"
        results.join(touched.select("id", "seq", known), ["id", "seq"], "left").write.mode("overwrite").parquet(work)
        results = spark.read.parquet(work)
        _put(results.filter("_certain").drop("_certain", "_known"), f"{place}/out", number)
        fresh = F.col("_known").isNull()
        changed = results.filter(fresh != F.col("_certain"))  # opens, or was open and is certain now
        state.write(
            number, changed.select("id", "seq", F.col("since").alias("sample_ts"), fresh.alias("opened"), (~fresh).alias("closed"))
        )

    return each_batch(samples, f"{place}/checkpoint", step, trigger), state


def _highest(rows: DataFrame, whole: bool = True) -> DataFrame:
    return rows.groupBy("service").agg(F.max("seq").alias("seq"))


def follow(lines: DataFrame, place: str, trigger: Mapping = ONCE) -> tuple[StreamingQuery, Segments]:
    """History first, then only new lines (``{place}/out``), however late a service's lines come.

    Lines of a service come in the order of ``seq``; what is not above the highest number seen is a repeat. The
    state is one row per service.
    """
    state = Segments(lines.sparkSession, f"{place}/state", "service STRING, seq BIGINT", _highest)

    def step(batch: DataFrame, number: int) -> None:
        marks = state.before(number).select("service", F.col("seq").alias("_mark"))
        fresh = batch.dropDuplicates(["service", "seq"]).join(marks, "service", "left")
        fresh = fresh.filter(F.col("_mark").isNull() | (F.col("seq") > F.col("_mark"))).select(*batch.columns)
        _put(fresh, f"{place}/out", number)
        state.write(number, _highest(batch))

    return each_batch(lines, f"{place}/checkpoint", step, trigger), state


def state_flips(
    samples: DataFrame,
    place: str,
    flag: str = "running",
    key: str = "id",
    width: int = CHUNK,
    trigger: Mapping = ONCE,
) -> tuple[StreamingQuery, Segments]:
    """Rows where a flag changes, also from one batch to the next; the state is each key's last flag."""
    spark, out = samples.sparkSession, f"{place}/out"
    kinds = dict(samples.dtypes)

    def last(rows: DataFrame, whole: bool = True) -> DataFrame:
        return latest_by(rows, [key], "seq")

    state = Segments(spark, f"{place}/state", f"{key} {kinds[key]}, seq BIGINT, {flag} BOOLEAN", last)

    def step(batch: DataFrame, number: int) -> None:
        rows = batch.select(key, "seq", flag)
        own = last(rows)
        before = state.before(number).join(own.select(key), key, "left_semi")
        both = rows.withColumn("_new", F.lit(True)).unionByName(before.withColumn("_new", F.lit(False)))
        flips = status.state_flips(both, flag, key, width).filter("_new")
        _put(flips.drop("_new"), out, number)
        state.write(number, own)

    return each_batch(samples, f"{place}/checkpoint", step, trigger), state


def first_match(
    lines: DataFrame,
    place: str,
    match: Column,
    restart: Column,
    width: int = CHUNK,
    trigger: Mapping = ONCE,
) -> tuple[StreamingQuery, Segments]:
    """First match of each run as it arrives; a restart row opens the next run of its service.

    The state is the number of runs and whether the last one has its match, as of the last batch with the service.
    """
    spark, out = lines.sparkSession, f"{place}/out"

    def last(rows: DataFrame, whole: bool = True) -> DataFrame:
        return latest_by(rows, ["service"], "batch")

    state = Segments(spark, f"{place}/state", "service STRING, runs BIGINT, found BOOLEAN, batch BIGINT", last)

    def step(batch: DataFrame, number: int) -> None:
        before = state.before(number).drop("batch")
        marked = logs.segment_by_marker(batch, restart, width=width).withColumn("_match", match)
        hit = F.col("_match") != ""
        found = marked.filter(hit).groupBy("service", "segment")
        first = found.agg(F.min("seq").alias("seq"), F.min_by("_match", "seq").alias("match"))
        known = first.join(before, "service", "left")
        repeated = (F.col("segment") == 0) & F.coalesce(F.col("found"), F.lit(False))
        run = F.col("segment") + F.coalesce("runs", F.lit(0))
        _put(known.filter(~repeated).select("service", run.alias("run"), "seq", "match"), out, number)

        seen = marked.groupBy("service").agg(
            F.max("segment").alias("_restarts"), F.max(F.when(hit, F.col("segment"))).alias("_hit")
        )
        restarts = F.coalesce("_restarts", F.lit(0))
        in_last = F.coalesce(F.col("_hit") == F.col("_restarts"), F.lit(False))
        earlier = F.coalesce("found", F.lit(False))
        after = seen.join(before, "service", "left").select(
            "service",
            (F.coalesce("runs", F.lit(0)) + restarts).alias("runs"),
            F.when(restarts > 0, in_last).otherwise(earlier | in_last).alias("found"),
            F.lit(number).cast("bigint").alias("batch"),
        )
        state.write(number, after)

    return each_batch(lines, f"{place}/checkpoint", step, trigger), state


# Sinks of exercises are named with this in front, all others stand for a service.
EXERCISE = "ex-"
COMMITS = "topic STRING, batch BIGINT, lines BIGINT"


def topic_of(sink: Column) -> Column:
    """The topic of a sink: of an exercise's session, or of a service, the setup and the repair alike."""
    exercise = F.concat(F.lit("exercise:"), F.substring(sink, F.lit(len(EXERCISE) + 1), F.length(sink)), F.lit(":log"))
    return F.when(sink.startswith(EXERCISE), exercise).otherwise(F.concat(F.lit("service:"), sink, F.lit(":log")))


def _commits(spark: SparkSession, place: str) -> Segments:
    return Segments(spark, f"{place}/commits", COMMITS, lambda rows, whole: rows)


def fan_out(lines: DataFrame, place: str, trigger: Mapping = ONCE) -> StreamingQuery:
    """Keep every line (``log``) and deliver it to each of its ``topics``, an array of names; null: to none.

    A batch's lines are there by topic, then its commits (topic, batch, lines) make them known: ``subscribe`` reads no
    batch without them, and a batch that runs again replaces its own.
    """
    spark = lines.sparkSession
    commits = _commits(spark, place)

    def step(batch: DataFrame, number: int) -> None:
        _put(batch.drop("topics"), f"{place}/log", number)
        routed = batch.withColumn("topic", F.explode(F.array_distinct("topics"))).drop("topics")
        # Few files per topic, several for a large one.
        routed.hint("rebalance", "topic").write.mode("overwrite").partitionBy("topic").parquet(f"{place}/topics/batch={number}")
        there = spark.read.schema(schema_of(routed)).parquet(f"{place}/topics/batch={number}")
        counts = there.groupBy("topic").agg(F.count("*").alias("lines"))
        commits.write(number, counts.select("topic", F.lit(number).cast("bigint").alias("batch"), "lines"))

    return each_batch(lines, f"{place}/checkpoint", step, trigger)


def subscribe(spark: SparkSession, place: str, topic: str, after: int = -1) -> tuple[DataFrame | None, int]:
    """The lines of a topic that came after batch ``after``, and the batch to ask from the next time; None: no lines.

    A subscriber that keeps that number gets each line once, however often it or the delivery is started again. Only the
    folders of its new batches are read.
    """
    new = _commits(spark, place).now().filter((F.col("topic") == topic) & (F.col("batch") > after))
    batches = sorted(row["batch"] for row in new.select("batch").collect())
    if not batches:
        return None, after
    folders = [f"{place}/topics/batch={batch}" for batch in batches]
    rows = spark.read.option("basePath", f"{place}/topics").parquet(*folders).filter(F.col("topic") == topic)
    return rows, batches[-1]
