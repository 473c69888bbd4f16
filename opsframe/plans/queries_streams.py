"""Streaming queries. The events table is read as a stream of files, and what a run gives out is read back."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from opsframe.functions import scalars as S
from opsframe.plans import views
from opsframe.plans.queries_logs import LEVELED
from opsframe.plans.queries_status import LATEST, SIX_HOURS
from opsframe.plans.registry import ORACLES, Inputs, query
from opsframe.plans.session import scratch
from opsframe.streaming import live

STARTED = "arrancado con PID"


# Files of a micro-batch, where rows may come in any order. What follows the order of a key takes the files of the table
# together, because files of one table have no order among themselves.
FILES = 64


def events_stream(v: Inputs, files: int | None = FILES) -> DataFrame:
    """The events as a stream of files. The pattern fits a file and a folder of files alike."""
    reader = v.spark.readStream.schema(v["events"].schema)
    if files is not None:
        reader = reader.option("maxFilesPerTrigger", files)
    return reader.parquet(f"{v.sf_dir.rstrip('/')}/events.parque[t]")


def stream_view(v: Inputs, name: str, files: int | None = FILES) -> DataFrame:
    return v.sql(views.VIEWS[name], events=events_stream(v, files))


def finish(running) -> None:
    running.awaitTermination()


@query(
    "stream_log_levels",
    f"SELECT service, seq, level, text FROM {LEVELED} WHERE level IN ('WARN', 'ERROR')",
    "log_lines",
)
def _(v):
    place = scratch(v.spark, "stream")
    lines = live.log_levels(stream_view(v, "log_lines"), "warn").select("service", "seq", "level", "text")
    finish(live.to_table(lines, f"{place}/checkpoint", f"{place}/out"))
    return v.spark.read.parquet(f"{place}/out")


@query("stream_ring_buffer", ORACLES["ring_buffer"])
def _(v):
    running, state = live.ring_buffer(stream_view(v, "log_lines"), scratch(v.spark, "stream"), 100)
    finish(running)
    return state.now().select("service", "seq", "text")


@query("stream_latest_status", f"SELECT id, seq, running, healthy, pid FROM {LATEST}", "status")
def _(v):
    place = scratch(v.spark, "stream")
    finish(live.latest_status(stream_view(v, "status").select("id", "seq", "running", "healthy", "pid"), place))
    return live.read_latest(v.spark, place)


@query(
    "stream_tick_windows",
    """SELECT time_bucket(INTERVAL 2 SECOND, ts) AS start, user_id AS host, arg_max(cents, ts) AS last,
       CAST(sum(cents) AS DOUBLE) / count(*) AS mean, max(cents) AS largest
FROM (SELECT *, CAST(round(value * 100) AS BIGINT) AS cents FROM events)
GROUP BY ALL""",
)
def _(v):
    place = scratch(v.spark, "stream")
    cents = F.round(F.col("value") * 100).cast("bigint").alias("value")
    samples = events_stream(v).select("ts", F.col("user_id").alias("host"), cents)
    finish(live.tick_windows(samples, place))
    return live.read_ticks(v.spark, place)


@query("stream_time_to_healthy", ORACLES["time_to_healthy"])
def _(v):
    place = scratch(v.spark, "stream")
    running, state = live.time_to_healthy(stream_view(v, "status", None), place, SIX_HOURS)
    finish(running)
    # What is still open when the data ends has not become healthy in time.
    open_ = state.now().select(
        "id",
        "seq",
        F.col("sample_ts").alias("since"),
        F.lit("timeout").alias("outcome"),
        F.lit(None).cast("double").alias("seconds"),
    )
    return v.spark.read.parquet(f"{place}/out").drop("batch").unionByName(open_)


@query("snapshot_then_follow", "SELECT service, seq, ts, stream, text FROM log_lines", "log_lines")
def _(v):
    place = scratch(v.spark, "stream")
    finish(live.follow(stream_view(v, "log_lines", None), place)[0])
    return v.spark.read.parquet(f"{place}/out").drop("batch")


@query("stream_state_flips", ORACLES["state_flips"])
def _(v):
    place = scratch(v.spark, "stream")
    finish(live.state_flips(stream_view(v, "status", None), place)[0])
    return v.spark.read.parquet(f"{place}/out").drop("batch")


@query("stream_first_match", ORACLES["first_match_wins"])
def _(v):
    place = scratch(v.spark, "stream")
    text = F.col("text")
    running, _ = live.first_match(
        stream_view(v, "log_lines", None), place, S.extract_access_url(text), text.startswith(STARTED)
    )
    finish(running)
    return v.spark.read.parquet(f"{place}/out").drop("batch")


# Sinks of the services; exercises have their own, and what is repaired or set up goes to those sinks as well.
ROUTED = """SELECT CASE WHEN service = 'purchase' THEN 'exercise:01:log' ELSE concat('service:', service, ':log') END AS topic,
       seq, text FROM log_lines
UNION ALL SELECT 'service:repair:log', seq, text FROM log_lines WHERE text LIKE '[heal]%'
UNION ALL SELECT 'service:setup:log', seq, text FROM log_lines WHERE text LIKE '[dfsadmin%'"""


def routed(v: Inputs) -> DataFrame:
    lines = stream_view(v, "log_lines")
    sink = F.when(F.col("service") == "purchase", "ex-01").otherwise(F.col("service"))
    also = [F.when(F.col("text").startswith("[heal]"), "repair"), F.when(F.col("text").startswith("[dfsadmin"), "setup")]
    return lines.withColumn("topics", F.transform(F.array_compact(F.array(sink, *also)), live.topic_of))


@query("fan_out", ROUTED, "log_lines")
def _(v):
    place = scratch(v.spark, "stream")
    finish(live.fan_out(routed(v), place))
    return v.spark.read.parquet(f"{place}/topics").select("topic", "seq", "text")


@query(
    "topic_subscription",
    f"SELECT * FROM ({ROUTED}) WHERE topic IN ('service:repair:log', 'exercise:01:log')",
    "log_lines",
)
def _(v):
    place = scratch(v.spark, "stream")
    finish(live.fan_out(routed(v), place))
    parts = []
    for topic in ("service:repair:log", "exercise:01:log"):
        rows, until = live.subscribe(v.spark, place, topic)
        if rows is not None:
            parts.append(rows.select("topic", "seq", "text"))
        assert live.subscribe(v.spark, place, topic, until)[0] is None  # all of it has been read
    return reduce(DataFrame.unionByName, parts)
