"""Service health: badges, probe verdicts, latest status, latency and time to healthy."""

from __future__ import annotations

import math
from collections.abc import Sequence
from http import HTTPStatus

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from opsframe.operators.ordered import CHUNK, Fold, latest_by, running

# Texts of a stopped service, a captured link and an open port, and reason phrases of HTTP answers that
# newer standards renamed.
STOPPED = "detenido"
URL_READY = "URL lista"
TCP_WELL = "tcp ok"
NO_PID = "—"
OLDER_PHRASES = {
    413: "Request Entity Too Large",
    414: "Request URI Too Long",
    416: "Requested Range Not Satisfiable",
    418: "I'm a teapot",
    422: "Unprocessable Entity",
}
STATUS_TEXT = {status.value: status.phrase for status in HTTPStatus} | OLDER_PHRASES


def status_badge(running_: Column, healthy: Column) -> Column:
    """stopped, healthy or running; a missing status counts as stopped."""
    return (
        F.when(~F.coalesce(running_, F.lit(False)), "stopped")
        .when(F.coalesce(healthy, F.lit(False)), "healthy")
        .otherwise("running")
    )


def step_badge(status: Column) -> Column:
    """done, running or failed; anything else is pending."""
    return F.when(status.isin("done", "running", "failed"), status).otherwise("pending")


def status_text(code: Column) -> Column:
    """Reason phrase of an HTTP answer, blank for an unknown code."""
    phrases = [F.lit(part) for pair in STATUS_TEXT.items() for part in pair]
    return F.coalesce(F.element_at(F.create_map(*phrases), code), F.lit(""))


def probe_verdict(probes: DataFrame) -> DataFrame:
    """Health of raw probe records ``(kind, status_code, connected, error)``; other columns are kept.

    HTTP is healthy for codes 200 to 399 without an error, TCP when connected. The detail is the error, or for
    HTTP the reason phrase, for a healthy TCP probe the text of an open port.
    """
    http = F.col("kind") == "http"
    failed = F.coalesce(F.col("error"), F.lit("")) != ""
    answered = F.coalesce(F.col("status_code").between(200, 399), F.lit(False))
    healthy = ~failed & F.when(http, answered).otherwise(F.coalesce(F.col("connected"), F.lit(False)))
    detail = F.when(failed, F.col("error")).when(http, status_text(F.col("status_code")))
    detail = detail.otherwise(F.when(healthy, TCP_WELL).otherwise(""))
    return probes.withColumn("healthy", healthy).withColumn("detail", detail)


def service_status(processes: DataFrame, probes: DataFrame, on: Sequence[str] = ("id",)) -> DataFrame:
    """Status from a process table (``running, pid, since``, ``url`` if there is one) and probe verdicts.

    A process that does not run has no pid, start or health; a captured link replaces the detail.
    """
    up = F.coalesce(F.col("running"), F.lit(False))
    joined = processes.join(probes.select(*on, "healthy", "detail"), list(on), "left")
    detail = F.coalesce(F.col("detail"), F.lit(""))
    if "url" in processes.columns:
        detail = F.when(F.coalesce(F.col("url"), F.lit("")) != "", URL_READY).otherwise(detail)
    return joined.select(
        *on,
        up.alias("running"),
        (up & F.coalesce(F.col("healthy"), F.lit(False))).alias("healthy"),
        F.when(up, F.col("pid")).alias("pid"),
        F.when(up, F.col("since")).alias("since"),
        F.when(up, detail).otherwise(STOPPED).alias("detail"),
    )


def latest_status(status: DataFrame, order: str = "seq") -> DataFrame:
    """Last status of each service: the last write wins."""
    return latest_by(status, ["id"], order)


def service_overview(services: DataFrame, latest: DataFrame) -> DataFrame:
    """Each service with its badge and pid; a dash where there is none."""
    joined = services.join(latest.select("id", "running", "healthy", "pid"), "id", "left")
    shown = F.when(F.coalesce(F.col("pid"), F.lit(0)) == 0, NO_PID).otherwise(F.col("pid").cast("string"))
    return joined.select(
        *services.columns, status_badge(F.col("running"), F.col("healthy")).alias("badge"), shown.alias("pid")
    )


# Entries that a map of statuses may have, and digits of the hash that prefixes are cut from.
MAP_ENTRIES = 4_096
HASH_BITS = 60


def hash_bits(id_: Column) -> Column:
    """The first 60 bits of the MD5 of an id as a text of zeros and ones."""
    return F.lpad(F.conv(F.substring(F.md5(id_.cast("binary")), 1, HASH_BITS // 4), 16, 2), HASH_BITS, "0")


def shards(ids: DataFrame, most: int = MAP_ENTRIES) -> DataFrame:
    """(prefix): the shortest prefixes of hash bits that no more than ``most`` ids (unique, ``id``) share.

    A directory that doubles where it is overfull: counts of long prefixes are added up to those of all shorter ones, and
    a prefix is taken where it fits and the one before it does not.
    """
    bits = ids.select(hash_bits(F.col("id")).alias("_bits"))
    depth = max(0, math.ceil(math.log2(max(bits.count(), 1) / most))) + 4
    while True:
        depth = min(depth, HASH_BITS)
        leaves = bits.groupBy(F.substring("_bits", 1, depth).alias("leaf")).agg(F.count("*").alias("n"))
        if depth == HASH_BITS or (leaves.agg(F.max("n")).first()[0] or 0) <= most:
            break
        depth += 4
    above = F.explode(F.sequence(F.lit(0), F.lit(depth))).alias("k")
    counts = leaves.select(above, "leaf", "n").groupBy(F.substring("leaf", F.lit(1), F.col("k")).alias("prefix"), "k")
    fits = counts.agg(F.sum("n").alias("n")).filter((F.col("n") <= most) | (F.col("k") == depth))
    # Of the prefixes of a leaf that fit, the shortest: the others begin with one that fits too.
    shorter = fits.select(F.col("prefix").alias("_shorter"))
    cut = F.substring("prefix", F.lit(1), F.length("prefix") - 1)
    return fits.join(shorter, (F.length("prefix") > 0) & (cut == F.col("_shorter")), "left_anti").select("prefix")


def statuses_map(latest: DataFrame, most: int = MAP_ENTRIES) -> DataFrame:
    """Latest statuses as maps from id to status, none with more than ``most`` entries, however large the fleet.

    One map for a whole fleet would be one row in one task, so ids are split by prefixes of their hash, which ``shards``
    finds from counts. The union of the maps is the whole table.
    """
    others = [name for name in latest.columns if name != "id"]
    entry = F.struct(F.col("id"), F.struct(*others).alias("status"))
    directory = shards(latest, most)
    lengths = [row[0] for row in directory.select(F.length("prefix")).distinct().collect()]  # at most 61 numbers
    if not lengths:
        return latest.limit(0).groupBy(F.lit("").alias("shard")).agg(F.map_from_entries(F.collect_list(entry)).alias("statuses"))
    asked = F.array(*[F.substring(hash_bits(F.col("id")), 1, n) for n in sorted(lengths)])
    rows = latest.withColumn("_entry", entry).select("_entry", F.explode(asked).alias("prefix")).join(directory, "prefix")
    grouped = rows.groupBy(F.col("prefix").alias("shard")).agg(F.collect_list("_entry").alias("_entries"))
    return grouped.select("shard", F.map_from_entries("_entries").alias("statuses"))


def state_flips(samples: DataFrame, flag: str = "running", key: str = "id", width: int = CHUNK) -> DataFrame:
    """Only the rows where a flag differs from the row before; the first row of a key counts as a change."""
    before = {"_before": Fold("lag", F.col(flag)), "_first": Fold("lag", F.lit(True))}
    rows = running(samples, [key], "seq", before, width)
    changed = F.col("_first").isNull() | ~F.col(flag).eqNullSafe(F.col("_before"))
    return rows.filter(changed).select(*samples.columns)


def probe_latency(probes: DataFrame, quantiles: Sequence[float] = (0.5, 0.95), width: int = CHUNK) -> DataFrame:
    """Count, mean, exact percentiles (µs, interpolated) and healthy share per service.

    Works on counts per distinct latency, so repeated values collapse before the shuffle; ranks come from a
    running total in chunks of the latency axis. No task holds a whole service.
    """
    counts = probes.groupBy("id", "latency_us").agg(
        F.count("*").alias("_n"), F.sum(F.col("healthy").cast("bigint")).alias("_well")
    )
    totals = counts.groupBy("id").agg(
        F.sum("_n").alias("probes"),
        F.sum(F.col("_n") * F.col("latency_us")).alias("_sum"),
        F.coalesce(F.sum("_well"), F.lit(0)).alias("_ok"),
    )
    ranked = running(counts, ["id"], "latency_us", {"_upto": Fold("sum", F.col("_n"))}, width)

    def at(rank: Column) -> Column:
        """The value with a zero-based rank: the smallest one with more rows up to it."""
        return F.min(F.when(F.col("_upto") > rank, F.col("latency_us")))

    ends = []
    for n, q in enumerate(quantiles):
        place = F.lit(float(q)) * (F.col("probes") - 1)
        ends += [at(F.floor(place)).alias(f"_low{n}"), at(F.ceil(place)).alias(f"_high{n}")]
    picked = ranked.join(totals, "id", "left").groupBy("id", "probes", "_sum", "_ok").agg(*ends)

    values = []
    for n, q in enumerate(quantiles):
        place = F.lit(float(q)) * (F.col("probes") - 1)
        low, high = F.col(f"_low{n}"), F.col(f"_high{n}")
        value = low + (high - low) * (place - F.floor(place))
        values.append(value.alias(f"p{round(q * 100)}_us"))
    return picked.select(
        "id",
        "probes",
        (F.col("_sum") / F.col("probes")).alias("mean_us"),
        *values,
        (F.col("_ok") / F.col("probes")).alias("healthy_share"),
    )


def probe_latency_sketch(probes: DataFrame, quantiles: Sequence[float] = (0.5, 0.95)) -> DataFrame:
    """The same with percentile sketches: one pass, approximate percentiles."""
    picked = [F.percentile_approx("latency_us", q).alias(f"p{round(q * 100)}_us") for q in quantiles]
    return probes.groupBy("id").agg(
        F.count("*").alias("probes"),
        F.avg("latency_us").alias("mean_us"),
        *picked,
        F.avg(F.col("healthy").cast("int")).alias("healthy_share"),
    )


def time_to_healthy(samples: DataFrame, budget_seconds: int, width: int = CHUNK) -> DataFrame:
    """Outcome of every start (``is_start`` rows): ``healthy`` with the seconds, ``exited`` or ``timeout``.

    The first healthy and the first not-running sample from the start on decide, if within the budget. Both are
    found by carrying the next such time backwards along the samples, so no start is paired with its samples.
    A row without a ``running`` value marks a start only and is no sample.
    """
    up = F.col("running")
    well = up & F.coalesce(F.col("healthy"), F.lit(False))
    ahead = {
        "_well": Fold("last", F.when(well, F.col("sample_ts"))),
        "_down": Fold("last", F.when(~up, F.col("sample_ts"))),
        "_well_seq": Fold("last", F.when(well, F.col("seq"))),
        "_down_seq": Fold("last", F.when(~up, F.col("seq"))),
    }
    starts = running(samples, ["id"], "seq", ahead, width, backwards=True).filter("is_start")
    deadline = F.col("sample_ts") + F.expr(f"INTERVAL {int(budget_seconds)} SECOND")
    exited = F.col("_down") <= deadline
    healthy = (F.col("_well") <= deadline) & F.coalesce(F.col("_well_seq") < F.col("_down_seq"), F.lit(True))
    waited = F.unix_micros(F.col("_well").cast("timestamp")) - F.unix_micros(F.col("sample_ts").cast("timestamp"))
    return starts.select(
        "id",
        "seq",
        F.col("sample_ts").alias("since"),
        F.when(healthy, "healthy").when(exited, "exited").otherwise("timeout").alias("outcome"),
        F.when(healthy, waited / 1e6).alias("seconds"),
    )
