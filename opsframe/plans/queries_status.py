"""Queries on service status and telemetry."""

from __future__ import annotations

from pyspark.sql import functions as F

from opsframe.functions import scalars as S
from opsframe.operators import config, status, telemetry
from opsframe.operators.catalog import sort_by_id
from opsframe.plans.registry import query

BADGE = "CASE WHEN NOT coalesce(running, false) THEN 'stopped' WHEN healthy THEN 'healthy' ELSE 'running' END"
LATEST = "(SELECT * FROM status QUALIFY row_number() OVER (PARTITION BY id ORDER BY seq DESC) = 1)"
VERDICT = """(SELECT *, error IS NULL AND CASE WHEN kind = 'http' THEN status_code BETWEEN 200 AND 399
                                              ELSE connected END AS well,
       CASE WHEN error IS NOT NULL THEN error WHEN kind = 'tcp' THEN CASE WHEN connected THEN 'tcp ok' ELSE '' END
            WHEN status_code = 200 THEN 'OK' WHEN status_code = 302 THEN 'Found'
            WHEN status_code = 404 THEN 'Not Found' ELSE 'Service Unavailable' END AS detail FROM probes)"""
SIX_HOURS = 6 * 3600


@query("status_badge", f"SELECT id, seq, {BADGE} AS badge FROM status", "status")
def _(v):
    badge = status.status_badge(F.col("running"), F.col("healthy"))
    return v["status"].select("id", "seq", badge.alias("badge"))


@query(
    "step_badge",
    """SELECT run_id, pos, CASE WHEN graceful AND status = 'done' THEN 'pending' ELSE status END AS badge
FROM steps""",
    "steps",
)
def _(v):
    told = F.when(F.col("graceful") & (F.col("status") == "done"), "unknown").otherwise(F.col("status"))
    return v["steps"].select("run_id", "pos", status.step_badge(told).alias("badge"))


@query("probe_verdict", f"SELECT id, seq, latency_us, well AS healthy, detail FROM {VERDICT}", "status probes")
def _(v):
    return status.probe_verdict(v["probes"]).select("id", "seq", "latency_us", "healthy", "detail")


@query(
    "service_status",
    f"""SELECT s.id, s.seq, s.running, s.running AND p.well AS healthy, CASE WHEN s.running THEN s.pid END AS pid,
       CASE WHEN s.running THEN s.sample_ts END AS since,
       CASE WHEN NOT s.running THEN 'detenido' WHEN s.latency_ms < 1 THEN 'URL lista' ELSE p.detail END AS detail
FROM status s LEFT JOIN {VERDICT} p ON p.id = s.id AND p.seq = s.seq""",
    "status probes",
)
def _(v):
    processes = v["status"].select(
        "id",
        "seq",
        "running",
        "pid",
        F.col("sample_ts").alias("since"),
        F.when(F.col("latency_ms") < 1, "http://localhost/?token=t").alias("url"),
    )
    return status.service_status(processes, status.probe_verdict(v["probes"]), ["id", "seq"])


@query(
    "latest_status",
    f"SELECT id, seq, sample_ts, running, healthy, pid, status_code, latency_ms FROM {LATEST}",
    "status",
)
def _(v):
    latest = status.latest_status(v["status"])
    return latest.select("id", "seq", "sample_ts", "running", "healthy", "pid", "status_code", "latency_ms")


SERVICES = "SELECT concat('h', c_custkey) AS id, c_name AS name, CAST(1024 + c_custkey AS INT) AS port FROM {customer}"


@query(
    "service_overview",
    f"""SELECT d.id, d.name, d.port, {BADGE} AS badge, coalesce(CAST(pid AS VARCHAR), '—') AS pid
FROM ({SERVICES.replace('{customer}', 'customer')}) d LEFT JOIN {LATEST} s ON s.id = d.id""",
    "status",
)
def _(v):
    return status.service_overview(v.sql(SERVICES), status.latest_status(v["status"]))


# Small maps, so that the directory of shards has something to split.
ENTRIES = 50


@query(
    "statuses_map",
    f"""SELECT shard, count(*) AS services,
       string_agg(concat(id, '=', pid, CASE WHEN running THEN '+' ELSE '-' END), ',' ORDER BY id) AS statuses
FROM (
  SELECT id, pid, running, substr(bits, 1, CAST(min(k) AS BIGINT)) AS shard FROM (
    SELECT id, pid, running, bits, k, count(*) OVER (PARTITION BY k, substr(bits, 1, k)) AS n FROM (
      SELECT id, pid, running, to_base(CAST(concat('0x', substr(md5(id), 1, 15)) AS BIGINT), 2, 60) AS bits FROM {LATEST}
    ), range(61) r(k)
  ) WHERE n <= {ENTRIES} GROUP BY id, pid, running, bits
) GROUP BY shard""",
    "status",
)
def _(v):
    maps = status.statuses_map(status.latest_status(v["status"]), ENTRIES)
    sign = lambda entry: F.when(entry["value"]["running"], "+").otherwise("-")
    shown = F.transform(
        F.array_sort(F.map_entries("statuses")),
        lambda entry: F.concat(entry["key"], F.lit("="), entry["value"]["pid"], sign(entry)),
    )
    return maps.select(
        "shard", F.size("statuses").cast("bigint").alias("services"), F.array_join(shown, ",").alias("statuses")
    )


@query(
    "state_flips",
    """SELECT id, seq, running FROM (
  SELECT id, seq, running, lag(running) OVER (PARTITION BY id ORDER BY seq) AS before FROM status)
WHERE before IS DISTINCT FROM running""",
    "status",
)
def _(v):
    return status.state_flips(v["status"].select("id", "seq", "running"))


@query(
    "probe_latency",
    """SELECT id, count(*) AS probes, CAST(sum(latency_us) AS DOUBLE) / count(*) AS mean_us,
       round(quantile_cont(latency_us, 0.5), 3) AS p50_us, round(quantile_cont(latency_us, 0.95), 3) AS p95_us,
       CAST(sum(CASE WHEN connected THEN 1 ELSE 0 END) AS DOUBLE) / count(*) AS healthy_share
FROM probes GROUP BY id""",
    "status probes",
)
def _(v):
    stats = status.probe_latency(v["probes"].withColumn("healthy", F.col("connected")))
    return stats.withColumns({name: F.round(name, 3) for name in ("p50_us", "p95_us")})


@query(
    "time_to_healthy",
    f"""SELECT s.id, s.seq, s.sample_ts AS since,
       CASE WHEN well IS NOT NULL AND (down IS NULL OR well < down) THEN 'healthy'
            WHEN down IS NOT NULL THEN 'exited' ELSE 'timeout' END AS outcome,
       CASE WHEN well IS NOT NULL AND (down IS NULL OR well < down)
            THEN (epoch_us(well) - epoch_us(s.sample_ts)) / 1e6 END AS seconds
FROM status s LEFT JOIN (
  SELECT a.id, a.seq, min(b.sample_ts) FILTER (WHERE b.running AND b.healthy) AS well,
         min(b.sample_ts) FILTER (WHERE NOT b.running) AS down
  FROM status a JOIN status b ON a.id = b.id
   AND b.sample_ts BETWEEN a.sample_ts AND a.sample_ts + INTERVAL {SIX_HOURS} SECOND
  WHERE a.is_start GROUP BY a.id, a.seq) o ON o.id = s.id AND o.seq = s.seq
WHERE s.is_start""",
    "status",
)
def _(v):
    return status.time_to_healthy(v["status"], SIX_HOURS)


@query("sort_by_id", f"SELECT id, running FROM {LATEST}", "status")
def _(v):
    return sort_by_id(status.latest_status(v["status"])).select("id", "running")


@query(
    "domain_clamp",
    "SELECT doc_id, CASE WHEN lang IN ('es', 'en') THEN lang ELSE 'es' END AS lang FROM documents",
)
def _(v):
    return v["documents"].select("doc_id", config.domain_clamp(F.col("lang")).alias("lang"))


@query(
    "cpu_delta",
    """SELECT host, seq, trunc((busy - b) * 100.0::DOUBLE / nullif(total - t, 0) * 10 + 0.5) / 10 AS cpu_percent
FROM (SELECT *, lag(busy) OVER w AS b, lag(total) OVER w AS t FROM telemetry
      WINDOW w AS (PARTITION BY host ORDER BY seq))""",
    "telemetry",
)
def _(v):
    return telemetry.cpu_delta(v["telemetry"]).select("host", "seq", "cpu_percent")


@query(
    "fill_forward",
    """SELECT host, seq, last_value(reading IGNORE NULLS) OVER (
  PARTITION BY host ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS filled FROM telemetry""",
    "telemetry",
)
def _(v):
    return telemetry.fill_forward(v["telemetry"]).select("host", "seq", "filled")


@query("round1", "SELECT host, seq, trunc(reading * 10 + 0.5) / 10 AS reading FROM telemetry", "telemetry")
def _(v):
    return v["telemetry"].select("host", "seq", S.round1(F.col("reading")).alias("reading"))


@query("bytes_to_mb", "SELECT host, seq, used_bytes // 1048576 AS used_mb FROM telemetry", "telemetry")
def _(v):
    return v["telemetry"].select("host", "seq", S.bytes_to_mb(F.col("used_bytes")).alias("used_mb"))
