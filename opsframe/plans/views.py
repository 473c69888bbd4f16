"""Views on the given tables. Each is one SQL text with the same rows in Spark and in the checking engine.

Tables are written ``{name}``; ``sql`` leaves plain names for the check, ``view`` binds DataFrames.
One view has a Spark form of its own with the same rows, because its SQL has a window over a whole host. Another gets its
table dealt out to more tasks than Spark would make.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from opsframe.operators.ordered import Fold, dealt, running

# Order lines per task of ``steps``, each of which becomes up to three log lines.
STEP_ROWS = 50_000

VIEWS = {
    "log_lines": """
SELECT event_type AS service, event_id AS seq, ts,
       CASE WHEN event_id % 5 = 0 THEN 'stderr' ELSE 'stdout' END AS stream,
       CASE event_id % 12
         WHEN 0 THEN repeat('=', 60)
         WHEN 1 THEN 'ERROR value out of range'
         WHEN 2 THEN 'java.lang.NullPointerException: x'
         WHEN 3 THEN 'warning: slow request'
         WHEN 4 THEN '  error: Could not find or load main class PC '
         WHEN 5 THEN '[heal] restored exec bits'
         WHEN 6 THEN concat('URL http://127.0.0.1:8888/lab?token=abc', event_id)
         WHEN 7 THEN concat('arrancado con PID ', user_id)
         WHEN 8 THEN concat('detenido (exit ', event_id % 3, ')')
         WHEN 9 THEN 'éERROR a'
         WHEN 10 THEN '[dfsadmin -safemode enter] Safe mode is ON'
         ELSE 'a | b' END AS text
FROM {events}""",
    "status": """
SELECT concat('h', user_id) AS id, event_id AS seq, ts AS sample_ts,
       event_type = 'signup' AS is_start,
       event_type <> 'error' AS running,
       (event_type <> 'error' AND value < 20) AS healthy,
       CAST(1000 + user_id AS INT) AS pid,
       CAST(CASE event_type WHEN 'error' THEN 503 WHEN 'purchase' THEN 302
                            WHEN 'signup' THEN 404 ELSE 200 END AS INT) AS status_code,
       value AS latency_ms
FROM {events}""",
    "probes": """
SELECT id, seq, CASE WHEN is_start THEN 'tcp' ELSE 'http' END AS kind, status_code,
       status_code <> 404 OR healthy AS connected,
       CASE WHEN latency_ms > 60 THEN 'timeout' END AS error,
       CAST(ROUND(latency_ms * 1000) AS BIGINT) AS latency_us
FROM {status}""",
    "telemetry": """
SELECT user_id AS host, event_id AS seq, ts,
       CAST(SUM(CAST(ROUND(value * 100) AS BIGINT)) OVER w AS BIGINT) AS busy,
       CAST(SUM(CAST(ROUND(value * 100) AS BIGINT) + 5000) OVER w AS BIGINT) AS total,
       CASE WHEN event_type = 'error' THEN NULL ELSE value END AS reading,
       CAST(ROUND(value * 1000000) AS BIGINT) AS used_bytes
FROM {events}
WINDOW w AS (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""",
    "files": """
SELECT doc_id, source AS host, lang AS dir, name, type, length, modification_ms,
       concat('/', source, '/', lang, CASE WHEN doc_id % 11 = 0 THEN '/__pycache__/x/__pycache__' ELSE '' END,
              '/', name) AS path
FROM (SELECT doc_id, source, lang, n_chars AS length,
             1700000000000 + doc_id * 1000 AS modification_ms,
             CASE WHEN doc_id % 10 = 0 THEN 'DIRECTORY' ELSE 'FILE' END AS type,
             CASE doc_id % 9
               WHEN 0 THEN 'VERSION' WHEN 1 THEN 'mapper.py' WHEN 2 THEN 'reducer.py'
               WHEN 3 THEN concat('.hidden', doc_id) WHEN 4 THEN 'meta.properties'
               WHEN 5 THEN 'core-site.xml' WHEN 6 THEN 'edits_inprogress_1'
               ELSE concat('part ', doc_id, '.csv') END AS name
      FROM {documents}) f""",
    "requests": """
SELECT CAST((s_suppkey - s_suppkey % 60) / 60 AS INT) AS host, s_suppkey AS service_id, s_name AS service_name,
       CAST(1024 + s_suppkey * 7 % 900 AS INT) AS port
FROM {supplier}""",
    "required": """
SELECT host, service_id, 0 AS pos, port FROM {requests}
UNION ALL
SELECT host, service_id, 1, port + 1 FROM {requests}""",
    "listeners": """
SELECT CAST((c_custkey - c_custkey % 900) / 900 AS INT) AS host, CAST(1024 + c_custkey % 900 AS INT) AS port,
       CAST(c_custkey AS INT) AS pid,
       CASE WHEN c_custkey % 13 = 0 THEN 'VBoxHeadless.exe' ELSE c_mktsegment END AS name
FROM {customer}""",
    "ours": """
SELECT CAST((s_suppkey - s_suppkey % 60) / 60 AS INT) AS host, CAST(s_suppkey * 15 AS INT) AS pid FROM {supplier}""",
    "steps": """
SELECT l_orderkey AS run_id,
       CAST(ROW_NUMBER() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice,
                               l_quantity, l_shipdate) AS BIGINT) AS pos,
       CASE l_returnflag WHEN 'R' THEN 'failed' ELSE 'done' END AS status,
       CASE l_returnflag WHEN 'R' THEN concat('error ', l_partkey) END AS error,
       l_linestatus = 'F' AS graceful
FROM {lineitem}""",
    "defaults": """
SELECT c_custkey AS id, c_name AS name, CAST(1024 + c_custkey AS INT) AS port, '1g' AS heap FROM {customer}""",
    "overrides": """
SELECT o_custkey AS id,
       CAST(CAST(FLOOR(MAX_BY(o_totalprice, o_orderkey)) AS BIGINT) % 3000 - 500 AS INT) AS port,
       CASE WHEN MAX(o_orderkey) % 4 = 0 THEN '' ELSE '2g' END AS heap
FROM {orders} GROUP BY o_custkey""",
    "changes": """
SELECT o_custkey AS owner, o_orderpriority AS key, o_orderkey AS seq,
       CASE o_orderstatus WHEN 'P' THEN 'delete' ELSE 'set' END AS op, o_totalprice AS value
FROM {orders}""",
    "releases": """
SELECT source AS os, lang AS arch,
       CASE WHEN MAX(doc_id) % 7 = 0 THEN '' ELSE concat('0.2.', MAX(doc_id) % 10) END AS version
FROM {documents} GROUP BY source, lang""",
}


def sql(name: str) -> str:
    """The view's text on plain table names."""
    return re.sub(r"\{(\w+)\}", r"\1", VIEWS[name])


def with_views(names: str, query: str) -> str:
    """A query text with the named views in front."""
    return "WITH " + ", ".join(f"{name} AS ({sql(name)})" for name in names.split()) + "\n" + query


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def select(spark: SparkSession, sf_dir: str, query: str, **views: DataFrame) -> DataFrame:
    """Run a text whose ``{names}`` are given DataFrames, views or tables."""
    names = set(re.findall(r"\{(\w+)\}", query)) - set(views)
    bound = {name: view(spark, sf_dir, name) if name in VIEWS else table(spark, sf_dir, name) for name in names}
    return spark.sql(query, **bound, **views)


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    if name == "telemetry":
        return _telemetry(table(spark, sf_dir, "events"))
    if name == "steps":
        # Orders stay together, so the window of the text shuffles no more.
        lineitem = dealt(table(spark, sf_dir, "lineitem"), ["l_orderkey"], STEP_ROWS)
        return select(spark, sf_dir, VIEWS[name], lineitem=lineitem)
    return select(spark, sf_dir, VIEWS[name])


def _telemetry(events: DataFrame) -> DataFrame:
    ticks = F.round(F.col("value") * 100).cast("bigint")
    samples = events.select(
        F.col("user_id").alias("host"),
        F.col("event_id").alias("seq"),
        "ts",
        ticks.alias("_ticks"),
        F.when(F.col("event_type") != "error", F.col("value")).alias("reading"),
        F.round(F.col("value") * 1000000).cast("bigint").alias("used_bytes"),
    )
    counters = {"busy": Fold("sum", F.col("_ticks")), "total": Fold("sum", F.col("_ticks") + 5000)}
    counted = running(samples, ["host"], "seq", counters)
    return counted.select("host", "seq", "ts", "busy", "total", "reading", "used_bytes")

