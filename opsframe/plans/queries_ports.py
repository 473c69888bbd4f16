"""Queries on ports and processes."""

from __future__ import annotations

from pyspark.sql import functions as F

from opsframe.operators import ports
from opsframe.plans.registry import query
from opsframe.plans.session import scratch
from opsframe.sources import parsers, readers

HOST = ["host"]


@query(
    "union_probes",
    """SELECT CAST(service_id AS VARCHAR) AS service_id, service_name, port, '0 service' AS origin FROM requests
UNION ALL SELECT 'hdfs_rpc', 'HDFS RPC', 9000, '1 extra' UNION ALL SELECT 'kafka_ctl', 'Kafka Controller', 9093,
       '1 extra'""",
    "requests",
)
def _(v):
    return ports.union_probes(v["requests"])


@query(
    "port_scan",
    """SELECT r.host, r.service_id, r.service_name, r.port, l.pid, l.name AS owner,
       CASE WHEN l.port IS NULL THEN 'free' WHEN o.pid IS NOT NULL THEN 'ours' ELSE 'other' END AS status,
       l.port IS NOT NULL AND o.pid IS NULL AND l.pid > 0 AS releasable
FROM requests r LEFT JOIN listeners l ON l.host = r.host AND l.port = r.port
LEFT JOIN ours o ON o.host = l.host AND o.pid = l.pid AND l.pid > 0""",
    "requests listeners ours",
)
def _(v):
    return ports.port_scan(v["requests"], v["listeners"], v["ours"], HOST)


# A service's own process is the one of ours that holds its first port.
OWN = """SELECT r.host, r.service_id, l.pid FROM {requests} r JOIN {listeners} l ON l.host = r.host AND l.port = r.port
JOIN {ours} o ON o.host = l.host AND o.pid = l.pid"""


@query(
    "preflight_conflict",
    f"""SELECT host, service_id, port, pid, owner,
       CASE WHEN lower(owner) LIKE '%vboxheadless%' THEN 'peer_vm' ELSE 'foreign' END AS kind
FROM (SELECT r.host, r.service_id, r.port, l.pid, l.name AS owner,
             row_number() OVER (PARTITION BY r.host, r.service_id ORDER BY r.pos) AS rn
      FROM required r JOIN listeners l ON l.host = r.host AND l.port = r.port
      LEFT JOIN ({OWN.replace('{', '').replace('}', '')}) w ON w.host = r.host AND w.service_id = r.service_id
      WHERE l.pid > 0 AND (w.pid IS NULL OR w.pid <> l.pid))
WHERE rn = 1""",
    "requests required listeners ours",
)
def _(v):
    return ports.preflight_conflict(v["required"], v["listeners"], v.sql(OWN), HOST)


# Every other listener has a known process.
PROCESSES = """SELECT CAST((c_custkey * 2 - c_custkey * 2 % 900) / 900 AS INT) AS host, CAST(c_custkey * 2 AS INT) AS pid,
       c_name AS image FROM {customer}"""


@query(
    "listener_process",
    f"""SELECT l.host, l.port, l.pid, l.name, coalesce(p.image, '') AS process
FROM listeners l LEFT JOIN ({PROCESSES.replace('{customer}', 'customer')}) p ON p.host = l.host AND p.pid = l.pid""",
    "listeners",
)
def _(v):
    return ports.listener_process(v["listeners"], v.sql(PROCESSES), HOST)


@query(
    "kill_guard",
    """SELECT host, port, pid, name FROM listeners l
WHERE pid > 0 AND NOT EXISTS (SELECT 1 FROM ours o WHERE o.host = l.host AND o.pid = l.pid)""",
    "listeners ours",
)
def _(v):
    return ports.kill_guard(v["listeners"], v["ours"], HOST)


@query(
    "suggest_free_port",
    """SELECT r.host, r.service_id, r.service_name, r.port,
       coalesce((SELECT min(p) FROM (SELECT unnest(range(greatest(r.port, 1024), least(r.port + 200, 65535))) AS p) c
                 WHERE NOT EXISTS (SELECT 1 FROM listeners l WHERE l.host = r.host AND l.port = p)), 0)::INT AS free_port
FROM requests r""",
    "requests listeners",
)
def _(v):
    return ports.suggest_free_port(v["requests"], v["listeners"], HOST)


@query(
    "port_in_range",
    """SELECT id, port, CASE WHEN port <= 0 OR port >= 65535 THEN 'not in 1-65534' END AS rejected,
       CASE WHEN port < 1024 OR port > 65534 THEN 'not in 1024-65534' END AS rejected_by_form FROM overrides""",
    "overrides",
)
def _(v):
    port = F.col("port")
    return v["overrides"].select(
        "id",
        "port",
        ports.port_in_range(port).alias("rejected"),
        ports.port_in_range(port, 1024, 65534).alias("rejected_by_form"),
    )


@query(
    "peer_vm_owner",
    """SELECT host, port, name, contains(lower(name), 'vboxheadless') OR contains(lower(name), 'virtualboxvm')
       OR contains(lower(name), 'vboxsvc') AS is_vm,
       contains(concat('"', name, '" {', pid, '}'), '"BUILDING"') AS runs FROM listeners""",
    "listeners",
)
def _(v):
    listing = F.concat(F.lit('"'), "name", F.lit('" {'), "pid", F.lit("}"))
    return v["listeners"].select(
        "host",
        "port",
        "name",
        ports.peer_vm_owner(F.col("name")).alias("is_vm"),
        ports.vm_running(listing, "BUILDING").alias("runs"),
    )


# Collected listings: a host is a block of customers, so that a listing has a bounded number of rows.
NETSTAT = """
SELECT c_custkey DIV 1000 AS host, c_custkey AS line_no,
       concat('  TCP    127.0.0.1:', 1024 + (c_custkey * 7) % 300, '     0.0.0.0:0   ',
              CASE WHEN c_mktsegment = 'BUILDING' THEN 'ESTABLISHED ' WHEN c_nationkey = 3 THEN ''
                   ELSE 'LISTENING ' END,
              CASE WHEN c_acctbal < 0 THEN '-' ELSE CAST(c_custkey AS STRING) END) AS line
FROM {customer}"""


@query(
    "parse_netstat",
    """SELECT CAST(c_custkey // 1000 AS INT) AS host, CAST(1024 + (c_custkey * 7) % 300 AS INT) AS port,
       CAST(min(c_custkey) AS INT) AS pid FROM customer
WHERE c_mktsegment <> 'BUILDING' AND c_nationkey <> 3 AND c_acctbal >= 0 GROUP BY ALL""",
)
def _(v):
    place = scratch(v.spark, "netstat")
    # One file per host, as the command wrote it: a block of at most 1,000 lines in order.
    listed = F.array_sort(F.collect_list(F.struct("line_no", "line")))
    dump = F.array_join(F.transform(listed, lambda row: row["line"]), "\n")
    dumps = v.sql(NETSTAT).groupBy("host").agg(dump.alias("value"))
    dumps.write.partitionBy("host").text(place)
    return parsers.parse_netstat(readers.read_dump(v.spark, place), ["host"])


LSOF = """
SELECT c_custkey DIV 1000 AS host, CAST(1024 + c_custkey % 300 AS INT) AS port, c_custkey * 2 + n AS line_no,
       CASE n WHEN 0 THEN concat('p', c_custkey) ELSE concat('c', c_mktsegment) END AS line
FROM {customer} LATERAL VIEW explode(array(0, 1)) AS n WHERE n = 0 OR c_nationkey <> 3"""


@query(
    "parse_lsof",
    """SELECT c_custkey // 1000 AS host, CAST(1024 + c_custkey % 300 AS INT) AS port,
       CAST(max(c_custkey) AS INT) AS pid,
       coalesce(arg_max(c_mktsegment, c_custkey) FILTER (WHERE c_nationkey <> 3), '') AS name
FROM customer GROUP BY ALL""",
)
def _(v):
    return parsers.parse_lsof(v.sql(LSOF), ["host", "port"])


TASKLIST = """
SELECT CASE WHEN c_nationkey = 3 THEN 'INFO: No tasks are running which match the specified criteria.'
            ELSE concat('"', lower(c_mktsegment), '.exe","', c_custkey, '","Console","1","', c_nationkey, ',004 K"')
       END AS line
FROM {customer}"""


@query(
    "parse_tasklist",
    """SELECT CAST(c_custkey AS INT) AS pid, concat(lower(c_mktsegment), '.exe') AS image
FROM customer WHERE c_nationkey <> 3""",
)
def _(v):
    return parsers.parse_tasklist(v.sql(TASKLIST))
