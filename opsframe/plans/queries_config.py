"""Queries on settings, change logs and step outcomes."""

from __future__ import annotations

from pyspark.sql import functions as F

from opsframe.functions import scalars as S
from opsframe.operators import catalog, config, steps
from opsframe.plans.registry import query


@query(
    "port_overrides",
    """SELECT d.id, d.name, d.heap, CASE WHEN o.port > 0 THEN o.port ELSE d.port END AS port
FROM defaults d LEFT JOIN overrides o ON o.id = d.id""",
    "defaults overrides",
)
def _(v):
    return config.port_overrides(v["defaults"], v["overrides"])


@query(
    "heap_overrides",
    """SELECT d.id, d.name, d.port, coalesce(nullif(o.heap, ''), d.heap) AS heap
FROM defaults d LEFT JOIN overrides o ON o.id = d.id""",
    "defaults overrides",
)
def _(v):
    return config.heap_overrides(v["defaults"], v["overrides"])


# Every third override has an id that no service has.
STRAY = "SELECT CASE WHEN id % 3 = 0 THEN -id ELSE id END AS id, port, heap FROM {overrides}"


@query(
    "orphan_overrides",
    f"SELECT id, port, heap FROM ({STRAY.replace('{overrides}', 'overrides')}) WHERE id NOT IN (SELECT c_custkey FROM customer)",
    "overrides",
)
def _(v):
    return config.orphan_overrides(v["customer"].select(F.col("c_custkey").alias("id")), v.sql(STRAY))


BASE = """SELECT o_custkey AS owner, o_orderkey AS pos,
       CASE o_orderstatus WHEN 'P' THEN o_orderpriority ELSE concat(o_orderpriority, '=', o_orderstatus) END AS entry
FROM {orders}"""
CHANGED = """SELECT c_custkey AS owner, CASE WHEN c_nationkey < 12 THEN '1-URGENT' ELSE 'NEW' END AS key,
       c_mktsegment AS value FROM {customer}"""


@query(
    "kv_overlay",
    f"""WITH base AS ({BASE.replace('{orders}', 'orders')}), changed AS ({CHANGED.replace('{customer}', 'customer')})
SELECT b.owner, 0 AS section, b.pos, CASE WHEN contains(entry, '=') THEN split_part(entry, '=', 1) END AS key,
       CASE WHEN c.value IS NULL THEN b.entry ELSE concat(c.key, '=', c.value) END AS entry
FROM base b LEFT JOIN changed c ON c.owner = b.owner AND contains(entry, '=') AND c.key = split_part(entry, '=', 1)
UNION ALL
SELECT owner, 1, NULL, key, concat(key, '=', value) FROM changed c
WHERE NOT EXISTS (SELECT 1 FROM base b WHERE b.owner = c.owner AND contains(entry, '=')
                  AND split_part(entry, '=', 1) = c.key)""",
)
def _(v):
    return config.kv_overlay(v.sql(BASE), v.sql(CHANGED))


@query(
    "kv_split",
    f"""SELECT owner, pos, CASE WHEN contains(entry, '=') THEN split_part(entry, '=', 1) END AS key,
       CASE WHEN contains(entry, '=') THEN substr(entry, instr(entry, '=') + 1) END AS value
FROM ({BASE.replace('{orders}', 'orders')})""",
)
def _(v):
    entry = F.col("entry")
    return v.sql(BASE).select("owner", "pos", S.kv_key(entry).alias("key"), S.kv_value(entry).alias("value"))


@query(
    "split_fields",
    r"""SELECT c_custkey AS id, len(f) AS fields, f[1] AS first, f[len(f)] AS last
FROM (SELECT c_custkey, list_filter(string_split_regex(concat('  ', c_name, '   ', c_mktsegment, chr(9), c_nationkey),
             '\s+'), lambda x: x <> '') AS f FROM customer)""",
)
def _(v):
    line = F.concat(F.lit("  "), "c_name", F.lit("   "), "c_mktsegment", F.lit("\t"), "c_nationkey")
    rows = v["customer"].select(F.col("c_custkey").alias("id"), S.split_fields(line).alias("f"))
    return rows.select(
        "id",
        F.size("f").cast("bigint").alias("fields"),
        F.element_at("f", 1).alias("first"),
        F.element_at("f", -1).alias("last"),
    )


EXPECTED = """SELECT c_custkey AS host, name, CASE name WHEN 'fs.defaultFS' THEN 'hdfs://localhost:9000'
       ELSE concat('file:///srv/', c_custkey, '/data') END AS value
FROM {customer} LATERAL VIEW explode(array('fs.defaultFS', 'hadoop.tmp.dir')) AS name"""
ACTUAL = """SELECT c_custkey AS host, name, CASE WHEN name = 'fs.defaultFS' THEN 'hdfs://localhost:9000'
       WHEN c_nationkey < 5 THEN '/Users/old/data' ELSE concat('file:///srv/', c_custkey, '/data') END AS value
FROM {customer} LATERAL VIEW explode(array('fs.defaultFS', 'hadoop.tmp.dir', 'dfs.extra')) AS name
WHERE NOT (name = 'dfs.extra' AND c_nationkey <> 7) AND NOT (name = 'hadoop.tmp.dir' AND c_nationkey = 9)"""


@query(
    "config_drift",
    """SELECT c_custkey AS host, name, expected, actual,
       CASE WHEN actual IS NULL THEN 'missing' WHEN expected IS NULL THEN 'extra' ELSE 'changed' END AS drift,
       coalesce(contains(actual, '/Users/'), false) AS stale
FROM (SELECT c_custkey, 'hadoop.tmp.dir' AS name, concat('file:///srv/', c_custkey, '/data') AS expected,
             CASE WHEN c_nationkey < 5 THEN '/Users/old/data' END AS actual
      FROM customer WHERE c_nationkey < 5 OR c_nationkey = 9
      UNION ALL
      SELECT c_custkey, 'dfs.extra', NULL, concat('file:///srv/', c_custkey, '/data') FROM customer
      WHERE c_nationkey = 7)""",
)
def _(v):
    return config.config_drift(v.sql(EXPECTED), v.sql(ACTUAL), "/Users/", ["host", "name"])


ENV_LINES = """SELECT c_custkey AS file, n AS line_no,
       CASE n WHEN 0 THEN concat('@rem set HADOOP_IDENT_STRING=%U%', chr(13))
              WHEN 1 THEN concat('  SET HADOOP_IDENT_STRING=', CASE WHEN c_nationkey = 4 THEN 'fleet'
                                 ELSE c_name END, chr(13))
              ELSE 'set JAVA_HOME=/opt/java' END AS line
FROM {customer} LATERAL VIEW explode(array(0, 1, 2)) AS n"""


@query(
    "line_rewrite",
    """SELECT c_custkey AS file, CAST(n AS INT) AS line_no,
       CASE n WHEN 0 THEN '@rem set HADOOP_IDENT_STRING=%U%' || chr(13)
              WHEN 1 THEN 'set HADOOP_IDENT_STRING=fleet' || chr(13) ELSE 'set JAVA_HOME=/opt/java' END AS line,
       n = 1 AS changed
FROM customer, range(3) r(n)""",
)
def _(v):
    return config.line_rewrite(v.sql(ENV_LINES), "fleet")


@query(
    "merge_maps",
    """SELECT id, coalesce(nullif(o.heap, ''), '1g') AS elasticsearch, '1g' AS hadoop, o.heap AS kafka,
       nullif(o.heap, '') AS replaced
FROM defaults LEFT JOIN overrides o USING (id)""",
    "defaults overrides",
)
def _(v):
    rows = v.sql("SELECT d.id, o.heap AS loaded FROM {defaults} d LEFT JOIN {overrides} o ON o.id = d.id")
    defaults = F.create_map(*[F.lit(x) for x in ("elasticsearch", "1g", "hadoop", "1g")])
    set_heap = F.nullif("loaded", F.lit(""))
    loaded = F.map_filter(
        F.create_map(F.lit("elasticsearch"), set_heap, F.lit("kafka"), F.col("loaded")),
        lambda key, value: value.isNotNull(),
    )
    own = F.when(set_heap.isNotNull(), F.create_map(F.lit("elasticsearch"), set_heap))
    merged = config.merge_maps(defaults, loaded)
    replaced = config.merge_maps(F.create_map().cast("map<string,string>"), own, "replace")
    return rows.select(
        "id",
        merged["elasticsearch"].alias("elasticsearch"),
        merged["hadoop"].alias("hadoop"),
        merged["kafka"].alias("kafka"),
        replaced["elasticsearch"].alias("replaced"),
    )


SETTINGS = """SELECT concat('h', c_custkey) AS host,
       CASE WHEN c_nationkey < 5 THEN '' WHEN c_nationkey < 10 THEN NULL ELSE 'en' END AS language,
       CASE WHEN c_acctbal > 0 THEN true END AS setup_completed, CAST(NULL AS BOOLEAN) AS always_on_top,
       CASE WHEN c_nationkey % 2 = 0 THEN false END AS auto_start_notebooks,
       CASE WHEN c_nationkey = 3 THEN map('kafka', CAST(c_custkey AS INT)) END AS port_overrides,
       CASE WHEN c_nationkey > 12 THEN map('elasticsearch', '2g') END AS jvm_heap
FROM {customer}"""
SETTINGS_CHECK = """SELECT concat('h', c_custkey) AS host, CASE WHEN c_nationkey < 10 THEN 'es' ELSE 'en' END AS language,
       c_acctbal > 0 AS setup_completed, false AS always_on_top, c_nationkey % 2 <> 0 AS auto_start_notebooks,
       CASE WHEN c_nationkey = 3 THEN CAST(c_custkey AS INT) END AS kafka_port,
       CASE WHEN c_nationkey > 12 THEN '2g' ELSE '1g' END AS elasticsearch_heap, '1g' AS hadoop_heap
FROM customer"""


def flat_settings(settings):
    return settings.select(
        *[c for c in settings.columns if c not in ("port_overrides", "jvm_heap")],
        F.col("port_overrides")["kafka"].alias("kafka_port"),
        F.col("jvm_heap")["elasticsearch"].alias("elasticsearch_heap"),
        F.col("jvm_heap")["hadoop"].alias("hadoop_heap"),
    )


@query("settings_defaults", SETTINGS_CHECK)
def _(v):
    return flat_settings(config.settings_defaults(v.sql(SETTINGS)))


# Some changes are resets, which name no key; three of the keys belong to registered services.
CHANGE_LOG = """SELECT owner, CASE WHEN seq % 7 <> 0 THEN key END AS key, seq,
       CASE WHEN seq % 7 <> 0 THEN op ELSE 'reset' END AS op, value FROM {changes}"""
REGISTERED = ("1-URGENT", "2-HIGH", "3-MEDIUM")


@query(
    "apply_changes",
    f"""SELECT owner, key, value FROM (
  SELECT owner, key, seq, value FROM ({CHANGE_LOG.replace('{changes}', 'changes')}) WHERE op <> 'reset'
  QUALIFY row_number() OVER (PARTITION BY owner, key ORDER BY seq DESC) = 1 AND op = 'set'
) LEFT JOIN (SELECT owner, max(seq) AS reset FROM changes WHERE seq % 7 = 0 GROUP BY owner) USING (owner)
WHERE NOT coalesce(seq < reset AND key IN {REGISTERED}, false)""",
    "changes",
)
def _(v):
    registered = v.spark.createDataFrame([(key,) for key in REGISTERED], "id STRING")
    return config.apply_changes(v.sql(CHANGE_LOG), registered)


PATHS = """SELECT id, map('home', concat('/srv/', id), 'logs', concat('/srv/', id, '/logs')) AS paths FROM {defaults}"""


@query(
    "explode_map",
    """SELECT id, 'home' AS key, concat('/srv/', id) AS value FROM defaults
UNION ALL SELECT id, 'logs', concat('/srv/', id, '/logs') FROM defaults""",
    "defaults",
)
def _(v):
    return config.explode_map(v.sql(PATHS), "paths", "id").orderBy("id", "key")


@query(
    "all_steps_done",
    """SELECT run_id, bool_and(status = 'done') AS complete, count(*) FILTER (WHERE status = 'done') AS done,
       count(*) FILTER (WHERE status = 'failed') AS failed, count(*) FILTER (WHERE status = 'running') AS running,
       count(*) FILTER (WHERE status = 'pending') AS pending
FROM steps GROUP BY run_id""",
    "steps",
)
def _(v):
    return steps.all_steps_done(v["steps"])


@query(
    "collect_errors",
    "SELECT run_id, pos, error FROM steps WHERE error IS NOT NULL",
    "steps",
)
def _(v):
    return steps.collect_errors(v["steps"])


@query(
    "error_texts",
    "SELECT run_id, string_agg(error, chr(10) ORDER BY pos) AS errors FROM steps GROUP BY run_id",
    "steps",
)
def _(v):
    return steps.error_texts(v["steps"])


@query(
    "until_first_failure",
    """SELECT run_id, pos, status, CASE WHEN coalesce(sum(CASE WHEN status = 'failed' THEN 1 ELSE 0 END) OVER (
         PARTITION BY run_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) = 0
       THEN 'executed' ELSE 'pending' END AS execution
FROM steps""",
    "steps",
)
def _(v):
    return steps.until_first_failure(v["steps"]).select("run_id", "pos", "status", "execution")


@query(
    "upsert_registry",
    """SELECT run_id AS id, min(pos) AS ordinal, arg_max(status, pos) AS status FROM steps GROUP BY run_id""",
    "steps",
)
def _(v):
    entries = v["steps"].select(F.col("run_id").alias("id"), "pos", "status")
    return config.upsert_registry(entries)


@query("registration_order", "SELECT run_id, pos, status FROM steps", "steps")
def _(v):
    return catalog.registration_order(v["steps"].select("run_id", "pos", "status"), "pos", reverse=True)


@query(
    "template_fill",
    """SELECT run_id, pos, concat('file:///srv/', run_id, '/data/hdfs') AS value,
       concat('step ', pos, ' of ', run_id, ': ') AS text FROM steps""",
    "steps",
)
def _(v):
    uri = F.concat(F.lit("file:///srv/"), "run_id")
    args = F.array(F.col("pos").cast("string"), F.col("run_id").cast("string"))
    return v["steps"].select(
        "run_id",
        "pos",
        S.template_fill(F.lit("{{.URI}}/data/hdfs"), uri).alias("value"),
        S.placeholder_fill(F.lit("step {0} of {1}: {2}"), args).alias("text"),
    )


@query("clock_millis", "SELECT seq, strftime(ts, '%H:%M:%S.%g') AS clock FROM log_lines", "log_lines")
def _(v):
    return v["log_lines"].select("seq", S.clock_millis(F.col("ts")).alias("clock"))


@query(
    "extract_access_url",
    r"""SELECT seq, regexp_extract(text,
       'https?://(?:127\.0\.0\.1|localhost)(?::\d+)?/(?:lab|tree)?\??token=[A-Za-z0-9]+') AS url FROM log_lines""",
    "log_lines",
)
def _(v):
    return v["log_lines"].select("seq", S.extract_access_url(F.col("text")).alias("url"))


@query(
    "strip_cr",
    "SELECT seq, text || CASE WHEN seq % 2 = 0 THEN chr(13) ELSE '' END AS one, text AS every FROM log_lines",
    "log_lines",
)
def _(v):
    raw = F.concat("text", F.when(F.col("seq") % 2 == 0, "\r\r").otherwise("\r"))
    return v["log_lines"].select("seq", S.strip_cr(raw).alias("one"), S.strip_cr(raw, every=True).alias("every"))


@query(
    "extract_pid_exit",
    r"""SELECT seq, TRY_CAST(regexp_extract(text, 'PID (\d+)', 1) AS INT) AS pid,
       TRY_CAST(regexp_extract(text, '\(exit (-?\d+)\)', 1) AS INT) AS exit_code FROM log_lines""",
    "log_lines",
)
def _(v):
    text = F.col("text")
    return v["log_lines"].select(
        "seq", S.extract_pid(text).alias("pid"), S.extract_exit(text).alias("exit_code")
    )
