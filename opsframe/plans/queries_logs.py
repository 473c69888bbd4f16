"""Queries on log lines."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from opsframe.functions import scalars as S
from opsframe.operators import logs
from opsframe.operators.ordered import extent
from opsframe.plans.registry import Inputs, query

LEVEL = r"""CASE WHEN regexp_matches(text, '(?i)\b(ERROR|FATAL|SEVERE|Exception|Traceback)\b') THEN 'ERROR'
     WHEN regexp_matches(text, '(?i)\b(WARN(ING)?)\b') THEN 'WARN' ELSE 'INFO' END"""
LEVELED = f"(SELECT *, {LEVEL} AS level FROM log_lines)"
STAMP = "strftime(ts, '%Y-%m-%d %H:%M:%S.%g')"
URL = r"https?://(?:127\.0\.0\.1|localhost)(?::\d+)?/(?:lab|tree)?\??token=[A-Za-z0-9]+"


def leveled(v: Inputs) -> DataFrame:
    return logs.classify_level(v["log_lines"])


@query("classify_level", f"SELECT service, seq, 'INFO' AS level_raw, {LEVEL} AS level FROM log_lines", "log_lines")
def _(v):
    stored = v["log_lines"].withColumn("level", F.lit("INFO"))
    return logs.classify_level(stored).select("service", "seq", "level_raw", "level")


@query(
    "console_filter",
    f"""SELECT service, seq, level, text FROM {LEVELED}
WHERE level IN ('WARN', 'ERROR') AND contains(lower(text), lower('R'))""",
    "log_lines",
)
def _(v):
    return logs.console_filter(leveled(v), "warn", "R").select("service", "seq", "level", "text")


@query(
    "fatal_signature",
    """SELECT service, seq, trim(text) AS match FROM log_lines
WHERE contains(lower(text), 'could not find or load main class') OR contains(lower(text), 'classnotfoundexception')
   OR contains(lower(text), 'no se ha encontrado o cargado la clase')""",
    "log_lines",
)
def _(v):
    return logs.fatal_signature(v["log_lines"]).select("service", "seq", "match")


@query(
    "format_log_line",
    f"""SELECT service, seq, {STAMP} || ' ' || level || ' ' || stream || ' | ' || text AS file_line,
       strftime(ts, '%H:%M:%S.%g') || ' ' || rpad(level, 5, ' ') || ' ' || text AS console_line
FROM {LEVELED}""",
    "log_lines",
)
def _(v):
    return logs.format_log_line(leveled(v))


@query(
    "ring_buffer",
    """SELECT service, seq, text FROM (
  SELECT *, row_number() OVER (PARTITION BY service ORDER BY ts DESC, seq DESC) AS rn FROM log_lines)
WHERE rn <= 100""",
    "log_lines",
)
def _(v):
    return logs.ring_buffer(v["log_lines"], 100).select("service", "seq", "text")


@query(
    "tail_lines",
    """SELECT service, seq, text FROM (
  SELECT *, row_number() OVER (PARTITION BY service ORDER BY ts DESC, seq DESC) AS rn FROM log_lines
  WHERE service IN (SELECT service FROM log_lines WHERE text LIKE 'detenido (exit %'
                    GROUP BY service HAVING max_by(text, seq) <> 'detenido (exit 0)'))
WHERE rn <= 60""",
    "log_lines",
)
def _(v):
    lines = v["log_lines"]
    exits = lines.select("service", "seq", S.extract_exit(F.col("text")).alias("code")).filter("code IS NOT NULL")
    failed = exits.groupBy("service").agg(F.max_by("code", "seq").alias("code")).filter("code <> 0")
    return logs.tail_lines(lines, failed, 60).select("service", "seq", "text")


@query(
    "since_clear",
    """SELECT service, seq, text FROM log_lines l
WHERE seq > coalesce((SELECT max(seq) FROM log_lines c
                      WHERE c.service = l.service AND c.text = 'arrancado con PID 10'), -1)""",
    "log_lines",
)
def _(v):
    lines = v["log_lines"]
    return logs.since_clear(lines, lines.filter(F.col("text") == "arrancado con PID 10")).select(
        "service", "seq", "text"
    )


@query(
    "segment_by_marker",
    """SELECT service, seq, CAST(sum(CASE WHEN text = repeat('=', 60) THEN 1 ELSE 0 END)
       OVER (PARTITION BY service ORDER BY seq) AS BIGINT) AS segment FROM log_lines""",
    "log_lines",
)
def _(v):
    lines = v["log_lines"]
    return logs.segment_by_marker(lines, known=extent(lines, "seq")).select("service", "seq", "segment")


@query(
    "first_match_wins",
    f"""SELECT service, run, min(seq) AS seq, arg_min(m, seq) AS match FROM (
  SELECT service, seq, regexp_extract(text, '{URL}') AS m,
         CAST(sum(CASE WHEN starts_with(text, 'arrancado con PID') THEN 1 ELSE 0 END)
              OVER (PARTITION BY service ORDER BY seq) AS BIGINT) AS run FROM log_lines)
WHERE m <> '' GROUP BY service, run""",
    "log_lines",
)
def _(v):
    text = F.col("text")
    return logs.first_match_wins(v["log_lines"], S.extract_access_url(text), text.startswith("arrancado con PID"))


@query(
    "process_sessions",
    r"""SELECT service, seq, pid, ts AS started, CASE WHEN code IS NOT NULL THEN next_ts END AS finished,
       coalesce(code, -1) AS exit_code
FROM (SELECT service, seq, ts, pid, lead(ts) OVER w AS next_ts, lead(exit_code) OVER w AS code
      FROM (SELECT service, seq, ts, TRY_CAST(regexp_extract(text, 'PID (\d+)', 1) AS INT) AS pid,
                   TRY_CAST(regexp_extract(text, '\(exit (-?\d+)\)', 1) AS INT) AS exit_code FROM log_lines)
      WHERE pid IS NOT NULL OR exit_code IS NOT NULL
      WINDOW w AS (PARTITION BY service ORDER BY seq))
WHERE pid IS NOT NULL""",
    "log_lines",
)
def _(v):
    return logs.process_sessions(v["log_lines"])


@query(
    "tag_counts",
    rf"""SELECT tag, level, count(*) AS lines
FROM (SELECT regexp_extract(text, '^\[([^\]]+)\]', 1) AS tag, level FROM {LEVELED})
WHERE tag <> '' GROUP BY tag, level""",
    "log_lines",
)
def _(v):
    return logs.tag_counts(leveled(v))


@query(
    "level_counts",
    f"SELECT service, level, count(*) AS lines FROM {LEVELED} GROUP BY service, level",
    "log_lines",
)
def _(v):
    return logs.level_counts(leveled(v))


@query("merge_streams", "SELECT service, seq, ts, stream, text FROM log_lines", "log_lines")
def _(v):
    lines = v["log_lines"]
    both = logs.merge_streams(lines.filter("stream = 'stdout'"), lines.filter("stream = 'stderr'"))
    return both.orderBy("ts", "seq").select("service", "seq", "ts", "stream", "text")


# A run's log as its steps wrote it: a separator, the title, and how it ended (a graceful step leaves no end).
STEP_LINES = """
SELECT concat('run', run_id) AS service, CAST(pos * 10 + n AS BIGINT) AS seq,
       CASE n WHEN 0 THEN repeat('=', 60) WHEN 1 THEN concat('[', pos, '/7] step ', pos)
              ELSE CASE WHEN status = 'failed' THEN concat('Paso fallido: ', error)
                        ELSE concat('Paso completado: step ', pos) END END AS text
FROM {steps} CROSS_NUMBERS WHERE n < 2 OR status = 'failed' OR NOT graceful"""


@query(
    "step_runs",
    """SELECT concat('run', run_id) AS service, row_number() OVER (PARTITION BY run_id ORDER BY pos) AS segment,
       concat('step ', pos) AS title, CAST(pos AS INTEGER) AS n, 7 AS total, CAST(pos * 10 AS BIGINT) AS first_line,
       CASE WHEN status = 'failed' OR NOT graceful THEN 3::BIGINT ELSE 2 END AS lines, error AS message,
       CASE WHEN status = 'failed' THEN 'failed' WHEN NOT graceful THEN 'done' ELSE 'open' END AS outcome
FROM steps""",
    "steps",
)
def _(v):
    numbers = "LATERAL VIEW explode(array(0, 1, 2)) AS n"
    lines = v.sql(STEP_LINES.replace("CROSS_NUMBERS", numbers))
    stamped = lines.withColumn("ts", F.timestamp_seconds(F.col("seq")).cast("timestamp_ntz"))
    runs = logs.step_runs(stamped)
    first_line = F.unix_seconds(F.col("started").cast("timestamp")).alias("first_line")
    return runs.select("service", "segment", "title", "n", "total", first_line, "lines", "message", "outcome")
