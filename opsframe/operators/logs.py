"""Log lines: severity, search, rendering, retention, segments, first matches and process sessions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from opsframe.functions import scalars as S
from opsframe.operators.ordered import CHUNK, TASK_ROWS, Extent, Fold, extent, newest_rows, running

# Retention sizes, and the rows that separate the steps of a run.
RING_SIZE = 2000
EXERCISE_RING_SIZE = 4000  # for the lines of exercises
SEPARATORS = ("=" * 60, "─" * 60)


def classify_level(lines: DataFrame, text: str = "text", strict: bool = True) -> DataFrame:
    """Set ``level`` from the text; a stored level is kept as ``level_raw``."""
    if "level" in lines.columns:
        lines = lines.withColumnRenamed("level", "level_raw")
    return lines.withColumn("level", S.detect_level(F.col(text), strict))


def console_filter(lines: DataFrame, threshold: str = "all", query: str = "") -> DataFrame:
    """Lines at or above a severity (``all``, ``warn``, ``error``) whose text contains ``query``."""
    levels = {"all": None, "warn": ["WARN", "ERROR"], "error": ["ERROR"]}[threshold]
    if levels:
        lines = lines.filter(F.col("level").isin(levels))
    if query:
        lines = lines.filter(F.contains(F.lower("text"), F.lower(F.lit(query))))
    return lines


def fatal_signature(lines: DataFrame, signatures: tuple[str, ...] = S.FATAL_SIGNATURES) -> DataFrame:
    """Lines with a load-failure signature, and the line without the blanks around it."""
    return lines.filter(S.contains_any(F.col("text"), signatures)).withColumn(
        "match", F.btrim("text", F.lit(" \t\n\r\f\x0b"))
    )


def format_file_line(ts: Column, level: Column, stream: Column, text: Column) -> Column:
    """``yyyy-MM-dd HH:mm:ss.SSS LEVEL stream | text``"""
    return F.concat(
        F.date_format(ts, "yyyy-MM-dd HH:mm:ss.SSS"), F.lit(" "), level, F.lit(" "), stream, F.lit(" | "), text
    )


def format_console_line(ts: Column, level: Column, text: Column) -> Column:
    """``HH:mm:ss.SSS LEVEL text`` with the level padded to five, longer ones uncut."""
    shown = F.when(F.coalesce(level, F.lit("")) == "", "INFO").otherwise(level)
    padded = F.rpad(shown, F.greatest(F.lit(5), F.length(shown)), F.lit(" "))
    return F.concat(S.clock_millis(ts), F.lit(" "), padded, F.lit(" "), text)


def format_log_line(lines: DataFrame) -> DataFrame:
    """Both renderings of each line."""
    columns = [F.col(name) for name in ("ts", "level", "stream", "text")]
    ts, level, _, text = columns
    return lines.select(
        "service",
        "seq",
        format_file_line(*columns).alias("file_line"),
        format_console_line(ts, level, text).alias("console_line"),
    )


def ring_buffer(lines: DataFrame, n: int = RING_SIZE) -> DataFrame:
    """Newest ``n`` lines per service (the default size where ``n`` is not positive)."""
    return newest_rows(lines, ["service"], ["ts", "seq"], n if n > 0 else RING_SIZE)


def tail_lines(lines: DataFrame, failed: DataFrame, k: int = 60) -> DataFrame:
    """Last ``k`` lines of the services in ``failed``."""
    wanted = failed.select("service").distinct()
    return newest_rows(lines.join(wanted, "service", "left_semi"), ["service"], ["ts", "seq"], k)


def since_clear(lines: DataFrame, clears: DataFrame) -> DataFrame:
    """Lines after the last clear mark (``service, seq``) of their service; all where there is none."""
    marks = clears.groupBy("service").agg(F.max("seq").alias("_mark"))
    kept = lines.join(marks, "service", "left").filter(F.col("_mark").isNull() | (F.col("seq") > F.col("_mark")))
    return kept.select(*lines.columns)


def segment_by_marker(
    lines: DataFrame,
    marker: Column | None = None,
    sink: str = "service",
    width: int = CHUNK,
    known: Extent | None = None,
    chunks: str | None = None,
) -> DataFrame:
    """Number the segments that separator rows open; lines before the first one are in segment 0.

    ``known`` and ``chunks`` are those of ``running``.
    """
    marker = F.col("text").isin(*SEPARATORS) if marker is None else marker
    fold = Fold("sum", F.coalesce(marker, F.lit(False)).cast("bigint"))
    return running(lines, [sink], "seq", {"segment": fold}, width, known=known, chunks=chunks)


def first_match_wins(
    lines: DataFrame, match: Column, restart: Column, width: int = CHUNK, per_task: int = TASK_ROWS
) -> DataFrame:
    """First non-blank match of each run; a restart row opens the next run of its service."""
    known = extent(lines, "seq", width, per_task)
    runs = segment_by_marker(lines, restart, width=width, known=known).withColumn("_match", match)
    found = runs.filter(F.col("_match") != "").groupBy("service", F.col("segment").alias("run"))
    return found.agg(F.min("seq").alias("seq"), F.min_by("_match", "seq").alias("match"))


def merge_streams(out: DataFrame, err: DataFrame) -> DataFrame:
    """Both outputs of a process as one log; readers order it by ``ts, seq``."""
    return out.unionByName(err)


def process_sessions(lines: DataFrame, width: int = CHUNK) -> DataFrame:
    """One row per process start: pid, start, end and exit code.

    The next lifecycle line of the service closes the session if it reports an exit. Otherwise the process
    counts as running: no end, exit code -1.
    """
    lifecycle = F.contains("text", F.lit("PID ")) | F.contains("text", F.lit("(exit "))
    events = (
        lines.filter(lifecycle)
        .select(
            "service",
            "seq",
            "ts",
            S.extract_pid(F.col("text")).alias("pid"),
            S.extract_exit(F.col("text")).alias("exit_code"),
        )
        .filter(F.col("pid").isNotNull() | F.col("exit_code").isNotNull())
    )
    after = {"finished": Fold("lag", F.col("ts")), "_exit": Fold("lag", F.col("exit_code"))}
    paired = running(events, ["service"], "seq", after, width, backwards=True).filter(F.col("pid").isNotNull())
    closed = F.col("_exit").isNotNull()
    return paired.select(
        "service",
        "seq",
        "pid",
        F.col("ts").alias("started"),
        F.when(closed, F.col("finished")).alias("finished"),
        F.coalesce("_exit", F.lit(-1)).alias("exit_code"),
    )


def tag(text: Column) -> Column:
    """Leading ``[tag]`` of a line without the brackets; blank if it has none."""
    return F.regexp_extract(text, r"^\[([^\]]+)\]", 1)


def tag_counts(lines: DataFrame) -> DataFrame:
    """Lines per leading tag and severity."""
    tagged = lines.withColumn("tag", tag(F.col("text"))).filter(F.col("tag") != "")
    return tagged.groupBy("tag", "level").agg(F.count("*").alias("lines"))


def level_counts(lines: DataFrame) -> DataFrame:
    """Lines per service and severity."""
    return lines.groupBy("service", "level").agg(F.count("*").alias("lines"))


# How a step's title, success and failure show in its lines.
STEP_TITLE = r"(?s)^\[(\d+)/(\d+)\] (.*)\z"
STEP_NAME = r"(?s)^Ejecutando (?:paso|acción): (.*)\z"
STEP_DONE = r"^(?:Paso completado|Acción completada): |^✓ Ejercicio completado\.\z"
STEP_FAILED = r"(?s)^(?:Paso fallido|Acción fallida): (.*)\z"
STEP_FAILED_AT = r"(?s)^Paso \d+ falló: (.*)\. Detengo la secuencia\.\z"


def _cut(text: Column, title: str, name: str, done: str, failed: tuple[str, ...]) -> Column:
    """A line's layout, in one pass over it: the match is exchanged for its groups, each behind a separator.

    Layouts exclude each other, so they are one pattern; ``done`` has no groups. Other lines are one part.
    """
    one = "|".join(f"(?:{layout})" for layout in (title, f"({name})", f"({done})", *failed))
    groups = range(1, _FIRST_MESSAGE + len(failed))
    return F.split(F.regexp_replace(text, one, _GAP + _GAP.join(f"${k}" for k in groups) + _GAP), _GAP)


def _said(text: Column, cut: Column, title: str, name: str, done: str, failed: tuple[str, ...]) -> dict[str, Column]:
    """What a line says of a step: title, n, total, message, done; nulls where it says nothing.

    ``cut`` is a column, so that the line is read once. Lines that have the separator themselves are taken apart group
    by group.
    """
    at = lambda k: F.get(cut, F.lit(k))
    part = lambda pattern, k: F.regexp_extract(text, pattern, k)
    messages = [F.nullif(at(_FIRST_MESSAGE + k), F.lit("")) for k in range(len(failed))]
    quick = {
        "title": F.when(at(1) != "", at(3)).when(at(4) != "", at(5)),
        "n": at(1),
        "total": at(2),
        "message": F.coalesce(*messages),
        "done": at(6) != "",
    }
    slow = {
        "title": F.when(text.rlike(title), part(title, 3)).when(text.rlike(name), part(name, 1)),
        "n": part(title, 1),
        "total": part(title, 2),
        "message": F.coalesce(*[F.nullif(part(pattern, 1), F.lit("")) for pattern in failed]),
        "done": text.rlike(done),
    }
    odd, found = F.contains(text, F.lit(_GAP)), F.size(cut) >= _FIRST_MESSAGE + len(failed)
    return {key: F.when(odd, slow[key]).when(found, quick[key]) for key in quick}


_FIRST_MESSAGE = 7  # behind number, total and title, the line with a name, the name, and the line of success
_GAP = "\u0001"


def step_runs(
    lines: DataFrame,
    title: str = STEP_TITLE,
    name: str = STEP_NAME,
    done: str = STEP_DONE,
    failed: tuple[str, ...] = (STEP_FAILED, STEP_FAILED_AT),
    marker: Column | None = None,
    width: int = CHUNK,
    per_task: int = TASK_ROWS,
) -> DataFrame:
    """One row per executed step, recovered from a run's log: title, place, first and last line, outcome.

    A separator row opens a step. It is ``failed`` (with the first message) if a line says so, else ``done``
    if a line says so, else ``open``. The lines are counted first, and dealt to tasks of about ``per_task``.
    """
    known = extent(lines, "seq", width, per_task)
    # Lines are read before they are shuffled: what they say is far shorter than they are.
    opens = F.coalesce(F.col("text").isin(*SEPARATORS) if marker is None else marker, F.lit(False)).alias("_opens")
    text, layouts = F.col("text"), (title, name, done, failed)
    cut = lines.select("service", "seq", "ts", "text", opens, _cut(text, *layouts).alias("_cut"))
    said = _said(text, F.col("_cut"), *layouts)
    said = cut.select(
        "service",
        "seq",
        "ts",
        "_opens",
        said["title"].alias("_title"),
        S.to_int(said["n"]).alias("_n"),
        S.to_int(said["total"]).alias("_total"),
        said["message"].alias("_message"),
        F.coalesce(said["done"], F.lit(False)).alias("_done"),
    )
    numbered = segment_by_marker(said, F.col("_opens"), width=width, known=known, chunks="_chunk")

    def first(column: str) -> Column:
        return F.min(F.when(F.col(column).isNotNull(), F.struct("seq", F.col(column).alias("value"))))

    # Lines of a chunk are together already, so this needs no shuffle.
    runs = numbered.filter(F.col("segment") > 0).groupBy("service", "segment", "_chunk").agg(
        first("_title").alias("title"),
        first("_n").alias("n"),
        first("_total").alias("total"),
        F.min("ts").alias("started"),
        F.max("ts").alias("ended"),
        F.count("*").alias("lines"),
        first("_message").alias("message"),
        F.max("_done").alias("_done"),
    )
    if not known.single:  # a step may lie in several chunks
        if known.tasks:
            runs = runs.repartition(known.tasks, "service", "segment")
        earliest = [F.min(name).alias(name) for name in ("title", "n", "total", "started")]
        count = F.coalesce(F.sum("lines"), F.lit(0)).alias("lines")
        runs = runs.groupBy("service", "segment").agg(
            *earliest, F.max("ended").alias("ended"), count, F.min("message").alias("message"), F.max("_done").alias("_done")
        )
    runs = runs.drop("_chunk").withColumns({name: F.col(f"{name}.value") for name in ("title", "n", "total", "message")})
    outcome = F.when(F.col("message").isNotNull(), "failed").when(F.col("_done"), "done").otherwise("open")
    return runs.withColumn("outcome", outcome).drop("_done")
