"""Batch operators on literal cases."""

import datetime

import pandas as pd
import pytest
from pyspark.sql import functions as F

from opsframe.operators import catalog, config, logs, ports, status, steps, telemetry, text

T0 = datetime.datetime(2024, 1, 1)


def at(seconds):
    return T0 + datetime.timedelta(seconds=seconds)


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def lines_of(spark, *texts, service="a"):
    data = [(service, n, at(n), "stdout", t) for n, t in enumerate(texts)]
    return spark.createDataFrame(data, "service STRING, seq BIGINT, ts TIMESTAMP_NTZ, stream STRING, text STRING")


# Text


def test_top_words_ties(spark):
    lines = spark.createDataFrame([("a a b",), ("b  b c\tc ",)], "text STRING")
    counts = text.word_count(lines)
    assert [r["word"] for r in text.top_words(counts).collect()] == ["b", "c", "a"]
    assert text.top_words(counts, 1).count() == 1


def test_user_programs(spark):
    from opsframe.plans.queries_text import MAPPER, REDUCER, program

    lines = spark.createDataFrame([("a b",), ("é a",), ("",), ("b a\nc",)], "text STRING").repartition(3)
    for combiner in (None, program(REDUCER)):
        got = text.pipe_mapreduce(lines, program(MAPPER), program(REDUCER), combiner, partitions=3)
        assert rows(got) == [("a", "3"), ("b", "2"), ("c", "1"), ("é", "1")]


def test_failing_program_fails_the_job(spark):
    lines = spark.createDataFrame([("a",)], "text STRING")
    with pytest.raises(Exception):
        text.pipe_mapreduce(lines, "exit 3", "cat").collect()
    for mapper, reducer, combiner in (
        ("echo a; exit 3", "cat", "cat"),
        ("cat", "cat", "cat > /dev/null; exit 4"),
        ("cat", "cat > /dev/null; exit 5", "cat"),
    ):
        with pytest.raises(Exception, match="status|exit"):
            text.pipe_mapreduce(lines, mapper, reducer, combiner).collect()


def test_programs_that_do_not_read_and_odd_output(spark):
    lines = spark.range(50_000).select(F.concat(F.lit("k"), F.col("id") % 7, F.lit("\t"), F.lit("v" * 50)).alias("text")).repartition(2)
    one = text.pipe_mapreduce(lines, "head -n 1 || true", "cat").collect()
    assert len(one) == 2
    odd = spark.createDataFrame([("a\\n\\n b",), (None,), ("no tab",)], "text STRING").repartition(1)
    got = text.pipe_mapreduce(odd, "cat; printf '\\377\\tx\\nlast\\ty'", "cat", "cat").collect()
    assert sorted(map(tuple, got)) == sorted([("a\\n\\n b", ""), ("", ""), ("no tab", ""), ("\ufffd", "x"), ("last", "y")])
    with pytest.raises(Exception, match="status 3.*out of luck"):
        text.pipe_mapreduce(lines, "cat > /dev/null; echo out of luck >&2; exit 3", "cat").collect()


@pytest.mark.parametrize("spill", [64, 1 << 25])
def test_a_hot_key_leaves_map_tasks_combined(spark, monkeypatch, spill):
    from opsframe.operators import pipes
    from opsframe.plans.queries_text import MAPPER, REDUCER, program

    monkeypatch.setattr(pipes, "SPILL", spill)
    lines = spark.range(4_000).select(F.when(F.col("id") % 3 == 0, "hot cold").otherwise(F.concat(F.lit("w"), F.col("id") % 11)).alias("text"))
    lines = lines.repartition(4)
    mapping = pipes.mapped_and_combined(program(MAPPER), program(REDUCER))
    sent = lines.mapInArrow(mapping, "line STRING")
    hot = [r.line for r in sent.collect() if r.line.startswith("hot\t")]
    assert sum(int(x.split("\t")[1]) for x in hot) == 1_334
    assert len(hot) == 4 or spill < 1_000
    got = dict(map(tuple, text.pipe_mapreduce(lines, program(MAPPER), program(REDUCER), program(REDUCER)).collect()))
    want = {r["word"]: str(r["count"]) for r in text.word_count(lines).collect()}
    assert got == want
    # The same job again gives the same.
    assert dict(map(tuple, text.pipe_mapreduce(lines, program(MAPPER), program(REDUCER), program(REDUCER)).collect())) == want


def test_programs_are_fed_in_blocks_of_bounded_size(monkeypatch):
    import pyarrow as pa

    from opsframe.operators import pipes

    lines = ["x" * (n % 50) for n in range(1_000)] + ["y" * 5_000, None, "", "é", "z"]
    monkeypatch.setattr(pipes, "FEED", 1_000, raising=False)
    for kind in (pa.string(), pa.large_string()):
        batch = pa.RecordBatch.from_arrays([pa.array(["cut off", *lines], kind)], names=["text"]).slice(1)
        blocks = [bytes(block) for block in pipes.inputs(iter([batch, batch.slice(0, 0), batch.slice(3, 2)]))]
        assert b"".join(blocks).decode() == "".join(f"{x or ''}\n" for x in [*lines, *lines[3:5]])
        assert max(map(len, blocks)) < 6_100 and max(len(block) for block in blocks if b"y" not in block) < 1_100


def test_slices_hold_whole_lines(monkeypatch):
    monkeypatch.setattr(text, "SLICE_CHARS", 10)
    lines = pd.Series(["abc", "defg", None, "x" * 25, "", "y"])
    parts = list(text.slices(lines))
    assert [line for part in parts for line in part] == list(lines) and len(parts) > 1
    assert all(len(part) == 1 or part.str.len().sum() <= 35 for part in parts)


def test_python_functions(spark):
    data = [("hot x",)] * 50 + [(f"w{n} hot",) for n in range(30)] + [("",)]
    lines = spark.createDataFrame(data, "text STRING").repartition(4)
    want = rows(text.word_count(lines))
    assert rows(text.map_reduce_udf(lines, text.emit_ones, text.sum_rows)) == want
    assert rows(text.map_group_udf(lines, text.emit_ones, text.sum_batches)) == want


def test_python_functions_across_batches(spark):
    size = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        lines = spark.createDataFrame([("a b c d a",)] * 20, "text STRING").repartition(5)
        assert rows(text.map_reduce_udf(lines, text.emit_ones, text.sum_rows)) == [
            ("a", 40),
            ("b", 20),
            ("c", 20),
            ("d", 20),
        ]
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)


def test_table_function(spark):
    text.register_functions(spark)
    assert rows(spark.sql("SELECT * FROM emit_words('a  b')")) == [("a", 1), ("b", 1)]


# Logs


def test_console_filter(spark):
    data = spark.createDataFrame(
        [("WARN", "a boom"), ("INFO", "boom"), ("ERROR", "x"), ("ERROR", "Boom")], "level STRING, text STRING"
    )
    assert rows(logs.console_filter(data, "warn", "BOOM")) == [("ERROR", "Boom"), ("WARN", "a boom")]
    assert logs.console_filter(data, "error").count() == 2
    assert logs.console_filter(data).count() == 4
    assert logs.console_filter(data, query="%").count() == 0


def test_stored_level_is_kept(spark):
    data = spark.createDataFrame([("INFO", "an error")], "level STRING, text STRING")
    assert logs.classify_level(data).first().asDict() == {"level_raw": "INFO", "text": "an error", "level": "ERROR"}


def test_fatal_signature(spark):
    found = logs.fatal_signature(
        lines_of(spark, " \tCould NOT find or load main class PC ", "ok", "No se ha encontrado o cargado la clase X")
    )
    assert [r["match"] for r in found.orderBy("seq").collect()] == [
        "Could NOT find or load main class PC",
        "No se ha encontrado o cargado la clase X",
    ]


def test_ring_buffer_size(spark):
    many = lines_of(spark, *["x"] * 2100)
    assert logs.ring_buffer(many, 0).count() == 2000
    assert logs.ring_buffer(many, 4000).count() == 2100
    assert sorted(r.seq for r in logs.ring_buffer(many, 2).collect()) == [2098, 2099]


def test_tail_and_clear(spark):
    both = lines_of(spark, *"abcdef").union(lines_of(spark, *"xyz", service="b"))
    failed = spark.createDataFrame([("a",), ("a",)], "service STRING")
    assert [r.text for r in logs.tail_lines(both, failed, 2).orderBy("seq").collect()] == ["e", "f"]
    clears = spark.createDataFrame([("a", 1), ("a", 3)], "service STRING, seq BIGINT")
    kept = logs.since_clear(both, clears)
    assert [(r.service, r.text) for r in kept.orderBy("service", "seq").collect()] == [
        ("a", "e"),
        ("a", "f"),
        ("b", "x"),
        ("b", "y"),
        ("b", "z"),
    ]


def test_segments(spark):
    marked = logs.segment_by_marker(lines_of(spark, "a", "=" * 60, "b", "─" * 60, "=" * 59), width=2)
    assert [r.segment for r in marked.orderBy("seq").collect()] == [0, 1, 1, 2, 2]


def test_first_match_with_restart(spark):
    lines = lines_of(spark, "u a", "u b", "start", "u c", "start", "none")
    match = F.regexp_extract("text", r"^u (\w)", 1)
    found = logs.first_match_wins(lines, match, F.col("text") == "start", width=2)
    assert rows(found) == [("a", 0, 0, "a"), ("a", 1, 3, "c")]


def test_process_sessions(spark):
    lines = lines_of(
        spark, "arrancado con PID 7", "x", "detenido (exit 3)", "detenido (exit 0)", "arrancado con PID 8",
        "arrancado con PID 9",
    )
    got = [tuple(r) for r in logs.process_sessions(lines, width=2).orderBy("seq").collect()]
    assert got == [
        ("a", 0, 7, at(0), at(2), 3),
        ("a", 4, 8, at(4), None, -1),
        ("a", 5, 9, at(5), None, -1),
    ]


def test_tags(spark):
    lines = logs.classify_level(lines_of(spark, "[heal] x", "[heal] error", "[2/6] step", "no [tag]", "[] x"))
    assert rows(logs.tag_counts(lines)) == [("2/6", "INFO", 1), ("heal", "ERROR", 1), ("heal", "INFO", 1)]


def test_step_runs(spark):
    rule = "─" * 60
    lines = lines_of(
        spark, "before", rule, "[1/3] one", "work", rule, "[2/3] two",
        "Paso 2 falló: exit status 1. Detengo la secuencia.", "=" * 60, "Ejecutando paso: Kafka",
        "Paso completado: Kafka", rule, "[3/3] three",
    )
    got = logs.step_runs(lines, width=3).orderBy("segment").collect()
    assert [(r.title, r.n, r.total, r.lines, r.message, r.outcome) for r in got] == [
        ("one", 1, 3, 3, None, "open"),
        ("two", 2, 3, 3, "exit status 1", "failed"),
        ("Kafka", None, None, 3, None, "done"),
        ("three", 3, 3, 2, None, "open"),
    ]
    assert (got[0].started, got[0].ended) == (at(1), at(3))
    # A line with the separator of the layouts' groups is read like others; so is a width that holds all.
    odd = lines.withColumn("text", F.replace("text", F.lit("two"), F.lit("t\u0001w\u0001o")))
    assert [r.title for r in logs.step_runs(odd).orderBy("segment").collect()] == ["one", "t\u0001w\u0001o", "Kafka", "three"]
    assert logs.step_runs(lines).orderBy("segment").collect() == got


def test_tasks_of_step_runs_hold_a_bounded_number_of_lines(spark):
    # Short runs of 12 lines each, and one long run that crosses chunks, far below what Spark gives to one task.
    number = F.col("id") % 12
    said = F.element_at(
        F.array(*[F.lit(x) for x in ("=" * 60, "[1/3] one", "work", "Paso completado: one", "─" * 60, "Paso fallido: x")]),
        (F.col("id") % 6 + 1).cast("int"),
    )
    stamp = F.timestamp_seconds("id").cast("timestamp_ntz").alias("ts")
    short = spark.range(2400).select(
        F.concat(F.lit("s"), F.floor(F.col("id") / 12)).alias("service"), number.alias("seq"), stamp, said.alias("text")
    )
    long = spark.range(600).select(F.lit("long").alias("service"), F.col("id").alias("seq"), stamp, said.alias("text"))
    for lines, width in [(short, 1000), (short.union(long), 1000), (short.union(long), 50)]:
        dealt = logs.step_runs(lines, width=width, per_task=100)
        held = dealt.groupBy(F.spark_partition_id()).agg(F.sum("lines")).collect()
        assert len(held) > 10 and max(row[1] for row in held) < (800 if width == 1000 else 400)
        whole = logs.step_runs(lines, width=10_000, per_task=10_000)
        assert sorted(map(repr, dealt.collect())) == sorted(map(repr, whole.collect()))
        assert dealt.schema == whole.schema
    assert dealt.filter("service = 'long'").agg(F.count("*"), F.sum("lines")).first()[:] == (200, 600)


def test_a_trial_run_takes_the_first_rows(spark):
    lines = spark.createDataFrame([(3, "c"), (1, "a a"), (2, "b")], "n INT, text STRING")
    assert rows(text.trial_run(lines, ["n"], text.word_count, 2)) == [("a", 2), ("b", 1)]


# Status


def test_probe_verdict(spark):
    probes = spark.createDataFrame(
        [
            (1, "http", 200, None, None),
            (2, "http", 399, None, None),
            (3, "http", 400, None, ""),
            (4, "http", None, None, "refused"),
            (5, "tcp", None, True, None),
            (6, "tcp", None, False, "timeout"),
            (7, "http", 302, None, None),
        ],
        "id INT, kind STRING, status_code INT, connected BOOLEAN, error STRING",
    )
    got = {r.id: (r.healthy, r.detail) for r in status.probe_verdict(probes).collect()}
    assert got == {
        1: (True, "OK"),
        2: (True, ""),
        3: (False, "Bad Request"),
        4: (False, "refused"),
        5: (True, "tcp ok"),
        6: (False, "timeout"),
        7: (True, "Found"),
    }


def test_service_status(spark):
    processes = spark.createDataFrame(
        [("a", True, 1, at(0), ""), ("b", False, 2, at(0), "u"), ("c", True, 3, at(0), "u"), ("d", True, 4, at(0), None)],
        "id STRING, running BOOLEAN, pid INT, since TIMESTAMP_NTZ, url STRING",
    )
    probes = spark.createDataFrame([("a", True, "OK"), ("b", True, "OK")], "id STRING, healthy BOOLEAN, detail STRING")
    assert rows(status.service_status(processes, probes)) == [
        ("a", True, True, 1, at(0), "OK"),
        ("b", False, False, None, None, "detenido"),
        ("c", True, False, 3, at(0), "URL lista"),
        ("d", True, False, 4, at(0), ""),
    ]


def test_overview_and_maps(spark):
    services = spark.createDataFrame([("a", 1), ("b", 2)], "id STRING, port INT")
    latest = spark.createDataFrame([("a", True, True, 7)], "id STRING, running BOOLEAN, healthy BOOLEAN, pid INT")
    assert rows(status.service_overview(services, latest)) == [("a", 1, "healthy", "7"), ("b", 2, "stopped", "—")]
    one = status.statuses_map(latest).first()
    assert one.shard == "" and one.statuses["a"].pid == 7
    assert status.statuses_map(latest.limit(0)).collect() == []


@pytest.mark.parametrize("most", [1, 3, 16, 1_000, 10_000])
def test_maps_of_statuses_have_a_bounded_size(spark, most):
    many = spark.range(3_000).selectExpr("concat('s', id) AS id", "id % 2 = 0 AS running")
    maps = status.statuses_map(many, most).collect()
    assert max(len(m.statuses) for m in maps) <= most
    assert sorted((key, value.running) for m in maps for key, value in m.statuses.items()) == sorted(map(tuple, many.collect()))
    prefixes = [m.shard for m in maps]
    assert not any(a != b and b.startswith(a) for a in prefixes for b in prefixes) if len(prefixes) < 500 else True
    # No two maps could have been one.
    sizes = {m.shard: len(m.statuses) for m in maps}
    for prefix, n in sizes.items():
        other = prefix[:-1] + ("0" if prefix.endswith("1") else "1")
        assert not prefix or other not in sizes or n + sizes[other] > most


def test_state_flips(spark):
    samples = spark.createDataFrame(
        [("a", n, f) for n, f in enumerate([True, True, False, None, None, True])], "id STRING, seq BIGINT, running BOOLEAN"
    )
    assert [r.seq for r in status.state_flips(samples, width=2).orderBy("seq").collect()] == [0, 2, 3, 5]


def test_probe_latency(spark):
    data = [("a", v, v < 100) for v in (10, 20, 20, 40, 1000)] + [("b", 7, False)]
    probes = spark.createDataFrame(data, "id STRING, latency_us BIGINT, healthy BOOLEAN")
    got = {r.id: r for r in status.probe_latency(probes, (0.5, 0.95, 1.0), width=15).collect()}
    assert (got["a"].probes, got["a"].mean_us, got["a"].p50_us, got["a"].healthy_share) == (5, 218.0, 20.0, 0.8)
    assert round(got["a"].p95_us, 6) == 808.0 and got["a"].p100_us == 1000.0
    assert (got["b"].p50_us, got["b"].p95_us) == (7.0, 7.0)
    assert status.probe_latency_sketch(probes).count() == 2


def samples_of(spark, *samples):
    data = [(i, n, at(s), b, r, h) for n, (i, s, b, r, h) in enumerate(samples)]
    return spark.createDataFrame(
        data, "id STRING, seq BIGINT, sample_ts TIMESTAMP_NTZ, is_start BOOLEAN, running BOOLEAN, healthy BOOLEAN"
    )


@pytest.mark.parametrize("width", [1, 1000])
def test_time_to_healthy(spark, width):
    samples = samples_of(
        spark,
        ("well", 0, True, True, False),
        ("well", 10, False, True, True),
        ("exits", 0, True, True, False),
        ("exits", 5, False, False, False),
        ("exits", 6, False, True, True),
        ("never", 0, True, True, False),
        ("never", 59, False, True, False),
        ("edge", 0, True, True, False),
        ("edge", 60, False, True, True),
        ("late", 0, True, True, False),
        ("late", 61, False, True, True),
        ("once", 0, True, True, True),
    )
    got = {r.id: (r.outcome, r.seconds) for r in status.time_to_healthy(samples, 60, width).collect()}
    assert got == {
        "well": ("healthy", 10.0),
        "exits": ("exited", None),
        "never": ("timeout", None),
        "edge": ("healthy", 60.0),
        "late": ("timeout", None),
        "once": ("healthy", 0.0),
    }


# Ports


def test_port_scan(spark):
    requests = spark.createDataFrame([(n, n) for n in (1, 2, 3, 4)], "id INT, port INT")
    listeners = spark.createDataFrame([(1, 10, "x"), (2, 20, "y"), (3, 0, "")], "port INT, pid INT, name STRING")
    ours = spark.createDataFrame([(10,), (10,), (0,)], "pid INT")
    got = {r.id: (r.status, r.releasable) for r in ports.port_scan(requests, listeners, ours).collect()}
    assert got == {1: ("ours", False), 2: ("other", True), 3: ("other", False), 4: ("free", False)}


def test_preflight(spark):
    services = spark.createDataFrame([("s", [9092, 9093]), ("t", [9092]), ("u", [9093])], "service_id STRING, ports ARRAY<INT>")
    listeners = spark.createDataFrame([(9092, 5, ""), (9093, 6, "VBoxSVC")], "port INT, pid INT, name STRING")
    own = spark.createDataFrame([("t", 5)], "service_id STRING, pid INT")
    assert rows(ports.preflight_conflict(ports.required_ports(services), listeners, own)) == [
        ("s", 9092, 5, "proceso desconocido", "foreign"),
        ("u", 9093, 6, "VBoxSVC", "peer_vm"),
    ]


def test_suggest_free_port(spark):
    held = [(8000,), (8001,), *[(p,) for p in range(20000, 20200)], (65534,), (65533,)]
    listeners = spark.createDataFrame(held, "port INT")
    requests = spark.createDataFrame(
        [(8000,), (80,), (-5,), (20000,), (65533,), (65535,), (8002,), (8000,)], "port INT"
    )
    assert rows(ports.suggest_free_port(requests, listeners)) == [
        (-5, 1024),
        (20000, 0),
        (65533, 0),
        (65535, 0),
        (80, 1024),
        (8000, 8002),
        (8000, 8002),
        (8002, 8002),
    ]


def test_suggest_free_port_per_host(spark):
    listeners = spark.createDataFrame([("a", 8000)], "host STRING, port INT")
    requests = spark.createDataFrame([("a", 8000), ("b", 8000)], "host STRING, port INT")
    assert rows(ports.suggest_free_port(requests, listeners, ["host"])) == [("a", 8000, 8001), ("b", 8000, 8000)]


def test_union_probes_and_guards(spark):
    services = spark.createDataFrame([("n", "N", 9000)], "service_id STRING, service_name STRING, port INT")
    assert [r.port for r in ports.union_probes(services).orderBy("origin", "port").collect()] == [9000, 9000, 9093]
    listeners = spark.createDataFrame([(1, 5, "a"), (2, 6, "b"), (3, 0, "")], "port INT, pid INT, name STRING")
    assert rows(ports.kill_guard(listeners, spark.createDataFrame([(5,)], "pid INT"))) == [(2, 6, "b")]
    names = spark.createDataFrame([(5, "java")], "pid INT, image STRING")
    assert [r.process for r in ports.listener_process(listeners, names).orderBy("port").collect()] == ["java", "", ""]


# Catalogue


def files_of(spark, *files):
    return spark.createDataFrame(files, "host STRING, folder STRING, name STRING, type STRING")


def test_exercise_catalog(spark):
    files = files_of(
        spark,
        ("h", "Ejercicio_01", "reducer.py", "FILE"),
        ("h", "Ejercicio_01", "mapper.py", "FILE"),
        ("h", "Ejercicio_01", "data.csv", "FILE"),
        ("h", "Ejercicio_01", "sub", "DIRECTORY"),
        ("h", "Ejercicio_42", "readme.md", "FILE"),
        ("h", "Ejercicio_", "mapper.py", "FILE"),
        ("h", "Other", "mapper.py", "FILE"),
    )
    folders = files.select("host", "folder").union(spark.createDataFrame([("h", "Ejercicio_X")], "a STRING, b STRING"))
    assert rows(catalog.exercise_catalog(folders, files)) == [
        ("h", "ej01", "Ejercicio_01", "wordcount", 3),
        ("h", "ej42", "Ejercicio_42", "raw", 1),
        ("h", "ejx", "Ejercicio_X", "raw", 0),
    ]
    listed = [(r.id, r.name) for r in catalog.exercise_files(files).collect()]
    assert listed == [("ej01", "data.csv"), ("ej01", "mapper.py"), ("ej01", "reducer.py"), ("ej42", "readme.md")]


def test_namenode_state(spark):
    units = spark.createDataFrame([(d, "c") for d in ("none", "ok", "bad", "locks")], "host STRING, dir STRING")
    files = spark.createDataFrame(
        [("ok", "c", "VERSION"), ("ok", "c", "edits_1"), ("bad", "c", "edits_inprogress_1"), ("locks", "c", "in_use.lock")],
        "host STRING, dir STRING, name STRING",
    )
    got = {r.host: r.state for r in catalog.namenode_state(units, files).collect()}
    assert got == {"none": "empty", "ok": "formatted", "bad": "corrupted", "locks": "corrupted"}
    cleaned = catalog.namenode_state(units, files.filter("host = 'ok'"))
    assert {r.host: r.state for r in cleaned.collect()}["locks"] == "empty"


def test_missing_and_ready(spark):
    units = spark.createDataFrame([("a",), ("b",)], "host STRING")
    present = spark.createDataFrame([("a", n) for n in catalog.REQUIRED_FOLDERS], "host STRING, name STRING")
    assert rows(catalog.missing_required(units, present)) == [
        ("a", True, []),
        ("b", False, sorted(catalog.REQUIRED_FOLDERS)),
    ]
    there = ["/opt/etc/hadoop/core-site.xml", "/d/hdfs/datanode/current/VERSION", "/d/hdfs/namenode/current/VERSION"]
    files = spark.createDataFrame([("a", p, "FILE") for p in there], "host STRING, path STRING, type STRING")
    ready = {r.host: r for r in catalog.setup_readiness(units, files).collect()}
    assert (ready["a"].hadoop_config, ready["a"].namenode, ready["a"].missing) == (True, True, ["kafka"])
    assert ready["b"].setup_needed and len(ready["b"].missing) == 3
    # The marker of a data node is none of a name node, and a directory is no marker.
    other = spark.createDataFrame(
        [("a", there[1], "FILE"), ("a", there[2], "DIRECTORY")], "host STRING, path STRING, type STRING"
    )
    assert not catalog.setup_readiness(units.filter("host = 'a'"), other).first().namenode


def test_missing_prereqs(spark):
    exercises = spark.createDataFrame([("e", ["up", "down", "unknown"])], "id STRING, requires ARRAY<STRING>")
    services = spark.createDataFrame([("up", True), ("down", False)], "id STRING, running BOOLEAN")
    assert rows(catalog.missing_prereqs(exercises, services)) == [("e", "down"), ("e", "unknown")]


def test_paths(spark):
    paths = spark.createDataFrame(
        [
            ("h", "/p/__pycache__/x/__pycache__/a", 1, "FILE"),
            ("h", "/p/__pycache__/b", 2, "FILE"),
            ("h", "/q/__pycache__", 4, "FILE"),
            ("h", "/r/__pycache__", 16, "DIRECTORY"),
            ("h", "/q/not__pycache__/c", 8, "FILE"),
            ("i", "/q/c", 8, "FILE"),
        ],
        "host STRING, path STRING, length BIGINT, type STRING",
    )
    assert rows(catalog.dir_match_count(paths)) == [("h", 2), ("i", 0)]
    paths = paths.filter("host = 'h'")
    sums = {r.dir: (r.bytes, r.files) for r in catalog.dir_rollup(paths).collect()}
    assert sums["/"] == (15, 4) and sums["/p"] == (3, 2) and sums["/q"] == (12, 2)
    assert sums["/p/__pycache__"] == (3, 2) and "/q/__pycache__" not in sums


def test_dir_first_sort(spark):
    entries = spark.createDataFrame(
        [("b", "FILE"), ("A", "FILE"), ("z", "DIRECTORY"), ("á", "DIRECTORY"), ("a", "DIRECTORY")],
        "name STRING, type STRING",
    )
    assert [r.name for r in catalog.dir_first_sort(entries).collect()] == ["a", "á", "z", "A", "b"]


def test_names(spark):
    files = spark.createDataFrame(
        [("x", "b.CSV"), ("x", "c.csv"), ("x", ".hidden.csv"), ("y", "readme")], "host STRING, name STRING"
    ).withColumn("type", F.lit("FILE"))
    folder = spark.createDataFrame([("x", "a.csv", "DIRECTORY")], files.schema)
    first = catalog.first_by_name(catalog.visible_files(files.union(folder)), catalog.is_csv(F.col("name")))
    assert rows(first) == [("x", "b.CSV"), ("y", "input.txt")]
    assert rows(catalog.name_match(files, suffix=".csv", but_not="c.csv")) == [("x", ".hidden.csv", "FILE"), ("x", "b.CSV", "FILE")]
    assert rows(catalog.name_match(files, glob=r"^hadoop-|^read")) == [("y", "readme", "FILE")]
    assert [r.name for r in catalog.sort_by_id(files, "name").collect()] == [".hidden.csv", "b.CSV", "c.csv", "readme"]


# Telemetry and steps


def test_telemetry(spark):
    samples = spark.createDataFrame(
        [("h", 1, 10, 100, 1.0), ("h", 2, 35, 200, None), ("h", 3, 35, 200, 2.0)],
        "host STRING, seq BIGINT, busy BIGINT, total BIGINT, reading DOUBLE",
    )
    got = telemetry.cpu_delta(samples, width=2).orderBy("seq").collect()
    assert [r.cpu_percent for r in got] == [None, 25.0, None]
    filled = telemetry.fill_forward(samples, width=1).orderBy("seq").collect()
    assert [r.filled for r in filled] == [1.0, 1.0, 2.0]


def steps_of(spark, *states):
    data = [("r", n + 1, s, f"e{n + 1}" if s == "failed" else None) for n, s in enumerate(states)]
    return spark.createDataFrame(data, "run_id STRING, pos INT, status STRING, error STRING")


def test_steps(spark):
    three = steps_of(spark, "done", "failed", "done")
    got = steps.until_first_failure(three).orderBy("pos").collect()
    assert [r.execution for r in got] == ["executed", "executed", "pending"]
    row = steps.all_steps_done(three).first()
    assert (row.complete, row.done, row.failed, row.pending) == (False, 2, 1, 0)
    assert steps.all_steps_done(steps_of(spark, "done")).first().complete is True


def test_collect_errors(spark):
    four = steps_of(spark, "failed", "done", "failed", "done")
    assert [r.error for r in steps.collect_errors(four).orderBy("pos").collect()] == ["e1", "e3"]
    assert rows(steps.error_texts(four)) == [("r", "e1\ne3")]
    assert steps.error_texts(steps_of(spark, "done")).first().errors is None


# Settings


def test_overrides(spark):
    services = spark.createDataFrame([(c, 9200, "512m") for c in "abcd"], "id STRING, port INT, heap STRING")
    overrides = spark.createDataFrame(
        [("a", 0, ""), ("b", -1, None), ("c", 9300, "2g"), ("x", 1, "1g")], "id STRING, port INT, heap STRING"
    )
    assert {r.id: r.port for r in config.port_overrides(services, overrides).collect()} == {
        "a": 9200,
        "b": 9200,
        "c": 9300,
        "d": 9200,
    }
    assert {r.id: r.heap for r in config.heap_overrides(services, overrides).collect()} == {
        "a": "512m",
        "b": "512m",
        "c": "2g",
        "d": "512m",
    }
    assert [r.id for r in config.orphan_overrides(services, overrides).collect()] == ["x"]


def test_kv_overlay(spark):
    base = spark.createDataFrame(
        [("o", n, e) for n, e in enumerate(["A=1", "X", "B=2", "A=3"])], "owner STRING, pos BIGINT, entry STRING"
    )
    overrides = spark.createDataFrame([("o", "A", "9"), ("o", "C", "4")], "owner STRING, key STRING, value STRING")
    got = config.kv_overlay(base, overrides).orderBy("section", "pos", "key").collect()
    assert [r.entry for r in got] == ["A=9", "X", "B=2", "A=9", "C=4"]


def test_checksums_and_releases(spark):
    digests = spark.createDataFrame([(n, "ab") for n in (1, 2, 3, 4)], "id INT, digest STRING")
    expected = spark.createDataFrame([(1, ""), (2, "AB"), (3, "x")], "id INT, sha256 STRING")
    got = {r.id: r.verdict for r in config.checksum_audit(digests, expected, ["id"]).collect()}
    assert got == {1: "unchecked", 2: "ok", 3: "mismatch", 4: "unchecked"}
    hosts = spark.createDataFrame([("a", "linux", "x", "1.0"), ("b", "mac", "x", "1.0")], "host STRING, os STRING, arch STRING, current STRING")
    manifest = spark.createDataFrame([("linux", "x", "0.9"), ("mac", "x", "")], "os STRING, arch STRING, version STRING")
    assert [(r.host, r.latest) for r in config.release_drift(hosts, manifest).collect()] == [("a", "0.9")]


def test_config_drift(spark):
    schema = "file STRING, name STRING, value STRING"
    expected = spark.createDataFrame([("f", "a", "1"), ("f", "b", "2"), ("f", "c", "file:///srv")], schema)
    actual = spark.createDataFrame([("f", "b", "3"), ("f", "c", "file:///srv"), ("f", "d", "/old/x")], schema)
    assert rows(config.config_drift(expected, actual, "/old/")) == [
        ("f", "a", "1", None, "missing", False),
        ("f", "b", "2", "3", "changed", False),
        ("f", "d", None, "/old/x", "extra", True),
    ]


def test_line_rewrite(spark):
    lines = spark.createDataFrame(
        [
            ("f", 1, "@rem set HADOOP_IDENT_STRING=%U%\r"),
            ("f", 2, "\tset hadoop_ident_string=%U%\r"),
            ("f", 3, "set OTHER=1"),
            ("g", 1, "nothing"),
        ],
        "file STRING, line_no INT, line STRING",
    )
    once = config.line_rewrite(lines, "fleet")
    assert [(r.line, r.changed) for r in once.orderBy("file", "line_no").collect()] == [
        ("@rem set HADOOP_IDENT_STRING=%U%\r", False),
        ("set HADOOP_IDENT_STRING=fleet\r", True),
        ("set OTHER=1", False),
        ("nothing", False),
    ]
    twice = config.line_rewrite(once.drop("changed"), "fleet")
    assert not any(r.changed for r in twice.collect())
    assert rows(twice.drop("changed")) == rows(once.drop("changed"))


def test_registry_and_changes(spark):
    entries = spark.createDataFrame([("a", 1, "x"), ("b", 2, "y"), ("a", 3, "z")], "id STRING, pos INT, v STRING")
    assert rows(config.upsert_registry(entries)) == [("a", 1, "z"), ("b", 2, "y")]
    changes = spark.createDataFrame(
        [
            ("o", "kafka", 1, "set", 1),
            ("o", "kafka", 2, "set", 2),
            ("o", "gone", 3, "set", 3),
            ("o", "gone", 4, "delete", None),
            ("o", "other", 5, "set", 5),
            ("o", None, 6, "reset", None),
            ("o", "es", 7, "set", 7),
        ],
        "owner STRING, key STRING, seq BIGINT, op STRING, value INT",
    )
    known = spark.createDataFrame([("kafka",), ("es",)], "id STRING")
    assert rows(config.apply_changes(changes, known)) == [("o", "es", 7), ("o", "other", 5)]
    assert rows(config.apply_changes(changes)) == [("o", "es", 7)]
    no_reset = changes.filter("op <> 'reset'")
    assert rows(config.apply_changes(no_reset)) == [("o", "es", 7), ("o", "kafka", 2), ("o", "other", 5)]
    again = no_reset.union(no_reset.withColumn("seq", F.col("seq") + 10))
    assert rows(config.apply_changes(again)) == rows(config.apply_changes(no_reset))


def test_maps_and_clamp(spark):
    df = spark.sql("SELECT map('es', '1g', 'hadoop', '1g') AS d, map('es', '2g') AS l, CAST(NULL AS MAP<STRING, STRING>) AS n")
    merge = lambda mode, c: df.select(config.merge_maps(F.col("d"), F.col(c), mode)).first()[0]
    assert merge("merge", "l") == {"es": "2g", "hadoop": "1g"}
    assert merge("replace", "l") == {"es": "2g"}
    assert merge("merge", "n") == merge("replace", "n") == {"es": "1g", "hadoop": "1g"}
    langs = spark.createDataFrame([("en",), ("fr",), (None,)], "l STRING")
    assert [r[0] for r in langs.select(config.domain_clamp(F.col("l"))).collect()] == ["en", "es", "es"]
    assert rows(config.explode_map(df, "d")) == [("es", "1g"), ("hadoop", "1g")]


def test_order_of_rows_does_not_matter(spark):
    lines = lines_of(spark, *[f"u {n}" if n % 3 else "start" for n in range(60)])
    match = F.regexp_extract("text", r"^u (\d+)", 1)
    mixed = lines.repartition(7, "text")
    assert rows(logs.first_match_wins(mixed, match, F.col("text") == "start", 10)) == rows(
        logs.first_match_wins(lines, match, F.col("text") == "start")
    )
