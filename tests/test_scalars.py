"""Scalar functions on literal cases."""

import datetime

import pytest
from pyspark.sql import functions as F

from opsframe.functions import scalars as S
from opsframe.operators import logs, ports, status


def one(spark, make, *values):
    """The function's result for one row of literals."""
    df = spark.range(1).select(make(*[F.lit(value) for value in values]).alias("x"))
    return df.first()["x"]


@pytest.mark.parametrize(
    "text, level",
    [
        ("an error.", "ERROR"),
        ("[ERROR]", "ERROR"),
        ("java.lang.Exception", "ERROR"),
        ("Traceback (most recent call last)", "ERROR"),
        ("NullPointerException: x", "INFO"),
        ("errors", "INFO"),
        ("ERROR_CODE", "INFO"),
        ("éERROR", "ERROR"),
        ("ERRORé", "ERROR"),
        ("WARN", "WARN"),
        ("warning", "WARN"),
        ("warnings", "INFO"),
        ("WARN then ERROR", "ERROR"),
        ("", "INFO"),
    ],
)
def test_detect_level(spark, text, level):
    assert one(spark, S.detect_level, text) == level


def test_detect_level_of_compound_names(spark):
    assert one(spark, lambda t: S.detect_level(t, strict=False), "NullPointerException: x") == "ERROR"


@pytest.mark.parametrize(
    "size, shown",
    [
        (None, "0"),
        (0, "0"),
        (1, "1 B"),
        (1023, "1023 B"),
        (1024, "1.0 KB"),
        (1280, "1.3 KB"),
        (1536, "1.5 KB"),
        (1048576, "1.0 MB"),
        (2**30, "1.0 GB"),
        (2**50, "1024.0 TB"),
    ],
)
def test_human_size(spark, size, shown):
    value = F.lit(size).cast("bigint")
    assert spark.range(1).select(S.human_size(value).alias("x")).first()["x"] == shown


@pytest.mark.parametrize(
    "parent, child, path", [("/", "a", "/a"), ("", "a", "/a"), ("/a/", "b", "/a/b"), ("/a", "b", "/a/b")]
)
def test_path_join(spark, parent, child, path):
    assert one(spark, S.path_join, parent, child) == path


@pytest.mark.parametrize("path, want", [("", "/"), ("a", "/a"), ("/a", "/a")])
def test_normalise_path(spark, path, want):
    assert one(spark, S.normalise_path, path) == want


def test_escape_path(spark):
    assert one(spark, S.escape_path, "/a b/ñ+~*;,(x)&$:=@") == "/a%20b/%C3%B1+~%2A%3B%2C%28x%29&$:=@"
    assert one(spark, S.escape_path, "/50%/%2F") == "/50%25/%252F"


@pytest.mark.parametrize(
    "path, uri",
    [
        ("/", "file:///"),
        ("e:\\", "file:///e:/"),
        ("/srv/lago\\azul/", "file:///srv/lago/azul/"),
        ("/año/κόσμος.txt", "file:///año/κόσμος.txt"),
        ("/mixed\\up/one", "file:///mixed/up/one"),
    ],
)
def test_file_uri(spark, path, uri):
    assert one(spark, S.file_uri, path) == uri


@pytest.mark.parametrize("value, want", [(12.25, 12.3), (0.04, 0.0), (-1.26, -1.2)])
def test_round1(spark, value, want):
    assert one(spark, S.round1, value) == want


def test_bytes_to_mb(spark):
    assert one(spark, S.bytes_to_mb, 3 * 1048576 - 1) == 2


def test_times(spark):
    row = spark.sql("SELECT TIMESTAMP '2024-01-01 10:02:03.9996' AS ts").select(S.clock_millis(F.col("ts")).alias("x"))
    assert row.first()["x"] == "10:02:03.999"
    millis = spark.range(1).select(S.millis_to_ts(F.lit(1700000000123)).cast("timestamp_ntz").alias("x"))
    assert millis.first()["x"] == datetime.datetime(2023, 11, 14, 22, 13, 20, 123000)


@pytest.mark.parametrize(
    "text, url",
    [
        ("at http://127.0.0.1:8888/lab?token=abc and more", "http://127.0.0.1:8888/lab?token=abc"),
        ("http://localhost/?token=z9", "http://localhost/?token=z9"),
        ("http://localhost/lab/tree?token=q", ""),
        ("http://example.org/?token=q", ""),
    ],
)
def test_access_url(spark, text, url):
    assert one(spark, S.extract_access_url, text) == url


def test_rewrite_url_path(spark):
    url = "http://127.0.0.1:8888/lab?token=abc#x"
    assert one(spark, S.rewrite_url_path, url, "/lab/tree/a.ipynb") == "http://127.0.0.1:8888/lab/tree/a.ipynb?token=abc#x"
    assert one(spark, S.rewrite_url_path, "https://host", "/a") == "https://host/a"


@pytest.mark.parametrize("entry, key, value", [("k=v", "k", "v"), ("k=", "k", ""), ("=v", "", "v"), ("a=b=c", "a", "b=c"), ("x", None, None)])
def test_kv(spark, entry, key, value):
    assert one(spark, S.kv_key, entry) == key
    assert one(spark, S.kv_value, entry) == value


def test_split_fields(spark):
    assert one(spark, S.split_fields, "  a \t b  ") == ["a", "b"]
    assert one(spark, S.split_fields, "") == []


@pytest.mark.parametrize("name, want", [("Ejercicio_01", "ej01"), ("Ejercicio_AB", "ejab"), ("Ejercicio_", None)])
def test_exercise_id(spark, name, want):
    assert one(spark, lambda n: S.exercise_id(n, "Ejercicio_"), name) == want


def test_templates(spark):
    assert one(spark, S.template_fill, "{{.URI}}/a/{{.URI}}", "file:///x") == "file:///x/a/file:///x"
    fill = lambda t: S.placeholder_fill(t, F.array(F.lit("{1}"), F.lit("b")))
    assert one(spark, fill, "<{0}|{1}|{2}>{x}") == "<{1}|b|>{x}"


def test_strip_cr(spark):
    assert one(spark, S.strip_cr, "a\r\r") == "a\r"
    assert one(spark, lambda t: S.strip_cr(t, every=True), "a\rb\r\r") == "a\rb"
    assert one(spark, S.strip_cr, "a\r\n") == "a\r\n"


def test_digests_and_lifecycle(spark):
    assert one(spark, S.sha256_hex, "abc").startswith("ba7816bf")
    assert one(spark, S.extract_pid, "arrancado con PID 42") == 42
    assert one(spark, S.extract_pid, "no number") is None
    assert one(spark, S.extract_exit, "detenido (exit -1)") == -1
    assert one(spark, S.to_int, "99999999999") is None


def test_renderings(spark):
    ts = F.lit(datetime.datetime(2024, 1, 1, 0, 0, 1, 250000))
    line = logs.format_file_line(ts, F.lit("INFO"), F.lit("launcher"), F.lit("hola | mundo"))
    assert spark.range(1).select(line).first()[0] == "2024-01-01 00:00:01.250 INFO launcher | hola | mundo"
    for level, want in [("WARN", "WARN "), ("CRITICAL", "CRITICAL"), ("", "INFO ")]:
        shown = logs.format_console_line(ts, F.lit(level), F.lit("x"))
        assert spark.range(1).select(shown).first()[0] == f"00:00:01.250 {want} x"


def test_badges_and_names(spark):
    badge = lambda r, h: status.status_badge(r.cast("boolean"), h.cast("boolean"))
    assert [one(spark, badge, *p) for p in [(None, None), (False, True), (True, True), (True, False), (True, None)]] == [
        "stopped",
        "stopped",
        "healthy",
        "running",
        "running",
    ]
    assert [one(spark, status.step_badge, s) for s in ("done", "failed", "running", "other")] == [
        "done",
        "failed",
        "running",
        "pending",
    ]
    assert one(spark, ports.peer_vm_owner, "VBoxHeadless.exe") is True
    assert one(spark, ports.peer_vm_owner, "java") is False
    assert one(spark, lambda t: ports.vm_running(t, "lab"), '"lab" {1}') is True
    assert one(spark, lambda t: ports.vm_running(t, "lab"), '"lab2" {1}') is False
    assert one(spark, ports.port_in_range, 65535) == "not in 1-65534"
    assert one(spark, ports.port_in_range, 80) is None
    assert one(spark, lambda p: ports.port_in_range(p, 1024, 65534), 80) == "not in 1024-65534"
