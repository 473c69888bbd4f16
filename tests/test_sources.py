"""Readers, parsers and sinks on files."""

import hashlib
import os
import random

import pytest
from pyspark.sql import functions as F

from opsframe.operators import catalog, text
from opsframe.plans import session
from opsframe.sources import dataset, files, parsers, publish, readers, sinks


def put(place, name, content):
    path = os.path.join(place, name)
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "wb") as out:
        out.write(content)
    return path


def test_lines_split_at_newlines_only(spark, place):
    put(place, "a.log", b"a\rb\r\nc\r\r\n\nlast")
    got = readers.read_lines(spark, place).orderBy("seq").collect()
    assert [r.line for r in got] == ["a\rb", "c", "", "last"]


def test_line_numbers_follow_the_file_across_splits(spark, place):
    lines = [f"line {n:07d}" for n in range(300_000)]
    put(place, "big.log", ("\n".join(lines) + "\n").encode())
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(1 << 20))
    try:
        df = readers.read_lines(spark, place)
        assert df.rdd.getNumPartitions() > 2
        assert [r.line for r in df.orderBy("seq").collect()] == lines
        assert df.select("seq").distinct().count() == len(lines)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_log_files(spark, place):
    put(place, "kafka.log", "2024-01-01 00:00:01.250 INFO launcher | hola | mundo\nno layout\n".encode())
    parsed, rejects = readers.read_log_files(spark, place)
    row = parsed.first()
    assert (row.service, row.level, row.stream, row.text) == ("kafka", "INFO", "launcher", "hola | mundo")
    assert row.ts.microsecond == 250000
    assert [r.line for r in rejects.collect()] == ["no layout"]


def test_log_files_round_trip(spark, place):
    lines = spark.sql(
        "SELECT 'a:b' AS service, TIMESTAMP_NTZ '2024-01-01 00:00:01.25' AS ts, 'WARN' AS level, 'stderr' AS stream, "
        "'x | y' AS text"
    )
    sinks.write_log_files(lines, f"{place}/logs")
    sinks.write_log_files(lines, f"{place}/logs")
    parsed, rejects = readers.read_log_files(spark, f"{place}/logs")
    got = parsed.select("service", "ts", "level", "stream", "text").collect()
    assert got == lines.collect() * 2 and rejects.count() == 0


def test_word_count_job_twice_is_one_copy(spark, place):
    put(place, "in/b.CSV", b"word,n\na a\nb\n")
    put(place, "in/c.csv", b"c\n")
    names = readers.dir_listing(spark, f"{place}/in").withColumn("host", F.lit("h"))
    chosen = catalog.first_by_name(names, catalog.is_csv(F.col("name"))).first().name
    assert chosen == "b.CSV"
    sinks.put_overwrite(readers.read_text_dataset(spark, f"{place}/in/{chosen}"), f"{place}/data")
    sinks.put_overwrite(readers.read_text_dataset(spark, f"{place}/in/{chosen}"), f"{place}/data")
    for _ in range(2):
        sinks.write_word_counts(text.word_count(readers.read_text_dataset(spark, f"{place}/data")), f"{place}/out")
    counts = sinks.parse_word_counts(readers.read_text_dataset(spark, f"{place}/out"))
    assert {(r["word"], r["count"]) for r in counts.collect()} == {("word,n", 1), ("a", 2), ("b", 1)}
    assert files.output_checks(spark, [publish.current(spark, f"{place}/out")]).first().outcome == "ok"
    assert readers.concat_files(spark, f"{place}/in", "*.csv").count() == 1


def test_output_check(spark, place):
    put(place, "other/_SUCCESS", b"")
    put(place, "empty/part-00000", b"")
    put(place, "well/part-00000", b"")
    put(place, "well/part-00001", b"abc")
    os.makedirs(f"{place}/folder/part-00000")
    jobs = ("absent", "other", "empty", "well", "folder")
    got = {r.path.rsplit("/", 1)[1]: (r.outcome, r.files, r.bytes) for r in files.output_checks(spark, [f"{place}/{job}" for job in jobs]).collect()}
    nothing = ("missing", 0, 0)
    assert got == {"absent": nothing, "other": nothing, "folder": nothing, "empty": ("empty", 1, 0), "well": ("ok", 2, 3)}


def test_dir_listing(spark, place):
    put(place, "d/a.ipynb", b"12345")
    put(place, "d/sub/b.txt", b"1")
    put(place, "d/sub/deep/er/c", b"")
    put(place, "d/empty", b"")
    os.makedirs(f"{place}/d/none")
    os.symlink(f"{place}/d", f"{place}/d/sub/round")  # a circle
    os.symlink(f"{place}/gone", f"{place}/d/sub/broken")
    got = readers.dir_listing(spark, f"{place}/d").collect()
    head = len(f"{place}/d/")
    assert {(r.path[head:], r["size"], r.is_dir) for r in got if r.is_dir} == {(x, 0, True) for x in ("sub", "sub/deep", "sub/deep/er", "none")}
    assert {(r.path[head:], r["size"]) for r in got if not r.is_dir} == {
        ("a.ipynb", 5),
        ("sub/b.txt", 1),
        ("sub/deep/er/c", 0),
        ("empty", 0),
        ("sub/round", 0),
    }
    assert min(r.modified_ms for r in got) > 1_600_000_000_000
    assert readers.dir_listing(spark, f"{place}/absent").collect() == []


def test_an_unreadable_folder_is_skipped(spark, place, monkeypatch):
    put(place, "d/a", b"1")
    put(place, "d/locked/b", b"1")
    os.chmod(f"{place}/d/locked", 0)
    try:
        names = {r.name for r in readers.dir_listing(spark, f"{place}/d").collect()}
    finally:
        os.chmod(f"{place}/d/locked", 0o755)
    assert {"a", "locked"} <= names
    assert names == {"a", "locked"} or os.geteuid() == 0  # nothing is locked for root
    # What the file system says to a folder that may not be read.
    monkeypatch.setattr(files.os, "scandir", lambda place: (_ for _ in ()).throw(PermissionError(place)))
    assert list(files.entries(f"{place}/d")) == []


def test_flat_listing(spark, place):
    put(place, "d/a.ipynb", b"12345")
    put(place, "d/sub/b.txt", b"1")
    put(place, "d/empty", b"")
    folders = spark.createDataFrame([(f"{place}/d",), (f"file:{place}/d/sub",), (f"{place}/absent",), (None,)], "path STRING")
    listed = files.list_folders(folders).collect()
    assert {(r.name, r["size"], r.is_dir) for r in listed} == {
        ("a.ipynb", 5, False),
        ("b.txt", 1, False),
        ("empty", 0, False),
        ("sub", 0, True),
    }


def test_landed_files(spark, place):
    target = f"{place}/a/b/x.csv"
    put(place, "a/b/x.csv", b"old\n")
    lines = [(target, 2, "two"), (target, 1, "one\nand"), (f"{place}/e/empty", 1, None), (f"{place}/none/", 1, None), (None, 1, "x")]
    rows = spark.createDataFrame(lines, "path STRING, n INT, text STRING")
    landed = {r.path: r.lines for r in files.land_files(rows, ["n"]).collect()}
    assert landed == {target: 2, f"{place}/e/empty": 0, f"{place}/none/": 0}
    assert open(target, "rb").read() == b"one\nand\ntwo\n"
    assert os.path.getsize(f"{place}/e/empty") == 0 and os.listdir(f"{place}/none") == []
    # A task that fails midway leaves the earlier file, and nothing else.
    broken = rows.filter("n = 2").select("path", "n", F.when(F.raise_error(F.lit("killed")).isNull(), "x").alias("text"))
    with pytest.raises(Exception, match="killed"):
        files.land_files(rows.filter("n = 2").unionByName(broken), ["n"]).collect()
    assert open(target, "rb").read() == b"one\nand\ntwo\n" and os.listdir(f"{place}/a/b") == ["x.csv"]


def test_replaced_all_or_nothing(spark, place):
    text_of = lambda: sorted(r.text for r in readers.read_text_dataset(spark, f"{place}/data").collect())
    frame = lambda *lines: spark.createDataFrame([(x,) for x in lines], "text STRING")
    put(place, "data/plain.txt", b"as it was\n")
    assert text_of() == ["as it was"]  # nothing published yet
    sinks.put_overwrite(frame("one", "two"), f"{place}/data")
    assert text_of() == ["one", "two"]
    # A writer that is killed midway: some of its parts are there, and readers still see the copy before.
    failing = frame("three").repartition(1).unionByName(frame("x").select(F.raise_error(F.lit("killed")).cast("string").alias("text")))
    with pytest.raises(Exception, match="killed"):
        sinks.put_overwrite(failing, f"{place}/data")
    spark.createDataFrame([("half",)], "value STRING").write.text(f"{place}/data/versions/abandoned")
    assert text_of() == ["one", "two"]
    opened = readers.read_text_dataset(spark, f"{place}/data")
    sinks.put_overwrite(frame("four"), f"{place}/data")
    assert text_of() == ["four"]
    assert sorted(r.text for r in opened.collect()) == ["one", "two"]  # a reader keeps the copy it began with
    assert publish.retire(spark, f"{place}/data", keep=1) == 3
    assert text_of() == ["four"] and len(os.listdir(f"{place}/data/versions")) == 1


def test_settings_replaced_all_or_nothing(spark, place):
    settings = spark.createDataFrame([("a", "en"), ("b", "es")], "host STRING, language STRING")
    sinks.write_settings(settings, f"{place}/s")
    broken = settings.withColumn("language", F.when(F.col("host") == "b", F.raise_error(F.lit("killed"))).otherwise("de"))
    with pytest.raises(Exception, match="killed"):
        sinks.write_settings(broken, f"{place}/s")
    assert {r.host: r.language for r in readers.read_settings(spark, f"{place}/s").collect()} == {"a": "en", "b": "es"}


def test_folder_dataset(spark, place):
    dataset.register(spark)
    read = lambda path, **options: spark.read.format("folder_dataset").options(**options).load(path)
    text_of = lambda path, **options: [r.text for r in read(path, **options).collect()]
    put(place, "two/b.csv", b"no\n")
    put(place, "two/a.CSV", "a,b\r\n\ncr\rinside\né\n\xff".encode("latin-1").replace(b"\xe9", "é".encode()))
    put(place, "two/input.txt", b"no\n")
    put(place, "two/.a.csv", b"hidden\n")
    assert text_of(f"{place}/two") == ["a,b", "", "cr\rinside", "é", "\ufffd"]
    put(place, "text/input.txt", b"last line has no end")
    put(place, "text/other.txt", b"no\n")
    assert text_of(f"file:{place}/text") == ["last line has no end"]
    put(place, "none/notes.md", b"no\n")
    assert text_of(f"{place}/none") == [] and text_of(f"{place}/absent") == []
    put(place, "zero/a.csv", b"")
    assert text_of(f"{place}/zero") == []
    both = read(place, children="true").groupBy(F.substring_index("file", "/", -2).alias("f")).count().collect()
    assert {tuple(r) for r in both} == {("two/a.CSV", 5), ("text/input.txt", 1)}


def test_folder_dataset_in_ranges(spark, place, monkeypatch):
    dice = random.Random(1)
    lines = ["x" * dice.choice([0, 0, 1, 3, 40, 200]) + str(n) for n in range(3_000)]
    for end in ("\n", ""):
        put(place, f"d{len(end)}/a.csv", ("\n".join(lines) + end).encode())
    for read, block in ((7, 50), (64, 13), (1 << 22, 1_000), (100, 1 << 20)):
        monkeypatch.setattr(dataset, "READ", read)
        for end in (0, 1):
            size = os.path.getsize(f"{place}/d{end}/a.csv")
            dealt = dataset.ranges([(f"{place}/d{end}/a.csv", size)], block)
            got = [x for own in dealt for path, a, b in own for part in dataset.lines_of(path, a, b) for x in part.column(0).to_pylist()]
            assert got == lines
    frame = spark.read.format("folder_dataset").option("blockBytes", 20_000).load(f"{place}/d1") if dataset.register(spark) is None else None
    assert frame.rdd.getNumPartitions() > 3
    assert sorted(r.text for r in frame.collect()) == sorted(lines)


def test_listings(spark, place):
    put(
        place,
        "l.json",
        b'{"FileStatuses":{"FileStatus":[{"pathSuffix":"a","type":"FILE","length":3,"modificationTime":5,'
        b'"owner":"me","group":"g","permission":"644"},{"pathSuffix":"b","type":"DIRECTORY","length":0}]}}\n',
    )
    got = readers.read_listings(spark, place).orderBy("pathSuffix").collect()
    assert [(r.pathSuffix, r.length, r.owner) for r in got] == [("a", 3, "me"), ("b", 0, None)]


def test_settings(spark, place):
    put(
        place,
        "s.json",
        b'{"host":"a","language":"","jvm_heap":{"elasticsearch":"2g"},"port_overrides":{"kafka":9300}}\n'
        b'{"host":"b","language":"en","auto_start_notebooks":false\n'
        b'{"host":"c","language":"en","always_on_top":true,"auto_start_notebooks":false}\n',
    )
    got = {r.host: r for r in readers.read_settings(spark, place).collect()}
    assert (got["a"].language, got["a"].auto_start_notebooks, got["a"].malformed) == ("es", True, False)
    assert got["a"].jvm_heap == {"elasticsearch": "2g", "hadoop": "1g"} and got["a"].port_overrides == {"kafka": 9300}
    assert (got["b"].language, got["b"].auto_start_notebooks, got["b"].malformed) == ("es", True, True)
    assert (got["c"].language, got["c"].always_on_top, got["c"].auto_start_notebooks) == ("en", True, False)


def test_settings_one_document_per_file(spark, place):
    put(place, "s/a.json", b'{\n "host": "a",\n "language": "en"\n}\n')
    put(place, "s/b.json", b'{"language": "en"}')
    put(place, "s/c.json", b'{"language": ')
    got = {r.host: (r.language, r.malformed) for r in readers.read_settings(spark, f"{place}/s", multiline=True).collect()}
    assert got == {"a": ("en", False), "b": ("en", False), "c": ("es", True)}


def test_properties(spark, place):
    put(
        place,
        "core-site.xml",
        b'<?xml version="1.0"?>\n<!-- made -->\n<configuration>\n<property>\n<name>fs.defaultFS</name>\n'
        b"<value>hdfs://localhost:9000</value>\n</property>\n<property><name>x</name><value>a &amp; b</value></property>"
        b"\n</configuration>\n",
    )
    got = {(r.file, r.name, r.value) for r in readers.read_properties(spark, place).collect()}
    assert got == {("core-site.xml", "fs.defaultFS", "hdfs://localhost:9000"), ("core-site.xml", "x", "a & b")}


def test_property_files_are_of_bounded_size(spark, place):
    named = spark.range(250, numPartitions=1).select(
        F.concat(F.lit("h"), "id").alias("host"), F.lit("x").alias("name"), F.lit("a & <b>").alias("value"), F.lit("core-site.xml").alias("file")
    )
    assert sinks.FILE_PROPERTIES <= 100_000
    sinks.write_properties(named, f"{place}/p", most=100)
    read = readers.read_properties(spark, f"{place}/p")
    assert sorted(map(tuple, read.select(*named.columns).collect())) == sorted(map(tuple, named.collect()))
    sizes = read.groupBy(F.col("_metadata.file_path")).count()
    assert sorted(r["count"] for r in sizes.collect()) == [50, 100, 100]


def test_digests(spark, place):
    put(place, "f/x.bin", b"abc")
    put(place, "f/x.gz", b"abc")  # as it is, whatever the name says
    put(place, "f/empty", b"")
    rows = {r.path.rsplit("/", 1)[1]: r for r in files.file_digests(files.list_tree(spark, f"{place}/f")).collect()}
    assert rows["x.bin"]["size"] == 3 and rows["x.bin"].digest.startswith("ba7816bf")
    assert rows["x.gz"].digest == rows["x.bin"].digest
    assert rows["empty"]["size"] == 0 and rows["empty"].digest.startswith("e3b0c442")
    gone = spark.createDataFrame([(f"{place}/f/gone",)], "path STRING")
    assert tuple(files.file_digests(gone).first())[1:] == (None, None)


def test_digest_of_a_file_over_two_gigabytes(spark, place):
    size = 3 << 30
    with open(f"{place}/large", "wb") as out:  # a hole: no blocks on the disk
        out.truncate(size)
    state = hashlib.sha256()
    for _ in range(size >> 24):
        state.update(bytes(1 << 24))
    listed = files.list_tree(spark, place).filter("name = 'large'")
    row = files.file_digests(listed).first()
    os.truncate(f"{place}/large", 0)
    assert row["size"] == size and row.digest == state.hexdigest()


def test_releases(spark, place):
    put(place, "r/latest-windows-amd64.json", b'{"version":"0.2.1","sha256":"AB","url":"https://example.org/x"}')
    row = readers.read_releases(spark, f"{place}/r").first()
    assert (row.os, row.arch, row.version) == ("windows", "amd64", "0.2.1")


def test_netstat(spark, place):
    put(
        place,
        "n.txt",
        b"Active Connections\r\n\r\n  Proto  Local  Foreign  State  PID\r\n"
        b"  TCP    127.0.0.1:9200   0.0.0.0:0   LISTENING   42\r\n"
        b"  TCP    0.0.0.0:9200     0.0.0.0:0   LISTENING   43\r\n"
        b"  TCP    127.0.0.1:9300   0.0.0.0:0   ESTABLISHED 44\r\n"
        b"  TCP    127.0.0.1:9400   0.0.0.0:0   LISTENING\r\n"
        b"  TCP    127.0.0.1:9500   0.0.0.0:0   LISTENING   x\r\n"
        b"  TCP    [::]:9600        [::]:0      LISTENING   46\r\n",
    )
    got = parsers.parse_netstat(readers.read_dump(spark, place))
    assert {(r.port, r.pid) for r in got.collect()} == {(9200, 42), (9600, 46)}


def test_lsof_and_tasklist(spark):
    lines = spark.createDataFrame(
        [(1, 1, "p42"), (1, 2, "cjava"), (1, 3, "p43"), (1, 4, "px"), (2, 1, "f5")], "port INT, line_no INT, line STRING"
    )
    assert {tuple(r) for r in parsers.parse_lsof(lines).collect()} == {(1, 43, "java"), (2, 0, "")}
    tasks = spark.createDataFrame(
        [('"java.exe","42","Console","1","1,004 K"\r',), ("INFO: No tasks",), ("",)], "line STRING"
    )
    assert [tuple(r) for r in parsers.parse_tasklist(tasks).collect()] == [(42, "java.exe")]


def test_scratch_uses_the_shared_folder(spark):
    shared = spark.conf.get("spark.checkpoint.dir", None)
    first, second = session.scratch(spark, "x"), session.scratch(spark, "x")
    assert first != second
    assert first.startswith(shared or "/tmp/")


def test_line_numbers_of_small_splits(spark, place):
    lines = "".join(f"line {n:06d} {'x' * 20}\n" for n in range(20_000))
    put(place, "in/a.txt", lines.encode())
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(64 * 1024))
    spark.conf.set("spark.sql.files.openCostInBytes", "1024")
    try:
        read = readers.read_lines(spark, f"{place}/in")
        got = read.orderBy("seq").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert read.rdd.getNumPartitions() > 1 or len(got) == 20_000
    assert len({r.seq for r in got}) == 20_000 and [r.line for r in got] == lines.splitlines()
