"""Files and folders as rows, opened in the tasks: recursive listings, digests, and named files that tasks write.

Paths are opened through Arrow's file systems (local, HDFS, object stores), which each task finds by the path itself; a
path without a scheme is local. Only names and sizes travel between tasks; content is read and written as a stream.
"""

from __future__ import annotations

import hashlib
import os
import re
import uuid
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from opsframe.plans.session import scratch, ship

ship(__name__)

BLOCK = 8 << 20  # bytes of a file that are held at once
BATCH = 10_000  # entries of a folder in a batch

ENTRIES = pa.schema(
    [
        ("folder", pa.string()),
        ("path", pa.string()),
        ("name", pa.string()),
        ("is_dir", pa.bool_()),
        ("size", pa.int64()),
        ("modified_ms", pa.int64()),
    ]
)
LISTED = "folder STRING, path STRING, name STRING, is_dir BOOLEAN, size BIGINT, modified_ms BIGINT"


def file_system(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path, and the path in it."""
    if path.startswith("file:"):
        return fs.LocalFileSystem(), "/" + re.sub("^file:", "", path).lstrip("/")
    if "://" not in path:
        return fs.LocalFileSystem(), path
    return fs.FileSystem.from_uri(path)


def entries(folder: str) -> Iterator[tuple]:
    """What is in a folder; nothing if it is absent or cannot be read. An entry that cannot be read is left out.

    A link to a folder is an entry without size, and is not gone into, so that no listing runs in circles.
    """
    system, place = file_system(folder)
    head = folder.rstrip("/") + "/"
    if isinstance(system, fs.LocalFileSystem):  # one entry after the other, however many there are
        try:
            with os.scandir(place) as found:
                for one in found:
                    try:
                        status = one.stat()
                        is_dir = one.is_dir(follow_symlinks=False)
                        size = 0 if is_dir or one.is_dir() else status.st_size
                        yield folder, head + one.name, one.name, is_dir, size, status.st_mtime_ns // 1_000_000
                    except OSError:
                        continue
        except OSError:
            return
        return
    try:
        found = system.get_file_info(fs.FileSelector(place, allow_not_found=True))
    except OSError:
        return
    for one in found:
        is_dir = one.type == fs.FileType.Directory
        yield folder, head + one.base_name, one.base_name, is_dir, one.size or 0, (one.mtime_ns or 0) // 1_000_000


def batches_of(rows: Iterator[tuple], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    held = []
    for row in rows:
        held.append(row)
        if len(held) == BATCH:
            yield batch_of(held, schema)
            held = []
    if held:
        yield batch_of(held, schema)


def batch_of(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(zip(*rows), schema.types)], schema=schema)


def list_folders(folders: DataFrame) -> DataFrame:
    """Entries of each folder (``path``): name, kind, size and time (ms), empty files and directories included.

    Folders are listed in the tasks that hold their paths; an absent or unreadable folder has no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield from batches_of((row for path in batch.column(0).to_pylist() for row in entries(path)), ENTRIES)

    return folders.select("path").filter("path IS NOT NULL").mapInArrow(run, LISTED)


def spread(rows: DataFrame) -> DataFrame:
    """Dealt to as many tasks as a shuffle has; a number of their own keeps few short rows from ending in one task."""
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), "path")


def list_tree(spark: SparkSession, roots: str | Sequence[str], place: str | None = None) -> DataFrame:
    """Everything below the folders ``roots``, by frontier: all folders of a depth are listed at once, dealt to tasks,
    and the folders among their entries are the next frontier, until there are none.

    Each depth is a table in the shared folder (``place``), so the driver holds no entry and lost executors lose none. The
    number of rounds is the depth of the tree. A root that is there twice, or lies below another one, is listed again.
    """
    place = place or scratch(spark, "tree")
    frontier = spark.createDataFrame([(root,) for root in ([roots] if isinstance(roots, str) else roots)], "path STRING")
    depth = 0
    while True:
        list_folders(spread(frontier)).write.parquet(f"{place}/depth={depth}")
        frontier = spark.read.schema(LISTED).parquet(f"{place}/depth={depth}").filter("is_dir").select("path")
        if frontier.isEmpty():
            break
        depth += 1
    return spark.read.schema(f"{LISTED}, depth INT").option("basePath", place).parquet(*[f"{place}/depth={k}" for k in range(depth + 1)])


DIGESTS = pa.schema([("path", pa.string()), ("size", pa.int64()), ("digest", pa.string())])


def digest(path: str) -> tuple[int, str] | None:
    """Bytes and SHA-256 of a file, read block by block; None if it cannot be read."""
    system, place = file_system(path)
    total, state = 0, hashlib.sha256()
    try:
        with system.open_input_stream(place, compression=None) as stream:
            while block := stream.read(BLOCK):
                state.update(block)
                total += len(block)
    except OSError:
        return None
    return total, state.hexdigest()


def file_digests(files: DataFrame) -> DataFrame:
    """Bytes and SHA-256 of each file (``path``) of any size, as hex; null for one that cannot be read.

    Tasks get paths, and each file is one stream through one running digest: no content is a value of a row.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column(0).to_pylist():
                yield batch_of([(path, *(digest(path) or (None, None)))], DIGESTS)

    return spread(files.select("path")).mapInArrow(run, "path STRING, size BIGINT, digest STRING")


LANDED = pa.schema([("path", pa.string()), ("lines", pa.int64())])


def land_files(lines: DataFrame, order: Sequence[str] = ()) -> DataFrame:
    """Write text files by name: rows (path, text) are the lines of the file ``path``, in ``order``.

    A file's lines stream through one task to a temporary name beside it, which then takes the file's place by one
    rename; parents are made. Until then an earlier file is there as it was, also when the job is killed or repeated.
    Gives (path, lines) for each file; the files are written when that is asked for. Rows with null paths are left out.
    A null text is no line, so a path with nothing else becomes an empty file, or an empty folder if it ends in a slash.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        landing = None
        try:
            for batch in batches:
                for path, text in zip(*(column.to_pylist() for column in batch.columns)):
                    if landing is None or landing.path != path:
                        if landing is not None:
                            yield batch_of([landing.done()], LANDED)
                            landing = None
                        landing = _Landing(path)
                    if text is not None:
                        landing.write(text)
            if landing is not None:
                yield batch_of([landing.done()], LANDED)
                landing = None
        finally:
            if landing is not None:
                landing.drop()

    rows = spread(lines.filter("path IS NOT NULL")).sortWithinPartitions("path", *order)
    return rows.select("path", "text").mapInArrow(run, "path STRING, lines BIGINT")


class _Landing:
    """A file that is being written under a temporary name."""

    def __init__(self, path: str):
        self.path, self.lines = path, 0
        self.system, self.place = file_system(path)
        folder, _, name = self.place.rpartition("/")
        self.system.create_dir(folder, recursive=True)
        if not name:
            self.stream = None
            return
        self.part = f"{folder}/.{name}.{uuid.uuid4().hex}.tmp"
        self.stream = self.system.open_output_stream(self.part, compression=None, buffer_size=1 << 20)

    def write(self, text: str) -> None:
        self.stream.write(text.encode() + b"\n")
        self.lines += 1

    def done(self) -> tuple[str, int]:
        if self.stream is None:
            return self.path, 0
        self.stream.close()
        self.system.move(self.part, self.place)
        return self.path, self.lines

    def drop(self) -> None:
        if self.stream is not None:
            self.stream.close()
            self.system.delete_file(self.part)


def output_checks(spark: SparkSession, paths: Sequence[str], glob: str = "part-*") -> DataFrame:
    """Did jobs leave output? For each path ``missing`` without part files, ``empty`` without bytes, else ``ok``."""
    asked = spark.createDataFrame([(path,) for path in paths], "path STRING")
    named = "(?s)^" + ".*".join(re.escape(part) for part in glob.split("*")) + r"\z"
    parts = list_folders(spread(asked)).filter(~F.col("is_dir") & F.col("name").rlike(named))
    totals = parts.groupBy(F.col("folder").alias("path")).agg(F.count("*").alias("files"), F.sum("size").alias("bytes"))
    zero = F.lit(0).cast("bigint")
    found = asked.join(totals, "path", "left").withColumns(
        {"files": F.coalesce("files", zero), "bytes": F.coalesce("bytes", zero)}
    )
    outcome = F.when(F.col("files") == 0, "missing").when(F.col("bytes") == 0, "empty").otherwise("ok")
    return found.select("path", outcome.alias("outcome"), "files", "bytes")

