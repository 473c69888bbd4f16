"""The dataset of a folder as a data source: ``spark.read.format("folder_dataset").load(folder)``.

Of a folder's files, the first ``.csv`` by name (the suffix in any case) is the dataset, or else ``input.txt``; a folder
with neither has no lines. Each line is a record, a header too: (text, file). The planner looks at names and sizes only
and cuts the chosen files into byte ranges; a task reads the lines that begin in its ranges, as a stream of blocks.

Options: ``path``, a folder; ``children`` (default false): the path's direct subfolders are the folders instead;
``blockBytes`` (default 64 MiB): how much a task reads. Lines end at newlines, without the carriage returns before
them; bytes that are no UTF-8 are replaced. Hidden files (``.`` or ``_`` in front) are not candidates.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from opsframe.plans.session import ship
from opsframe.sources import files

ship(__name__)

FALLBACK = "input.txt"
READ = 1 << 22
SCHEMA = pa.schema([("text", pa.string()), ("file", pa.string())])


def choose(names: list[str]) -> str | None:
    """The name of the dataset among a folder's files."""
    tables = sorted(name for name in names if name.lower().endswith(".csv"))
    return tables[0] if tables else FALLBACK if FALLBACK in names else None


class Ranges(InputPartition):
    """(file, begin, end) of byte ranges."""

    def __init__(self, value: list[tuple[str, int, int]]):
        super().__init__(value)


def ranges(sizes: list[tuple[str, int]], block: int) -> list[list[tuple[str, int, int]]]:
    """Files cut into ranges of at most ``block`` bytes, small ones together, about a block for each task."""
    dealt: list[list[tuple[str, int, int]]] = []
    room = 0
    for path, size in sizes:
        for begin in range(0, size, block):
            part = min(block, size - begin)
            if part > room:
                dealt.append([])
                room = block
            dealt[-1].append((path, begin, begin + part))
            room -= part
    return dealt


def lines_of(path: str, begin: int, end: int) -> Iterator[pa.RecordBatch]:
    """The lines that begin in a byte range."""
    system, place = files.file_system(path)
    with system.open_input_file(place) as file:
        # A line that begins at the range's first byte follows a newline that is the last byte before it.
        at = max(begin - 1, 0)
        file.seek(at)
        held, inside = b"", begin == 0
        while block := file.read(READ):
            if not inside:
                newline = block.find(b"\n")
                if newline < 0 and at + len(block) < end:
                    at += len(block)
                    continue
                if newline < 0 or at + newline + 1 >= end:
                    return  # no line begins here
                block, at, inside = block[newline + 1 :], at + newline + 1, True
            data = held + block
            at -= len(held)
            # Whole lines that begin before the end of the range, and how far they reach.
            if at + len(data) > end:
                last = data.find(b"\n", end - 1 - at)
                if last >= 0:
                    yield batch(data[: last + 1], path)
                    return
                cut = 0 if at >= end else data.rfind(b"\n", 0, max(end - 1 - at, 0)) + 1
            else:
                cut = data.rfind(b"\n") + 1
            if cut:
                yield batch(data[:cut], path)
            held, at = data[cut:], at + len(data)
            if at - len(held) >= end:
                return
        if held:
            yield batch(held + b"\n", path)


def batch(data: bytes, path: str) -> pa.RecordBatch:
    """Whole lines as rows."""
    raw = np.frombuffer(data, np.uint8)
    ends = np.flatnonzero(raw == 0x0A)
    starts = np.append(0, ends[:-1] + 1)
    keep = raw != 0x0A
    lengths = ends - starts
    if (raw == 0x0D).any():
        for k in np.flatnonzero((lengths > 0) & (raw[np.maximum(ends - 1, 0)] == 0x0D)):
            at = ends[k] - 1
            while at >= starts[k] and raw[at] == 0x0D:
                keep[at] = False
                lengths[k] -= 1
                at -= 1
    offsets = np.append(0, np.cumsum(lengths)).astype(np.int32)
    text = pa.StringArray.from_buffers(len(ends), pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(raw[keep])))
    try:
        text.validate(full=True)
    except pa.ArrowInvalid:
        text = pa.array([x.as_py().decode("utf-8", "replace") for x in text.view(pa.binary())], pa.string())
    return pa.RecordBatch.from_arrays([text, pa.array([path] * len(ends), pa.string())], schema=SCHEMA)


class FolderReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        if "path" not in options:
            raise ValueError("folder_dataset needs a path")
        self.path = options["path"].rstrip("/") or "/"
        self.children = options.get("children", "false").lower() == "true"
        self.block = int(options.get("blockbytes", options.get("blockBytes", 64 << 20)))

    def partitions(self) -> list[Ranges]:
        folders = [row[1] for row in files.entries(self.path) if row[3]] if self.children else [self.path]
        sizes = []
        for folder in sorted(folders):
            known = {row[2]: row for row in files.entries(folder) if not row[3] and row[2][0] not in "._"}
            name = choose(list(known))
            if name is not None:
                sizes.append((known[name][1], known[name][4]))
        return [Ranges(own) for own in ranges(sizes, self.block)] or [Ranges([])]

    def read(self, partition: Ranges) -> Iterator[pa.RecordBatch]:
        for path, begin, end in partition.value:
            yield from lines_of(path, begin, end)


class FolderDataset(DataSource):
    @classmethod
    def name(cls) -> str:
        return "folder_dataset"

    def schema(self) -> str:
        return "text STRING, file STRING"

    def reader(self, schema) -> FolderReader:
        return FolderReader(self.options)


def register(spark: SparkSession) -> None:
    """Make the format ``folder_dataset`` known to a session."""
    spark.dataSource.register(FolderDataset)
