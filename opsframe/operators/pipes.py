"""User programs as children of a task: Arrow batches go to standard input as blocks of bytes, standard output is cut into
batches at its newlines. No line is ever a Python object.

The kernels here take the system's allocator: Arrow's own was seen to fail in long tasks that allocate large blocks.
"""

from __future__ import annotations

import os
import subprocess
import threading
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from opsframe.plans.session import ship

ship(__name__)

READ = 1 << 20  # bytes that are read from a program at once
FEED = 1 << 20  # bytes of lines that are given to a program at once; a longer line is a block of its own
SPILL = 1 << 23  # bytes of mapper output that are sorted and combined at once; sorting takes some ten times as much
TAIL = 4_000  # bytes of its last messages that are kept for the error

LINE = pa.schema([("line", pa.string())])
NEWLINE, TAB = 0x0A, 0x09


class ProgramFailed(RuntimeError):
    """A user program ended with a status other than 0."""


def as_lines(column: pa.Array) -> pa.Buffer | bytes:
    """The values of a string column, each with a newline behind it; null is an empty line."""
    text = pc.cast(column, pa.large_string(), memory_pool=pa.system_memory_pool())
    nothing, newline = pa.scalar("", pa.large_string()), pa.scalar("\n", pa.large_string())
    ended = pc.binary_join_element_wise(text, nothing, newline, null_handling="replace", null_replacement="", memory_pool=pa.system_memory_pool())
    ended = ended.combine_chunks() if isinstance(ended, pa.ChunkedArray) else ended
    if not len(ended):
        return b""
    offsets = np.frombuffer(ended.buffers()[1], np.int64)[ended.offset : ended.offset + len(ended) + 1]
    return ended.buffers()[2].slice(int(offsets[0]), int(offsets[-1] - offsets[0]))


def cut(data: bytes) -> pa.RecordBatch:
    """Whole lines, the last one with its newline, as a batch; bytes that are no UTF-8 are replaced."""
    raw = np.frombuffer(data, np.uint8)
    ends = np.flatnonzero(raw == NEWLINE)
    offsets = np.zeros(len(ends) + 1, np.int32)
    offsets[1:] = ends - np.arange(len(ends))  # where each line ends once the newlines are gone
    values = np.ascontiguousarray(raw[raw != NEWLINE])
    lines = pa.StringArray.from_buffers(len(ends), pa.py_buffer(offsets), pa.py_buffer(values))
    try:
        lines.validate(full=True)
    except pa.ArrowInvalid:
        lines = pa.array(data.decode("utf-8", "replace").split("\n")[:-1], pa.string())
    return pa.RecordBatch.from_arrays([lines], schema=LINE)


class Program:
    """A running program: a thread feeds it, another keeps its last messages, and its status is asked for at the end."""

    def __init__(self, command: str, blocks: Iterable[pa.Buffer | bytes]):
        self.command = command
        self.child = subprocess.Popen(
            ["sh", "-c", command], stdin=subprocess.PIPE, stdout=subprocess.PIPE, stderr=subprocess.PIPE, bufsize=0
        )
        self.error: BaseException | None = None
        self.messages = b""
        self.feeder = threading.Thread(target=self._feed, args=(blocks,), daemon=True)
        self.listener = threading.Thread(target=self._listen, daemon=True)
        self.feeder.start()
        self.listener.start()

    def _feed(self, blocks: Iterable[pa.Buffer | bytes]) -> None:
        reads = True
        try:
            for block in blocks:  # to the end, also when the program has stopped to read
                view = memoryview(block)
                while reads and len(view):
                    try:
                        view = view[self.child.stdin.write(view) :]
                    except BrokenPipeError:
                        reads = False
        except BaseException as error:  # what went wrong upstream is raised by the reading thread
            self.error = error
        finally:
            try:
                self.child.stdin.close()
            except BrokenPipeError:
                pass

    def _listen(self) -> None:
        while part := self.child.stderr.read(READ):
            self.messages = (self.messages + part)[-TAIL:]

    def output(self, size: int = READ) -> Iterator[bytes]:
        """What the program prints, in parts of about ``size`` bytes that end with a line."""
        try:
            parts: list[bytes] = []
            held = 0
            while part := os.read(self.child.stdout.fileno(), READ):
                parts.append(part)
                held += len(part)
                if held >= size and (end := part.rfind(b"\n") + 1):
                    parts[-1] = part[:end]
                    whole, parts = b"".join(parts), [part[end:]]
                    held = len(parts[0])
                    yield whole
            rest = b"".join(parts)
            if rest:
                yield rest if rest.endswith(b"\n") else rest + b"\n"
            self.finish()
        finally:
            if self.child.poll() is None:  # the rows are not wanted any more
                self.child.kill()
                self.child.wait()

    def finish(self) -> None:
        status = self.child.wait()
        self.feeder.join()
        self.listener.join()
        if self.error is not None:
            raise self.error
        if status:
            said = self.messages.decode("utf-8", "replace").strip()
            raise ProgramFailed(f"status {status} of {self.command!r}" + (f": {said}" if said else ""))


def inputs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Buffer | bytes]:
    """The lines of the first column as blocks of about ``FEED`` bytes, however large the batches are."""
    for batch in batches:
        column = batch.column(0)
        sizes = pc.fill_null(pc.binary_length(column, memory_pool=pa.system_memory_pool()), 0)
        block = np.cumsum(np.asarray(sizes, np.int64) + 1) // FEED  # of each line, by where it ends
        cuts = [0, *(np.flatnonzero(np.diff(block)) + 1).tolist(), len(column)]
        for start, end in zip(cuts, cuts[1:]):
            yield as_lines(column.slice(start, end - start))


def piped(command: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """For ``mapInArrow``: the lines of the first column through a program, as one column ``line``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for data in Program(command, inputs(batches)).output():
            yield cut(data)

    return run


def keys_of(lines: pa.StringArray) -> pa.StringArray:
    """What is before the first tab of each line; whole lines without one."""
    offsets = np.frombuffer(lines.buffers()[1], np.int32)[lines.offset : lines.offset + len(lines) + 1]
    raw = np.frombuffer(lines.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
    offsets = offsets - offsets[0]
    tabs = np.append(np.flatnonzero(raw == TAB), len(raw)).astype(np.int32)
    ends = np.minimum(tabs[np.searchsorted(tabs, offsets[:-1])], offsets[1:])
    edge = np.zeros(len(raw) + 1, np.int8)  # 1 where a key begins, -1 behind it; empty keys cancel out
    np.add.at(edge, offsets[:-1], 1)
    np.add.at(edge, ends, -1)
    values = np.ascontiguousarray(raw[np.cumsum(edge[:-1], dtype=np.int8) > 0])
    starts = np.append(0, np.cumsum(ends - offsets[:-1])).astype(np.int32)
    return pa.StringArray.from_buffers(len(lines), pa.py_buffer(starts), pa.py_buffer(values))


def by_key(lines: pa.StringArray) -> pa.StringArray:
    """Lines with equal keys (what is before the first tab) together, in the order of their keys' bytes."""
    if not len(lines):
        return lines
    keys = pc.dictionary_encode(keys_of(lines), memory_pool=pa.system_memory_pool())
    rank = np.empty(len(keys.dictionary), np.int32)
    rank[np.asarray(pc.sort_indices(keys.dictionary, memory_pool=pa.system_memory_pool()))] = np.arange(len(rank), dtype=np.int32)
    order = np.argsort(rank[np.asarray(keys.indices)], kind="stable")
    return pc.take(lines, pa.array(order), memory_pool=pa.system_memory_pool())


def mapped_and_combined(mapper: str, combiner: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """For ``mapInArrow``: the mapper's output, ``SPILL`` bytes at a time, sorted by key and through the combiner.

    Each is a process of its own, and the status of each counts.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for data in Program(mapper, inputs(batches)).output(SPILL):
            together = as_lines(by_key(cut(data).column(0)))
            for combined in Program(combiner, [together]).output():
                yield cut(combined)
            del data, together
            pa.system_memory_pool().release_unused()  # freed blocks go back to the system, or they add up block by block

    return run
