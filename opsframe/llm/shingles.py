"""Word shingles as 64-bit hashes, computed for whole batches of texts with numpy.

A word is a run of bytes outside 0x20 and 0x09-0x0D (the same in code points, since UTF-8 keeps these bytes for
themselves); A-Z are lower-cased. A shingle is the hash of five neighbouring words, or of all words of a shorter
text.

A word's hash is the sum, modulo 2^64, of one number for each of its bytes, which depends on the byte and its place in
the word and goes through a scrambling that is not linear. (A polynomial will not do: modulo a power of two all of them
are equal for some pairs of words, such as the Thue-Morse words, whatever the base.) Hashes are the same on every
machine. Two given different words or shingles have one hash with probability 2^-64.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

WIDTH = 5
PIECE = 1 << 19  # bytes that are hashed at once, so that they stay in the CPU's cache

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOWER = np.arange(256)
_LOWER[ord("A") : ord("Z") + 1] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """A one-to-one scrambling of 64-bit numbers."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


# One random number per byte value, the step from place to place in a word, and weights of the words in a shingle.
_EXACT = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_FOLDED = _EXACT[_LOWER]
_STEP = np.uint64(0xD1342543DE82EF95)
_WORD_STEP = [np.uint64(pow(0xDA942042E4DD58B5, k, 2**64)) for k in range(WIDTH)]


def _scattered(values: np.ndarray, places: np.ndarray) -> np.ndarray:
    """The numbers that bytes at their places add to a hash."""
    x = places.astype(np.uint64)
    x *= _STEP
    x += values
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(32)
    return x


def raw_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column, one text after the other, and the offsets of the texts (nulls: empty)."""
    column = column.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    raw = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, offsets - offsets[0]


def spans(raw: np.ndarray, offsets: np.ndarray, apart: np.ndarray = _SPACE) -> tuple[np.ndarray, np.ndarray]:
    """First and behind-last byte of all runs of bytes that ``apart`` doesn't hold; no run goes on in the next text."""
    inside = np.empty(len(raw) + 1, bool)
    np.logical_not(apart[raw], out=inside[:-1])
    inside[-1] = False
    change = np.empty(len(raw) + 1, bool)
    change[0] = inside[0]
    np.not_equal(inside[1:], inside[:-1], out=change[1:])
    edges = np.flatnonzero(change)
    first, last = edges[0::2], edges[1::2]
    # Texts that touch without a separator: cut the run at the border.
    border = offsets[1:-1]
    border = border[(border > 0) & (border < len(raw))]
    border = np.unique(border[inside[border] & inside[border - 1]])
    if len(border):
        first = np.sort(np.concatenate([first, border]))
        last = np.sort(np.concatenate([last, border]))
    return first, last


def run_hashes(raw: np.ndarray, first: np.ndarray, last: np.ndarray, values: np.ndarray = _EXACT) -> np.ndarray:
    """A 64-bit hash of each run of bytes."""
    out = np.empty(len(first), np.uint64)
    at = 0
    while at < len(first):
        begin = first[at]
        end = int(np.searchsorted(last, begin + PIECE, "right"))
        if end <= at:  # a run that is longer than a piece, piece by piece
            total = np.uint64(0)
            for part in range(begin, last[at], PIECE):
                bytes_ = raw[part : min(part + PIECE, last[at])]
                places = np.arange(part - begin, part - begin + len(bytes_))
                total += np.add.reduce(_scattered(values[bytes_], places), dtype=np.uint64)
            out[at] = total
            at += 1
            continue
        bytes_ = raw[begin : last[end - 1]]
        a, b = first[at:end] - begin, last[at:end] - begin
        places = np.arange(len(bytes_)) - np.repeat(a, np.diff(np.append(a, len(bytes_))))
        sums = np.zeros(len(bytes_) + 1, np.uint64)
        np.cumsum(_scattered(values[bytes_], places), out=sums[1:])
        out[at:end] = sums[b] - sums[a]
        at = end
    return mix(out + (last - first).astype(np.uint64))


def words(column: pa.Array, values: np.ndarray = _FOLDED) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of a string column, and how many each text has (nulls: none)."""
    with np.errstate(over="ignore"):
        raw, offsets = raw_bytes(column)
        first, last = spans(raw, offsets)
        return run_hashes(raw, first, last, values), np.diff(np.searchsorted(first, offsets))


def windows(hashes: np.ndarray, width: int = WIDTH) -> np.ndarray:
    """The hash of each window of neighbouring words, whichever texts they are in."""
    with np.errstate(over="ignore"):
        n = max(len(hashes) - width + 1, 0)
        out = np.full(n, width, np.uint64)
        for k in range(width):
            out += hashes[k : k + n] * _WORD_STEP[k]
        return mix(out)


def sets(column: pa.Array) -> Iterator[np.ndarray]:
    """For each text its distinct shingle hashes in ascending order."""
    hashes, n_words = words(column)
    whole = windows(hashes)
    at = 0
    for n in n_words.tolist():
        if n >= WIDTH:
            own = np.sort(whole[at : at + n - WIDTH + 1])
            new = np.empty(len(own), bool)
            new[0] = True
            np.not_equal(own[1:], own[:-1], out=new[1:])
            yield own[new]
        elif n:
            with np.errstate(over="ignore"):
                weighed = hashes[at : at + n] * np.array(_WORD_STEP[:n], np.uint64)
                yield mix(np.add.reduce(weighed, dtype=np.uint64, keepdims=True) + np.uint64(n))
        else:
            yield hashes[:0]
        at += n
