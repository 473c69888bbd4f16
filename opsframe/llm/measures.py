"""Measures of whole texts, for batches at once with numpy: words, lines, repeats and kinds of characters."""

from __future__ import annotations

import zlib
from functools import cached_property

import numpy as np
import pyarrow as pa

from opsframe.llm import shingles
from opsframe.llm.common import ship

ship("opsframe.llm.shingles")
ship(__name__)

_LINE = np.zeros(256, bool)
_LINE[0x0A] = True
_SYMBOL = np.zeros(256, np.int64)
_SYMBOL[list(b"#*$%&|<>")] = 1
_START = np.ones(256, np.int64)  # bytes that begin a code point
_START[0x80:0xC0] = 0
_BULLET, _ELLIPSIS = "•".encode(), "…".encode()


def kind(characters: bytes) -> np.ndarray:
    found = np.zeros(256, np.int64)
    found[list(characters)] = 1
    return found


class Measures:
    """Measures of the texts of one column (nulls are empty texts); each is worked out when it is first asked for."""

    def __init__(self, column: pa.Array):
        self.n = len(column)
        self.raw, self.offsets = shingles.raw_bytes(column)
        self.words = shingles.spans(self.raw, self.offsets)

    def per_text(self, values: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Sums of values at ascending byte positions, by text."""
        sums = np.append(0, np.cumsum(values))
        return np.diff(sums[np.searchsorted(at, self.offsets)])

    def count(self, table: np.ndarray) -> np.ndarray:
        """Bytes of a kind in each text."""
        sums = np.zeros(len(self.raw) + 1, np.int64)
        np.cumsum(table[self.raw], out=sums[1:])
        return np.diff(sums[self.offsets])

    @cached_property
    def n_words(self) -> np.ndarray:
        return np.diff(np.searchsorted(self.words[0], self.offsets))

    @cached_property
    def word_owner(self) -> np.ndarray:
        return np.repeat(np.arange(self.n), self.n_words)

    @cached_property
    def word_hashes(self) -> np.ndarray:
        with np.errstate(over="ignore"):
            return shingles.run_hashes(self.raw, *self.words)

    @cached_property
    def n_chars(self) -> np.ndarray:
        return self.count(_START)

    @cached_property
    def word_chars(self) -> np.ndarray:
        """Code points in words."""
        sums = np.zeros(len(self.raw) + 1, np.int64)
        np.cumsum(_START[self.raw], out=sums[1:])
        return self.per_text(sums[self.words[1]] - sums[self.words[0]], self.words[0])

    @cached_property
    def n_symbols(self) -> np.ndarray:
        return self.count(_SYMBOL)

    @cached_property
    def line_spans(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Where the lines that have a word begin and end, and how many each text has."""
        first, last = shingles.spans(self.raw, self.offsets, _LINE)
        with_word = np.searchsorted(self.words[0], last) > np.searchsorted(self.words[0], first)
        first, last = first[with_word], last[with_word]
        return first, last, np.diff(np.searchsorted(first, self.offsets))

    @cached_property
    def line_hashes(self) -> np.ndarray:
        with np.errstate(over="ignore"):
            return shingles.run_hashes(self.raw, *self.line_spans[:2])

    @cached_property
    def n_lines(self) -> np.ndarray:
        return self.line_spans[2]

    def _repeated(self, hashes: np.ndarray, owner: np.ndarray) -> np.ndarray:
        """Whether the same hash is in the same text at another place: 2 for a later one, 1 for the first, 0 if not."""
        with np.errstate(over="ignore"):
            keys = shingles.mix(hashes + shingles.mix(owner.astype(np.uint64) + np.uint64(1)))
        order = np.argsort(keys, kind="stable")
        found = keys[order]
        same = found[1:] == found[:-1]
        out = np.zeros(len(keys), np.int8)
        out[order[:-1][same]] = 1
        out[order[1:][same]] = 2
        return out

    @cached_property
    def n_dup_lines(self) -> np.ndarray:
        """Lines with a word that are equal to an earlier line."""
        owner = np.repeat(np.arange(self.n), self.n_lines)
        return np.bincount(owner[self._repeated(self.line_hashes, owner) == 2], minlength=self.n)

    @cached_property
    def n_repeat_words(self) -> np.ndarray:
        """Words in windows of five words that the text has twice or more."""
        width = shingles.WIDTH
        hashes = shingles.windows(self.word_hashes)
        if not len(hashes):
            return np.zeros(self.n, np.int64)
        owner = self.word_owner
        whole = np.flatnonzero(owner[: len(hashes)] == owner[width - 1 :])
        twice = whole[self._repeated(hashes[whole], owner[whole]) > 0]
        edge = np.zeros(len(owner) + 1, np.int64)
        np.add.at(edge, twice, 1)
        np.add.at(edge, twice + width, -1)
        covered = np.cumsum(edge[:-1]) > 0
        return np.bincount(owner[covered], minlength=self.n)

    @cached_property
    def n_distinct_words(self) -> np.ndarray:
        return self.distinct_words(np.arange(self.n))

    # Measures of some texts only, ``rows``: they cost more than a count, and are asked of what cheaper rules have left.

    def _chosen(self, rows: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which of the words or lines belong to ``rows``, and to which of these."""
        place = np.full(self.n, -1)
        place[rows] = np.arange(len(rows))
        own = np.flatnonzero(place[owner] >= 0)
        return own, place[owner[own]]

    def distinct_words(self, rows: np.ndarray) -> np.ndarray:
        own, owner = self._chosen(rows, self.word_owner)
        later = self._repeated(self.word_hashes[own], owner) == 2
        return self.n_words[rows] - np.bincount(owner[later], minlength=len(rows))

    def bulleted_lines(self, rows: np.ndarray) -> np.ndarray:
        """Lines that begin with a hyphen, an asterisk or a bullet."""
        first, _, counts = self.line_spans
        own, owner = self._chosen(rows, np.repeat(np.arange(self.n), counts))
        begin = self.words[0][np.searchsorted(self.words[0], first[own])]
        marked = (self.raw[begin] == 0x2D) | (self.raw[begin] == 0x2A) | self._at(begin, _BULLET)
        return np.bincount(owner[marked], minlength=len(rows))

    def cut_lines(self, rows: np.ndarray) -> np.ndarray:
        """Lines that end with three dots or an ellipsis."""
        first, last, counts = self.line_spans
        own, owner = self._chosen(rows, np.repeat(np.arange(self.n), counts))
        end = self.words[1][np.searchsorted(self.words[1], last[own], "right") - 1]
        begin = np.maximum(end - 3, 0)
        cut = (end - 3 >= first[own]) & (self._at(begin, b"...") | self._at(begin, _ELLIPSIS))
        return np.bincount(owner[cut], minlength=len(rows))

    def _at(self, places: np.ndarray, what: bytes) -> np.ndarray:
        """Whether three bytes are at the places."""
        padded = np.append(self.raw, np.zeros(3, np.uint8))
        return np.logical_and.reduce([padded[places + k] == byte for k, byte in enumerate(what)])

    def _bytes(self, row: int) -> np.ndarray:
        return self.raw[self.offsets[row] : self.offsets[row + 1]]

    def n_bytes(self, rows: np.ndarray) -> np.ndarray:
        return np.diff(self.offsets)[rows]

    def compressed(self, rows: np.ndarray) -> np.ndarray:
        """Bytes of the texts when they are compressed."""
        return np.array([len(zlib.compress(self._bytes(row), 1)) for row in rows.tolist()], np.int64)

    def entropy(self, rows: np.ndarray) -> np.ndarray:
        """Bits that a byte of the text carries, by the frequencies of its bytes."""
        found = np.zeros(len(rows))
        for k, row in enumerate(rows.tolist()):
            counts = np.bincount(self._bytes(row), minlength=256)
            share = counts[counts > 0] / max(counts.sum(), 1)
            found[k] = -(share * np.log2(share)).sum()
        return found
