"""Byte-level BPE by dynamic programming over prefixes.

For every prefix of a piece there is exactly one last token: the one that ends there and is *compatible* with the last
token of the prefix it leaves. Two tokens are compatible if the merges of their joined bytes give just these two back.
So a table with one last token per prefix stands for the encodings of all prefixes; following it backwards gives any of
them. Appending bytes extends the table and changes nothing in it; an edit keeps the table up to its place, and behind
the edit only the pieces that changed are encoded again (``Encoded``).

A text is split by the vocabulary's pattern and each match is encoded alone, without special tokens. Ranks come from a
file of lines ``base64(token) rank``. Null texts are empty and have no tokens; a table may be empty and have other
columns. Pieces recur, so each worker keeps the encodings of up to twice ``REMEMBERED`` of them; long texts need memory in
proportion to their own length only.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from opsframe.llm.common import ship

ship(__name__)

REMEMBERED = 1 << 18
REMEMBERED_BYTES = 48  # longer pieces are not kept


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as file:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, file)}


class Vocabulary:
    """``store`` holds plain dictionaries; whoever keeps it keeps what has been worked out."""

    def __init__(self, ranks: dict[bytes, int], store: dict | None = None):
        self.ranks = ranks
        self.store = store if store is not None else {}
        if "tokens" not in self.store:
            # Every suffix of a token: its rank, or -1 if it is no token itself.
            suffixes = {token[k:]: -1 for token in ranks for k in range(1, len(token))}
            self.store |= {"tokens": dict(zip(ranks.values(), ranks.keys(), strict=True)), "suffixes": suffixes | ranks}
        self.tokens, self.suffixes = self.store["tokens"], self.store["suffixes"]
        self.pairs = self.store.setdefault("pairs", {})

    def merged(self, data: bytes) -> list[bytes]:
        """The definition: merge the adjacent pair of least rank, again and again. Only for a token or two."""
        parts = [data[k : k + 1] for k in range(len(data))]
        while len(parts) > 1:
            joined = [self.ranks.get(a + b, 1 << 60) for a, b in zip(parts, parts[1:], strict=False)]
            least = min(joined)
            if least == 1 << 60:
                break
            k = joined.index(least)
            parts[k : k + 2] = [parts[k] + parts[k + 1]]
        return parts

    def compatible(self, left: int, right: int) -> bool:
        """Whether the joined bytes of two tokens are merged to these two; left is -1 where the piece begins."""
        if len(self.pairs) >= 2 * REMEMBERED:
            self.pairs.clear()
        known = [self.tokens[left]] if left >= 0 else []
        known.append(self.tokens[right])
        good = self.pairs[left << 32 | right] = self.merged(b"".join(known)) == known
        return good


class Prefixes:
    """The last token of every prefix of one piece."""

    def __init__(self, vocabulary: Vocabulary, data: bytes = b""):
        self.vocabulary, self.data, self.last = vocabulary, b"", [-1]
        self.append(data)

    def append(self, more: bytes) -> None:
        """Extends the table; what it has for shorter prefixes stays."""
        v, start = self.vocabulary, len(self.data)
        data, last, suffix, pair = self.data + more, self.last, v.suffixes.get, v.pairs.get
        for end in range(start + 1, len(data) + 1):
            begin = end - 1
            while True:
                token = suffix(data[begin:end])
                if token >= 0:
                    left = last[begin]
                    good = pair(left << 32 | token)
                    if good or good is None and v.compatible(left, token):
                        last.append(token)
                        break
                begin -= 1
        self.data = data

    def cut(self, length: int) -> None:
        self.data = self.data[:length]
        del self.last[length + 1 :]

    def ids(self, length: int | None = None) -> list[int]:
        """The encoding of a prefix, by default of the whole piece."""
        at, found = len(self.data) if length is None else length, []
        while at:
            found.append(self.last[at])
            at -= len(self.vocabulary.tokens[self.last[at]])
        return found[::-1]


class Tokenizer:
    """Encodes pieces to packed ids (little-endian unsigned 32-bit)."""

    def __init__(self, vocabulary: Vocabulary, pattern: str):
        self.vocabulary, self.pattern = vocabulary, regex.compile(pattern)
        self.newer = vocabulary.store.setdefault("newer", {})

    def piece(self, text: str) -> bytes:
        store, data = self.vocabulary.store, text.encode()
        packed = store.get("older", {}).get(text)
        if packed is None:
            whole = self.vocabulary.ranks.get(data)
            ids = Prefixes(self.vocabulary, data).ids() if whole is None else [whole]
            packed = b"".join([n.to_bytes(4, "little") for n in ids])
        if len(data) <= REMEMBERED_BYTES:
            # Two generations: what is still in use moves from the older to the newer one.
            if len(self.newer) >= REMEMBERED:
                store["older"] = dict(self.newer)
                self.newer.clear()
            self.newer[text] = packed
        return packed

    def encode(self, text: str) -> bytes:
        known, piece = self.newer.get, self.piece
        return b"".join([known(p) or piece(p) for p in self.pattern.findall(text)])

    def decode(self, packed: bytes) -> bytes:
        return b"".join(map(self.vocabulary.tokens.__getitem__, np.frombuffer(packed, "<u4").tolist()))


class Encoded:
    """A text with its ids by piece, which edits change near their place only."""

    def __init__(self, tokenizer: Tokenizer, text: str):
        self.tokenizer, self.text = tokenizer, text
        self.pieces = [(m.start(), m.group()) for m in tokenizer.pattern.finditer(text)]
        self.packed = [tokenizer.piece(p) for _, p in self.pieces]

    def ids(self) -> list[int]:
        return np.frombuffer(b"".join(self.packed), "<u4").tolist()

    def replace(self, begin: int, end: int, new: str) -> int:
        """Puts ``new`` in place of text[begin:end]; returns how many pieces were encoded again.

        Matching restarts two pieces before the edit (a match looks one character ahead) and stops where it meets a
        border of the old pieces again.
        """
        text = self.text[:begin] + new + self.text[end:]
        shift = len(new) - (end - begin)
        starts = [at for at, _ in self.pieces]
        first = max(0, int(np.searchsorted(starts, begin, "right")) - 3)
        at = starts[first] if starts else 0
        later = {s + shift: k for k, s in enumerate(starts) if s > end}
        fresh, stop = [], len(self.pieces)
        for m in self.tokenizer.pattern.finditer(text, at):
            if m.start() in later:
                stop = later[m.start()]
                break
            fresh.append((m.start(), m.group()))
        self.text = text
        self.pieces = self.pieces[:first] + fresh + [(s + shift, p) for s, p in self.pieces[stop:]]
        self.packed = self.packed[:first] + [self.tokenizer.piece(p) for _, p in fresh] + self.packed[stop:]
        return len(fresh)


def encode(docs: DataFrame, ranks: dict[bytes, int], pattern: str) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, ids (packed), decoded (bytes of the decoded ids)."""
    # The vocabulary, of a fixed size. A worker keeps a broadcast value between tasks, and with it what the store holds.
    shared = docs.sparkSession.sparkContext.broadcast({"ranks": ranks, "store": {}})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = Tokenizer(Vocabulary(shared.value["ranks"], shared.value["store"]), pattern)
        for batch in batches:
            for at in range(0, len(batch), 256):
                part = batch.slice(at, 256)
                ids = [tokenizer.encode(text or "") for text in part.column(1).to_pylist()]
                decoded = [tokenizer.decode(packed) for packed in ids]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(ids, pa.binary()), pa.array(decoded, pa.binary())], ["doc_id", "ids", "decoded"]
                )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, ids binary, decoded binary")


def token_ids(docs: DataFrame, ranks: dict[bytes, int], pattern: str) -> DataFrame:
    """doc_id, ids (packed), n_tokens, ids_sha256, decoded_sha256."""
    encoded = encode(docs, ranks, pattern)
    return encoded.selectExpr(
        "doc_id", "ids", "CAST(octet_length(ids) div 4 AS BIGINT) AS n_tokens", "sha2(ids, 256) AS ids_sha256",
        "sha2(decoded, 256) AS decoded_sha256",
    )


def digests(docs: DataFrame, ranks: dict[bytes, int], pattern: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256."""
    return token_ids(docs, ranks, pattern).drop("ids")


__all__ = ["Encoded", "Prefixes", "Tokenizer", "Vocabulary", "digests", "encode", "read_ranks", "token_ids"]
