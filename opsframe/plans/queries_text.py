"""Queries on words."""

from __future__ import annotations

import sys

from pyspark.sql import functions as F

from opsframe.operators import text
from opsframe.plans.registry import query

WORDS = r"(SELECT unnest(string_split_regex(text, '\s+')) AS word FROM documents)"
COUNTS = f"SELECT word, count(*) AS count FROM {WORDS} WHERE word <> '' GROUP BY word"
KEYED = f"SELECT word AS key, count(*) AS value FROM {WORDS} WHERE word <> '' GROUP BY word"

# The user programs of a word count: one prints each word with a 1, the other sums runs of equal keys.
MAPPER = """import sys
for line in sys.stdin.buffer:
    words = line.split()
    if words:
        sys.stdout.buffer.write(b"\\t1\\n".join(words) + b"\\t1\\n")
"""
REDUCER = """import sys
key, total = None, 0
write = sys.stdout.buffer.write
for line in sys.stdin.buffer:
    word, n = line.split(b"\\t")
    if word != key:
        if key is not None:
            write(b"%b\\t%d\\n" % (key, total))
        key, total = word, 0
    total += int(n)
if key is not None:
    write(b"%b\\t%d\\n" % (key, total))
"""


def program(source: str) -> str:
    """A command that runs a Python program given as text, so that no file has to be on the executors."""
    import shlex

    python = "python3" if not sys.executable else sys.executable
    return f"{python} -c {shlex.quote(source)}"


@query("word_count", COUNTS)
def _(v):
    return text.word_count(v["documents"])


@query("top_words", f"{COUNTS} ORDER BY count DESC, word DESC LIMIT 20")
def _(v):
    return text.top_words(text.word_count(v["documents"]))


@query("head_preview", f"{COUNTS} ORDER BY word LIMIT 20")
def _(v):
    return text.head_preview(text.word_count(v["documents"]), ["word"], 20)


@query("input_preview", "SELECT doc_id, text FROM documents ORDER BY doc_id LIMIT 20")
def _(v):
    return text.head_preview(v["documents"].select("doc_id", "text"), ["doc_id"], 20)


@query(
    "trial_run",
    f"{COUNTS.replace(WORDS, WORDS.replace('FROM documents', 'FROM (SELECT text FROM documents ORDER BY doc_id LIMIT 50)'))}",
)
def _(v):
    return text.trial_run(v["documents"].select("doc_id", "text"), ["doc_id"], text.word_count, 50)


@query("pipe_mapreduce", KEYED)
def _(v):
    counted = text.pipe_mapreduce(v["documents"].select("text"), program(MAPPER), program(REDUCER), program(REDUCER))
    return counted.select("key", F.col("value").cast("bigint").alias("value"))


@query("map_reduce_udf", KEYED)
def _(v):
    lines = v["documents"].select("text")
    return text.map_reduce_udf(lines, text.emit_ones, text.sum_rows)
