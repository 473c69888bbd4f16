"""Quality rules as a short-circuit cascade.

Each rule is a test on measures of a text. On a sample the rules are timed, on top of the measures that every row gets
anyway, and their rejections counted; they then run in the order of rejections per second, and each is asked only of what
the rules before it have left. Rules differ in what they cost: some compare counts that are there, others sort a text's
words, look at its lines, or compress it. A document is kept if no rule rejects it, so the order changes the work and
never the verdict. ``rejected_by`` names the first rule in that order, and ``rules_run`` how many were asked; both may
differ between runs where several reject. ``saved`` sums up the questions that were not asked.

The base rules come first and in their fixed order. Nulls: a null text is empty and fails the base rules. Ties, repeated
rows and long texts need nothing special: a row is judged by itself, whole. Empty tables give empty results; other columns
are not looked at.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from opsframe.llm.common import ship
from opsframe.llm.measures import Measures

ship("opsframe.llm.measures")
ship(__name__)

SAMPLE_ROWS = 2_000
BLOCK = 1_024


@dataclass(frozen=True)
class Rule:
    """``rejects(measures, rows)`` tells for each of the rows (places in the block) whether it is rejected."""

    name: str
    rejects: Callable[[Measures, np.ndarray], np.ndarray]


MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20
FEW_LINES = 3  # below it, how lines begin and end says nothing

BASE = [
    Rule("few words", lambda m, rows: m.n_words[rows] < MIN_WORDS),
    Rule("repeated words", lambda m, rows: 100 * m.n_repeat_words[rows] > MAX_REPEAT_PERCENT * m.n_words[rows]),
]

# Whole numbers on both sides where they do, so that no verdict hangs on rounding. Clean prose is far from all of these.
RULES = [
    Rule("symbols", lambda m, rows: 10 * m.n_symbols[rows] > 3 * m.n_words[rows]),
    Rule("short words", lambda m, rows: m.word_chars[rows] < 2 * m.n_words[rows]),
    Rule("long words", lambda m, rows: m.word_chars[rows] > 15 * m.n_words[rows]),
    Rule("repeated lines", lambda m, rows: 100 * m.n_dup_lines[rows] > 50 * m.n_lines[rows]),
    Rule("bullets", lambda m, rows: (m.n_lines[rows] >= FEW_LINES) & (10 * m.bulleted_lines(rows) > 9 * m.n_lines[rows])),
    Rule("lines cut off", lambda m, rows: (m.n_lines[rows] >= FEW_LINES) & (10 * m.cut_lines(rows) > 9 * m.n_lines[rows])),
    Rule("few different words", lambda m, rows: 10 * m.distinct_words(rows) < m.n_words[rows]),
    Rule("one kind of character", lambda m, rows: m.entropy(rows) < 2.0),
    Rule("compresses too well", lambda m, rows: 10 * m.compressed(rows) < m.n_bytes(rows)),
]
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def order_rules(docs: DataFrame, rules: list[Rule] = RULES, sample_rows: int = SAMPLE_ROWS) -> list[Rule]:
    """``rules`` by rejections per second on the ``sample_rows`` documents whose ids have the smallest hashes."""
    ids = docs.select("doc_id").distinct().orderBy(F.xxhash64("doc_id")).limit(sample_rows)
    sample = docs.join(F.broadcast(ids), "doc_id", "left_semi").select("text")

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spent, hit = [], []
            for rule in rules:
                own = Measures(batch.column(0))
                for name in COUNTS:  # there anyway; each rule pays for what it needs beyond these
                    getattr(own, name)
                start = time.perf_counter()
                hit.append(int(np.count_nonzero(rule.rejects(own, np.arange(own.n)))))
                spent.append(time.perf_counter() - start)
            names = pa.array([rule.name for rule in rules])
            yield pa.RecordBatch.from_arrays([names, pa.array(spent), pa.array(hit, pa.int64())], ["name", "spent", "hit"])

    found = sample.mapInArrow(measure, "name string, spent double, hit bigint").groupBy("name")
    rows = found.agg(F.sum("spent").alias("spent"), F.sum("hit").alias("hit")).collect()  # one row per rule
    gain = {row["name"]: row["hit"] / max(row["spent"], 1e-9) for row in rows}
    return sorted(rules, key=lambda rule: (-gain.get(rule.name, 0.0), rule.name))


def cascade(docs: DataFrame, rules: list[Rule] | None = None, base: list[Rule] = BASE) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): the counts, base_failed, kept, rejected_by, rules_run."""
    ordered = order_rules(docs) if rules is None else rules

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), BLOCK):
                part = batch.slice(at, BLOCK)
                whole = Measures(part.column(1))
                every = np.arange(len(part))
                values = [pa.array(np.asarray(getattr(whole, c), np.int64)) for c in COUNTS]
                by = np.full(len(part), None, object)
                for rule in base[::-1]:  # the first that rejects is named
                    by[rule.rejects(whole, every)] = rule.name
                failed = np.array([x is not None for x in by], bool)
                asked = np.zeros(len(part), np.int32)
                left = np.flatnonzero(~failed)
                for rule in ordered:
                    if not len(left):
                        break
                    asked[left] += 1
                    bad = rule.rejects(whole, left)
                    by[left[bad]] = rule.name
                    left = left[~bad]
                kept = np.zeros(len(part), bool)
                kept[left] = True
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), *values, pa.array(failed), pa.array(kept), pa.array(by.tolist(), pa.string()), pa.array(asked)],
                    ["doc_id", *COUNTS, "base_failed", "kept", "rejected_by", "rules_run"],
                )

    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = ", ".join([f"doc_id {kind}", *[f"{c} bigint" for c in COUNTS]])
    return docs.select("doc_id", "text").mapInArrow(
        run, f"{schema}, base_failed boolean, kept boolean, rejected_by string, rules_run int"
    )


def saved(found: DataFrame, n_rules: int = len(RULES)) -> DataFrame:
    """Of the result of ``cascade`` one row: documents, questions that rules were asked, and those that were saved."""
    asked = F.coalesce(F.sum("rules_run"), F.lit(0))
    return found.agg(F.count("*").alias("documents"), asked.alias("asked"), (n_rules * F.count("*") - asked).alias("saved"))
