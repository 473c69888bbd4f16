"""The trie of conversation prefixes against a plain version."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from opsframe.llm import prefix_trie
from tests.compare import connect, differences

SCHEMA = "conv_id BIGINT, turn BIGINT, role STRING, text STRING, pos STRING, n_turns INT, `key` STRING"


def plain_turns(rows):
    own = defaultdict(list)
    for conv_id, turn, role, text in rows:
        if conv_id is not None:
            role, text = role or "", text or ""
            size = str(len(role.encode())).encode()
            tie = hashlib.sha256(size + b":" + role.encode() + text.encode()).digest()[:16]
            own[conv_id].append((turn is not None, turn or 0, tie, role, text))
    return {c: [x[3:] for x in sorted(turns)] for c, turns in own.items()}


def plain_rebuilt(turns):
    out = {}
    for c, own in turns.items():
        h = zlib.crc32(str(c).encode()) % 9
        donor = c - (abs(c) % 5) * (1 if c >= 0 else -1)
        out[c] = turns.get(donor, [])[:h] + own[h:]
    return out


def plain_trie(convs):
    members = defaultdict(list)
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    children = defaultdict(list)
    for node in members:
        if node:
            children[node[:-1]].append(node)
    leaves, saved = {}, {}
    for node in sorted(members, key=len, reverse=True):
        leaves[node] = sum(leaves[x] for x in children[node]) or (0 if children[node] else 1)
        size = len(node[-1][1].encode()) if node else 0
        saved[node] = (len(members[node]) - 1) * size + sum(saved[x] for x in children[node])
    out = []
    for node, own in members.items():
        ends = ",".join(map(str, sorted(c for c in own if len(convs[c]) == len(node))))
        above = min(members[node[:-1]]) if node else None
        out.append((min(own), len(node), above, len(own), len(children[node]), leaves[node], saved[node], hashlib.sha256(ends.encode()).hexdigest()))
    return Counter(out)


def some_rows():
    dice = random.Random(8)
    said = ["", None, "a", "é" * 3, "b\n", " ", "x" * 50_000]
    rows = []
    for c in range(120):
        for t in range(dice.choice([0, 1, 2, 5, 9, 17, 40])):
            rows.append((c, t, dice.choice(["user", "user", None]), dice.choice(said[:3] if t < 12 else said)))
    rows += [(c, t, "user", "same") for c in range(1_000, 1_060) for t in range(20)]  # copies
    rows += [(5, None, "first", "by null"), (5, None, "first", "by null too"), (5, 0, "tie", "x"), (5, 0, "tie", "y"), (5, 0, "tie", "y")]
    rows += [(None, 1, "user", "of none"), (-7, 1, "user", "a"), (-5, 1, "user", "b"), (7777, 0, "user", "donor is not there")]
    rows += [(2_000, t, "user", f"{t % 3}") for t in range(700)]  # long, and a copy that leaves it late
    rows += [(2_005, t, "user", f"{t % 3 if t < 600 else t}") for t in range(650)]
    rows += [(3, t, "au", "b") for t in range(3)] + [(4, t, "a", "ub") for t in range(3)]
    return rows


def frame(spark, rows):
    return spark.createDataFrame([(*row, "p", 3, "k") for row in rows], SCHEMA)


@pytest.mark.parametrize("height", [2, 8])
def test_rebuilt_against_plain_version(spark, height):
    rows = some_rows()
    numbered = prefix_trie.ordinals(prefix_trie.turns_of(frame(spark, rows).repartition(5)))
    c = F.col("conv_id")
    head = F.crc32(c.cast("string").cast("binary")) % 9
    got = prefix_trie.trie(prefix_trie.rebuilt(numbered, c - c % 5, head, 8), height)
    assert Counter(map(tuple, got.collect())) == plain_trie(plain_rebuilt(plain_turns(rows)))


def test_conversations_as_they_are(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "PIECE", 40)
    rows = some_rows()
    numbered = prefix_trie.ordinals(prefix_trie.turns_of(frame(spark, rows)))
    got = prefix_trie.trie(prefix_trie.whole(numbered), 4)
    assert Counter(map(tuple, got.collect())) == plain_trie(plain_turns(rows))


def test_empty_table(spark):
    numbered = prefix_trie.ordinals(prefix_trie.turns_of(frame(spark, [])))
    assert prefix_trie.trie(prefix_trie.whole(numbered)).collect() == []


def test_query_with_sql(spark, sf_dir):
    assert differences(entry.queries()["op11_prefix_trie"](spark, sf_dir), connect(sf_dir), entry.oracle_sql()["op11_prefix_trie"]) is None
