"""Hard negatives against a plain search of all pairs."""

import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from opsframe.llm import negatives
from tests.compare import connect, differences

SCHEMA = "vec_id BIGINT, embedding ARRAY<DOUBLE>, label INT, score INT, anchor_no STRING"


def plain_search(rows, is_anchor, positives=5, per_window=10):
    own = []
    for vec_id, vector, label in rows:
        if vec_id is None or label is None or vector is None or any(x is None or not math.isfinite(x) for x in vector):
            continue
        scaled = [math.floor(256 * x) if abs(x) < 1e300 else int(x) * 256 for x in vector]
        own.append((vec_id, label, scaled))
    out = []
    for anchor_id, label, vector in own:
        if not is_anchor(anchor_id):
            continue
        scored = []
        for other, other_label, other_vector in own:
            total = sum(x * y for x, y in zip(vector, other_vector))
            scored.append((-min(max(total, -(2**63)), 2**63 - 1), other, other_label))
        scored.sort(key=lambda x: x[:2])
        for score, positive, _ in [x for x in scored if x[2] == label and x[1] != anchor_id][:positives]:
            fit = [x for x in scored if x[2] != label and 30 * -score <= 100 * -x[0] <= 90 * -score][:per_window]
            out += [(anchor_id, positive, k + 1, x[1], -score, -x[0]) for k, x in enumerate(fit)]
    return Counter(out)


def frame(spark, rows):
    return spark.createDataFrame([(i, v, label, 1, "x") for i, v, label in rows], SCHEMA)


def some_rows():
    dice = random.Random(3)
    vectors = [[dice.gauss(0, 0.3) for _ in range(6)] for _ in range(12)]
    rows = [(k, [x + dice.gauss(0, 0.1) for x in dice.choice(vectors)], dice.randrange(3)) for k in range(300)]
    rows += [(300 + k, vectors[0], k % 3) for k in range(150)]  # one vector in a third of the rows
    rows += [(450, [0.0] * 6, 0), (451, [0.0] * 6, 1), (440, [0.0] * 6, 1), (460, [], 0), (461, [0.5], 1), (470, vectors[1] + [9.0], 2)]
    rows += [(480, vectors[1], None), (None, vectors[1], 1), (490, None, 1), (500, [0.1, None, 0.1], 1)]
    rows += [(510, [math.nan] * 6, 1), (520, [math.inf] + [0.1] * 5, 1), (-10, vectors[2], 1), (530, vectors[2], -1)]
    rows += [rows[20], rows[20], rows[45], rows[310]]  # repeated rows, an anchor among them
    return rows


@pytest.mark.parametrize("at_once", [4_096, 7])
def test_against_plain_search(spark, at_once):
    rows = some_rows()
    for cut in (1, 9):
        got = negatives.hard_negatives(frame(spark, rows).repartition(cut), F.col("vec_id") % 10 == 0, anchors_at_once=at_once)
        assert Counter(map(tuple, got.collect())) == plain_search(rows, lambda x: x % 10 == 0)


def test_large_components_are_exact(spark):
    dice = random.Random(4)
    rows = [(k, [dice.choice([1e7, 3e7, 1.7e308, -1e-3, 12345.678]) * dice.random() for _ in range(3)], k % 2) for k in range(60)]
    rows += [(60 + k, [2.0**53 + 2 * dice.randrange(9), 1.0, 0.0], k % 2) for k in range(20)]
    got = negatives.hard_negatives(frame(spark, rows), F.col("vec_id") % 5 == 0)
    assert Counter(map(tuple, got.collect())) == plain_search(rows, lambda x: x % 5 == 0)


def test_small_blocks_of_rows(spark, monkeypatch):
    monkeypatch.setattr(negatives, "CELLS", 50)
    rows = some_rows()
    got = negatives.hard_negatives(frame(spark, rows), F.col("vec_id") % 10 == 0, positives=2, negatives=3)
    assert Counter(map(tuple, got.collect())) == plain_search(rows, lambda x: x % 10 == 0, 2, 3)


def test_empty(spark):
    none = frame(spark, [])
    assert negatives.hard_negatives(none, F.lit(True)).collect() == []
    assert negatives.hard_negatives(frame(spark, [(1, [1.0], 1)]), F.lit(True)).collect() == []


def test_query_with_sql(spark, sf_dir):
    assert differences(entry.queries()["op13_hard_negatives"](spark, sf_dir), connect(sf_dir), entry.oracle_sql()["op13_hard_negatives"]) is None
