"""Operators for training data against plain versions: nulls, empty and long texts, ties, repeated rows, empty tables,
other columns."""

import hashlib
import math
import os
import random
import re
import time
import uuid
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
from pyspark.sql import functions as F

import __spark_entry__ as entry
import corpus_pipeline
from opsframe.llm import (
    bpe,
    chat_format,
    common,
    exact_dedup,
    html_text,
    mixing,
    ngram_join,
    pseudonyms,
    quality_model,
    quality_rules,
    shingles,
    toxicity,
)
from opsframe.llm.components import components
from tests.compare import connect, differences
from tests.llm import plain

SCHEMA = "doc_id BIGINT, text STRING, lang STRING, source STRING, n_chars BIGINT, fp STRING, size STRING, `n` INT"
RANKS = bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))


def prose(seed, n):
    dice = random.Random(seed)
    return " ".join("".join(dice.choice("aeiou") + dice.choice("nrstlé") for _ in range(dice.randint(1, 4))) for _ in range(n))


def edited(text, seed, n):
    own, dice = text.split(" "), random.Random(seed)
    for _ in range(n):
        own[dice.randrange(len(own))] = f"x{dice.randrange(10**9)}"
    return " ".join(own)


ODD = [None, "", " \t\n\x0b ", "one", "A b c d", "a B C D", "a b c d e", "é" * 5, "x " * 30_000, "y" * 200_000]


def frame(spark, rows):
    """Rows (doc_id, text) with the columns of documents and some whose names operators use themselves."""
    return spark.createDataFrame([(d, t, "en", f"s{(d or 0) % 3}", None, "fp", "size", 1) for d, t in rows], SCHEMA)


@pytest.fixture(scope="module")
def rows():
    texts = [*ODD, *(prose(k, 80) for k in range(20))]
    texts += [edited(texts[12], k, k % 4) for k in range(60)] + [texts[13]] * 30
    texts += [prose(99, 60) + " " + prose(k, 12) for k in range(100, 115)]
    return list(enumerate(texts))


def thue_morse(n, letters="ab"):
    return "".join(letters[k.bit_count() % 2] for k in range(n))


@pytest.mark.parametrize("n", [64, 1_024, 2_048, 8_192])
def test_words_on_which_polynomials_collide(spark, n):
    one, other = thue_morse(n), thue_morse(n, "ba")
    assert list(shingles.sets(pa.array([one])))[0] != list(shingles.sets(pa.array([other])))[0]
    docs = frame(spark, [(1, one), (2, other), (3, one.upper()), (4, f"{one} {other}"), (5, f"{other} {one}")])
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.similar_documents(docs).collect()}
    assert got == {1: (1, 1), 2: (1, 2), 3: (1, 1), 4: (1, 4), 5: (1, 5)}
    lines = [f"{one}\n{other}\n{one}", f"{one} a b c d {other} a b c d", f"x {one} a b c d x {one} a b c d"]
    rows = quality_rules.cascade(frame(spark, list(enumerate(lines)))).orderBy("doc_id").collect()
    assert [(r.n_dup_lines, r.n_repeat_words) for r in rows] == [plain.measures(x)[3:] for x in lines] == [(1, 0), (0, 0), (0, 12)]


def test_long_words_hash_alike_wherever_pieces_end(monkeypatch):
    texts = pa.array(["a " + "xy" * 3_000 + " b c d e", "xy" * 3_000 + " b", None, "b c"])
    want = shingles.words(texts)[0]
    monkeypatch.setattr(shingles, "PIECE", 100)
    got = shingles.words(texts)[0]
    assert (got == want).all() and want[1] == want[6] and want[2] == want[7]


def test_queries_with_sql(spark, sf_dir):
    con = connect(sf_dir)
    for name in ("op4_chat_format", "op7_exact_dedup"):
        assert differences(entry.queries()[name](spark, sf_dir), con, entry.oracle_sql()[name]) is None


def test_exact_dedup(spark, rows):
    groups = plain.duplicates(rows)
    for options in ({}, {"capacity": 2}):
        got = {r.doc_id: r for r in exact_dedup.exact_duplicates(frame(spark, rows), **options).collect()}
        for d, t in rows:
            own = groups[t or ""]
            digest = hashlib.sha256((t or "").encode()).hexdigest()
            assert tuple(got[d]) == (d, max(own), len(own), d == max(own), digest)


def test_exact_dedup_compares_bytes_where_fingerprints_collide(spark, rows):
    few = lambda text: F.pmod(F.length(text), F.lit(3)).cast("bigint")
    df = frame(spark, rows)
    good = exact_dedup.exact_duplicates(df).collect()
    assert sorted(map(tuple, exact_dedup.exact_duplicates(df, fp=few).collect())) == sorted(map(tuple, good))
    index, places, depth = exact_dedup.build_index(df, 4, few)
    chains = {}
    for r in index.collect():
        chains.setdefault((r.bucket, r.fp), []).append((r.chain, r.text))
    texts = {t or "" for _, t in rows}
    assert sorted(text for chain in chains.values() for _, text in chain) == sorted(texts)
    assert all(sorted(n for n, _ in chain) == list(range(1, len(chain) + 1)) for chain in chains.values())


def test_exact_dedup_splits_overfull_buckets(spark):
    heads = spark.range(4000).select(F.xxhash64("id").alias("fp"))
    held = exact_dedup.directory(heads, capacity=100, max_depth=10)
    filled = heads.withColumn("cell", F.shiftrightunsigned("fp", 54)).join(held, "cell").groupBy("bucket", "depth").count()
    found = filled.collect()
    assert sum(r["count"] for r in found) == 4000 and max(r["count"] for r in found) <= 100 and len(found) > 40
    assert [exact_dedup.bits(n, 100) for n in (0, 1, 100, 101, 4000, 10**12)] == [1, 1, 4, 5, 10, exact_dedup.MAX_BITS]


def test_deduplicate_keeps_one_row(spark):
    rows = [(1, "a"), (1, "a"), (2, "a"), (2, "a"), (None, "b"), (None, "b"), (3, None), (4, ""), (2, "c")]
    df = frame(spark, rows).withColumnsRenamed({"fp": "bucket", "size": "row"})  # names that the operator uses itself
    few = lambda text: F.lit(7).cast("bigint")
    for got in (exact_dedup.deduplicate(df), exact_dedup.deduplicate(df, fp=few)):
        assert got.columns == df.columns
        assert sorted((str(r.doc_id), str(r.text)) for r in got.collect()) == [("2", "a"), ("2", "c"), ("4", ""), ("None", "b")]


def test_components(spark):
    dice = random.Random(3)
    links = [(dice.randrange(300), dice.randrange(300)) for _ in range(220)] + [(k, k + 1) for k in range(400, 440)]
    parent = list(range(500))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    got = {r.node: r.root for r in components(spark.createDataFrame(links, "u bigint, v bigint")).collect()}
    assert got == {k: find(k) for k in range(500) if find(k) != k}


def test_ngram_join(spark, rows, monkeypatch):
    want = plain.similar(rows)
    assert {tuple(r) for r in ngram_join.similar_documents(frame(spark, rows)).collect()} == {(d, *v) for d, v in want.items()}
    kept = ngram_join.one_of_each(frame(spark, rows))
    assert kept.columns == frame(spark, rows[:1]).columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(d for d, (_, c) in want.items() if d == c)


def test_ngram_join_of_chained_families(spark):
    base = prose(7, 120)
    own = [(k, edited(base, k, k % 9)) for k in range(60)]
    own += [(100 + k, edited(prose(8, 30), k, 1)) for k in range(40)]
    for percent in (60, 80, 95):
        want = {(d, *v) for d, v in plain.similar(own, percent).items()}
        assert {tuple(r) for r in ngram_join.similar_documents(frame(spark, own), percent).collect()} == want


@pytest.mark.parametrize("percent", [60, 80, 95])
def test_ngram_join_needs_no_more_than_any_size(spark, percent):
    least = lambda n: (percent * n + 99) // 100
    both = lambda n, m: (percent * (n + m) + 99 + percent) // (100 + percent)
    cases, want = [], []
    for n in range(1, 61):
        for low in range(least(n), 100 * n // percent + 1):
            for high in range(low, 100 * n // percent + 1):
                sizes = range(low, high + 1)
                mine = min(both(n, m) - least(n) + 1 for m in sizes)
                theirs = min(both(n, m) - least(m) + 1 for m in sizes)
                cases += [(n, low, high, 0, 1, 1), (n, low, high, 2, 1, 1), (n, low, high, 1, 0, 2)]
                want += [max(1, mine), max(1, theirs), max(1, min(mine, theirs))]
    rows = [(k, *c) for k, c in enumerate(cases)]
    df = spark.createDataFrame(rows, "k INT, n BIGINT, low BIGINT, high BIGINT, last BIGINT, first BIGINT, final BIGINT")
    got = df.select("k", ngram_join.needed("n", "last", "low", "high", "first", "final", percent)).collect()
    assert [x for _, x in sorted(map(tuple, got))] == want


def test_ngram_join_of_sets_that_only_link_with_the_smaller_member(spark):
    own = []
    for k in range(300):
        a = prose(5000 + k, 33)  # 29 shingles; with one and seven words more, 30 and 36
        own += [(3 * k, f"{a} b{k}"), (3 * k + 1, a), (3 * k + 2, f"{a} {' '.join(f'c{k}x{i}' for i in range(7))}")]
    want = {(3 * k + i, n, 3 * k) for k in range(300) for i, n in enumerate((30, 29, 36))}
    assert {tuple(r) for r in ngram_join.similar_documents(frame(spark, own)).collect()} == want


def test_ngram_join_meets_groups_of_fitting_sizes_only(spark):
    rng, sets = random.Random(11), {}
    for k in range(60):
        base = rng.sample(range(1000, 10**6), rng.randrange(8, 90))
        base += rng.sample(range(40), 6)  # a few tokens that sets of all sizes share, at the head of the order
        for i in range(3):
            gone = set(rng.sample(base, len(base) * i // 10))
            sets[3 * k + i] = sorted(set(base) - gone) + [10**6 + 10 * k + i]
    hub = {r: r - r % 3 if r % 2 else r for r in sets}
    band = {r: int(math.log(len(s)) / math.log(1.1)) for r, s in sets.items()}
    rows = [
        (token, r, place, len(s), hub[r], band[r], False)
        for r, s in sets.items()
        for place, token in enumerate(s[: len(s) - (80 * len(s) + 99) // 100 + 1])
    ]
    schema = "token BIGINT, rep BIGINT, place BIGINT, n BIGINT, hub BIGINT, band BIGINT, tied BOOLEAN"
    got = {(r.rep, r.met_hub, r.met_band) for r in ngram_join.overlaps(spark.createDataFrame(rows, schema), 80).collect()}
    fit = lambda a, b: 80 * len(sets[a]) <= 100 * len(sets[b]) and 80 * len(sets[b]) <= 100 * len(sets[a])
    near = {(a, hub[b], band[b]) for a in sets for b in sets if a != b and fit(a, b)}
    assert got <= near
    links = 0
    for a in sets:
        for b in range(a + 1, max(sets) + 1):
            if 100 * len({*sets[a]} & {*sets[b]}) >= 80 * len({*sets[a], *sets[b]}):
                links += 1
                assert (a, hub[b], band[b]) in got or (b, hub[a], band[a]) in got
    assert links == 60


def test_ngram_join_of_a_passage_in_texts_of_all_sizes(spark):
    passage = prose(77, 9)
    own = [(k, f"{passage} {prose(9000 + k, 4 + 5 * (k // 3))}") for k in range(0, 90, 3)]
    own += [(d + 1, f"{text} {prose(9500 + d, 1 + d // 10)}") for d, text in own]
    want = {(d, *v) for d, v in plain.similar(own).items()}
    assert {tuple(r) for r in ngram_join.similar_documents(frame(spark, own)).collect()} == want


def test_ngram_join_without_ids(spark):
    got = ngram_join.similar_documents(frame(spark, [(None, "a b"), (5, "a b"), (None, "c"), (None, None)])).collect()
    assert Counter(tuple(r) for r in got) == {(None, 1, 5): 1, (5, 1, 5): 1, (None, 1, None): 1, (None, 0, None): 1}


def test_mixing(spark, rows):
    own = [(d, t) for d, t in rows if t is None or len(t) < 10_000] + [(1000 + k, prose(k, 50 + k)) for k in range(120)]
    df = frame(spark, own).withColumn("source", F.when(F.col("doc_id") % 4 == 3, None).otherwise(F.col("source")))
    got = mixing.taken(df).collect()
    assert len(got) == len(own)
    sizes, taken = Counter(), Counter()
    for r in got:
        sizes[r.source] += r.size
        taken[r.source] += r.taken
        assert 0 <= r.taken <= 2 * r.size
    texts = dict(own)
    assert all(r.size == len(plain.words(texts[r.doc_id])) and r.source_size == sizes[r.source] for r in got)
    want = plain.targets(sizes)
    assert all(r.target == pytest.approx(want[r.source]) for r in got)
    assert all(taken[s] == pytest.approx(want[s], rel=0.03) for s in want)
    assert sorted(map(str, mixing.taken(df.repartition(5)).collect())) == sorted(map(str, got))
    copies = Counter(r.doc_id for r in mixing.mix(df).select("doc_id").collect())
    assert copies == {r.doc_id: int(r.taken / r.size + 0.5) for r in got if r.size and r.taken / r.size >= 0.5}


def test_apportion_is_highest_quotients(spark):
    dice = random.Random(5)
    for n, seats in ((3, 10), (7, 5), (9, 200), (1, 4), (4, 0)):
        votes = {f"k{k}": dice.randrange(1, 1000) for k in range(n)} | {"none": 0}
        df = spark.createDataFrame([(1, k, v, seats) for k, v in votes.items()], "g int, k string, v bigint, seats bigint")
        got = {r.k: r.won for r in mixing.apportion(df, ["g"], [F.col("k")], "v", "seats").collect()}
        assert got == plain.seats(votes, seats)


def test_quality_rules(spark, rows):
    got = {r.doc_id: r for r in quality_rules.cascade(frame(spark, rows)).collect()}
    assert len(got) == len(rows)
    for d, t in rows:
        n, chars, symbols, dup, repeated = plain.measures(t)
        r = got[d]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (n, chars, symbols, dup, repeated)
        assert r.base_failed == (n < 10 or 100 * repeated > 20 * n)
        assert not (r.base_failed and r.kept) and (r.kept or r.rejected_by)
    text = "a # $\n* b %\na # $\n" + prose(1, 20) + "\n\n\n \n| < >"
    r = quality_rules.cascade(frame(spark, [(1, text)])).first()
    assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == plain.measures(text)


BAD = {
    "symbols": "a # word * here % and $ more & of | them < and > so on",
    "short words": "a b c d e f g h i j k l m n o p",
    "long words": " ".join(f"{'lengthyword' * 2}{k}" for k in range(20)),
    "repeated lines": "\n".join(["one line"] * 6 + [f"word{k} of text{k}" for k in range(2)]),
    "bullets": "\n".join(f"{mark} point{k} here" for k, mark in enumerate("-*•- ".replace(" ", "-"))),
    "lines cut off": "\n".join(f"text{k} goes on{end}" for k, end in enumerate(["...", "… ", "...", "…", "..."])),
    "few different words": " ".join(f"w{k % 3}x{k % 5}" for k in (0, 0, 1, 0, 2, 2, 1, 1, 0, 1) * 50),
    "one kind of character": " ".join("a" * (30 + k) for k in range(12)),
    "compresses too well": " ".join(("ab" * 300 + str(k)) for k in range(12)),
}


def test_rules_against_plain_ones(spark, rows):
    texts = [t for _, t in rows] + list(BAD.values()) + [prose(5, 40) + "...", "- " + prose(6, 40), "…\n" * 5, prose(7, 300)]
    df = frame(spark, list(enumerate(texts)))
    order = [rule.name for rule in quality_rules.RULES]
    got = {r.doc_id: r for r in quality_rules.cascade(df, quality_rules.RULES).collect()}
    for k, text in enumerate(texts):
        broken = plain.broken_rules(text)
        r = got[k]
        assert r.kept == (not r.base_failed and not broken), text[:60]
        if not r.base_failed:
            first = next((name for name in order if name in broken), None)
            assert r.rejected_by == first
            assert r.rules_run == (order.index(first) + 1 if first else len(order))  # and none behind it
        else:
            assert r.rules_run == 0
    assert all(name in plain.broken_rules(text) for name, text in BAD.items())
    total = quality_rules.saved(quality_rules.cascade(df, quality_rules.RULES)).first()
    assert total.asked == sum(r.rules_run for r in got.values()) and total.saved == len(order) * len(texts) - total.asked


def test_rule_order_does_not_change_verdicts(spark, rows):
    df = frame(spark, rows + [(1_000 + k, text) for k, text in enumerate(BAD.values())])
    orders = [quality_rules.RULES, quality_rules.RULES[::-1], quality_rules.order_rules(df, sample_rows=30)]
    verdicts = [sorted((r.doc_id, r.kept) for r in quality_rules.cascade(df, order).collect()) for order in orders]
    assert verdicts[0] == verdicts[1] == verdicts[2]


def test_quality_model(spark, sf_dir):
    docs, labels = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    got = {r.doc_id: r for r in quality_model.posterior(docs, labels).collect()}
    marks = labels.collect()
    right = np.mean([got[m.doc_id].kept == (m.quality == 1) for m in marks])
    assert len(got) == docs.count() and right > 0.9
    kept = quality_model.keep_good(docs, labels)
    assert kept.columns == docs.columns and kept.count() == sum(r.kept for r in got.values())


def sites(spark, n=600):
    """Documents of sites of very different sizes and kinds, some without host or path; a third has no label."""
    dice, own, marks = random.Random(3), [], []
    for k in range(n):
        host = None if k % 50 == 0 else "hot" if k % 3 == 0 else f"h{int(dice.paretovariate(0.6)) % 60}"
        path = None if k % 41 == 0 else dice.choice("ab")
        good = dice.random() < {"hot": 0.9, None: 0.5}.get(host, 0.2 if hash_of(host) % 2 else 0.95)
        own.append((k, prose(k, 60) if good != (dice.random() < 0.1) else "BUY | NOW !!! " * 12, path, host))
        if k % 3:
            marks.append((k, int(good)))
    return spark.createDataFrame(own, "doc_id long, text string, lang string, source string"), marks


def hash_of(text):
    return int(hashlib.sha256(str(text).encode()).hexdigest()[:4], 16)


@pytest.mark.parametrize("hot", [1, 8, 1_024])
def test_quality_model_shrinks_sparse_sites(spark, monkeypatch, hot):
    """Against a plain version: sums by host and path without the document itself, whichever groups are broadcast."""
    monkeypatch.setattr(quality_model, "HOT", hot)
    docs, marks = sites(spark)
    labels = spark.createDataFrame(marks, "doc_id long, quality int")
    got = {r.doc_id: r for r in quality_model.posterior(docs, labels).collect()}
    prior, known = quality_model.fit(docs, labels).prior, dict(marks)
    listed = docs.collect()
    own = [(r.source, r.lang, known.get(r.doc_id, 1 / (1 + np.exp(-got[r.doc_id].evidence - prior)))) for r in listed]
    assert len(got) == len(listed)
    for r, (host_share, path_share) in zip(listed, plain.shares(own), strict=True):
        x = got[r.doc_id]
        assert (x.host_share, x.path_share) == (pytest.approx(host_share), pytest.approx(path_share))
        assert x.score == pytest.approx(1 / (1 + np.exp(-x.evidence) * (1 - path_share) / path_share))
        assert x.kept == (x.score >= 0.5)


def test_a_label_is_left_out_of_the_shares_that_score_it(spark):
    """Equal texts, so labels are all that differ: of a site's two documents each is scored by the other's label."""
    docs = spark.createDataFrame([(k, "same words", "p", f"h{k // 2}") for k in range(40)], "doc_id long, text string, lang string, source string")
    marks = [(k, int((k // 2) % 2 == 0 if k > 1 else k)) for k in range(40)]
    got = {r.doc_id: r for r in quality_model.posterior(docs, spark.createDataFrame(marks, "doc_id long, quality int")).collect()}
    assert got[0].path_share > 0.5 > got[1].path_share  # 0 is bad and 1 good, on one site
    assert all((got[k].path_share > 0.5) == (k // 2 % 2 == 0) for k in range(2, 40))


def test_quality_model_on_held_out_labels(spark):
    """What was not learnt from is judged right, bad documents are found, and good ones are kept."""
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    held = toxicity.held_out(F.col("doc_id"))
    got = {r.doc_id: r.kept for r in quality_model.posterior(docs, labels.filter(~held)).collect()}
    marks = labels.filter(held).collect()
    bad, good = [m for m in marks if m.quality == 0], [m for m in marks if m.quality == 1]
    assert len(bad) > 5 and len(good) > 30
    assert np.mean([not got[m.doc_id] for m in bad]) >= 0.7
    assert np.mean([got[m.doc_id] for m in good]) >= 0.9


def test_fits_are_bounded_where_ids_repeat(spark):
    """One labelled id has most rows; the bound counts rows, and the result is there."""
    own = [(1, prose(1, 30))] * 500 + [(k, prose(k, 30) + (" vile" if k % 2 else "")) for k in range(2, 40)]
    labels = spark.createDataFrame([(k, k % 2, k % 2) for k in range(1, 40)], "doc_id long, quality int, toxic int")
    docs = frame(spark, own)
    assert quality_model.posterior(docs, labels, fit_rows=45).count() == len(own)
    assert toxicity.toxicity(docs, labels, fit_rows=45).count() == len(own)


def test_models_without_usable_labels(spark, rows):
    none = spark.createDataFrame([], "doc_id BIGINT, quality INT, toxic INT")
    odd = spark.createDataFrame([(None, 1, 1), (1, None, None), (10**6, 1, 1)], none.schema)
    for labels in (none, odd):
        assert {r.kept for r in quality_model.posterior(frame(spark, rows), labels).collect()} == {True}
        assert {r.score for r in toxicity.toxicity(frame(spark, rows), labels).collect()} == {0.5}


def test_toxicity(spark):
    bad = ["vile", "rotten", "scoundrel"]
    own = [(k, prose(k, 40) + (f" {bad[k % 3]} " + prose(k + 5000, 5) if k % 4 == 0 else "")) for k in range(600)]
    labels = spark.createDataFrame([(k, 1, int(k % 4 == 0)) for k in range(600)], "doc_id BIGINT, quality INT, toxic INT")
    got = toxicity.toxicity(frame(spark, own + [(10**6, None), (10**6 + 1, "")]), labels).collect()
    seen = {r.doc_id: r for r in got}
    assert seen[10**6].score == seen[10**6 + 1].score and 0 <= seen[10**6].score <= 1
    out = [r for r in got if r.held_out and r.doc_id < 600]
    assert len(out) > 60 and np.mean([r.predicted == (r.doc_id % 4 == 0) for r in out]) > 0.95
    assert all(r.held_out == (crc(r.doc_id) % 5 == 0) for r in got)


def crc(doc_id):
    import zlib

    return zlib.crc32(str(doc_id).encode())


def test_bpe(spark, rows):
    ref = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=RANKS, special_tokens={})
    own = rows + [(10**6, "<|endoftext|> 漢字🙂 don't  \n\n 12345 ﬁ")]
    got = {r.doc_id: r for r in bpe.encode(frame(spark, own), RANKS, public_tokenizers.PATTERN).collect()}
    for d, t in own:
        assert np.frombuffer(bytes(got[d].ids), "<u4").tolist() == ref.encode_ordinary(t or "")
        assert bytes(got[d].decoded) == (t or "").encode()
    r = bpe.digests(frame(spark, own[-1:]), RANKS, public_tokenizers.PATTERN).first()
    assert r.n_tokens == len(ref.encode_ordinary(own[-1][1]))


def test_bpe_appends_and_edits():
    ref = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=RANKS, special_tokens={})
    tokenizer = bpe.Tokenizer(bpe.Vocabulary(RANKS), public_tokenizers.PATTERN)
    dice = random.Random(2)
    for _ in range(300):
        text = "".join(dice.choice("ab  \n'stéß漢🙂01.,<|>") for _ in range(40))
        whole = bpe.Encoded(tokenizer, text)
        a = dice.randrange(41)
        whole.replace(a, min(40, a + dice.randrange(4)), dice.choice(["", "x", " ", "'s", "\n\n", "é1"]))
        assert whole.ids() == ref.encode_ordinary(whole.text)
        word = "".join(dice.choice("abcdest") for _ in range(12)).encode()
        table = bpe.Prefixes(tokenizer.vocabulary, word[:5])
        table.append(word[5:])
        for length in range(1, 13):
            assert table.ids(length) == bpe.Prefixes(tokenizer.vocabulary, word[:length]).ids()
        table.cut(3)
        assert table.ids() == bpe.Prefixes(tokenizer.vocabulary, word[:3]).ids()


PAGE = """<html><head><title>t</title></head><body><nav><a>Home</a></nav><div class="cookie-banner">ok?</div>
<header>Site</header>{body}<aside>side</aside><form>f<input value="x"></form><script>var a="<p>no</p>"</script>
<div id="comments"><p>nice</p></div><footer>&copy; me</footer></body></html>"""


def test_html_text(spark):
    body = "<article><h1>A &amp; B</h1>\n<p>one <b>two</b>three<br>four<div class=ad>buy</div><!-- x --><p>five</article>"
    pages = [(1, "http://a.b/x", PAGE.format(body=body)), (2, None, None), (3, "http://a.b/y", ""), (4, "u", "plain  text <p>x")]
    df = spark.createDataFrame(pages, "page_id BIGINT, url STRING, html STRING")
    got = {r.page_id: (r.url, r.text, r.n_chars) for r in html_text.main_text(df).collect()}
    assert got[1] == ("http://a.b/x", "A & B one twothree four five", 28)
    assert got[2] == (None, "", 0) and got[3][1:] == ("", 0) and got[4][1] == "plain text x"


def test_html_names_of_wrappers():
    text = "All that is said on this page is here."
    for wrapper in (
        '<body class="post no-sidebar"><p>{}</p></body>', '<body class="sidebar"><p>{}</p></body>', '<div id="content" class="has-comments">{}</div>',
        '<div class="entry ad-free">{}</div>', '<div class="text share-enabled">{}</div>', '<div class="promo">{}</div>',
        '<main><article class="related"><div class="ad-free">{}</div></article></main>', '<article><div class="share">{}</div></article>',
    ):
        page = "<html class='menu'>" + wrapper.format(text) + "<div class='ad'>Buy</div><div class='cookie-notice'>We</div></html>"
        assert [x for _, x in html_text.blocks(page)] == [text], wrapper
    left_out = '<div class="x comments">a</div><p id="sidebar-left">b</p><i class=ad>c</i><div role="navigation">d</div>'
    assert html_text.blocks(f"<div>{text}</div>{left_out}") == [(False, text)]
    assert html_text.blocks(f"<article>{text}{left_out}</article>{left_out}<div class=comments>{text * 9}</div>") == [(True, text)]


def test_html_differences(spark, monkeypatch):
    open_page = "<body><div>Shop of things</div><div>{0}</div><div>Call us now</div></body>"
    pages = [(k, f"http://h.c/n/{k}", open_page.format(prose(k, 30))) for k in range(4)]
    df = spark.createDataFrame(pages, "page_id BIGINT, url STRING, html STRING").coalesce(1)
    got = {r.page_id: r.text for r in html_text.main_text(df).collect()}
    assert got == {k: prose(k, 30) for k in range(4)}
    a, b = list("xaybzbc"), list("abcbq")
    assert "".join(a[k] for k in sorted(html_text.shared_lines(a, b))) in ("abbc"[:3], "abc", "abb")
    dice = random.Random(1)
    for _ in range(200):
        a, b = ([dice.choice("abcd") for _ in range(dice.randrange(9))] for _ in range(2))
        best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                best[i + 1][j + 1] = best[i][j] + 1 if x == y else max(best[i][j + 1], best[i + 1][j])
        for direct in (2_048, 2):
            monkeypatch.setattr(html_text, "DIRECT", direct)
            found = html_text.shared_lines(a, b)
            rest = iter(b)
            assert len(found) == best[-1][-1] and all(a[k] in rest for k in sorted(found))


def test_html_differences_with_marked_neighbours(spark):
    frame_of = "<body><nav>Shop of things</nav><aside>We use what you give</aside>{}<p>{}</p><footer>All rights</footer></body>"
    plain_frame = "<body><div>Shop of things</div><div>We use what you give</div>{}<div>Call us now</div><div>All rights</div></body>"
    quote = prose(70, 9)
    pages = [(k, f"http://h.c/n/{k}", frame_of.format(f"<article><p>{prose(k, 30)}<p>Call us now<p>{quote}</article>", "" if k == 4 else "Call us now")) for k in range(5)]
    # Short text in a large frame, without marks.
    pages[2] = (2, "http://h.c/n/2", plain_frame.format("<p>Short news"))
    df = spark.createDataFrame(pages, "page_id BIGINT, url STRING, html STRING").coalesce(1)
    got = {r.page_id: r.text for r in html_text.main_text(df).collect()}
    assert got[2] == "Short news"
    # Page 4 has a line only within its article that is frame next door; page 0 has it in its own frame too.
    assert got[4] == f"{prose(4, 30)} {quote}" and got[0] == f"{prose(0, 30)} Call us now {quote}"
    # A neighbour's teaser of an article is no frame, nor a link to it.
    title, text = prose(80, 5), prose(81, 40)
    page = html_text.marked(f"<article><h1>{title}</h1><p>{text}</article>")
    other = html_text.marked(f"<article>{prose(82, 9)}</article><aside><a href=x>{title}</a></aside><div>{text}</div>")
    assert html_text.article(page, [other]) == [title, text]


# What is left out and what stays, in pages of all kinds; TEXT is what has to come out.
TEXT = "All that is said on this page is here."
WHOLE_PAGES = [
    ("<article><p>{}</p></article><article class='comment'>Nice one</article>", TEXT),
    ("<article><p>{}</p><article class=comment><p>Nice one</article></article>", TEXT),
    ("<article>{}<div class='post-comments'><p>Nice one</div></article>", TEXT),
    ("<article>{}<ol class='comment-list'><li>Nice one</ol></article>", TEXT),
    ("<div class='main-menu'>Home Shop</div><div class='site-nav'>All of it</div><div class=entry>{}</div>", TEXT),
    ("<div class='ad-container'>Buy</div><div id='related-posts'>More</div><p class='no-sidebar ad-free'>{}", TEXT),
    ("<p title=it's>{}", TEXT),
    ("<p title=\"abc>{}", TEXT),
    ("<p title='a>b' class=\"c>d\">{}<p data-x=\"it's\">", TEXT),
    ("<p title = 'a > b'>{}<br/><img alt=\"1 > 2\">", TEXT),
    ("<script>if (a < b) { '<p>no</p>' }</script><!-- <p>no</p> --><p>{}<!-- open <p>no", TEXT),
    ("<noscript><p>no</p></noscript><p>{}<script>no", TEXT),
    ("<p>1 &lt; 2 &amp;amp; 3&nbsp;> 2 <p>a<b>b</b>c\n\t d &#233;&#x41;<br>{}", "1 < 2 &amp; 3 > 2 abc d éA " + TEXT),
    ("<form>f<p>f</form><select><option>o</select><p>{}<button>b</button>", TEXT),
    ("", ""),
    ("<nav>only</nav>", ""),
    ("< p > <3 {}", "< p > <3 " + TEXT),
]


def test_html_whole_pages(spark):
    pages = [(k, f"http://host{k}/", page.replace("{}", TEXT)) for k, (page, _) in enumerate(WHOLE_PAGES)]
    df = spark.createDataFrame(pages, "page_id BIGINT, url STRING, html STRING")
    got = {r.page_id: r.text for r in html_text.main_text(df).collect()}
    for k, (page, want) in enumerate(WHOLE_PAGES):
        assert got[k] == want, page


def test_html_of_unclosed_elements_takes_linear_time():
    page = "<div class=ad>x" * 40_000 + "</section>" * 40_000 + "<p>" * 40_000 + TEXT
    start = time.perf_counter()
    found = html_text.marked(page)
    assert len(found) == 40_001 and time.perf_counter() - start < 20


def plain_texts(rows):
    """The texts of (page_id, url, html) rows, all pages sorted in one list."""
    pages = []
    for page_id, url, page in rows:
        scheme = re.match(r"[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)", url or "")
        host = None if url is None else scheme[1].lower() if scheme else ""
        path = re.match(r"[^?#]*", (url or "")[scheme.end() if scheme else 0 :])[0]
        lines = html_text.marked(page or "")
        content = html_text.line_hash("\n".join(x for _, x in lines)) if lines else 0
        pages.append((host is not None, host or "", path, url or "", page_id is not None, page_id or 0, content, lines))
    pages.sort(key=lambda x: x[:7])
    by_host = {}
    for page in pages:
        lines = page[7]
        if not any(state & 3 == html_text.ARTICLE for state, _ in lines):
            own = frozenset(x for state, x in lines if state & 3 == html_text.OPEN)
            by_host.setdefault(page[:2], set()).add(own)
    frame = {}
    for host, different in by_host.items():
        counts = Counter(x for own in different for x in own)
        n = len([own for own in different if own])
        frame[host] = {html_text.line_hash(x) for x, k in counts.items() if k >= 3 and 4 * k >= n}
    out = Counter()
    for k, page in enumerate(pages):
        near = [pages[j][7] for j in (k - 1, k + 1) if 0 <= j < len(pages) and pages[j][:2] == page[:2]]
        out[page[5], page[3], " ".join(html_text.article(page[7], near, frozenset(frame.get(page[:2], ()))))] += 1
    return out


def test_html_does_not_depend_on_partitions(spark):
    dice = random.Random(12)
    bare = "<body><div>Shop of {h}</div><p>We use what you give</p>{t}<div>Call us now</div><div>All rights of {h}</div></body>"
    named = "<body><nav>Shop</nav><article>{t}<p>Call us now</article><p>Call us now</p></body>"
    rows = []
    for k in range(150):
        host = dice.choice(["a.b", "a.b", "a.b", *(f"h{n}.c" for n in range(20))])
        text = "".join(f"<p>{prose(dice.randrange(60), 6)}</p>" for _ in range(dice.randrange(4)))
        layout = named if dice.random() < 0.3 else bare
        rows.append((k, f"http://{host}/{dice.choice('xyz')}/{dice.randrange(60)}?q={dice.randrange(3)}", layout.format(h=host, t=text)))
    rows += [rows[3], rows[3], rows[4], (4, rows[4][1], "<p>another text of the same page</p>")]
    rows += [(900 + k, f"http://copies.d/{k}", bare.format(h="d", t=f"<p>{prose(77, 50)}</p>")) for k in range(12)]
    rows += [(None, None, "<p>no url"), (None, None, "<p>no url"), (999, "no host", "x"), (998, "", "y"), (997, "http://a.b/x/0?q=1", None)]
    want = plain_texts(rows)
    old = {key: spark.conf.get(key) for key in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.enabled")}
    try:
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        for n in (1, 7, 61):
            spark.conf.set("spark.sql.shuffle.partitions", str(n))
            df = spark.createDataFrame([(*row, "h", "p") for row in rows], "page_id BIGINT, url STRING, html STRING, host STRING, place STRING")
            got = Counter((r.page_id or 0, r.url or "", r.text) for r in html_text.main_text(df).collect())
            assert got == want, n
    finally:
        for key, value in old.items():
            spark.conf.set(key, value)
    # The frame goes from short texts too, and copies of one article keep it.
    short = [x[2] for x in want if x[1].startswith("http://a.b/")]
    assert not any("All rights" in x or "Shop of" in x for x in short)
    assert sum(prose(77, 50) in x[2] for x in want) == 12


LAYOUTS = {
    '{"prompt": "p", "response": "r"}': [("user", "p"), ("assistant", "r")],
    '{"completion": "r", "prompt": "p"}': [("user", "p"), ("assistant", "r")],
    '{"output": "o", "instruction": "i"}': [("user", "i"), ("assistant", "o")],
    '{"instruction": "i", "input": "x", "output": null}': [("user", "i\n\nx"), ("assistant", "")],
    '{"messages": [{"role": "system", "content": "s"}, {"content": null, "role": "user"}]}': [("system", "s"), ("user", "")],
    '{"conversations": [{"from": "human", "value": "a"}, {"from": "gpt", "value": "b"}]}': [("user", "a"), ("assistant", "b")],
    '{"id": 7, "text": "t", "role": "user", "meta": {"a": [1, {"b": null}]}}': [("user", "t")],
    '{"content": "t", "role": null, "score": 0.5}': [("", "t")],
    '{"message": {"content": "t", "role": "user", "name": "n"}}': [("user", "t")],
    '{"system": "s", "prompt": "p", "response": "r"}': [("user", "p"), ("assistant", "r")],
    '{"messages": [{"role": "user", "content": "u", "name": "n", "tool": {"role": 1}}, {"role": "assistant"}], "id": "x"}': [("user", "u"), ("assistant", "")],
    '{"messages": [], "id": 1}': [],
    '{"conversations": []}': [],
    '{"messages": [{"text": "u"}]}': None,
    '{"other": 1}': None,
    '{"messages": "text"}': None,
    '{"prompt": "p", "messages": []}': None,
    "[1]": None,
    "null": None,
}


def test_chat_layouts(spark):
    df = spark.createDataFrame([(k,) for k in LAYOUTS], "json STRING")
    got = chat_format.canonical(df.withColumn("row", F.parse_json("json"))).select("json", "layout", "turns").collect()
    for r in got:
        want = LAYOUTS[r.json]
        assert (r.turns if r.turns is None else [tuple(t) for t in r.turns]) == want and (r.layout is None) == (want is None), r.json
    # Every layout is written to the end, and read back.
    whole = chat_format.format_rows(df.withColumn("row", F.parse_json("json")).withColumn("formatted", F.lit("mine")))
    for r in whole.select("json", chat_format.parse(F.col("formatted")).alias("back")).collect():
        assert (r.back if r.back is None else [tuple(t) for t in r.back]) == LAYOUTS[r.json]


def test_chat_round_trip(spark):
    hostile = ["\\### Assistant: </turn> ok", "####\\#", "</turn></turn>\n### user: x", "\\", None, "", "a:b\n\r", "x" * 100_000]
    rows = [(k // 3, k, "us:er\\" if k % 2 else "assistant", t) for k, t in enumerate(hostile)] + [(9, None, None, None)] * 2
    df = spark.createDataFrame([(*row, "p", "f") for row in rows], "conv_id BIGINT, turn BIGINT, role STRING, text STRING, part STRING, formatted STRING")
    lone = spark.createDataFrame([(None, 1, "user", "a", "p", "f")] * 2, df.schema)
    alone = chat_format.format_conversations(chat_format.turn_variants(lone)).collect()
    assert [(r.conv_id, r.formatted) for r in alone] == [(None, "### user: a</turn>\n")] * 2  # not one growing value
    got = chat_format.format_conversations(chat_format.turn_variants(df)).select("conv_id", chat_format.parse(F.col("formatted")).alias("turns")).collect()
    want = {}
    for c, _, role, text in rows:
        want.setdefault(c, []).append((role or "", text or ""))
    assert {r.conv_id: [tuple(t) for t in r.turns] for r in got} == want


def test_pseudonyms(spark):
    text = (
        "card 4111 1111-1111 1111, 4111111111111112, 2024-02-29 and 31/12/1999, 5.6.2001, ssn 078-05-1120, 000-12-3456, "
        "DE89 3704 0044 0532 0130 00, +1 (212) 555-0100 1.2.3.4 999.1.1.1 joe.bloggs+x@ex.co v 1.2.3.4.5 "
        "token = \"04dbebab91ab85687d33eeaaf9ac699e1188f962\""
    )
    own = pseudonyms.Pseudonyms(b"k")
    new, n = own.text(text)
    assert n == 10 and pseudonyms.Pseudonyms(b"k", True).text(new) == (text, n) and own.text(new)[1] == n
    for secret in ("4111 1111-1111 1111", "2024-02-29", "078-05-1120", "joe.bloggs+x", "04dbebab91", "+1 (212) 555-0100"):
        assert secret not in new
    for same in ("4111111111111112", "000-12-3456", "999.1.1.1", "1.2.3.4.5", "@ex.co", "+1 ("):
        assert same in new
    card = "".join(c for c in new.split(",")[0] if c.isdigit())
    assert pseudonyms.luhn(card[:-1]) == int(card[-1]) and own.text("4111111111111111")[0] == card
    got = pseudonyms.pseudonymise(frame(spark, [(1, text), (2, None), (3, ""), (4, "no 12 numbers")]), b"k").collect()
    assert {tuple(r) for r in got} == {(1, new, 10), (2, None, 0), (3, "", 0), (4, "no 12 numbers", 0)}


SAME = [
    ("+1 212 555 0100", "+12125550100", "(212) 555-0100", "212-555-0100", "212.555.0100", "+1 (212) 555-0100", "+1.212.555.0100"),
    ("+442071838750", "+44 20 7183 8750", "+44 (0)20 7183 8750", "+44 (20) 7183-8750"),
    ("+351 21 123 4567", "+351211234567"),
    ("Bob.Smith@x.com", "bob.smith@x.com", "BOB.SMITH@x.com"),
    ("DE89370400440532013000", "DE89 3704 0044 0532 0130 00", "de89 3704 0044 0532 0130 00", "de89370400440532013000"),
    ("4111 1111 1111 1111", "4111-1111-1111-1111", "4111111111111111"),
    ("ssn 078-05-1120", "SSN: 078 05 1120", "Social Security Number 078 05 1120"),
    ("1999-03-09", "09.03.1999", "9.3.1999", "03/09/1999", "3/9/1999", "March 9, 1999", "9 March 1999", "9. MARCH 1999", "march 09 1999"),
    ("1999-12-31", "31.12.1999", "12/31/1999", "31/12/1999", "December 31, 1999", "31 December 1999"),
]


def canonical_value(text):
    """What a written value stands for, without its format."""
    months = [x.lower() for x in pseudonyms.MONTH_NAMES]
    words = re.findall("[a-z]+", text.lower())
    if any(x in months for x in words):
        month = next(months.index(x) + 1 for x in words if x in months)
        day, year = re.findall(r"\d+", text)
        return int(year), month, int(day)
    if m := re.fullmatch(r"(\d{4})-(\d\d)-(\d\d)", text):
        return tuple(int(x) for x in m.groups())
    if m := re.fullmatch(r"(\d{1,2})([./])(\d{1,2})[./](\d{4})", text):
        first, second = int(m[1]), int(m[3])
        month_first = m[2] == "/" and first <= 12
        return (int(m[4]), first, second) if month_first else (int(m[4]), second, first)
    if "@" in text or text[:2].isalpha() and text[2].isdigit():
        return text.replace(" ", "").lower()
    digits = re.sub(r"\D", "", text.replace("(0)", ""))
    return digits.removeprefix("1") if len(digits) == 11 else digits


def test_equal_values_stay_linked():
    own, back = pseudonyms.Pseudonyms(b"k"), pseudonyms.Pseudonyms(b"k", True)
    for written in SAME:
        new = [own.text(f"a {x} b") for x in written]
        assert [n for _, n in new] == [1] * len(written), (written, new)
        assert len({canonical_value(x) for x in written}) == len({canonical_value(x[2:-2]) for x, _ in new}) == 1, new
        assert all(x[2:-2] != y and back.text(x) == (f"a {y} b", 1) for (x, _), y in zip(new, written))
    for same in ("version 1.2.3.4", "v1.2.3.4", "13/13/1999", "March 32, 1999", "078 05 1120 and more", "Marching 3, 1999"):
        assert own.text(same) == (same, 0)


def test_days_are_permuted_and_every_layout_undone():
    own, back = pseudonyms.Pseudonyms(b"k"), pseudonyms.Pseudonyms(b"k", True)
    members, places = pseudonyms._classes()
    every = sorted(places)
    assert len(every) == 73_049
    new = {day: own._day(day.year, day.month, day.day) for day in every}
    assert sorted(new.values()) == every and all(back._day(y.year, y.month, y.day) == x for x, y in list(new.items())[::7])
    dice = random.Random(2)
    layouts = ("{y}-{m:02d}-{d:02d}", "{d}.{m}.{y}", "{d:02d}.{m:02d}.{y}", "{d:02d}.{m}.{y}", "{m}/{d}/{y}", "{m:02d}/{d:02d}/{y}", "{d}/{m}/{y}", "{d:02d}/{m:02d}/{y}")
    for day in dice.sample(every, 400):
        for layout in layouts:
            text = layout.format(y=day.year, m=day.month, d=day.day)
            there, n = own.text(text)
            assert n == 1 and back.text(there) == (text, 1), (text, there)
            assert len(there) == len(text)


def test_pseudonyms_of_values_followed_by_more():
    own, back = pseudonyms.Pseudonyms(b"k"), pseudonyms.Pseudonyms(b"k", True)
    values = {"4111 1111 1111 1111": (" 12/27", " 123", "-123", " 12", " 1234", " 04/2029 123"), "3782 822463 10005": (" 1234",)}
    values |= {
        "BE68 5390 0754 7034": (" BIC", " 12", " X", " EUR 12"), "DE89 3704 0044 0532 0130 00": (" BIC",), "BE68539007547034": (" BIC",),
        "AT61 1904 3002 3457 3201": (" BIC",), "ES91 2100 0418 4502 0005 1332": (" BIC", " 2024"),
    }
    for value, tails in values.items():
        alone, n = own.text(value)
        assert n == 1 and alone != value
        for tail in tails:
            text = f"pay {value}{tail} now"
            assert own.text(text) == (f"pay {alone}{tail} now", 1)
            assert back.text(own.text(text)[0]) == (text, 1)
    card = own.text("4111 1111 1111 1111")[0]
    assert own.text("row 12 4111 1111 1111 1111") == (f"row 12 {card}", 1)
    assert own.text("4111 1111 1111 1111 4111 1111 1111 1111") == (f"{card} {card}", 2)
    assert own.text("4111 1111 1111 1112 123")[1] == 0


@pytest.mark.parametrize("size", [2, 3, 7, 10, 100, 1000, 1009])
def test_feistel_permutes(size):
    own, back = pseudonyms.Feistel(b"z"), pseudonyms.Feistel(b"z", True)
    image = [own.permute("t", v, size) for v in range(size)]
    assert sorted(image) == list(range(size)) and [back.permute("t", v, size) for v in image] == list(range(size))


def test_empty_tables(spark):
    docs = frame(spark, [])
    labels = spark.createDataFrame([], "doc_id BIGINT, quality INT, toxic INT")
    made = [
        exact_dedup.exact_duplicates(docs), exact_dedup.deduplicate(docs), ngram_join.similar_documents(docs), mixing.taken(docs),
        mixing.mix(docs), quality_rules.cascade(docs), quality_model.posterior(docs, labels), toxicity.toxicity(docs, labels),
        bpe.digests(docs, RANKS, public_tokenizers.PATTERN), pseudonyms.pseudonymise(docs, b"k"),
        html_text.main_text(spark.createDataFrame([], "page_id BIGINT, url STRING, html STRING")),
        chat_format.read_back(
            chat_format.format_conversations(
                chat_format.turn_variants(spark.createDataFrame([], "conv_id BIGINT, turn BIGINT, role STRING, text STRING"))
            )
        ),
    ]
    assert [df.count() for df in made] == [0] * len(made)


def test_pipeline(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    texts = {r.doc_id: r for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES:
        before = Counter(r.doc_id for r in docs.select("doc_id").collect())
        made = stage(spark, docs, sf_dir)
        if name == "byte-level BPE encoding and decoding":
            got = made.collect()
            assert Counter(r.doc_id for r in got) == before
            assert all(r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].text.encode()).hexdigest() for r in got)
            continue
        assert made.columns == docs.columns
        path = exact_dedup.settle(made, "stage")
        after = Counter(r.doc_id for r in path.select("doc_id").collect())
        own = [(d, texts[d].text) for d in before]
        if name == "exact dedup":
            assert after == {max(g): 1 for g in plain.duplicates(own).values()}
        elif name == "n-gram Jaccard join":
            assert after == {d: 1 for d, (_, c) in plain.similar(own).items() if d == c}
        elif name == "mixing sources to target weights":
            assert set(after) <= set(before) and max(after.values()) <= 2
        else:
            assert set(after) < set(before)
        docs = path


def test_pipeline_on_hostile_rows(spark, sf_dir, rows):
    """Nulls in every column, odd and long texts, repeated rows and ids, columns with names that operators use."""
    own = [*rows[:40], (None, "text without an id"), (None, None), (3, "one"), (3, "another text of this id"), *rows[28:31]]
    docs = frame(spark, own).withColumnsRenamed({"fp": "row", "size": "bucket"})
    docs = docs.unionByName(docs.limit(2).withColumns({"source": F.lit(None).cast("string"), "lang": F.lit(None).cast("string")}))
    stages = dict(corpus_pipeline.STAGES)
    columns, listed = docs.columns, lambda df: Counter((r.doc_id, r.text or "") for r in df.collect())
    good = exact_dedup.settle(stages["quality classifier"](spark, docs, sf_dir), "good")
    assert good.columns == columns and not listed(good) - listed(docs)
    distinct = exact_dedup.settle(stages["exact dedup"](spark, docs, sf_dir), "distinct")
    largest = {}
    for d, t in listed(docs):
        largest[t] = max(largest.get(t, -1), -1 if d is None else d)
    assert distinct.columns == columns
    assert listed(distinct) == Counter((None if d == -1 else d, t) for t, d in largest.items())
    single = exact_dedup.settle(stages["n-gram Jaccard join"](spark, distinct, sf_dir), "single")
    assert single.columns == columns and not listed(single) - listed(distinct)
    assert {"one", "text without an id"} <= {t for _, t in listed(single)}
    mix = exact_dedup.settle(stages["mixing sources to target weights"](spark, single, sf_dir), "mix")
    assert mix.columns == columns and set(listed(mix)) <= set(listed(single)) and max(listed(mix).values()) <= 2
    ids = stages["byte-level BPE encoding and decoding"](spark, mix, sf_dir).collect()
    assert Counter((r.doc_id, r.decoded_sha256) for r in ids) == Counter(
        {(d, hashlib.sha256(t.encode()).hexdigest()): n for (d, t), n in listed(mix).items()}
    )
    for name, stage in corpus_pipeline.STAGES[:-1]:
        none = stage(spark, docs.limit(0), sf_dir)
        assert none.columns == columns and none.count() == 0, name


def test_pipeline_deletes_what_stages_have_written(spark, sf_dir, monkeypatch, place):
    monkeypatch.setattr(common, "scratch", lambda spark, name: f"{place}/{name}-{uuid.uuid4().hex}")
    made = corpus_pipeline.run(spark, sf_dir)
    assert len(os.listdir(place)) == 1 and made.count() > 0


def test_pipeline_ends_in_token_ids(spark):
    own = [(k, t) for k, t in enumerate(ODD)] + [(3, "one")]
    got = corpus_pipeline.STAGES[-1][1](spark, frame(spark, own), None).collect()
    words = {rank: token for token, rank in RANKS.items()}
    for r in got:
        ids = np.frombuffer(bytes(r.ids), "<u4").tolist()
        assert len(ids) == r.n_tokens and b"".join(words[k] for k in ids).decode() == (dict(own)[r.doc_id] or "")
        assert hashlib.sha256(bytes(r.ids)).hexdigest() == r.ids_sha256
    assert Counter(r.doc_id for r in got) == Counter(d for d, _ in own)


def test_entry_without_this_part():
    names = [f"op{k}_" for k in range(1, 14)]
    found = [n for n in entry.queries() if n.startswith("op")]
    assert all(sum(n.startswith(p) for n in found if n[: len(p)] == p) >= 1 for p in names) and "pipeline" in entry.queries()
