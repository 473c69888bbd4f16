"""Quality of documents by hierarchical empirical Bayes.

Three kinds of evidence add up as log odds:

- the document: a logistic model on measures of its text, cut into ranges. It is fitted on at most ``fit_rows`` labelled
  documents, those whose ids have the smallest hashes (a documented bound; scoring covers all).
- its host: the share of good documents there. Labels count as they are, other documents with the probability that
  their text gives. The share is shrunk towards the global one, the more the fewer documents the host has; how strongly
  is estimated from how much hosts differ beyond chance (method of moments).
- its path within the host, shrunk towards its host in the same way.

Host and path shares are grouped sums of all documents; a host with a third of all rows is summed in parts by the
map tasks. The shares that score a document are those of the other documents: what it counts itself, its label too, is
left out of its path, its host and the global share. How strongly shares are shrunk is estimated from all. A document is
kept if its posterior probability of being good is at least ``least``.

Rows meet the sums of their host and path in joins. Groups with at least a ``1 / HOT`` of all documents, of which there
are no more than ``HOT``, are broadcast, so no task joins a larger part than that for one key.

Nulls: a null text is empty, null hosts and paths are groups of their own. Repeated rows count each, also in the bound
of the fit. Labels without a document, or with a null, are not used; of several labels of a document all count in the
fit. Without labels, or with one kind only, nothing can be learnt and every document is kept with probability 0.5. Empty tables give empty results.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from opsframe.llm.common import settle, ship
from opsframe.llm.measures import Measures, kind

ship("opsframe.llm.measures")
ship(__name__)

FIT_ROWS = 20_000
RANGES = 12  # ranges per measure
HOT = 1_024

_UPPER = kind(bytes(range(ord("A"), ord("Z") + 1)))
_DIGIT = kind(b"0123456789")
_MARKS = kind(b"!?.,;:")
_CRY = kind(b"!")
_BAR = kind(b"|")
_QUOTE = kind(b"\"'`=_{}[]()/\\@+~^")
_LETTER = kind(bytes([*range(65, 91), *range(97, 123), *range(0x80, 0x100)]))


def features(column: pa.Array) -> np.ndarray:
    """Measures of each text, one column each; shares lie between 0 and 1."""
    m = Measures(column)
    chars, words = np.maximum(m.n_chars, 1), np.maximum(m.n_words, 1)
    size = np.maximum(np.diff(m.offsets), 1)
    return np.column_stack(
        [
            np.log1p(m.n_words),
            m.word_chars / words,
            m.n_symbols / chars,
            m.count(_UPPER) / chars,
            m.count(_DIGIT) / chars,
            m.count(_MARKS) / chars,
            m.count(_CRY) / chars,
            m.count(_BAR) / chars,
            m.count(_QUOTE) / chars,
            m.count(_LETTER) / size,
            m.n_dup_lines / np.maximum(m.n_lines, 1),
            m.n_repeat_words / words,
            m.n_distinct_words / words / np.log(np.e + words),
            np.log1p(m.n_words / np.maximum(m.n_lines, 1)),
        ]
    )


class Model:
    """Logistic regression on ranges of the measures."""

    def __init__(self, x: np.ndarray, y: np.ndarray, rounds: int = 25, ridge: float = 1.0):
        self.cuts = [np.unique(np.quantile(c, np.linspace(0, 1, RANGES + 1)[1:-1])) for c in x.T]
        # An extreme tenth of a percent may be what tells: cut there as well.
        for k, c in enumerate(x.T):
            self.cuts[k] = np.unique(np.append(self.cuts[k], np.quantile(c, [0.01, 0.03, 0.97, 0.99])))
        z = self.ranges(x)
        self.weights = np.zeros(z.shape[1])
        penalty = np.full(z.shape[1], ridge)
        penalty[0] = 1e-6
        for _ in range(rounds):  # Newton's steps
            p = 1 / (1 + np.exp(-np.clip(z @ self.weights, -30, 30)))
            grade = z.T @ (p - y) + penalty * self.weights
            curve = (z * (p * (1 - p) + 1e-6)[:, None]).T @ z + np.diag(penalty)
            step = np.linalg.solve(curve, grade)
            self.weights -= step
            if np.abs(step).max() < 1e-4:
                break
        self.prior = float(np.log((y.sum() + 0.5) / (len(y) - y.sum() + 0.5)))

    def ranges(self, x: np.ndarray) -> np.ndarray:
        columns = [np.ones(len(x))]
        for c, cuts in zip(x.T, self.cuts, strict=True):
            place = np.searchsorted(cuts, c, "right")
            columns += [(place == k).astype(float) for k in range(len(cuts) + 1)]
        return np.column_stack(columns)

    def evidence(self, x: np.ndarray) -> np.ndarray:
        """Log odds of good that the text adds to those of all documents."""
        out = np.full(len(x), self.weights[0] - self.prior)
        at = 1
        for c, cuts in zip(x.T, self.cuts, strict=True):
            out += self.weights[at : at + len(cuts) + 1][np.searchsorted(cuts, c, "right")]
            at += len(cuts) + 1
        return np.clip(out, -15, 15)


def fit(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> Model | None:
    """The model of at most ``fit_rows`` labelled documents; None if the labels are all alike."""
    usable = labels.filter("doc_id IS NOT NULL AND quality IS NOT NULL").select("doc_id", "quality")
    sample = usable.orderBy(F.xxhash64("doc_id"), "doc_id", "quality").limit(fit_rows)
    found = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id")

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.ascontiguousarray(features(batch.column(1)))
            values = pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), x.shape[1]).cast(pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), values], ["doc_id", "quality", "x"])

    kind_ = docs.schema["doc_id"].dataType.simpleString()
    rows = found.select("doc_id", "text", F.col("quality").cast("int").alias("quality"))
    rows = rows.mapInArrow(measure, f"doc_id {kind_}, quality int, x array<double>")
    # Rows that repeat an id are bounded too: what is gathered are measures, the first ones in the sample's order.
    rows = rows.orderBy(F.xxhash64("doc_id"), "doc_id", "quality", "x").limit(fit_rows).toPandas()
    if not len(rows) or rows["quality"].nunique() < 2:
        return None
    rows = rows.sort_values(["doc_id", "quality"], kind="stable")
    return Model(np.stack(rows["x"].to_list()), (rows["quality"] > 0).to_numpy(float))


def evidence(docs: DataFrame, model: Model | None, keep: list[str]) -> DataFrame:
    """``keep`` columns and the log odds that each text adds."""
    parts = None if model is None else (model.cuts, model.weights, model.prior)
    schema = docs.select(*keep).schema.add("evidence", "double")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = None
        if parts is not None:
            own = Model.__new__(Model)
            own.cuts, own.weights, own.prior = parts
        for batch in batches:
            for at in range(0, len(batch), 2048):
                part = batch.slice(at, 2048)
                text = part.column(part.num_columns - 1)
                value = np.zeros(len(part)) if own is None else own.evidence(features(text))
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(value)], [*keep, "evidence"])

    return docs.select(*keep, F.col("text").alias("__text")).mapInArrow(run, schema)


def _shrunk(good: Column, n: Column, above: Column, strength: float) -> Column:
    """Posterior share of ``good`` of ``n`` with the share ``above`` as the prior's mean and ``strength`` its weight."""
    return (good + F.lit(strength) * above) / (n + F.lit(strength))


def _beside(rows: DataFrame, groups: DataFrame, keys: list[str], n: str, total: int) -> DataFrame:
    """``rows`` with the columns of their group, of which ``n`` counts its documents among ``total``. Null keys are equal."""
    named = groups.withColumnsRenamed({key: f"of_{key}" for key in keys})
    same = F.lit(True)
    for key in keys:
        same = same & F.col(key).eqNullSafe(F.col(f"of_{key}"))
    frequent = F.col(n) * HOT >= total
    hot = F.broadcast(named.filter(frequent))  # at most HOT rows
    others = rows.join(hot, same, "left_anti").join(named.filter(~frequent), same)
    return rows.join(hot, same).unionByName(others).drop(*[f"of_{key}" for key in keys])


def _strength(groups: DataFrame, good: Column, n: Column, p: Column) -> float:
    """How many documents the prior is worth. Groups that differ no more than by chance get a strong prior."""
    chance = F.sum(p * (1 - p))  # what n * (share - p)^2 adds up to if groups differ by chance only
    seen = F.sum(n * F.pow(good / n - p, 2))
    spread = F.greatest((seen - chance) / F.greatest(F.sum(n * p * (1 - p)), F.lit(1e-9)), F.lit(1e-4))
    found = groups.agg(F.least(F.lit(10_000.0), F.greatest(F.lit(2.0), 1 / spread - 1)).alias("strength"))
    return float(found.first()["strength"] or 2.0)


def _logit(p: Column) -> Column:
    held = F.greatest(F.lit(1e-6), F.least(F.lit(1 - 1e-6), p))
    return F.log(held / (1 - held))


def posterior(
    docs: DataFrame, labels: DataFrame, host: str = "source", path: str = "lang", least: float = 0.5, fit_rows: int = FIT_ROWS
) -> DataFrame:
    """One row per row of ``docs``: doc_id, evidence, host_share, path_share, score, kept."""
    model = fit(docs, labels, fit_rows)
    known = docs.select("doc_id", F.col(host).alias("host"), F.col(path).alias("path"), "text")
    seen = evidence(known, model, ["doc_id", "host", "path"])
    base = 0.5 if model is None else float(1 / (1 + np.exp(-model.prior)))
    marks = labels.filter("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy("doc_id")
    marks = marks.agg(F.avg((F.col("quality") > 0).cast("double")).alias("mark"))
    guess = 1 / (1 + F.exp(-(F.col("evidence") + float(np.log(base / (1 - base))))))
    counted = seen.join(marks, "doc_id", "left").withColumn("good", F.coalesce("mark", guess)).drop("mark")
    counted = settle(counted, "evidence")

    paths = counted.groupBy("host", "path").agg(F.sum("good").alias("path_good"), F.count("*").alias("path_n"))
    paths = settle(paths, "paths")
    hosts = paths.groupBy("host").agg(F.sum("path_good").alias("host_good"), F.sum("path_n").alias("host_n"))
    hosts = settle(hosts, "hosts")
    # One row each: the global share, then how alike hosts are, then paths.
    everything = hosts.agg(F.sum("host_good").alias("good"), F.sum("host_n").alias("n")).first()
    total, good = everything["n"] or 0, everything["good"] or 0.0
    share = F.lit(good / total if total else 0.5)
    of_hosts = _strength(hosts, F.col("host_good"), F.col("host_n"), share)
    paths = _beside(paths, hosts, ["host"], "host_n", total)
    host_share = _shrunk(F.col("host_good"), F.col("host_n"), share, of_hosts)
    of_paths = _strength(paths, F.col("path_good"), F.col("path_n"), host_share)

    # The same shares without the document that they score.
    found = _beside(counted, paths, ["host", "path"], "path_n", total)
    own = F.col("good")
    others = (F.lit(good) - own) / (total - 1) if total > 1 else F.lit(0.5)
    found = found.withColumn("host_share", _shrunk(F.col("host_good") - own, F.col("host_n") - 1, others, of_hosts))
    found = found.withColumn("path_share", _shrunk(F.col("path_good") - own, F.col("path_n") - 1, F.col("host_share"), of_paths))
    score = 1 / (1 + F.exp(-(F.col("evidence") + _logit(F.col("path_share")))))
    found = found.withColumn("score", F.lit(0.5) if model is None else score)
    kept = F.lit(True) if model is None else F.col("score") >= least
    return found.select("doc_id", "evidence", "host_share", "path_share", "score", kept.alias("kept"))


def keep_good(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """``docs`` without the rows that are rejected. Rows that share an id go together, if all of them are rejected."""
    found = posterior(docs, labels, **options).groupBy("doc_id").agg(F.max("kept").alias("kept"))
    drop = found.filter("NOT kept").select(F.col("doc_id").alias("__doc"))
    return docs.join(drop, docs["doc_id"].eqNullSafe(drop["__doc"]), "left_anti").select(*docs.columns)
