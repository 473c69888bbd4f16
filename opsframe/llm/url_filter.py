"""URL filters: block and allow entries in a trie over reversed host labels and path segments; the longest match decides.

An entry is a host and the beginning of a path. It fits a URL whose host is the entry's or a subdomain of it (compared
by whole labels) and whose path starts with the entry's, character by character; an entry without a host fits every host.
Of the entries that fit, the one with the longest host wins, then the one with the longest path; of equal entries,
block. A URL that no entry fits gets ``default``.

Hosts lie behind the first ``://``, up to ``/``, ``?``, ``#`` or the end, with A-Z in lower case; paths go on up to ``?``,
``#`` or the end. A null URL or one without ``://`` has an empty host and path. A port or a user name counts as part of
the host.

The trie goes to all executors while the entries are within ``MAX_ENTRIES`` and ``MAX_CHARS``, which bounds it. Larger
lists are joined instead: each URL asks for the prefixes of its labels and segments, none deeper than the deepest entry,
and the rows of a URL are reduced to the best before they meet. Both forms give the same rows.

Repeated URLs and rows come out as often as they went in; long URLs are walked no deeper than the entries go; an empty
table gives an empty result, an empty list the default throughout. Columns besides ``url`` are passed through; those
called host, path, rule or verdict are replaced. Entries with a null host, path or verdict are left out.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from opsframe.llm.common import ship

ship(__name__)

MAX_ENTRIES = 1_000_000
MAX_CHARS = 64_000_000

BLOCK, ALLOW = "block", "allow"
Entry = tuple[str, str, str]  # verdict, host, path

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host(url: Column) -> Column:
    found = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(found, _UPPER, _LOWER)


def path(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def labels(name: str) -> list[str]:
    """Labels of a host from the last one on."""
    return name.split(".")[::-1] if name else []


def segments(place: str) -> tuple[list[str], str]:
    """The whole segments of a path, each with the slash behind it, and what begins after the last slash."""
    *whole, rest = place.split("/")
    return [part + "/" for part in whole], rest


# Nodes are numbers, 0 the root: {(node, label): node}, {(node, segment): node}, {(node, partial segment): (rule, verdict)}
# and {node: lengths of its partial segments, the longest first}. Flat, so that deep entries need no recursion.
Trie = tuple[dict, dict, dict, dict]


def trie(entries: Iterable[Entry]) -> Trie:
    by_label, by_segment, ends, lengths = {}, {}, {}, {}
    new = itertools.count(1)
    for verdict, name, place in entries:
        at = 0
        for label in labels(name):
            at = by_label[at, label] if (at, label) in by_label else by_label.setdefault((at, label), next(new))
        whole, rest = segments(place)
        for part in whole:
            at = by_segment[at, part] if (at, part) in by_segment else by_segment.setdefault((at, part), next(new))
        if ends.get((at, rest), ("", ALLOW))[1] != BLOCK:
            ends[at, rest] = (name + place, verdict)
            if len(rest) not in lengths.setdefault(at, []):
                lengths[at] = sorted([*lengths[at], len(rest)], reverse=True)
    return by_label, by_segment, ends, lengths


def nodes_of(whole: Trie, name: str) -> list[int]:
    """The nodes that the labels of a host reach, the deepest first."""
    at, found, until = 0, [0], len(name)
    while until > 0:
        dot = name.rfind(".", 0, until)
        at = whole[0].get((at, name[dot + 1 : until]))
        if at is None:
            break
        found.append(at)
        until = dot
    return found[::-1]


def match(whole: Trie, hosts: list[int], place: str) -> tuple[str, str] | None:
    """The entry that decides: of the deepest host that has one for the path, the one with the longest path."""
    _, by_segment, ends, lengths = whole
    for at in hosts:
        begin, best = 0, None
        while at is not None:
            for n in lengths.get(at, ()):
                if n <= len(place) - begin and (at, place[begin : begin + n]) in ends:
                    best = ends[at, place[begin : begin + n]]
                    break
            slash = place.find("/", begin)
            if slash < 0:
                break
            at, begin = by_segment.get((at, place[begin : slash + 1])), slash + 1
        if best is not None:
            return best
    return None


def with_parts(pages: DataFrame) -> DataFrame:
    return pages.withColumns({"host": host(F.col("url")), "path": path(F.col("url"))})


def judge(pages: DataFrame, entries: Iterable[Entry], default: str = ALLOW) -> DataFrame:
    """``pages`` (url, ...) with host, path, rule and verdict, by a trie that every executor gets."""
    root = pages.sparkSession.sparkContext.broadcast(trie(entries))

    @F.pandas_udf("rule string, verdict string")
    def look_up(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        whole = root.value
        for hosts, paths in batches:
            reached = {name: nodes_of(whole, name) for name in hosts.unique()}
            found = [match(whole, reached[name], place) or (None, default) for name, place in zip(hosts, paths)]
            yield pd.DataFrame(found, columns=["rule", "verdict"], dtype=object)

    parts = with_parts(pages)
    judged = parts.withColumn("_found", look_up("host", "path"))
    return judged.withColumns({"rule": F.col("_found.rule"), "verdict": F.col("_found.verdict")}).drop("_found")


def judge_by(pages: DataFrame, entries: DataFrame, default: str = ALLOW, max_entries: int = MAX_ENTRIES, max_chars: int = MAX_CHARS) -> DataFrame:
    """The same with entries from a table (verdict, host, path): by a trie within the bounds, by a join beyond them."""
    known = entries.select("verdict", "host", "path").na.drop().distinct()
    size = known.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.length("host") + F.length("path")), F.lit(0)).alias("chars")).first()
    if size["n"] <= max_entries and size["chars"] <= max_chars:
        return judge(pages, [tuple(row) for row in known.collect()], default)
    return judge_joined(pages, known, default)


def judge_joined(pages: DataFrame, entries: DataFrame, default: str = ALLOW) -> DataFrame:
    """The same by a join on beginnings of paths and ends of hosts, for lists that no executor should hold.

    Distinct URLs are judged. Each asks once for every shape of entries that it is long enough for: a number of labels and
    a length of path. So the entries of a large host are told apart by the join's key, and none is gathered.
    """
    rules = entries.select(
        "verdict",
        F.concat("host", "path").alias("rule"),
        F.col("host").alias("r_host"),
        F.col("path").alias("r_path"),
        F.when(F.col("host") == "", 0).otherwise(F.size(F.split("host", r"\."))).alias("n_labels"),
        F.length("path").alias("n_chars"),
    )
    shapes = rules.select("n_labels", "n_chars").distinct()
    parts = with_parts(pages.select("url").distinct())
    own = F.when(F.col("host") == "", 0).otherwise(F.size(F.split("host", r"\.")))
    longest = shapes.agg(F.max("n_labels").alias("labels"), F.max("n_chars").alias("chars")).first()
    depths = F.sequence(F.lit(0), F.least(own, F.lit(longest["labels"] or 0)))
    asks = parts.select("url", "host", "path", F.explode(depths).alias("n_labels")).join(shapes, "n_labels")
    name = F.when(F.col("n_labels") == 0, "").otherwise(
        F.call_function("substring_index", F.col("host"), F.lit("."), -F.col("n_labels"))
    )
    asks = asks.filter(F.col("n_chars") <= F.length("path")).select(
        "url", name.alias("r_host"), F.substring(F.col("path"), F.lit(1), F.col("n_chars")).alias("r_path")
    )
    order = F.struct(F.length("r_host"), F.length("r_path"), (F.col("verdict") == BLOCK).cast("int"))
    best = asks.join(rules.select("r_host", "r_path", "rule", "verdict"), ["r_host", "r_path"])
    best = best.groupBy(F.col("url").alias("_url")).agg(F.max_by(F.struct("rule", "verdict"), order).alias("_best"))
    judged = with_parts(pages).join(best, F.col("url").eqNullSafe(F.col("_url")), "left")
    verdict = F.coalesce(F.col("_best.verdict"), F.lit(default))
    return judged.withColumns({"rule": F.col("_best.rule"), "verdict": verdict}).drop("_best", "_url")
