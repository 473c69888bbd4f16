"""Similarity join of documents on their sets of word shingles, by a token-group matrix.

A document's set has the distinct five-word shingles of its text (see ``shingles``); two documents link when
``100 * intersection >= percent * union``. All links between different sets count; no cap, no approximate step:

1. Documents with equal sets are one *class*, named by its smallest id.
2. Tokens have one global order: rare ones by hash, then frequent ones by their counts. Two sets that link share a token
   in the first ``n - ceil(percent * n / 100) + 1`` tokens of either (prefix filter), so only these are compared. The
   frequent ones are found by counts in blocks of all documents; which tokens are in that list changes the work, never
   the result, so it may be bounded.
3. Classes are partitioned into groups of similar ones: those of nearly the same size that share most prefix tokens
   with the same *hub*. A first pass checks classes against their hub, so one large family of near copies is tied
   together by as many checks as it has members.
4. The token-group matrix has a row for each prefix token of a group. A class is a query for a group if it shares enough
   prefix tokens with it (``needed``); what is tied to one hub already is not asked again.
5. Each group is split into blocks of at most some hundred members, whose token union is stored with them. A query's
   overlap with the union bounds its overlap with every member; only where that may suffice is the block opened.
   A block gives one link for each set of members that were not yet connected, so links grow with members and queries,
   not with their product.
6. Links become components.

Ids name documents and are unique; where rows share an id, each still gets the component of its own set. A row without an id gets the component of the class
with its set, if there is one with an id, else null. Texts that are null or without words have empty sets and link with
nothing; their component is their own id. Empty tables give empty results; columns besides doc_id and text are not
looked at.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from opsframe.llm import shingles
from opsframe.llm.common import settle, ship
from opsframe.llm.components import components

ship("opsframe.llm.shingles")
ship(__name__)

FREQUENT = 1 << 16  # tokens that may be moved to the end of the order: 512 KB
OFTEN = 64  # documents from which on a token is frequent
SLICE = 512  # texts whose sets are made at once
BLOCK = 128  # members of a group in one block
CHECKS = 1024  # classes that are checked against one copy of their hub
SLOTS = 1 << 20  # bound of the broadcast that thins documents before the exact join


def _least(n, percent: int):
    """The smallest intersection that a set of size n needs."""
    return (percent * n + 99) // 100


def _kept(n: str, percent: int) -> str:
    """Tokens of a set behind its prefix."""
    return f"((({percent} * {n} + 99) div 100) - 1)"


def _both(a: str, b: str, percent: int) -> str:
    """The intersection that two sets of sizes a and b need."""
    return f"(({percent} * ({a} + {b}) + {99 + percent}) div {100 + percent})"


def _late(low: str, high: str, percent: int) -> list[str]:
    """What sets of sizes from low to high need falls with their size, but for the ceilings: least at high or so few below."""
    steps = -(-100 * (100 + percent) // percent**2)
    return [f"greatest({low}, {high} - {d})" for d in range(steps)]


def _either(n: str, low: str, high: str, percent: int) -> str:
    """The prefix tokens that a set of size n shares at least with one it links with, wherever their prefixes end."""
    sizes = (low, *_late(low, high, percent))
    return f"least({', '.join(f'{_both(n, m, percent)} - {_kept(f"greatest({n}, {m})", percent)}' for m in sizes)})"


def needed(n: str, last: str, low: str, high: str, first: str, final: str, percent: int) -> Column:
    """How many prefix tokens a set shares at least with one that it links with, of a size from low to high.

    Up to where the first of the two prefixes ends, both show every common token; behind it, that set has no more than
    the rest of its tokens. ``last`` is where the set's prefix ends, ``first`` to ``final`` where those of the others do.
    """
    mine = f"{_both(n, low, percent)} - {_kept(n, percent)}"
    theirs = ", ".join(f"{_both(n, m, percent)} - {_kept(m, percent)}" for m in _late(low, high, percent))
    either = _either(n, low, high, percent)
    chosen = f"CASE WHEN {last} < {first} THEN {mine} WHEN {last} > {final} THEN least({theirs}) ELSE {either} END"
    return F.greatest(F.lit(1), F.expr(chosen))


def _signature(own: np.ndarray) -> tuple[int, int]:
    with np.errstate(over="ignore"):
        a = np.add.reduce(own, dtype=np.uint64)
        b = np.add.reduce(shingles.mix(own ^ np.uint64(0xA5A5A5A55A5A5A5A)), dtype=np.uint64)
    return int(np.int64(a.view(np.int64))), int(np.int64(b.view(np.int64)))


def _frequent_in_block(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Tokens in four or more different sets of a block of documents, and in how many."""
    for batch in batches:
        for at in range(0, len(batch), 4096):
            seen, own = set(), []
            for tokens in shingles.sets(batch.column(0).slice(at, 4096)):
                key = (len(tokens), int(tokens[0]), int(tokens[-1])) if len(tokens) else None
                if key and key not in seen:
                    seen.add(key)
                    own.append(tokens)
            if not own:
                continue
            every = np.sort(np.concatenate(own))
            first = np.flatnonzero(np.append(True, every[1:] != every[:-1]))
            counts = np.diff(np.append(first, len(every)))
            often = np.flatnonzero(counts >= 4)
            often = often[np.argsort(-counts[often], kind="stable")[: FREQUENT // 4]]
            yield pa.RecordBatch.from_arrays(
                [pa.array(every[first[often]].view(np.int64)), pa.array(counts[often].astype(np.int64))], ["token", "n"]
            )


def frequent_tokens(docs: DataFrame) -> np.ndarray:
    """At most ``FREQUENT`` tokens, by count and then by value."""
    found = docs.select("text").mapInArrow(_frequent_in_block, "token bigint, n bigint")
    found = found.groupBy("token").agg(F.sum("n").alias("n")).filter(F.col("n") >= OFTEN)
    rows = found.orderBy(F.desc("n"), "token").limit(FREQUENT).toPandas()
    rows = rows.sort_values(["n", "token"])
    return rows["token"].to_numpy(np.int64).view(np.uint64)


def _prefixes(frequent, percent: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        order = frequent.value
        by_value = np.argsort(order)
        values = order[by_value]

        def rank(tokens: np.ndarray) -> np.ndarray:
            """Place in the order for frequent tokens, -1 for others."""
            if not len(values):
                return np.full(len(tokens), -1)
            at = np.minimum(np.searchsorted(values, tokens), len(values) - 1)
            return np.where(values[at] == tokens, by_value[at], -1)

        def prefix(tokens: np.ndarray) -> np.ndarray:
            want = len(tokens) - _least(len(tokens), percent) + 1
            part = tokens[: 2 * want + 8]
            rare = part[rank(part) < 0]
            if len(rare) < want and len(part) < len(tokens):
                part, rare = tokens, tokens[rank(tokens) < 0]
            if len(rare) < want:
                places = rank(part)
                often = part[places >= 0][np.argsort(places[places >= 0])]
                rare = np.concatenate([rare, often])
            return rare[:want]

        def end(prefix: np.ndarray) -> int:
            """Place of a prefix's last token in the order, in 62 bits."""
            if not len(prefix):
                return 0
            place = int(rank(prefix[-1:])[0])
            return int(prefix[-1]) >> 2 if place < 0 else (1 << 62) + place

        for batch in batches:
            for at in range(0, len(batch), SLICE):
                sizes, keys, parts = [], [], []
                for tokens in shingles.sets(batch.column(1).slice(at, SLICE)):
                    sizes.append(len(tokens))
                    keys.append(_signature(tokens))
                    parts.append(prefix(tokens) if len(tokens) else tokens)
                ends = np.append(0, np.cumsum([len(x) for x in parts])).astype(np.int32)
                flat = np.concatenate([*parts, np.zeros(0, np.uint64)]).view(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(at, SLICE),
                        pa.array(sizes, pa.int64()),
                        pa.array([k[0] for k in keys], pa.int64()),
                        pa.array([k[1] for k in keys], pa.int64()),
                        pa.array([end(x) for x in parts], pa.int64()),
                        pa.ListArray.from_arrays(pa.array(ends), pa.array(flat)),
                    ],
                    ["doc_id", "n", "s1", "s2", "last", "prefix"],
                )

    return run


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by (token, rep), those whose token has another rep, with the token's smallest rep as hub."""
    token = rep = hub = place = np.zeros(0, np.int64)
    held = np.zeros(0, bool)  # whether the last row has been given out

    def give(mask):
        return pa.RecordBatch.from_arrays([pa.array(x[mask]) for x in (token, rep, hub, place)], ["token", "rep", "hub", "place"])

    for batch in batches:
        if not len(batch):
            continue
        n = len(token)
        token = np.append(token, batch.column(0).to_numpy())
        rep = np.append(rep, batch.column(1).to_numpy())
        place = np.append(place, batch.column(2).to_numpy())
        new = np.append(True, token[1:] != token[:-1])
        first = np.flatnonzero(new)[np.cumsum(new) - 1]
        hubs = rep[first]
        hubs[first < n] = hub[0] if n else 0  # the run of the carried row began before
        hub = hubs
        same = np.zeros(len(token), bool)
        same[1:] |= ~new[1:]
        same[:-1] |= ~new[1:]
        same[:n] &= ~held
        yield give(same)
        # The last row waits for the next batch.
        held = same[-1:].copy()
        token, rep, hub, place = token[-1:], rep[-1:], hub[-1:], place[-1:]


def overlaps(rows: DataFrame, percent: int) -> DataFrame:
    """Of rows (token, rep, place, n, hub, band, tied), the groups (met_hub, met_band) that a class (rep) has to ask.

    A class shares c prefix tokens with those members of a group that have them and whose sizes, low to high, may fit its
    own; the last ones have the places i and j. Sizes are compared with each token, before the pairs are shuffled: most
    that meet in a token are too far apart. A member that links has all its shared tokens in rows that stay.
    """
    matrix = rows.groupBy("token", F.col("hub").alias("met_hub"), F.col("band").alias("met_band")).agg(
        F.count("*").alias("held"), F.max("place").alias("met_place"), F.min("n").alias("low"), F.max("n").alias("high")
    )
    # A class doesn't ask what the same hub ties it to, and of two groups of different hubs one asks the other.
    own = "NOT tied AND (band <> met_band OR held > 1)"
    ask = F.expr(f"if(hub = met_hub, {own}, xxhash64(met_hub, met_band) < xxhash64(hub, band))")
    fits = F.expr(f"100 * high >= {percent} * n AND {percent} * low <= 100 * n")
    met = rows.join(matrix, "token").filter(ask & fits).groupBy("rep", "n", "met_hub", "met_band")
    low = F.greatest(F.min("low"), F.expr(f"({percent} * n + 99) div 100"))
    high = F.least(F.max("high"), F.expr(f"100 * n div {percent}"))
    met = met.agg(
        F.count("*").alias("c"), F.max("place").alias("i"), F.max("met_place").alias("j"), low.alias("low"), high.alias("high")
    )
    return met.filter("low <= high").filter(f"c >= {_either('n', 'low', 'high', percent)}")


def with_texts(docs: DataFrame, sides: DataFrame) -> DataFrame:
    """Adds the text of ``rep``. Texts, compressed in the exchange, are smaller than their sets of hashes."""
    slot = F.pmod(F.xxhash64("doc_id"), F.lit(SLOTS))
    slots = F.broadcast(sides.select(F.pmod(F.xxhash64("rep"), F.lit(SLOTS)).alias("slot")).distinct())
    thinned = docs.withColumn("slot", slot).join(slots, "slot", "left_semi").select(F.col("doc_id").alias("rep"), "text")
    return sides.join(thinned, "rep")


def _rows(batch: pa.RecordBatch) -> Iterator[tuple]:
    """The values of all columns but the last, and the set of the text in the last."""
    for at in range(0, len(batch), SLICE):
        part = batch.slice(at, SLICE)
        columns = [part.column(k).to_pylist() for k in range(part.num_columns - 1)]
        yield from zip(*columns, shingles.sets(part.column(part.num_columns - 1)), strict=True)


def _tied(percent: int) -> Callable:
    """Rows (hub, block, kind, rep, text) sorted by the first three: the hub (kind 0), then those to check with it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, heads = None, []
        for batch in batches:
            u, v = [], []
            for hub, block, kind, rep, own in _rows(batch):
                if (hub, block) != key:
                    key, heads = (hub, block), []
                if kind == 0:
                    heads.append(own)
                    continue
                for head in heads:
                    both = len(np.intersect1d(own, head, assume_unique=True))
                    if (100 + percent) * both >= percent * (len(own) + len(head)):
                        u.append(rep)
                        v.append(hub)
            yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], ["u", "v"])

    return run


class _Block:
    """Members of one block with their token union, and what is known of their connections."""

    def __init__(self, percent: int):
        self.percent, self.reps, self.tied, self.sets = percent, [], [], []
        self.union = None

    def add(self, rep: int, tied: bool, tokens: np.ndarray) -> None:
        self.reps.append(rep)
        self.tied.append(tied)
        self.sets.append(tokens)

    def close(self) -> None:
        sizes = np.array([len(x) for x in self.sets])
        flat = np.concatenate(self.sets)
        order = np.argsort(flat, kind="stable")
        flat, self.who = flat[order], np.repeat(np.arange(len(sizes)), sizes)[order]
        first = np.flatnonzero(np.append(True, flat[1:] != flat[:-1]))
        self.union, self.begin = flat[first], np.append(first, len(flat))
        self.sizes, self.ids = sizes, np.array(self.reps)
        # What is tied to the hub is connected already.
        self.label = np.where(self.tied, -1, np.arange(len(sizes)))
        self.sets = []

    def links(self, rep: int, tokens: np.ndarray) -> list[int]:
        """Members that the query links with: one for each set of connected members."""
        if self.union is None:
            self.close()
        n, p = len(tokens), self.percent
        fits = (100 * self.sizes >= p * n) & (100 * n >= p * self.sizes) & (self.ids != rep)
        if not fits.any():
            return []
        at = np.minimum(np.searchsorted(self.union, tokens), len(self.union) - 1)
        met = at[self.union[at] == tokens]
        # No member can have more in common with the query than the union has.
        if (100 + p) * len(met) < p * (n + self.sizes[fits].min()):
            return []
        counts = self.begin[met + 1] - self.begin[met]
        place = np.repeat(self.begin[met] - np.cumsum(counts) + counts, counts) + np.arange(counts.sum())
        both = np.bincount(self.who[place], minlength=len(self.sizes))
        good = np.flatnonzero(fits & ((100 + p) * both >= p * (n + self.sizes)))
        found, first = np.unique(self.label[good], return_index=True)
        if len(found) > 1:
            self.label[np.isin(self.label, found)] = found[0]
        return self.ids[good[first]].tolist()


def _opened(percent: int) -> Callable:
    """Rows (grp, block, kind, rep, tied, text) sorted by the first three: members (kind 0), then queries."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, block = None, None
        for batch in batches:
            u, v = [], []
            for grp, part, kind, rep, tied, own in _rows(batch):
                if (grp, part) != key:
                    key, block = (grp, part), _Block(percent)
                if kind == 0:
                    block.add(rep, tied, own)
                elif block.reps:
                    for other in block.links(rep, own):
                        u.append(rep)
                        v.append(other)
            yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], ["u", "v"])

    return run


def similar_documents(docs: DataFrame, percent: int = 80) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, n_shingles, component_id."""
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    frequent = spark.sparkContext.broadcast(frequent_tokens(docs))
    schema = "doc_id bigint, n bigint, s1 bigint, s2 bigint, last bigint, prefix array<bigint>"
    signed = settle(docs.mapInArrow(_prefixes(frequent, percent), schema), "prefixes")

    named = signed.filter("n > 0 AND doc_id IS NOT NULL").groupBy("n", "s1", "s2")
    tokens = named.agg(F.min("doc_id").alias("rep"), F.first("prefix").alias("prefix"))
    tokens = tokens.select("rep", F.posexplode("prefix").alias("place", "token"))
    tokens = tokens.select("token", "rep", F.col("place").cast("bigint").alias("place"))
    tokens = tokens.repartition("token").sortWithinPartitions("token", "rep")
    shared = settle(tokens.mapInArrow(_shared, "token bigint, rep bigint, hub bigint, place bigint"), "shared")
    classes = settle(named.agg(F.min("doc_id").alias("rep"), F.max("last").alias("last")), "classes")

    # Groups: classes of the same hub, the one with most shared tokens, and of nearly the same size.
    votes = shared.filter("rep <> hub").groupBy("rep", "hub").agg(F.count("*").alias("votes"))
    best = votes.groupBy("rep").agg(F.max(F.struct("votes", -F.col("hub"))).alias("best"))
    best = best.select("rep", (-F.col("best.col2")).alias("hub"), "best.votes")
    sizes = classes.groupBy("rep").agg(F.max("n").alias("n"), F.max("last").alias("last"))
    reps = shared.select("rep").distinct().join(sizes, "rep").join(best, "rep", "left")
    size_class = F.floor(F.log(F.col("n").cast("double")) / math.log(1.1))
    # A few shared tokens make no group: such classes stay alone, where bounds are sharpest.
    alike = F.expr(f"8 * votes >= n - {_kept('n', percent)}")
    hub = F.when(alike, F.col("hub")).otherwise(F.col("rep"))
    grouped = reps.select("rep", "n", "last", hub.alias("hub"), size_class.alias("band"), "votes")
    grouped = settle(grouped, "groups")

    # Members that share a good part of their prefix with their hub are checked against it. (Others are left to the
    # matrix, which loses nothing.)
    hubs = sizes.select(F.col("rep").alias("hub"), F.col("n").alias("n_hub"))
    part = F.expr(f"(least(n, n_hub) - {_kept('least(n, n_hub)', percent)}) div 3")
    fits = F.expr(f"{percent} * n <= 100 * n_hub AND {percent} * n_hub <= 100 * n")
    near = grouped.filter("rep <> hub").join(hubs, "hub").filter(fits & (F.col("votes") >= part))
    near = settle(near.select("rep", "hub"), "near")
    checks = near.groupBy("hub").agg(F.ceil(F.count("*") / CHECKS).cast("bigint").alias("blocks"))
    follow = near.join(checks, "hub").select("hub", F.expr("pmod(xxhash64(rep), blocks)").alias("block"), F.lit(1).alias("kind"), "rep")
    lead = checks.select("hub", F.explode(F.expr("sequence(0L, blocks - 1)")).alias("block"), F.lit(0).alias("kind"), F.col("hub").alias("rep"))
    sides = with_texts(docs, follow.unionByName(lead)).select("hub", "block", "kind", "rep", "text")
    sides = sides.repartition("hub", "block").sortWithinPartitions("hub", "block", "kind")
    tied = settle(sides.mapInArrow(_tied(percent), "u bigint, v bigint").distinct(), "tied")
    yes = tied.select(F.col("u").alias("rep"), F.lit(True).alias("yes"))
    is_tied = F.coalesce("yes", F.lit(False)) | (F.col("rep") == F.col("hub"))
    members = grouped.join(yes, "rep", "left")
    grp = F.xxhash64("hub", "band").alias("grp")
    members = members.select("rep", "n", "last", "hub", "band", grp, is_tied.alias("tied"))
    members = settle(members, "members")

    # The matrix has the tokens of each group. A query must share enough of its own with a group. What the groups' other
    # members and the prefixes' ends rule out as well is looked up for the few pairs that are left.
    groups = members.groupBy("grp").agg(
        F.ceil(F.count("*") / BLOCK).cast("bigint").alias("blocks"), F.min("last").alias("first"), F.max("last").alias("final"),
        F.count("*").alias("members"),
    )
    rows = shared.select("token", "rep", "place").join(members.select("rep", "n", "hub", "band", "tied"), "rep")
    met = overlaps(rows, percent).withColumn("grp", F.xxhash64("met_hub", "met_band"))
    overlap = met.join(members.select("rep", "last"), "rep").join(groups, "grp")
    enough = needed("n", "last", "low", "high", "first", "final", percent)
    # Against a single class also what either side has behind the last shared token bounds the overlap.
    alone = F.expr(f"members > 1 OR c + least(n - 1 - i, low - 1 - j) >= {_both('n', 'low', percent)}")
    asked = settle(overlap.filter(alone & (F.col("c") >= enough)).select("rep", "grp", "blocks"), "asked")
    asked_groups = asked.select("grp", "blocks").distinct()
    placed = members.join(asked_groups, "grp")
    asked = asked.select("rep", "grp", F.explode(F.expr("sequence(0L, blocks - 1)")).alias("block"))

    placed = placed.select("grp", F.expr("pmod(xxhash64(rep), blocks)").alias("block"), F.lit(0).alias("kind"), "rep", "tied")
    asked = asked.select("grp", "block", F.lit(1).alias("kind"), "rep", F.lit(False).alias("tied"))
    sides = with_texts(docs, placed.unionByName(asked)).select("grp", "block", "kind", "rep", "tied", "text")
    sides = sides.repartition("grp", "block").sortWithinPartitions("grp", "block", "kind")
    links = sides.mapInArrow(_opened(percent), "u bigint, v bigint")

    roots = components(tied.unionByName(links))
    named = classes.select("n", "s1", "s2", "rep").join(roots.withColumnRenamed("node", "rep"), "rep", "left")
    named = named.select("n", "s1", "s2", F.coalesce("root", "rep").alias("component_id"))
    found = signed.select("doc_id", "n", "s1", "s2").join(named, ["n", "s1", "s2"], "left")
    alone = F.when(F.col("n") == 0, F.col("doc_id")).otherwise(F.col("component_id"))
    return found.select("doc_id", F.col("n").alias("n_shingles"), alone.alias("component_id"))


def one_of_each(docs: DataFrame, percent: int = 80) -> DataFrame:
    """``docs`` without the documents that are linked with one of a smaller id."""
    found = similar_documents(docs, percent).filter("doc_id <> component_id")
    drop = found.select(F.col("doc_id").alias("__doc")).distinct()
    return docs.join(drop, docs["doc_id"] == drop["__doc"], "left_anti").select(*docs.columns)
