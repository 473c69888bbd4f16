"""Mixing sources to target weights by Sainte-Lague apportionment, in DataFrame operations only.

Sizes are words. Sources get shares of ``budget_percent`` of all words by weight; a share stops at ``most`` times its
source, and the excess goes to the others by weight until none is above (``targets``). Targets are dealt out in equal
blocks of words: the highest quotients ``votes / (2 k + 1)`` win, first among sources, then among the shards of a source
(``quotas``), so each shard of a source has a whole number of blocks. Within a shard, documents follow each other in
seeded order; the shard's blocks are cut from that sequence and taken from its start, a second time round where the
quota is more than the shard has. A document so gets the words of its taken blocks, at most ``most`` times its own.

All is decided by hashes of ids, so runs agree. Null texts and texts without words have size 0 and get nothing; a null
source is a source of its own, the last one. Rows that repeat an id are separate documents; which of two equal rows gets
more is of no consequence. Empty tables give empty results. Columns besides doc_id, text and source are not looked at.

A source with a third of all rows is spread over ``SHARDS * CHUNKS`` window groups; only one row per source meets in one
task for ranks and targets.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from opsframe.llm.common import settle, words

WEIGHTS = (3, 1, 2)
SHARDS = 16
CHUNKS = 64
BLOCK = 16


def targets(sources: DataFrame, weights=WEIGHTS, budget_percent: int = 150, most: int = 2) -> DataFrame:
    """Adds weight and target to (source, source_size). One row per source, so these windows are small."""
    in_order = Window.orderBy(F.col("source").asc_nulls_last())
    place = F.pmod(F.row_number().over(in_order) - 1, F.lit(len(weights)))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (place + 1).cast("int"))
    ranked = sources.withColumn("weight", weight).withColumn("cap", F.col("source_size") * F.lit(float(most)))
    # Sources fill up in the order of cap / weight. The level is what each unit of weight gets of the rest.
    filled = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before = filled.rowsBetween(Window.unboundedPreceding, -1)
    rest = filled.rowsBetween(0, Window.unboundedFollowing)
    whole = Window.partitionBy()
    level = (
        F.sum("source_size").over(whole) * F.lit(budget_percent / 100) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))
    ) / F.sum("weight").over(rest)
    levels = ranked.withColumn("level", level)
    # The first source whose share of the level is below its cap fixes the level for itself and all behind it.
    fixed = F.min(F.when(F.col("level") * F.col("weight") <= F.col("cap"), F.struct(F.col("cap") / F.col("weight"), "level")))
    final = fixed.over(whole)["level"]
    share = F.coalesce(F.least(F.col("cap"), final * F.col("weight")), F.col("cap"))
    return levels.select("source", "source_size", "weight", share.alias("target"))


def apportion(votes: DataFrame, within: list[str], key: list[Column], weight: str, seats: str) -> DataFrame:
    """Adds ``won``: the seats of each row of ``votes`` by highest quotients, ``seats`` in all among equal ``within``.

    Seats differ from the exact share ``e`` by at most ``e * rows / (2 * seats) + 1``: moving the divisor that far changes
    the rounded shares by more than the ``rows / 2`` that rounding can be off. So only quotients in that reach compete,
    a few per row. Equal quotients go by ``key``.
    """
    group = Window.partitionBy(*within)
    exact = F.when(F.col("__total") > 0, F.col(weight) / F.col("__total") * F.col(seats)).otherwise(0.0)
    reach = F.ceil(F.col("__exact") * F.col("__rows") / (2 * F.greatest(F.col(seats), F.lit(1)))) + 1
    started = (
        votes.withColumns({"__total": F.sum(weight).over(group), "__rows": F.count("*").over(group)})
        .withColumn("__exact", exact)
        .withColumn("__base", F.greatest(F.lit(0), F.floor("__exact") - reach).cast("bigint"))
        .withColumn("__open", F.col(seats) - F.sum("__base").over(group))
    )
    more = F.when(F.col("__exact") > 0, F.ceil("__exact") + reach - F.col("__base")).otherwise(0).cast("bigint")
    offered = started.withColumn("__k", F.explode(F.sequence(F.lit(0).cast("bigint"), more)))
    offered = offered.withColumn("__quotient", F.col(weight) / (2 * (F.col("__base") + F.col("__k")) + 1))
    order = Window.partitionBy(*within).orderBy(F.desc("__quotient"), *key, "__k")
    won = F.max("__base") + F.count_if((F.col("__place") <= F.col("__open")) & (F.col("__exact") > 0))
    return offered.withColumn("__place", F.row_number().over(order)).groupBy(*votes.columns).agg(won.alias("won"))


def _beside(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Left join on keys of which some may be null."""
    named = right.select(*[F.col(c).alias(f"__{c}") if c in keys else F.col(c) for c in right.columns])
    equal = F.lit(True)
    for key in keys:
        equal = equal & F.col(key).eqNullSafe(F.col(f"__{key}"))
    return left.join(named, equal, "left").drop(*[f"__{key}" for key in keys])


def taken(docs: DataFrame, weights=WEIGHTS, budget_percent: int = 150, most: int = 2, seed: int = 7) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text, source): doc_id, source, size, source_size, target, taken."""
    shard = F.pmod(F.xxhash64(F.lit(seed), "doc_id"), F.lit(SHARDS))
    place = F.xxhash64(F.lit(seed + 1), "doc_id")
    sized = docs.select("doc_id", "source", F.size(words(F.col("text"))).cast("bigint").alias("size"))
    sized = settle(
        sized.select(
            "doc_id", "source", "size", shard.alias("shard"), place.alias("place"),
            F.pmod(F.shiftrightunsigned(place, 32), F.lit(CHUNKS)).alias("chunk"),
        ),
        "sizes",
    )
    chunks = settle(sized.groupBy("source", "shard", "chunk").agg(F.sum("size").alias("chunk_size")), "chunks")
    sources = targets(chunks.groupBy("source").agg(F.sum("chunk_size").alias("source_size")), weights, budget_percent, most)

    # Blocks of the whole mix go to sources, blocks of a source to its shards.
    every = F.round(F.sum("target").over(Window.partitionBy()) / BLOCK).cast("bigint")
    by_source = sources.withColumns({"seats": every, "all": F.lit(1)})
    by_source = apportion(by_source, ["all"], [F.col("source").asc_nulls_last()], "target", "seats")
    by_source = settle(by_source.select("source", "source_size", "target", F.col("won").alias("blocks")), "source_quotas")
    shards = chunks.groupBy("source", "shard").agg(F.sum("chunk_size").alias("shard_size"))
    shards = _beside(shards, by_source, ["source"])
    quotas = apportion(shards, ["source"], [F.col("shard")], "shard_size", "blocks")
    quotas = quotas.withColumn("quota", F.col("won") * BLOCK).drop("won", "blocks")

    # Words before each chunk of a shard's sequence; then words before each document of a chunk.
    ahead = Window.partitionBy("source", "shard").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    starts = chunks.withColumn("start", F.coalesce(F.sum("chunk_size").over(ahead), F.lit(0))).drop("chunk_size")
    starts = _beside(starts, quotas, ["source", "shard"])
    in_chunk = Window.partitionBy("source", "shard", "chunk").orderBy("place", "doc_id", "size")
    before = F.coalesce(F.sum("size").over(in_chunk.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = _beside(sized.withColumn("before", before), starts, ["source", "shard", "chunk"])
    rows = rows.withColumn("at", F.col("start") + F.col("before"))
    # Round r takes what of the quota is left after r whole shards.
    rounds = [
        F.greatest(F.lit(0), F.least(F.col("size"), F.col("quota") - F.col("shard_size") * r - F.col("at")))
        for r in range(most)
    ]
    words_taken = rounds[0]
    for more in rounds[1:]:
        words_taken = words_taken + more
    return rows.select("doc_id", "source", "size", "source_size", "target", words_taken.cast("bigint").alias("taken"))


def mix(docs: DataFrame, weights=WEIGHTS, budget_percent: int = 150, most: int = 2, seed: int = 7) -> DataFrame:
    """``docs`` as mixed: each document as often as it is taken, to the nearest whole number of copies.

    A document's words are whole or not in the mix; rows with the same id are counted once and repeated alike.
    """
    counted = taken(docs, weights, budget_percent, most, seed)
    copies = F.when(F.col("size") > 0, F.floor(F.col("taken") / F.col("size") + 0.5)).otherwise(0).cast("int")
    wanted = counted.groupBy(F.col("doc_id").alias("__id")).agg(F.max(copies).alias("__copies")).filter("__copies > 0")
    found = docs.join(wanted, docs["doc_id"].eqNullSafe(wanted["__id"]))
    return found.withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("__copies")))).select(*docs.columns)
