"""Exact duplicates by an extendible-hash index on shared files.

1. Equal texts meet in one hash aggregation on (fingerprint, text): it compares bytes, and its map-side part sends each
   distinct text once per map task, so a text with a third of all rows stays small. Its result, one *head* per text,
   has no text in it any more.
2. The directory: heads are counted by the first bits of their fingerprint, as many as their number asks for. The
   directory doubles while a bucket holds more than ``capacity`` heads; buckets that were not overfull keep their smaller
   depth.
3. Each owner task gets a range of keys (bucket, fingerprint), chains the heads whose fingerprints collide, and writes its
   part of the index in key order. A head in a chain has its text with it, others do without.
4. Every row finds its bucket through the directory and probes the index there by its fingerprint. Without a chain the
   one head is its own, since all texts are in the index; in a chain it is the head with the same bytes.

The directory has at most 2^MAX_BITS cells, which fit in a broadcast, and is enough for 10^11 texts at the default
capacity. Beyond that, or where fingerprints crowd, a bucket is longer; the result is the same.

Nulls count as empty texts. Of equal texts the row with the largest id stays (a null id is the smallest). Rows that
repeat an id and its text are listed each; ``deduplicate`` keeps one of them. An empty table gives an empty result;
other columns are passed through by ``deduplicate``, whatever their names.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from opsframe.llm.common import settle

MAX_BITS = 22
CAPACITY = 65_536


def fingerprint(text: Column) -> Column:
    return F.xxhash64(text)


def digest(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def bits(heads: int, capacity: int = CAPACITY) -> int:
    """Bits of the fingerprint that the directory may use: four more than even buckets would need."""
    return min(max(math.ceil(math.log2(max(heads, 1) / capacity)) + 4, 1), MAX_BITS)


def cell(depth: int) -> Column:
    return F.shiftrightunsigned("fp", 64 - depth)


def directory(heads: DataFrame, capacity: int = CAPACITY, max_depth: int = MAX_BITS) -> DataFrame:
    """Buckets (cell, bucket, depth) for the first ``max_depth`` bits of ``fp``; at most 2^max_depth rows."""
    cells = settle(heads.groupBy(cell(max_depth).alias("cell")).agg(F.count("*").alias("n")), "cells")
    depth = 0
    while depth < max_depth:
        held = cells.groupBy(F.shiftright("cell", max_depth - depth).alias("bucket")).agg(F.sum("n").alias("n"))
        if held.filter(F.col("n") > capacity).isEmpty():
            break
        depth += 1
    # A cell belongs to the first bucket on its way down that is not overfull.
    levels = cells.withColumn("depth", F.explode(F.sequence(F.lit(0), F.lit(depth)))).withColumn(
        "bucket", F.expr(f"shiftright(cell, {max_depth} - depth)")
    )
    fitting = levels.groupBy("depth", "bucket").agg(F.sum("n").alias("held"))
    fitting = fitting.filter((F.col("held") <= capacity) | (F.col("depth") == depth)).drop("held")
    found = levels.join(fitting, ["depth", "bucket"]).groupBy("cell").agg(F.min("depth").alias("depth"))
    # The bucket's number is its first cell, so that buckets of all depths are in key order.
    first = F.expr(f"shiftleft(shiftright(cell, {max_depth} - depth), {max_depth} - depth)")
    return found.select("cell", first.alias("bucket"), "depth")


def with_bucket(rows: DataFrame, places: DataFrame, depth: int) -> DataFrame:
    """``rows`` (fp, ...) with the bucket that the directory has for them."""
    return rows.withColumn("cell", cell(depth)).join(F.broadcast(places.select("cell", "bucket")), "cell").drop("cell")


def build_index(docs: DataFrame, capacity: int = CAPACITY, fp=fingerprint) -> tuple[DataFrame, DataFrame, int]:
    """The index (bucket, fp, chain, text, keep_id, group_size), the directory and its bits.

    ``chain`` is the place among heads of one fingerprint, 0 where there is but one; ``text`` is null there.
    """
    texts = docs.select(F.col("doc_id").alias("id"), F.coalesce("text", F.lit("")).alias("text"))
    heads = texts.withColumn("fp", fp(F.col("text"))).groupBy("fp", "text")
    heads = heads.agg(F.max("id").alias("keep_id"), F.count("*").alias("group_size"))
    # Texts go no further, unless fingerprints collide: these heads need their bytes.
    narrow = settle(heads.drop("text"), "heads")
    collided = narrow.groupBy("fp").agg(F.count("*").alias("n")).filter("n > 1").select("fp")
    entries = narrow.withColumn("text", F.lit(None).cast("string"))
    if not collided.isEmpty():
        entries = entries.join(collided, "fp", "left_anti").unionByName(heads.join(collided, "fp", "left_semi"))
    depth = bits(narrow.count(), capacity)
    places = settle(directory(narrow, capacity, depth), "directory")
    owned = with_bucket(entries, places, depth).repartitionByRange("bucket", "fp").sortWithinPartitions("bucket", "fp", "text")
    place = F.row_number().over(Window.partitionBy("bucket", "fp").orderBy("text"))
    chain = F.when(F.col("text").isNull(), 0).otherwise(place)
    columns = ["bucket", "fp", chain.alias("chain"), "text", "keep_id", "group_size"]
    return settle(owned.select(*columns), "index"), places, depth


def exact_duplicates(docs: DataFrame, capacity: int = CAPACITY, fp=fingerprint) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, keep_id, group_size, kept, text_sha256."""
    index, places, depth = build_index(docs, capacity, fp)
    text = F.coalesce("text", F.lit(""))
    rows = with_bucket(docs.select("doc_id", fp(text).alias("fp"), digest(text).alias("text_sha256")), places, depth)
    found = rows.join(index.filter("chain = 0").drop("text"), ["bucket", "fp"])
    chained = index.filter("chain > 0")
    if not chained.isEmpty():
        # Rows whose fingerprints collide come with their bytes.
        whole = docs.select("doc_id", fp(text).alias("fp"), digest(text).alias("text_sha256"), text.alias("text"))
        found = found.unionByName(with_bucket(whole, places, depth).join(chained, ["bucket", "fp", "text"]).drop("text"))
    kept = F.col("doc_id").eqNullSafe(F.col("keep_id"))
    return found.select("doc_id", "keep_id", "group_size", kept.alias("kept"), "text_sha256")


def deduplicate(docs: DataFrame, capacity: int = CAPACITY, fp=fingerprint) -> DataFrame:
    """``docs`` with one row of each text: the one with the largest id."""
    index, places, depth = build_index(docs, capacity, fp)
    least = F.lit(-(2**63)).cast("bigint")
    text = F.coalesce("text", F.lit(""))
    # The row's own columns stay together in one, so that no name can clash with the keys.
    own = [F.struct(*docs.columns).alias("row"), fp(text).alias("fp"), F.coalesce(F.col("doc_id").cast("bigint"), least).alias("id")]
    stay = index.select("bucket", "fp", "chain", F.coalesce("keep_id", least).alias("id"), "text")
    # Rows that repeat an id with its text meet by the same keys; one of them stays.
    keys = ["bucket", "fp", "id"]
    rows = with_bucket(docs.select(*own), places, depth)
    found = rows.join(stay.filter("chain = 0").select(*keys), keys, "left_semi").dropDuplicates(keys).select("row.*")
    chained = stay.filter("chain > 0").select(*keys, "text")
    if not chained.isEmpty():
        keys = [*keys, "text"]
        rows = with_bucket(docs.select(*own, text.alias("text")), places, depth)
        found = found.unionByName(rows.join(chained, keys, "left_semi").dropDuplicates(keys).select("row.*"))
    return found
