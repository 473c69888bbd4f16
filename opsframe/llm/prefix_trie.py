"""A trie of conversation prefixes, with totals of subtrees by a rollup over bands of depth.

Each distinct sequence of the first d turns (role, text) of a conversation is a node of depth d, the empty sequence the
root. A node is told by a digest of its turns, and named by its smallest member and its depth.

**Digests.** A conversation may have any number of turns, so its prefixes are not hashed one after the other. Its turns
come in blocks of ``HEIGHT``; a whole block is one element of the sequence on the level above, whose blocks are elements
of the next, and so on, until one block holds a conversation. From the top down, each block gets the digest of what lies
before it and chains its own elements to that. So no task ever has more than a block of one conversation at once, and
the number of levels is the logarithm of the longest conversation. Digests are the first 16 bytes of SHA-256.

**Bands.** The blocks of a level are its bands. A node gives its counts to its ancestors within its band only, at most
``HEIGHT`` rows each; the totals of band roots are found the same way on the level above, whose bands hold band roots;
and then each finished band root adds its total to its ancestors in the band above its own. Rounds grow with the
logarithm of the depth, and the rows made in a round with the number of nodes.

**Order.** Turns are numbered within conversations by a range sort of the whole table (``ordinals``), so a conversation
with a third of all rows lies in many tasks. The ids of the conversations that end at a node are joined in pieces that
tasks make of their own ranges; only the pieces of a node meet, one after the other, in its hash.

Null roles and texts are empty; null turns come first; turns with equal numbers are ordered by their digests, so reruns
agree. A row without a conv_id belongs to no conversation. Repeated rows are turns of their own. An empty table gives an
empty result (there is no conversation, so no root). Other columns are not looked at.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from opsframe.llm.common import settle, ship

ship(__name__)

HEIGHT = 8
KEY_BYTES = 16
ROOT = bytes(KEY_BYTES)
PIECE = 1 << 20  # bytes of ids that are joined at once


def digest(x: Column) -> Column:
    return F.unhex(F.substring(F.sha2(x, 256), 1, 2 * KEY_BYTES))


def turn_digest(role: Column, text: Column) -> Column:
    """Of a role and a text; the length keeps what is role and what is text apart."""
    role = role.cast("binary")
    return digest(F.concat(F.octet_length(role).cast("string").cast("binary"), F.lit(b":"), role, text.cast("binary")))


def turns_of(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, element, n_bytes): what the trie needs of each turn."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    rows = conversations.filter(F.col("conv_id").isNotNull())
    return rows.select(
        F.col("conv_id").cast("bigint").alias("conv_id"),
        "turn",
        turn_digest(role, text).alias("element"),
        F.octet_length(text).cast("bigint").alias("n_bytes"),
    )


def ordinals(turns: DataFrame) -> DataFrame:
    """``turns`` with ``pos``, the place in the conversation from 1 on.

    Ranges of the whole order are numbered within themselves. Where a conversation goes on in the next ranges, what the
    ranges before have of it is added: that is one row for each range at most.
    """
    n = int(turns.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = ["conv_id", F.asc_nulls_first("turn"), "element"]
    # The last key cuts rows that are equal otherwise; which of them comes first makes no difference.
    dealt = turns.withColumn("_any", F.monotonically_increasing_id()).repartitionByRange(n, *order, "_any").sortWithinPartitions(*order)
    placed = settle(dealt.withColumn("_at", F.monotonically_increasing_id()).drop("turn", "_any"), "ranges")
    placed = placed.withColumn("_range", F.shiftright("_at", 33))
    parts = placed.groupBy("conv_id", "_range").agg(F.count("*").alias("_n"), F.min("_at").alias("_first"))
    earlier = Window.partitionBy("conv_id").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.withColumn("_before", F.coalesce(F.sum("_n").over(earlier), F.lit(0)))
    # A conversation's first place in its range: the joined side is as large as the list of conversations.
    found = placed.join(parts.select("conv_id", "_range", "_first", "_before"), ["conv_id", "_range"])
    return found.select("conv_id", "element", "n_bytes", (F.col("_at") - F.col("_first") + F.col("_before") + 1).alias("pos"))


def rebuilt(numbered: DataFrame, donor: Column, head: Column, most: int) -> DataFrame:
    """Each conversation with its first ``head`` turns exchanged for those of another: (conv_id, pos, n_turns, ...).

    ``donor`` and ``head`` (at most ``most``) are expressions on ``conv_id``; a donor is its own donor. One that is not
    there gives nothing. The result has a row with null ``pos`` for each conversation without turns.
    """
    lengths = numbered.groupBy("conv_id").agg(F.count("*").alias("own"))
    convs = lengths.select("conv_id", "own", donor.alias("donor"), head.alias("head"))
    given = lengths.select(F.col("conv_id").alias("donor"), F.least("own", F.lit(most)).alias("there"))
    convs = convs.join(given, "donor", "left").withColumn("taken", F.least("head", F.coalesce("there", F.lit(0))))
    convs = convs.withColumn("n_turns", F.col("taken") + F.greatest(F.col("own") - F.col("head"), F.lit(0)))
    convs = settle(convs.select("conv_id", "donor", "head", "taken", "n_turns"), "conversations")
    kept = numbered.join(convs.drop("donor"), "conv_id").filter(F.col("pos") > F.col("head"))
    kept = kept.withColumn("pos", F.col("pos") - F.col("head") + F.col("taken"))
    begun = numbered.filter((F.col("pos") <= most) & (donor == F.col("conv_id"))).withColumnRenamed("conv_id", "donor")
    lent = begun.join(convs, "donor").filter(F.col("pos") <= F.col("head"))
    columns = ["conv_id", "pos", "n_turns", "element", "n_bytes"]
    bare = convs.filter(F.col("n_turns") == 0)
    nothing = {"pos": F.lit(None).cast("bigint"), "element": F.lit(None).cast("binary"), "n_bytes": F.lit(0).cast("bigint")}
    bare = bare.withColumns(nothing).select(*columns)
    return kept.select(*columns).unionByName(lent.select(*columns)).unionByName(bare)


def blocks(elements: DataFrame, height: int) -> DataFrame:
    """(conv_id, block, total, items): ``height`` elements (conv_id, pos, total, element, n_bytes) in a row each."""
    block = F.call_function("div", F.col("pos") - 1, F.lit(height))
    items = F.sort_array(F.collect_list(F.struct("pos", "element", "n_bytes")))
    return elements.groupBy("conv_id", block.alias("block"), "total").agg(items.alias("items"))


def chained(start: Column, items: Column, end: Column, height: int) -> Column:
    """The keys in a block: of what lies before it, then with one element more each time; ``end`` is a whole block's last."""
    first = F.array(start)
    keys = F.aggregate(items, first, lambda keys, x: F.concat(keys, F.array(digest(F.concat(F.element_at(keys, -1), x["element"])))))
    whole = F.concat(F.slice(keys, 1, height), F.array(end))
    return F.when((F.size(items) == height) & end.isNotNull(), whole).otherwise(keys)


def levels(elements: DataFrame, height: int) -> list[DataFrame]:
    """For each level, from the turns up, its blocks with keys: (conv_id, block, total, items, keys)."""
    own, found = elements.withColumnRenamed("n_turns", "total"), []
    longest = own.agg(F.max("total")).first()[0] or 0
    while True:
        found.append(settle(blocks(own, height), "blocks"))
        if longest <= height:
            break
        whole = found[-1].filter(F.size("items") == height)
        together = F.aggregate("items", F.lit(b""), lambda x, y: F.concat(x, y["element"]))
        own = whole.select(
            "conv_id",
            (F.col("block") + 1).alias("pos"),
            F.call_function("div", F.col("total"), F.lit(height)).alias("total"),
            digest(together).alias("element"),
            F.lit(0).cast("bigint").alias("n_bytes"),
        )
        longest //= height
    nothing = F.lit(None).cast("binary")
    keyed = [found[-1].withColumn("keys", chained(F.lit(ROOT), F.col("items"), nothing, height))]
    for below in found[-2::-1]:
        # A block of the level above has, for each of its elements, what lies before and behind that block below; the
        # conversation's last one also has what lies before the block that is not whole.
        spans = F.transform("items", lambda x, k: F.struct((x["pos"] - 1).alias("block"), F.get("keys", k).alias("start"), F.get("keys", k + 1).alias("end")))
        last = F.struct(F.element_at("items", -1)["pos"].alias("block"), F.element_at("keys", -1).alias("start"), nothing.alias("end"))
        spans = F.when(F.element_at("items", -1)["pos"] == F.col("total"), F.concat(spans, F.array(last))).otherwise(spans)
        spans = keyed[-1].select("conv_id", F.inline(spans))
        joined = below.join(spans, ["conv_id", "block"], "left").withColumn("start", F.coalesce("start", F.lit(ROOT)))
        keyed.append(settle(joined.withColumn("keys", chained(F.col("start"), F.col("items"), F.col("end"), height)).drop("start", "end"), "keys"))
    return keyed[::-1]


def steps(keyed: DataFrame, height: int) -> DataFrame:
    """One row for each element of the blocks: its key, and ``above``, the keys of its ancestors in its parent's band."""
    whole = keyed.select(
        "conv_id",
        "total",
        F.explode(
            F.transform(
                "items",
                lambda x, k: F.struct(
                    x["pos"].alias("depth"),
                    x["n_bytes"].alias("n_bytes"),
                    F.get("keys", k + 1).alias("key"),
                    F.aggregate(F.slice("keys", 1, k + 1), F.lit(b""), lambda a, b: F.concat(a, b)).alias("above"),
                ),
            )
        ).alias("x"),
    )
    return whole.select("conv_id", "total", "x.*").withColumn("is_root", F.col("depth") % height == 0)


def ancestors(above: Column) -> Column:
    """``above`` as an array of keys."""
    places = F.sequence(F.lit(0), F.call_function("div", F.octet_length(above), F.lit(KEY_BYTES)).cast("int"))
    keys = F.transform(places, lambda at: F.substring(above, at * KEY_BYTES + 1, F.lit(KEY_BYTES)))
    return F.filter(keys, lambda key: F.octet_length(key) > 0)


def parent(above: Column) -> Column:
    return F.substring(above, -KEY_BYTES, KEY_BYTES)


def band_sums(nodes: DataFrame, counts: list[str], top: bool) -> DataFrame:
    """Totals of ``counts`` (key, above, is_root, ...) in the part of each subtree that lies in its node's band."""
    up = ancestors(F.col("above"))
    own = F.array("key")
    targets = F.concat(own, up) if top else F.when(F.col("is_root"), own).otherwise(F.concat(own, up))
    return nodes.select(F.explode(targets).alias("key"), *counts).groupBy("key").agg(*[F.sum(c).alias(c) for c in counts])


def subtree_sums(tree: list[DataFrame], counts: list[str], height: int) -> DataFrame:
    """Totals of ``counts`` over each node's subtree: (key, ...).

    ``tree[0]`` has all nodes (key, above, is_root, counts), ``tree[k]`` the nodes of level k (key, above, is_root), each
    with the root, whose ``above`` is empty.
    """
    sums, level = [], tree[0]
    for k in range(len(tree)):
        sums.append(settle(band_sums(level, counts, k == len(tree) - 1), "sums"))
        if k + 1 < len(tree):
            level = tree[k + 1].join(sums[k], "key")  # the weight of a band root: what lies in its band below it
    done = sums[-1]
    for k in range(len(tree) - 2, -1, -1):
        # Finished band roots: their totals go to their ancestors in the band above, of which the first is finished too.
        roots = tree[k].filter(F.col("is_root") & (F.octet_length("above") > 0)).select("key", "above")
        sent = roots.join(done, "key").withColumn("key", F.explode(F.slice(ancestors(F.col("above")), 2, height)))
        open_ = sums[k].join(done.select("key"), "key", "left_anti")
        rest = open_.unionByName(sent.select("key", *counts)).groupBy("key").agg(*[F.sum(c).alias(c) for c in counts])
        done = settle(done.unionByName(rest), "totals")
    return done


def id_hashes(ends: DataFrame) -> DataFrame:
    """(key, ends_sha256) of rows (key, conv_id): SHA-256 of the ids, ascending, joined by commas.

    Tasks join the ids of their ranges into pieces; a node's pieces then stream through one hash. Neither the ids nor the
    pieces of a node are held at once.
    """

    def join_ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, first, ids, size = None, None, [], 0

        def piece() -> pa.RecordBatch:
            columns = [pa.array([key], pa.binary()), pa.array([first], pa.int64()), pa.array([",".join(ids)], pa.string())]
            return pa.RecordBatch.from_arrays(columns, ["key", "first", "ids"])

        for batch in batches:
            for own, conv_id in zip(*(column.to_pylist() for column in batch.columns)):
                if ids and (own != key or size >= PIECE):
                    yield piece()
                    ids = []
                if not ids:
                    key, first, size = own, conv_id, 0
                ids.append(str(conv_id))
                size += len(ids[-1]) + 1
        if ids:
            yield piece()

    def hash_pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state = None, None
        for batch in batches:
            done = []
            for own, _, ids in zip(*(column.to_pylist() for column in batch.columns)):
                if own != key:
                    if state is not None:
                        done.append((key, state.hexdigest()))
                    key, state = own, hashlib.sha256(ids.encode())
                else:
                    state.update(b"," + ids.encode())
            if done:
                yield rows(done)
        if state is not None:
            yield rows([(key, state.hexdigest())])

    def rows(done: list[tuple[bytes, str]]) -> pa.RecordBatch:
        keys, hashes = zip(*done)
        return pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(hashes)], ["key", "ends_sha256"])

    n = int(ends.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = ends.select("key", "conv_id").repartitionByRange(n, "key", "conv_id").sortWithinPartitions("key", "conv_id")
    pieces = ranged.mapInArrow(join_ids, "key BINARY, first BIGINT, ids STRING")
    return pieces.repartition("key").sortWithinPartitions("key", "first").mapInArrow(hash_pieces, "key BINARY, ends_sha256 STRING")


def trie(conversations: DataFrame, height: int = HEIGHT) -> DataFrame:
    """One row for each node of the rebuilt conversations (conv_id, pos, n_turns, element, n_bytes)."""
    conversations = settle(conversations, "rebuilt")
    keyed = levels(conversations.filter(F.col("pos").isNotNull()), height)
    rows = steps(keyed[0], height)
    last = (F.col("depth") == F.col("total")).cast("bigint")
    nodes = rows.groupBy("key", "above", "depth", "n_bytes", "is_root").agg(
        F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), F.sum(last).alias("n_ends")
    )
    convs = conversations.groupBy("conv_id").agg(F.max("n_turns").alias("n_turns"))
    bare = (F.col("n_turns") == 0).cast("bigint")
    top = convs.agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), F.sum(bare).alias("n_ends")).filter("n_convs > 0")
    no_depth = F.lit(0).cast("bigint")
    origin = {"key": F.lit(ROOT), "above": F.lit(b""), "depth": no_depth, "n_bytes": no_depth, "is_root": F.lit(True)}
    top = settle(top.withColumns(origin), "root")
    nodes = settle(nodes.unionByName(top), "nodes")

    leaf = (F.col("n_convs") == F.col("n_ends")).cast("bigint")
    weighed = nodes.select("key", "above", "is_root", leaf.alias("n_leaves"), ((F.col("n_convs") - 1) * F.col("n_bytes")).alias("saved_tokens"))
    tree = [weighed]
    for level in keyed[1:]:
        own = steps(level, height).select("key", "above", "is_root").distinct()
        tree.append(settle(own.unionByName(top.select("key", "above", "is_root")), "bands"))
    totals = subtree_sums(tree, ["n_leaves", "saved_tokens"], height)

    children = nodes.filter(F.col("depth") > 0).groupBy(parent(F.col("above")).alias("key")).agg(F.count("*").alias("n_children"))
    ends = rows.filter(F.col("depth") == F.col("total")).select("key", "conv_id")
    ends = ends.unionByName(conversations.filter(F.col("pos").isNull()).select(F.lit(ROOT).alias("key"), "conv_id"))
    parents = nodes.select(F.col("key").alias("_parent"), F.col("conv_id").alias("parent_conv_id"))
    out = nodes.join(totals, "key").join(children, "key", "left").join(id_hashes(ends), "key", "left")
    out = out.withColumn("_parent", F.when(F.col("depth") > 0, parent(F.col("above")))).join(parents, "_parent", "left")
    return out.select(
        "conv_id",
        "depth",
        "parent_conv_id",
        "n_convs",
        F.coalesce("n_children", no_depth).alias("n_children"),
        "n_leaves",
        "saved_tokens",
        F.coalesce("ends_sha256", F.sha2(F.lit(b""), 256)).alias("ends_sha256"),
    )


def whole(numbered: DataFrame) -> DataFrame:
    """Conversations as they are, in the form that ``trie`` takes."""
    lengths = numbered.groupBy("conv_id").agg(F.count("*").alias("n_turns"))
    return numbered.join(lengths, "conv_id").select("conv_id", "pos", "n_turns", "element", "n_bytes")
