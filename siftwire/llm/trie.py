"""Prefix tree of conversations, by halving: cut sequences at half depth, name the cut prefixes, go on above and below.

A piece of 2^k turns that starts at a depth divisible by 2^(k+1) is the upper half of a cut; what it
leads to gets a name from the name of where it starts and a digest of its turns. A round names the
ends of all upper halves of one length, in the upper tree and in every lower forest alike, so a
tree of depth D takes about log2(D) rounds, whatever its shape. Totals return the same way: a round
grafts every lower forest, by its total, onto the nodes of the upper half on the way to its cut.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from siftwire.llm.common import crc32_of_id, stored

#: A conversation takes over less than so many turns of the one that its id falls to; ids share it in runs of FAMILY.
HEADS, FAMILY = 9, 5
#: Bytes of the ids that are handed on as one piece to the task that digests them.
PIECE_BYTES = 1 << 20


def _digest(*parts: str | Column) -> Column:
    """16 bytes of the SHA-256 of what the parts put together."""
    return F.unhex(F.substring(F.sha2(F.concat(*parts), 256), 1, 32))


def numbered(rows: DataFrame, group: str, order: list[str | Column], keep: list[str | Column]) -> DataFrame:
    """``group``, ``keep`` and ``pos``, from 1 in each group by ``order`` (nulls first).

    Rows are dealt out by ranges of group and order, so a large group lies in several tasks; a
    small table of where each group goes on in each task turns places into positions.
    """
    keys = [group, *order]
    ranged = rows.withColumn("__tie", F.monotonically_increasing_id())
    ranged = ranged.repartitionByRange(*keys, "__tie").sortWithinPartitions(*keys, "__tie")
    placed = ranged.select(group, *keep, F.monotonically_increasing_id().alias("__at"))
    placed = stored(placed.withColumn("__task", F.shiftright("__at", 33)), "placed")
    runs = placed.groupBy(group, "__task").agg(F.min("__at").alias("__first"), F.count("*").alias("__n"))
    before = Window.partitionBy(group).orderBy("__task").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.select(group, "__task", "__first", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    return (
        placed.join(runs, [group, "__task"])
        .withColumn("pos", F.col("__at") - F.col("__first") + F.col("__before") + 1)
        .drop("__at", "__task", "__first", "__before")
    )


def rebuild(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rebuilt conversations: (conv_id, depth, item, size) of their turns, and (conv_id, turns) of all of them.

    Turns stand by ``turn`` (null first), equal ones by role and text. Conversation c takes the first
    h turns of c - c % 5, h the CRC-32 of its decimal id modulo 9, and then its own after the first
    h. A null role or text is empty; rows without a conv_id belong to none. ``item`` tells turns of
    different role or text apart, ``size`` counts the bytes of the text.
    """
    role, text = F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")
    rows = conversations.filter("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), "turn", role, text)
    item = _digest(F.octet_length("role").cast("string"), F.lit(":"), "role", "text").alias("item")
    turns = numbered(rows, "conv_id", ["turn", "role", "text"], [item, F.octet_length("text").cast("long").alias("size")])
    turns = stored(turns, "turns")

    base = (F.col("conv_id") - F.col("conv_id") % FAMILY).alias("base")
    heads = (crc32_of_id("conv_id") % HEADS).alias("h")
    own = turns.groupBy("conv_id").agg(F.count("*").alias("n")).select("conv_id", "n", base, heads)
    of_base = own.select(F.col("conv_id").alias("base"), F.col("n").alias("there"))
    convs = own.join(of_base, "base", "left").select(
        "conv_id", "base", "n", "h", F.least("h", F.coalesce("there", F.lit(0))).alias("taken")
    )
    convs = stored(convs.withColumn("turns", F.col("taken") + F.greatest(F.col("n") - F.col("h"), F.lit(0))), "conversations")

    first = turns.filter(F.col("pos") < HEADS).withColumnRenamed("conv_id", "base")
    taken = convs.select("conv_id", "base", "h").join(first, "base").filter("pos <= h")
    taken = taken.select("conv_id", F.col("pos").alias("depth"), "item", "size")
    rest = turns.join(convs.select("conv_id", "h", "taken"), "conv_id").filter("pos > h")
    rest = rest.select("conv_id", (F.col("pos") - F.col("h") + F.col("taken")).alias("depth"), "item", "size")
    return stored(taken.unionByName(rest), "rebuilt"), convs.select("conv_id", "turns")


def _blocks(items: DataFrame, levels: int) -> list[DataFrame]:
    """(conv_id, block, item) for each length 2^k: digests of the whole blocks of as many turns."""
    blocks = [items.select("conv_id", (F.col("depth") - 1).alias("block"), "item")]
    for _ in range(levels - 1):
        side = F.col("block") % 2
        pairs = blocks[-1].groupBy("conv_id", F.shiftright("block", 1).alias("block")).agg(
            F.max(F.when(side == 0, F.col("item"))).alias("a"), F.max(F.when(side == 1, F.col("item"))).alias("b")
        )
        blocks.append(stored(pairs.filter("b is not null").select("conv_id", "block", _digest("a", "b").alias("item")), "blocks"))
    return blocks


def prefix_names(items: DataFrame, convs: DataFrame) -> DataFrame:
    """(conv_id, depth, name) for every prefix of every sequence: the smallest conv_id that starts so.

    ``items`` holds (conv_id, depth, item), depths from 1 without gaps; ``convs`` every conv_id.
    """
    deepest = items.agg(F.max("depth")).first()[0] or 0
    levels = int(deepest).bit_length()
    root = convs.agg(F.min("conv_id")).first()[0]
    named = [convs.select("conv_id", F.lit(0).cast("long").alias("depth"), F.lit(root).cast("long").alias("name"))]
    blocks = _blocks(items, levels)
    for k in reversed(range(levels)):
        halves = blocks[k].filter(F.col("block") % 2 == 0)
        halves = halves.select("conv_id", F.shiftleft("block", k).alias("depth"), "item")
        known = reduce(DataFrame.unionByName, named)
        starts = stored(halves.join(known, ["conv_id", "depth"]), "halves")
        found = starts.groupBy("depth", "name", "item").agg(F.min("conv_id").alias("new"))
        ends = starts.join(found, ["depth", "name", "item"])
        named.append(stored(ends.select("conv_id", (F.col("depth") + (1 << k)).alias("depth"), F.col("new").alias("name")), "names"))
    return reduce(DataFrame.unionByName, named)


def _graft(names: DataFrame, nodes: DataFrame, levels: int) -> DataFrame:
    """(depth, name, n_leaves, saved): totals over the subtree of every node below the root."""
    totals = nodes.select("depth", "name", "parent", "n_leaves", "saved")
    for k in range(levels):
        at_cut = ((F.col("depth") - 1) % (1 << k) == 0) & (F.shiftright(F.col("depth") - 1, k) % 2 == 1)
        forests = totals.filter(at_cut).groupBy((F.col("depth") - 1).alias("cut"), F.col("parent").alias("conv_id")).agg(
            F.sum("n_leaves").alias("n_leaves"), F.sum("saved").alias("saved")
        )
        forests = forests.withColumn("half", F.shiftright("cut", k) - 1)
        half = F.shiftright(F.col("depth") - 1, k)
        above = names.filter((F.col("depth") > 0) & (half % 2 == 0)).withColumn("half", half)
        grafts = above.join(forests, ["conv_id", "half"]).groupBy("depth", "name").agg(
            F.sum("n_leaves").alias("more_leaves"), F.sum("saved").alias("more_saved")
        )
        zero = F.lit(0)
        totals = totals.join(grafts, ["depth", "name"], "left").select(
            "depth", "name", "parent", (F.col("n_leaves") + F.coalesce("more_leaves", zero)).alias("n_leaves"),
            (F.col("saved") + F.coalesce("more_saved", zero)).alias("saved"),
        )
        totals = stored(totals, "totals")
    return totals


def id_digests(members: DataFrame) -> DataFrame:
    """(depth, name, ends_sha256) of ``members`` (depth, name, conv_id): SHA-256 of the ascending ids, comma-joined.

    A digest needs its ids in one row of bytes, so tasks over ranges of the ids write them out in
    pieces, and the task that digests a node streams a few pieces, not its members.
    """

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, first, held, size = None, 0, [], 0

        def piece() -> tuple:
            return (*key, first, ",".join(held).encode())

        out: list[tuple] = []
        for batch in batches:
            for depth, name, conv in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if key != (depth, name) or size >= PIECE_BYTES:
                    if held:
                        out.append(piece())
                    key, first, held, size = (depth, name), conv, [], 0
                held.append(str(conv))
                size += len(held[-1]) + 1
            if out:
                yield _batch(out, ["depth", "name", "first", "ids"])
                out = []
        if held:
            yield _batch([piece()], ["depth", "name", "first", "ids"])

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state = None, None
        for batch in batches:
            out = []
            for depth, name, ids in zip(*(batch.column(c).to_pylist() for c in (0, 1, 3)), strict=True):
                if key == (depth, name):
                    state.update(b",")
                else:
                    if key is not None:
                        out.append((*key, state.hexdigest()))
                    key, state = (depth, name), hashlib.sha256()
                state.update(ids)
            if out:
                yield _batch(out, ["depth", "name", "ends_sha256"])
        if key is not None:
            yield _batch([(*key, state.hexdigest())], ["depth", "name", "ends_sha256"])

    order = ["depth", "name", "conv_id"]
    written = members.select(order).repartitionByRange(*order).sortWithinPartitions(*order)
    written = written.mapInArrow(pieces, "depth long, name long, first long, ids binary")
    gathered = written.repartition("depth", "name").sortWithinPartitions("depth", "name", "first")
    return gathered.mapInArrow(digests, "depth long, name long, ends_sha256 string")


def _batch(rows: list[tuple], names: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows, strict=True)], names)


def prefix_trie(items: DataFrame, convs: DataFrame) -> DataFrame:
    """Nodes of the tree of all prefixes of ``items`` (conv_id, depth, item, size) of ``convs`` (conv_id, turns).

    A node is named by its smallest member and its depth. ``saved`` adds up, over its subtree, the
    size of each node's last item times its members but one. Sequences without items are members of
    the root; without sequences there is no tree.
    """
    items, convs = items.select("conv_id", "depth", "item", "size"), convs.select("conv_id", "turns")
    names = stored(prefix_names(items, convs), "prefix-names")
    levels = int(items.agg(F.max("depth")).first()[0] or 0).bit_length()

    own = names.filter("conv_id = name and depth > 0").select("conv_id", "depth")
    above = names.select("conv_id", (F.col("depth") + 1).alias("depth"), F.col("name").alias("parent"))
    own = own.join(items.select("conv_id", "depth", "size"), ["conv_id", "depth"]).join(above, ["conv_id", "depth"])
    own = own.withColumnRenamed("conv_id", "name")
    members = names.groupBy("depth", "name").agg(F.count("*").alias("n_convs"))
    nodes = members.filter("depth > 0").join(own, ["depth", "name"])
    nodes = stored(nodes.withColumn("saved", (F.col("n_convs") - 1) * F.col("size")), "nodes")
    children = nodes.groupBy((F.col("depth") - 1).alias("depth"), F.col("parent").alias("name")).agg(
        F.count("*").alias("n_children")
    )
    children = stored(children, "children")
    leaves = nodes.join(children, ["depth", "name"], "left_anti").select("depth", "name", F.lit(1).alias("leaf"))
    nodes = nodes.join(leaves, ["depth", "name"], "left").withColumn("n_leaves", F.coalesce("leaf", F.lit(0)).cast("long"))
    totals = stored(_graft(names, stored(nodes.drop("leaf"), "weighed"), levels), "grafted")

    tops = totals.filter("depth = 1").groupBy((F.col("depth") - 1).alias("depth")).agg(
        F.sum("n_leaves").alias("n_leaves"), F.sum("saved").alias("saved")
    )
    root = members.filter("depth = 0").join(tops, "depth", "left").select(
        "depth", "name", F.lit(None).cast("long").alias("parent"), "n_convs",
        F.coalesce("n_leaves", F.lit(1)).alias("n_leaves"), F.coalesce("saved", F.lit(0)).alias("saved"),
    )
    below = totals.join(members, ["depth", "name"]).select(root.columns)
    ends = convs.select("conv_id", F.col("turns").alias("depth")).join(names, ["conv_id", "depth"])
    ends = stored(id_digests(ends.select("depth", "name", "conv_id")), "ends")
    return (
        root.unionByName(below)
        .join(children.select("depth", "name", "n_children"), ["depth", "name"], "left")
        .join(ends, ["depth", "name"], "left")
        .select(
            F.col("name").alias("conv_id"),
            "depth",
            F.col("parent").alias("parent_conv_id"),
            "n_convs",
            F.coalesce("n_children", F.lit(0)).cast("long").alias("n_children"),
            F.col("n_leaves").cast("long").alias("n_leaves"),
            "saved",
            F.coalesce("ends_sha256", F.sha2(F.lit(b""), 256)).alias("ends_sha256"),
        )
    )


def trie_digest(conversations: DataFrame) -> DataFrame:
    """The tree of the rebuilt conversations; sizes are bytes of the texts."""
    items, convs = rebuild(conversations)
    return prefix_trie(items, convs).withColumnRenamed("saved", "saved_tokens")
