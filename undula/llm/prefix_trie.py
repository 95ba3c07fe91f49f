"""Prefix trie of conversations, its totals rolled up by bands of depth.

A node is a distinct sequence of first turns. Turns are named by the SHA-256 of role and text, so that texts are read once and never
shuffled; a sequence's name is the exclusive or of 128 bits for each of its turns and their depths, a running aggregate. Totals of subtrees
go up in bands of BAND levels: a node hands its own to its ancestors within its band only. The tops of the bands, whose band totals then are
complete below them, form a trie of their own that is BAND times lower and is treated alike, until one band holds all; on the way
down each top hands its completed total to its ancestors in the band above. So a trie of depth d takes log(d) rounds and a node
becomes BAND rows in each at most.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from undula.llm.shared import table, written

#: Levels of a band; neither this nor the next two change a result.
BAND = 4
#: Turns of a conversation whose names are combined in one group.
BLOCK = 4096
#: A parent with more than this share of all nodes as its children is broadcast; there are fewer than so many of them.
HEAVY = 2048
#: Conversations graft turns of the one at the start of their century, HEADS - 1 at most.
CENTURY, HEADS = 100, 6


def numbered(conversations: DataFrame) -> DataFrame:
    """(conv_id, part, pos, n, name, chars) of every turn: its place from 1 in its conversation of n turns.

    Turns are sorted by range, so that a conversation of any length is dealt over tasks; places add up counts of (conversation,
    part), and `part` says in which part of the sorted turns one stands. Null turns come first, ties follow the name; null roles and texts are empty, rows without a conversation are left out.
    """
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    name = F.unhex(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256))
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), "turn", name.alias("name"), F.length(text).cast("long").alias("chars"))
    rows = written(rows.filter(F.col("conv_id").isNotNull()))
    order = [F.col("conv_id"), F.col("turn").asc_nulls_first(), F.col("name")]
    placed = written(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id()).withColumn("part", F.shiftright("at", 33)).drop("turn"))
    spans = placed.groupBy("conv_id", "part").agg(F.min("at").alias("low"), F.count("*").alias("c"))
    own = Window.partitionBy("conv_id")
    before = F.coalesce(F.sum("c").over(own.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    spans = spans.select("conv_id", "part", (before - F.col("low") + 1).alias("shift"), F.sum("c").over(own).alias("n"))
    return placed.join(spans, ["conv_id", "part"]).select("conv_id", "part", (F.col("at") + F.col("shift")).alias("pos"), "n", "name", "chars")


def grafted(turns: DataFrame) -> DataFrame:
    """(conv_id, depth, last, name, chars) of `numbered` turns, rebuilt: the first h turns of conversation c - c % 100, then c's own after its first h.

    h is CRC-32 of the decimal id, modulo 6. Every conversation also has a row of depth 0 (a null name); `last` marks its last row.
    """
    spans = turns.groupBy("conv_id", "part").agg(F.max("n").alias("n"))
    convs = spans.groupBy("conv_id").agg(F.max("n").alias("n")).withColumn("base", F.col("conv_id") - F.col("conv_id") % CENTURY)
    convs = convs.withColumn("h", F.crc32(F.col("conv_id").cast("string")) % HEADS)
    there = convs.select(F.col("conv_id").alias("base"), F.col("n").alias("m"))
    convs = convs.join(there, "base", "left").withColumn("taken", F.least("h", F.coalesce("m", F.lit(0))))
    convs = written(convs.select("conv_id", "base", "h", "taken", (F.col("taken") + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("length")))
    heads = turns.filter(F.col("pos") < HEADS).select(F.col("conv_id").alias("base"), "pos", "name", "chars")
    depth, last = F.col("depth"), F.col("depth") == F.col("length")
    first = convs.join(heads, "base").filter("pos <= taken").withColumn("depth", F.col("pos"))
    moved = spans.select("conv_id", "part").join(convs, "conv_id")  # a long conversation meets its own row once for each part, not for each turn
    own = turns.join(moved, ["conv_id", "part"]).filter("pos > h").withColumn("depth", F.col("pos") - F.col("h") + F.col("taken"))
    tops = convs.select("conv_id", F.lit(0).cast("long").alias("depth"), (F.col("length") == 0).alias("last"), F.lit(None).cast("binary").alias("name"), F.lit(0).cast("long").alias("chars"))
    return tops.union(first.select("conv_id", depth, last, "name", "chars")).union(own.select("conv_id", depth, last, "name", "chars"))


def _sequences(rows: DataFrame) -> DataFrame:
    """Rows with the names of their sequences of turns (k1, k2) and of those without the last turn (p1, p2)."""
    for k in (1, 2):
        rows = rows.withColumn(f"x{k}", F.when(F.col("depth") > 0, F.xxhash64(F.lit(k), "depth", "name")).otherwise(0))
    rows = rows.withColumn("block", F.floor(F.col("depth") / BLOCK))
    inside = Window.partitionBy("conv_id", "block").orderBy("depth").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    above = Window.partitionBy("conv_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    rows = written(rows.select("conv_id", "block", "depth", "last", "chars", "x1", "x2"))
    blocks = rows.groupBy("conv_id", "block").agg(*[F.bit_xor(f"x{k}").alias(f"b{k}") for k in (1, 2)])
    blocks = blocks.select("conv_id", "block", *[F.coalesce(F.bit_xor(f"b{k}").over(above), F.lit(0)).alias(f"b{k}") for k in (1, 2)])
    running = rows.select("*", *[F.bit_xor(f"x{k}").over(inside).alias(f"r{k}") for k in (1, 2)]).join(blocks, ["conv_id", "block"])
    keys = [F.col(f"r{k}").bitwiseXOR(F.col(f"b{k}")).alias(f"k{k}") for k in (1, 2)]
    return running.select("conv_id", "depth", "last", "chars", *keys, "x1", "x2").withColumns({f"p{k}": F.col(f"k{k}").bitwiseXOR(F.col(f"x{k}")) for k in (1, 2)}).drop("x1", "x2")


def _band(depth: Column, height: int) -> Column:
    return F.floor(depth / height)


def _handed(tops: DataFrame, paths: DataFrame, step: int, height: int, up: int) -> DataFrame:
    """(k1, k2, w, leaves) summed for the ancestors, at depths divisible by `step`, in the band that is `up` bands above a row's own.

    A row meets its ancestors on the path of one conversation through it, BAND of them at most.
    """
    own = tops.select("conv_id", F.col("depth").alias("from"), (_band(F.col("depth"), height) - up).alias("band"), "w", "leaves")
    path = paths.filter(F.col("depth") % step == 0).select("conv_id", "depth", _band(F.col("depth"), height).alias("band"), "k1", "k2")
    met = own.join(path, ["conv_id", "band"]).filter(F.col("depth") <= F.col("from"))
    return met.groupBy("k1", "k2").agg(F.sum("w").alias("w"), F.sum("leaves").alias("leaves"))


def totals(nodes: DataFrame, paths: DataFrame, band: int = BAND) -> DataFrame:
    """(k1, k2, w, leaves): both summed over the subtrees of `nodes` (k1, k2, conv_id, depth, w, leaves), themselves included.

    `paths` (conv_id, depth, k1, k2) leads from the root to every node, along the conversation that the node names.
    """
    tallest = nodes.agg(F.max("depth")).first()[0] or 0
    levels = 0
    while band ** (levels + 1) <= tallest:
        levels += 1
    place = nodes.select("k1", "k2", "conv_id", "depth")
    state, local = nodes, []
    for k in range(levels + 1):
        local.append(written(_handed(state, paths, band**k, band ** (k + 1), 0).join(place, ["k1", "k2"])))
        state = local[-1].filter(F.col("depth") % band ** (k + 1) == 0)
    done = local[levels]
    for k in reversed(range(levels)):
        height = band ** (k + 1)
        more = _handed(done.filter(F.col("depth") > 0), paths, band**k, height, 1)
        more = more.select("k1", "k2", F.col("w").alias("more"), F.col("leaves").alias("more_leaves"))
        both = local[k].join(more, ["k1", "k2"], "left")
        done = written(both.select("k1", "k2", "conv_id", "depth", (F.col("w") + F.coalesce("more", F.lit(0))).alias("w"), (F.col("leaves") + F.coalesce("more_leaves", F.lit(0))).alias("leaves")))
    return done.select("k1", "k2", "w", "leaves")


def _digests(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(k1, k2, sha) of (k1, k2, ids), sorted; a node's ids go through one hash state, part by part, and are never held together."""
    now, state = None, None
    for b in batches:
        out = []
        for k1, k2, ids in zip(b["k1"], b["k2"], b["ids"], strict=True):
            if (k1, k2) == now:
                state.update(b",")
            else:
                if now is not None:
                    out.append((*now, state.hexdigest()))
                now, state = (k1, k2), hashlib.sha256()
            state.update(ids.encode())
        if out:
            yield pd.DataFrame(out, columns=["k1", "k2", "sha"])
    if now is not None:
        yield pd.DataFrame([(*now, state.hexdigest())], columns=["k1", "k2", "sha"])


def _endings(rows: DataFrame) -> DataFrame:
    """(k1, k2, sha) of the conversations that end at a node. Ids are distinct, so 1,024 of them make a part at most."""
    part = F.shiftright("conv_id", 10).alias("part")
    ids = F.array_join(F.transform(F.sort_array(F.collect_list("conv_id")), lambda x: x.cast("string")), ",")
    parts = rows.filter("last").groupBy("k1", "k2", part).agg(ids.alias("ids"))
    return parts.repartition("k1", "k2").sortWithinPartitions("k1", "k2", "part").select("k1", "k2", "ids").mapInPandas(_digests, "k1 long, k2 long, sha string")


def _with_parents(nodes: DataFrame) -> DataFrame:
    """Nodes with the number of their children and their parent's conv_id; a parent of very many children is broadcast, not shuffled with them."""
    children = nodes.filter("depth > 0").groupBy("p1", "p2").agg(F.count("*").alias("n_children"))
    nodes = written(nodes.join(children.withColumnsRenamed({"p1": "k1", "p2": "k2"}), ["k1", "k2"], "left").fillna(0, ["n_children"]))
    total = nodes.count()
    parents = nodes.filter("n_children > 0").select(F.col("k1").alias("p1"), F.col("k2").alias("p2"), F.col("conv_id").alias("parent_conv_id"), "n_children")
    heavy = F.broadcast(parents.filter(F.col("n_children") * HEAVY > total).drop("n_children"))
    below = nodes.filter("depth > 0")
    known = below.join(heavy, ["p1", "p2"])
    rest = below.join(heavy, ["p1", "p2"], "left_anti").join(parents.filter(F.col("n_children") * HEAVY <= total).drop("n_children"), ["p1", "p2"])
    top = nodes.filter("depth = 0").withColumn("parent_conv_id", F.lit(None).cast("long"))
    return top.unionByName(known).unionByName(rest)


def trie(rows: DataFrame, band: int = BAND) -> DataFrame:
    """The nodes of the trie of conversations: `rows` (conv_id, depth, last, name, chars) as `grafted` gives them, all other columns ignored.

    Returns, as longs, conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, and ends_sha256.
    A conversation without turns is a member of the root only, and ends there. No rows: no nodes.
    """
    paths = written(_sequences(rows))
    nodes = paths.groupBy("k1", "k2").agg(*[F.min(c).alias(c) for c in ("conv_id", "depth", "p1", "p2", "chars")], F.count("*").alias("n_convs"))
    nodes = written(_with_parents(nodes))
    own = nodes.select("k1", "k2", "conv_id", "depth", ((F.col("n_convs") - 1) * F.col("chars")).alias("w"), (F.col("n_children") == 0).cast("long").alias("leaves"))
    summed = totals(own, paths.select("conv_id", "depth", "k1", "k2"), band)
    out = nodes.join(summed, ["k1", "k2"]).join(_endings(paths), ["k1", "k2"], "left")
    none = F.lit(hashlib.sha256(b"").hexdigest())
    counts = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", F.col("leaves").alias("n_leaves"), F.col("w").alias("saved_tokens")]
    return out.select(*counts, F.coalesce("sha", none).alias("ends_sha256"))


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The trie of all `conversations`, each rebuilt with the head of another; see `numbered`, `grafted` and `trie`."""
    return trie(grafted(written(numbered(table(spark, sf_dir, "conversations")))))
