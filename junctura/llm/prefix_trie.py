"""The trie of conversation prefixes: members, ends, leaves and the tokens that shared prefixes save.

A node is named by its depth and 128 bits made of the turns above it: each turn at its place is hashed to two longs, and a prefix
is their running exclusive or, which needs no walk along the conversation. Each partition's rows are combined to a partial
trie first; partial tries are then merged FAN at a time, keyed by node, until one is left. Counts and the smallest member are
merged so; end lists are merged by ranges of SPAN ids, so that no list grows with its node, and a hash reads the ranges in order.

Rollup: a node belongs to the longest conversation through it (ties: the smallest id), so the nodes of a conversation are one
chain downward to a childless node. Chains hand their sums to the nodes they hang from, the lowest first; along a chain sums run
upward. The number of rounds is that of chains nested in each other, not that of turns.

Null turns come first; turns with equal numbers stand in the order of a hash of role and text, so repeated rows are turns
of their own. Null role or text is empty. Rows with a null conv_id belong to no conversation and are left out. Texts of any length are
hashed once and not carried further. An empty table has no nodes. Other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from junctura.llm.common import STRETCH, checkpoint, ranked, running

WORD = r"[^\x20\x09-\x0D]+"
FAN = 32  # partial tries merged into one in a round
SPAN = 1 << 16  # ids to a range of an end list
SALTS = 64  # parts that the children of one node are looked up in
NODE = ["depth", "a", "b"]


def turns(conversations: DataFrame) -> DataFrame:
    """conv_id, idx (place of the turn, from 0), size (turns of the conversation), content (hash of role and text) and words."""
    role, text = (F.coalesce(conversations[c].cast("string"), F.lit("")) for c in ("role", "text"))
    content = F.unhex(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256))
    x = conversations.where(conversations["conv_id"].isNotNull()).select(conversations["conv_id"].cast("long").alias("conv_id"), conversations["turn"].alias("turn"), content.alias("content"), F.regexp_count(text, F.lit(WORD)).cast("long").alias("words"))
    return checkpoint(ranked(checkpoint(x), ["conv_id"], ["turn", "content"]).drop("turn"))


def rebuilt(found: DataFrame, group: int = 20, heads: int = 4) -> DataFrame:
    """conv_id, p (place from 0; -1 for the root), length, content and words of rebuilt conversations: the first h turns of the first conversation of its
    group of `group` ids, then its own turns after its first h, with h = crc32(conv_id) % heads. Every conversation has a row for the root."""
    h = (F.crc32(F.col("conv_id").cast("string")) % heads).cast("int")
    base = F.col("conv_id") - F.col("conv_id") % group
    first = found.where((F.col("conv_id") == base) & (F.col("idx") < heads - 1)).groupBy(F.col("conv_id").alias("base"))
    first = first.agg(F.sort_array(F.collect_list(F.struct("idx", "content", "words"))).alias("first"))  # heads - 1 turns at most
    each = found.where("idx = 0").select("conv_id", "size", h.alias("h"), base.alias("base")).join(first, "base", "left")
    each = each.withColumn("first", F.slice(F.coalesce("first", F.array().cast("array<struct<idx:bigint,content:binary,words:bigint>>")), F.lit(1), F.col("h")))
    each = each.withColumn("taken", F.size("first").cast("long")).withColumn("length", F.col("taken") + F.greatest(F.col("size") - F.col("h"), F.lit(0)))
    root = F.struct(F.lit(-1).cast("long").alias("idx"), F.lit(None).cast("binary").alias("content"), F.lit(0).cast("long").alias("words"))
    top = each.select("conv_id", "length", F.inline(F.concat(F.array(root), "first"))).withColumnRenamed("idx", "p")
    # a conversation of any size meets its own row stretch by stretch
    part = each.select("conv_id", "length", (F.col("taken") - F.col("h")).alias("move"), F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("size") - 1) / STRETCH))).alias("_part"))
    own = found.where(F.col("idx") >= h).withColumn("_part", F.floor(F.col("idx") / STRETCH)).join(part, ["conv_id", "_part"])
    return top.unionByName(own.select("conv_id", "length", (F.col("idx") + F.col("move")).alias("p"), "content", "words"))


def steps(found: DataFrame) -> DataFrame:
    """depth, a, b (the node), pa, pb (its parent), words, conv_id and length: one row for each node that a conversation passes."""
    own = lambda salt: F.when(F.col("p") >= 0, F.xxhash64(F.lit(salt), "p", "content")).otherwise(0)
    x = running(found.withColumns({"xa": own(1), "xb": own(2)}).drop("content"), ["conv_id"], "p", {"a": "xa", "b": "xb"}, xor=True)
    return x.select((F.col("p") + 1).alias("depth"), "a", "b", F.col("a").bitwiseXOR(F.col("xa")).alias("pa"), F.col("b").bitwiseXOR(F.col("xb")).alias("pb"), "words", "conv_id", "length")


def merged(rows: DataFrame) -> DataFrame:
    """The nodes: depth, a, b, pa, pb, words, conv_id (the smallest member), n_convs and owner (the smallest of the longest members)."""
    partial = rows.select(*NODE, "pa", "pb", "words", "conv_id", F.lit(1).cast("long").alias("n_convs"), F.struct((-F.col("length")).alias("l"), "conv_id").alias("owner"), F.spark_partition_id().alias("part"))
    left = rows.rdd.getNumPartitions()
    while True:
        left = -(-left // FAN)
        key = [*NODE, F.expr(f"part div {FAN}").cast("int").alias("part")]
        partial = partial.groupBy(*key).agg(*[F.min(c).alias(c) for c in ("pa", "pb", "words", "conv_id", "owner")], F.sum("n_convs").alias("n_convs"))
        if left <= 1:
            return checkpoint(partial.withColumn("owner", F.col("owner.conv_id")).drop("part"))


def _hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The hash of each node's ids from its ranges, which come in order, however many batches they fill."""
    node, state, done = None, None, []
    for batch in batches:
        for *key, text in zip(*[c.to_pylist() for c in batch.columns]):
            if key == node:
                state.update(b",")
            else:
                if node is not None:
                    done.append((*node, state.hexdigest()))
                node, state = key, hashlib.sha256()
            state.update(text.encode())
        if done:
            yield _batch(done)
            done = []
    if node is not None:
        yield _batch([(*node, state.hexdigest())])


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string())
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], [*NODE, "ends_sha256"])


def ends(rows: DataFrame) -> DataFrame:
    """depth, a, b and ends_sha256 of the nodes that conversations end at."""
    last = rows.where(F.col("depth") == F.col("length")).groupBy(*NODE, F.expr(f"conv_id div {SPAN}").alias("span")).agg(F.sort_array(F.collect_list("conv_id")).alias("ids"))
    text = last.select(*NODE, "span", F.array_join(F.transform("ids", lambda i: i.cast("string")), ",").alias("ids"))
    in_order = text.repartition(*NODE).sortWithinPartitions(*NODE, "span").select(*NODE, "ids")
    return in_order.mapInArrow(_hashes, "depth long, a long, b long, ends_sha256 string")


def with_parents(nodes: DataFrame) -> DataFrame:
    """nodes with parent_conv_id, parent_owner (null for the root) and n_children. The children of one node ask for it in SALTS parts."""
    asks = nodes.withColumn("salt", F.when(F.col("depth") > 0, F.pmod(F.xxhash64("a", "b"), F.lit(SALTS))))
    pairs = asks.where("depth > 0").groupBy((F.col("depth") - 1).alias("depth"), F.col("pa").alias("a"), F.col("pb").alias("b"), "salt").agg(F.count("*").alias("n"))
    pairs = checkpoint(pairs)
    children = pairs.groupBy(*NODE).agg(F.sum("n").alias("n_children"))
    told = pairs.join(nodes.select(*NODE, F.col("conv_id").alias("parent_conv_id"), F.col("owner").alias("parent_owner")), NODE)
    told = told.select((F.col("depth") + 1).alias("depth"), F.col("a").alias("pa"), F.col("b").alias("pb"), "salt", "parent_conv_id", "parent_owner")
    x = asks.join(told, ["depth", "pa", "pb", "salt"], "left").drop("salt")
    return x.join(children, NODE, "left").na.fill(0, ["n_children"])


def rolled_up(nodes: DataFrame) -> DataFrame:
    """nodes (with parents) with n_leaves and saved_tokens of the subtree of each."""
    saves = (F.col("n_convs") - 1) * F.col("words")
    hangs = F.col("parent_owner").isNull() | (F.col("parent_owner") != F.col("owner"))
    chains = nodes.groupBy("owner").agg(F.lit(1).cast("long").alias("leaves"), F.sum(saves).alias("saved"), F.max(F.when(hangs, F.col("parent_owner"))).alias("under"), (F.min("depth") - 1).alias("at"))
    chains = checkpoint(chains)
    links = chains.where("under is not null").select("owner", "under", "at")
    mass, given = chains.select("owner", "leaves", "saved"), None
    while True:
        moved = checkpoint(mass.join(links, "owner").groupBy("under", "at").agg(F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved")))
        given = moved if given is None else given.union(moved)
        if moved.isEmpty():
            break
        mass = moved.groupBy(F.col("under").alias("owner")).agg(F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"))
    given = given.groupBy(F.col("under").alias("owner"), F.col("at").alias("depth")).agg(F.sum("leaves").alias("_leaves"), F.sum("saved").alias("_saved"))
    own = nodes.join(given, ["owner", "depth"], "left").na.fill(0, ["_leaves", "_saved"])
    own = own.withColumns({"_leaves": F.col("_leaves") + (F.col("n_children") == 0).cast("long"), "_saved": F.col("_saved") + saves})
    return running(own, ["owner"], "depth", {"n_leaves": "_leaves", "saved_tokens": "_saved"}, downward=True).drop("_leaves", "_saved")


def trie(found: DataFrame) -> DataFrame:
    """The nodes of conversations (conv_id, p, length, content, words as of `rebuilt`)."""
    rows = checkpoint(steps(found))
    nodes = checkpoint(with_parents(merged(rows)))
    none = hashlib.sha256().hexdigest()
    full = rolled_up(nodes).join(ends(rows), NODE, "left").na.fill(none, ["ends_sha256"])
    return full.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")
