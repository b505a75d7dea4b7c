"""Prefix trie of conversations, built level by level.

At each depth the live conversations are grouped by (parent node, next turn) and each group becomes a node, named by its smallest conv_id. Equal
conversations are one class with a count, so a node with one class left is the top of a chain that needs no more grouping: its class leaves the
live table. Leaves and savings are rolled up by joins from the deepest level to the root.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._common import folded, stored

COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
NOTHING = hashlib.sha256().hexdigest()


def turns_of(conversations: DataFrame) -> DataFrame:
    """(conv_id, pos, role, text): turns numbered from 1 by turn (nulls first), those of one turn by role and text; null role and text are empty, rows without conv_id are left out."""
    of_conv = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    named = conversations.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), "turn", *[F.coalesce(c, F.lit("")).alias(c) for c in ("role", "text")])
    return named.withColumn("pos", F.row_number().over(of_conv).cast("long")).select("conv_id", "pos", "role", "text")


def rebuilt(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """turns -> (conv_id) of all conversations and their turns after each takes the first h turns of conversation conv_id - conv_id % 5, h = crc32(conv_id) % 9, before its own turns after its first h."""
    convs = turns.select("conv_id").distinct().withColumn("h", F.crc32(F.col("conv_id").cast("string")) % 9).withColumn("base", F.expr("conv_id - conv_id % 5"))
    heads = turns.where("pos <= 8").withColumnsRenamed({"conv_id": "b_conv"})  # 8 turns at most, for five conversations at most
    head = convs.where("h > 0").join(heads, F.expr("base = b_conv and pos <= h")).select("conv_id", "pos", "role", "text")
    own = turns.where(F.col("pos") > F.crc32(F.col("conv_id").cast("string")) % 9)
    # positions keep their order; a short head leaves a gap, which the trie does not mind
    return convs.select("conv_id"), head.unionByName(own)


def _digest() -> Column:
    """Identity of a turn: a hash of role and text, told apart by the length of the role."""
    return F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text")), 256)


def _part(of: Column, at: int) -> Column:
    return F.conv(F.substring(of, at, 14), 16, 10).cast("decimal(18,0)")


def _classes(convs: DataFrame, turns: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """convs, turns(conv_id, pos, role, text) -> members(conv_id, class), classes(class, m, length) and steps(class, depth, turn, bytes).

    A class holds the conversations with equal turns and is named by its smallest conv_id. Sequences are told apart by sums of 224 bits of SHA-256 of
    place and turn, which are aggregated before they are shuffled.
    """
    of_conv = Window.partitionBy("conv_id").orderBy("pos")
    placed = stored(turns.select("conv_id", F.row_number().over(of_conv).cast("long").alias("depth"), _digest().alias("turn"), F.octet_length("text").cast("long").alias("bytes")))
    mark = F.sha2(F.concat_ws(":", F.col("depth").cast("string"), F.col("turn")), 256)
    marks = placed.select("conv_id", "depth", mark.alias("mark")).groupBy("conv_id").agg(F.max("depth").alias("length"), *[F.sum(_part(F.col("mark"), 1 + 14 * i)).alias(f"s{i}") for i in range(4)])
    sums = ["length", "s0", "s1", "s2", "s3"]
    marked = convs.join(marks, "conv_id", "left").select("conv_id", *[F.coalesce(F.col(c), F.lit(0)).alias(c) for c in sums])
    kinds = marked.groupBy(*sums).agg(F.min("conv_id").alias("class"), F.count("*").alias("m"))
    members = stored(marked.join(kinds, sums).select("conv_id", "class", "m", "length"))
    classes = members.where("conv_id = class").select("class", "m", "length")
    steps = placed.withColumnRenamed("conv_id", "class").join(classes.select("class"), "class", "left_semi")
    return members, classes, steps


def trie(conversations: DataFrame) -> DataFrame:
    """One row per node of the rebuilt conversations' trie: COLUMNS, from the root at depth 0 with no parent.

    Null turns come first, turns of equal number are ordered by role and text, repeated rows are turns of their own, null roles and texts
    are empty, rows without conv_id are left out and other columns are ignored; % has the sign of conv_id, as in SQL. An empty table gives an empty result.
    """
    return build(*rebuilt(turns_of(conversations)))


def build(convs: DataFrame, turns: DataFrame) -> DataFrame:
    """The trie of convs(conv_id), each once, with turns(conv_id, pos, role, text) in the order of pos."""
    members, classes, steps = _classes(convs, turns)
    steps = stored(steps)
    ends = folded(members, "class", ["conv_id"], ["conv_id"], _Listed, _Listed.add, lambda s: (s.hash.hexdigest(),), "ends_sha256 string")
    classes = stored(classes.join(ends, "class"))
    every = classes.agg(F.min("class").alias("node"), F.sum("m").alias("n_convs"), F.count("*").alias("k")).where("k > 0")
    zero, none = F.lit(0).cast("long"), F.lit(None).cast("long")
    # a row for each class, with the node that it is in; the row of the class that names the node stands for it
    live = stored(classes.select("class", "m", "length").join(F.broadcast(every)).select("class", "m", "length", none.alias("parent"), zero.alias("bytes"), "node", "n_convs", "k"))  # one row
    levels, depth = [], 0
    while not live.isEmpty():
        levels.append(live)
        depth += 1
        onward = live.where((F.col("k") > 1) & (F.col("length") >= depth)).select("class", "m", "length", F.col("node").alias("parent"))
        ahead = onward.join(steps.where(F.col("depth") == depth).drop("depth"), "class")
        nodes = ahead.groupBy("parent", "turn").agg(F.min("class").alias("node"), F.sum("m").alias("n_convs"), F.count("*").alias("k"))
        live = stored(ahead.join(nodes, ["parent", "turn"]).select(*live.columns))
    chains = classes.select("class", "m", "length", F.col("m").alias("parent"), F.col("m").alias("since")).where("false")
    for at, level in enumerate(levels):
        chains = chains.unionByName(level.where("k = 1").select("class", "m", "length", "parent", F.lit(at).cast("long").alias("since")))
    chains = stored(_chains(chains, steps, classes))
    return _rolled_up(levels, chains, classes)


def _chains(tails: DataFrame, steps: DataFrame, classes: DataFrame) -> DataFrame:
    """All nodes of the chains: COLUMNS, with first, whether the node is the top of its chain."""
    # the root has no step
    zero = F.lit(0).cast("long")
    at = tails.where("since = 0").select("class", zero.alias("depth"), zero.alias("bytes"), "m", "length", "parent", "since")
    below = tails.join(steps.select("class", "depth", "bytes"), "class").where("depth >= since").select(*at.columns)
    nodes = at.unionByName(below)
    rest = Window.partitionBy("class").orderBy(F.col("depth").desc())
    first = F.col("depth") == F.col("since")
    last = F.col("depth") == F.col("length")
    summed = nodes.withColumn("saved_tokens", F.sum((F.col("m") - 1) * F.col("bytes")).over(rest)).join(classes.select("class", "ends_sha256"), "class")
    return summed.select(
        F.col("class").alias("conv_id"), "depth", F.when(first, F.col("parent")).otherwise(F.col("class")).alias("parent_conv_id"), F.col("m").alias("n_convs"), F.when(last, 0).otherwise(1).cast("long").alias("n_children"),
        F.lit(1).cast("long").alias("n_leaves"), "saved_tokens", F.when(last, F.col("ends_sha256")).otherwise(F.lit(NOTHING)).alias("ends_sha256"), first.alias("first"),
    )


def _rolled_up(levels: list[DataFrame], chains: DataFrame, classes: DataFrame) -> DataFrame:
    """Branching nodes of all levels with the sums of their subtrees, deepest level first, and the nodes of the chains."""
    hashes = classes.select("class", "ends_sha256")
    zero = lambda c, x=0: F.coalesce(c, F.lit(x)).cast("long")
    out, children = chains.drop("first"), None
    for depth in range(len(levels) - 1, -1, -1):
        branching = levels[depth].where("k > 1")
        below = chains.where(F.col("first") & (F.col("depth") == depth + 1)).select("parent_conv_id", "n_leaves", "saved_tokens")
        if children is not None:
            below = below.unionByName(children.select(*below.columns))
        sums = below.groupBy(F.col("parent_conv_id").alias("node")).agg(F.count("*").alias("n_children"), F.sum("n_leaves").alias("n_leaves"), F.sum("saved_tokens").alias("saved"))
        # one class at most ends in a node
        ended = branching.where(F.col("length") == depth).select("node", "class").join(hashes, "class").select("node", "ends_sha256")
        joined = branching.where("class = node").join(sums, "node", "left").join(ended, "node", "left")
        saved = zero(F.col("saved")) + (F.col("n_convs") - 1) * F.col("bytes")
        children = joined.select(
            F.col("node").alias("conv_id"), F.lit(depth).cast("long").alias("depth"), F.col("parent").alias("parent_conv_id"), "n_convs", zero(F.col("n_children")).alias("n_children"),
            zero(F.col("n_leaves"), 1).alias("n_leaves"), saved.cast("long").alias("saved_tokens"), F.coalesce("ends_sha256", F.lit(NOTHING)).alias("ends_sha256"),
        )
        children = stored(children)
        out = out.unionByName(children)
    return out.select(*COLUMNS)


class _Listed:
    """Hash of a comma-joined list of numbers that arrive in order."""

    def __init__(self) -> None:
        self.hash, self.any = hashlib.sha256(), False

    def add(self, value: int) -> None:
        self.hash.update(f"{',' if self.any else ''}{value}".encode())
        self.any = True
