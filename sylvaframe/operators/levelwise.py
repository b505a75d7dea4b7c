"""Random forests grown and walked level by level as Spark plans, for ranks and models of any size.

Training holds one row per (sample, tree) with the node that it is in. A level is one histogram over (rank, tree, node, feature, bin, class), which
is aggregated before it is shuffled, the best cut of each node by prefix sums over its bins, and a join that moves the rows to their
children. Nothing of a rank, tree or node is gathered in one task.

A walk moves (sample, tree, node) by one join with the inner nodes a level and stays in the JVM.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import stored
from .forest import PART_NODES, TREE_SCHEMA
from .weights import rank_seeds, tree_counts

_NODE = ["rank", "tree_id", "node_id"]
#: Nodes of a level that are sent to find the nodes of the next one.
SENT_PARENTS = 50_000
#: Levels that are walked in one stage: the code of longer ones is not compiled by the JVM and takes twice the time.
STAGE_LEVELS = 5
#: Weights of a sample in a bootstrap: Poisson(1) by inversion, of which larger ones have a chance below 1e-9.
_POISSON = [0.36787944117144233, 0.7357588823428847, 0.9196986029286058, 0.9810118431238462, 0.9963401531726563, 0.9994058151824183, 0.9999167588507119, 0.9999898050803253, 0.9999988747974020, 0.9999998885745217, 0.9999999899522337]


def bin_edges(df: DataFrame, n_bins: int = 64, features: str = "features", accuracy: int = 10_000) -> list[list[float]]:
    """Upper edges of the bins of each feature by approximate quantiles, ascending and distinct; n_bins - 1 numbers a feature at most reach the driver."""
    width = df.agg(F.max(F.size(features))).first()[0] or 0
    shares = [i / n_bins for i in range(1, n_bins)]
    row = df.agg(*[F.percentile_approx(F.col(features)[i].cast("double"), shares, accuracy).alias(f"q{i}") for i in range(width)]).first() if width else []
    return [sorted(set(q or [])) for q in row]


def binned(features: Column, edges: Sequence[Sequence[float]]) -> Column:
    """Bin of each element: the number of edges below it, so that bin <= b just where the value is at most edge b. Null and NaN go to the last bin."""

    def bin_of(i: int) -> Column:
        value, own = features[i].cast("double"), F.array(*[F.lit(float(e)) for e in edges[i]]).cast("array<double>")
        return F.when(value.isNull(), F.lit(len(edges[i]))).otherwise(F.size(F.filter(own, lambda e: e < value))).cast("int")

    return F.array(*[bin_of(i) for i in range(len(edges))])


def bootstrap_weight(seed: Column, tree: Column, key: Column) -> Column:
    """How often a sample is drawn into a tree, by a hash of its key."""
    u = (F.pmod(F.xxhash64(seed, tree, key, F.lit("draw")), F.lit(1 << 52)) + F.lit(0.5)) / float(1 << 52)
    return F.size(F.filter(F.array(*[F.lit(p) for p in _POISSON]), lambda p: p <= u)).cast("long")


def feature_order(seed: Column, tree: Column, node: Column, width: int) -> Column:
    """The features in the order in which a node tries them."""
    drawn = F.transform(F.sequence(F.lit(0), F.lit(width - 1)), lambda f: F.struct(F.xxhash64(seed, tree, node, f).alias("h"), f.alias("f")))
    return F.transform(F.array_sort(drawn), lambda s: s["f"])


def best_splits(rows: DataFrame, n_classes: int, tried: int, width: int) -> DataFrame:
    """rows(rank, tree_id, node_id, seed, w, y, x) of one level -> the best cut of each node that has one.

    (rank, tree_id, node_id, feature, bin, score): rows with x[feature] <= bin go left. A node tries its first tried features, and further ones up to the
    first that is not constant; of equal scores the feature tried first wins, then the lowest bin. score is the sum over both sides of
    squared class weights by weight, which is greatest where gini impurity is least.
    """
    order = feature_order(F.col("seed"), F.col("tree_id"), F.col("node_id"), width)
    nodes = rows.groupBy(*_NODE).agg(F.min("seed").alias("seed"), *[F.sum(F.when(F.col("y") == c, F.col("w")).otherwise(0)).alias(f"t{c}") for c in range(n_classes)])
    mixed = nodes.where(sum(((F.col(f"t{c}") > 0).cast("int") for c in range(n_classes)), F.lit(0)) > 1)
    asked = stored(mixed.withColumn("order", order))
    first = _cuts(rows, asked.select(*_NODE, F.posexplode(F.slice("order", 1, tried)).alias("nth", "feature")), n_classes)
    found = stored(_best(first))
    if tried >= width:
        return found
    rest = asked.join(found.select(*_NODE), _NODE, "left_anti")
    if rest.isEmpty():
        return found
    later = _cuts(rows, rest.select(*_NODE, F.posexplode(F.slice("order", tried + 1, width)).alias("nth", "feature")), n_classes)
    # of these only the first feature that can be cut counts
    nearest = Window.partitionBy(*_NODE)
    return found.unionByName(_best(later.withColumn("near", F.min("nth").over(nearest)).where("nth = near").drop("near")))


def _cuts(rows: DataFrame, asked: DataFrame, n_classes: int) -> DataFrame:
    """The cuts between the bins that occur, for the (node, feature) pairs asked for, with their scores."""
    by_node = asked.groupBy(*_NODE).agg(F.collect_list(F.struct("nth", "feature")).alias("features"))
    paired = rows.select(*_NODE, "w", "y", "x").join(by_node, _NODE)
    each = paired.select(*_NODE, "w", "y", "x", F.explode("features").alias("f")).select(*_NODE, "w", "y", F.col("f.nth").alias("nth"), F.col("f.feature").alias("feature"), F.col("x")[F.col("f.feature")].alias("bin"))
    own = [*_NODE, "nth", "feature"]
    histogram = each.groupBy(*own, "bin").agg(*[F.sum(F.when(F.col("y") == c, F.col("w")).otherwise(0)).alias(f"c{c}") for c in range(n_classes)])
    upto = Window.partitionBy(*own).orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy(*own)
    sums = histogram.select(*own, "bin", *[F.sum(f"c{c}").over(upto).alias(f"l{c}") for c in range(n_classes)], *[F.sum(f"c{c}").over(whole).alias(f"s{c}") for c in range(n_classes)])
    left = [F.col(f"l{c}").cast("double") for c in range(n_classes)]
    right = [(F.col(f"s{c}") - F.col(f"l{c}")).cast("double") for c in range(n_classes)]
    side = lambda x: F.try_divide(sum((v * v for v in x), F.lit(0.0)), sum(x, F.lit(0.0)))
    # the last bin leaves nothing on the right
    return sums.withColumn("score", side(left) + side(right)).where("score is not null").select(*own, "bin", "score")


def _best(cuts: DataFrame) -> DataFrame:
    top = cuts.groupBy(*_NODE).agg(F.min_by(F.struct("feature", "bin", "score"), F.struct(-F.col("score"), F.col("nth"), F.col("bin"))).alias("b"))
    return top.select(*_NODE, F.col("b.feature").cast("int").alias("feature"), F.col("b.bin").cast("int").alias("bin"), F.col("b.score").alias("score"))


def train_by_level(
    df: DataFrame, n_classes: int, n_trees: int, edges: Sequence[Sequence[float]], n_ranks: int = 1, seed: int = 0, replicated: bool = True, key: str = "sample_id", features: str = "features",
    label: str = "label", rank: str = "rank", add_rank: bool = False, bootstrap: bool = True, tried: int | None = None, max_depth: int | None = None,
) -> DataFrame:
    """Tree table (TREE_SCHEMA) of fully grown trees on features cut at edges, as bin_edges() gives them.

    replicated: every rank sees all rows, else only its own. A tree draws each sample by a Poisson weight of a hash of its key (equal keys are drawn alike)
    and each node tries features in hashed order, so the model does not depend on partitions or order. tried defaults to the square root of the number of
    features. Rows without a label are left out. A rank without a drawn row has no tree; no rows give an empty table.
    """
    width = len(edges)
    tried = tried or max(1, int(width**0.5))
    counts, seeds = tree_counts(n_trees, n_ranks), rank_seeds(seed, n_ranks, add_rank)
    spark = df.sparkSession
    first = [sum(counts[:r]) for r in range(n_ranks)]
    # one row a tree
    trees = spark.createDataFrame([(r, first[r] + t, (seeds[r] + 7919 * t) % 2**32) for r in range(n_ranks) for t in range(counts[r])], "rank int, tree_id int, seed long")
    trees = F.broadcast(trees) if n_trees <= PART_NODES else trees
    base = df.where(F.col(f"`{label}`").isNotNull()).select(F.col(f"`{key}`").alias("key"), binned(F.col(f"`{features}`"), edges).alias("x"), F.col(f"`{label}`").cast("int").alias("y"), *([] if replicated else [F.col(f"`{rank}`").cast("int").alias("own")]))
    given = base.join(trees) if replicated else base.join(trees, F.col("own") == F.col("rank")).drop("own")
    weight = bootstrap_weight(F.col("seed"), F.col("tree_id"), F.col("key")) if bootstrap else F.lit(1).cast("long")
    rows = stored(given.withColumn("w", weight).where("w > 0").select("rank", "tree_id", F.lit(0).alias("node_id"), "seed", "w", "y", "x"))
    model, depth = [], 0
    totals = rows.select("rank", "tree_id").distinct().withColumn("used", F.lit(1))
    while not rows.isEmpty():
        splits = best_splits(rows, n_classes, tried, width) if max_depth is None or depth < max_depth else None
        shares = rows.groupBy(*_NODE).agg(F.sum("w").alias("n"), *[F.sum(F.when(F.col("y") == c, F.col("w")).otherwise(0)).alias(f"t{c}") for c in range(n_classes)])
        votes = F.array(*[F.col(f"t{c}") / F.col("n") for c in range(n_classes)])
        if splits is None:
            splits = shares.select(*_NODE, F.lit(0).alias("feature"), F.lit(0).alias("bin"), F.lit(0.0).alias("score")).where("false")
        # children are numbered on in the order of their parents
        nth = F.row_number().over(Window.partitionBy("rank", "tree_id").orderBy("node_id"))
        numbered = splits.withColumn("nth", nth).join(totals, ["rank", "tree_id"]).withColumn("left", (F.col("used") + 2 * (F.col("nth") - 1)).cast("int"))
        level = stored(shares.select(*_NODE, votes.alias("votes")).join(numbered.drop("nth", "used", "score"), _NODE, "left"))
        model.append(level)
        inner = level.where("left is not null").select(*_NODE, "feature", "bin", "left")
        totals = stored(totals.join(inner.groupBy("rank", "tree_id").agg(F.count("*").alias("k")), ["rank", "tree_id"], "left").select("rank", "tree_id", (F.col("used") + 2 * F.coalesce("k", F.lit(0))).cast("int").alias("used")))
        down = F.when(F.col("x")[F.col("feature")] <= F.col("bin"), F.col("left")).otherwise(F.col("left") + 1)
        rows = stored(rows.join(inner, _NODE).select("rank", "tree_id", down.alias("node_id"), "seed", "w", "y", "x"), replaces=rows)
        depth += 1
    if not model:
        return spark.createDataFrame([], TREE_SCHEMA)
    nodes = model[0]
    for level in model[1:]:
        nodes = nodes.unionByName(level)
    at_edge = F.coalesce(*[F.when((F.col("feature") == f) & (F.col("bin") < len(edges[f])), F.get(F.array(*[F.lit(float(e)) for e in edges[f]]), F.col("bin"))) for f in range(width) if edges[f]], F.lit(0.0)) if any(edges) else F.lit(0.0)
    none = F.lit(-1)
    return nodes.select("rank", "tree_id", "node_id", F.coalesce("feature", none).alias("feature"), at_edge.alias("threshold"), F.coalesce("left", none).alias("left"), F.coalesce(F.col("left") + 1, none).alias("right"), "votes")


def levels_of(trees: DataFrame, depth: int | None = None) -> list[tuple[DataFrame, int]]:
    """The inner nodes (t, n, feature, threshold, left, right) of each level from the roots down, stored, with their number; one number a level reaches the driver.

    Only levels of up to SENT_PARENTS nodes are sent to find those below them; Spark's own choice by size would send larger ones. depth: the levels wanted at most.
    """
    inner = trees.where("left >= 0").select(F.col("tree_id").alias("t"), F.col("node_id").alias("n"), "feature", "threshold", "left", "right")
    at, out = stored(inner.where("n = 0")), []
    while (depth is None or len(out) < depth) and (size := at.count()):
        out.append((at, size))
        below = at.select(F.col("t").alias("tree_id"), F.explode(F.array("left", "right")).alias("child"))
        below = F.broadcast(below) if size <= SENT_PARENTS else below.hint("merge")
        at = stored(inner.join(below, F.expr("tree_id = t and child = n"), "left_semi"))
    return out


def depth_of(trees: DataFrame) -> int:
    """Steps from a root to the farthest leaf."""
    return len(levels_of(trees))


def leaves(df: DataFrame, trees: DataFrame, key: str = "sample_id", features: str = "features", depth: int | None = None) -> DataFrame:
    """(key, rank, tree_id, node_id): the leaf of each sample in each tree, by one join with the inner nodes of a level each.

    A level of up to PART_NODES nodes is sent, once; up to STAGE_LEVELS levels of so many nodes together are walked in one stage without a shuffle, and the samples
    are stored before the next ones. Larger levels are joined by (tree, node). A null or NaN feature goes right. depth: steps that are known to be enough.
    """
    roots = trees.where("node_id = 0").select("rank", "tree_id")
    roots = F.broadcast(roots) if roots.count() <= PART_NODES else roots
    value = lambda: F.get(F.col("x"), F.col("feature"))
    down = F.when((value() <= F.col("threshold")) & ~F.isnan(value()), F.col("left")).otherwise(F.col("right"))
    at = df.select(F.col(f"`{key}`").alias("key"), F.col(f"`{features}`").cast("array<double>").alias("x")).join(roots).withColumn("node_id", F.lit(0))
    before, held = None, []  # held: the sizes of the levels of the stage so far
    for inner, size in levels_of(trees, depth):
        sent = size <= PART_NODES
        if held and (sum(held) + size > PART_NODES or len(held) >= STAGE_LEVELS):
            at = before = stored(at, replaces=before)
            held = []
        moved = at.join(F.broadcast(inner) if sent else inner.hint("merge"), F.expr("tree_id = t and node_id = n"), "left")
        at = moved.select("key", "x", "rank", "tree_id", F.coalesce(F.when(F.col("t").isNotNull(), down), F.col("node_id")).alias("node_id"))
        held.append(size)
    return at.select(F.col("key").alias(key), "rank", "tree_id", "node_id")


def votes_by_joins(df: DataFrame, trees: DataFrame, n_classes: int, key: str = "sample_id", features: str = "features", voting: str = "rounded", depth: int | None = None) -> DataFrame:
    """(key, rank, votes) by relational plans alone: the shares of the leaves of a rank's trees added up, voting as in vote(); keys must be distinct."""
    if voting not in ("rounded", "soft", "hard"):
        raise ValueError(voting)
    ends = trees.where("left < 0").select(F.col("tree_id").alias("t"), F.col("node_id").alias("n"), F.col("votes").alias("share"))
    ends = F.broadcast(ends) if trees.count() <= PART_NODES else ends
    met = leaves(df, trees, key, features, depth).join(ends, F.expr("tree_id = t and node_id = n"))
    top = F.array_position("share", F.array_max("share")) - 1
    value = (lambda c: (top == c).cast("double")) if voting == "hard" else (lambda c: F.col("share")[c])
    sums = met.groupBy(key, "rank").agg(*[F.sum(value(c)).alias(f"v{c}") for c in range(n_classes)])
    out = (lambda c: F.rint(f"v{c}")) if voting == "rounded" else (lambda c: F.col(f"v{c}"))
    return sums.select(key, "rank", F.array(*[out(c) for c in range(n_classes)]).alias("votes"))
