"""Level-wise training and relational walks against trees grown and walked one by one."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from sylvaframe.operators import forest, levelwise

EDGES = [[float(e) for e in range(7)]] * 5


def data(n, seed, classes=3):
    rng = np.random.RandomState(seed)
    x = rng.randint(0, 8, (n, 5))
    x[:, 4] = 3  # constant
    y = np.where(x[:, 0] > 3, 1, 0) + (x[:, 1] % 2) * (rng.rand(n) < 0.6)
    return x, np.minimum(y, classes - 1)


def frame(spark, x, y, rank=None):
    return spark.createDataFrame([(i, list(map(float, v)), int(c), int(rank[i]) if rank is not None else 0) for i, (v, c) in enumerate(zip(x, y, strict=True))], "sample_id long, features array<double>, label int, rank int")


class Ordered:
    """Stands in for the generator of grow_tree: tries features in a given order."""

    def __init__(self, order):
        self.order = order

    def permutation(self, n):
        return np.array(self.order)


def orders_of(spark, model, seeds):
    rows = [(r["tree_id"], r["node_id"], seeds[r["tree_id"]]) for r in model]
    df = spark.createDataFrame(rows, "tree_id int, node_id int, seed long")
    return {(r["tree_id"], r["node_id"]): r["o"] for r in df.select("*", levelwise.feature_order(F.col("seed"), F.col("tree_id"), F.col("node_id"), 5).alias("o")).collect()}


@pytest.mark.parametrize("bootstrap", [False, True])
def test_each_split_is_that_of_grow_tree(spark, bootstrap):
    x, y = data(120, 1)
    rank = np.arange(120) % 3 % 2  # rank 0 holds two thirds
    model = levelwise.train_by_level(frame(spark, x, y, rank), 3, 3, EDGES, n_ranks=2, seed=5, replicated=False, bootstrap=bootstrap).collect()
    seeds = {t: (s + 7919 * i) % 2**32 for (t, i), s in zip(((0, 0), (1, 1), (2, 0)), [forest.rank_seeds(5, 2)[r] for r in (0, 0, 1)], strict=True)}
    assert {(r["rank"], r["tree_id"]) for r in model} == {(0, 0), (0, 1), (1, 2)}
    orders = orders_of(spark, model, seeds)
    for tree, of in ((0, 0), (1, 0), (2, 1)):
        nodes = {r["node_id"]: r for r in model if r["tree_id"] == tree}
        own = np.flatnonzero(rank == of)
        if bootstrap:
            keys = spark.createDataFrame([(int(i),) for i in own], "k long")
            drawn = dict(keys.select("k", levelwise.bootstrap_weight(F.lit(seeds[tree]).cast("long"), F.lit(tree), F.col("k"))).collect())
            own = np.repeat(own, [drawn[i] for i in own])
        todo, seen = [(0, own)], set()
        while todo:
            at, rows = todo.pop()
            node = nodes[at]
            seen.add(at)
            want = forest.grow_tree(x[rows].astype(float), y[rows], 3, Ordered(orders[tree, at]), bootstrap=False)[0]
            assert node["votes"] == pytest.approx(want[5])
            if want[1] < 0:
                assert node["left"] == -1
                continue
            values = x[rows, want[1]]
            assert (node["feature"], node["threshold"]) == (want[1], values[values <= want[2]].max())
            todo += [(node["left"], rows[values <= want[2]]), (node["right"], rows[values > want[2]])]
        assert seen == set(nodes) == set(range(len(nodes)))


def test_bins_and_edges(spark):
    df = spark.createDataFrame([(float(i % 10), float(i)) for i in range(1000)], "a double, b double").select(F.array("a", "b").alias("features"))
    edges = levelwise.bin_edges(df, 16)
    assert edges[0] == [float(i) for i in range(10)] and len(edges[1]) == 15
    bins = df.select("features", levelwise.binned(F.col("features"), edges).alias("x")).collect()
    for r in bins:
        for f in range(2):
            assert all((r["features"][f] <= e) == (r["x"][f] <= b) for b, e in enumerate(edges[f]))
    odd = spark.createDataFrame([([None, float("nan")],)], "features array<double>")
    assert odd.select(levelwise.binned(F.col("features"), edges)).first()[0] == [10, 15]


def test_accuracy_replicas_and_empty_ranks(spark):
    x, y = data(400, 2)
    df = frame(spark, x, y)
    trees = levelwise.stored(levelwise.train_by_level(df, 3, 4, EDGES, n_ranks=2, seed=1, max_depth=3))
    assert forest.score(df, trees, 3) > 0.7
    assert {r[0] for r in trees.select("rank").distinct().collect()} == {0, 1}
    alone = levelwise.train_by_level(df, 3, 4, EDGES, n_ranks=2, seed=1, replicated=False, max_depth=0)  # rank 1 has no rows
    assert {(r["rank"], r["node_id"], r["left"]) for r in alone.collect()} == {(0, 0, -1)}
    assert levelwise.train_by_level(df.where("false"), 3, 2, EDGES).count() == 0


@pytest.mark.parametrize("sent", [True, False])
def test_walks_by_joins_vote_like_the_forest(spark, monkeypatch, sent):
    rng = np.random.RandomState(3)
    x, y = rng.rand(25, 5), rng.randint(0, 3, 25)
    rows = [(r, r, *n) for r in range(2) for n in forest.grow_tree(x, y, 3, np.random.RandomState(r))]
    trees = spark.createDataFrame(rows, forest.TREE_SCHEMA)
    if not sent:
        monkeypatch.setattr(levelwise, "PART_NODES", 1)
    df = frame(spark, x, y)
    for voting in ("rounded", "hard"):
        want = {r["sample_id"]: r["votes"] for r in forest.vote(df, trees, 3, by_rank=True, voting=voting).collect()}
        for r in levelwise.votes_by_joins(df, trees, 3, voting=voting).collect():
            assert r["votes"] == pytest.approx(want[r["sample_id"]][r["rank"]])


@pytest.mark.parametrize("part_nodes", [1, 6, 1_000_000])
def test_each_level_of_a_large_model_is_sent_once_or_joined(spark, monkeypatch, part_nodes):
    rng = np.random.RandomState(5)
    x, y = rng.rand(60, 5), rng.randint(0, 3, 60)
    rows = [(0, t, *n) for t in range(2) for n in forest.grow_tree(x, y, 3, np.random.RandomState(t))]
    chain = 9  # levels of one inner node each, more than a stage walks
    rows += [(0, 2, i, 0, 1.0 - 0.1 * i, i + 1, chain + 1 + i, [1.0]) for i in range(chain)] + [(0, 2, i, -1, 0.0, -1, -1, [1.0]) for i in range(chain, 2 * chain + 1)]
    trees = spark.createDataFrame(rows, forest.TREE_SCHEMA)
    monkeypatch.setattr(levelwise, "PART_NODES", part_nodes)
    monkeypatch.setattr(levelwise, "SENT_PARENTS", part_nodes)
    levels = levelwise.levels_of(trees)
    assert sum(n for _, n in levels) == sum(r[5] >= 0 for r in rows) and levelwise.depth_of(trees) == len(levels) >= chain
    walked = levelwise.leaves(frame(spark, x, y), trees)
    nodes = {(r[1], r[2]): r for r in rows}
    for r in walked.collect():
        at = 0
        while (node := nodes[r["tree_id"], at])[5] >= 0:
            at = node[5] if x[r["sample_id"], node[3]] <= node[4] else node[6]
        assert r["node_id"] == at
    assert walked.count() == 3 * 60
    # a level larger than PART_NODES does not reach the driver, however small Spark takes it for
    above = levelwise.stored(spark.createDataFrame([(0, t, i, 0, 0.5, 1 if i == 0 else -1, 2 if i == 0 else -1, [1.0]) for t in range(2) for i in range(3)], forest.TREE_SCHEMA))
    plan = levelwise.leaves(frame(spark, x, y), above)._jdf.queryExecution().executedPlan().toString()
    assert ("SortMergeJoin" in plan) == (part_nodes == 1)
