"""Cuts by order statistics, alias tables, Skellam masses and proportional fits against brute force."""

import hashlib
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from sylvaframe.functions import scalars
from sylvaframe.operators import partition, weights


def places(keys, seed=0):
    """Place of each key in the shuffled order."""
    order = sorted(keys, key=lambda k: (hashlib.md5(f"{seed}:{k}".encode()).hexdigest(), k))
    return {k: i for i, k in enumerate(order)}


@pytest.fixture(scope="module")
def skewed(spark):
    """One class holds nine of ten rows, one a single row."""
    return spark.range(3000).select(F.col("id").alias("k"), F.when(F.col("id") == 7, "lone").when(F.col("id") % 10 > 0, "hot").when(F.col("id") % 20 == 0, None).otherwise("cold").alias("c"))


def test_cuts_equal_a_full_sort(spark, skewed):
    groups = {}
    for k, c in skewed.collect():
        groups.setdefault(c, []).append(k)
    want = {}
    for c, keys in groups.items():
        n, at = len(keys), places(keys)
        shares = weights.largest_remainder(n, [1] * 7)
        ends = np.cumsum(shares)
        want |= {k: int(np.searchsorted(ends, at[k], side="right")) for k in keys}
    found = dict(partition.balanced_partition(skewed, "c", "k", 7).select("k", "rank").collect())
    assert found == want
    split = dict(partition.train_test_split(skewed, "k", stratify="c").select("k", "split").collect())
    assert sum(v == "test" for v in split.values()) == 750
    for keys in groups.values():
        at = places(keys)
        tests = sorted(at[k] for k in keys if split[k] == "test")
        assert tests == list(range(len(tests)))


def test_only_ranges_with_a_cut_are_ordered(spark, skewed):
    placed = partition._cut(skewed, "k", 0, "c", lambda totals: totals.select(F.col("class").alias("c_class"), (F.col("n") / 2).cast("long").alias("at")))
    halves = placed.groupBy("class").agg(F.sum("cut").alias("high"), F.count("*").alias("n")).collect()
    assert all(r["high"] == r["n"] - r["n"] // 2 for r in halves)
    plan = placed._jdf.queryExecution().optimizedPlan().toString().splitlines()
    windows = [i for i, line in enumerate(plan) if "row_number()" in line and "Window [" in line]
    assert len(windows) == 1
    # what is ordered is the join below it, of ranges with a cut inside
    assert any("Filter" in line and "size(" in line for line in plan[windows[0] + 1 :])


def test_repeated_keys_and_many_ranks(spark):
    same = spark.range(500).select(F.lit(1).alias("k"), F.lit("a").alias("c"))
    assert sorted(r["count"] for r in partition.balanced_partition(same, "c", "k", 3).groupBy("rank").count().collect()) == [166, 167, 167]
    few = spark.range(10).select(F.col("id").alias("k"), F.lit("a").alias("c"))
    assert sorted(r["rank"] for r in partition.balanced_partition(few, "c", "k", 1000).collect()) == list(range(990, 1000))


def test_alias_tables_hold_the_weights():
    for w in ([1.0], [0, 3], [1, 2, 3, 4], [0.1] * 7 + [0, 0], list(range(1, 1001))):
        keep, alias = weights.alias_table(w)
        share = np.zeros(len(w))
        for i, (k, a) in enumerate(zip(keep, alias, strict=True)):
            share[i] += k / len(w)
            share[a] += (1 - k) / len(w)
        assert share == pytest.approx(np.array(w) / sum(w), abs=1e-12)
    with pytest.raises(ValueError):
        weights.alias_table([0, 0])


def test_skellam_masses():
    for mu, reach in ((0.5, 40), (2.0, 1500), (300.0, 400)):
        i = np.arange(0, int(mu + 40 * math.sqrt(mu) + 60))
        poisson = np.exp(i * math.log(mu) - mu - np.array([math.lgamma(x + 1) for x in i]))
        both = np.convolve(poisson, poisson[::-1])
        ks = np.arange(-reach, reach + 1)
        want = np.array([both[len(i) - 1 + k] if abs(k) < len(i) else 0.0 for k in ks])
        found = weights.skellam_pmf(ks, mu)
        assert (found >= 0).all() and found == pytest.approx(want, abs=1e-14) and found.sum() == pytest.approx(1)
    for mu in (1e5, 1e6):  # nearly a normal law
        assert weights.skellam_pmf(np.array([0]), mu)[0] == pytest.approx(1 / math.sqrt(4 * math.pi * mu), rel=1e-5)
    many = weights.skellam_class_weights(2.0, 3000, 5)
    assert (many >= 0).all() and many.sum() == pytest.approx(1) and many.argmax() == 5


def test_fits_that_do_not_exist_raise():
    with pytest.raises(ValueError):
        weights.proportional_fit(np.eye(2), [1, 1], [3, 1], most=50)


def test_constant_size_fits_the_counts(spark):
    df = spark.range(2000).select(F.col("id").alias("k"), (F.col("id") % 7 * (F.col("id") % 2)).cast("string").alias("c"))
    ranked = partition.skellam_partition(df, "c", "k", 4, 1.0, True)
    sizes = [r["count"] for r in ranked.groupBy("rank").count().collect()]
    assert max(sizes) - min(sizes) <= 7  # a row a class


def test_tree_counts_as_expressions(spark):
    df = spark.range(40).crossJoin(spark.range(1, 9).withColumnRenamed("id", "ranks"))
    share = scalars.tree_share(F.col("id"), F.col("ranks"), F.col("rank"))
    strong, weak = (scalars.scaled_trees(F.col("id"), F.col("ranks"), kind) for kind in ("strong", "weak"))
    rows = df.withColumn("rank", F.explode(F.sequence(F.lit(0), F.col("ranks") - 1))).select("*", share.alias("n"), F.array(*strong, *weak).alias("scaled")).collect()
    for r in rows:
        assert r["n"] == weights.tree_counts(r["id"], r["ranks"])[r["rank"]]
        assert r["scaled"] == [*weights.scaled_trees(r["id"], r["ranks"], "strong"), *weights.scaled_trees(r["id"], r["ranks"], "weak")]
