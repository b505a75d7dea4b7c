"""Places of rows by file, runs that broke, times by rank, transforms of clusters and level-wise experiments."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from sylvaframe.operators import forest, partition
from sylvaframe.plans import experiments, runner
from sylvaframe.sources import datasets


def key(trees):
    return sorted(map(str, trees.select(*[c.split()[0] for c in forest.TREE_SCHEMA.split(", ")]).collect()))


@pytest.mark.parametrize("block", ["1k", "64m"])
def test_reading_order_over_files_and_blocks(spark, tmp_path, block):
    sizes = [300, 0, 1, 700, 40]  # one file without rows
    start = 0
    for i, n in enumerate(sizes):
        with open(tmp_path / f"part-{i}.csv", "w") as f:
            f.writelines(f"{start + j},{'x' * (j % 23)}\n" for j in range(n))
        start += n
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", block)
    try:
        df = spark.read.csv(str(tmp_path), schema="i int, row string")
        for n in (0, 1, 41, 400, sum(sizes), 5000):
            cut = max(0, sum(sizes) - n)
            got = partition.tail_split(df, n).select("i", "split").collect()
            assert len(got) == sum(sizes) and all((r["i"] >= cut) == (r["split"] == "test") for r in got)
            assert sorted(r["i"] for r in partition.first_rows(df, n).collect()) == list(range(min(n, sum(sizes))))
        odd = df.where("i % 2 = 1").select("i")
        assert sorted(r["i"] for r in partition.first_rows(odd, 200).collect()) == list(range(1, 400, 2))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_reading_order_of_parquet_and_of_no_rows(spark, tmp_path):
    path = str(tmp_path / "p")
    spark.range(1000).repartitionByRange(5, "id").sortWithinPartitions("id").write.parquet(path)
    df = spark.read.parquet(path)
    assert sorted(r[0] for r in partition.first_rows(df, 333).collect()) == list(range(333))
    assert partition.tail_split(df.where("id < 0"), 3).count() == 0


@pytest.fixture(scope="module")
def ranked(spark):
    data = datasets.generate(spark, 160, 8, 3, seed=4, n_informative=6)
    return partition.balanced_partition(data, "label", "sample_id", 4).cache()


def test_a_broken_run_goes_on_and_equals_a_whole_one(spark, ranked, tmp_path):
    path, settings = str(tmp_path), (3, 6, str(tmp_path), "u", 4, 1, False)
    whole = forest.train(ranked, 3, 6, 4, 1, replicated=False).cache()
    first = forest.train_resumable(ranked, *settings, only=[0, 2])
    assert key(first) == key(whole.where("rank in (0, 2)"))
    with pytest.raises(ValueError):  # two ranks are missing
        forest.load(spark, path, "u", 4)
    # what a wave that broke before its commit leaves does not count
    whole.where("rank = 1").limit(2).withColumn("seconds", F.lit(1.0)).write.mode("append").partitionBy("rank").parquet(f"{path}/run_uid=u")
    seconds = {r["rank"]: r["seconds"] for r in forest.manifest(spark, path, "u").collect()}
    assert key(forest.train_resumable(ranked, *settings, only=[0])) == key(whole.where("rank = 0"))
    assert key(forest.train_resumable(ranked, *settings, wave=1)) == key(whole) == key(forest.load(spark, path, "u", 4))
    after = {r["rank"]: r["seconds"] for r in forest.manifest(spark, path, "u").collect()}
    assert sorted(after) == [0, 1, 2, 3] and all(after[r] == s for r, s in seconds.items()) and min(after.values()) > 0
    for other in ((ranked.limit(100), *settings), (ranked, 3, 7, *settings[2:])):
        with pytest.raises(ValueError):
            forest.train_resumable(*other)
    with pytest.raises(ValueError):
        forest.train_resumable(ranked, *settings[:5], None, False)


def test_lost_and_repeated_nodes_are_noticed(spark, ranked, tmp_path):
    trees = forest.train(ranked, 3, 4, 2, 1).cache()
    forest.save(trees, str(tmp_path), "u")
    assert key(forest.load(spark, str(tmp_path), "u", 2)) == key(trees)
    forest.save(trees.where("tree_id < 3"), str(tmp_path), "u")  # overwritten as a whole
    assert forest.load(spark, str(tmp_path), "u", 2).select("tree_id").distinct().count() == 3
    trees.where("rank = 1").write.mode("append").partitionBy("rank").parquet(f"{tmp_path}/run_uid=u")
    with pytest.raises(ValueError):
        forest.load(spark, str(tmp_path), "u", 2)
    forest.save(trees.where("rank = 0"), str(tmp_path), "v", 2)  # a rank without a tree
    assert key(forest.load(spark, str(tmp_path), "v", 2)) == key(trees.where("rank = 0"))
    forest.save(trees.where("false"), str(tmp_path), "w", 1)
    assert forest.load(spark, str(tmp_path), "w", 1).count() == 0


def test_times_are_taken_by_rank(spark, ranked):
    timed = forest.train(ranked, 3, 6, 4, 1, replicated=False, timed=True).cache()
    assert timed.where("(seconds is null) = (node_id = 0)").count() == 0
    times = {r[0]: r[1] for r in forest.times_by_rank(timed).collect()}
    assert sorted(times) == [0, 1, 2, 3] and min(times.values()) > 0
    assert key(timed) == key(forest.train(ranked, 3, 6, 4, 1, replicated=False))


def test_experiment_writes_times_by_rank_and_resumes(spark, tmp_path):
    data = datasets.generate(spark, 120, 8, 3, seed=1, n_informative=5)
    x = runner.Experiment(3, 4, 2, "distributed", seed=1)
    out = runner.run_experiment(spark, data, x, str(tmp_path / "m"))
    of = lambda results: {r["comm_rank"]: r["time_sec_training"] for r in results.collect()}
    times = of(out.results)
    assert times["global"] == pytest.approx((times["0"] + times["1"]) / 2) and times["0"] != times["1"] and min(times.values()) > 0
    resumed = runner.run_experiment(spark, data, x, str(tmp_path / "m"), uid=out.uid)
    assert of(resumed.results) == times and key(resumed.trees) == key(out.trees)
    again = experiments.read_results(spark, runner.write_outcome(out, str(tmp_path / "o"), n_classes=3) + "_results.csv")
    assert {r["comm_rank"]: r["time_sec_training"] for r in again.collect()} == pytest.approx(times)
    assert os.path.isdir(tmp_path / "m" / f"run_uid={out.uid}")


@pytest.mark.parametrize("mode", ["replicated", "distributed"])
def test_experiment_grown_by_levels(spark, tmp_path, mode):
    data = datasets.generate(spark, 240, 6, 2, seed=1, n_informative=4, flip_y=0.0, class_sep=3.0)
    x = runner.Experiment(2, 6, 2, mode, seed=1, grower="levels", n_bins=16)
    out = runner.run_experiment(spark, data, x, str(tmp_path))
    scores = [r["accuracy_global_test"] for r in out.results.collect()]
    assert min(scores) > 0.8 and "time_sec_training_wall" in out.results.columns and "time_sec_training" not in out.results.columns
    again = runner.evaluate_checkpoint(spark, data, x, str(tmp_path), out.uid)
    assert [r["accuracy_global_test"] for r in again.results.collect()] == scores
    with pytest.raises(ValueError):
        runner.Experiment(2, grower="other")


def test_clusters_have_the_covariance_of_their_matrices(spark):
    n = 3
    made = datasets.generate(spark, 60_000, 3, 2, seed=7, n_informative=n, flip_y=0.0, class_sep=4.0).toPandas()
    matrices, seen = datasets.cluster_matrices(7, 2, n), []
    assert not np.allclose(matrices[0].T @ matrices[0], np.eye(n), atol=0.2)
    for label in (0, 1):
        x = np.stack(made[made["label"] == label]["features"].to_numpy())
        seen.append(np.cov(x.T))
        expected = matrices[label].T @ matrices[label]
        assert np.allclose(seen[-1], expected, atol=0.05 * np.abs(expected).max())
        assert np.allclose(np.abs(x.mean(axis=0)), 4.0, atol=0.05)  # a vertex
    assert not np.allclose(seen[0], seen[1], atol=0.05)


def test_transform_of_odd_rows(spark):
    rows = [(0, [1.0, 2.0], "a"), (1, [1.0, 2.0], "b"), (5, [1.0, 2.0], "c"), (None, [1.0, 2.0], "d"), (0, None, "e"), (0, [None, 2.0], "f")]
    df = spark.createDataFrame(rows, "row int, v array<double>, c_cluster string")
    got = {r["c_cluster"]: r["v"] for r in datasets.transform_clusters(df, "row", "v", [[[1, 0], [3, 1]], [[0, 1], [1, 0]]]).collect()}
    assert got == {"a": [7.0, 2.0], "b": [2.0, 1.0], "c": None, "d": None, "e": [None, None], "f": [None, None]}


def test_tables_are_collected_by_thread(spark):
    """A table that another thread stores meanwhile is not put on this one's list; nested blocks both have the inner one's."""
    from concurrent.futures import ThreadPoolExecutor

    from sylvaframe.sources.shared import collected, exists, owner_of, stored

    with ThreadPoolExecutor(1) as pool, collected() as outer:
        other = pool.submit(lambda: stored(spark.range(3))).result()
        mine = stored(spark.range(5))
        with collected() as inner:
            last = stored(spark.range(7))
    assert outer == [mine._stored_at, last._stored_at] and inner == [last._stored_at]
    owner = owner_of(mine, outer)
    assert owner.count() == 5
    del owner
    assert not exists(spark, mine._stored_at) and exists(spark, other._stored_at) and other.count() == 3
