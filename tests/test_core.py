"""Metrics, weights, partitions and forests against hand-derived or brute-force values."""

import math
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from sylvaframe.functions import metrics
from sylvaframe.operators import forest, partition, stats, weights
from sylvaframe.plans import experiments, runner
from sylvaframe.sources import datasets


def table(spark, y, p):
    df = spark.createDataFrame(list(zip(map(int, y), map(int, p), strict=True)), "y int, p int")
    return metrics.confusion(df, "y", "p").cache()


@pytest.mark.parametrize("n", [2, 10, 100])
def test_metrics_all_right_wrong_zero(spark, n):
    y = [c for c in range(n) for _ in range(5)]
    right, wrong, zero = table(spark, y, y), table(spark, y, [(c + 1) % n for c in y]), table(spark, y, [0] * len(y))
    assert metrics.accuracy(right).first()[0] == 1 and metrics.accuracy(wrong).first()[0] == 0
    assert metrics.balanced_accuracy(zero).first()[0] == pytest.approx(1 / n)
    assert metrics.agreement(right).first()[:] == (1, 1)
    assert metrics.agreement(zero).first()["matthews"] == 0
    assert metrics.precision_score(zero, "macro").first()[0] is None
    assert metrics.f1_score(right, "weighted").first()[0] == 1


def test_sixty_percent_and_bad_average(spark):
    y = [c for c in range(4) for _ in range(5)]
    p = [c if i % 5 < 3 else (c + 1) % 4 for i, c in enumerate(y)]
    t = table(spark, y, p)
    for average in ("micro", "macro", "weighted"):
        assert [round(v, 9) for v in metrics.precision_recall_fbeta(t, 2.0, average).first()] == [0.6] * 3
    for bad in ("invalid", 1, True):
        with pytest.raises(ValueError):
            metrics.precision_recall_fbeta(t, average=bad)


def test_auc_with_ties(spark):
    rows = [(1, 0.9), (0, 0.9), (1, 0.5), (0, 0.1)]
    assert metrics.roc_auc(spark.createDataFrame(rows, "y int, s double"), "y", "s").first()[0] == pytest.approx(0.625)


def test_weights():
    assert weights.largest_remainder(10, [1, 1, 1]) == [3, 3, 4]
    with pytest.raises(ValueError):
        weights.largest_remainder(3, [0, 0])
    assert weights.skellam_class_weights(0, 5, 7).tolist() == [0, 0, 1, 0, 0]
    assert weights.skellam_class_weights("inf", 4).tolist() == [0.25] * 4
    w = weights.skellam_class_weights(2, 9, 4)
    assert w.argmax() == 4 and w.sum() == pytest.approx(1)
    # series of the Poisson difference
    series = sum(math.exp(-4) * 2**i / math.factorial(i) * 2 ** (i + 1) / math.factorial(i + 1) for i in range(60))
    assert weights.skellam_pmf(np.array([1]), 2)[0] == pytest.approx(series)
    fitted = weights.constant_size_weights(weights.skellam_rank_weights(4, 5, 2), [10, 20, 30, 40, 50])
    assert fitted.sum(axis=1) == pytest.approx([1] * 4)
    assert weights.tree_counts(10, 4) == [3, 3, 2, 2]


def test_partition_invariants(spark):
    df = spark.range(1003).select("id", (F.col("id") % 3).cast("int").alias("c"))
    ranked = partition.skellam_partition(df, "c", "id", 4, 2.0, constant_size=True).cache()
    assert ranked.count() == 1003 and ranked.where("rank is null").count() == 0
    sizes = [r["count"] for r in ranked.groupBy("rank").count().collect()]
    assert max(sizes) - min(sizes) <= 3
    split = partition.train_test_split(df, "id", 0.75).groupBy("split").count().collect()
    assert {r[0]: r[1] for r in split} == {"test": 251, "train": 752}


def test_forest_vote_checkpoint_and_equivalence(spark, tmp_path):
    data = datasets.generate(spark, 300, 12, 3, seed=4, n_informative=6, flip_y=0.0).cache()
    assert [r["count"] for r in data.groupBy("label").count().collect()] == [100] * 3
    trees = forest.train(data, 3, 6, 2, 1).cache()
    assert trees.select("tree_id").distinct().count() == 6
    whole = forest.evaluate(data, trees, 3)["scores"].first()["acc_global"]
    assert whole == pytest.approx(forest.score(data, trees, 3)) and whole > 0.9
    forest.save(trees, str(tmp_path), "u")
    again = forest.load(spark, str(tmp_path), "u", 2)
    votes = lambda t: sorted((r["sample_id"], r["votes"]) for r in forest.vote(data, t, 3).collect())
    assert votes(trees) == votes(again)
    with pytest.raises(ValueError):
        forest.load(spark, str(tmp_path), "u", 3)


def test_t_quantile_and_null_safe_join(spark):
    assert experiments.t_quantile_975(1) == pytest.approx(12.7062047364)
    assert experiments.t_quantile_975(10) == pytest.approx(2.2281388520)
    df = spark.createDataFrame([("a", 1.0), (None, 2.0), (None, 4.0)], "k string, local_x double")
    got = experiments.with_group_means(df, ["k"], ["local_x"]).collect()
    assert sorted(r["mean_local_x"] for r in got) == [1.0, 3.0, 3.0]


def test_csv_sources_and_published_split(spark, tmp_path):
    path = str(tmp_path / "higgs.csv")
    with open(path, "w") as f:
        f.writelines(",".join([f"{i % 2}.0", *[f"{i + j}.5" for j in range(28)]]) + "\n" for i in range(40))
    assert datasets.get_dataset("higgs", spark, path, high_level=False, subset=7).agg(F.count("*"), F.max(F.size("features"))).first()[:] == (7, 21)
    split = datasets.read_higgs_original_split(spark, path, n_test=15)
    got = sorted((r["features"][0], r["split"]) for r in split.collect())
    assert got == [(i + 0.5, "test" if i >= 25 else "train") for i in range(40)]
    for n, expected in ((0, {"train": 40}), (99, {"test": 40})):
        assert {r[0]: r[1] for r in partition.tail_split(spark.range(40), n).groupBy("split").count().collect()} == expected
    with pytest.raises(ValueError):
        datasets.get_dataset("none", spark, path)


def test_serial_results_get_parallel_columns(spark, tmp_path):
    df = spark.createDataFrame([("0.5", "0.75")], "accuracy_test string, accuracy_train string")
    path = experiments.write_results(df, str(tmp_path / "r"))
    assert os.path.isfile(path) and path.endswith("/r.csv")
    got = experiments.read_results(spark, path).first().asDict()
    assert got == {"result_filename": "r.csv", "accuracy_global_test": 0.5, "accuracy_local_test": 0.5, "accuracy_global_train": 0.75, "accuracy_local_train": 0.75}


def test_null_and_unlisted_classes(spark):
    rows = [(i, "ab"[i % 2] if i % 5 else None, "clash") for i in range(100)]
    df = spark.createDataFrame(rows, "id long, c string, __h string")
    ranked = partition.balanced_partition(df, "c", "id", 3)
    assert ranked.columns == ["id", "c", "__h", "rank"] and ranked.count() == 100
    assert sorted(r["count"] for r in ranked.where("c is null").groupBy("rank").count().collect()) == [6, 7, 7]
    for f in (partition.assign_ranks, partition.sampled_partition):
        with pytest.raises(RuntimeError):
            f(df, "c", "id", 2, [[1.0, 1.0], [1.0, 1.0]], 0, ["a", "b"])
        assert f(df, "c", "id", 2, [[1.0, 1.0, 0.0], [1.0, 1.0, 1.0]], 0, ["a", "b", None]).where("c is null and rank = 0").count() == 0
        assert f(df, "c", "id", 2, [[1.0] * 3] * 2).count() == 100
    with pytest.raises(ValueError):
        partition.assign_ranks(df, "c", "id", 2, [[1.0, 0.0, 1.0], [1.0, 0.0, 1.0]], 0, ["a", "b", None])
    for split in (partition.train_test_split(df, "id", 0.75, 0, "c"), partition.train_test_split(df, "id", 0.75, 0, within="c"), partition.train_test_split(df, "id", 0.75)):
        assert {r[0]: r[1] for r in split.groupBy("split").count().collect()} == {"test": 25, "train": 75}
    assert partition.balanced_partition(df.limit(0), "c", "id", 3).count() == partition.train_test_split(df.limit(0), "id", 0.5, 0, "c").count() == 0
    with pytest.raises(RuntimeError):
        partition.partition_class_wise(df, "c", "id", 2, lambda c, pos, n: F.when(pos > 0, 0))
    lists = partition.indices_by_rank(ranked, "id").collect()
    assert sorted(i for r in lists for i in r.indices) == list(range(100))


def test_even_rank_is_largest_remainder(spark):
    for n, ranks in ((10, 3), (2, 5), (12, 4)):
        got = [r[0] for r in spark.range(n).select(partition.even_rank(F.col("id"), F.lit(n), ranks)).collect()]
        assert [got.count(r) for r in range(ranks)] == weights.largest_remainder(n, [1.0] * ranks)


def test_auc_by_group_and_many_scores(spark):
    r = np.random.RandomState(1)
    rows = [(int(g), int(y), float(np.round(s, 2))) for g, y, s in zip(r.randint(0, 3, 900), r.randint(0, 2, 900), r.randn(900))] + [(9, 1, 0.5)]
    by = {x["g"]: x["auc"] for x in metrics.roc_auc(spark.createDataFrame(rows, "g int, y int, s double"), "y", "s", "g").collect()}
    for g in range(3):
        pos, neg = ([s for k, y, s in rows if k == g and y == c] for c in (1, 0))
        assert by[g] == pytest.approx(np.mean([(a > b) + (a == b) / 2 for a in pos for b in neg]))
    assert by[9] is None


def test_large_models_vote_in_parts_whatever_the_arrival(spark, monkeypatch):
    data = datasets.generate(spark, 120, 8, 3, seed=4, n_informative=6).cache()
    ranked = partition.balanced_partition(data, "label", "sample_id", 2)
    trees = forest.train(ranked, 3, 5, 2, 1, replicated=False).cache()
    again = forest.train(ranked.repartition(5, "sample_id"), 3, 5, 2, 1, replicated=False)
    key = lambda t: sorted(map(str, t.collect()))
    assert key(trees) == key(again)
    whole = key(forest.vote(data, trees, 3, by_rank=True))
    monkeypatch.setattr(forest, "PART_NODES", 10)
    assert key(forest.vote(data, trees, 3, by_rank=True)) == whole


def test_private_test_rows_are_judged_by_their_own_rank(spark):
    leaf = lambda c: [float(i == c) for i in range(2)]
    trees = spark.createDataFrame([(r, r, 0, -1, 0.0, -1, -1, leaf(r)) for r in (0, 1)], forest.TREE_SCHEMA)
    rows = spark.createDataFrame([([0.0], r, r) for r in (0, 1) for _ in range(3)], "features array<double>, label int, rank int")
    scores = {r["rank"]: r for r in forest.evaluate(rows, trees, 2, private=True)["scores"].collect()}
    assert [scores[r]["acc_local"] for r in (0, 1)] == [1, 1] and [scores[r]["acc_global_local"] for r in (0, 1)] == [1, 0] and scores[0]["acc_global"] == 0.5
    everyone = forest.evaluate(rows, trees, 2, shared_model=False)["scores"].collect()
    assert [r["acc_local"] for r in everyone] == [0.5, 0.5] and everyone[0]["acc_global_local"] is None
    with pytest.raises(ValueError):
        forest.evaluate(rows, trees, 2, private=True, shared_model=False)


@pytest.mark.parametrize("globally, locally, shared_test", [(False, False, False), (True, False, True), (False, True, True)])
def test_experiment_and_its_checkpoint_agree(spark, tmp_path, globally, locally, shared_test):
    options = {"seed": 1, "flip_y": 0.0, "n_informative": 5}
    data = datasets.generate(spark, 160, 8, 3, **options) if globally else datasets.generate_skellam(spark, 160, 8, 3, 2.0, 1, **options)
    x = runner.Experiment(3, 4, 2, "distributed", locally, None if locally else 2.0, not locally, shared_test, seed=1, detailed=globally)
    out = runner.run_experiment(spark, data, x, str(tmp_path / "m"), {"output_label": "t"})
    again = runner.evaluate_checkpoint(spark, data, x, str(tmp_path / "m"), out.uid)
    columns = [c for c in out.results.columns if c.startswith("accuracy")]
    rows = out.results.select("comm_rank", *columns).collect()
    assert rows == again.results.select("comm_rank", *columns).collect() and [r["comm_rank"] for r in rows] == ["0", "1", "global"]
    assert sorted(map(tuple, out.confusion["test"].collect()), key=str) == sorted(map(tuple, again.confusion["test"].collect()), key=str)
    assert out.frequencies.where("scope = 'global'").count() == 3
    if globally:
        path = runner.write_outcome(out, str(tmp_path / "o"), "lab", "exp", 3)
        got = experiments.read_results(spark, f"{path}_results.csv")
        assert {"mu_partition", "seed", "time_sec_training", "output_label"} <= set(got.columns) and got.count() == 3
        assert spark.read.csv(f"{path}_confusion_matrix_test", header=True).where("scope = 'local'").select("rank").distinct().count() == 2


def test_command_line_options():
    a = runner.parser().parse_args(["--locally_imbalanced", "--mu_partition", "2", "--distribute_data", "--no-shared_test_set", "--random_state_model", "5", "--enforce_constant_local_size"])
    x = runner.experiment_options(a)
    assert (x.mode, x.mu_partition, x.shared_test, x.model_seed, x.constant_size, x.n_classes) == ("distributed", "2", False, 5, True, 5)
    assert runner.generator_options(a)["n_informative"] == 10
    with pytest.raises(ValueError):
        runner.Experiment(3, mode="distributed", shared_test=False, shared_model=False)
    with runner.Timer("a b", "{name} {seconds}", times := {}):
        pass
    assert list(times) == ["time_sec_a_b"]
    assert runner.set_logger("DEBUG").level == 10


def test_seeds_summary_and_t_for_many(spark):
    assert weights.model_base_seed(3, 7) == 7 and weights.model_base_seed(3) == weights.model_base_seed(3) != weights.model_base_seed(4)
    df = spark.createDataFrame([(1,), (1,), (0,), (None,)], "y int")
    assert stats.summary(df, "y") == "4 samples, class None: 25.0%, class 0: 25.0%, class 1: 50.0%"
    many = [1, 7, 60, 61, 100, 250, 5000]
    got = [r[0] for r in spark.createDataFrame([(n,) for n in many], "n int").select(experiments.t_quantile_column(F.col("n"))).collect()]
    assert got == pytest.approx([experiments.t_quantile_975(n) for n in many], abs=1e-8)


def test_checkpoint_lookup_errors(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        experiments.find_checkpoint(spark, str(tmp_path), 4, 2, 0.5, 2.0, 0, 1)
    os.makedirs(tmp_path / "breaking_iid/n4_m2/nodes_16/1_0_1_05_20")
    with pytest.raises(ValueError):
        experiments.find_checkpoint(spark, str(tmp_path), 4, 2, 0.5, 2.0, 0, 1)


def test_loading_with_split_and_scaling(spark, tmp_path):
    with open(tmp_path / "s.csv", "w") as f:
        f.writelines(",".join([f"{i % 2}.0", *[f"{i * (j + 1) % 7}.0" for j in range(18)]]) + "\n" for i in range(40))
    got = datasets.load("susy", spark, str(tmp_path / "s.csv"), stratified=True, scaled=True)
    assert {r[0]: r[1] for r in got.groupBy("split").count().collect()} == {"test": 10, "train": 30}
    first = [r[0] for r in got.where("split = 'train'").select(F.col("features")[0]).collect()]
    assert np.mean(first) == pytest.approx(0, abs=1e-5) and np.std(first) == pytest.approx(1, abs=1e-5)
    with pytest.raises(ValueError):
        datasets.load("susy", spark, "x", original_split=True)
    train, test = datasets.make_classification(spark, 40, 12, 2)
    assert (train.count(), test.count()) == (30, 10)


def test_entry_imports():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
