"""Experiments: data, ranks, forest, evaluation, results tables and files; and a command line."""

from __future__ import annotations

import argparse
import logging
import time
import uuid
from dataclasses import asdict, dataclass, field
from datetime import datetime
from pathlib import PurePosixPath

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import forest, levelwise, stats
from ..operators.weights import model_base_seed
from ..sources import datasets
from ..sources.shared import stored
from . import experiments

log = logging.getLogger("sylvaframe")


def set_logger(level: int | str = logging.INFO, path: str | None = None) -> logging.Logger:
    """The engine's logger, to the console and, with a path, to a file."""
    handlers: list[logging.Handler] = [logging.StreamHandler()] + ([logging.FileHandler(path)] if path else [])
    for old in list(log.handlers):
        log.removeHandler(old)
        old.close()
    for handler in handlers:
        handler.setFormatter(logging.Formatter("%(asctime)s %(levelname)s %(name)s: %(message)s"))
        log.addHandler(handler)
    log.setLevel(level)
    log.propagate = False
    return log


@dataclass
class Timer:
    """Seconds of a block, which must contain an action; text is a template over the fields."""

    name: str = ""
    text: str = "{name}: {seconds:.2f} s"
    times: dict[str, float] = field(default_factory=dict)
    seconds: float = 0.0

    def __enter__(self) -> Timer:
        self.began = time.perf_counter()
        return self

    def __exit__(self, *_: object) -> None:
        self.seconds = time.perf_counter() - self.began
        self.times[f"time_sec_{'_'.join(self.name.split())}"] = self.seconds
        log.info(self.text.format(name=self.name, seconds=self.seconds))


def mean_over_ranks(times: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """times(rank, time_sec_...) -> the mean of each time over the ranks, by keys."""
    columns = [c for c in times.columns if c.startswith("time_sec_")]
    return times.groupBy(*(keys or [])).agg(*[F.avg(c).alias(c) for c in columns])


def output_path(base: str, name: str, experiment: str = "", now: datetime | None = None, uid: str | None = None) -> tuple[str, str]:
    """(folder, base name) of a run's results, by date."""
    now = now or datetime.now()
    folder = PurePosixPath(base) / str(now.year) / f"{now.year}-{now.month}" / f"{now:%Y-%m-%d}"
    return str(folder / experiment if experiment else folder), f"{now:%Y-%m-%d--%H-%M-%S}-{name}-{uid or uuid.uuid4().hex[:8]}"


@dataclass(frozen=True)
class Experiment:
    """Options of a run. mode replicated: each rank trains on all train rows; distributed: on its own part.

    grower exact: exact cuts, a rank's rows in one worker; levels: cuts between n_bins quantiles a feature, by Spark level by level, for ranks of any size.
    """

    n_classes: int
    n_trees: int = 100
    n_ranks: int = 1
    mode: str = "replicated"
    locally_balanced: bool = True
    mu_partition: float | str | None = None
    constant_size: bool = False
    shared_test: bool = True
    shared_model: bool = True
    train: float = 0.75
    stratified: bool = False
    seed: int = 0
    model_seed: int | None = None
    detailed: bool = False
    grower: str = "exact"
    n_bins: int = 64

    def __post_init__(self) -> None:
        if self.mode not in ("replicated", "distributed"):
            raise ValueError(self.mode)
        if self.grower not in ("exact", "levels"):
            raise ValueError(self.grower)
        if not (self.shared_model or self.shared_test):
            raise ValueError("a private test set needs a shared model")
        if self.mode == "replicated" and not self.shared_test:
            raise ValueError("ranks that see all rows have no private test set")


@dataclass
class Outcome:
    """Results (one row a rank and one global row), model, confusion tables by part ('test', 'train'), class counts by rank, and the run's uid."""

    results: DataFrame
    trees: DataFrame
    confusion: dict[str, DataFrame]
    frequencies: DataFrame
    uid: str


def distributed(data: DataFrame, x: Experiment) -> DataFrame:
    """data with split and rank as the experiment asks for."""
    if x.mode == "distributed":
        return datasets.distribute(data, x.n_ranks, x.n_classes, x.locally_balanced, x.shared_test, x.mu_partition, x.constant_size, x.seed, x.train, x.stratified)
    split = data if "split" in data.columns else datasets.train_test_split(data, "sample_id", x.train, x.seed, "label" if x.stratified else None)
    return split.withColumn("rank", F.when(F.col("split") == "train", 0).cast("int"))


def _results(spark: SparkSession, x: Experiment, judged: dict[str, dict[str, DataFrame]], times: dict[str, float], uid: str, config: dict, by_rank: DataFrame | None = None) -> DataFrame:
    """One row a rank and a global row, with the configuration as columns. by_rank(rank, time_sec_...): each rank's own times; the global row has their means."""
    rows = spark.range(x.n_ranks + 1).select(F.when(F.col("id") < x.n_ranks, F.col("id").cast("int")).alias("r"))
    table = rows.select("r", F.coalesce(F.col("r").cast("string"), F.lit("global")).alias("comm_rank"), F.when(F.col("r").isNull(), "global").otherwise("local").alias("scope"))
    for part, e in judged.items():
        scores = e["scores"]
        names = {"acc_local": f"accuracy_local_{part}", "acc_global_local": f"accuracy_global_local_{part}", "auc_local": f"auc_local_{part}"}
        own = scores.select(F.col("rank").alias("s_rank"), *[F.col(c).alias(n) for c, n in names.items() if c in scores.columns])
        whole = scores.agg(F.first("acc_global").alias(f"accuracy_global_{part}"), *[F.first("auc_global").alias(f"auc_global_{part}")] * ("auc_global" in scores.columns))
        table = table.join(own, F.col("r") == F.col("s_rank"), "left").drop("s_rank").crossJoin(whole)  # one row
    if by_rank is not None:
        means = mean_over_ranks(by_rank).select(F.lit(None).cast("int").alias("t_rank"), "*")
        own_times = by_rank.withColumnRenamed("rank", "t_rank").unionByName(means)
        table = table.join(own_times, F.col("r").eqNullSafe(F.col("t_rank")), "left").drop("t_rank")
    options = {k: v for k, v in (asdict(x) | config).items() if v is not None and k not in times}
    constants = {"run_uid": uid, **options, **times}
    typed = {k: F.lit(v if isinstance(v, (int, float, str)) and not isinstance(v, bool) else str(v)).alias(k) for k, v in constants.items()}
    return experiments.in_order(table.drop("r").select("*", *typed.values()), "comm_rank")


def _trained(rows: DataFrame, x: Experiment, checkpoint: str | None, uid: str) -> tuple[DataFrame, DataFrame | None]:
    """The model, and its times by rank where ranks are trained each in a task of its own."""
    spark, replicated, seed = rows.sparkSession, x.mode == "replicated", model_base_seed(x.seed, x.model_seed)
    if x.grower == "levels":
        trees = stored(levelwise.train_by_level(rows, x.n_classes, x.n_trees, levelwise.bin_edges(rows, x.n_bins), x.n_ranks, seed, replicated))
        if checkpoint:
            forest.save(trees, checkpoint, uid, x.n_ranks)
        return trees, None
    if checkpoint:
        trees = forest.train_resumable(rows, x.n_classes, x.n_trees, checkpoint, uid, x.n_ranks, seed, replicated)
        return trees, forest.manifest(spark, checkpoint, uid).select("rank", F.col("seconds").alias("time_sec_training"))
    timed = stored(forest.train(rows, x.n_classes, x.n_trees, x.n_ranks, seed, replicated, timed=True))
    return timed.drop("seconds"), forest.times_by_rank(timed)


def run_experiment(spark: SparkSession, data: DataFrame, x: Experiment, checkpoint: str | None = None, config: dict | None = None, uid: str | None = None) -> Outcome:
    """One training and evaluation. data: sample_id, features, label; a column split is kept in replicated mode.

    time_sec_training is a rank's own time, on the global row the mean over ranks, and time_sec_training_wall the driver's clock; models grown by levels have the latter alone, as
    their ranks share all tasks. With a checkpoint, uid goes on with a run that broke: ranks that it committed are not trained again.
    """
    times: dict[str, float] = {}
    uid = uid or uuid.uuid4().hex[:8]
    with Timer("data preparation", times=times):
        rows = stored(distributed(data, x))
    train_rows, test_rows = rows.where("split = 'train'"), rows.where("split = 'test'")
    with Timer("training wall", times=times):
        trees, by_rank = _trained(train_rows, x, checkpoint, uid)
    with Timer("test", times=times):
        judged = {"test": forest.evaluate(test_rows, trees, x.n_classes, private=not x.shared_test, shared_model=x.shared_model)}
        if x.detailed:
            judged["train"] = forest.evaluate(train_rows, trees, x.n_classes, private=x.mode == "distributed", shared_model=True)
    frequencies = stats.class_frequency_dense(train_rows, "label", "rank", x.n_ranks, x.n_classes)
    return Outcome(_results(spark, x, judged, times, uid, config or {}, by_rank), trees, {p: e["confusion"] for p, e in judged.items()}, frequencies, uid)


def evaluate_checkpoint(spark: SparkSession, data: DataFrame, x: Experiment, path: str, uid: str, config: dict | None = None) -> Outcome:
    """The evaluation of a saved model on data, split and partitioned as in its training, so it gives the results of the training run."""
    times: dict[str, float] = {}
    with Timer("data preparation", times=times):
        rows = stored(distributed(data, x))
    trees = forest.load(spark, path, uid, x.n_ranks)
    with Timer("test", times=times):
        judged = {"test": forest.evaluate(rows.where("split = 'test'"), trees, x.n_classes, private=not x.shared_test, shared_model=x.shared_model)}
        if x.detailed:
            judged["train"] = forest.evaluate(rows.where("split = 'train'"), trees, x.n_classes, private=x.mode == "distributed", shared_model=True)
    frequencies = stats.class_frequency_dense(rows.where("split = 'train'"), "label", "rank", x.n_ranks, x.n_classes)
    return Outcome(_results(spark, x, judged, times, uid, config or {}), trees, {p: e["confusion"] for p, e in judged.items()}, frequencies, uid)


def write_outcome(outcome: Outcome, base: str, label: str = "", experiment: str = "", n_classes: int = 2, now: datetime | None = None) -> str:
    """Results, confusion matrices and class counts of a run as CSV below a folder by date; returns the path that all names begin with."""
    folder, name = output_path(base, label, experiment, now, outcome.uid)
    experiments.write_results(outcome.results, f"{folder}/{name}_results")
    for part, table in outcome.confusion.items():
        experiments.write_confusion(table, f"{folder}/{name}_confusion_matrix_{part}", n_classes)
    experiments.write_class_frequencies(outcome.frequencies, f"{folder}/{name}_class_frequencies")
    return f"{folder}/{name}"


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(description="Train and evaluate a random forest over logical ranks.")
    for name, kind, default in (
        ("n_samples", int, 1000), ("n_features", int, 100), ("n_classes", int, 5), ("n_clusters_per_class", int, 1), ("random_state", int, 0), ("frac_informative", float, 0.1), ("frac_redundant", float, 0.1),
        ("flip_y", float, 0.01), ("n_trees", int, 100), ("n_ranks", int, 1), ("random_state_model", int, None), ("train_split", float, 0.75), ("mu_data", str, "10"), ("peak", int, 0), ("mu_partition", str, "10.0"),
        ("output_dir", str, None), ("output_label", str, ""), ("experiment_id", str, ""), ("log_path", str, None), ("logging_level", str, "INFO"), ("checkpoint_path", str, None), ("checkpoint_uid", str, ""), ("data_path", str, None),
    ):
        p.add_argument(f"--{name}", type=kind, default=default)
    p.add_argument("--grower", choices=("exact", "levels"), default="exact")
    p.add_argument("--n_bins", type=int, default=64)
    p.add_argument("--dataset_name", choices=sorted(datasets.DATASETS))
    for name in ("stratified_train_test", "globally_imbalanced", "distribute_data", "enforce_constant_local_size", "locally_imbalanced", "detailed_evaluation", "save_model"):
        p.add_argument(f"--{name}", action="store_true")
    for name in ("shared_global_model", "shared_test_set"):
        p.add_argument(f"--{name}", action=argparse.BooleanOptionalAction, default=True)
    return p


def generator_options(a: argparse.Namespace) -> dict:
    """Options of the synthetic generator from shares of informative and redundant features."""
    return {"n_informative": int(a.frac_informative * a.n_features), "n_redundant": int(a.frac_redundant * a.n_features), "n_clusters_per_class": a.n_clusters_per_class, "flip_y": a.flip_y}


def experiment_options(a: argparse.Namespace) -> Experiment:
    return Experiment(
        a.n_classes, a.n_trees, a.n_ranks, "distributed" if a.distribute_data else "replicated", not a.locally_imbalanced, a.mu_partition if a.locally_imbalanced else None, a.enforce_constant_local_size,
        a.shared_test_set, a.shared_global_model, a.train_split, a.stratified_train_test, a.random_state, a.random_state_model, a.detailed_evaluation, a.grower, a.n_bins,
    )


def main(argv: list[str] | None = None) -> Outcome:
    a = parser().parse_args(argv)
    set_logger(a.logging_level, a.log_path)
    spark = SparkSession.builder.getOrCreate()
    if a.dataset_name:
        data = datasets.get_dataset(a.dataset_name, spark, a.data_path)
    elif a.globally_imbalanced:
        data = datasets.generate_skellam(spark, a.n_samples, a.n_features, a.n_classes, a.mu_data, a.peak, seed=a.random_state, **generator_options(a))
    else:
        data = datasets.generate(spark, a.n_samples, a.n_features, a.n_classes, seed=a.random_state, **generator_options(a))
    x = experiment_options(a)
    config = {k: v for k, v in vars(a).items() if k not in asdict(x)}
    log.info(stats.summary(data, "label"))
    if a.checkpoint_uid and not a.save_model:
        outcome = evaluate_checkpoint(spark, data, x, a.checkpoint_path, a.checkpoint_uid, config)
    else:
        outcome = run_experiment(spark, data, x, a.checkpoint_path if a.save_model else None, config, a.checkpoint_uid or None)
    if a.output_dir:
        log.info("written to %s", write_outcome(outcome, a.output_dir, a.output_label, a.experiment_id, a.n_classes))
    return outcome


if __name__ == "__main__":
    main().results.show(truncate=False)
