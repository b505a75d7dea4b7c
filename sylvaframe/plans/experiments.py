"""Experiment analytics: run logs and result files to scaling tables."""

from __future__ import annotations

import math
import re
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars

SEEDS = ("data_seed", "model_seed")


def parse_run_log(df: DataFrame, text: str = "value") -> DataFrame:
    """Adds wall_clock_sec, energy_wh, power_w and memory_gb of a scheduler's run log."""
    t = F.col(text)
    memory, unit = scalars.field(t, r"Memory Utilized: ([0-9.]+) [A-Z]+"), F.regexp_extract(t, r"Memory Utilized: [0-9.]+ ([A-Z]+)", 1)
    return df.select(
        "*",
        scalars.time_to_seconds(F.regexp_extract(t, r"Job Wall-clock time: ([0-9:-]+)", 1)).alias("wall_clock_sec"),
        scalars.field(t, r"/ ([0-9.]+) Watthours").alias("energy_wh"),
        scalars.field(t, r"Average node power draw: ([0-9.]+) Watt").alias("power_w"),
        scalars.to_gigabytes(memory, unit).alias("memory_gb"),
    )


def parse_job_output(df: DataFrame, text: str = "value") -> DataFrame:
    """Adds the fields of a job's output; states keep their words, '_' becomes a space."""
    t = F.col(text)
    found = {
        "n_samples": scalars.field(t, r"n_samples=(\d+)", "bigint"), "n_features": scalars.field(t, r"n_features=(\d+)", "bigint"),
        "n_trees": scalars.field(t, r"n_trees=(\d+)", "bigint"), "training_sec": scalars.field(t, r"Time for training is ([0-9.]+) s\."),
        "accuracy": scalars.field(t, r"Accuracy is ([0-9.]*[0-9])"), "joule": scalars.field(t, r"Energy Consumed: ([0-9.]+) Joule"),
        "job_id": scalars.field(t, r"Job ID: (\d+)", "bigint"), "state": F.nullif(F.regexp_replace(F.regexp_extract(t, r"State: (\w+)", 1), "_", " "), F.lit("")),
    }
    out = df.select("*", *[c.alias(n) for n, c in found.items()])
    return out.withColumn("data_entries", F.col("n_samples") * F.col("n_features"))


def parse_run_path(df: DataFrame, path: str = "path", updated: bool = True) -> DataFrame:
    """Adds n_tasks and model_seed from .../n_nodes_<n>/<data>_<model>_<job>/... or, not updated, .../nodes_<n>/<job>_<data>_<model>/..."""
    nodes, run = (r"/n_nodes_(\d+)/", r"/n_nodes_\d+/\d+_(\d+)_\d+") if updated else (r"/nodes_(\d+)/", r"/nodes_\d+/\d+_\d+_(\d+)")
    return df.select("*", scalars.field(F.col(path), nodes, "int").alias("n_tasks"), scalars.field(F.col(path), run, "int").alias("model_seed"))


def read_logs(spark: SparkSession, path: str) -> DataFrame:
    """(path, value): whole log files below a folder."""
    logs = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "slurm*.out").text(path, wholetext=True)
    return logs.select(F.input_file_name().alias("path"), "value")


#: Columns of results that are text or whole numbers; all others are doubles.
_TEXT = ("comm_rank", "scope", "run_uid", "mode", "result_filename", "dataset", "output_dir", "output_label", "experiment_id")
_WHOLE = ("n_ranks", "comm_size", "n_nodes", "n_trees", "trees_per_node", "n_samples", "n_features", "n_classes", "seed", "data_seed", "model_seed", "peak")


def _typed(df: DataFrame) -> DataFrame:
    """Text columns of a CSV as what they hold; what does not parse is NULL."""
    kind = lambda c: "string" if c in _TEXT else "bigint" if c in _WHOLE else "double"
    of = lambda c: F.col(f"`{c}`") if kind(c) == "string" else F.col(f"`{c}`").try_cast(kind(c))
    return df.select(*[F.col(c) if c.startswith("__") or df.schema[c].dataType.typeName() != "string" else of(c).alias(c) for c in df.columns])


def parallel_layout(df: DataFrame) -> DataFrame:
    """Serial results under the columns of parallel ones: the one model is local and global."""
    for name in ("accuracy_test", "accuracy_train", "auc_test", "auc_train"):
        if name in df.columns:
            metric, part = name.split("_")
            df = df.withColumn(f"{metric}_global_{part}", F.col(name)).withColumn(f"{metric}_local_{part}", F.col(name)).drop(name)
    return df


def read_results(spark: SparkSession, path: str) -> DataFrame:
    """Result CSVs below path, typed; serial ones get the columns of parallel ones."""
    return parallel_layout(_typed(spark.read.csv(path, header=True, inferSchema=False)))


def write_results(df: DataFrame, path: str, name: str | None = None) -> str:
    """One CSV file of a results table, which is of report size; path gets the suffix .csv, which is returned with it. name goes to result_filename."""
    path = path if path.endswith(".csv") else f"{path}.csv"
    spark, part = df.sparkSession, f"{path}.part"
    df.withColumn("result_filename", F.lit(name or path.rsplit("/", 1)[-1])).coalesce(1).write.mode("overwrite").csv(part, header=True)
    of = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    fs = of(part).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    made = fs.globStatus(of(f"{part}/part-*"))[0].getPath()
    fs.delete(of(path), True)
    fs.rename(made, of(path))
    fs.delete(of(part), True)
    return path


def set_where(df: DataFrame, condition: Column, values: dict[str, Column]) -> DataFrame:
    """Columns set to values where the condition holds, NULL where it does not and the column is new."""
    return df.withColumns({c: F.when(condition, v).otherwise(F.col(c) if c in df.columns else F.lit(None)) for c, v in values.items()})


def write_confusion(confusion: DataFrame, path: str, n_classes: int) -> None:
    """CSV matrices of a confusion table (scope, rank, label, prediction, cnt): a row a true class, a folder per scope and rank."""
    rows = confusion.groupBy("scope", "rank", "label").pivot("prediction", list(range(n_classes))).agg(F.sum("cnt")).na.fill(0)
    rows.repartition("scope", "rank").sortWithinPartitions("scope", "rank", "label").write.mode("overwrite").partitionBy("scope", "rank").csv(path, header=True)


def write_class_frequencies(frequencies: DataFrame, path: str) -> None:
    """CSVs of class counts (scope, rank, class, cnt), a folder per scope and rank."""
    frequencies.repartition("scope", "rank").sortWithinPartitions("scope", "rank", "class").write.mode("overwrite").partitionBy("scope", "rank").csv(path, header=True)


def run_results(spark: SparkSession, root: str, updated: bool = True) -> DataFrame:
    """Results of all complete runs below root: folders with exactly one log and one result CSV, others are left out.

    The global row of a run gets the fields of its log and its mean power; n_nodes and model_seed come from the path.
    """
    folder = lambda c: F.regexp_extract(c, r"^(.*)/[^/]+$", 1)
    reader = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*_results.csv")
    raw = _typed(reader.csv(root, header=True, inferSchema=False).withColumn("__path", F.input_file_name()))
    logs = read_logs(spark, root)
    files = raw.select(F.col("__path").alias("path")).distinct().unionByName(logs.select("path")).select(folder(F.col("path")).alias("dir"), "path")
    complete = complete_runs(files).withColumnRenamed("dir", "__dir")
    parsed = parse_run_log(logs.select(folder(F.col("path")).alias("l_dir"), "value")).drop("value")
    runs = raw.withColumn("__dir", folder(F.col("__path"))).join(complete, "__dir").join(parsed, F.col("__dir") == F.col("l_dir"), "left").drop("l_dir")
    placed = parse_run_path(runs.drop("model_seed", "n_tasks", "n_nodes"), "__path", updated).withColumnRenamed("n_tasks", "n_nodes")
    fields = ["wall_clock_sec", "energy_wh", "power_w", "memory_gb"]
    is_global = F.col("comm_rank").eqNullSafe("global") if "comm_rank" in placed.columns else F.lit(True)
    values = {c: F.col(c) for c in fields} | {"exp_node_power_draw": scalars.mean_power(F.col("energy_wh"), F.col("wall_clock_sec"), F.col("n_nodes"))}
    return parallel_layout(set_where(placed, is_global, values).withColumn("run", F.col("__dir")).drop("__dir", "__path"))


def scaling_table(runs: DataFrame, scaling: str | None = None, keys: Sequence[str] = ("dataset", "n_nodes", "model_seed", "n_trees")) -> DataFrame:
    """Global rows of runs with the means of their local columns, trees_per_node and, by scaling ('strong', 'weak'), speedup or efficiency; sorted."""
    keys = [k for k in keys if k in runs.columns]
    local = [c for c in runs.columns if c.startswith(("accuracy_", "auc_")) and "local" in c]
    means = with_group_means(runs, keys, local) if local else runs
    out = means.where(F.col("comm_rank") == "global").withColumn("trees_per_node", F.col("n_trees") / F.col("n_nodes"))
    if scaling:
        times = [c for c in out.columns if "time" in c]
        serial = out.where("n_nodes = 1")
        by = ["dataset", "trees_per_node" if scaling == "weak" else "n_trees"]
        by += ["model_seed"] if serial.select("model_seed").distinct().count() > 1 else []
        out = speedup(out, serial, by, times, scaling == "weak")
    return in_order(out, "dataset", "n_nodes", "model_seed", "comm_rank")


def in_order(df: DataFrame, *columns: str) -> DataFrame:
    """Results sorted by those of the columns that they have; '-name' sorts downwards."""
    return df.orderBy(*[F.col(c.lstrip("-")).desc() if c.startswith("-") else F.col(c) for c in columns if c.lstrip("-") in df.columns])


def plot_lines(df: DataFrame, x: str, y: str, by: Sequence[str]) -> DataFrame:
    """(by, x, mean, low, high): the points and 95 % intervals of a line plot."""
    out = df.groupBy(*by, x).agg(F.avg(y).alias("mean"), ci95(y).alias("half"))
    return out.select(*by, x, "mean", (F.col("mean") - F.col("half")).alias("low"), (F.col("mean") + F.col("half")).alias("high"))


def plot_capacity(df: DataFrame, value: str) -> DataFrame:
    """(n_samples, n_features, n_trees, value): the largest model of each data size that a run completed, for a capacity plot."""
    done = df.where(F.col(value).isNotNull())
    return done.groupBy("n_samples", "n_features").agg(F.max("n_trees").alias("n_trees"), F.max_by(value, "n_trees").alias(value))


def find_checkpoint(spark: SparkSession, base: str, log_n_samples: int, log_n_features: int, mu_global: float | str, mu_local: float | str, data_seed: int, model_seed: int, n_nodes: int = 16) -> tuple[str, str]:
    """(folder, run uid) of the run with these parameters in its folder's name; of several the smallest job id, compared as a string.

    Raises FileNotFoundError without such a folder, ValueError where it holds no model or no results file with a uid.
    """
    plain = lambda mu: str(mu).replace(".", "")
    pattern = f"{base.rstrip('/')}/breaking_iid/n{log_n_samples}_m{log_n_features}/nodes_{n_nodes}/*_{data_seed}_{model_seed}_{plain(mu_global)}_{plain(mu_local)}"
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    listed = lambda p: [str(s.getPath()) for s in (jvm.org.apache.hadoop.fs.Path(p).getFileSystem(conf).globStatus(jvm.org.apache.hadoop.fs.Path(p)) or [])]
    name = lambda p: p.rstrip("/").rsplit("/", 1)[-1]
    found = listed(pattern)
    if not found:
        raise FileNotFoundError(f"no checkpoint folder matches {pattern}")
    folder = min(found, key=lambda p: name(p).split("_")[0])
    inside = [name(p) for p in listed(f"{folder}/*")]
    if not any(n.startswith("run_uid=") for n in inside):
        raise ValueError(f"no model in {folder}")
    uids = [m[1] for n in sorted(inside) if (m := re.search(r"--[\d\w-]+-(\w+)_results(?:\.csv)?$", n))]
    if not uids:
        raise ValueError(f"no results file with a run uid in {folder}")
    return folder, uids[0]


def complete_runs(files: DataFrame) -> DataFrame:
    """files(dir, path) -> directories with exactly one log and one result file."""
    log, csv = (F.sum(F.col("path").endswith(e).cast("int")) for e in (".out", "_results.csv"))
    return files.groupBy("dir").agg(log.alias("logs"), csv.alias("results")).where("logs = 1 and results = 1").select("dir")


def smallest_job(runs: DataFrame, keys: Sequence[str], job: str = "job_id") -> DataFrame:
    """The run of each key with the smallest job id, compared as a string; the run whose checkpoint is read."""
    return runs.groupBy(*keys).agg(F.min_by(F.struct(*[c for c in runs.columns if c not in keys]), F.col(job).cast("string")).alias("run")).select(*keys, "run.*")


def null_safe_join(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Inner join in which missing keys match each other; right's keys are dropped."""
    renamed = right.select(*[F.col(c).alias(f"__{c}") if c in keys else F.col(c) for c in right.columns])
    return left.join(renamed, reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys])).drop(*[f"__{k}" for k in keys])


def with_group_means(df: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    means = df.groupBy(*keys).agg(*[F.avg(c).alias(c.replace("local", "mean_local") if "local" in c else f"mean_{c}") for c in columns])
    return null_safe_join(df, means, keys)


def speedup(df: DataFrame, serial: DataFrame, keys: Sequence[str], times: Sequence[str], weak: bool = False) -> DataFrame:
    """Adds <time>_serial and speedup_<x> (strong) or efficiency_<x> (weak); runs without a serial partner drop out."""
    base = serial.select(*keys, *[F.col(t).alias(f"{t}_serial") for t in times])
    joined = df.join(base, list(keys))
    kind = "efficiency" if weak else "speedup"
    return joined.select("*", *[F.try_divide(F.col(f"{t}_serial"), F.col(t)).alias(t.replace("time_sec", kind)) for t in times])


def t_quantile_975(df: int) -> float:
    """0.975 quantile of Student's t distribution, by bisection on its distribution function."""

    def tail(t: float) -> float:  # P(|T| > t), regularised incomplete beta by its continued fraction
        x, a, b = df / (df + t * t), df / 2, 0.5
        front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) if 0 < x < 1 else 0.0

        def fraction(x: float, a: float, b: float) -> float:
            c, d = 1.0, 1 - (a + b) * x / (a + 1)
            d = 1 / (d if abs(d) > 1e-300 else 1e-300)
            h = d
            for m in range(1, 300):
                for n in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
                    d = 1 / (1 + n * d)
                    c = 1 + n / c
                    h *= c * d
                if abs(c * d - 1) < 1e-15:
                    break
            return h

        return front * fraction(x, a, b) / a if x < (a + 1) / (a + b + 2) else 1 - front * fraction(1 - x, b, a) / b

    lo, hi = 0.0, 1000.0
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if tail(mid) > 0.05 else (lo, mid)
    return (lo + hi) / 2


def t_quantile_column(df: Column) -> Column:
    """0.975 quantile of Student's t distribution for any whole number of degrees of freedom from 1: tabulated for few, by its expansion in 1/df for many.

    The expansion's first left-out term is below 1e-9 where it takes over.
    """
    few = 60
    z = 1.959963984540054
    terms = [
        z,
        (z**3 + z) / 4,
        (5 * z**5 + 16 * z**3 + 3 * z) / 96,
        (3 * z**7 + 19 * z**5 + 17 * z**3 - 15 * z) / 384,
        (79 * z**9 + 776 * z**7 + 1482 * z**5 - 1920 * z**3 - 945 * z) / 92160,
    ]
    table = F.array(*[F.lit(t_quantile_975(d)) for d in range(1, few + 1)])
    many = sum((F.lit(t) / F.pow(df.cast("double"), F.lit(float(k))) for k, t in enumerate(terms[1:], 1)), F.lit(terms[0]))
    return F.when(df <= few, F.get(table, (df - 1).cast("int"))).otherwise(many)


def ci95(column: str) -> Column:
    """Half-width of the 95 % confidence interval of a mean, by Student's t; NULL for a single value."""
    n = F.count(column)
    return F.when(n > 1, F.stddev_samp(column) / F.sqrt(n) * t_quantile_column(n - 1))


def aggregate_by_seeds(df: DataFrame, keys: Sequence[str], columns: Sequence[str], stats: str = "all") -> DataFrame:
    """Means over seeds by key; stats 'std' adds sample deviations, 'all' also 95 % intervals."""
    out = [F.avg(c).alias(f"{c}_mean") for c in columns]
    if stats in ("std", "all"):
        out += [F.stddev_samp(c).alias(f"{c}_std") for c in columns]
    if stats == "all":
        out += [ci95(c).alias(f"{c}_ci95") for c in columns]
    return df.groupBy(*keys).agg(*out)


def union_runs(runs: Sequence[DataFrame | None]) -> DataFrame:
    """Rows of all runs that did not fail, over all their columns."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [r for r in runs if r is not None])
