"""Run-time planning expressions."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Serial minutes by workload and number of trees. n6_m4 is 10^6 samples of 10^4 features.
SERIAL_MINUTES = {
    "n6_m4": {1600: 138.0, 800: 73.0},
    "n7_m3": {448: 227.0, 224: 103.0},
    "n5_m3": {76: 1.0},
    "n6_m2": {76: 2.0},
    "susy": {1000: 30.0, 100: 10.0},
    "cover_type": {1000: 10.0, 500: 5.0, 100: 2.0},
    "higgs": {320: 15.0, 640: 30.0, 1280: 60.0, 2560: 120.0, 5120: 240.0, 10: 5.0},
}
HIGGS_MINUTES = SERIAL_MINUTES["higgs"]
#: Memory per node in MB by node class, and the greatest run time in minutes.
MEMORY_MB = {"standard": 239_400, "high": 497_500, "large": 4_120_112}
MAX_MINUTES = 4320


def time_limit(minutes: Column, factor: float = 2.0, most: int = MAX_MINUTES) -> Column:
    """Limit of a job: the estimate with a margin, capped; rounded half up to whole minutes."""
    return F.floor(F.round(F.least(minutes * factor, F.lit(float(most))), 6) + 0.5).cast("long")


def node_class(memory_mb: Column) -> Column:
    """Smallest class of nodes that has the memory; NULL if none has."""
    out = F.lit(None).cast("string")
    for name, size in sorted(MEMORY_MB.items(), key=lambda x: -x[1]):
        out = F.when(memory_mb <= size, name).otherwise(out)
    return out


def closest_baseline(wanted: DataFrame, minutes: Mapping[int, float], column: str = "wanted") -> DataFrame:
    """Adds the measured tree count whose ratio to the wanted one is nearest 1 (the smaller on ties), and minutes scaled from it."""
    known = F.array(*[F.struct(F.lit(n).alias("n"), F.lit(float(m)).alias("m")) for n, m in sorted(minutes.items())])
    near = F.transform(known, lambda x: F.struct(F.abs(x["n"] / F.col(column) - 1).alias("d"), x["n"].alias("n"), x["m"].alias("m")))
    best = wanted.withColumn("b", F.array_min(near))
    return best.select(column, F.col("b.n").alias("n_trees"), (F.col("b.m") * F.col(column) / F.col("b.n")).alias("minutes"))


def closest_baselines(wanted: DataFrame, workload: str = "workload", trees: str = "wanted") -> DataFrame:
    """wanted(workload, wanted) with n_trees and minutes of each workload's closest baseline; unknown workloads drop out."""
    spark = wanted.sparkSession
    rows = [(w, float(n), m) for w, by in SERIAL_MINUTES.items() for n, m in by.items()]
    known = F.broadcast(spark.createDataFrame(rows, "b_workload string, n double, m double"))
    best = F.min(F.struct(F.abs(F.col("n") / F.col(trees) - 1).alias("d"), F.col("n").alias("n"), F.col("m").alias("m"))).alias("b")
    near = wanted.select(workload, trees).distinct().join(known, F.col(workload) == F.col("b_workload")).groupBy(workload, trees).agg(best)
    return near.select(workload, trees, F.col("b.n").cast("long").alias("n_trees"), (F.col("b.m") * F.col(trees) / F.col("b.n")).alias("minutes"))


def job_grid(spark: SparkSession, datasets: Sequence[str], nodes: Sequence[int], seeds: Sequence[int]) -> DataFrame:
    """(workload, n_nodes, model_seed): every combination of an experiment's few workloads, node counts and seeds."""
    one = lambda values, column: spark.createDataFrame([(v,) for v in values], column)
    return one(datasets, "workload string").crossJoin(one(nodes, "n_nodes int")).crossJoin(one(seeds, "model_seed int"))
