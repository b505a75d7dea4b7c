"""Labelled data sets: CSV readers by name and a synthetic generator."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.partition import balanced_partition, first_rows, normalize_features, skellam_partition, tail_split, train_test_split
from ..operators.weights import largest_remainder, skellam_class_weights
from .shared import stored


def _csv(spark: SparkSession, path: str, n_columns: int) -> DataFrame:
    return spark.read.csv(path, schema=", ".join(f"c{i} double" for i in range(n_columns)), header=False)


def _labelled(raw: DataFrame, label: str, features: Sequence[str], shift: int = 0, keep: Sequence[str] = ()) -> DataFrame:
    array = F.array(*[F.col(c).cast("float") for c in features])
    sample_id = F.xxhash64(*[c for c in raw.columns if c not in keep]).alias("sample_id")
    return raw.select(sample_id, array.alias("features"), (F.col(label) - shift).cast("int").alias("label"), *keep)


def read_susy(spark: SparkSession, path: str) -> DataFrame:
    """SUSY: label first, 18 features, 2 classes. All rows are data."""
    return _labelled(_csv(spark, path, 19), "c0", [f"c{i}" for i in range(1, 19)])


def read_higgs(spark: SparkSession, path: str, high_level: bool = True, subset: int | None = None) -> DataFrame:
    """HIGGS: label first, 28 features of which the last 7 are derived; subset keeps the first rows in the order of the files."""
    raw = _csv(spark, path, 29)
    return _labelled(raw if subset is None else first_rows(raw, subset), "c0", [f"c{i}" for i in range(1, 29 if high_level else 22)])


def read_higgs_original_split(spark: SparkSession, path: str, high_level: bool = True, n_test: int = 500_000) -> DataFrame:
    """HIGGS with its published split in column split: the last n_test rows in the order of the files are test."""
    raw = _csv(spark, path, 29)
    return _labelled(tail_split(raw, n_test), "c0", [f"c{i}" for i in range(1, 29 if high_level else 22)], keep=("split",))


def read_cover_type(spark: SparkSession, path: str) -> DataFrame:
    """CoverType: 54 features, label 1 to 7 last, shifted to 0 to 6."""
    return _labelled(_csv(spark, path, 55), "c54", [f"c{i}" for i in range(54)], 1)


DATASETS: dict[str, Callable[..., DataFrame]] = {"susy": read_susy, "higgs": read_higgs, "cover_type": read_cover_type}


def get_dataset(name: str, spark: SparkSession, path: str, **options) -> DataFrame:
    if name not in DATASETS:
        raise ValueError(f"unknown data set {name!r}; known are {sorted(DATASETS)}")
    return DATASETS[name](spark, path, **options)


def load(name: str, spark: SparkSession, path: str, key: str = "sample_id", split_seed: int = 0, train: float = 0.75, stratified: bool = False, scaled: bool = False, original_split: bool = False, **options) -> DataFrame:
    """A data set by name with column split ('train' or 'test'); scaled: z-scores by the train rows. original_split: the published one, for higgs."""
    if original_split:
        if name != "higgs":
            raise ValueError("only higgs has a published split")
        data = read_higgs_original_split(spark, path, **options)
    else:
        data = train_test_split(get_dataset(name, spark, path, **options), key, train, split_seed, "label" if stratified else None)
    return normalize_features(data, F.col("split") == "train") if scaled else data


def transform_clusters(df: DataFrame, cluster: str, vector: str, matrices: Sequence[np.ndarray]) -> DataFrame:
    """df with vector replaced by vector @ matrices[cluster], so that what is uncorrelated gets the covariance of its cluster's matrix.

    cluster is an index of matrices; other ones and null give a NULL vector. A null element makes the elements that it weighs in NULL. Small matrices are sent as Spark estimates them.
    """
    columns = [[[float(v) for v in column] for column in np.asarray(m, float).T] for m in matrices]
    table = pa.table({"c_cluster": pa.array(range(len(columns)), pa.int32()), "c_matrix": pa.array(columns, pa.list_(pa.list_(pa.float64())))})
    dot = lambda column: F.aggregate(F.zip_with(column, "c_vector", lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v)
    rows = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("c_row"), F.col(f"`{cluster}`").alias("c_own"), F.col(f"`{vector}`").alias("c_vector"))
    joined = rows.join(df.sparkSession.createDataFrame(table), F.col("c_own") == F.col("c_cluster"), "left").select("c_row", F.transform("c_matrix", dot).alias("c_made"))
    return joined.select(*[(F.col("c_made") if c == vector else F.col(f"c_row.`{c}`")).alias(c) for c in df.columns])


def cluster_matrices(seed: int, n_clusters: int, n: int) -> np.ndarray:
    """The transform of each cluster of generate(): n x n numbers drawn evenly between -1 and 1."""
    return np.random.RandomState([seed % 2**32, 1]).uniform(-1, 1, (n_clusters, n, n))


def generate(
    spark: SparkSession, n_samples: int, n_features: int, n_classes: int, class_weights: Sequence[float] | None = None, seed: int = 0,
    n_informative: int = 10, n_redundant: int = 0, flip_y: float = 0.01, class_sep: float = 1.0, n_clusters_per_class: int = 1,
    n_repeated: int = 0, hypercube: bool = True, shift: float = 0.0, scale: float = 1.0,
) -> DataFrame:
    """(sample_id, features, label): Gaussian clusters around vertices of a hypercube (or of a random polytope), each with a linear transform of
    its own, redundant linear combinations, repeated features, noise; features are (x + shift) * scale.

    Class counts are exact before the share flip_y of labels is redrawn. Rows depend only on the parameters and sample_id.
    """
    n_informative = min(n_informative, n_features)
    n_redundant = min(n_redundant, n_features - n_informative)
    n_repeated = min(n_repeated, n_features - n_informative - n_redundant)
    n_clusters = n_classes * n_clusters_per_class
    rng = np.random.RandomState(seed)
    vertices: set[tuple[int, ...]] = set()
    if n_clusters > 2**n_informative:
        raise ValueError("too few informative features for the clusters of the classes")
    while len(vertices) < n_clusters:
        vertices.add(tuple(rng.randint(0, 2, n_informative)))
    centre = (np.array(sorted(vertices)) * 2 - 1.0)[rng.permutation(n_clusters)] * class_sep
    if not hypercube:
        centre *= rng.uniform(size=(n_clusters, 1)) * rng.uniform(size=(1, n_informative))
    combine = rng.uniform(-1, 1, (n_informative, n_redundant))
    repeated = rng.randint(0, max(1, n_informative + n_redundant), n_repeated)
    matrices = cluster_matrices(seed, n_clusters, n_informative)
    counts = largest_remainder(n_samples, class_weights if class_weights is not None else [1.0] * n_classes)
    ends = F.array(*[F.lit(e) for e in np.cumsum(counts).tolist()])
    true_label = F.least(F.lit(n_classes - 1), F.size(F.filter(ends, lambda e: e <= F.col("sample_id"))))
    uniform = lambda *salt: (F.pmod(F.xxhash64(F.lit(seed), F.col("sample_id"), *map(F.lit, salt)), F.lit(1 << 40)) + 0.5) / float(1 << 40)
    normal = lambda i: F.sqrt(-2 * F.log(uniform("a", i))) * F.cos(2 * np.pi * uniform("b", i))
    cluster = F.col("true_label") * n_clusters_per_class + F.floor(uniform("cluster") * n_clusters_per_class).cast("int")
    base = spark.range(n_samples).select(F.col("id").alias("sample_id")).withColumn("true_label", true_label.cast("int")).withColumn("cluster", cluster)
    centres = F.array(*[F.array(*[F.lit(float(v)) for v in row]) for row in centre])
    redundant = [sum((F.col("inf")[i] * float(combine[i, j]) for i in range(n_informative)), F.lit(0.0)) for j in range(n_redundant)]
    noise = [normal(i) for i in range(n_informative + n_redundant + n_repeated, n_features)]
    drawn = F.floor(uniform("label") * n_classes).cast("int")
    flipped = F.when(uniform("flip") < flip_y, drawn).otherwise(F.col("true_label"))
    drawn_rows = base.withColumn("around", F.array(*[normal(i) for i in range(n_informative)]).cast("array<double>"))
    around = transform_clusters(drawn_rows, "cluster", "around", matrices).withColumn("centre", centres[F.col("cluster")])
    made = around.withColumn("inf", F.zip_with("around", "centre", lambda a, b: a + b)).withColumn("own", F.concat("inf", F.array(*redundant).cast("array<double>")))
    copies = F.array(*[F.col("own")[int(i)] for i in repeated]).cast("array<double>")
    whole = F.transform(F.concat("own", copies, F.array(*noise).cast("array<double>")), lambda x: (x + shift) * scale)
    return made.select("sample_id", whole.cast("array<float>").alias("features"), flipped.alias("label"))


def generate_skellam(spark: SparkSession, n_samples: int, n_features: int, n_classes: int, mu: float | str, peak: int = 0, rescale: bool = True, **options) -> DataFrame:
    return generate(spark, n_samples, n_features, n_classes, skellam_class_weights(mu, n_classes, peak, rescale).tolist(), **options)


def make_classification(spark: SparkSession, n_samples: int, n_features: int, n_classes: int = 10, seed: int = 0, train: float = 0.75, stratified: bool = False, **options) -> tuple[DataFrame, DataFrame]:
    """(train, test) of a balanced synthetic data set that is not distributed."""
    split = train_test_split(generate(spark, n_samples, n_features, n_classes, seed=seed, **options), "sample_id", train, seed, "label" if stratified else None)
    return tuple(split.where(F.col("split") == part).drop("split") for part in ("train", "test"))


def distribute(
    data: DataFrame, n_ranks: int, n_classes: int, locally_balanced: bool = True, shared_test: bool = True, mu: float | str | None = None, constant_size: bool = False,
    seed: int = 0, train: float = 0.75, stratified: bool = False,
) -> DataFrame:
    """data(sample_id, features, label) with split and rank: shared test rows (rank NULL) are split off before the others are partitioned, private ones within each rank."""
    if not locally_balanced and mu is None:
        raise ValueError("an imbalanced partition needs mu")

    def ranked(df: DataFrame) -> DataFrame:
        if locally_balanced:
            return balanced_partition(df, "label", "sample_id", n_ranks, seed)
        return skellam_partition(df, "label", "sample_id", n_ranks, mu, constant_size, seed, range(n_classes))

    by = "label" if stratified else None
    if not shared_test:
        own = ranked(data)
        if not stratified:
            return train_test_split(own, "sample_id", train, seed, within="rank")
        strata = own.withColumn("stratum", F.concat_ws(":", "rank", "label"))  # each rank's classes keep their shares
        return train_test_split(strata, "sample_id", train, seed, stratify="stratum").drop("stratum")
    split = stored(train_test_split(data, "sample_id", train, seed, by))
    test = split.where("split = 'test'").withColumn("rank", F.lit(None).cast("int"))
    return ranked(split.where("split = 'train'")).unionByName(test)


def generate_and_distribute(
    spark: SparkSession, n_samples: int, n_features: int, n_classes: int, n_ranks: int, globally_balanced: bool = True, locally_balanced: bool = True, shared_test: bool = True,
    mu_data: float | str | None = None, peak: int | None = None, mu_partition: float | str | None = None, constant_size: bool = False, seed: int = 0, train: float = 0.75, stratified: bool = False, **options,
) -> DataFrame:
    """A synthetic data set with split and rank, imbalanced as a whole (mu_data, peak) and by rank (mu_partition) if asked for."""
    if globally_balanced:
        data = generate(spark, n_samples, n_features, n_classes, seed=seed, **options)
    elif mu_data is None or peak is None:
        raise ValueError("a globally imbalanced data set needs mu_data and peak")
    else:
        data = generate_skellam(spark, n_samples, n_features, n_classes, mu_data, peak, seed=seed, **options)
    return distribute(data, n_ranks, n_classes, locally_balanced, shared_test, mu_partition, constant_size, seed, train, stratified)
