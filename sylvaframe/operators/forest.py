"""Random forests as a tree table: train per rank, vote, predict, evaluate, checkpoint.

A tree is rows (rank, tree_id, node_id, feature, threshold, left, right, votes); left = -1 marks a leaf, votes are its class shares.
Global voting and a shared model are one relational plan over the same table, local models are its filter by rank.
"""

from __future__ import annotations

import json
import time
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import metrics
from ..sources.shared import exists, remove, stored
from .weights import rank_seeds, tree_counts

TREE_SCHEMA = "rank int, tree_id int, node_id int, feature int, threshold double, left int, right int, votes array<double>"
_COLUMNS = [c.split()[0] for c in TREE_SCHEMA.split(", ")]
#: Nodes of a part of the model that is sent to the workers at once; larger models vote part by part.
PART_NODES = 1_000_000


def grow_tree(x: np.ndarray, y: np.ndarray, n_classes: int, rng: np.random.RandomState, bootstrap: bool = True) -> list[tuple]:
    """One fully grown CART tree: gini, square root of the features per node, exact thresholds."""
    if bootstrap:
        rows = rng.randint(0, len(y), len(y))
        x, y = x[rows], y[rows]
    nodes: list[list] = []
    todo = [(np.arange(len(y)), 0)]
    nodes.append([0, -1, 0.0, -1, -1, None])
    n_features = max(1, int(np.sqrt(x.shape[1])))
    while todo:
        own, at = todo.pop()
        counts = np.bincount(y[own], minlength=n_classes).astype(float)
        nodes[at][5] = (counts / counts.sum()).tolist()
        best = None
        if np.count_nonzero(counts) > 1:
            for tried, f in enumerate(rng.permutation(x.shape[1])):
                if tried >= n_features and best:
                    break
                values = x[own, f]
                order = np.argsort(values, kind="stable")
                v = values[order]
                cut = np.flatnonzero(v[1:] > v[:-1])
                if not len(cut):
                    continue
                left = np.cumsum(np.eye(n_classes)[y[own][order]], axis=0)[cut]
                n_left = cut + 1.0
                right = counts - left
                score = (left**2).sum(axis=1) / n_left + (right**2).sum(axis=1) / (len(own) - n_left)
                i = int(np.argmax(score))
                if best is None or score[i] > best[0]:
                    best = score[i], int(f), float((v[cut[i]] + v[cut[i] + 1]) / 2), own[values <= (v[cut[i]] + v[cut[i] + 1]) / 2], own[values > (v[cut[i]] + v[cut[i] + 1]) / 2]
        if best and len(best[3]) and len(best[4]):
            a, b = len(nodes), len(nodes) + 1
            nodes[at][1:5] = [best[1], best[2], a, b]
            nodes += [[a, -1, 0.0, -1, -1, None], [b, -1, 0.0, -1, -1, None]]
            todo += [(best[3], a), (best[4], b)]
    return [tuple(n) for n in nodes]


def train(
    df: DataFrame, n_classes: int, n_trees: int, n_ranks: int = 1, seed: int | None = 0, replicated: bool = True, features: str = "features", label: str = "label", rank: str = "rank", add_rank: bool = False,
    timed: bool = False, only: Sequence[int] | None = None,
) -> DataFrame:
    """Tree table of n_trees over n_ranks. replicated: every rank sees all rows; otherwise only its own.

    A rank's rows are one group, sent once: sub-forests are local by definition, so a rank must fit in a worker, and more data takes more
    ranks. Rows are ordered by all their values before trees are grown, so the result does not depend on the order of arrival.

    timed adds seconds, taken where the rank is trained: at the root of each tree the time that it took, with that of ordering the rank's rows at
    the rank's first tree, else NULL. only: the ranks to train, whose trees are those that they have in the whole model.
    """
    counts, seeds = tree_counts(n_trees, n_ranks), rank_seeds(seed, n_ranks, add_rank)
    offsets = np.concatenate([[0], np.cumsum(counts)]).tolist()
    wanted = sorted(set(range(n_ranks) if only is None else only))
    own = F.explode(F.array(*[F.lit(r) for r in wanted]).cast("array<int>")) if replicated else F.col(rank)
    rows = df.select(F.col(features).cast("array<double>").alias("x"), F.col(label).cast("int").alias("y"), own.alias("rank"))
    if not replicated and only is not None:
        rows = rows.where(F.col("rank").isin(wanted))

    def grow(part: pd.DataFrame) -> pd.DataFrame:
        began = time.perf_counter()
        r = int(part["rank"].iloc[0])
        x, y = np.stack(part["x"].to_numpy()), part["y"].to_numpy()
        order = np.lexsort([*x.T, y])  # rows that are equal in all of these are interchangeable
        x, y = x[order], y[order]
        out = []
        for t in range(counts[r]):
            rng = np.random.RandomState(None if seeds[r] is None else (seeds[r] + 7919 * t) % 2**32)
            tree = grow_tree(x, y, n_classes, rng)
            now = time.perf_counter()
            out += [(r, offsets[r] + t, *n, now - began if n[0] == 0 else None) for n in tree]
            began = now
        return pd.DataFrame(out, columns=[*_COLUMNS, "seconds"])

    grown = rows.groupBy("rank").applyInPandas(grow, f"{TREE_SCHEMA}, seconds double")
    return grown if timed else grown.drop("seconds")


def times_by_rank(timed: DataFrame) -> DataFrame:
    """(rank, time_sec_training) of a stored tree table with seconds; a rank without trees has no row."""
    return timed.groupBy("rank").agg(F.sum("seconds").alias("time_sec_training"))


def shared_model(trees: DataFrame) -> DataFrame:
    """The trees of all ranks in the order of a shared model: the first tree of each rank, the second of each, and so on."""
    nth = F.dense_rank().over(Window.partitionBy("rank").orderBy("tree_id"))
    return trees.withColumn("local_tree", nth - 1).orderBy("local_tree", "rank", "node_id")


def _parts(trees: DataFrame, part_nodes: int) -> Iterator[DataFrame]:
    """The model in runs of whole trees of about part_nodes nodes; one row a tree reaches the driver."""
    sizes = trees.groupBy("tree_id").agg(F.count("*").alias("n")).orderBy("tree_id").collect()
    first, size = None, 0
    for i, r in enumerate(sizes):
        first = r.tree_id if first is None else first
        size += r.n
        if i + 1 == len(sizes) or size + sizes[i + 1].n > part_nodes:
            yield trees.where(F.col("tree_id").between(first, r.tree_id))
            first, size = None, 0


def _add_votes(df: DataFrame, part: DataFrame, n_ranks: int, n_classes: int, features: str, hard: bool) -> DataFrame:
    """df(row, sums): the votes of one part of the model added to sums, ranks times classes."""
    model = part.orderBy("tree_id", "node_id").toPandas()
    forest = [(int(g["rank"].iloc[0]), *(g[c].to_numpy() for c in ("feature", "threshold", "left", "right")), np.stack(g["votes"].to_numpy())) for _, g in model.groupby("tree_id")]
    sent = df.sparkSession.sparkContext.broadcast(forest)

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            x = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
            sums = np.array(batch.column(2).flatten()).reshape(len(x), n_ranks, n_classes)
            for r, feature, threshold, left, right, share in sent.value:
                at = np.zeros(len(x), int)
                while (inner := left[at] >= 0).any():
                    i = np.flatnonzero(inner)
                    down = x[i, feature[at[i]]] <= threshold[at[i]]
                    at[i] = np.where(down, left[at[i]], right[at[i]])
                leaf = share[at]
                sums[:, r] += np.eye(n_classes)[leaf.argmax(axis=1)] if hard else leaf
            votes = pa.ListArray.from_arrays(np.arange(len(x) + 1, dtype=np.int32) * (n_ranks * n_classes), sums.reshape(-1))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), votes], names=["row", "x", "sums"])

    return df.mapInArrow(run, df.schema)


def vote(df: DataFrame, trees: DataFrame, n_classes: int, features: str = "features", by_rank: bool = False, voting: str = "rounded", part_nodes: int | None = None) -> DataFrame:
    """df with votes array (by_rank: one array of arrays per rank), dense over the classes.

    rounded: per-rank sums of leaf shares, rounded half to even; soft: not rounded; hard: one vote per tree. The model is sent in parts of about
    part_nodes (PART_NODES) nodes, whose votes add up, so it may have any number of trees. A null feature goes right; each row needs an array of all features.
    """
    if voting not in ("rounded", "soft", "hard"):
        raise ValueError(voting)
    n_ranks = (trees.agg(F.max("rank")).first()[0] or 0) + 1
    columns = [c for c in df.columns if c != "votes"]
    zeros = F.array_repeat(F.lit(0.0), n_ranks * n_classes)
    voted = df.select(F.struct(*[F.col(f"`{c}`") for c in columns]).alias("row"), F.col(features).cast("array<double>").alias("x"), zeros.alias("sums"))
    for i, part in enumerate(_parts(trees, part_nodes or PART_NODES)):
        voted = _add_votes(stored(voted) if i else voted, part, n_ranks, n_classes, features, voting == "hard")
    value = (lambda x: F.rint(x)) if voting == "rounded" else (lambda x: x)
    ranks = F.array(*[F.transform(F.slice("sums", r * n_classes + 1, n_classes), value) for r in range(n_ranks)])
    total = F.expr(f"transform(sequence(0, {n_classes - 1}), c -> aggregate(v, 0D, (a, x) -> a + x[c]))")
    return voted.withColumn("v", ranks).select(*[F.col(f"row.`{c}`") for c in columns], (F.col("v") if by_rank else total).alias("votes"))


def first_argmax(votes: Column) -> Column:
    """Class with most votes; the smallest on ties."""
    return (F.array_position(votes, F.array_max(votes)) - 1).cast("int")


def predict(df: DataFrame, trees: DataFrame, n_classes: int, features: str = "features", voting: str = "rounded", part_nodes: int | None = None) -> DataFrame:
    return vote(df, trees, n_classes, features, voting=voting, part_nodes=part_nodes).withColumn("prediction", first_argmax(F.col("votes")))


def score(df: DataFrame, trees: DataFrame, n_classes: int, label: str = "label") -> float:
    return predict(df, trees, n_classes).agg(F.avg((F.col("prediction") == F.col(label)).cast("double"))).first()[0]


def evaluate(df: DataFrame, trees: DataFrame, n_classes: int, label: str = "label", features: str = "features", private: bool = False, shared_model: bool = True) -> dict[str, DataFrame]:
    """Tables of an evaluation: scores(rank, n, acc_local, acc_global_local, acc_global[, auc_local, auc_global]) and confusion(scope, rank, label, prediction, cnt).

    private: df has a column rank and each rank is judged on its own rows; otherwise every rank on all rows. acc_local judges a rank's own trees,
    acc_global_local all trees on the rank's rows (NULL without a shared model), acc_global all trees on all rows. auc_ columns for two
    classes only; NULL where a rank's rows are of one class. A rank without rows has no row in scores.
    """
    if private and not shared_model:
        raise ValueError("a private test set needs a shared model")
    voted = vote(df.select(*[F.col(f"`{c}`") for c in dict.fromkeys([label, features, *["rank"] * private])]), trees, n_classes, features, by_rank=True)
    total = F.expr(f"transform(sequence(0, {n_classes - 1}), c -> aggregate(votes, 0D, (a, v) -> a + v[c]))")
    ranks = F.expr("array(struct(rank as r, get(votes, rank) as v))") if private else F.expr("transform(votes, (v, i) -> struct(i as r, v as v))")
    cut = voted.select(F.col(f"`{label}`").cast("int").alias("label"), total.alias("total"), ranks.alias("own"))
    judged = stored(cut.withColumn("prediction", first_argmax(F.col("total"))))
    local = judged.select("label", "prediction", "total", F.explode("own").alias("o")).select("label", "prediction", "total", F.col("o.r").cast("int").alias("rank"), F.col("o.v").alias("v")).where("v is not null")
    local = local.withColumn("local", first_argmax(F.col("v")))
    right = lambda c: F.avg((F.col(c) == F.col("label")).cast("double"))
    scores = local.groupBy("rank").agg(F.count("*").alias("n"), right("local").alias("acc_local"), (right("prediction") if shared_model else F.lit(None).cast("double")).alias("acc_global_local"))
    scores = scores.crossJoin(judged.agg(right("prediction").alias("acc_global")))  # one row
    if n_classes == 2:
        by_rank = metrics.roc_auc(local.withColumn("s", F.col("v")[1]), "label", "s", "rank").withColumnsRenamed({"rank": "a_rank", "auc": "auc_local"})
        scores = scores.join(by_rank, F.col("rank") == F.col("a_rank"), "left").drop("a_rank").crossJoin(metrics.roc_auc(judged.withColumn("s", F.col("total")[1]), "label", "s").withColumnRenamed("auc", "auc_global"))
    cells = local.groupBy("rank", "label", F.col("local").alias("prediction")).agg(F.count("*").alias("cnt")).select(F.lit("local").alias("scope"), "rank", "label", "prediction", "cnt")
    whole = metrics.confusion(judged, "label", "prediction").select(F.lit("global").alias("scope"), F.lit(None).cast("int").alias("rank"), "label", "prediction", "cnt")
    return {"scores": stored(scores), "confusion": stored(cells.unionByName(whole))}


def _run_paths(path: str, run_uid: str) -> tuple[str, str]:
    base = path.rstrip("/")
    return f"{base}/run_uid={run_uid}", f"{base}/manifest-{run_uid}"


def _commit(trees: DataFrame, path: str, run_uid: str, settings: str, ranks: Sequence[int]) -> None:
    """Write the trees of these ranks in place of what an earlier try left of them, and then their rows of the manifest, which make them count.

    The manifest has a row a rank, also where it has no tree: (rank, n_trees, n_nodes, seconds, settings).
    """
    spark = trees.sparkSession
    models, committed = _run_paths(path, run_uid)
    for r in ranks:
        remove(spark, f"{models}/rank={r}")
    trees.write.mode("append").partitionBy("rank").parquet(models)
    own = spark.createDataFrame([(r,) for r in ranks], "rank int")  # a row a rank
    seconds = F.sum("seconds") if "seconds" in trees.columns else F.lit(None).cast("double")
    written = spark.read.schema(trees.schema).parquet(models).where(F.col("rank").isin(list(ranks)))
    counts = written.groupBy("rank").agg(F.countDistinct("tree_id").alias("n_trees"), F.count("*").alias("n_nodes"), seconds.alias("seconds"))
    rows = own.join(counts, "rank", "left").na.fill(0, ["n_trees", "n_nodes"]).withColumn("settings", F.lit(settings))
    rows.coalesce(1).write.mode("append").parquet(committed)


def manifest(spark: SparkSession, path: str, run_uid: str) -> DataFrame:
    """(rank, n_trees, n_nodes, seconds, settings) of the ranks of a run that are committed; seconds is NULL where training was not timed."""
    where = _run_paths(path, run_uid)[1]
    schema = "rank int, n_trees long, n_nodes long, seconds double, settings string"
    return spark.read.schema(schema).parquet(where) if exists(spark, where) else spark.createDataFrame([], schema)


def save(trees: DataFrame, path: str, run_uid: str, n_ranks: int | None = None) -> None:
    """Checkpoint: one folder per run and rank, overwritten as a whole. n_ranks: ranks of the run, where some may have no tree."""
    spark = trees.sparkSession
    models, committed = _run_paths(path, run_uid)
    kept = stored(trees)
    ranks = range(n_ranks) if n_ranks is not None else sorted(r[0] for r in kept.select("rank").distinct().collect())
    for old in (committed, models):  # the manifest first: trees without it do not count
        remove(spark, old)
    _commit(kept, path, run_uid, "", list(ranks))


def _committed(spark: SparkSession, path: str, run_uid: str) -> DataFrame:
    """The trees of the ranks in the manifest, which must have all their nodes."""
    rows = {r["rank"]: r["n_nodes"] for r in manifest(spark, path, run_uid).collect()}  # a row a rank
    trees = spark.read.schema(TREE_SCHEMA).parquet(_run_paths(path, run_uid)[0]).where(F.col("rank").isin(list(rows)))
    found = {r["rank"]: r["n"] for r in trees.groupBy("rank").agg(F.count("*").alias("n")).collect()}
    if broken := [r for r in rows if rows[r] != found.get(r, 0)]:
        raise ValueError(f"checkpoint {run_uid} lacks or repeats nodes of ranks {broken}")
    return trees.select(*_COLUMNS)


def load(spark: SparkSession, path: str, run_uid: str, n_ranks: int) -> DataFrame:
    """Tree table of a run; every rank must be committed with all its nodes."""
    ranks = sorted(r["rank"] for r in manifest(spark, path, run_uid).select("rank").collect())  # a row a rank
    if ranks != list(range(n_ranks)):
        raise ValueError(f"checkpoint {run_uid} holds ranks {ranks}, not 0 to {n_ranks - 1}")
    return _committed(spark, path, run_uid)


def train_resumable(
    df: DataFrame, n_classes: int, n_trees: int, path: str, run_uid: str, n_ranks: int = 1, seed: int = 0, replicated: bool = True, features: str = "features", label: str = "label", rank: str = "rank",
    add_rank: bool = False, wave: int | None = None, only: Sequence[int] | None = None,
) -> DataFrame:
    """train() into a checkpoint, some ranks at a time; those that an earlier try of the run committed are not trained again, and the model is that of one try.

    A wave has as many ranks as Spark runs tasks at once unless said otherwise, so a broken run loses one wave. only: the ranks of this part of the run, whose trees alone
    are returned; another call adds the rest. Raises ValueError where the run
    was begun with other rows or settings, or without a seed, as trees then could not be the same.
    """
    if seed is None:
        raise ValueError("a run that may be resumed needs a seed")
    spark = df.sparkSession
    values = [F.col(features).cast("array<double>"), F.col(label).cast("int"), *([] if replicated else [F.col(rank).cast("int")])]
    rows = df.agg(F.count("*").alias("n"), F.sum(F.xxhash64(*values).cast("decimal(38,0)")).alias("h")).first()
    settings = json.dumps([n_classes, n_trees, n_ranks, seed, replicated, add_rank, rows.n, str(rows.h)])
    done = manifest(spark, path, run_uid).collect()  # a row a rank
    if any(r["settings"] != settings for r in done):
        raise ValueError(f"run {run_uid} was begun with other rows or settings")
    asked = sorted(set(range(n_ranks) if only is None else only))
    left = sorted(set(asked) - {r["rank"] for r in done})
    wave = wave or spark.sparkContext.defaultParallelism
    for at in range(0, len(left), wave):
        ranks = left[at : at + wave]
        _commit(train(df, n_classes, n_trees, n_ranks, seed, replicated, features, label, rank, add_rank, True, ranks), path, run_uid, settings, ranks)
    return load(spark, path, run_uid, n_ranks) if only is None else _committed(spark, path, run_uid).where(F.col("rank").isin(asked))


def case_of(nodes: Sequence[dict], columns: Sequence[str], at: int = 0) -> str:
    """A shallow tree as a CASE expression of its leaf class, for plans that stay in generated code."""
    node = {n["node_id"]: n for n in nodes}[at]
    if node["left"] < 0:
        return str(int(np.argmax(node["votes"])))
    a, b = (case_of(nodes, columns, node[side]) for side in ("left", "right"))
    return f"case when {columns[node['feature']]} <= {node['threshold']}D then {a} else {b} end"
