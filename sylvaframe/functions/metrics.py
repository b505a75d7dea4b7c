"""Classification metrics as functions of a confusion table (label, prediction, cnt)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Bins of distinct scores.
_BINS = 256
AVERAGES = ("micro", "macro", "weighted", None)


def confusion(df: DataFrame, label: str, prediction: str) -> DataFrame:
    """Long confusion table; the only pass over the samples that any metric needs."""
    return df.groupBy(F.col(label).cast("int").alias("label"), F.col(prediction).cast("int").alias("prediction")).agg(F.count("*").alias("cnt"))


def confusion_dense(table: DataFrame) -> DataFrame:
    """Zero-filled over the sorted union of true and predicted classes."""
    classes = table.select(F.col("label").alias("k")).union(table.select("prediction")).distinct()
    grid = classes.select(F.col("k").alias("label")).crossJoin(classes.select(F.col("k").alias("prediction")))  # classes squared
    return grid.join(table, ["label", "prediction"], "left").select("label", "prediction", F.coalesce("cnt", F.lit(0).cast("long")).alias("cnt"))


def per_class(table: DataFrame) -> DataFrame:
    """(class, tp, n_true, n_pred) over the union of true and predicted classes."""
    zero = F.lit(0).cast("long")
    hit = F.when(F.col("label") == F.col("prediction"), F.col("cnt")).otherwise(zero)
    rows = table.select(F.col("label").alias("class"), hit.alias("tp"), F.col("cnt").alias("t"), zero.alias("p")).unionAll(
        table.select("prediction", zero, zero, "cnt")
    )
    return rows.groupBy("class").agg(F.sum("tp").alias("tp"), F.sum("t").alias("n_true"), F.sum("p").alias("n_pred"))


def _scores(beta: float) -> dict[str, Column]:
    b2 = F.lit(float(beta) ** 2)
    tp = F.col("tp").cast("double")
    return {
        "precision": F.try_divide(tp, F.col("n_pred").cast("double")),
        "recall": F.try_divide(tp, F.col("n_true").cast("double")),
        "fbeta": F.try_divide((1 + b2) * tp, b2 * F.col("n_true") + F.col("n_pred")),
    }


def precision_recall_fbeta(table: DataFrame, beta: float = 1.0, average: str | None = None) -> DataFrame:
    """(precision, recall, fbeta), by class if average is None. An undefined ratio is NULL and makes its average NULL."""
    if average not in AVERAGES:
        raise ValueError(f"average must be one of {AVERAGES}, not {average!r}")
    classes = per_class(table)
    if average == "micro":
        accuracy = F.try_divide(F.sum("tp").cast("double"), F.sum("n_true").cast("double"))
        return classes.agg(accuracy.alias("precision"), accuracy.alias("recall"), accuracy.alias("fbeta"))
    scored = classes.select("class", "n_true", *[c.alias(n) for n, c in _scores(beta).items()])
    if average is None:
        return scored.select("class", "precision", "recall", "fbeta")
    weight = F.col("n_true").cast("double") if average == "weighted" else F.lit(1.0)
    return scored.agg(*[_strict(F.try_divide(F.sum(weight * F.col(n)), F.sum(weight)), n).alias(n) for n in ("precision", "recall", "fbeta")])


def _strict(value: Column, name: str) -> Column:
    return F.when(F.count(name) == F.count("*"), value)


def accuracy(table: DataFrame) -> DataFrame:
    hit = F.when(F.col("label") == F.col("prediction"), F.col("cnt")).otherwise(0)
    return table.agg(F.try_divide(F.sum(hit).cast("double"), F.sum("cnt").cast("double")).alias("accuracy"))


def balanced_accuracy(table: DataFrame) -> DataFrame:
    return precision_recall_fbeta(table, average="macro").select(F.col("recall").alias("balanced_accuracy"))


def precision_score(table: DataFrame, average: str | None = None) -> DataFrame:
    return precision_recall_fbeta(table, average=average).drop("recall", "fbeta")


def recall_score(table: DataFrame, average: str | None = None) -> DataFrame:
    return precision_recall_fbeta(table, average=average).drop("precision", "fbeta")


def fbeta_score(table: DataFrame, beta: float, average: str | None = None) -> DataFrame:
    return precision_recall_fbeta(table, beta, average).drop("precision", "recall")


def f1_score(table: DataFrame, average: str | None = None) -> DataFrame:
    return fbeta_score(table, 1.0, average).withColumnRenamed("fbeta", "f1")


def agreement(table: DataFrame) -> DataFrame:
    """(cohen_kappa, matthews): kappa is NULL where chance agreement is 1, matthews 0 where undefined."""
    d = lambda name: F.col(name).cast("double")
    sums = per_class(table).agg(
        F.sum(d("tp")).alias("c"), F.sum(d("n_true")).alias("s"), F.sum(d("n_true") * d("n_pred")).alias("tp"),
        F.sum(d("n_pred") * d("n_pred")).alias("pp"), F.sum(d("n_true") * d("n_true")).alias("tt"),
    )
    pe = F.try_divide(F.col("tp"), F.col("s") * F.col("s"))
    kappa = F.try_divide(F.try_divide(F.col("c"), F.col("s")) - pe, 1 - pe)
    root = F.sqrt((F.col("s") * F.col("s") - F.col("pp")) * (F.col("s") * F.col("s") - F.col("tt")))
    mcc = F.when(root == 0, 0.0).otherwise(F.try_divide(F.col("c") * F.col("s") - F.col("tp"), root))
    return sums.select(kappa.alias("cohen_kappa"), mcc.alias("matthews"))


def roc_auc(df: DataFrame, label: str, score: str, by: str | None = None) -> DataFrame:
    """Area under the ROC curve of a binary label, of each group by if given: Mann-Whitney with ties counted half, over the distinct scores.

    Distinct scores are cut at their quantiles into bins, in which they are ordered, so no group is ordered in one task. NULL where one class is absent.
    """
    y, g = F.col(label).cast("long"), F.col(by) if by else F.lit(1)
    by_score = df.groupBy(g.alias("g"), F.col(score).cast("double").alias("score")).agg(F.sum(y).alias("pos"), F.sum(1 - y).alias("neg"))
    cuts = by_score.agg(F.percentile_approx("score", [i / _BINS for i in range(1, _BINS)], 10_000).alias("cuts"))  # one row
    binned = by_score.crossJoin(cuts).select("g", "score", "pos", "neg", F.size(F.filter("cuts", lambda c: c < F.col("score"))).alias("bin"))
    starts = binned.groupBy("g", "bin").agg(F.sum("neg").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("g").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = binned.join(starts.select(F.col("g").alias("s_g"), F.col("bin").alias("s_bin"), before.alias("start")), F.expr("g <=> s_g and bin = s_bin"))
    inside = F.coalesce(F.sum("neg").over(Window.partitionBy("g", "bin").orderBy("score").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    won = placed.select("g", "pos", "neg", (F.col("pos") * (F.col("start") + inside + F.col("neg") / 2.0)).alias("won"))
    auc = F.try_divide(F.sum("won"), F.sum("pos").cast("double") * F.sum("neg")).alias("auc")
    return won.groupBy(F.col("g").alias(by)).agg(auc) if by else won.agg(auc)
