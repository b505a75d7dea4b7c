"""Class statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def class_frequency(df: DataFrame, label: str) -> DataFrame:
    """(class, cnt, share)."""
    counts = df.groupBy(F.col(label).alias("class")).agg(F.count("*").alias("cnt"))
    return counts.withColumn("share", F.col("cnt") / F.sum("cnt").over(Window.partitionBy()))


def class_frequency_by_rank(df: DataFrame, label: str, rank: str, n_ranks: int) -> DataFrame:
    """(rank, class, cnt), zero-filled over all ranks and the classes that occur."""
    counts = df.groupBy(F.col(rank).cast("int").alias("rank"), F.col(label).alias("class")).agg(F.count("*").alias("cnt"))
    ranks = df.sparkSession.range(n_ranks).select(F.col("id").cast("int").alias("rank"))
    spine = ranks.crossJoin(counts.select("class").distinct())  # ranks times classes
    return spine.join(counts, ["rank", "class"], "left").select("rank", "class", F.coalesce("cnt", F.lit(0).cast("long")).alias("cnt"))


def class_imbalance(df: DataFrame, label: str) -> DataFrame:
    """One row: n_classes, largest and smallest share and their ratio."""
    return class_frequency(df, label).agg(
        F.count("*").alias("n_classes"), F.max("share").alias("max_share"), F.min("share").alias("min_share"), (F.max("cnt") / F.min("cnt")).alias("ratio")
    )


def summary(df: DataFrame, label: str) -> str:
    """Size and class shares of a table in one line; one row a class reaches the driver."""
    rows = class_frequency(df, label).orderBy("class").collect()
    return f"{sum(r.cnt for r in rows)} samples, " + ", ".join(f"class {r['class']}: {r.share:.1%}" for r in rows)


def class_frequency_dense(df: DataFrame, label: str, rank: str, n_ranks: int, n_classes: int) -> DataFrame:
    """(scope, rank, class, cnt): per rank and for all ranks (scope global, rank NULL), zero-filled over classes 0 to n_classes - 1."""
    by_rank = df.groupBy(F.col(rank).cast("int").alias("rank"), F.col(label).cast("int").alias("class")).agg(F.count("*").alias("cnt"))
    spark = df.sparkSession
    spine = spark.range(n_ranks * n_classes).select(F.floor(F.col("id") / n_classes).cast("int").alias("rank"), (F.col("id") % n_classes).cast("int").alias("class"))
    local = spine.join(by_rank, ["rank", "class"], "left").select(F.lit("local").alias("scope"), "rank", "class", F.coalesce("cnt", F.lit(0).cast("long")).alias("cnt"))
    whole = local.groupBy("class").agg(F.sum("cnt").alias("cnt")).select(F.lit("global").alias("scope"), F.lit(None).cast("int").alias("rank"), "class", "cnt")
    return local.unionByName(whole)
