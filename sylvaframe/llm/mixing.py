"""Mixing sources to target weights by fitting word budgets as a bounded subset-sum problem.

Documents are counted by exact length within each source. A source's budget is first spent on whole passes over the source;
what is left is a bounded subset-sum over the counted lengths, which is solved to the optimum. How many documents of each length
are taken is thus fixed; which of them is decided by a seeded hash order.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._common import n_words_of, row_of, stored

WEIGHTS = (5.0, 2.0, 1.0)
MAX_PASSES = 3
#: Words and documents of a length that the programme starts with; both grow until the budget is met or all documents are in it.
FIRST_WORDS, FIRST_COPIES = 1 << 16, 8


def fit_budget(lengths: np.ndarray, counts: np.ndarray, budget: int) -> np.ndarray:
    """How many documents of each length to take: at most counts, their words the largest sum that is no more than budget.

    lengths are distinct and positive. A pool of documents, from the shortest lengths on, is left to the dynamic programme; the others
    are taken in proportion and then from the longest. A sum that meets the budget is the optimum; where the pool has none it grows, up
    to all documents. Deterministic.
    """
    order = np.argsort(lengths)
    l, c = lengths[order].astype(np.int64), counts[order].astype(np.int64)
    whole = int((l * c).sum())
    out = np.zeros_like(c)
    if budget >= whole:
        out[order] = c
        return out
    if budget <= 0 or not len(l):
        return out
    common = int(np.gcd.reduce(l))
    l, budget, whole = l // common, budget // common, whole // common
    words, copies = FIRST_WORDS, FIRST_COPIES
    while True:
        pool = np.minimum(c, copies)
        pool[np.cumsum(pool * l) > max(words, int(l[0]))] = 0
        is_all = bool((pool == c).all())
        share = np.array([int(x) * budget // whole for x in c], np.int64)
        take = np.clip(share - pool // 2, 0, c - pool)  # half of the pool's documents may come, half may go
        left = budget - int((l * take).sum())
        for i in range(len(l) - 1, -1, -1):
            k = min(int(c[i] - pool[i] - take[i]), max(0, left - int((l * pool).sum()) // 2) // int(l[i]))
            if k > 0:
                take[i] += k
                left -= k * int(l[i])
        added, gap = _knapsack(l, pool, left)
        if gap == 0 or is_all:
            out[order] = take + added
            return out
        words, copies = words * 4, copies * 2


def _knapsack(lengths: np.ndarray, counts: np.ndarray, budget: int) -> tuple[np.ndarray, int]:
    """Bounded knapsack by binary splitting: (documents of each length, words short of budget) of the nearest sum from below."""
    top = min(budget, int((lengths * counts).sum()))
    came = np.full(top + 1, -1, np.int32)  # the item that first reached a sum
    reach = np.zeros(top + 1, bool)
    reach[0] = True
    items: list[tuple[int, int]] = []
    for i, (n, c) in enumerate(zip(lengths.tolist(), counts.tolist(), strict=True)):
        c, size = min(c, top // n), 1
        while c > 0:
            size = min(size, c)
            weight = size * n
            new = np.zeros_like(reach)
            new[weight:] = reach[: top + 1 - weight]
            new &= ~reach
            came[new] = len(items)
            reach |= new
            items.append((i, size))
            c -= size
            size *= 2
        if reach[top]:
            break
    take, at = np.zeros(len(lengths), np.int64), int(np.flatnonzero(reach)[-1])
    short = budget - at
    while at:
        i, size = items[came[at]]
        take[i] += size
        at -= size * int(lengths[i])
    return take, short


def source_targets(sizes: DataFrame, weights: Sequence[float] = WEIGHTS, most: float = MAX_PASSES) -> DataFrame:
    """sizes(source, source_size), one row a source -> the same with target.

    Sources are ordered by code point, null last, and get the weights in turn; targets share the sum of sizes by weight, stop at most *
    size, and the excess goes to the others by weight until none is above. Only counts of the ordered partitions and one number a round
    reach the driver, however many sources there are.
    """
    by = F.col("source").asc_nulls_last()
    ordered = stored(sizes.repartitionByRange(by).sortWithinPartitions(by).select("*", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("at")))
    parts = ordered.groupBy("part").agg(F.count("*").alias("n"), F.min("at").alias("first")).orderBy("part").collect()
    before = np.concatenate([[0], np.cumsum([p.n for p in parts])]).tolist()
    spark = sizes.sparkSession
    # one row a shuffle partition
    starts = F.broadcast(spark.createDataFrame([(p.part, b - p.first) for p, b in zip(parts, before, strict=False)], "part int, start long"))
    weight = F.element_at(F.array(*map(F.lit, map(float, weights))), ((F.col("at") + F.col("start")) % len(weights) + 1).cast("int"))
    weighted = stored(ordered.join(starts, "part").select("source", "source_size", weight.alias("weight")), replaces=ordered)
    total = float(weighted.agg(F.sum("source_size")).first()[0] or 0)
    cap, level, known = F.col("source_size") * float(most), 0.0, None
    while True:  # level grows; a target is the smaller of level * weight and the source's cap
        above = cap < F.col("weight") * level
        row = weighted.where("source_size > 0").agg(
            F.sum(F.when(above, cap).otherwise(0.0)).alias("capped"), F.sum(F.when(above, 0.0).otherwise(F.col("weight"))).alias("open"), F.count(F.when(above, 1)).alias("n")
        ).first()
        if row.n == known or not row.open:
            break
        known, level = row.n, (total - row.capped) / row.open
    return weighted.select("source", "source_size", F.when(F.col("source_size") > 0, F.least(cap, F.col("weight") * level)).otherwise(0.0).alias("target"))


def _passes() -> tuple[Column, Column]:
    """Whole passes over a source, and the words still wanted after them."""
    want = F.bround("target").cast("long")
    passes = F.when(F.col("source_size") > 0, F.least(F.lit(MAX_PASSES), F.floor(want / F.col("source_size")))).otherwise(0).cast("int")
    return passes, F.when(passes == MAX_PASSES, 0).otherwise(want - passes * F.col("source_size")).cast("long")


def mix(
    docs: DataFrame, weights: Sequence[float] = WEIGHTS, seed: str = "mix", id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", with_row: bool = False
) -> DataFrame:
    """(doc_id, size, source, source_size, target, taken, copies): one row per row of docs; with_row adds it as struct row.

    size counts words (null text: 0). Sources are ordered by code point, null (a source of its own) last, and get the weights in
    turn. taken = size * copies, copies is 0 to 3. Documents of size 0 have copies 0, and so has a source of such documents, whose target
    is 0. Repeated rows are rows of their own. An empty table gives an empty result. Which rows are taken depends on seed, doc_id, text, size
    and source; rows equal in all of these are interchangeable, and rows without doc_id are taken by their place in docs. Other columns
    never clash.
    """
    text = F.col(text_col).cast("string")
    chosen = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(source_col).cast("string").alias("source"), n_words_of(text).alias("size"), F.xxhash64(text).alias("of_text"), *[row_of(docs).alias("row")] * with_row)
    chosen = chosen.withColumn("place", F.monotonically_increasing_id())
    place = F.when(F.col("doc_id").isNull(), F.col("place"))
    # a group of one source and length falls into 65 536 hash ranges, of which only the one where the taking stops needs an order
    sized = stored(chosen.withColumn("hash", F.xxhash64(F.lit(seed), "doc_id", "of_text", place)).drop("of_text").withColumn("range", F.shiftright("hash", 48).cast("int")))
    sizes = stored(sized.groupBy("source").agg(F.sum("size").alias("source_size")))
    passes, budget = _passes()
    plan = source_targets(sizes, weights).select("source", "source_size", "target", passes.alias("passes"), budget.alias("budget"))
    ranges = stored(sized.groupBy("source", "size", "range").agg(F.count("*").alias("n")))
    lengths = ranges.groupBy("source", "size").agg(F.sum("n").alias("n"))
    planned = lengths.join(plan.withColumnRenamed("source", "p_source"), F.expr("source <=> p_source")).drop("p_source")

    def fit(part: pd.DataFrame) -> pd.DataFrame:
        # one row a length: as many as the longest text has words at most
        own = part["size"].to_numpy() > 0
        taken = np.zeros(len(part), np.int64)
        taken[own] = fit_budget(part["size"].to_numpy()[own], part["n"].to_numpy()[own], int(part["budget"].iloc[0]))
        return part.drop(columns=["n", "budget"]).assign(k=taken)

    fitted = planned.groupBy("source").applyInPandas(fit, "source string, size long, source_size long, target double, passes int, k long")
    before = F.sum("n").over(Window.partitionBy("source", "size").orderBy("range").rowsBetween(Window.unboundedPreceding, -1))
    decided = (
        ranges.withColumn("before", F.coalesce(before, F.lit(0)))
        .join(fitted.withColumnsRenamed({"source": "f_source", "size": "f_size"}), F.expr("source <=> f_source and size = f_size"))
        .select(
            F.col("source").alias("q_source"), F.col("size").alias("q_size"), F.col("range").alias("q_range"), "source_size", "target", "passes",
            F.greatest(F.lit(0), F.least("n", F.col("k") - F.col("before"))).alias("quota"),
        )
    )
    nth = F.row_number().over(Window.partitionBy("source", "size", "range").orderBy("hash", "doc_id"))
    slim = sized.select("doc_id", "source", "size", "hash", "range", "place")
    placed = slim.join(decided, F.expr("source <=> q_source and size = q_size and range = q_range")).withColumn("nth", nth)
    copies = F.when(F.col("size") > 0, F.col("passes") + (F.col("nth") <= F.col("quota")).cast("int")).otherwise(0).cast("int")
    out = placed.withColumn("copies", copies).select("doc_id", "size", "source", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "copies", *["place"] * with_row)
    return out.join(sized.select("place", "row"), "place").drop("place") if with_row else out
