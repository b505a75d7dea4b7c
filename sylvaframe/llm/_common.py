"""Helpers shared by the training-data operators."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.shared import drop, shared_dir, stored

__all__ = ["drop", "folded", "n_words_of", "read_table", "row_of", "shared_dir", "spread_join", "stored", "words_of"]


def words_of(text: Column) -> Column:
    """Array of the words of a text; null and blank texts have none. ASCII white space alone ends a word."""
    spaced = F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x09-\x0D]", " ")
    return F.array_remove(F.split(spaced, " "), "")


def n_words_of(text: Column) -> Column:
    return F.size(words_of(text)).cast("long")


def row_of(docs: DataFrame) -> Column:
    """A whole row as one struct, so that its columns clash with none of an operator's own."""
    return F.struct(*[F.col(f"`{c}`") for c in docs.columns])


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread_join(rows: DataFrame, facts: DataFrame, key: str, counts: DataFrame, spread: Column, how: str = "inner") -> DataFrame:
    """rows joined with facts (one row a key) on key, with the rows of hot keys spread over many tasks.

    counts(key, n) holds the rows of each key. A key is hot above a quarter of a shuffle partition's even share, so there are fewer than
    four hot keys a partition: a broadcast bounded by the partitions, not the data. Hot keys are told apart by spread, an expression over rows.
    """
    parts = 4 * int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    share = max(1.0, (counts.agg(F.sum("n")).first()[0] or 0) / parts)
    hot = F.broadcast(counts.where(F.col("n") > share).select(F.col(key).alias("__hot"), F.ceil(F.col("n") / F.lit(share)).cast("int").alias("__copies")))
    copies = F.coalesce("__copies", F.lit(1))
    is_hot = F.col(key).eqNullSafe(F.col("__hot"))
    left = rows.join(hot, is_hot, "left").withColumn("__salt", F.pmod(F.xxhash64(spread), copies).cast("int")).drop("__hot", "__copies")
    right = facts.join(hot, is_hot, "left").withColumn("__other", F.explode(F.sequence(F.lit(0), copies - 1))).drop("__hot", "__copies")
    right = right.withColumnRenamed(key, "__key")
    return left.join(right, F.expr(f"`{key}` = __key and __salt = __other"), how).drop("__key", "__salt", "__other")


def folded(rows: DataFrame, key: str, order: Sequence[str | Column], values: Sequence[str], start: Callable[[], object], step: Callable, finish: Callable[[object], tuple], schema: str) -> DataFrame:
    """(key, schema): the rows of each key folded in order; step(state, *values) changes or returns the state, finish(state) gives the columns.

    Rows stream through a task in sorted order, so that it holds one state and one batch, however many rows a key has. Null keys are one key.
    """
    kind = rows.schema[key].dataType.simpleString()
    names = [key, *[c.split()[0] for c in schema.split(", ")]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, state, out, types = None, None, [], None
        for batch in batches:
            types = [batch.schema.field(0).type]
            for own, *value in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if at is None or own != at[0]:
                    if at is not None:
                        out.append((at[0], *finish(state)))
                    at, state = (own,), start()
                changed = step(state, *value)
                state = state if changed is None else changed
            if len(out) >= 4096:
                yield packed(out, types)
                out = []
        if at is not None:
            out.append((at[0], *finish(state)))
            yield packed(out, types)

    def packed(out: list[tuple], types: list) -> pa.RecordBatch:
        columns = list(zip(*out, strict=True))
        return pa.RecordBatch.from_arrays([pa.array(columns[0], types[0]), *[pa.array(c) for c in columns[1:]]], names=names)

    sorted_rows = rows.repartition(key).sortWithinPartitions(key, *order).select(key, *values)
    return sorted_rows.mapInArrow(run, f"`{key}` {kind}, {schema}")
