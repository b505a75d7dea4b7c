"""Scalar expressions: log fields, units, problem size, runtime models. Unmatched or undefined values are NULL."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F


def field(text: Column, pattern: str, kind: str = "double") -> Column:
    """First group of a pattern, cast; NULL if it does not match."""
    return F.nullif(F.regexp_extract(text, pattern, 1), F.lit("")).try_cast(kind)


def time_to_seconds(text: Column) -> Column:
    """Seconds of d-hh:mm:ss or hh:mm:ss."""
    part = lambda i: F.regexp_extract(text, r"^(?:(\d+)-)?(\d+):(\d{2}):(\d{2})", i)
    days = F.coalesce(F.nullif(part(1), F.lit("")).cast("double"), F.lit(0.0))
    return F.when(part(2) != "", days * 86400 + part(2).try_cast("double") * 3600 + part(3).try_cast("double") * 60 + part(4).try_cast("double"))


def to_gigabytes(value: Column, unit: Column) -> Column:
    return F.when(unit == "TB", value * 1024).when(unit == "MB", value / 1024).otherwise(value)


def problem_size(n: Column, m: Column, t: Column) -> Column:
    n = n.cast("double")
    return n * F.log2(n) * F.sqrt(m.cast("double")) * t


def mean_power(watt_hours: Column, seconds: Column, tasks: Column) -> Column:
    return F.try_divide(F.try_divide(watt_hours, seconds / 3600.0), tasks)


def scientific(value: Column) -> Column:
    return F.when(value.isNotNull(), F.format_string("%.0E", value.cast("double")))


def nodes_of(ranges: Column) -> Column:
    """Node names of a list such as [0041-0042,0016], four digits each; without brackets none."""
    inner = F.regexp_extract(ranges, r"\[([0-9,\- ]+)\]", 1)
    ends = F.transform(F.filter(F.split(inner, ","), lambda x: x != ""), lambda x: F.split(F.trim(x), "-"))
    spans = F.transform(ends, lambda e: F.sequence(F.element_at(e, 1).cast("int"), F.element_at(e, -1).cast("int")))
    return F.transform(F.flatten(spans), lambda i: F.lpad(i.cast("string"), 4, "0"))


def strong_runtime(serial: Column, nodes: Column, overhead: float = 0.25) -> Column:
    return serial * ((1 - F.lit(overhead)) / nodes + F.lit(overhead))


def weak_runtime(serial: Column, nodes: Column, overhead: float = 0.01) -> Column:
    return serial * (1 + F.lit(overhead) * nodes)


def mapped(value: Column, names: Mapping[str, str], other: str | None = None) -> Column:
    """A value by a dictionary; other for values that are not in it."""
    table = F.create_map(*[F.lit(x) for pair in names.items() for x in pair])
    return F.coalesce(F.try_element_at(table, value), F.lit(other))


def tree_share(trees: Column, ranks: Column, rank: Column) -> Column:
    """Trees of a rank; the first ranks get the remainder."""
    return F.floor(trees / ranks) + (rank < trees % ranks).cast("int")


def scaled_trees(trees: Column, ranks: Column, scaling: str | None) -> tuple[Column, Column]:
    """(local, global) number of trees under strong, weak or no scaling."""
    if scaling == "strong":
        return F.floor(trees / ranks), F.floor(trees / ranks) * ranks
    return trees, trees * ranks if scaling == "weak" else trees
