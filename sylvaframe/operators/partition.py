"""Splitting and partitioning labelled tables over logical ranks.

The shuffle order is md5(seed:key), so it is the same on every engine and cluster. Positions in it are counted in 4096 hash ranges per class, so a
class that holds most rows is never ordered in one task. Where only cuts in that order are asked for, as by splits and exact partitions, the counts
of the ranges decide all rows but those of the ranges with a cut inside, and these alone are ordered. Classes are compared null-safe: NULL is a class like any other. Counts stay
in tables that are joined; only the caller's own weights come from the driver.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import stored
from .weights import alias_table, constant_size_weights, skellam_rank_weights

#: Rows of a driver-made table of weights up to which it is broadcast.
MAX_BROADCAST_ROWS = 10_000


def shuffle_key(key: str | Column, seed: int | str) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}:"), (F.col(key) if isinstance(key, str) else key).cast("string")))


def _placed(df: DataFrame, key: str, seed: int | str, by: str | None) -> DataFrame:
    """(row, class, pos, n): each row as a struct, its group, its 0-based place in the group's shuffled order and the group's size."""
    group = F.col(f"`{by}`") if by else F.lit(1)
    hashed = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"), group.alias("class"), shuffle_key(F.col(f"`{key}`"), seed).alias("hash"), F.col(f"`{key}`").alias("key"))
    hashed = hashed.withColumn("range", F.substring("hash", 1, 3))
    counts = hashed.groupBy("class", "range").agg(F.count("*").alias("k"))
    of_class = Window.partitionBy("class")
    before = F.coalesce(F.sum("k").over(of_class.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = counts.select(F.col("class").alias("s_class"), F.col("range").alias("s_range"), before.alias("start"), F.sum("k").over(of_class).alias("n"))
    joined = hashed.join(starts, F.col("class").eqNullSafe(F.col("s_class")) & (F.col("range") == F.col("s_range")))
    nth = F.row_number().over(Window.partitionBy("class", "range").orderBy("hash", "key"))
    return joined.select("row", "class", (F.col("start") + nth - 1).cast("long").alias("pos"), "n")


def _cut(df: DataFrame, key: str, seed: int | str, by: str | None, cuts_of: Callable[[DataFrame], DataFrame], digits: int = 3) -> DataFrame:
    """(row, class, cut): each row with the number of cuts at or below its place in the group's shuffled order.

    cuts_of(totals(class, n)) gives (c_class, at), the places of the cuts. Rows are counted in 16^digits hash ranges a class; a range without a cut
    inside is decided as a whole, so only rows of ranges with one are ordered, by a window in each.
    """
    group = F.col(f"`{by}`") if by else F.lit(1)
    hashed = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"), group.alias("class"), shuffle_key(F.col(f"`{key}`"), seed).alias("hash"), F.col(f"`{key}`").alias("key"))
    hashed = hashed.withColumn("range", F.substring("hash", 1, digits))
    counts = stored(hashed.groupBy("class", "range").agg(F.count("*").alias("k")))
    same = F.col("class").eqNullSafe(F.col("c_class"))
    cuts = cuts_of(counts.groupBy("class").agg(F.sum("k").alias("n"))).groupBy("c_class").agg(F.sort_array(F.collect_list("at")).alias("cuts"))
    before = F.sum("k").over(Window.partitionBy("class").orderBy("range").rowsBetween(Window.unboundedPreceding, -1))
    starts = counts.withColumn("start", F.coalesce(before, F.lit(0))).join(cuts, same, "left").drop("c_class")
    told = starts.select(
        F.col("class").alias("c_class"), F.col("range").alias("c_range"), "start", F.size(F.filter("cuts", lambda a: a <= F.col("start"))).alias("below"),
        F.filter("cuts", lambda a: (a > F.col("start")) & (a < F.col("start") + F.col("k"))).alias("inside"),
    )
    told = told.withColumn("below", F.greatest("below", F.lit(0))).withColumn("inside", F.coalesce("inside", F.array().cast("array<long>")))
    joined = hashed.join(told, same & (F.col("range") == F.col("c_range")))
    whole = joined.where(F.size("inside") == 0).select("row", "class", F.col("below").alias("cut"))
    of_range = Window.partitionBy("class", "range").orderBy("hash", "key")
    placed = joined.where(F.size("inside") > 0).withColumn("pos", F.col("start") + F.row_number().over(of_range) - 1)
    return whole.unionByName(placed.select("row", "class", (F.col("below") + F.size(F.filter("inside", lambda a: a <= F.col("pos")))).alias("cut")))


def _flat(df: DataFrame, columns: Sequence[str], name: str, value: Column) -> DataFrame:
    """The columns of the rows, and value as name in place of one of that name."""
    return df.select(*[F.col(f"row.`{c}`").alias(c) for c in columns if c != name], value.alias(name))


def with_position(df: DataFrame, key: str, seed: int | str, by: str | None = None, name: str = "pos") -> DataFrame:
    """Adds the 0-based position of each row in the shuffled order, within by if given."""
    return _flat(_placed(df, key, seed, by), df.columns, name, F.col("pos"))


def _class_table(df: DataFrame, label: str, classes: Sequence, rows: list[tuple], fields: str) -> DataFrame:
    """A table of the caller's weights by class; raises if df has rows of a class that is not in classes."""
    kind = df.schema[label].dataType.simpleString()
    spark = df.sparkSession
    known = spark.createDataFrame([(c,) for c in classes], f"k {kind}")
    other = df.select(F.col(f"`{label}`").alias("class")).distinct().join(known, F.col("class").eqNullSafe(F.col("k")), "left_anti").limit(3).collect()
    if other:
        raise RuntimeError(f"rows of classes that have no weights would stay unassigned, such as {[r[0] for r in other]}")
    table = spark.createDataFrame(rows, f"w_class {kind}, {fields}")
    return F.broadcast(table) if len(rows) <= MAX_BROADCAST_ROWS else table


def _classes_of(df: DataFrame, label: str, n: int) -> list:
    """The classes of df in order, NULL last, for weights that name none; there are as many as weights."""
    found = [r[0] for r in df.select(f"`{label}`").distinct().limit(n + 1).collect()]
    if len(found) != n:
        raise RuntimeError(f"weights are for {n} classes; name the classes that they stand for")
    return sorted((c for c in found if c is not None)) + [None] * (None in found)


def partition_class_wise(df: DataFrame, label: str, key: str, n_ranks: int, partitioner: Callable[[Column, Column, Column], Column], seed: int | str = 0) -> DataFrame:
    """Adds rank by a strategy: partitioner(class, pos, n) is the rank of the row at place pos of n in its class's shuffled order.

    A row that it gives no rank of 0 to n_ranks - 1 raises.
    """
    rank = partitioner(F.col("class"), F.col("pos"), F.col("n")).cast("int")
    placed = _placed(df, key, seed, label).withColumn("rank", rank)
    if not placed.where(F.col("rank").isNull() | ~F.col("rank").between(0, n_ranks - 1)).isEmpty():
        raise RuntimeError("the partitioner leaves rows without a rank")
    return _flat(placed, df.columns, "rank", F.col("rank"))


def even_rank(pos: Column, n: Column, n_ranks: int) -> Column:
    """Rank of a place among n in equal shares; the units left over go to the last ranks."""
    base = F.floor(n / F.lit(n_ranks))
    more = n - base * n_ranks
    cut = (n_ranks - more) * base
    return F.when(pos < cut, F.floor(pos / base)).otherwise(n_ranks - more + F.floor((pos - cut) / (base + 1))).cast("int")


def shares(df: DataFrame, label: str, weights: Sequence[Sequence[float]], classes: Sequence) -> DataFrame:
    """(w_class, w_rank, lo, hi): the places of each class that each rank gets, by largest remainder; weights is ranks x classes.

    Of equal remainders the higher ranks are served first. A class with rows but without a positive weight raises.
    """
    if bad := [c for i, c in enumerate(classes) if sum(w[i] for w in weights) <= 0]:
        if not df.where(F.coalesce(F.col(f"`{label}`").isin(*[c for c in bad if c is not None]), F.lit(None in bad))).isEmpty():
            raise ValueError("a class has no rank with a positive weight")
    rows = [(c, r, float(w[i])) for r, w in enumerate(weights) for i, c in enumerate(classes) if c not in bad]
    table = _class_table(df, label, classes, rows, "w_rank int, w double")
    counts = df.groupBy(F.col(f"`{label}`").alias("class")).agg(F.count("*").alias("n"))
    of_class = Window.partitionBy("w_class")
    exact = F.col("w") / F.sum("w").over(of_class) * F.col("n")
    based = counts.join(table, F.col("class").eqNullSafe(F.col("w_class"))).withColumn("exact", exact).withColumn("base", F.floor("exact"))
    nth = F.row_number().over(of_class.orderBy(F.round(F.col("exact") - F.col("base"), 9).desc(), F.col("w_rank").desc()))
    cnt = F.col("base") + (nth <= F.col("n") - F.sum("base").over(of_class)).cast("long")
    hi = F.sum("cnt").over(of_class.orderBy("w_rank").rowsBetween(Window.unboundedPreceding, 0))
    return based.withColumn("cnt", cnt).withColumn("hi", hi).select("w_class", "w_rank", (F.col("hi") - F.col("cnt")).alias("lo"), "hi")


def assign_ranks(df: DataFrame, label: str, key: str, n_ranks: int, weights: Sequence[Sequence[float]] | None = None, seed: int | str = 0, classes: Sequence | None = None) -> DataFrame:
    """Adds rank: exact counts per class and rank (uniform without weights), members by shuffled position.

    With weights every class of df must be among classes (default: the classes of df in order, NULL last), else RuntimeError.
    """
    if weights is None:
        base = F.floor(F.col("n") / n_ranks)
        # the units left over go to the last ranks
        at = F.transform(F.sequence(F.lit(1), F.lit(n_ranks - 1)), lambda r: r * base + F.greatest(F.lit(0), r - (n_ranks - (F.col("n") - base * n_ranks)))) if n_ranks > 1 else F.array().cast("array<long>")
        even = _cut(df, key, seed, label, lambda totals: totals.select(F.col("class").alias("c_class"), F.explode(at.cast("array<long>")).alias("at")), _digits(n_ranks))
        return _flat(even, df.columns, "rank", F.col("cut").cast("int"))
    classes = list(classes) if classes is not None else _classes_of(df, label, len(weights[0]))
    spans = shares(df, label, weights, classes)
    placed = _cut(df, key, seed, label, lambda totals: spans.select(F.col("w_class").alias("c_class"), F.col("lo").cast("long").alias("at")), _digits(n_ranks))
    # the ranks in order start at their lo, a rank without rows where the next one does
    return _flat(placed, df.columns, "rank", (F.col("cut") - 1).cast("int"))


def _digits(n_cuts: int) -> int:
    """Hex digits so that at most one of 16 hash ranges of a class has a cut inside."""
    digits = 3
    while 16**digits < 16 * n_cuts:
        digits += 1
    return digits


def balanced_partition(df: DataFrame, label: str, key: str, n_ranks: int, seed: int | str = 0) -> DataFrame:
    return assign_ranks(df, label, key, n_ranks, None, seed)


def skellam_weights(df: DataFrame, label: str, n_ranks: int, mu: float | str, constant_size: bool, classes: Sequence) -> list[list[float]]:
    """ranks x classes weights; constant_size fits them to equal rank sizes by the counts of the classes."""
    weights = skellam_rank_weights(n_ranks, len(classes), mu)
    if constant_size:  # one count a class of the driver's own matrix
        listed = [c for c in classes if c is not None]
        own = F.col(f"`{label}`").isin(*listed) if listed else F.lit(False)
        counts = dict(df.where(own | F.col(f"`{label}`").isNull()).groupBy(f"`{label}`").count().collect())
        weights = constant_size_weights(weights, [counts.get(c, 0) for c in classes])
    return weights.tolist()


def skellam_partition(df: DataFrame, label: str, key: str, n_ranks: int, mu: float | str, constant_size: bool = False, seed: int | str = 0, classes: Sequence | None = None) -> DataFrame:
    """Ranks whose class weights peak at evenly spaced classes; constant_size makes the ranks equally large."""
    if classes is None:
        classes = _classes_of(df, label, df.select(f"`{label}`").distinct().count())
    classes = list(classes)
    return assign_ranks(df, label, key, n_ranks, skellam_weights(df, label, n_ranks, mu, constant_size, classes), seed, classes)


def uniform_draw(key: str, seed: int | str) -> Column:
    """A number in [0, 1) from the first 8 hex digits of the shuffle key."""
    return F.conv(F.substring(shuffle_key(F.col(f"`{key}`"), seed), 1, 8), 16, 10).cast("double") / F.lit(float(1 << 32))


def sampled_partition(df: DataFrame, label: str, key: str, n_ranks: int, weights: Sequence[Sequence[float]] | None = None, seed: int | str = 0, classes: Sequence | None = None) -> DataFrame:
    """Adds rank drawn independently per row by its class's weights (uniform without weights): one draw and one lookup in the class's alias table, however many ranks there are.

    Rows of a class without weights raise.
    """
    u = uniform_draw(key, seed)
    if weights is None:
        return df.withColumn("rank", F.least(F.lit(n_ranks - 1), F.floor(u * n_ranks)).cast("int"))
    classes = list(classes) if classes is not None else _classes_of(df, label, len(weights[0]))
    rows = [(c, *alias_table([w[i] for w in weights])) for i, c in enumerate(classes)]
    table = _class_table(df, label, classes, rows, "keep array<double>, alias array<int>")
    drawn = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"), F.col(f"`{label}`").alias("class"), (u * n_ranks).alias("u"))
    column = F.least(F.lit(n_ranks - 1), F.floor("u")).cast("int")
    joined = drawn.join(table, F.col("class").eqNullSafe(F.col("w_class"))).withColumn("i", column)
    taken = F.when(F.col("u") - F.col("i") < F.col("keep")[F.col("i")], F.col("i")).otherwise(F.col("alias")[F.col("i")])
    return _flat(joined, df.columns, "rank", taken.cast("int"))


def local_subset(ranked: DataFrame, rank: int) -> DataFrame:
    """The rows of one rank."""
    return ranked.where(F.col("rank") == rank)


def indices_by_rank(ranked: DataFrame, key: str) -> DataFrame:
    """(rank, indices): the sorted keys of each rank as one array, so a rank must fit in memory, as it does where a forest is grown."""
    return ranked.groupBy("rank").agg(F.sort_array(F.collect_list(f"`{key}`")).alias("indices"))


def train_test_split(df: DataFrame, key: str, train: float = 0.75, seed: int | str = 0, stratify: str | None = None, within: str | None = None) -> DataFrame:
    """Adds split: ceil((1 - train) n) rows are test, exactly; stratify shares them over classes by largest remainder, within splits each group. NULL is a class and a group."""
    n_test = F.ceil(F.round(F.col("n") * (1 - train), 9))

    def cuts(totals: DataFrame) -> DataFrame:
        if stratify is None:
            return totals.select(F.col("class").alias("c_class"), n_test.cast("long").alias("at"))
        whole = Window.partitionBy()  # one row a class
        total = F.sum("n").over(whole)
        tests = F.ceil(F.round(total * (1 - train), 9))
        based = totals.withColumn("tests", tests).withColumn("exact", F.col("n") / total * F.col("tests")).withColumn("base", F.floor("exact"))
        nth = F.row_number().over(whole.orderBy(F.round(F.col("exact") - F.col("base"), 9).desc(), F.col("class").desc_nulls_last()))
        k_test = F.col("base") + (nth <= F.col("tests") - F.sum("base").over(whole)).cast("long")
        return based.select(F.col("class").alias("c_class"), k_test.cast("long").alias("at"))

    placed = _cut(df, key, seed, stratify or within, cuts)
    return _flat(placed, df.columns, "split", F.when(F.col("cut") < 1, "test").otherwise("train"))


def _placed_by_file(df: DataFrame) -> DataFrame:
    """(row, place, total): the rows numbered from 0 in reading order, and their number.

    Reading order is that of files by path, of the blocks that a file is read in, and of the rows of a block, whichever tasks read them. df must show
    the file's metadata, as scans and projections and filters of them do; other frames are numbered in the order of their partitions. Rows are counted by block, one row a
    block is ordered, and a second scan adds what comes before its block to each row's place in it.
    """
    number = F.monotonically_increasing_id()
    try:
        df.select("_metadata.file_path").schema  # noqa: B018  # resolves or raises
        block = [F.col("_metadata.file_path"), F.col("_metadata.file_block_start")]
    except AnalysisException:
        block = [F.lit(""), F.shiftright(number, 33)]
    read = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"), block[0].alias("file"), block[1].alias("start"), number.alias("id"))
    sizes = read.groupBy("file", "start").agg(F.count("*").alias("n"), F.min("id").alias("first"))
    order = Window.orderBy("file", "start")  # one row a block
    before = F.coalesce(F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    blocks = stored(sizes.select(F.col("file").alias("b_file"), F.col("start").alias("b_start"), (before - F.col("first")).alias("shift"), F.sum("n").over(Window.partitionBy()).alias("total")))
    joined = read.join(blocks, (F.col("file") == F.col("b_file")) & (F.col("start") == F.col("b_start")))
    return joined.select("row", (F.col("id") + F.col("shift")).alias("place"), "total")


def tail_split(df: DataFrame, n_test: int) -> DataFrame:
    """Adds split: the last n_test rows in reading order, over any number of files and blocks, are test."""
    return _flat(_placed_by_file(df), df.columns, "split", F.when(F.col("place") >= F.col("total") - n_test, "test").otherwise("train"))


def first_rows(df: DataFrame, n: int) -> DataFrame:
    """The first n rows in reading order; all where there are fewer."""
    return _placed_by_file(df).where(F.col("place") < n).select("row.*")


def normalize(df: DataFrame, columns: Sequence[str], train: Column) -> DataFrame:
    """z-scores by mean and population standard deviation of the train rows."""
    stats = df.where(train).agg(*[f(c).alias(f"__{n}_{c}") for c in columns for n, f in (("m", F.avg), ("s", F.stddev_pop))])
    scaled = df.crossJoin(stats)  # one row
    return scaled.select(*[F.try_divide(F.col(c) - F.col(f"__m_{c}"), F.col(f"__s_{c}")).alias(c) if c in columns else F.col(c) for c in df.columns])


def normalize_features(df: DataFrame, train: Column, features: str = "features") -> DataFrame:
    """z-scores of the elements of a feature array by mean and population standard deviation of the train rows; constant features become NULL."""
    width = df.select(F.size(features)).first()
    n = width[0] if width else 0
    stats = df.where(train).agg(F.array(*[F.avg(F.col(features)[i]) for i in range(n)]).alias("__m"), F.array(*[F.stddev_pop(F.col(features)[i]) for i in range(n)]).alias("__s"))
    z = F.transform(features, lambda x, i: F.try_divide(x - F.col("__m")[i], F.col("__s")[i]).cast("float"))
    return df.crossJoin(stats).select(*[z.alias(c) if c == features else F.col(f"`{c}`") for c in df.columns])  # one row
