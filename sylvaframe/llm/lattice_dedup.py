"""Near-duplicate vectors by lattice hashing.

A unit vector is projected by seeded Gaussian matrices to BLOCKS times 8 dimensions in each of TABLES tables; each 8 of them are decoded to the
nearest point of the lattice E8. A vector lies in its own cell and in the PROBES - 1 neighbouring cells nearest to it, and two vectors meet
where a cell of theirs is the same. Pairs that meet are verified by cosine.

Equal vectors are one. Cells with many vectors are cut by balls: all vectors whose angle to the mean of a crowded cell is at most half the limit's
angle are linked with each other, so those links are counted and not looked at; pairs across balls are verified in blocks. No cell is
ever in one task and no list of pairs is made: a block gives the links of each vector and the edges of a spanning forest.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import row_of, spread_join, stored
from .components import connected_components

LIMIT = 0.9
TABLES, BLOCKS, PROBES, SCALE = 10, 3, 16, 0.5
#: Vectors of a block; a cell with more is crowded and cut.
BLOCK = 64
#: Pairs that are verified at once.
_CHUNK = 1 << 15


@lru_cache(maxsize=1)
def _neighbours() -> np.ndarray:
    """Zero and the 240 shortest vectors of E8, in double integers."""
    pairs = [v for i, j in itertools.combinations(range(8), 2) for a in (2, -2) for b in (2, -2) for v in [[a if k == i else b if k == j else 0 for k in range(8)]]]
    halves = [s for s in itertools.product((1, -1), repeat=8) if math.prod(s) > 0]
    return np.array([[0] * 8, *pairs, *halves], np.int64)


def decode_e8(x: np.ndarray) -> np.ndarray:
    """Nearest point of E8 to each row of x, in double integers: the nearer of the nearest points of D8 and of D8 + 1/2."""

    def d8(y: np.ndarray) -> np.ndarray:
        near = np.rint(y)
        off = y - near
        odd = np.flatnonzero(near.sum(axis=1) % 2 != 0)
        worst = np.abs(off[odd]).argmax(axis=1)
        near[odd, worst] += np.where(off[odd, worst] >= 0, 1.0, -1.0)
        return near

    whole, half = d8(x), d8(x - 0.5) + 0.5
    nearer = ((x - whole) ** 2).sum(axis=1) <= ((x - half) ** 2).sum(axis=1)
    return np.rint(2 * np.where(nearer[:, None], whole, half)).astype(np.int64)


@lru_cache(maxsize=8)
def _tables(width: int, tables: int, blocks: int, seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Projections (tables x 8 blocks, width), odd multipliers of the cell hash and a start for each table."""
    rng = np.random.default_rng([seed, width, tables, blocks])
    odd = rng.integers(0, 1 << 63, (tables, blocks, 8), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    return rng.standard_normal((tables * blocks * 8, width)), odd, rng.integers(0, 1 << 63, tables, dtype=np.uint64)


def cells(units: np.ndarray, tables: int = TABLES, blocks: int = BLOCKS, probes: int = PROBES, scale: float = SCALE, seed: int = 0) -> np.ndarray:
    """64-bit names of the cells of each unit vector: (vectors, tables, probes), the own cell and those whose points are nearest."""
    n = len(units)
    project, odd, start = _tables(units.shape[1], tables, blocks, seed)
    y = scale * np.einsum("ij,kj->ik", units, project)
    steps = _neighbours()
    out = np.empty((n, tables, probes), np.uint64)
    for t in range(tables):
        names = far = None
        for b in range(blocks):
            own = y[:, (t * blocks + b) * 8 : (t * blocks + b + 1) * 8]
            home = decode_e8(own)
            # squared distance to each neighbouring point, less that to the own one
            away = (steps**2).sum(axis=1) / 4 - np.einsum("ij,kj->ik", own - home / 2, steps.astype(float))
            near = np.argpartition(away, probes, axis=1)[:, :probes]
            near_far = np.take_along_axis(away, near, 1)
            name = ((home[:, None, :] + steps[near]).astype(np.uint64) * odd[t, b]).sum(axis=2, dtype=np.uint64)
            if names is None:
                names, far = name, near_far
            else:
                both = (far[:, :, None] + near_far[:, None, :]).reshape(n, -1)
                pick = np.argpartition(both, probes, axis=1)[:, :probes]
                names = np.take_along_axis((names[:, :, None] + name[:, None, :]).reshape(n, -1), pick, 1)
                far = np.take_along_axis(both, pick, 1)
        mixed = names + start[t]
        mixed = (mixed ^ (mixed >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
        out[:, t] = mixed ^ (mixed >> np.uint64(29))
    return out.view(np.int64)


def _matrix(column: pa.ListArray) -> np.ndarray:
    """Rows of a column of equally long lists."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def _units(x: np.ndarray) -> np.ndarray:
    return x / np.sqrt((x * x).sum(axis=1))[:, None]


def _cells_of(vectors: DataFrame) -> DataFrame:
    """vectors(id, x, width) -> (id, key): a row for each cell."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            widths = batch.column(2).to_numpy()
            for width in np.unique(widths):
                own = batch.filter(pa.array(widths == width))
                ids, x = own.column(0).to_numpy(), _units(_matrix(own.column(1)))
                for at in range(0, len(ids), 1024):
                    keys = cells(x[at : at + 1024]).reshape(-1, TABLES * PROBES)
                    yield pa.RecordBatch.from_arrays([pa.array(np.repeat(ids[at : at + 1024], keys.shape[1])), pa.array(keys.ravel())], names=["id", "key"])

    return vectors.select("id", "x", "width").mapInArrow(run, "id long, key long")


def _balls(live: DataFrame, vectors: DataFrame, limit: float) -> DataFrame:
    """live(id, key, n), vectors(id, u) -> (id, ball): vectors of crowded cells that are within half the limit's angle of a cell's mean, by the mean with most of them, then the smallest key."""
    counts = live.where(F.col("n") > BLOCK).groupBy("key").agg(F.max("n").alias("n"))
    crowded = live.where(F.col("n") > BLOCK).select("key", "id").join(vectors.select("id", "u"), "id")
    means = crowded.groupBy("key").agg(vector_to_array(Summarizer.mean(array_to_vector("u"))).alias("mean"))
    dot = F.aggregate(F.zip_with("u", "mean", lambda a, b: a * b), F.lit(0.0), lambda a, b: a + b)
    norm = F.sqrt(F.aggregate("mean", F.lit(0.0), lambda a, b: a + b * b))
    inside = stored(spread_join(crowded, means, "key", counts, F.col("id")).where(dot >= F.lit(math.sqrt((1 + limit) / 2) + 1e-9) * norm).select("key", "id"))
    held = inside.groupBy("key").agg(F.count("*").alias("n"))
    sized = spread_join(inside, held.withColumnRenamed("n", "held"), "key", held, F.col("id"))
    return sized.groupBy("id").agg(F.min_by("key", F.struct(-F.col("held"), F.col("key"))).alias("ball"))


def _blocks(live: DataFrame, vectors: DataFrame) -> DataFrame:
    """live(id, key, n), vectors(id, copies, ball, x, width) -> (task, side, id, copies, ball, x, width, key).

    A cell of up to BLOCK vectors is one task, in which all meet (side 0). A larger cell is cut by balls and into blocks, and each pair of blocks is a
    task, whose sides 1 and 2 meet; blocks of one ball are no pair.
    """
    columns = ["id", "copies", "ball", "x", "width", "key"]
    rows = live.join(vectors.select("id", "copies", "ball", "x", "width"), "id")
    small = rows.where(F.col("n") <= BLOCK).select(F.col("key").alias("task"), F.lit(0).alias("side"), *columns)
    large = rows.where(F.col("n") > BLOCK).withColumn("group", F.struct(F.col("ball").isNull().alias("free"), F.coalesce("ball", F.lit(0).cast("long")).alias("ball")))
    sizes = large.groupBy("key", "group").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("parts"))
    other = sizes.withColumnsRenamed({"key": "o_key", "group": "o_group", "parts": "o_parts"})
    meet = sizes.join(other, F.expr("key = o_key and (group < o_group or group.free and group = o_group)"))
    pairs = meet.withColumn("part", F.explode(F.expr("sequence(0, parts - 1)"))).withColumn("o_part", F.explode(F.expr("sequence(if(group = o_group, part, 0), o_parts - 1)")))
    named = pairs.withColumn("task", F.xxhash64("key", "group", "part", "o_group", "o_part"))
    whole = F.expr("group = o_group and part = o_part")
    first = named.select("task", F.when(whole, 0).otherwise(1).alias("side"), F.struct("key", "group", "part").alias("at"))
    second = named.where(~whole).select("task", F.lit(2).alias("side"), F.struct("key", F.col("o_group").alias("group"), F.col("o_part").alias("part")).alias("at"))
    part = F.pmod(F.xxhash64("id"), F.col("parts")).cast("int").alias("part")
    placed = large.join(sizes, ["key", "group"]).select(*columns, F.struct("key", "group", part).alias("at"))
    return small.unionByName(placed.join(first.unionByName(second), "at").select(*small.columns))


def _verified(blocks: DataFrame, limit: float) -> DataFrame:
    """(id, links, low): for each vector of a block with a link there, the vectors linked with it, counted in the first cell of a pair, and the smallest id of its piece."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None
        for batch in batches:
            table = pa.Table.from_batches([batch]) if rest is None else pa.concat_tables([rest, pa.Table.from_batches([batch])])
            tasks = table.column("task").to_numpy()
            cut = int(np.flatnonzero(tasks != tasks[-1])[-1]) + 1 if tasks[0] != tasks[-1] else 0
            if cut:
                yield from linked(table.slice(0, cut))
            rest = table.slice(cut)
        if rest is not None and rest.num_rows:
            yield from linked(rest)

    def linked(table: pa.Table) -> Iterator[pa.RecordBatch]:
        widths = table.column("width").to_numpy()
        for width in np.unique(widths):
            yield from of_width(table.filter(pa.array(widths == width)).combine_chunks())

    def of_width(table: pa.Table) -> Iterator[pa.RecordBatch]:
        task, side, ids, copies, key = (table.column(c).to_numpy() for c in ("task", "side", "id", "copies", "key"))
        ball = table.column("ball")
        free, ball = ball.is_null().to_numpy(), ball.fill_null(0).to_numpy()
        x = _matrix(table.column("x").combine_chunks())
        norm = np.sqrt((x * x).sum(axis=1))
        # partners of a row: those behind it in its task, or those of side 2 for a row of side 1
        ends = np.flatnonzero(np.r_[task[1:] != task[:-1], True]) + 1
        end = ends[np.searchsorted(ends, np.arange(len(task)), side="right")]
        begin = np.arange(len(task)) + 1
        seconds = np.cumsum(side == 2)
        has = side == 1
        begin[has] = end[has] - (seconds[end[has] - 1] - seconds[np.arange(len(task))[has]])
        number = np.where(side == 2, 0, np.maximum(end - begin, 0))
        links, low = np.zeros(len(task), np.int64), np.arange(len(task))
        known = _Known()
        total = np.cumsum(number)
        at = 0
        while at < len(task):
            to = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + _CHUNK, side="right")))
            count = number[at:to]
            i = np.repeat(np.arange(at, to), count)
            j = np.arange(len(i)) - np.repeat(np.cumsum(count) - count, count) + begin[i]
            at = to
            other = free[i] | free[j] | (ball[i] != ball[j])
            i, j = i[other], j[other]
            near = np.einsum("ij,ij->i", x[i], x[j]) >= limit * (norm[i] * norm[j])
            i, j = i[near], j[near]
            if not len(i):
                continue
            known.add(ids, x, norm, np.unique(np.r_[i, j]))
            first = np.concatenate([first_common(known.of(ids[i[s : s + 2048]]), known.of(ids[j[s : s + 2048]])) == key[i[s : s + 2048]] for s in range(0, len(i), 2048)])
            i, j = i[first], j[first]
            np.add.at(links, i, copies[j])
            np.add.at(links, j, copies[i])
            edges = np.stack([i, j])
            while True:  # the smallest row of each piece
                least = np.minimum(low[edges[0]], low[edges[1]])
                before = low.copy()
                np.minimum.at(low, edges[0], least)
                np.minimum.at(low, edges[1], least)
                low = low[low]
                if (low == before).all():
                    break
        has = np.flatnonzero(links)
        if len(has):
            yield pa.RecordBatch.from_arrays([pa.array(ids[has]), pa.array(links[has]), pa.array(ids[low[has]])], names=["id", "links", "low"])

    dealt = blocks.repartition("task").sortWithinPartitions("task", "side", "id")
    return dealt.mapInArrow(run, "id long, links long, low long")


class _Known:
    """Cells of the vectors that a task has found linked in a batch, each computed once."""

    def __init__(self) -> None:
        self.rows: dict[int, int] = {}
        self.cells = np.empty((0, TABLES, PROBES), np.int64)

    def add(self, ids: np.ndarray, x: np.ndarray, norm: np.ndarray, at: np.ndarray) -> None:
        new = np.array(list({int(ids[r]): r for r in at if int(ids[r]) not in self.rows}.values()), int)
        parts = [cells(x[some] / norm[some][:, None]) for some in (new[s : s + 1024] for s in range(0, len(new), 1024))]
        self.rows |= {int(ids[r]): len(self.rows) + k for k, r in enumerate(new)}
        self.cells = np.concatenate([self.cells, *parts])

    def of(self, ids: np.ndarray) -> np.ndarray:
        return self.cells[[self.rows[int(i)] for i in ids]]


def first_common(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For each pair of (tables, probes) cells the smallest name that both have, in the first table in which they share one; the largest integer without any."""
    none = np.iinfo(np.int64).max
    shared = np.where((a[:, :, :, None] == b[:, :, None, :]).any(axis=3), a, none).min(axis=2)
    return shared[np.arange(len(a)), (shared < none).argmax(axis=1)]


def near_duplicates(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", limit: float = LIMIT) -> DataFrame:
    """(vec_id, n_links, component_id, kept, row): one row for each row of vectors, whose columns are in row.

    n_links counts the other rows linked directly, component_id is the smallest id reachable. Two vectors are linked if they meet in a cell and their
    cosine in double precision is limit or more. Vectors that are null or empty, of norm 0 or with null or non-finite components link with
    nothing, and no vectors of different lengths link. Rows without an id link with nothing and have no component; they are kept. Rows of one id
    are rows of their own, linked by their vectors. An empty table gives an empty result.
    """
    given = vectors.select(F.col(f"`{id_col}`").cast("long").alias("vec_id"), F.col(f"`{vector_col}`").cast("array<double>").alias("x"), row_of(vectors).alias("row"))
    finite = F.forall("x", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf")))
    square = F.aggregate("x", F.lit(0.0), lambda a, v: a + v * v)
    # beyond the range of squares a vector is divided by its greatest component
    top = F.array_max(F.transform("x", F.abs))
    scaled = F.when((square > 1e-280) & (square < 1e280), F.col("x")).otherwise(F.transform("x", lambda v: v / top))
    usable = F.col("vec_id").isNotNull() & F.coalesce((F.size("x") > 0) & finite & (top > 0), F.lit(False))
    rows = given.withColumn("x", F.when(usable, scaled))
    classes = rows.where("x is not null").groupBy("x").agg(F.min("vec_id").alias("first"), F.count("*").alias("copies"))
    # vectors are named by numbers of their own, which are fixed by the write
    named = stored(classes.select(F.monotonically_increasing_id().alias("id"), "first", "copies", "x", F.size("x").alias("width")))
    facts = named.select("id", "x").join(_links(named, limit), "id").drop("id")
    found = spread_join(rows.where("x is not null"), facts, "x", named.select("x", F.col("copies").alias("n")), F.col("vec_id"))
    alone = rows.where("x is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), "row")
    every = found.select("vec_id", "n_links", "component_id", "row").unionByName(alone)
    return every.select("vec_id", "n_links", "component_id", F.col("vec_id").eqNullSafe(F.col("component_id")).alias("kept"), "row")


def _links(named: DataFrame, limit: float) -> DataFrame:
    """named(id, first, copies, x, width), vectors that differ -> (id, n_links, component_id) by first."""
    slim = stored(_cells_of(named))
    shared = stored(slim.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"))
    live = stored(spread_join(slim, shared, "key", shared, F.col("id")).select("id", "key", "n"), replaces=slim)
    if shared.where(F.col("n") > BLOCK).isEmpty():
        balls = named.select("id", F.col("id").alias("ball")).where("false")
    else:
        norm = F.sqrt(F.aggregate("x", F.lit(0.0), lambda a, v: a + v * v))
        balls = stored(_balls(live, named.select("id", F.transform("x", lambda v: v / norm).alias("u")), limit))
    vectors = stored(named.drop("first").join(balls, "id", "left"))
    met = stored(_verified(_blocks(live, vectors), limit))
    by_ball = vectors.where("ball is not null").groupBy("ball").agg(F.sum("copies").alias("all"), F.min("id").alias("low"))
    in_ball = stored(vectors.select("id", "ball").join(by_ball, "ball").select("id", "all", "low"))
    edges = met.select(F.col("id").alias("a"), F.col("low").alias("b")).unionByName(in_ball.select(F.col("id").alias("a"), F.col("low").alias("b")))
    roots = connected_components(edges).withColumnRenamed("node", "id")
    links = met.groupBy("id").agg(F.sum("links").alias("links"))
    joined = named.select("id", "first", "copies").join(links, "id", "left").join(in_ball.select("id", "all"), "id", "left").join(roots, "id", "left")
    facts = stored(joined.select("id", "first", F.coalesce("root", "id").alias("root"), (F.coalesce("links", F.lit(0)) + F.coalesce("all", "copies") - 1).cast("long").alias("n_links")))
    least = facts.groupBy("root").agg(F.min("first").alias("component_id"), F.count("*").alias("n"))
    return spread_join(facts, least.select("root", "component_id"), "root", least.select("root", "n"), F.col("id")).select("id", "n_links", "component_id")
