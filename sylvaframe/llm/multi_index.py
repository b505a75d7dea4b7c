"""Exact top-k search over binary codes by incremental multi-index hashing.

Codes of 64 bits are cut into m segments and indexed by each. In round r every active query probes all segment values at
distance r from its own; a code within m * (r + 1) - 1 bits has a segment within r, so it has been met by then. A query is done once
its k-th verified distance is covered. A pair is verified inside the join that meets it: it passes in the first round and segment where it
meets, and only within the k-th distance found so far, so few pairs are ever shuffled. Codes that are equal are searched once and
hold only their k + 1 smallest ids, and a query keeps at most k + 1 codes, which ties by id make exact.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._common import stored

BITS = 64
#: Rows of a batch of probes.
_CHUNK = 1 << 16


def sign_codes(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(id, code): bit i is set where component i of the vector is positive; at most 64 components, missing and null ones count as 0.

    A null vector has a null code.
    """
    bits = [F.when(F.coalesce(F.get(F.col(vector_col), F.lit(i)), F.lit(0.0)) > 0, F.lit(1 << i if i < 63 else -(1 << 63)).cast("long")).otherwise(F.lit(0).cast("long")) for i in range(BITS)]
    code = bits[0]
    for b in bits[1:]:
        code = code.bitwiseOR(b)
    return vectors.select(F.col(id_col).cast("long").alias("id"), F.when(F.col(vector_col).isNotNull(), code).alias("code"))


def _segments(m: int) -> list[tuple[int, int]]:
    """(shift, width) of m segments."""
    cuts = [BITS * i // m for i in range(m + 1)]
    return [(a, b - a) for a, b in zip(cuts, cuts[1:], strict=False)]


def segments_for(n: int) -> int:
    """Segments so that a segment has about log2(n) bits, 3 to 8 of them."""
    return min(8, max(3, math.ceil(BITS / max(1.0, math.log2(max(2, n))))))


@lru_cache(maxsize=64)
def _masks(width: int, radius: int) -> np.ndarray:
    """All values of width bits of which radius are set."""
    return np.array([sum(1 << b for b in bits) for bits in itertools.combinations(range(width), radius)], np.int64)


def _index_keys(m: int) -> Column:
    """Array of the m segment values of code, each with the segment's number in its low 4 bits."""
    own = [F.shiftrightunsigned("code", shift).bitwiseAND(F.lit((1 << width) - 1).cast("long")) for shift, width in _segments(m)]
    return F.array(*[F.shiftleft(v, 4).bitwiseOR(F.lit(s).cast("long")) for s, v in enumerate(own)])


def _probes(active: DataFrame, m: int, radius: int) -> DataFrame:
    """active(code, far) -> (code, far, key): the keys of all segment values at this distance from the code's own."""
    segments = _segments(m)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes, fars = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            for s, (shift, width) in enumerate(segments):
                own = (codes.view(np.uint64) >> np.uint64(shift)).view(np.int64) & ((1 << width) - 1)
                masks = _masks(width, radius)
                for at in range(0, len(masks), _CHUNK):
                    some = masks[at : at + _CHUNK]
                    step = max(1, _CHUNK // len(some))
                    for i in range(0, len(codes), step):
                        keys = ((own[i : i + step, None] ^ some[None, :]) << 4) | s
                        both = [pa.array(np.repeat(x[i : i + step], len(some))) for x in (codes, fars)]
                        yield pa.RecordBatch.from_arrays([*both, pa.array(keys.ravel())], names=["code", "far", "key"])

    # a fixed number of tasks: a few queries give many probes
    tasks = int(active.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return active.select("code", F.col("far").cast("int")).repartition(tasks, "code").mapInArrow(run, "code long, far int, key long")


def _met_first(m: int, radius: int) -> str:
    """SQL: a pair that meets in segment key & 15 in this round has met in no earlier round or segment."""
    apart = [f"bit_count(shiftrightunsigned(code ^ found, {shift}) & {(1 << width) - 1}L)" for shift, width in _segments(m)]
    return " and ".join(f"({d} > {radius} or ({d} = {radius} and (key & 15) <= {s}))" for s, d in enumerate(apart))


def _nearest(pool: DataFrame, k: int) -> DataFrame:
    """(code, found, distance, first, ids, total, far): the k + 1 nearest codes of each query code by distance and smallest id, without
    those that k + 1 ids are strictly closer than; total ids held by them and the greatest distance."""
    of_code = Window.partitionBy("code")
    rank = F.row_number().over(of_code.orderBy("distance", "first"))
    near = pool.select("code", "found", "distance", "first", "ids").withColumn("rank", rank).where(F.col("rank") <= k + 1)
    closer = F.sum("ids").over(of_code.orderBy("distance").rangeBetween(Window.unboundedPreceding, -1))
    kept = near.withColumn("closer", F.coalesce(closer, F.lit(0))).where(F.col("closer") <= k).drop("rank", "closer")
    return kept.withColumn("total", F.sum("ids").over(of_code)).withColumn("far", F.max("distance").over(of_code))


def search(codes: DataFrame, queries: DataFrame, k: int = 10, segments: int | None = None) -> DataFrame:
    """codes(id, code), queries(id, code) -> (query_id, rank, neighbour_id, distance): the k nearest other ids.

    Exact: ordered by distance, then id; a row with the query's own id is never its neighbour. Rows with a null id or code are left out,
    of repeated ids the smallest code counts, an empty side gives an empty result, and fewer than k other codes give fewer rows. segments
    is 3 to 16, else ValueError.
    """
    if segments is not None and not 3 <= segments <= 16:
        raise ValueError("segments must be 3 to 16")
    one_code = lambda df: df.select("id", "code").dropna().groupBy("id").agg(F.min("code").alias("code"))
    ids = F.slice(F.array_sort(F.collect_list("id")), 1, k + 1)
    # smallest ids of each code: ranked first, so that a hot code's list stays short
    by_salt = Window.partitionBy("code", "salt").orderBy("id")
    ranked = one_code(codes).withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(64))).withColumn("n", F.row_number().over(by_salt))
    held = stored(ranked.where(F.col("n") <= k + 1).groupBy("code").agg(ids.alias("list")))
    m = segments or segments_for(held.count())
    index = held.select(F.col("code").alias("found"), F.col("list")[0].alias("first"), F.size("list").alias("ids"), F.explode(_index_keys(m)).alias("key"))
    # merge joins: index and held grow with the data, so neither is ever broadcast
    asked = stored(one_code(queries))
    # equal query codes are searched once; k + 1 ids of the nearest codes serve all of them, whichever id is their own
    active = stored(asked.select("code", F.lit(BITS).alias("far")).distinct())
    waiting = None
    done = []
    for radius in range(math.ceil(BITS / m) + 1):
        apart = F.expr("bit_count(code ^ found)")
        hits = _probes(active, m, radius).join(index.hint("merge"), "key").where((apart <= F.col("far")) & F.expr(_met_first(m, radius))).withColumn("distance", apart)
        pool = hits.select("code", "found", "distance", "first", "ids")
        nearest = stored(_nearest(pool if waiting is None else pool.unionByName(waiting), k))
        covered = m * (radius + 1) - 1
        if covered >= BITS:
            done.append(nearest)
            break
        is_done = F.coalesce((F.col("total") > k) & (F.col("far") <= covered), F.lit(False))
        done.append(nearest.where(is_done))
        waiting = nearest.where(~is_done).select("code", "found", "distance", "first", "ids")
        reach = nearest.select("code", "total", "far").distinct()
        state = active.select("code").join(reach, "code", "left").where(~is_done)
        active = stored(state.select("code", F.when(F.col("total") > k, F.col("far")).otherwise(BITS).alias("far")))
        if active.isEmpty():
            break
    found = done[0].select("code", "found", "distance")
    for d in done[1:]:
        found = found.unionByName(d.select("code", "found", "distance"))
    # at most (k + 1)^2 ids of a query code
    near = found.join(held.select(F.col("code").alias("found"), "list").hint("merge"), "found").select("code", F.expr("transform(list, x -> struct(distance, x as id))").alias("near"))
    answers = near.groupBy("code").agg(F.slice(F.array_sort(F.flatten(F.collect_list("near"))), 1, k + 1).alias("near"))
    others = F.slice(F.filter("near", lambda x: x["id"] != F.col("query_id")), 1, k)
    listed = asked.withColumnRenamed("id", "query_id").join(answers, "code").select("query_id", F.posexplode(others).alias("at", "hit"))
    return listed.select("query_id", (F.col("at") + 1).alias("rank"), F.col("hit.id").alias("neighbour_id"), F.col("hit.distance").cast("int").alias("distance"))
