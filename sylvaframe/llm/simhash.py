"""SimHash near-duplicates through deletion-variant signatures.

Fingerprints of 64 bits link at k = 3 differing bits or fewer. They are cut into only two segments of 32
bits, so one segment of a linked pair differs in at most one bit. Each segment is indexed under its 32
variants with one bit wiped; a pair that differs in at most that bit shares the variant. Equal variants meet
by an equality shuffle, and the whole fingerprints are verified there. A bucket emits a spanning forest
of its links instead of all its pairs, so hot groups of near copies stay linear. Exact copies collapse before. A bucket with more
than a fixed number of fingerprints is cut on: its free bits fall into four pieces, of which linked fingerprints share one, and each
piece's values are buckets of the next round. So no bucket is ever compared, or held, as a whole when it is large.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import row_of, spread_join, stored
from .components import connected_components
from .shingle_links import part_keys, set_links, shingle_set

SEED = 42
MAX_BITS = 3
_BLOCK = 1 << 16
#: Fingerprints up to which a bucket is compared in one task, and free bits from which no bucket is cut on.
MAX_BUCKET, _FEW_BITS = 4096, 12


def fingerprint(text: str | None, shingle: int = 3) -> int:
    """64-bit SimHash of one text: majority of the XXH64 bits of its word shingles; without words 0."""
    import xxhash

    words = (text or "").encode("utf-8", "replace").lower().split()
    if not words:
        return 0
    if len(words) < shingle:
        grams = iter([b" ".join(words)])
        n = 1
    else:
        grams = map(b" ".join, zip(*(words[i:] for i in range(shingle)), strict=False))
        n = len(words) - shingle + 1
    digest = xxhash.xxh64_intdigest
    counts = np.zeros(64, np.int64)
    for at in range(0, n, _BLOCK):
        size = min(_BLOCK, n - at)
        hashes = np.fromiter((digest(g, SEED) for g in islice(grams, size)), np.uint64, size)
        counts += np.unpackbits(hashes.view(np.uint8).reshape(size, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > n, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, shingle: int = 3, id_col: str = "doc_id", text_col: str = "text", with_row: bool = False) -> DataFrame:
    """(doc_id, fp): one row per row of docs; with_row adds it as struct row. A null or blank text has fingerprint 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = np.fromiter((fingerprint(t, shingle) for t in batch.column(1).to_pylist()), np.uint64, batch.num_rows)
            rest = batch.columns[2:]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fp.view(np.int64)), *rest], names=["doc_id", "fp", *["row"] * len(rest)])

    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), *[row_of(docs).alias("row")] * with_row)
    schema = "doc_id long, fp long" + (f", row {source.schema['row'].dataType.simpleString()}" if with_row else "")
    return source.mapInArrow(run, schema)


def variants(fps: DataFrame) -> DataFrame:
    """(key, fp): the 64 one-wildcard segment variants of each fingerprint."""
    one = fps.select("fp", F.explode(F.sequence(F.lit(0), F.lit(63))).alias("i"))
    part = F.when(F.col("i") < 32, F.col("fp").bitwiseAND(F.lit(0xFFFFFFFF))).otherwise(F.shiftrightunsigned("fp", 32))
    wild = F.expr("shiftleft(1L, i % 32)")
    key = F.expr("shiftleft(cast(i as long), 32)").bitwiseOR(part.bitwiseAND(F.bitwise_not(wild)))
    return one.select(key.alias("key"), "fp")


def bucket_links(fps: np.ndarray, max_bits: int = MAX_BITS) -> list[tuple[np.ndarray, np.ndarray]]:
    """A spanning forest of the links inside one bucket of distinct fingerprints (uint64).

    Reached members leave the pool, so a dense bucket takes few comparisons and emits fewer edges than members.
    """
    found, rest, queue = [], fps[1:], [fps[0]]
    while len(rest):
        if not queue:
            queue.append(rest[0])
            rest = rest[1:]
            continue
        at = queue.pop()
        near = np.bitwise_count(rest ^ at) <= max_bits
        if near.any():
            hits = rest[near]
            found.append((np.full(len(hits), at), hits))
            queue.extend(hits)
            rest = rest[~near]
    return found


def _first_free(key: np.ndarray) -> np.ndarray:
    """Bits that a first-round bucket leaves free: the wiped bit and the other segment."""
    i = (key.view(np.uint64) >> np.uint64(32)).astype(np.uint64)
    other = np.where(i < 32, np.uint64(0xFFFFFFFF00000000), np.uint64(0xFFFFFFFF))
    return other | np.uint64(1) << i


def pieces(free: int) -> list[int]:
    """Masks of the free bits cut into four pieces: fingerprints that differ in three of them or fewer share one."""
    bits = [b for b in range(64) if free >> b & 1]
    return [sum(1 << b for b in bits[len(bits) * k // 4 : len(bits) * (k + 1) // 4]) for k in range(4)]


def _link_sorted(batches: Iterator[pa.RecordBatch], max_bits: int, most: int = MAX_BUCKET) -> Iterator[pa.RecordBatch]:
    """Batches (key, fp, free) sorted by key -> rows (a, b, free): verified links with free 0, and (key, fp, free) of the next round's buckets, those of more than most fingerprints.

    Of the last, unfinished bucket at most that many fingerprints are carried over; a bucket that has grown past that is cut on as it comes.
    """
    held = [np.empty(0, np.int64), np.empty(0, np.uint64), np.empty(0, np.uint64)]
    cut_key = None

    def row(a: np.ndarray, b: np.ndarray, free: np.ndarray | int) -> pa.RecordBatch:
        free = np.broadcast_to(np.asarray(free, np.uint64), a.shape)
        return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(x).view(np.int64)) for x in (a, b, free)], names=["a", "b", "free"])

    def cut(key: int, fps: np.ndarray, free: int) -> Iterator[pa.RecordBatch]:
        for k, piece in enumerate(pieces(free)):
            with np.errstate(over="ignore"):
                x = (fps & np.uint64(piece)) ^ np.uint64(key & (2**64 - 1)) * np.uint64(0x9E3779B97F4A7C15) ^ np.uint64(k + 1) * np.uint64(0xBF58476D1CE4E5B9)
                x ^= x >> np.uint64(31)
                x *= np.uint64(0x94D049BB133111EB)
                x ^= x >> np.uint64(29)
            yield row(x, fps, free & ~piece)

    def links(k: np.ndarray, f: np.ndarray, free: np.ndarray) -> Iterator[pa.RecordBatch]:
        start = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]]))
        size = np.diff(np.append(start, len(k)))
        two = start[size == 2]
        a, b = f[two], f[two + 1]
        near = np.bitwise_count(a ^ b) <= max_bits
        found = [(a[near], b[near])]
        for s, n in zip(start[size > 2].tolist(), size[size > 2].tolist(), strict=True):
            if n > most and int(free[s]).bit_count() > _FEW_BITS:
                yield from cut(int(k[s]), f[s : s + n], int(free[s]))
            else:
                found += bucket_links(f[s : s + n], max_bits)
        a, b = (np.concatenate(x) for x in zip(*found, strict=True))
        if len(a):
            yield row(a, b, 0)

    for batch in batches:
        if not batch.num_rows:
            continue
        key, fp, free = (batch.column(i).to_numpy() for i in range(3))
        part = [key, fp.view(np.uint64), free.view(np.uint64)]
        if cut_key is not None:
            n = int(np.searchsorted(key, cut_key, side="right"))
            if n:
                yield from cut(cut_key, part[1][:n], int(part[2][0]))
                part = [x[n:] for x in part]
            if not len(part[0]):
                continue
            cut_key = None
        held = [np.concatenate([a, b]) for a, b in zip(held, part, strict=True)]
        last = int(np.searchsorted(held[0], held[0][-1]))
        if last:
            yield from links(*[x[:last] for x in held])
            held = [x[last:] for x in held]
        if len(held[0]) > most and int(held[2][0]).bit_count() > _FEW_BITS:
            cut_key = int(held[0][0])
            yield from cut(cut_key, held[1], int(held[2][0]))
            held = [x[:0] for x in held]
    if len(held[0]):
        yield from links(*held)


def links(distinct: DataFrame, max_bits: int = MAX_BITS, most: int = MAX_BUCKET) -> DataFrame:
    """distinct(fp) -> edges (a, b) whose components are those of all links of max_bits or fewer."""

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with_free = (pa.RecordBatch.from_arrays([*b.columns, pa.array(_first_free(b.column(0).to_numpy()).view(np.int64))], names=["key", "fp", "free"]) for b in batches)
        return _link_sorted(with_free, max_bits, most)

    schema = "a long, b long, free long"
    # few fingerprints give many variants, so they are spread before
    tasks = int(distinct.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    found = stored(variants(distinct.select("fp").repartition(tasks)).repartition(tasks, "key").sortWithinPartitions("key").mapInArrow(first, schema))
    edges = found.where("free = 0")
    while not (rest := found.where("free <> 0")).isEmpty():
        again = rest.select(F.col("a").alias("key"), F.col("b").alias("fp"), "free").repartition(tasks, "key").sortWithinPartitions("key")
        found = stored(again.mapInArrow(lambda it: _link_sorted(it, max_bits, most), schema))
        edges = edges.unionAll(found.where("free = 0"))
    return edges.select("a", "b")


def _classes(printed: DataFrame, max_bits: int, grouped: Callable[[DataFrame], DataFrame] = connected_components) -> tuple[DataFrame, DataFrame]:
    """printed(doc_id, fp) -> (fp, root, component_id), one row a fingerprint, and (fp, first, n). grouped gives (node, root) of the edges (a, b)."""
    distinct = stored(printed.groupBy("fp").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")))
    roots = grouped(links(distinct, max_bits))
    groups = stored(distinct.join(roots, distinct.fp == roots.node, "left").select("fp", "first", F.coalesce("root", "fp").alias("root")))
    smallest = groups.groupBy("root").agg(F.min("first").alias("component_id"), F.count("*").alias("n"))
    return spread_join(groups.select("fp", "root"), smallest.drop("n"), "root", smallest, F.col("fp")), distinct


def _checked(max_bits: int) -> int:
    if not 0 <= max_bits <= 3:
        raise ValueError("two segments with one wildcard cover 0 to 3 differing bits")
    return max_bits


def near_duplicates(docs: DataFrame, shingle: int = 3, max_bits: int = MAX_BITS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp, component_id): one row per row of docs; component_id is the smallest doc_id reachable.

    Null texts count as empty (fingerprint 0, linked like any other); repeated rows give repeated rows; an empty
    table gives an empty result; a null doc_id stays null and never becomes a component_id of others, a component without any doc_id has
    the component_id null. Other columns are ignored. max_bits may be 0 to 3: beyond 3, two segments with one wildcard no longer cover all links.
    """
    printed = stored(fingerprints(docs, shingle, id_col, text_col))
    classes, distinct = _classes(printed, _checked(max_bits))
    return spread_join(printed, classes, "fp", distinct, F.col("doc_id")).select("doc_id", "fp", "component_id")


def _with_parts(docs: DataFrame, shingle: int, words: int, similarity: float, text_col: str) -> DataFrame:
    """(fp, sum, n, keys, row): the fingerprint of each row of docs, and sum, size and part signatures of its set of shingles of words words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps, sums, sizes, keys = [], [], [], []
            for text in batch.column(0).to_pylist():
                hashes = shingle_set(text, words, SEED)
                fps.append(fingerprint(text, shingle))
                sums.append(hashes.sum(dtype=np.uint64))
                sizes.append(len(hashes))
                keys.append(part_keys(hashes, similarity))
            columns = [pa.array(np.array(x, np.uint64).view(np.int64)) for x in (fps, sums)]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(sizes, pa.int64()), pa.array(keys, pa.list_(pa.int64())), batch.column(1)], names=["fp", "sum", "n", "keys", "row"])

    source = docs.select(F.col(text_col).cast("string").alias("text"), row_of(docs).alias("row"))
    return source.mapInArrow(run, f"fp long, sum long, n long, keys array<long>, row {source.schema['row'].dataType.simpleString()}")


def _sets(texts: DataFrame, words: int) -> DataFrame:
    """texts(item, text) -> (item, hashes)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hashes = [shingle_set(t, words, SEED).view(np.int64) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(hashes, pa.list_(pa.int64()))], names=["item", "hashes"])

    return texts.mapInArrow(run, "item long, hashes array<long>")


def representatives(
    docs: DataFrame, shingle: int = 3, max_bits: int = MAX_BITS, id_col: str = "doc_id", text_col: str = "text", words: int = 5, similarity: float | None = None
) -> DataFrame:
    """The rows of docs that stay when one of each component does: that with the smallest doc_id, null last; of several the one whose row hashes lowest.

    With a similarity (above 0.5), texts whose sets of shingles of words words have at least that Jaccard similarity are linked as well.
    Rows of equal columns are interchangeable. Null texts and ids are as in near_duplicates(), but a row without doc_id stays where its component has no other.
    """
    if similarity is not None and not 0.5 < similarity <= 1:
        raise ValueError("similarity must be above 0.5 and at most 1")
    placed = F.monotonically_increasing_id().alias("place")
    if similarity is None:
        printed = stored(fingerprints(docs, shingle, id_col, text_col, with_row=True).select("fp", "row", placed))
        grouped = connected_components
    else:
        printed = stored(_with_parts(docs, shingle, words, similarity, text_col).select("*", placed))

        def grouped(edges: DataFrame) -> DataFrame:
            first = stored(printed.groupBy("fp", "sum", "n").agg(F.min("place").alias("item")))
            items = printed.join(first.select(F.col("item").alias("place")), "place", "left_semi").select(F.col("place").alias("item"), F.col("fp").alias("node"), "n", "keys")
            texts = printed.select(F.col("place").alias("item"), F.col(f"row.`{text_col}`").cast("string").alias("text"))
            return set_links(items, lambda ids: _sets(texts.join(ids, "item", "left_semi"), words), stored(edges), connected_components, similarity)

    slim = printed.select(F.col(f"row.`{id_col}`").cast("long").alias("doc_id"), "fp", "place", F.xxhash64("row").alias("hash"))
    classes, distinct = _classes(slim, _checked(max_bits), grouped)
    order = F.struct(F.col("doc_id").isNull(), "doc_id", "hash", "place")
    best = spread_join(slim, classes.select("fp", "root"), "fp", distinct, F.col("place")).groupBy("root").agg(F.min(order).alias("best"))
    return printed.join(best.select(F.col("best.place").alias("place")), "place", "left_semi").select("row.*")


def fingerprint_hex(fp: Column) -> Column:
    """16 lowercase hex digits."""
    return F.lpad(F.lower(F.hex(fp)), 16, "0")
