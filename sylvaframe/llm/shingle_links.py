"""Links of texts whose sets of word shingles are alike (Jaccard similarity t or more), through signatures of parts.

SimHash at three bits finds pairs far above t = 0.8 only (such pairs differ in 5 to 14 of 64 bits), so these links stand beside it.
Sets of n shingles at similarity t differ in at most d = 2n(1 - t)/(1 + t) shingles. Each set is cut by its shingles' hashes into more
parts than d, so a part is the same on both sides, and equal signatures of parts meet by an equality shuffle. Sizes are taken by powers
of two; a set that may have a partner in the next power is cut for that one too. Of more than 64 parts the first 64 are indexed: each is
alike with chance about 1/e at the limit, and parts of one shingle are no keys from 64 shingles on; by estimate a pair at the limit
shares no key with a chance of 1e-6 at most.

In a bucket the first text meets all others; what is linked then needs no more comparing. Of buckets that still hold several components
the next 4, 16, 64, ... texts meet the others, until one component is left or all have met. So a group of near copies is linear, and
no pair that shares a key is lost. Sets are compared exactly. What stays quadratic is a bucket of many texts with nothing but that part in common, as a
passage of a few hundred words gives in short texts.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._common import drop, spread_join, stored

INDEXED, FEWEST = 64, 32
#: Size of a set from which parts of one shingle are no keys.
_SINGLES_BELOW = 64


def shingle_set(text: str | None, shingle: int = 5, seed: int = 42) -> np.ndarray:
    """Sorted distinct XXH64 of a text's word shingles, A-Z lower-cased; fewer words are one shingle, no words none."""
    import xxhash

    words = (text or "").encode("utf-8", "replace").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    grams = map(b" ".join, zip(*(words[i:] for i in range(shingle)), strict=False)) if len(words) >= shingle else [b" ".join(words)]
    digest = xxhash.xxh64_intdigest
    return np.unique(np.fromiter((digest(g, seed) for g in grams), np.uint64))


def part_keys(hashes: np.ndarray, similarity: float) -> np.ndarray:
    """Signatures (int64) of the parts of a set of distinct hashes."""
    n = len(hashes)
    if not n:
        return np.empty(0, np.int64)
    level = n.bit_length()
    out = []
    for at in [level, level + 1] if n >= similarity * (1 << level) else [level]:
        parts = max(FEWEST, int((1 << at) * 2 * (1 - similarity) / (1 + similarity)) + 1)
        part = (hashes >> np.uint64(20)) % np.uint64(parts)
        mine = part < INDEXED
        order = np.argsort(part[mine], kind="stable")
        own, member = part[mine][order], hashes[mine][order]
        if not len(own):
            continue
        start = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
        wide = np.diff(np.append(start, len(own))) > (1 if n >= _SINGLES_BELOW else 0)
        with np.errstate(over="ignore"):
            x = np.add.reduceat(member, start) * np.uint64(0x9E3779B97F4A7C15) ^ (own[start] + np.uint64(at * INDEXED + 1)) * np.uint64(0xBF58476D1CE4E5B9)
        out.append(x[wide])
    return np.unique(np.concatenate(out)).view(np.int64) if out else np.empty(0, np.int64)


def set_links(items: DataFrame, sets_of: Callable[[DataFrame], DataFrame], known: DataFrame, components: Callable[[DataFrame], DataFrame], similarity: float) -> DataFrame:
    """(node, root), the components of all links of the given similarity or more and of the edges known(a, b); nodes without an edge are absent.

    items(item, node, n, keys): one row for each different set of n shingles, node being what known links. sets_of(ids) gives (item, hashes)
    of the items in ids(item). components(edges) gives (node, root).
    """
    same = Window.partitionBy("key").orderBy("item")
    rows = items.select("item", "node", "n", F.explode("keys").alias("key"))
    ranked = rows.select("*", F.row_number().over(same).alias("rank"), F.lead("item").over(same).isNotNull().alias("more"))
    pool = stored(ranked.where("more or rank > 1").drop("more"))
    if pool.isEmpty():
        return components(known)
    sets = stored(sets_of(pool.select("item").distinct()))
    alike = F.expr("least(n, other_n)") >= F.expr("greatest(n, other_n)") * similarity - 1e-9
    edges, first, width = known, 1, 1
    while True:
        roots = components(edges)
        comp = stored(pool.join(roots.withColumnRenamed("node", "__node"), F.col("node") == F.col("__node"), "left").select(*pool.columns, F.coalesce("root", "node").alias("comp")))
        open_ = stored(comp.groupBy("key").agg(F.min("comp").alias("low"), F.max("comp").alias("high"), F.max("rank").alias("n")).where(f"low <> high and n > {first}").select("key", "n"))
        if open_.isEmpty():
            return roots
        heads = comp.where(F.col("rank").between(first, first + width - 1)).select("key", *[F.col(c).alias(f"other_{c}") for c in ("item", "node", "n", "rank", "comp")])
        met = spread_join(comp.join(open_.select("key"), "key", "left_semi"), heads, "key", open_, F.col("item"))
        pairs = stored(met.where((F.col("rank") > F.col("other_rank")) & (F.col("comp") != F.col("other_comp")) & alike).select("item", "node", "n", "other_item", "other_node", "other_n").distinct())
        often = stored(pairs.groupBy("other_item").agg(F.count("*").alias("n")))
        one = spread_join(pairs, sets.select(F.col("item").alias("other_item"), F.col("hashes").alias("other_hashes")), "other_item", often, F.col("item"))
        both = one.join(sets.withColumnRenamed("item", "__item"), F.col("item") == F.col("__item"))
        shared = F.size(F.array_intersect("hashes", "other_hashes"))
        linked = both.where(shared >= (F.col("n") + F.col("other_n")) * (similarity / (1 + similarity)) - 1e-9)
        edges = stored(edges.unionAll(linked.select(F.col("node").alias("a"), F.col("other_node").alias("b"))))
        for table in (comp, open_, pairs, often):
            drop(table)
        first, width = first + width, 4 * width
