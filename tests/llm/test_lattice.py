"""Lattice hashing against brute force."""

import numpy as np
import pytest

from sylvaframe.llm import lattice_dedup
from sylvaframe.llm.lattice_dedup import near_duplicates


def by_hand(ids, vectors, limit=0.9):
    """{row: (id, links, component)} over all pairs."""
    ok = [i is not None and v is not None and len(v) > 0 and all(x is not None and np.isfinite(x) for x in v) and any(v) for i, v in zip(ids, vectors, strict=True)]
    links, root = [0] * len(ids), list(range(len(ids)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(ids)):
        for j in range(i):
            if ok[i] and ok[j] and len(vectors[i]) == len(vectors[j]):
                a, b = np.array(vectors[i], float), np.array(vectors[j], float)
                a, b = a / np.abs(a).max(), b / np.abs(b).max()
                if a @ b >= limit * np.sqrt((a @ a) * (b @ b)):
                    links[i] += 1
                    links[j] += 1
                    root[find(i)] = find(j)
    least = {}
    for i in range(len(ids)):
        least[find(i)] = min((x for x in (least.get(find(i)), ids[i]) if x is not None), default=None)
    return [(ids[i], links[i], least[find(i)], ids[i] == least[find(i)]) for i in range(len(ids))]


def run(spark, ids, vectors):
    df = spark.createDataFrame([(i, v, 0, k) for k, (i, v) in enumerate(zip(ids, vectors, strict=True))], "vec_id long, embedding array<float>, n_links int, nth int")
    rows = near_duplicates(df).collect()
    return [tuple(r)[:4] for r in sorted(rows, key=lambda r: r["row"]["nth"])]


def test_points_of_e8_are_the_nearest():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(200, 8)) * 2
    found = lattice_dedup.decode_e8(x) / 2
    steps = lattice_dedup._neighbours() / 2
    assert len(np.unique(steps, axis=0)) == 241 and set((steps**2).sum(axis=1)) == {0.0, 2.0}
    far = ((x - found) ** 2).sum(axis=1)
    # no neighbour is nearer, and the covering radius is 1
    assert (far[:, None] <= ((x[:, None] - found[:, None] - steps[None]) ** 2).sum(axis=2) + 1e-12).all() and far.max() <= 1 + 1e-12
    twice = np.rint(2 * found).astype(int)
    assert ((twice % 2 == twice[:, :1] % 2).all(axis=1) & (twice.sum(axis=1) % 4 == 0)).all()


@pytest.mark.parametrize("block", [8])
def test_groups_equal_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(lattice_dedup, "BLOCK", block)
    rng = np.random.default_rng(2)
    unit = lambda x: x / np.linalg.norm(x, axis=-1, keepdims=True)
    base = unit(rng.normal(size=(4, 48)))
    close = [unit(base[0] + 0.02 * rng.normal(size=(60, 48)))]  # one ball
    close += [unit(base[1] + np.linspace(0, 1, 30)[:, None] * base[2])]  # a chain wider than a ball
    vectors = [list(map(float, v)) for part in [*close, unit(rng.normal(size=(80, 48)))] for v in np.float32(part)]
    vectors += [vectors[0]] * 25 + [[2 * x for x in vectors[100]]]
    ids = [1_000 - 3 * i for i in range(len(vectors))]
    assert run(spark, ids, vectors) == by_hand(ids, vectors)


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    vectors = [[1.0, 0.0], [1.0, 0.01], [0.0, 0.0], [0.0, 0.0], None, None, [], [1.0, None], [1.0, nan], [inf, 0.0], [inf, 0.0], [1.0, 0.0, 0.0], [-1.0, 0.0], [1.0, -0.0], [1e-30, 0.0], [3e38, 1e38], [5.0], [7.0], [1.0, 0.0], [0.0, 1.0]]
    ids = [5, 4, 3, 2, 1, None, 0, 9, 8, 7, 6, 11, 12, 13, 14, 15, 16, 17, None, 5]
    assert run(spark, ids, vectors) == [(i, n, c, k if i is not None else True) for i, n, c, k in by_hand(ids, vectors)]
    assert run(spark, [], []) == []


def test_recall_at_the_limit():
    """Pairs of cosine 0.9 to 0.901 meet in at least 0.99 of all cases, those of unlike vectors seldom."""
    rng = np.random.default_rng(3)
    unit = lambda x: x / np.linalg.norm(x, axis=-1, keepdims=True)
    a, b = unit(rng.normal(size=(1500, 64))), unit(rng.normal(size=(1500, 64)))
    b = unit(b - (a * b).sum(axis=1, keepdims=True) * a)
    cos = rng.uniform(0.9, 0.901, size=(1500, 1))
    near = cos * a + np.sqrt(1 - cos**2) * b
    own, other, far = (lattice_dedup.cells(x) for x in (a, near, b))
    meet = lambda x, y: np.mean(lattice_dedup.first_common(x, y) < np.iinfo(np.int64).max)
    assert meet(own, other) >= 0.99 and meet(own, far) <= 0.01


def test_recall_on_the_table(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    rows = df.orderBy("vec_id").collect()
    vectors = [r["embedding"] for r in rows]
    # a near copy of each tenth vector
    rng = np.random.default_rng(4)
    vectors += [[float(np.float32(x + 0.02 * e)) for x, e in zip(v, rng.normal(size=len(v)), strict=True)] for v in vectors[::10]]
    ids = list(range(len(vectors)))
    want = by_hand(ids, vectors)
    assert sum(n for _, n, _, _ in want) >= 100
    assert run(spark, ids, vectors) == want


def test_segments_out_of_range_raise(spark):
    from sylvaframe.llm import multi_index

    codes = spark.createDataFrame([(1, 5), (2, 7)], "id long, code long")
    for segments in (1, 2, 17, 20):
        with pytest.raises(ValueError):
            multi_index.search(codes, codes, 1, segments)
