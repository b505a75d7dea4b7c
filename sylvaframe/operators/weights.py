"""Class weights by rank: Skellam distributions, equal rank sizes, seeds and tree counts. Small driver-side tables."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np


def skellam_pmf(k: np.ndarray, mu: float) -> np.ndarray:
    """P(X = k) of the difference of two Poisson(mu) variables: Bessel functions I_k(2 mu) by their downward recurrence, over their sum.

    The recurrence starts where they no longer count and is scaled on the way, so that no mu and no k overflows; masses too small for a double are 0.
    """
    k, x = np.abs(np.asarray(k, int)), 2 * mu
    if mu == 0:
        return (k == 0).astype(float)
    top = max(int(k.max(initial=0)), int(12 * math.sqrt(x))) + 60
    found, scales = np.empty(top + 1), np.zeros(top + 1, int)
    above, here, scale = 0.0, 1.0, 0
    for i in range(top, -1, -1):
        found[i], scales[i] = here, scale
        above, here = here, above + 2 * i / x * here
        if here > 1e150:
            above, here, scale = above * 1e-150, here * 1e-150, scale + 1
    mass = found * 1e-150 ** np.minimum(scales.max() - scales, 3)
    return mass[k] / (mass[0] + 2 * mass[1:].sum())


def skellam_class_weights(mu: float | str, n_classes: int, peak: int = 0, rescale: bool = True) -> np.ndarray:
    """Weights of the classes, largest at peak: mu 0 is one-hot, infinite mu uniform."""
    peak, mu = peak % n_classes, float(mu)
    if mu < 0:
        raise ValueError("mu must not be negative")
    if mu == 0:
        return np.eye(n_classes)[peak]
    if math.isinf(mu):
        return np.full(n_classes, 1 / n_classes)
    middle = n_classes // 2
    weights = np.roll(skellam_pmf(np.arange(n_classes) - middle, mu), peak - middle)
    return weights / weights.sum() if rescale else weights


def skellam_rank_weights(n_ranks: int, n_classes: int, mu: float | str) -> np.ndarray:
    """ranks x classes, peaks evenly spaced over the classes."""
    peaks = np.round(np.linspace(0, n_classes, n_ranks + 1))[:-1].astype(int)
    return np.array([skellam_class_weights(mu, n_classes, int(p)) for p in peaks])


def proportional_fit(weights: np.ndarray, rows: Sequence[float], columns: Sequence[float], tolerance: float = 1e-9, most: int = 10_000) -> np.ndarray:
    """Iterative proportional fitting of a matrix to row and column sums."""
    out, rows, columns = np.array(weights, float), np.asarray(rows, float), np.asarray(columns, float)
    columns = columns * rows.sum() / columns.sum()
    for _ in range(most):
        sums = out.sum(axis=1)
        out *= np.divide(rows, sums, out=np.zeros_like(rows), where=sums > 0)[:, None]
        sums = out.sum(axis=0)
        out *= np.divide(columns, sums, out=np.zeros_like(columns), where=sums > 0)
        if np.abs(out.sum(axis=1) - rows).max() < tolerance:
            return out
    raise ValueError(f"no matrix with these zeros has the row and column sums, or {most} rounds do not reach them")


def constant_size_weights(weights: np.ndarray, class_counts: Sequence[int]) -> np.ndarray:
    """Weights under which every rank gets as many samples as any other."""
    n_ranks, counts = len(weights), np.asarray(class_counts, float)
    return proportional_fit(weights, [1.0] * n_ranks, counts / counts.sum() * n_ranks)


def alias_table(weights: Sequence[float]) -> tuple[list[float], list[int]]:
    """(keep, alias): column i of n gives i with chance keep[i] and else alias[i], so one draw and one lookup sample by weight."""
    w = np.asarray(weights, float)
    if w.sum() <= 0 or (w < 0).any():
        raise ValueError("a class has no rank with a positive weight")
    n = len(w)
    left = w / w.sum() * n
    keep, alias = [1.0] * n, list(range(n))
    small, large = [i for i in range(n) if left[i] < 1], [i for i in range(n) if left[i] >= 1]
    while small and large:
        i, j = small.pop(), large[-1]
        keep[i], alias[i] = float(left[i]), j
        left[j] -= 1 - left[i]
        if left[j] < 1:
            small.append(large.pop())
    for i in small:  # rounding errors only, but for weights of 0, which are never kept
        if w[i] == 0:
            keep[i], alias[i] = 0.0, int(w.argmax())
    return keep, alias


def largest_remainder(total: int, weights: Sequence[float]) -> list[int]:
    """Whole shares of total; the units left go to the largest remainders, among equal ones to the later."""
    w = np.asarray(weights, float)
    if w.sum() <= 0:
        raise ValueError("a class has no rank with a positive weight")
    exact = w / w.sum() * total
    share = np.floor(exact).astype(int)
    order = sorted(range(len(w)), key=lambda i: (exact[i] - share[i], i), reverse=True)
    for i in order[: total - int(share.sum())]:
        share[i] += 1
    return share.tolist()


def tree_counts(n_trees: int, n_ranks: int) -> list[int]:
    """Trees per rank; the first ranks get the remainder."""
    return [n_trees // n_ranks + (r < n_trees % n_ranks) for r in range(n_ranks)]


def scaled_trees(n_trees: int, n_ranks: int, scaling: str | None) -> tuple[int, int]:
    """(local, global) number of trees under strong, weak or no scaling."""
    if scaling == "strong":
        return n_trees // n_ranks, n_trees // n_ranks * n_ranks
    return n_trees, n_trees * n_ranks if scaling == "weak" else n_trees


def rank_seeds(seed: int | None, n_ranks: int, add_rank: bool = False) -> list[int | None]:
    if seed is None:
        return [None] * n_ranks
    if add_rank:
        return [seed + r for r in range(n_ranks)]
    return np.random.RandomState(seed).randint(0, 2**32 - 1, n_ranks, dtype=np.uint32).astype(int).tolist()


def model_base_seed(data_seed: int, model_seed: int | None = None) -> int:
    """Seed of the model: the given one, or else the first number drawn from the data's generator."""
    return model_seed if model_seed is not None else int(np.random.RandomState(data_seed).randint(0, 2**32 - 1, dtype=np.uint32))
