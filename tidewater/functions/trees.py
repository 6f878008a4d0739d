"""Shapley attributions of tree ensembles, leaf by leaf: imported by workers."""

from __future__ import annotations

from dataclasses import dataclass
from itertools import combinations
from math import factorial

import numpy as np


@dataclass(frozen=True)
class Leaf:
    """A leaf's weighted value and, for each feature on its path, the interval that leads to it
    (low < x <= high) and the share of training rows that go on along the path."""

    value: float
    features: tuple[int, ...]
    low: tuple[float, ...]
    high: tuple[float, ...]
    share: tuple[float, ...]


def attributions(leaves: list[Leaf], x: np.ndarray) -> np.ndarray:
    """Rows times features. In a leaf's game a known feature counts as 1 if the row goes along the
    path and 0 if not, an unknown one as its share; features off the path add nothing, so the sum
    runs over subsets of the path's features only."""
    out = np.zeros(x.shape)
    for leaf in leaves:
        d = len(leaf.features)
        inside = np.stack([(x[:, f] > a) & (x[:, f] <= b) for f, a, b in zip(leaf.features, leaf.low, leaf.high)], 1).astype(float) if d else None
        for i in range(d):
            others = [j for j in range(d) if j != i]
            gain = inside[:, i] - leaf.share[i]
            for size in range(d):
                weight = factorial(size) * factorial(d - size - 1) / factorial(d)
                for known in combinations(others, size):
                    rest = np.prod([leaf.share[j] for j in others if j not in known]) if d - size - 1 else 1.0
                    along = inside[:, list(known)].prod(1) if size else 1.0
                    out[:, leaf.features[i]] += leaf.value * weight * gain * rest * along
    return out


def expected(leaves: list[Leaf]) -> float:
    """The ensemble's mean prediction over the training rows, as the trees hold it."""
    return float(sum(leaf.value * np.prod(leaf.share) for leaf in leaves))
