"""Union-find inside one task."""

from __future__ import annotations

import numpy as np


class Forest:
    """Union-find over positions that keeps the links which joined two sets."""

    def __init__(self, n: int):
        self.parent = np.arange(n)
        self.edges: list[tuple[int, int]] = []

    def _find(self, i: int) -> int:
        p = self.parent
        while p[i] != i:
            p[i] = p[p[i]]
            i = p[i]
        return i

    def roots(self) -> np.ndarray:
        p = self.parent
        while True:
            q = p[p]
            if np.array_equal(q, p):
                return p
            self.parent = p = q

    def add(self, i: np.ndarray, j: np.ndarray) -> None:
        r = self.roots()
        a, b = r[i], r[j]
        new = a != b
        if not new.any():
            return
        i, j, a, b = i[new], j[new], a[new], b[new]
        lo, hi = np.minimum(a, b), np.maximum(a, b)
        _, first = np.unique(lo * len(r) + hi, return_index=True)
        for x, y in zip(i[first].tolist(), j[first].tolist()):
            a, b = self._find(x), self._find(y)
            if a != b:
                self.parent[max(a, b)] = min(a, b)
                self.edges.append((x, y))
