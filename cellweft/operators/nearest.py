"""Nearest points inside tiles of the plane, in numpy, for the spatial joins.

A tile's points are cut into leaves by medians, so leaves are small where points are dense and wide where they are rare. The nearest points of
a leaf's own members bound what has to be looked at; only leaves whose boxes are within that bound are compared.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

#: Points of a leaf at most, but more than are searched for; numbers held at once while visitors are compared.
LEAF, SLAB = 32, 4_000_000


class Leaves:
    """Points ``(x, y, site)`` in leaves of nearly equal size; within a leaf they are in order of site."""

    def __init__(self, x: np.ndarray, y: np.ndarray, site: np.ndarray, least: int) -> None:
        size = max(LEAF, 2 * least)
        parts = [np.arange(len(x))]
        while len(parts[0]) > size or len(parts[-1]) > size:
            halves = []
            for p in parts:
                if len(p) <= size:
                    halves.append(p)
                    continue
                along = x if np.ptp(x[p]) >= np.ptp(y[p]) else y
                split = p[np.argpartition(along[p], len(p) // 2)]
                halves += [split[:len(p) // 2], split[len(p) // 2:]]
            parts = halves
        self.parts = [p[np.argsort(site[p], kind="stable")] for p in parts if len(p)]
        self.x, self.y, self.site = x, y, site
        self.box = np.array([[x[p].min(), x[p].max(), y[p].min(), y[p].max()] for p in self.parts]).reshape(-1, 4)

    def gaps(self, x0, x1, y0, y1) -> np.ndarray:
        """Squared distances of boxes to all leaves' boxes."""
        b = self.box
        dx = np.maximum(np.maximum(b[:, 0] - np.asarray(x1)[..., None], np.asarray(x0)[..., None] - b[:, 1]), 0)
        dy = np.maximum(np.maximum(b[:, 2] - np.asarray(y1)[..., None], np.asarray(y0)[..., None] - b[:, 3]), 0)
        return dx * dx + dy * dy


def smallest(d2: np.ndarray, names: np.ndarray, n: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each row of ``d2`` the ``n`` smallest and their names; ties to the smaller name. Columns are in order of name."""
    if d2.shape[1] <= n:
        order = np.argsort(d2, axis=1, kind="stable")
        for row, o in zip(d2, order, strict=True):
            yield row[o], names[o]
        return
    limit = np.partition(d2, n - 1, axis=1)[:, n - 1]
    for row, most in zip(d2, limit, strict=True):
        at = np.flatnonzero(row <= most)
        o = at[np.argsort(row[at], kind="stable")][:n]
        yield row[o], names[o]


def within(x: np.ndarray, y: np.ndarray, site: np.ndarray, n: int) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """For each point the ``n`` nearest of the same points, itself included: squared distances and sites, ties to the smaller site."""
    leaves = Leaves(x, y, site, n)
    far, names = [np.zeros(0)] * len(x), [site[:0]] * len(x)
    for p, (x0, x1, y0, y1) in zip(leaves.parts, leaves.box, strict=True):
        own = (x[p][:, None] - x[p][None, :]) ** 2 + (y[p][:, None] - y[p][None, :]) ** 2
        bound = np.partition(own, n - 1, axis=1)[:, n - 1].max() if len(p) >= n else np.inf
        near = np.flatnonzero(leaves.gaps(x0, x1, y0, y1) <= bound * (1 + 1e-12))
        q = np.concatenate([leaves.parts[i] for i in near])
        q = q[np.argsort(site[q], kind="stable")]
        d2 = (x[p][:, None] - x[q][None, :]) ** 2 + (y[p][:, None] - y[q][None, :]) ** 2
        for i, (d, s) in zip(p.tolist(), smallest(d2, site[q], n), strict=True):
            far[i], names[i] = d, s
    return far, names


def visit(vx: np.ndarray, vy: np.ndarray, limit: np.ndarray, x: np.ndarray, y: np.ndarray, site: np.ndarray, n: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each visitor the ``n`` nearest points of a tile, none farther than its limit (squared)."""
    leaves = Leaves(x, y, site, n)
    step = max(SLAB // max(len(x), 1), 1)
    order = np.lexsort((vy, vx))
    for i in range(0, len(vx), step):
        some = order[i:i + step]
        gap = leaves.gaps(vx[some], vx[some], vy[some], vy[some])
        near = np.flatnonzero((gap <= limit[some][:, None] * (1 + 1e-12)).any(0))
        if not len(near):
            continue
        q = np.concatenate([leaves.parts[j] for j in near])
        q = q[np.argsort(site[q], kind="stable")]
        d2 = (vx[some][:, None] - x[q][None, :]) ** 2 + (vy[some][:, None] - y[q][None, :]) ** 2
        for v, (d, s) in zip(some.tolist(), smallest(d2, site[q], n), strict=True):
            ok = d <= limit[v]
            if ok.any():
                yield v, d[ok], s[ok]
