"""Directions of clusters in cells, in which the closest of a cluster is sought without comparing all of them."""

from __future__ import annotations

import numpy as np

EPSILON = 1.1920929e-07  # of single precision
PLACES = 1e12  # closeness counts in steps of 1 / PLACES, so that equal pairs are equal however they are computed
GONE = -4.0  # closeness of what is no cluster
SLACK = 1e-7  # of bounds, whose roots lose half of the digits


def units(sums: np.ndarray) -> np.ndarray:
    """Rows of length 1; those without direction become 0."""
    with np.errstate(all="ignore"):
        lengths = np.linalg.norm(sums, axis=1, keepdims=True)
        return np.where((lengths > EPSILON) & np.isfinite(lengths), sums / lengths, 0.0)


def unit(x: np.ndarray) -> np.ndarray:
    """The same of one row."""
    length = float(x @ x) ** 0.5
    return x / length if EPSILON < length < np.inf else np.zeros(len(x))


class Directions:
    """Unit vectors of clusters, in cells of width each, which a cone bounds: a centre and the widest angle to it.

    A cluster is compared with the cells whose cone may hold something as close as
    the closest of the cell at its own direction. Zero vectors have closeness 0 to
    all; least is 0 for the cells that hold one.
    """

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, width: int = 128):
        n, d = vectors.shape
        count = -(-n // width)
        order, todo = np.arange(n), [(0, count)]
        while todo:  # halves along the axis of the largest extent
            a, b = todo.pop()
            if b - a > 1:
                own, half = order[a * width : b * width], (a + b) // 2
                values = vectors[own]
                axis = int(np.ptp(values, axis=0).argmax())
                order[a * width : b * width] = own[np.argpartition(values[:, axis], (half - a) * width)]
                todo += [(a, half), (half, b)]
        self.width, self.count, self.d = width, count, d
        self.ids = np.full(count * width, -1)
        self.ids[:n] = ids[order]
        flat = np.zeros((count * width, d))
        flat[:n] = vectors[order]
        self.values = np.zeros((d + 1, count * width))  # the last row holds GONE where there is no cluster
        self.values[:d] = flat.T
        self.values[d, n:] = GONE
        self.cells = self.values.reshape(d + 1, count, width)
        members = flat.reshape(count, width, d)
        directed = members.any(axis=2)
        centres = members.sum(axis=1)
        lengths = np.linalg.norm(centres, axis=1, keepdims=True)
        self.centres = np.where(lengths > 1e-6, centres / np.maximum(lengths, 1e-6), np.eye(d)[0])
        self.cos = np.where(directed, np.einsum("cwd,cd->cw", members, self.centres), 1.0).min(axis=1)
        self.sin = np.sqrt(np.maximum(1 - self.cos**2, 0))
        self.least = np.where((~directed & (self.ids.reshape(count, width) >= 0)).any(axis=1), 0.0, GONE)
        self.slot = {c: s for s, c in enumerate(self.ids.tolist()) if c >= 0}

    def replace(self, i: int, j: int, unit: np.ndarray) -> None:
        """Put unit for i, which j is merged into; it goes to the cell of theirs that it widens less."""
        p, q = self.slot.pop(i), self.slot.pop(j)
        self.values[:-1, [p, q]], self.values[-1, [p, q]], self.ids[[p, q]] = 0.0, GONE, -1
        x, y = p // self.width, q // self.width
        if x != y and self.centres[y] @ unit - self.cos[y] > self.centres[x] @ unit - self.cos[x]:
            p, x = q, y
        self.values[:-1, p], self.values[-1, p], self.ids[p], self.slot[i] = unit, 0.0, i, p
        if not unit.any():
            self.least[x] = 0.0
        elif (cos := float(self.centres[x] @ unit)) < self.cos[x]:
            self.cos[x], self.sin[x] = cos, max(1 - cos * cos, 0) ** 0.5

    def closest(self, c: int) -> tuple[float, int]:
        """Closeness in steps and the cluster closest to c, the first of equal ones."""
        s = self.slot[c]
        u = self.values[:, s].copy()
        u[-1] = 1.0
        self.values[-1, s] = GONE
        cells = None
        if u[:-1].any():
            cos = self.centres @ u[:-1]
            bound = np.where(cos >= self.cos, 1.0, cos * self.cos + np.sqrt(np.maximum(1 - cos * cos, 0)) * self.sin)
            near = (u @ self.cells[:, int(cos.argmax())]).max()
            cells = (np.maximum(bound, self.least) >= near - SLACK).nonzero()[0]
        if cells is None or 2 * len(cells) > self.count:
            found, ids = u @ self.values, self.ids
        else:
            found, ids = u @ self.cells[:, cells].reshape(len(u), -1), self.ids.reshape(self.count, -1)[cells].ravel()
        self.values[-1, s] = 0.0
        at = (found >= found.max() - 1.5 / PLACES).nonzero()[0]
        if len(at) == 1:
            return float(np.rint(found[at[0]] * PLACES)), int(ids[at[0]])
        steps = np.rint(found[at] * PLACES)
        return float(steps.max()), int(ids[at[steps == steps.max()]].min())
