"""Hash tables of p-stable projections and the order in which a query visits their cells."""

from __future__ import annotations

import heapq
from dataclasses import dataclass

import numpy as np

from .base import BASE_A, U64, mix


@dataclass(frozen=True)
class Tables:
    """`count` tables of `width` Gaussian projections each, cut to cells of side `side`."""

    directions: np.ndarray  # (count, width, dimension)
    shifts: np.ndarray  # (count, width)
    side: float

    @staticmethod
    def draw(dimension: int, count: int, width: int, side: float, seed: int) -> Tables:
        rng = np.random.default_rng(seed)
        return Tables(rng.normal(size=(count, width, dimension)), rng.uniform(0, side, (count, width)), side)

    def project(self, x: np.ndarray) -> np.ndarray:
        """(rows, tables, projections), in units of a cell."""
        count, width, dimension = self.directions.shape
        return ((x @ self.directions.reshape(-1, dimension).T).reshape(len(x), count, width) + self.shifts) / self.side

    @staticmethod
    def names(cells: np.ndarray) -> np.ndarray:
        """A 64-bit name for each cell (last axis: its coordinates)."""
        out = np.zeros(cells.shape[:-1], U64)
        with np.errstate(over="ignore"):
            for k in range(cells.shape[-1]):
                out = mix(out * U64(BASE_A) + (cells[..., k].astype(np.int64) + (1 << 20)).astype(U64))
        return out.view(np.int64)


def probes(at: np.ndarray, most: int) -> np.ndarray:
    """The `most` cells that most likely hold neighbours of a point at `at` (one table): its own first, then those reached by
    the sets of steps to adjacent cells with the smallest sums of squared distances to the walls crossed.

    Sets are made in order from the sorted walls: each set yields the one with its last wall replaced by the next, and the one with the next added.
    """
    own = np.floor(at)
    width = len(at)
    distance = np.concatenate([at - own, own + 1 - at]) ** 2
    order = np.argsort(distance, kind="stable")
    cost = distance[order]
    axis, step = order % width, np.where(order < width, -1, 1)
    out = [own]
    heap: list[tuple[float, tuple[int, ...]]] = [(float(cost[0]), (0,))]
    while heap and len(out) < most:
        total, walls = heapq.heappop(heap)
        last = walls[-1]
        if last + 1 < 2 * width:
            heapq.heappush(heap, (total - cost[last] + cost[last + 1], (*walls[:-1], last + 1)))
            heapq.heappush(heap, (total + cost[last + 1], (*walls, last + 1)))
        crossed = axis[list(walls)]
        if len(set(crossed.tolist())) == len(walls):
            cell = own.copy()
            cell[crossed] += step[list(walls)]
            out.append(cell)
    return np.array(out)
