"""K-means for several numbers of clusters at once: each pass over the rows serves all of them.

As in ``pyspark.ml``: centers begin with parallel sampling by distance (two rounds) and a weighted
k-means++ over what was taken, and move until none moves by more than a tolerance. Rows stay in their
files between the passes; a task holds one Arrow batch and gives one row of sums.
"""

from __future__ import annotations

import pickle

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

#: Rounds of sampling, steps at most, and the move below which a center stays.
ROUNDS, STEPS, TOLERANCE = 2, 20, 1e-4


def _squares(x: np.ndarray, centers: np.ndarray) -> np.ndarray:
    """Least squared distance of each row of ``x`` (columns x rows) to ``centers``."""
    least = np.full(x.shape[1], np.inf)
    for c in centers:
        np.minimum(least, sum((v - a) ** 2 for v, a in zip(x, c)), out=least)
    return least


def _owner(x: np.ndarray, centers: np.ndarray) -> np.ndarray:
    """Number of the nearest of ``centers``; the first of equal ones."""
    best, owner = None, np.zeros(x.shape[1], np.int64)
    for j, c in enumerate(centers):
        far = sum((v * (-2.0 * a) for v, a in zip(x, c)), float(c @ c))
        if best is None:
            best = far
        else:
            owner[far < best] = j
            np.minimum(best, far, out=best)
    return owner


def _pass(rows: DataFrame, each, start) -> list:
    """What ``each(state, x, random)`` makes of ``start()`` over the batches of each task."""
    def run(batches):
        state, random = start(), None
        for b in batches:
            if random is None:
                random = np.random.default_rng([TaskContext.get().partitionId(), 1])
            if b.num_rows:
                state = each(state, np.stack([c.to_numpy() for c in b.columns]), random)
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(state)], pa.binary())], ["state"])

    return [pickle.loads(r["state"]) for r in rows.mapInArrow(run, "state binary").collect()]  # one a task


def _sums(rows: DataFrame, centers: dict) -> dict:
    """For each of ``centers``: number and sums of the rows that are nearest to it."""
    def each(state, x, _):
        for k, c in centers.items():
            own = _owner(x, c)
            state[k][:, 0] += np.bincount(own, minlength=len(c))
            for i, v in enumerate(x):
                state[k][:, i + 1] += np.bincount(own, v, minlength=len(c))
        return state

    parts = _pass(rows, each, lambda: {k: np.zeros((len(c), c.shape[1] + 1)) for k, c in centers.items()})
    return {k: sum(p[k] for p in parts) for k in centers}


def _plus_plus(points: np.ndarray, weights: np.ndarray, k: int, random) -> np.ndarray:
    """Centers of few weighted points: k-means++ and at most 30 steps."""
    pick = lambda w: points[random.choice(len(points), p=w / w.sum())] if w.sum() > 0 else points[0]
    centers = pick(weights)[None]
    while len(centers) < k:
        centers = np.concatenate([centers, pick(weights * _squares(points.T, centers))[None]])
    for _ in range(30):
        own = _owner(points.T, centers)
        moved = centers.copy()
        for j in range(k):
            mine = own == j
            if weights[mine].sum() > 0:
                moved[j] = np.average(points[mine], axis=0, weights=weights[mine])
        if (moved == centers).all():
            break
        centers = moved
    return centers


def _beginning(rows: DataFrame, sizes, seed: int) -> dict:
    def first(state, x, random):
        draws = np.random.default_rng([seed, int(random.integers(2 ** 62))]).random(x.shape[1])
        at = int(draws.argmin())
        return min(state, (float(draws[at]), x[:, at].tolist())) if state else (float(draws[at]), x[:, at].tolist())

    start = np.array([min(s for s in _pass(rows, first, lambda: None) if s)[1]])
    found = {k: start for k in sizes}
    for turn in range(ROUNDS):
        def cost(state, x, _):
            return {k: state[k] + _squares(x, c).sum() for k, c in found.items()}

        whole = _pass(rows, cost, lambda: dict.fromkeys(found, 0.0))
        whole = {k: sum(p[k] for p in whole) for k in found}

        def taken(state, x, random):
            draws = np.random.default_rng([seed, turn, int(random.integers(2 ** 62))]).random(x.shape[1])
            for k, c in found.items():
                if whole[k] > 0:
                    state[k].append(x[:, draws < 2.0 * k * _squares(x, c) / whole[k]].T)
            return state

        more = _pass(rows, taken, lambda: {k: [] for k in found})
        found = {k: np.unique(np.concatenate([c, *[t for p in more for t in p[k]]]), axis=0)
                 for k, c in found.items()}
    weights = _sums(rows, found)
    return {k: c if len(c) <= k else _plus_plus(c, weights[k][:, 0], k, np.random.default_rng([seed, k]))
            for k, c in found.items()}


def centers_of(rows: DataFrame, sizes, seed=42) -> dict:
    """Centers for each number of clusters in ``sizes``; fewer where the rows have fewer points.

    All columns of ``rows`` are numbers without nulls, and they are read some 25 times.
    """
    centers = _beginning(rows, sizes, seed)
    moving = dict(centers)
    for _ in range(STEPS):
        for k, s in _sums(rows, moving).items():
            n = s[:, :1]
            moved = np.where(n > 0, s[:, 1:] / np.maximum(n, 1), centers[k])
            if (((moved - centers[k]) ** 2).sum(axis=1) <= TOLERANCE ** 2).all():
                del moving[k]
            centers[k] = moved
            if k in moving:
                moving[k] = moved
        if not moving:
            break
    return {k: c.tolist() for k, c in centers.items()}
