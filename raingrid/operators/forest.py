"""A random forest of two classes, grown level by level from counts taken by numpy inside the tasks.

As in ``pyspark.ml``: every tree sees each row as often as a Poisson draw says, a node chooses among
the square root of the features, rounded up, by the gini gain over 32 bins, and the trees' shares of
the classes are added up. How often a tree sees a row hangs on a hash of the row's key, so it needs
no memory and does not change with the tasks.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from raingrid.operators.common import dealt
from raingrid.session import written

#: Bins of a feature, rows that are taken at once, and nodes whose counts a task holds.
BINS, CHUNK, MOST_NODES = 32, 65_536, 40_000


def _seen() -> np.ndarray:
    """How often a row is seen, for the upper 16 bits of its hash: a Poisson draw with mean 1."""
    upto = np.cumsum([math.exp(-1.0) / math.factorial(i) for i in range(12)])
    return np.searchsorted(upto, (np.arange(65_536) + 0.5) / 65_536, side="right").astype(np.uint8)


def _draws(keys: np.ndarray, tree: int, seed: int, table: np.ndarray) -> np.ndarray:
    shift = (((tree + 1) * 0x9E3779B97F4A7C15) ^ (seed * 0xD1B54A32D192ED03)) % 2 ** 64
    h = keys + np.uint64(shift)
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return table[(h ^ (h >> np.uint64(31))) >> np.uint64(48)]


def _bins(columns, borders) -> np.ndarray:
    """Features x rows: number of the borders below each value."""
    return np.stack([np.searchsorted(b, c.to_numpy(zero_copy_only=False).astype(float)).astype(np.int8)
                     for c, b in zip(columns, borders)])


class Trees:
    """Nodes of all trees. A leaf is its own left child and sends no row to the right."""

    def __init__(self, trees: int):
        self.feature = [np.zeros(1, np.int32) for _ in range(trees)]
        self.cut = [np.full(1, 127, np.int8) for _ in range(trees)]
        self.left = [np.zeros(1, np.int32) for _ in range(trees)]
        self.wet = [np.zeros(1) for _ in range(trees)]

    def __len__(self):
        return len(self.left)

    def walk(self, t: int, flat: np.ndarray, n: int, at: np.ndarray, steps: int) -> np.ndarray:
        """Node of the rows ``at`` of tree ``t`` after so many steps; ``flat`` is features x n."""
        node, feature, cut, left = np.zeros(len(at), np.int32), self.feature[t], self.cut[t], self.left[t]
        for _ in range(min(steps, len(left))):
            node = left[node] + (flat[feature[node] * n + at] > cut[node])
        return node

    def split(self, t: int, nodes, feature, cut, wet_left, wet_right) -> np.ndarray:
        """Gives ``nodes`` two leaves each; returns the left ones."""
        size, many = len(self.left[t]), len(nodes)
        first = (size + 2 * np.arange(many)).astype(np.int32)
        self.feature[t][nodes], self.cut[t][nodes], self.left[t][nodes] = feature, cut, first
        grow = lambda a, more: np.concatenate([a, more]).astype(a.dtype)
        self.feature[t] = grow(self.feature[t], np.zeros(2 * many))
        self.cut[t] = grow(self.cut[t], np.full(2 * many, 127))
        self.left[t] = grow(self.left[t], size + np.arange(2 * many))
        self.wet[t] = grow(self.wet[t], np.stack([wet_left, wet_right], 1).ravel())
        return first


def _counts(nodes: Trees, slots: dict, chosen: dict, level: int, features: int, seed: int):
    """Function of the rows of a task: for each tree the counts of slot x choice x bin x class."""
    table = _seen()

    def run(batches):
        sums = {t: np.zeros((c.shape[1], c.shape[0] * BINS * 2)) for t, c in chosen.items()}

        def add(part):
            part = pa.Table.from_batches(part)
            n = len(part)
            column = lambda c: part[c].to_numpy()
            flat = np.concatenate([column(f"b{i}") for i in range(features)])
            label, keys = column("label").astype(np.int32), column("key").view(np.uint64)
            for t, own in slots.items():
                often = _draws(keys, t, seed, table)
                at = np.flatnonzero(often).astype(np.int32)
                slot = own[nodes.walk(t, flat, n, at, level)]
                here = np.flatnonzero(slot >= 0)
                at, slot = at[here], slot[here]
                weight, base = often[at], slot * (2 * BINS) + label[at]
                for j in range(chosen[t].shape[1]):
                    value = flat[chosen[t][slot, j] * n + at]
                    sums[t][j] += np.bincount(base + 2 * value, weight, minlength=sums[t].shape[1])

        held, rows, seen = [], 0, 0
        for b in batches:
            held.append(b)
            rows, seen = rows + b.num_rows, seen + b.num_rows
            if rows >= CHUNK:
                add(held)
                held, rows = [], 0
        if rows:
            add(held)
        if seen:
            yield pa.RecordBatch.from_arrays([
                pa.array(list(sums), pa.int32()),
                pa.array([s.astype(np.int64).tobytes() for s in sums.values()], pa.binary())],
                ["tree", "counts"])

    return run


def _best(chosen: dict):
    """Function of a tree's counts of all tasks: a row for each slot with its best split."""
    def run(table: pa.Table) -> pa.Table:
        t = table["tree"][0].as_py()
        c = chosen[t]
        total = sum(np.frombuffer(b.as_py(), np.int64) for b in table["counts"])
        split = total.reshape(c.shape[1], c.shape[0], BINS, 2).transpose(1, 0, 2, 3).astype(float)
        left = np.cumsum(split, axis=2)
        whole = left[:, :1, -1:, :]
        right = whole - left

        def impurity(x):
            n = x.sum(axis=-1)
            with np.errstate(all="ignore"):
                share = np.where(n > 0, x[..., 1] / n, 0.0)
            return n, 2.0 * share * (1.0 - share), share

        (n, g, wet), (nl, gl, wl), (nr, gr, wr) = map(impurity, (whole, left, right))
        with np.errstate(all="ignore"):
            gain = np.where((nl >= 1) & (nr >= 1), g - (nl * gl + nr * gr) / n, -1.0).reshape(len(c), -1)
        at = gain.argmax(axis=1)
        s, (j, b) = np.arange(len(c)), np.divmod(at, BINS)
        columns = {"tree": np.full(len(c), t, np.int32), "slot": s.astype(np.int32),
                   "feature": c[s, j].astype(np.int32), "cut": b.astype(np.int32), "gain": gain[s, at],
                   "n": n[:, 0, 0], "wet": wet[:, 0, 0], "left": wl[s, j, b], "right": wr[s, j, b],
                   "pure_left": gl[s, j, b] == 0, "pure_right": gr[s, j, b] == 0}
        return pa.table(columns)

    return run


SPLIT = ("tree int, slot int, feature int, cut int, gain double, n double, wet double, `left` double, "
         "`right` double, pure_left boolean, pure_right boolean")


class Forest:
    """What ``grown`` returns: the features' names, their borders, the trees and the importances."""

    def __init__(self, names, borders, nodes: Trees, depth: int, importances):
        self.names, self.borders, self.nodes, self.depth = names, borders, nodes, depth
        self.importances = importances

    def transform(self, df: DataFrame, names=None, out="rain") -> DataFrame:
        """Adds the more likely class (0 or 1) of every row; 0 if both are equally likely. ``names``
        are the features' columns, if they have other names here."""
        borders, nodes, depth = self.borders, self.nodes, self.depth

        @F.arrow_udf("double")
        def likely(*columns: pa.Array) -> pa.Array:
            n = len(columns[0])
            flat, at, wet = _bins(columns, borders).ravel(), np.arange(n, dtype=np.int32), np.zeros(n)
            for t in range(len(nodes)):
                wet += nodes.wet[t][nodes.walk(t, flat, n, at, depth)]
            return pa.array((wet > len(nodes) - wet).astype(float))

        return df.withColumn(out, likely.asNondeterministic()(*[F.col(c).cast("double") for c in names or self.names]))


def grown(df: DataFrame, names: list[str], label: Column, key: Column, trees=100, depth=8, seed=42) -> Forest:
    """Forest for the rows of ``df``; ``label`` is 0 or 1, and ``names`` and ``key`` are never null.

    Rows are written once as bins of a byte. A level is one pass over them: each task adds up counts,
    a tree's counts meet in one task, and only the splits reach the driver.
    """
    shares = [i / BINS for i in range(1, BINS)]
    numbers = df.select(*[F.col(c).cast("double").alias(c) for c in names])
    borders = [np.unique(q) for q in numbers.approxQuantile(names, shares, 1e-3)]
    fields = ", ".join(f"b{i} tinyint" for i in range(len(names))) + ", label tinyint, key long"

    def binned(batches):
        for b in batches:
            columns = list(_bins(b.columns[:-2], borders))
            yield pa.RecordBatch.from_arrays([*map(pa.array, columns), *b.columns[-2:]], [
                *[f"b{i}" for i in range(len(columns))], "label", "key"])

    rows = df.select(*[F.col(c).cast("double").alias(f"v{i}") for i, c in enumerate(names)],
                     label.cast("tinyint").alias("label"), key.cast("long").alias("key"))
    rows = written(dealt(rows.mapInArrow(binned, fields), "key"), "forest")
    nodes, few = Trees(trees), math.ceil(math.sqrt(len(names)))
    open_ = [(t, 0) for t in range(trees)]
    weights = np.zeros((trees, len(names)))
    for level in range(depth):
        random = np.random.default_rng([seed, level])
        found = []
        for first in range(0, len(open_), MOST_NODES):
            part = open_[first:first + MOST_NODES]
            mine, slots, chosen = {}, {}, {}
            for t, node in part:
                mine.setdefault(t, []).append(node)
            for t, some in mine.items():
                slots[t] = np.full(len(nodes.left[t]), -1, np.int32)
                slots[t][some] = np.arange(len(some))
                chosen[t] = random.random((len(some), len(names))).argsort(axis=1)[:, :few].astype(np.int32)
            splits = rows.mapInArrow(
                _counts(nodes, slots, chosen, level, len(names), seed), "tree int, counts binary").groupBy(
                "tree").applyInArrow(_best(chosen), SPLIT).toPandas()  # a row for each open node
            found.append((mine, splits))
        open_ = []
        for mine, splits in found:
            for t, s in splits.sort_values(["tree", "slot"]).groupby("tree"):
                if not level:
                    nodes.wet[t][0] = s["wet"].iloc[0]
                s = s[s["gain"] > 0]
                np.add.at(weights[t], s["feature"].to_numpy(), (s["gain"] * s["n"]).to_numpy())
                left = nodes.split(t, np.array(mine[t])[s["slot"].to_numpy()], s["feature"].to_numpy(),
                                   s["cut"].to_numpy(), s["left"].to_numpy(), s["right"].to_numpy())
                open_ += [(t, int(c)) for c in left[~s["pure_left"].to_numpy()]]
                open_ += [(t, int(c) + 1) for c in left[~s["pure_right"].to_numpy()]]
        if not open_:
            break
    each = weights.sum(axis=1, keepdims=True)
    shares = (weights / np.where(each > 0, each, 1.0)).sum(axis=0)
    return Forest(names, borders, nodes, depth, (shares / (shares.sum() or 1.0)).tolist())
