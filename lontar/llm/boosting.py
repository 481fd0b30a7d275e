"""Gradient-boosted trees for several classes, on binned numeric columns.

Trees grow from sums of gradients by class, node, column and bin, so the rows may lie
in memory (``Rows``) or on the workers (``JobRows``, a job a level); either way all of
them count.  Prediction is a few array operations per tree and level, for whole Arrow batches.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from lontar.llm.arrow import batch, map_batches

#: Rows whose sums are made at a time, so that their keys stay in the processor's cache.
CHUNK = 8_192


def grid_keys(x: np.ndarray) -> np.ndarray:
    """Whole numbers in the order of the values, 4,096 to each doubling: cells in which values are counted for their quantiles."""
    k = np.ascontiguousarray(x, np.float32).view(np.int32)
    return (k ^ ((k >> 31) & 0x7FFFFFFF)) >> 11


def grid_values(keys: np.ndarray) -> np.ndarray:
    """The least value of each cell."""
    k = keys.astype(np.int32) << 11
    return (k ^ ((k >> 31) & 0x7FFFFFFF)).view(np.float32).astype(np.float64)


class Rows:
    """Binned rows in memory, with their scores and, for each class, the node of the tree being grown."""

    def __init__(self, b: np.ndarray, y: np.ndarray, classes: int, weight: np.ndarray | None = None, score: np.ndarray | None = None) -> None:
        self.b, self.y, self.classes, self.score = b, y, classes, score
        self.weight = np.ones(len(b)) if weight is None else weight

    def totals(self) -> np.ndarray:
        return np.bincount(self.y, self.weight, self.classes)

    def start(self, model: Boosted, r: int) -> None:
        """Gradients of round ``r`` from the scores."""
        if self.score is None:
            self.score = np.tile(model.prior, (len(self.b), 1))
        p = np.exp(self.score - self.score.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        hot = np.zeros_like(p)
        hot[np.arange(len(p)), self.y] = 1
        self.grad = np.ascontiguousarray(((p - hot) * self.weight[:, None]).T)
        self.hess = np.ascontiguousarray((np.maximum(p * (1 - p), 1e-6) * self.weight[:, None]).T)
        self.node = np.zeros((self.classes, len(self.b)), np.int64)

    def move(self, model: Boosted, r: int, level: int) -> None:
        """Send the rows down the splits of ``level``."""
        rows = np.arange(len(self.b))
        for k in range(self.classes):
            tree, at = r * self.classes + k, self.node[k] + 2**level - 1
            self.node[k] = 2 * self.node[k] + (self.b[rows, model.feature[tree][at]] > model.cut[tree][at])

    def finish(self, model: Boosted, r: int) -> None:
        """Add the values of the trees of round ``r`` to the scores."""
        self.move(model, r, model.depth - 1)
        for k in range(self.classes):
            self.score[:, k] += model.value[r * self.classes + k][self.node[k]]

    def sums(self, level: int, bins: int, side: np.ndarray | None) -> np.ndarray:
        """Sums of gradients and their slopes (2, classes, nodes, columns, bins): of all rows, or by parent of those in its child ``side``."""
        width, wide = self.b.shape[1], 2 ** max(0, level - 1)
        out = np.zeros((2, self.classes, wide * width * bins))
        offsets = np.arange(width)[:, None] * bins
        for a in range(0, len(self.b), CHUNK):
            here = slice(a, a + CHUNK)
            flat = np.ascontiguousarray(self.b[here].T) + offsets
            for k in range(self.classes):
                key, g, h = flat, self.grad[k, here], self.hess[k, here]
                if side is not None:
                    node = self.node[k, here]
                    parent = node >> 1
                    at = np.flatnonzero((node & 1) == side[k][parent])
                    if not len(at):
                        continue
                    key, g, h = flat.take(at, 1) + parent[at] * (width * bins), g[at], h[at]
                key = key.ravel()  # column by column
                out[0, k] += np.bincount(key, np.tile(g, width), out.shape[2])
                out[1, k] += np.bincount(key, np.tile(h, width), out.shape[2])
        return out.reshape(2, self.classes, wide, width, bins)

    def histograms(self, model: Boosted, r: int, level: int, side: np.ndarray | None) -> np.ndarray:
        if level:
            self.move(model, r, level - 1)
        else:
            if r:
                self.finish(model, r - 1)
            self.start(model, r)
        return self.sums(level, model.bins + 1, side)

    def close(self) -> None:
        pass


class JobRows:
    """The same over a DataFrame of ``y`` and ``b`` (the bins as bytes): a job a level, scores are stored with the rows once a round."""

    def __init__(self, rows: DataFrame, totals: np.ndarray, width: int) -> None:
        self.rows, self.weights, self.classes, self.width = rows.select("y", "b"), totals, len(totals), width
        self.scored: DataFrame | None = None

    def totals(self) -> np.ndarray:
        return self.weights

    def _load(self, b: pa.RecordBatch) -> Rows:
        bins = np.frombuffer(b"".join(b.column(1).to_pylist()), np.uint8).reshape(-1, self.width)
        score = np.frombuffer(b"".join(b.column(2).to_pylist())).reshape(-1, self.classes).copy() if b.num_columns > 2 else None
        return Rows(bins, b.column(0).to_numpy(), self.classes, score=score)

    def _keep(self, model: Boosted, r: int) -> None:
        """Store the scores that round ``r`` begins with."""
        last, load = self.scored, self._light()._load

        def work(b: pa.RecordBatch) -> pa.RecordBatch:
            rows = load(b)
            rows.start(model, r - 1)
            for level in range(model.depth - 1):
                rows.move(model, r - 1, level)
            rows.finish(model, r - 1)
            return batch(y=b.column(0), b=b.column(1), score=pa.array([s.tobytes() for s in rows.score], pa.binary()))

        self.scored = map_batches(self.rows if last is None else last, work, "y int, b binary, score binary").persist()
        self.scored.count()
        if last is not None:
            last.unpersist()

    def _light(self) -> JobRows:
        """This without its tables, to be sent to the workers."""
        light = object.__new__(JobRows)
        light.classes, light.width = self.classes, self.width
        return light

    def histograms(self, model: Boosted, r: int, level: int, side: np.ndarray | None) -> np.ndarray:
        if r and not level:
            self._keep(model, r)
        load, bins = self._light()._load, model.bins + 1
        shape = (2, self.classes, 2 ** max(0, level - 1), self.width, bins)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros(shape)
            for b in batches:
                rows = load(b)
                rows.start(model, r)
                for above in range(level):
                    rows.move(model, r, above)
                total += rows.sums(level, bins, side)
            yield batch(sums=pa.array([total.tobytes()], pa.binary()))

        parts = (self.rows if self.scored is None else self.scored).mapInArrow(run, "sums binary").rdd
        return parts.map(lambda x: np.frombuffer(x[0])).treeReduce(np.add).reshape(shape)

    def close(self) -> None:
        if self.scored is not None:
            self.scored.unpersist()


@dataclass
class Boosted:
    """Softmax boosting with second-order splits and temperature-and-bias calibration."""

    rounds: int = 50
    depth: int = 4
    rate: float = 0.2
    bins: int = 48
    ridge: float = 1.0
    least: float = 2.0
    edges: list[np.ndarray] = field(default_factory=list)
    prior: np.ndarray | None = None
    feature: np.ndarray | None = None
    cut: np.ndarray | None = None
    value: np.ndarray | None = None
    scale: np.ndarray | None = None
    shift: np.ndarray | None = None

    def binned(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, f], side="right") for f, e in enumerate(self.edges)], axis=1).astype(np.uint8)

    def _shares(self) -> np.ndarray:
        return np.linspace(0, 1, self.bins + 1)[1:-1]

    def cuts(self, counted: list[tuple[np.ndarray, np.ndarray]]) -> "Boosted":
        """Bins from the counts (keys of ``grid_keys``, rows) of each column over all rows."""
        self.edges = []
        for keys, n in counted:
            order = np.argsort(keys)
            until = n[order].cumsum()
            self.edges.append(np.unique(grid_values(keys[order][np.searchsorted(until, self._shares() * until[-1], side="right")])))
        return self

    def fit(self, x: np.ndarray, y: np.ndarray, classes: int, weight: np.ndarray | None = None) -> "Boosted":
        self.edges = [np.unique(np.quantile(x[:, f], self._shares())) for f in range(x.shape[1])]
        return self.grow(Rows(self.binned(x), y, classes, weight))

    def grow(self, rows: Rows | JobRows) -> "Boosted":
        """Grow the trees; those of a round at once, a child's sums are its parent's without its sibling's."""
        totals, bins, depth = rows.totals(), self.bins + 1, self.depth
        classes, width = len(totals), len(self.edges)
        self.prior = np.log(np.maximum(totals, 1e-3) / totals.sum())
        trees, inner, leaves = self.rounds * classes, 2**depth - 1, 2**depth
        self.feature = np.zeros((trees, inner), np.int32)
        self.cut = np.full((trees, inner), bins + 1, np.int32)
        self.value = np.zeros((trees, leaves))
        for r in range(self.rounds):
            tree = np.arange(r * classes, (r + 1) * classes)[:, None]
            side = parents = None
            for level in range(depth):
                wide = 2**level
                sums = rows.histograms(self, r, level, side)
                if level:
                    chosen = side[None, :, :, None, None].astype(bool)
                    sums = np.stack([np.where(chosen, parents - sums, sums), np.where(chosen, sums, parents - sums)], axis=3).reshape(2, classes, wide, width, bins)
                parents = sums
                below = sums.cumsum(4)[..., :-1]
                total = sums.sum(4, keepdims=True)
                (gl, hl), (gt, ht) = below, total
                gain = gl**2 / (hl + self.ridge) + (gt - gl) ** 2 / (ht - hl + self.ridge) - gt**2 / (ht + self.ridge)
                gain[(hl < self.least / 8) | (ht - hl < self.least / 8)] = -1
                # in single precision, so that splits that are equal but for the order of the sums count as equal
                gain = gain.reshape(classes, wide, -1).astype(np.float32)
                best = gain.argmax(2)
                f, c = best // (bins - 1), best % (bins - 1)
                split = gain.max(2) > 1e-6
                at = np.arange(wide) + wide - 1
                self.feature[tree, at] = f
                self.cut[tree, at] = np.where(split, c, bins + 1)
                whole = total[:, np.arange(classes)[:, None], np.arange(wide), f, 0]
                left = np.where(split, np.take_along_axis(below.reshape(2, classes, wide, -1), best[None, ..., None], 3)[..., 0], whole)
                right = whole - left
                side = (left[1] > right[1]).astype(np.int64)
            g, h = np.stack([left, right], axis=3).reshape(2, classes, leaves)
            self.value[tree[:, 0]] = -self.rate * g / (h + self.ridge)
        rows.close()
        self.scale, self.shift = np.ones(1), np.zeros(classes)
        return self

    def raw(self, x: np.ndarray) -> np.ndarray:
        b = self.binned(x)
        n, classes = len(x), len(self.prior)
        score, rows = np.tile(self.prior, (n, 1)), np.arange(n)
        for tree in range(len(self.feature)):
            node = np.zeros(n, np.int64)
            for level in range(self.depth):
                at = node + 2**level - 1
                node = 2 * node + (b[rows, self.feature[tree][at]] > self.cut[tree][at])
            score[:, tree % classes] += self.value[tree][node]
        return score

    def calibrate(self, x: np.ndarray, y: np.ndarray, steps: int = 400) -> "Boosted":
        return self.calibrate_raw(self.raw(x), y, steps)

    def calibrate_raw(self, raw: np.ndarray, y: np.ndarray, steps: int = 400) -> "Boosted":
        """Temperature and class shifts that minimise the log loss on the hand-checked rows, from their raw scores."""
        hot = np.zeros_like(raw)
        hot[np.arange(len(y)), y] = 1
        t, shift = 1.0, np.zeros(raw.shape[1])
        for _ in range(steps):
            z = raw * t + shift
            p = np.exp(z - z.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            d = p - hot
            t = min(3.0, max(0.2, t - 0.02 * float((d * raw).sum(1).mean())))
            shift = shift - 0.1 * (d.mean(0) + 0.002 * shift)
        self.scale, self.shift = np.array([t]), shift
        return self

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        if not len(x):
            return np.zeros((0, len(self.prior)))
        z = self.raw(x) * self.scale + self.shift
        p = np.exp(z - z.max(1, keepdims=True))
        return p / p.sum(1, keepdims=True)
