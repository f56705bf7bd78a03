"""Regression trees of Spark ML as arrays, for explanations that ask a model for
far more points than there are rows.

A tree only compares features with its thresholds, so a row is known to it by
the interval (``bin``) of each feature, and a leaf is a box of bins. Sums over
all boxes answer what would else take a model call for each point; a missing
value goes right everywhere, as in Spark.
"""

from __future__ import annotations

import math
import re

import numpy as np
import pandas as pd
from pyspark.ml import PipelineModel
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import DecisionTreeRegressionModel, GBTRegressionModel, RandomForestRegressionModel

#: Features of one leaf's path and leaves of one tree that the arrays take.
MOST_TESTS, MOST_LEAVES = 8, 64
_TREE = re.compile(r"Tree \d+ \(weight (\S+)\):")
_TEST = re.compile(r"(If|Else) \(feature (\d+) (<=|>) (\S+)\)")


class TreeTables:
    """``leaves``: (tree, value, {feature number: (low, high)}), the thresholds
    between which a row's feature lies; a tree's weight is in its values."""

    def __init__(self, features: list[str], leaves: list[tuple[int, float, dict]]):
        self.features, self.trees = features, max(t for t, *_ in leaves) + 1
        cuts = [sorted({c for *_, box in leaves for c in box.get(i, ()) if math.isfinite(c)}) for i in range(len(features))]
        self.cuts = [np.array(c) for c in cuts]
        place = [{c: n for n, c in enumerate(own)} for own in cuts]
        # bins low + 1 .. high of a feature are inside the box
        self.leaves = [(t, v, {i: (place[i][lo] + 1 if lo > -math.inf else 0, place[i][hi] if hi < math.inf else len(cuts[i]))
                               for i, (lo, hi) in box.items()}) for t, v, box in leaves]

    @staticmethod
    def of(model, prediction: str) -> "TreeTables | None":
        """The tables of an assembler and regression trees on it; None of any other model."""
        if not isinstance(model, PipelineModel) or len(model.stages) != 2 or not isinstance(model.stages[0], VectorAssembler):
            return None
        asm, trees = model.stages
        if not isinstance(trees, (RandomForestRegressionModel, GBTRegressionModel, DecisionTreeRegressionModel)) or (
                trees.getPredictionCol() != prediction or trees.getFeaturesCol() != asm.getOutputCol() or asm.getHandleInvalid() != "keep"):
            return None
        leaves, box, tree = [], [], 0 if isinstance(trees, DecisionTreeRegressionModel) else -1
        weight, share = 1.0, 1.0 / trees.getNumTrees if isinstance(trees, RandomForestRegressionModel) else 1.0
        for line in trees.toDebugString.splitlines()[1:]:
            if found := _TREE.search(line):
                tree, weight, box = tree + 1, float(found[1]), []
            elif found := _TEST.search(line):
                depth = (len(line) - len(line.lstrip()))
                box = [b for b in box if b[0] < depth] + [(depth, int(found[2]), found[3], float(found[4]))]
            elif "Predict: " in line:
                depth = (len(line) - len(line.lstrip()))
                sides: dict = {}
                for _, i, side, cut in (b for b in box if b[0] < depth):
                    lo, hi = sides.get(i, (-math.inf, math.inf))
                    sides[i] = (lo, min(hi, cut)) if side == "<=" else (max(lo, cut), hi)
                leaves.append((tree, float(line.split("Predict: ")[1]) * weight * share, sides))
            elif line.strip():
                return None  # a test of another kind
        return TreeTables(list(asm.getInputCols()), leaves)

    def bins(self, df: pd.DataFrame) -> np.ndarray:
        """Rows x features: up to the first threshold is bin 0."""
        return np.stack([np.searchsorted(c, df[f].to_numpy("float64"), "left") for f, c in zip(self.features, self.cuts)], axis=1)

    # ------------------------------------------------------- replaced features
    def masks(self) -> list[np.ndarray] | None:
        """Per feature, trees x bins: the leaves (bits) that allow the bin; None if a tree has too many."""
        number, seen = [], [0] * self.trees
        for t, *_ in self.leaves:
            number.append(seen[t])
            seen[t] += 1
        if max(seen) > MOST_LEAVES:
            return None
        out = [np.zeros((self.trees, len(c) + 1), "uint64") for c in self.cuts]
        self.values = np.zeros((self.trees, MOST_LEAVES))
        for n, (t, value, box) in zip(number, self.leaves):
            self.values[t, n] = value
            for i, own in enumerate(out):
                lo, hi = box.get(i, (0, own.shape[1] - 1))
                own[t, lo:hi + 1] |= np.uint64(1 << n)
        return out

    def replaced(self, masks: list[np.ndarray], bins: np.ndarray, i: int, block: int = 2048) -> np.ndarray:
        """Rows x bins of feature ``i``: the prediction if the row had that bin."""
        out, trees = np.empty((len(bins), masks[i].shape[1])), np.arange(self.trees)
        for at in range(0, len(bins), block):
            rows, left = bins[at:at + block], None
            for j, own in enumerate(masks):
                if j != i:
                    met = own.T[rows[:, j]]
                    left = met if left is None else left & met
            if left is None:
                left = np.full((len(rows), self.trees), ~np.uint64(0))
            for b in range(out.shape[1]):
                leaf = np.frexp((left & masks[i][:, b]).astype("float64"))[1] - 1  # exactly one bit is set
                out[at:at + block, b] = self.values[trees, leaf].sum(axis=1)
        return out

    # ----------------------------------------------------------------- Shapley
    def tests(self) -> list[np.ndarray] | None:
        """Per feature, bins x leaves: the bit of the leaf's test of it where the
        bin passes, else 0; None if a path has too many features."""
        if max(len(box) for *_, box in self.leaves) > MOST_TESTS:
            return None
        out = [np.zeros((len(c) + 1, len(self.leaves)), "uint8") for c in self.cuts]
        for n, (*_, box) in enumerate(self.leaves):
            for j, (i, (lo, hi)) in enumerate(sorted(box.items())):
                out[i][lo:hi + 1, n] = 1 << j
        return out

    @staticmethod
    def passed(tests: list[np.ndarray], bins: np.ndarray) -> np.ndarray:
        """Rows x leaves: which tests of the leaf (bits) the row passes."""
        out = np.zeros((len(bins), tests[0].shape[1]), "uint8")
        for i, own in enumerate(tests):
            out += own[bins[:, i]]
        return out

    def attributions(self, shares: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """Per feature the leaves that test it, and for them, by what a row
        passes, its Shapley value: the mean over all background rows and all
        orders of features. ``shares``: leaves x what background rows pass.

        A leaf counts for a set of features taken from the row (the others from
        the background row) if the set has all that only the row passes (a of
        them) and none that only the background row passes (b of them).
        """
        weigh = lambda s, r: math.factorial(s) * math.factorial(r) / math.factorial(s + r + 1)
        out = [([], []) for _ in self.features]
        for n, (_, value, box) in enumerate(self.leaves):
            k = len(box)
            every = np.arange(1 << k)
            row, back = every[:, None], every[None, :]
            counts = ((row | back) == (1 << k) - 1) * shares[n, :1 << k] * value
            of_row, of_back = [np.array([k - int(x).bit_count() for x in every])[s] for s in ((None, slice(None)), (slice(None), None))]
            gain = np.array([[weigh(a - 1, b) if a else 0.0 for b in range(k + 1)] for a in range(k + 1)])[of_row, of_back]
            loss = np.array([[weigh(a, b - 1) if b else 0.0 for b in range(k + 1)] for a in range(k + 1)])[of_row, of_back]
            for j, i in enumerate(sorted(box)):
                only_row, only_back = (back >> j & 1) == 0, (row >> j & 1) == 0
                each = (counts * np.where(only_row, gain, np.where(only_back, -loss, 0.0))).sum(axis=1)
                out[i][0].append(n)
                out[i][1].append(np.pad(each, (0, (1 << MOST_TESTS) - len(each))))
        return [(np.array(ns, "int64"), np.array(own).reshape(len(ns), 1 << MOST_TESTS)) for ns, own in out]


# Spark's xxhash64 of (long, int, int), as 64-bit numbers
_P1, _P2, _P3, _P4, _P5 = (np.uint64(x) for x in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))


def _turn(x, n: int):
    return (x << np.uint64(n)) | (x >> np.uint64(64 - n))


def _mixed(x):
    x = (x ^ (x >> np.uint64(33))) * _P2
    x = (x ^ (x >> np.uint64(29))) * _P3
    return x ^ (x >> np.uint64(32))


def hash_long(x: np.ndarray, seed: int = 42) -> np.ndarray:
    start = np.uint64(seed) + _P5 + np.uint64(8)
    return _mixed(_turn(start ^ (_turn(x.astype("int64").view("uint64") * _P2, 31) * _P1), 27) * _P1 + _P4)


def hash_int(x, before: np.ndarray) -> np.ndarray:
    """The hash goes on with an int (or a column of them)."""
    own = np.atleast_1d(np.asarray(x, "int64")).astype("int32").view("uint32").astype("uint64") * _P1
    return _mixed(_turn((before + _P5 + np.uint64(4)) ^ own, 23) * _P2 + _P3)
