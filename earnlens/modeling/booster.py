"""Multi-quantile gradient boosting with the pinball loss (MOD-01).

MLlib's GBT only has squared/absolute loss, so each round is assembled from
distributed pieces:

1. negative pinball gradient g = alpha - 1[y <= f] on every row;
2. a ``DecisionTreeRegressor`` (depth-limited, binned, tree-aggregated) fit
   on a seeded ``subsample`` of the rows and a seeded ``colsample`` of the
   features, with ``leafCol`` exposing each row's leaf;
3. the leaf value is the alpha-quantile of the residual y - f among the
   leaf's rows (``percentile_approx``, one aggregate over <= 2^depth
   groups), shrunk by n / (n + lambda);
4. f += step * value[leaf].

Above ``SINGLE_ROWS`` rows, those equal in all features are kept together as
units with the array of their labels: they share f, whatever the trees. The
learner gets a unit's sampled rows as one that weighs as many, with their mean
gradient; a variance split depends on no more than that. How many of its rows
up to f and above f are sampled is drawn from the binomial distributions that
sampling them one by one has. Leaf values are still taken over all rows.

A fitted tree is kept as its splits, and a head is scored as ONE column
expression over them: no assembler and no model stage per tree.

Lineage grows by one tree per round, so the working frame is checkpointed
to the shared ``spark.checkpoint.dir`` every ``checkpoint_every`` rounds
(reliable checkpoints survive executor loss; never local ones). Units are
written there as Parquet instead: small and fast to read again.
"""

from __future__ import annotations

import json
import posixpath
import random
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import DecisionTreeRegressor
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from earnlens.modeling.search import SINGLE_ROWS, WEIGHT
from earnlens.session import checkpoint_dir

#: Rows of a unit, about, at most.
UNIT_ROWS = 1024


@dataclass
class _Tree:
    """``root``: a leaf's value, or [feature, threshold, left, right]; a value
    up to the threshold goes left, a larger or missing one right."""
    root: list | float

    def column(self) -> Column:
        return _descend(self.root)


def _descend(node) -> Column:
    if not isinstance(node, list):
        return F.lit(float(node))
    feature, threshold, left, right = node
    return F.when(F.col(feature) <= F.lit(float(threshold)), _descend(left)).otherwise(_descend(right))


def _splits(node, features: list[str], leaves: list):
    """The splits of an MLlib tree; leaf i of ``leaves`` (its number) from the left."""
    if node.subtreeDepth() == 0:
        leaves.append(len(leaves))
        return leaves[-1]
    split = node.split()
    left = _splits(node.leftChild(), features, leaves)
    return [features[split.featureIndex()], split.threshold(), left,
            _splits(node.rightChild(), features, leaves)]


def _with_values(node, values: dict[int, float]):
    if not isinstance(node, list):
        return values.get(int(node), 0.0)
    return [*node[:2], _with_values(node[2], values), _with_values(node[3], values)]


def _total(cols: list[Column]) -> Column:
    """The sum, halved recursively: its depth grows with log(n)."""
    if len(cols) == 1:
        return cols[0]
    return _total(cols[:len(cols) // 2]) + _total(cols[len(cols) // 2:])


@dataclass
class QuantileHead:
    alpha: float
    base: float
    step: float
    trees: list[_Tree] = field(default_factory=list)


class QuantileBooster:
    """``fit(df)`` -> ``QuantileBoosterModel``; label column is the target
    in model space (log1p income), features a list of numeric columns."""

    def __init__(self, features: list[str], label: str = "label", alphas=(0.1, 0.5, 0.9),
                 rounds: int = 169, max_depth: int = 3, step: float = 0.045,
                 subsample: float = 0.741, colsample: float = 0.829, reg_lambda: float = 9.88,
                 max_bins: int = 32, seed: int = 42, checkpoint_every: int = 10,
                 single_rows: int = SINGLE_ROWS):
        self.features, self.label, self.alphas = list(features), label, tuple(alphas)
        self.rounds, self.max_depth, self.step = rounds, max_depth, step
        self.subsample, self.colsample, self.reg_lambda = subsample, colsample, reg_lambda
        self.max_bins, self.seed, self.checkpoint_every = max_bins, seed, checkpoint_every
        self.single_rows = single_rows

    def fit(self, df: DataFrame) -> "QuantileBoosterModel":
        checkpoint_dir(df.sparkSession)
        work = df.select(*self.features, F.col(self.label).cast("double").alias("_y"))
        work = work.checkpoint(eager=True)
        many = work.count() > self.single_rows
        bases = work.agg(*[F.percentile_approx("_y", a, 100000) for a in self.alphas]).first()
        if many:
            work = _written(_units(work, self.features))
        # the heads are independent: fit them as concurrent Spark jobs
        from concurrent.futures import ThreadPoolExecutor
        with ThreadPoolExecutor(max_workers=len(self.alphas)) as ex:
            heads = list(ex.map(lambda a, b: self._fit_head(work, a, float(b), many), self.alphas, bases))
        return QuantileBoosterModel(self.features, heads)

    def _fit_head(self, work: DataFrame, alpha: float, base: float, many: bool) -> QuantileHead:
        rng = random.Random(f"{self.seed}|{alpha}")
        head = QuantileHead(alpha, base, self.step)
        cur = work.withColumn("_f", F.lit(base))
        k = max(1, int(round(self.colsample * len(self.features))))
        for r in range(self.rounds):
            feats = sorted(rng.sample(self.features, k), key=self.features.index)
            draw = rng.randrange(1 << 30) if self.subsample < 1.0 else 0
            points = (_unit_gradients if many else _gradients)(cur, alpha, self.subsample, draw)
            if many:  # the learner makes several passes
                points = points.persist()
            asm = VectorAssembler(inputCols=feats, outputCol="_x", handleInvalid="keep")
            tree = DecisionTreeRegressor(featuresCol="_x", labelCol="_g", weightCol=WEIGHT, maxDepth=self.max_depth,
                                         maxBins=self.max_bins, seed=rng.randrange(1 << 30)).fit(
                asm.transform(points))
            if many:
                points.unpersist()
            root = _splits(tree._call_java("rootNode"), feats, [])
            rows = cur.select(_Tree(root).column().cast("int").alias("_leaf"), "_f", "_ys" if many else "_y")
            if many:
                rows = rows.select("_leaf", "_f", F.explode("_ys").alias("_y"))
            vals = rows.groupBy("_leaf").agg(
                F.percentile_approx(F.col("_y") - F.col("_f"), alpha, 10000).alias("q"),
                F.count("*").alias("n")).collect()          # <= 2^depth rows
            lv = {v["_leaf"]: float(v["q"]) * v["n"] / (v["n"] + self.reg_lambda) for v in vals}
            head.trees.append(_Tree(_with_values(root, lv)))
            cur = cur.withColumn("_f", F.col("_f") + F.lit(self.step) * head.trees[-1].column())
            if (r + 1) % self.checkpoint_every == 0 and r + 1 < self.rounds:
                cur = _written(cur) if many else cur.checkpoint(eager=True)
        return head


def _gradients(rows: DataFrame, alpha: float, subsample: float, seed: int) -> DataFrame:
    """The sampled rows with ``_g``, their negative pinball gradient, and ``_weight`` 1."""
    rows = rows.sample(False, subsample, seed=seed) if subsample < 1.0 else rows
    return rows.withColumns({"_g": F.lit(alpha) - (F.col("_y") <= F.col("_f")).cast("double"), WEIGHT: F.lit(1.0)})


def _unit_gradients(units: DataFrame, alpha: float, subsample: float, seed: int) -> DataFrame:
    """Units with sampled rows: ``_weight``, how many, and ``_g``, their mean negative pinball gradient."""
    @F.pandas_udf("below double, above double")
    def drawn(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        rng = np.random.default_rng([seed, TaskContext.get().partitionId()])
        for ys, f in batches:
            n = ys.map(len).to_numpy("int64")
            unit = np.repeat(np.arange(len(n)), n)
            reached = np.concatenate(ys.to_list()) <= f.to_numpy("float64")[unit]
            below = np.bincount(unit[reached], minlength=len(n))
            counts = [below, n - below]
            if subsample < 1.0:
                counts = [rng.binomial(c, subsample) for c in counts]
            yield pd.DataFrame({"below": counts[0].astype("float64"), "above": counts[1].astype("float64")})

    seen = units.withColumn("_seen", drawn.asNondeterministic()("_ys", "_f")).drop("_ys")
    weight = F.col("_seen.below") + F.col("_seen.above")
    return seen.withColumn(WEIGHT, weight).where(F.col(WEIGHT) > 0).withColumn(
        "_g", F.lit(alpha) - F.col("_seen.below") / F.col(WEIGHT))


def _units(rows: DataFrame, features: list[str], most: int = UNIT_ROWS) -> DataFrame:
    """``features, _ys``: rows equal in all features with the array of their
    labels. More than ``most`` of them make several units: they are dealt out
    by their number, so no group and no array grows with a frequent value."""
    rows = rows.withColumn("_key", F.xxhash64(*features))
    often = rows.groupBy("_key").agg(F.ceil(F.count("*") / most).alias("_parts")).where("_parts > 1")
    rows = rows.withColumn("_id", F.monotonically_increasing_id()).join(often, "_key", "left")
    part = F.coalesce(F.pmod(F.xxhash64("_id"), F.col("_parts")), F.lit(0))
    label = F.coalesce("_y", F.raise_error(F.lit("a label is null")).cast("double"))
    return rows.groupBy(*features, part.alias("_part")).agg(F.collect_list(label).alias("_ys")).drop("_part")


def _written(df: DataFrame) -> DataFrame:
    """``df`` as Parquet in the shared checkpoint folder."""
    path = posixpath.join(checkpoint_dir(df.sparkSession), "booster", uuid.uuid4().hex)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


class QuantileBoosterModel:
    def __init__(self, features: list[str], heads: list[QuantileHead]):
        self.features, self.heads = features, heads

    def transform(self, df: DataFrame, prefix: str = "q") -> DataFrame:
        """Adds one column per head (model space): ``q10``, ``q50``, ``q90``."""
        heads = {}
        for h in self.heads:
            grown = F.lit(h.step) * _total([t.column() for t in h.trees]) if h.trees else F.lit(0.0)
            heads[f"{prefix}{int(round(h.alpha * 100))}"] = F.lit(h.base) + grown
        return df.withColumns(heads)

    def save(self, path: str) -> None:
        """SNK-03: one JSON document with all splits and leaf values; it holds
        no path, so a model can be moved."""
        man = {"features": self.features, "heads": [
            {"alpha": h.alpha, "base": h.base, "step": h.step, "trees": [t.root for t in h.trees]}
            for h in self.heads]}
        spark_write_text(path, json.dumps(man))

    @staticmethod
    def load(spark, path: str) -> "QuantileBoosterModel":
        man = json.loads(spark.read.text(path + "/manifest").first()[0])
        heads = [QuantileHead(h["alpha"], h["base"], h["step"], [_Tree(t) for t in h["trees"]])
                 for h in man["heads"]]
        return QuantileBoosterModel(man["features"], heads)


def spark_write_text(path: str, text: str) -> None:
    from pyspark.sql import SparkSession
    spark = SparkSession.getActiveSession()
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(
        path + "/manifest")
