"""Explanations (EXP-01..04) as Spark jobs."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from earnlens.functions.hashing import hash_rank_key, hash_unit
from earnlens.modeling.search import same_features
from earnlens.modeling.tree_tables import MOST_TESTS, TreeTables, hash_int, hash_long
from earnlens.operators import evaluate as ev
from earnlens.session import written


def feature_importance(model, features: list[str]) -> DataFrame:
    """EXP-01: the tree ensemble's split-gain importances, sorted."""
    tree = model.stages[-1] if hasattr(model, "stages") else model
    imp = tree.featureImportances.toArray().tolist()
    spark = SparkSession.getActiveSession()
    return spark.createDataFrame(list(zip(features, [float(x) for x in imp])),
                                 "feature string, importance double").orderBy(F.desc("importance"))


#: Rows of a bucket, inside which columns are permuted, and rows whose buckets a task takes at once.
BUCKET_ROWS, ROWS_AT_ONCE = 512, 50_000


def permuted_copies(df: DataFrame, features: list[str], key: str, repeats: int, seed: int,
                    buckets: int | None = None) -> DataFrame:
    """A copy of ``df`` per (``_feature``, ``_repeat``), in it that feature
    replaced by a seeded permutation of itself. Rows are dealt once into random
    buckets (of ``BUCKET_ROWS`` rows, about) and permuted inside each, so no
    task sees a whole column. A bucket is one array; its copies are made from
    it where it lies, one after the other, and no copy is shuffled or sorted on disk."""
    x = _dealt(df, seed, buckets).groupBy("_pb").agg(F.sort_array(F.collect_list(F.struct(
        F.xxhash64(*df.columns, F.lit(seed)).alias("_at"), F.struct(*df.columns).alias("_row")))).alias("_rows"))
    x = x.withColumn("_c", F.explode(F.sequence(F.lit(0), F.lit(len(features) * repeats - 1))))
    x = x.withColumn("_f", F.element_at(F.array(*[F.lit(f) for f in features]), F.floor(F.col("_c") / repeats).cast("int") + 1))
    # the places of the rows in an order of the copy's own
    places = F.array_sort(F.transform("_rows", lambda r, i: F.struct(
        F.xxhash64(r["_at"], F.col("_c"), F.lit(seed + 1)).alias("h"), i.alias("i"))))
    x = x.withColumn("_places", places).select("_c", "_f", "_rows", F.posexplode("_places").alias("_i", "_from"))
    own, other = F.get("_rows", F.col("_i"))["_row"], F.get("_rows", F.col("_from")["i"])["_row"]
    x = x.select("_c", "_f", own.alias("_own"), other.alias("_other"))
    return x.select(
        *[F.when(F.col("_f") == c, F.col("_other")[c]).otherwise(F.col("_own")[c]).alias(c)
          if c in features else F.col("_own")[c].alias(c) for c in df.columns],
        F.col("_f").alias("_feature"), (F.col("_c") % repeats).alias("_repeat"))


def _dealt(df: DataFrame, seed: int, buckets: int | None = None) -> DataFrame:
    """``df`` with ``_pb``, the bucket of a row, dealt out by it."""
    if buckets is None:
        buckets = max(1, math.ceil(df.count() / BUCKET_ROWS))
    # all columns decide the bucket: rows of one key, or of none, are spread too
    x = df.withColumn("_pb", F.pmod(F.xxhash64(*df.columns, F.lit(seed)), F.lit(buckets)))
    return x.repartition(min(buckets, 2048), "_pb")


def _copies_errors(tables: TreeTables, masks, df: DataFrame, features: list[str], label: str, repeats: int, seed: int) -> DataFrame:
    """``_feature, _repeat, _sse``: the summed squared errors of the copies that
    :func:`permuted_copies` makes, with the same draws. A copy's row differs from
    its own in one feature, so a task finds what a row scores at each bin of
    that feature, and every row of every copy looks its score up."""
    x = _dealt(df, seed).select("_pb", F.xxhash64(*df.columns, F.lit(seed)).alias("_at"), F.col(label).cast("double").alias("_y"),
                                *[F.col(f).cast("double").alias(f) for f in tables.features])

    def errors(whole: pd.DataFrame) -> pd.DataFrame:
        bins, y, at = tables.bins(whole), whole["_y"].to_numpy("float64"), hash_long(whole["_at"].to_numpy())
        met, cell = np.unique(bins, axis=0, return_inverse=True)
        cell = cell.ravel()
        ends = np.append(np.flatnonzero(np.diff(whole["_pb"].to_numpy())) + 1, len(whole))
        sums = np.zeros((len(features), repeats))
        for n, f in enumerate(features):
            i = tables.features.index(f)
            scores = tables.replaced(masks, met, i)
            copies, start = np.arange(n * repeats, (n + 1) * repeats)[:, None], 0
            for end in ends:
                drawn = hash_int(seed + 1, hash_int(copies, at[None, start:end])).view("int64")
                others = np.argsort(drawn, axis=1, kind="stable")
                found = scores[cell[None, start:end], bins[start:end, i][others]]
                sums[n] += np.nansum((y[None, start:end] - found) ** 2, axis=1)
                start = end
        return pd.DataFrame({"_feature": np.repeat(features, repeats), "_repeat": np.tile(np.arange(repeats), len(features)), "_sse": sums.ravel()})

    def of_task(batches):
        kept = []  # whole buckets, and the rows so far of the last one
        for b in batches:
            kept.append(b)
            if sum(map(len, kept)) >= ROWS_AT_ONCE:
                rows = pd.concat(kept)
                last = rows["_pb"].to_numpy() == rows["_pb"].iloc[-1]
                kept = [rows[last]]
                if not last.all():
                    yield errors(rows[~last])
        if kept:
            yield errors(pd.concat(kept))

    x = x.sortWithinPartitions("_pb", "_at").mapInPandas(of_task, "_feature string, _repeat int, _sse double")
    return x.groupBy("_feature", "_repeat").agg(F.sum("_sse").alias("_sse"))


def permuted(df: DataFrame, col: str, key: str, seed: int, buckets: int | None = None) -> DataFrame:
    """``df`` with the numeric ``col`` replaced by a seeded permutation of itself."""
    return permuted_copies(df, [col], key, 1, seed, buckets).drop("_feature", "_repeat")


def permutation_importance(model, df: DataFrame, features: list[str], key: str,
                           label: str = "annual_income", prediction: str = "prediction",
                           repeats: int = 50, seed: int = 42) -> DataFrame:
    """EXP-02: mean and std of the R2 drop when one feature is permuted.
    All (feature, repeat) copies are scored: of regression trees in arrays, of
    other models in one transform."""
    tables = TreeTables.of(model, prediction)
    masks = tables.masks() if tables and set(features) <= set(tables.features) else None
    base = ev.point_metrics(model.transform(df), label, prediction).select(
        F.col("r2").alias("base_r2"), F.lit(0).alias("_k"))
    rows = df.select(*dict.fromkeys([key, *features, label]))
    if masks is None or set(tables.features) - set(rows.columns):
        per = ev.point_metrics(model.transform(permuted_copies(rows, features, key, repeats, seed)), label, prediction, ["_feature", "_repeat"])
    else:  # the labels' spread is that of every copy
        spread = df.agg((F.var_pop(label) * F.count("*")).alias("_sst"))
        per = _copies_errors(tables, masks, rows, features, label, repeats, seed).join(F.broadcast(spread))
        per = per.select("_feature", "_repeat", (1 - F.col("_sse") / F.col("_sst")).alias("r2"))
    per = per.withColumn("_k", F.lit(0)).join(F.broadcast(base), "_k")
    return per.groupBy(F.col("_feature").alias("feature")).agg(
        F.avg(F.col("base_r2") - F.col("r2")).alias("importance_mean"),
        F.stddev_pop(F.col("base_r2") - F.col("r2")).alias("importance_std")
    ).orderBy(F.desc("importance_mean"))


#: Background rows that are used; more are an error, none is dropped.
BACKGROUND_ROWS = 1000


def shapley_values(model, rows: DataFrame, background: DataFrame, features: list[str],
                   key: str, permutations: int = 8, seed: int = 42,
                   prediction: str = "prediction") -> DataFrame:
    """EXP-03: sampling Shapley values. For each explained row, ``permutations``
    seeded feature orders are drawn; for each order and each prefix length
    the hybrid point (row values for features in the prefix, a background
    row's values otherwise, for each distinct background row) is scored in ONE ``transform``; the attribution
    of a feature is the mean jump when it joins the prefix. Output: key,
    feature, value, attribution (rows x features).

    Of regression trees the values are exact: the mean over all orders and over
    every background row, however many, without a model call for a point."""
    tables = TreeTables.of(model, prediction)
    tests = tables.tests() if tables and tables.features == list(features) else None
    if tests is not None:
        return _tree_shapley(tables, tests, rows, background, key)
    d = len(features)
    bg = background.select(*[F.col(f).alias(f"_bg_{f}") for f in features])
    if bg.limit(BACKGROUND_ROWS + 1).count() > BACKGROUND_ROWS:
        raise ValueError(f"more than {BACKGROUND_ROWS} background rows: sample them first")
    # every background row counts; their number is checked, so they are broadcast
    bg = bg.withColumns({"_k": F.lit(0), "_b": F.xxhash64(*bg.columns)}).dropDuplicates(["_b"])
    x = rows.select(key, *features).withColumn("_k", F.lit(0)).join(F.broadcast(bg), "_k").drop("_k")
    x = x.withColumn("_perm", F.explode(F.sequence(F.lit(0), F.lit(permutations - 1))))
    # rank of each feature inside this row's permutation
    for i, f in enumerate(features):
        x = x.withColumn(f"_o_{f}", hash_rank_key(F.concat_ws("|", F.col(key).cast("string"),
                                                              F.col("_perm").cast("string"),
                                                              F.lit(f)), seed))
    ranks = F.array(*[F.col(f"_o_{f}") for f in features])
    x = x.withColumn("_pos", F.explode(F.sequence(F.lit(0), F.lit(d))))
    # feature f is "in" the prefix when fewer than _pos features precede it
    def earlier(f):
        return lambda r: r < F.col(f"_o_{f}")
    for f in features:
        before = F.size(F.filter(ranks, earlier(f)))
        x = x.withColumn(f"_in_{f}", before < F.col("_pos"))
    hyb = x.select(key, "_perm", "_b", "_pos", *[F.col(f"_o_{f}") for f in features],
                   *[F.col(f"_in_{f}") for f in features],
                   *[F.when(F.col(f"_in_{f}"), F.col(f)).otherwise(F.col(f"_bg_{f}")).alias(f)
                     for f in features])
    scored = model.transform(hyb).select(key, "_perm", "_b", "_pos", prediction,
                                         *[f"_o_{f}" for f in features])
    w = Window.partitionBy(key, "_perm", "_b").orderBy("_pos")
    scored = scored.withColumn("_jump", F.col(prediction) - F.lag(prediction).over(w))
    # the feature that joined at step _pos is the one with exactly _pos-1 before it
    ranks2 = F.array(*[F.col(f"_o_{f}") for f in features])
    joined = F.get(F.array_sort(ranks2), F.col("_pos") - 1)   # 0-based, null when out of range
    pick = F.coalesce(*[F.when(F.col(f"_o_{f}") == joined, F.lit(f)) for f in features])
    att = scored.where(F.col("_pos") > 0).withColumn("feature", pick)
    att = att.groupBy(key, "feature").agg(F.avg("_jump").alias("attribution"))
    vals = rows.select(key, F.explode(F.array(*[F.struct(F.lit(f).alias("feature"),
                                                         F.col(f).cast("double").alias("value"))
                                                for f in features])).alias("_v")
                       ).select(key, "_v.feature", "_v.value")
    return att.join(vals, [key, "feature"])


def _tree_shapley(tables: TreeTables, tests: list[np.ndarray], rows: DataFrame, background: DataFrame, key: str) -> DataFrame:
    """Exact Shapley values. What background rows pass of each leaf's tests is
    one small table; rows equal in all features are explained once."""
    features, wide = tables.features, 1 << MOST_TESTS
    numbers = [F.col(f).cast("double").alias(f) for f in features]

    def passing(batches):
        total, at = np.zeros(len(tables.leaves) * wide), np.arange(len(tables.leaves)) * wide
        for b in batches:
            for i in range(0, len(b), 1024):
                part = b.iloc[i:i + 1024]
                met = TreeTables.passed(tests, tables.bins(part)) + at
                total += np.bincount(met.ravel(), np.repeat(part["n"].to_numpy("float64"), len(at)), len(total))
        found = np.flatnonzero(total)
        yield pd.DataFrame({"at": found, "n": total[found]})

    back = background.select(*numbers).groupBy(*features).agg(F.count("*").alias("n"))
    back = back.mapInPandas(passing, "at long, n double").groupBy("at").agg(F.sum("n").alias("n")).toArrow()
    if not back.num_rows:
        return rows.select(key, F.lit(None).cast("string").alias("feature"), F.lit(0.0).alias("attribution"), F.lit(0.0).alias("value")).limit(0)
    shares = np.zeros((len(tables.leaves), wide))
    shares.ravel()[back["at"].to_numpy()] = back["n"].to_numpy()
    values = tables.attributions(shares / shares[0].sum())

    def explain(batches):
        for b in batches:
            out = np.zeros((len(b), len(features)))
            for i in range(0, len(b), 1024):
                met = TreeTables.passed(tests, tables.bins(b.iloc[i:i + 1024]))
                for j, (leaves, own) in enumerate(values):
                    if len(leaves):
                        out[i:i + 1024, j] = own[np.arange(len(leaves)), met[:, leaves]].sum(axis=1)
            yield b.assign(_values=[*out])

    kinds = ", ".join(f"`{f}` double" for f in features)
    cells = rows.select(*numbers).distinct().mapInPandas(explain, f"{kinds}, _values array<double>")
    of_rows = same_features(rows.select(F.col(key).alias("_key"), *numbers), written(cells), features)
    each = F.explode(F.array(*[F.struct(F.lit(f).alias("feature"), F.element_at("_values", i + 1).alias("attribution"),
                                        F.col(f).alias("value")) for i, f in enumerate(features)]))
    return of_rows.select(F.col("_key").alias(key), each.alias("_v")).select(key, "_v.feature", "_v.attribution", "_v.value")


def mean_abs_attribution(shap: DataFrame) -> DataFrame:
    """EXP-03 summary: mean |attribution| per feature, sorted."""
    return shap.groupBy("feature").agg(F.avg(F.abs("attribution")).alias("mean_abs")).orderBy(
        F.desc("mean_abs"))
