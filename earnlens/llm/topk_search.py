"""Exact top-k search by inner product: ball-tree branch and bound per shard.

Vectors are dealt into shards; each shard builds a ball tree. Queries are
dealt into blocks; a block meets every shard of a lane one after another, so
that each query's kth score so far bounds the next shard. Before that, a
bounded sample of the vectors gives every query a first bound. Within a tree,
nodes are visited in the order of the upper bound q.c + |q| r, and left out
when it is below the kth score. Lanes' results are merged by a ranking.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from earnlens.llm.common import stage

#: Vectors of a shard and queries of a block (about: rows are dealt by a hash).
SHARD_ROWS, BLOCK_ROWS = 8192, 1024
#: Shards that a block meets in one task.
LANE = 16
LEAF = 256
#: Vectors in the sample that gives the first bounds.
SAMPLE_ROWS = 2048


def build_tree(ids: np.ndarray, rows: np.ndarray) -> dict[str, np.ndarray]:
    """A ball tree over float rows: permuted ids and rows, and for each node
    its range, children, centre and radius. Nodes split at the median of the
    direction between two far points."""
    order = np.argsort(ids, kind="stable")
    ids, rows = ids[order], rows[order]
    at = np.arange(len(ids))
    nodes, todo = [], [(0, len(ids), -1, 0)]
    while todo:
        a, b, parent, side = todo.pop()
        own = rows[at[a:b]]
        centre = own.mean(axis=0)
        far = ((own - centre) ** 2).sum(axis=1)
        me = len(nodes)
        nodes.append([a, b, -1, -1, centre, np.sqrt(far.max())])
        if parent >= 0:
            nodes[parent][2 + side] = me
        if b - a > LEAF and far.max() > 0:
            p = own[far.argmax()]
            q = own[((own - p) ** 2).sum(axis=1).argmax()]
            along = own @ (p - q)
            half = (b - a) // 2
            at[a:b] = at[a:b][np.argsort(along, kind="stable")]
            todo += [(a, a + half, me, 0), (a + half, b, me, 1)]
    return {"ids": ids[at], "rows": rows[at], "range": np.array([n[:4] for n in nodes], dtype=np.int64).reshape(-1, 4),
            "centre": np.array([n[4] for n in nodes]), "radius": np.array([n[5] for n in nodes])}


class Best:
    """The ``k`` best of each query of a block: by score, then smaller id."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray, bound: np.ndarray, k: int):
        self.ids, self.rows, self.k = ids, rows, k
        self.norm = np.sqrt((rows.astype(np.float64) ** 2).sum(axis=1))
        self.bound = bound.astype(np.float64).copy()  # a score that k vectors reach
        self.found: list[list[tuple[int, int]]] = [[] for _ in ids]

    def add(self, i: int, ids: np.ndarray, scores: np.ndarray) -> None:
        good = np.flatnonzero((scores >= self.bound[i]) & (ids != self.ids[i]))
        if not len(good):
            return
        best = self.found[i] + [(-int(s), int(v)) for s, v in zip(scores[good], ids[good])]
        best.sort()
        self.found[i] = best = best[:self.k]
        if len(best) == self.k:
            self.bound[i] = max(self.bound[i], -best[-1][0])

    def search(self, tree: dict[str, np.ndarray]) -> None:
        """All queries go down the tree together; at each node only those that
        it may still improve."""
        ranges, centre, radius = tree["range"], tree["centre"], tree["radius"]
        upper = self.rows @ centre.T + self.norm[:, None] * radius
        upper += 1e-6 * (1 + np.abs(upper))  # for the rounding of centres
        todo = [(0, np.arange(len(self.ids)))]
        while todo:
            node, who = todo.pop()
            who = who[upper[who, node] >= self.bound[who]]
            if not len(who):
                continue
            a, b, left, right = ranges[node]
            if left < 0:
                scores = exact_scores(self.rows[who], tree["rows"][a:b])
                for i, s in zip(who, scores):
                    self.add(i, tree["ids"][a:b], s)
            else:
                # the child of the larger bound first (on the stack: last)
                first = upper[who, left] >= upper[who, right]
                for one, other, part in ((left, right, who[first]), (right, left, who[~first])):
                    if len(part):
                        todo += [(other, part), (one, part)]


def exact_scores(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Integer inner products. Doubles are exact up to 2**53; larger values
    take integer arithmetic."""
    most = np.abs(a).max(initial=0) * np.abs(b).max(initial=0) * a.shape[1]
    if most < 2 ** 53:
        return (a @ b.T).astype(np.int64)
    return a.astype(np.int64) @ b.astype(np.int64).T


def _pack(rows: pd.DataFrame, dim: int) -> tuple[np.ndarray, np.ndarray]:
    return rows["id"].to_numpy(np.int64), np.array(rows["v"].tolist(), dtype=np.float64).reshape(len(rows), dim)


def _shard(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
    tree = build_tree(*_pack(rows, int(key[0])))
    return pd.DataFrame({"dim": [key[0]], "shard": [key[1]], **{k: [np.ascontiguousarray(v).tobytes()] for k, v in tree.items()}})


def _block(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
    ids, v = _pack(rows, int(key[0]))
    return pd.DataFrame({"dim": [key[0]], "block": [key[1]], "q_ids": [ids.tobytes()], "q_rows": [v.tobytes()]})


TREE = "dim int, shard long, ids binary, `rows` binary, `range` binary, centre binary, radius binary"


def _search(k: int):
    def tree_of(r: dict) -> dict[str, np.ndarray]:
        d = r["dim"]
        whole = lambda c, kind: np.frombuffer(r[c], dtype=kind)
        return {"ids": whole("ids", np.int64), "rows": whole("rows", np.float64).reshape(-1, d),
                "range": whole("range", np.int64).reshape(-1, 4), "centre": whole("centre", np.float64).reshape(-1, d),
                "radius": whole("radius", np.float64)}

    def result(best: Best) -> pa.RecordBatch:
        rows = [(int(q), v, -s) for q, found in zip(best.ids, best.found) for s, v in found]
        return pa.RecordBatch.from_pydict({n: pa.array([r[i] for r in rows], pa.int64())
                                           for i, n in enumerate(("query_id", "vec_id", "score"))})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, best = None, None
        for batch in batches:
            for r in (row for i in range(batch.num_rows) for row in batch.slice(i, 1).to_pylist()):
                key = (r["dim"], r["block"], r["lane"])
                if key != at:
                    if best is not None:
                        yield result(best)
                    ids = np.frombuffer(r["q_ids"], dtype=np.int64)
                    rows = np.frombuffer(r["q_rows"], dtype=np.float64).reshape(len(ids), r["dim"])
                    at, best = key, Best(ids, rows, np.full(len(ids), -np.inf), k)
                    if r["s_ids"] is not None:
                        first_bounds(best, np.frombuffer(r["s_ids"], dtype=np.int64),
                                     np.frombuffer(r["s_rows"], dtype=np.float64).reshape(-1, r["dim"]))
                best.search(tree_of(r))
        if best is not None:
            yield result(best)
    return run


def first_bounds(best: Best, ids: np.ndarray, rows: np.ndarray) -> None:
    """The kth score among the sample bounds the kth score among all."""
    scores = exact_scores(best.rows, rows).astype(np.float64)
    scores[best.ids[:, None] == ids[None, :]] = -np.inf
    if scores.shape[1] >= best.k:
        best.bound = np.partition(scores, -best.k, axis=1)[:, -best.k].astype(np.float64)


def top_k(vectors: DataFrame, queries: DataFrame, k: int, shard_rows: int = SHARD_ROWS, block_rows: int = BLOCK_ROWS,
          lane: int = LANE) -> DataFrame:
    """``vectors`` and ``queries`` (``id, v``: arrays of longs) to ``query_id,
    rank, vec_id, score``: each query's ``k`` vectors of largest inner
    product, ties to the smaller id, without the vector of its own id.

    Only vectors of a query's own length are compared with it. Null ids and
    null or empty vectors take no part; rows that repeat an id and a vector
    count once. Every vector is searched: the tree only leaves out nodes whose
    bound is below ``k`` scores found. Products must fit a long.
    """
    valid = lambda df: df.where("id is not null and size(v) > 0").select(
        "id", "v", F.size("v").alias("dim")).distinct()
    vectors, queries = stage(valid(vectors), "topk-vectors"), stage(valid(queries), "topk-queries")
    n = {r["dim"]: r["n"] for r in vectors.groupBy("dim").agg(F.count("*").alias("n")).collect()}
    m = {r["dim"]: r["n"] for r in queries.groupBy("dim").agg(F.count("*").alias("n")).collect()}
    dims = sorted(set(n) & set(m))
    parts = lambda counts, rows: F.create_map(*[F.lit(x) for d in dims for x in (d, -(-counts[d] // rows))])[F.col("dim")]
    none = vectors.sparkSession.createDataFrame([], "query_id long, `rank` int, vec_id long, score long")
    if not dims:
        return none
    h = F.xxhash64("id")
    shards = vectors.where(F.col("dim").isin(dims)).groupBy("dim", F.pmod(h, parts(n, shard_rows)).alias("shard")) \
        .applyInPandas(_shard, TREE)
    shards = stage(shards, "topk-shards")
    blocks = queries.where(F.col("dim").isin(dims)).groupBy("dim", F.pmod(h, parts(m, block_rows)).alias("block")) \
        .applyInPandas(_block, "dim int, block long, q_ids binary, q_rows binary")
    rate = F.least(F.lit(1.0), F.lit(float(SAMPLE_ROWS)) / parts(n, 1))
    sample = vectors.where(F.col("dim").isin(dims)).where(F.pmod(F.xxhash64(F.lit(1), "id"), F.lit(1 << 20)) < rate * (1 << 20))
    sample = sample.groupBy("dim", F.lit(0).alias("block")).applyInPandas(
        _block, "dim int, block long, q_ids binary, q_rows binary").select(
        "dim", F.col("q_ids").alias("s_ids"), F.col("q_rows").alias("s_rows"))
    # one bounded row for each length of vectors
    blocks = stage(blocks.join(sample, "dim", "left"), "topk-blocks")
    # each shard goes to every block of queries: queries against all rows, in blocks
    met = shards.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), parts(m, block_rows).cast("long") - 1)))
    met = met.withColumn("lane", F.floor(F.col("shard") / lane)).join(blocks, ["dim", "block"])
    met = met.repartition("dim", "block", "lane").sortWithinPartitions("dim", "block", "lane", "shard")
    found = met.mapInArrow(_search(k), "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.distinct().withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select(
        "query_id", "rank", "vec_id", "score")
