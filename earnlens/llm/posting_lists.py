"""Approximate nearest neighbours over balanced posting lists.

A bounded sample is halved again and again into equal parts; the centres of
the parts are the lists' centroids, so that lists hold about as many vectors
each. The centroids are linked to a graph, which is small and held in memory,
and searched from a few entries with a beam. Every vector goes to the list
of its nearest centroid and, near a boundary, to further ones: those up to a
ratio of that distance, unless their centroid lies close to that of a list it
already has. A query searches all lists up to a ratio of its nearest
centroid's distance, and distances there are exact. The ratio is the one that
a bounded number of queries, compared with all vectors, need for the recall
that is asked for.

Equal vectors count by their smallest ids only, as no query can return more;
lists are dealt into segments of bounded rows and their queries into blocks,
so that no task depends on how many vectors or queries a list draws. A task
goes through its segments in order and carries each query's best along, so
that it passes on no more than those and skips what their last one excludes.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from earnlens.llm.common import releasing, stage

#: Vectors that the centroids are fitted to, at most (rows of least hash), and
#: lists, at most. Below that the lists, and what each holds, grow with the
#: square root of the vectors: ``LIST_SHARE`` times it.
SAMPLE_ROWS, MAX_LISTS, LIST_SHARE = 65_536, 8192, 2
#: Links of a centroid, and centroids that a search keeps in view at first:
#: the view widens while its last centroid is still within a query's ratio.
DEGREE, BEAM = 24, 64
#: A vector's further lists: up to this ratio of its nearest distance, no more
#: than so many lists in all, and each at least ``SPREAD`` times the vector's
#: own distance away from those before it.
BOUNDARY_RATIO, REPLICAS, SPREAD = 1.02, 2, 0.25
#: The share of the true nearest that queries' lists shall hold, and the queries
#: (those of least hash) that are compared with all vectors to find the ratio for it.
RECALL, CALIBRATED = 0.96, 256
#: Vectors of a segment and queries of a block.
SEGMENT_ROWS, BLOCK_ROWS = 4096, 512
FINITE = "forall(v, x -> x is not null and not isnan(x) and abs(x) < double('Infinity'))"
#: Tasks that search the graph for the queries, at most (64 queries each at least).
PROBE_TASKS = 2048
#: Queries whose best a task carries along; beyond it passes them on.
CARRIED = 50_000


@dataclass
class Index:
    """Centroids (float64, a row each), the graph's links (-1: none) and the
    centroids that searches start from."""

    centroids: np.ndarray
    links: np.ndarray
    entries: np.ndarray


def squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.maximum((a * a).sum(axis=1)[:, None] + (b * b).sum(axis=1)[None, :] - 2 * (a @ b.T), 0)


def balanced_centroids(rows: np.ndarray, lists: int, rounds: int = 6) -> np.ndarray:
    """Means of ``lists`` parts of ``rows``, halved (in proportion) by two-means
    whose parts have fixed sizes."""
    done, todo = [], [(np.arange(len(rows)), min(lists, len(rows)))]
    while todo:
        at, n = todo.pop()
        own = rows[at]
        if n == 1:
            done.append(own.mean(axis=0))
            continue
        first = n // 2
        size = min(max(round(len(at) * first / n), first), len(at) - (n - first))
        one = own[((own - own.mean(axis=0)) ** 2).sum(axis=1).argmax()]
        two = own[((own - one) ** 2).sum(axis=1).argmax()]
        for _ in range(rounds):
            order = np.argsort(own @ (two - one), kind="stable")
            one, two = own[order[:size]].mean(axis=0), own[order[size:]].mean(axis=0)
        todo += [(at[order[:size]], first), (at[order[size:]], n - first)]
    return np.unique(np.array(done), axis=0)


def link(centroids: np.ndarray, degree: int = DEGREE) -> Index:
    """A graph of near centroids: of the nearest ones, those that no chosen one
    is nearer to, filled up with the nearest; links go both ways. One entry for
    every part of the graph, and the centroid nearest to the middle."""
    n = len(centroids)
    near = []
    for i in range(0, n, 512):
        d = squared(centroids[i:i + 512], centroids)
        d[np.arange(len(d)), np.arange(i, i + len(d))] = np.inf
        near.append(np.argsort(d, axis=1, kind="stable")[:, :min(3 * degree, n - 1)])
    near = np.concatenate(near) if n > 1 else np.empty((n, 0), dtype=np.int64)
    ways: list[list[int]] = []
    for i in range(n):
        to_me = ((centroids[near[i]] - centroids[i]) ** 2).sum(axis=1)
        between = squared(centroids[near[i]], centroids[near[i]])
        chosen: list[int] = []
        for j in range(len(to_me)):
            if len(chosen) < degree // 2 and all(between[j, c] >= to_me[j] for c in chosen):
                chosen.append(j)
        rest = [j for j in range(len(to_me)) if j not in set(chosen)]
        ways.append(near[i][chosen + rest[:degree // 2 - len(chosen)]].tolist())
    both: list[dict[int, None]] = [dict.fromkeys(w) for w in ways]
    for i, w in enumerate(ways):
        for j in w:
            both[j][i] = None
    links = np.full((n, max(map(len, both), default=0)), -1, dtype=np.int64)
    for i, w in enumerate(both):
        links[i, :len(w)] = list(w)
    part = np.full(n, -1)
    middle = int(((centroids - centroids.mean(axis=0)) ** 2).sum(axis=1).argmin())
    entries = []
    for start in [middle, *range(n)]:
        if part[start] < 0:
            entries.append(start)
            todo = [start]
            part[start] = start
            while todo:
                for j in both[todo.pop()]:
                    if part[j] < 0:
                        part[j] = start
                        todo.append(j)
    return Index(centroids, links, np.array(entries))


def nearest_lists(index: Index, rows: np.ndarray, beam: int = BEAM) -> tuple[np.ndarray, np.ndarray]:
    """For each row the ``beam`` nearest centroids that the graph search finds,
    nearest first (-1: none), and their distances (inf: none). All rows
    search together; a step looks at the links of each row's nearest centroid not yet looked at."""
    n, m = len(index.centroids), len(rows)
    beam = min(beam, n)
    norm = (index.centroids ** 2).sum(axis=1)
    seen = np.zeros((m, n + 1), dtype=bool)
    seen[:, n] = True  # the place of missing links
    ids = np.full((m, beam), n)
    far = np.full((m, beam), np.inf)
    looked = np.ones((m, beam), dtype=bool)

    def meet(who: np.ndarray, new: np.ndarray) -> None:
        """Adds the centroids ``new`` (a row each) to the view of ``who``."""
        new = np.where(seen[who[:, None], new], n, new)
        seen[who[:, None], new] = True
        safe = np.minimum(new, n - 1)
        d = np.einsum("ij,ikj->ik", rows[who], index.centroids[safe])
        d = np.where(new == n, np.inf, norm[safe] - 2 * d)  # without the row's own norm
        every, dist = np.concatenate((ids[who], new), axis=1), np.concatenate((far[who], d), axis=1)
        old = np.concatenate((looked[who], new == n), axis=1)
        best = np.argsort(dist, axis=1, kind="stable")[:, :beam]
        at = np.arange(len(who))[:, None]
        ids[who], far[who], looked[who] = every[at, best], dist[at, best], old[at, best]

    links = np.where(index.links < 0, n, index.links)
    width = max(1, links.shape[1])
    for i in range(0, len(index.entries), width):
        part = index.entries[i:i + width]
        meet(np.arange(m), np.broadcast_to(part, (m, len(part))).copy())
    who = np.arange(m)
    while links.shape[1]:
        open_ = ~looked[who]
        who = who[open_.any(axis=1)]
        if not len(who):
            break
        at = (~looked[who]).argmax(axis=1)
        looked[who, at] = True
        meet(who, links[ids[who, at]])
    ids = np.where(ids == n, -1, ids)
    exact = np.sqrt(((rows[:, None, :] - index.centroids[np.maximum(ids, 0)]) ** 2).sum(axis=2)) if n else far
    return ids, np.where(ids < 0, np.inf, exact)


def query_lists(index: Index, rows: np.ndarray, ratio: float, beam: int = BEAM) -> np.ndarray:
    """The lists of each query (-1: none): all found up to the ratio of the
    nearest distance. The view is doubled for the rows that it may cut off."""
    out = np.full((len(rows), len(index.centroids)), -1)
    who = np.arange(len(rows))
    while len(who):
        ids, far = nearest_lists(index, rows[who], beam)
        within = far <= ratio * far[:, :1]
        out[who, :ids.shape[1]] = np.where(within, ids, -1)
        who = who[within[:, -1]] if beam < len(index.centroids) else who[:0]
        beam *= 2
    return out


def boundary_lists(index: Index, rows: np.ndarray, ratio: float, replicas: int, spread: float = SPREAD) -> np.ndarray:
    """The lists of each row (-1: none): the nearest, and further ones up to the
    ratio that lie apart from those the row already has."""
    ids, far = nearest_lists(index, rows, max(4 * replicas, 16))
    out = np.full((len(rows), replicas), -1)
    out[:, 0] = ids[:, 0]
    used = np.ones(len(rows), dtype=np.int64)
    for j in range(1, ids.shape[1]):
        near = (far[:, j] <= ratio * far[:, 0]) & (used < replicas) & (ids[:, j] >= 0)
        who = np.flatnonzero(near)
        if not len(who):
            continue
        have = out[who]
        gap = ((index.centroids[np.maximum(have, 0)] - index.centroids[ids[who, j]][:, None, :]) ** 2).sum(axis=2)
        gap[have < 0] = np.inf
        who = who[np.sqrt(gap.min(axis=1)) > spread * far[who, j]]
        out[who, used[who]] = ids[who, j]
        used[who] += 1
    return out


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


def _by_lists(index: Index, dim: int, choose):
    """Rows ``id, v`` to one row for each list that ``choose(rows)`` gives."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 512):
                part = batch.slice(i, 512)
                lists = choose(_matrix(part.column("v"), dim))
                row, at = np.nonzero(lists >= 0)
                take = pa.array(row)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(lists[row, at].astype(np.int64)), part.column("id").take(take), part.column("v").take(take)],
                    names=["list", "id", "v"])
    return run


def _fit(lists: int, dim: int):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("id", kind="stable")
        index = link(balanced_centroids(np.array(rows["v"].tolist(), dtype=np.float64).reshape(len(rows), dim), lists))
        return pd.DataFrame({"centroids": [index.centroids.tobytes()], "links": [index.links.tobytes()],
                             "entries": [index.entries.astype(np.int64).tobytes()]})
    return run


def fit(vectors: DataFrame, dim: int, rows: int, lists: int | None = None, sample: int = SAMPLE_ROWS) -> Index:
    """The centroids and their graph, from at most about ``sample`` of the
    ``rows`` vectors (``id, v``); one task holds the sample, and the driver the
    index: at most ``MAX_LISTS`` centroids."""
    lists = min(lists or math.ceil(LIST_SHARE * math.sqrt(rows)), MAX_LISTS)
    share = min(1.0, sample / max(rows, 1))
    part = vectors.where(F.pmod(F.xxhash64(F.lit(13), "id"), F.lit(1 << 20)) < share * (1 << 20))
    part = part if rows <= sample else part.limit(2 * sample)
    r = part.withColumn("one", F.lit(0)).groupBy("one").applyInPandas(_fit(lists, dim), "centroids binary, links binary, entries binary").first()
    if r is None:
        return Index(np.empty((0, dim)), np.empty((0, 0), dtype=np.int64), np.empty(0, dtype=np.int64))
    centroids = np.frombuffer(r["centroids"], dtype=np.float64).reshape(-1, dim)
    return Index(centroids, np.frombuffer(r["links"], dtype=np.int64).reshape(len(centroids), -1),
                 np.frombuffer(r["entries"], dtype=np.int64))


def nearest_in(queries: np.ndarray, q_ids: np.ndarray, rows: np.ndarray, ids: np.ndarray, k: int) -> Iterator[tuple]:
    """Each query's ``k`` nearest rows of another id: ``(query, ids, distances)``.
    Products choose the rows that can be among them, differences score those."""
    approx = squared(queries, rows)
    approx[q_ids[:, None] == ids[None, :]] = np.inf
    slack = 1e-9 * ((queries ** 2).sum(axis=1) + (rows ** 2).sum(axis=1).max(initial=0))
    for i in range(len(queries)):
        d = approx[i]
        bound = np.partition(d, k - 1)[k - 1] if len(d) > k else np.inf
        at = np.flatnonzero((d <= bound + slack[i]) & np.isfinite(d))
        exact = np.sqrt(((rows[at] - queries[i]) ** 2).sum(axis=1))
        order = np.lexsort((ids[at], exact))[:k]
        yield q_ids[i], ids[at][order], exact[order]


class Carried:
    """The best of the queries that a task has met: ``query id -> (distances, ids)``."""

    def __init__(self, k: int):
        self.k = k
        self.best: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def bound(self, q: int) -> float:
        far = self.best[q][0] if q in self.best else ()
        return far[-1] if len(far) == self.k else np.inf

    def meet(self, q_ids: np.ndarray, queries: np.ndarray, ids: np.ndarray, rows: np.ndarray) -> None:
        """Products tell which queries the rows may improve, and by which rows."""
        approx = squared(queries, rows)
        approx[q_ids[:, None] == ids[None, :]] = np.inf
        slack = 1e-9 * ((queries ** 2).sum(axis=1) + (rows ** 2).sum(axis=1).max(initial=0))
        limit = np.array([self.bound(q) for q in q_ids.tolist()]) ** 2 + slack
        for i in np.flatnonzero(approx.min(axis=1, initial=np.inf) <= limit):
            d, most = approx[i], limit[i]
            if len(d) > self.k:
                most = min(most, np.partition(d, self.k - 1)[self.k - 1] + slack[i])
            at = np.flatnonzero((d <= most) & np.isfinite(d))
            far, near = np.sqrt(((rows[at] - queries[i]) ** 2).sum(axis=1)), ids[at]
            have = self.best.get(int(q_ids[i]))
            if have is not None:
                # a vector that lies in several lists comes again
                again = np.isin(near, have[1]) & np.isin(far, have[0])
                far, near = np.concatenate((have[0], far[~again])), np.concatenate((have[1], near[~again]))
            order = np.lexsort((near, far))[:self.k]
            self.best[int(q_ids[i])] = (far[order], near[order])

    def rows(self) -> pa.RecordBatch:
        found, self.best = self.best, {}
        sizes = [len(far) for far, _ in found.values()]
        whole = lambda j, kind: np.concatenate([x[j] for x in found.values()]) if found else np.empty(0, dtype=kind)
        return pa.RecordBatch.from_arrays(
            [pa.array(np.repeat(np.fromiter(found, dtype=np.int64, count=len(found)), sizes)), pa.array(whole(1, np.int64)),
             pa.array(whole(0, np.float64))], names=["query_id", "vec_id", "score"])


def _search(dim: int, k: int, group: list[str]):
    """Rows sorted by ``group`` and ``side`` (queries, 0, before vectors, 1) to
    the best of each query in this task."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        carried, at = Carried(k), None
        q_ids, queries = np.empty(0, dtype=np.int64), np.empty((0, dim))
        for batch in batches:
            keys = np.stack([batch.column(c).to_numpy() for c in [*group, "side"]], axis=1)
            cuts = np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1
            for a, b in zip([0, *cuts], [*cuts, batch.num_rows]):
                key, side = tuple(keys[a, :-1]), keys[a, -1]
                if key != at:
                    if len(carried.best) > CARRIED:
                        yield carried.rows()
                    at, q_ids, queries = key, q_ids[:0], queries[:0]
                for c in range(a, b, 2048):
                    part = batch.slice(c, min(2048, b - c))
                    ids, rows = part.column("id").to_numpy(), _matrix(part.column("v"), dim)
                    if side == 0:
                        q_ids, queries = np.concatenate((q_ids, ids)), np.concatenate((queries, rows))
                        continue
                    for i in range(0, len(q_ids), 256):
                        carried.meet(q_ids[i:i + 256], queries[i:i + 256], ids, rows)
        yield carried.rows()
    return run


def _met(queries: DataFrame, vectors: DataFrame, group: list[str], dim: int, k: int) -> DataFrame:
    """The best of every query among the vectors of its own groups."""
    both = queries.select(*group, F.lit(0).cast("long").alias("side"), "id", "v").unionByName(
        vectors.select(*group, F.lit(1).cast("long").alias("side"), "id", "v"))
    dealt = both.repartition(*group).sortWithinPartitions(*group, "side", "id")
    return dealt.mapInArrow(releasing(_search(dim, k, group)), "query_id long, vec_id long, score double")


def _nearest_of_all(q_ids: np.ndarray, queries: np.ndarray, k: int):
    """Rows ``id, v`` to each query's ``k`` nearest of the task, with vectors."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dim = queries.shape[1]
        best = [(np.empty(0), np.empty(0, dtype=np.int64), np.empty((0, dim))) for _ in q_ids]
        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                part = batch.slice(at, 2048)
                ids, rows = part.column("id").to_numpy(), _matrix(part.column("v"), dim)
                place = {v: j for j, v in enumerate(ids.tolist())}
                for i, (_, near, far) in enumerate(nearest_in(queries, q_ids, rows, ids, k)):
                    far = np.concatenate((best[i][0], far))
                    near_ids = np.concatenate((best[i][1], near))
                    near_rows = np.concatenate((best[i][2], rows[[place[v] for v in near.tolist()]]))
                    order = np.lexsort((near_ids, far))[:k]
                    best[i] = (far[order], near_ids[order], near_rows[order])
        sizes = [len(x[0]) for x in best]
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.repeat(np.arange(len(best)), sizes)), pa.array(np.concatenate([x[1] for x in best])),
             pa.array(np.concatenate([x[0] for x in best])), pa.array(list(np.concatenate([x[2] for x in best])), pa.list_(pa.float64()))],
            names=["query", "id", "score", "v"])
    return run


def needed_ratio(index: Index, queries: np.ndarray, of: np.ndarray, rows: np.ndarray, recall: float, boundary_ratio: float,
                 replicas: int) -> float:
    """The ratio at which the lists of ``queries`` hold the share ``recall`` of
    their true neighbours ``rows`` (``of``: whose each is)."""
    nearest_centroid = np.sqrt(squared(queries, index.centroids).min(axis=1))[of]
    lists = boundary_lists(index, rows, boundary_ratio, replicas)
    gap = np.sqrt(((index.centroids[np.maximum(lists, 0)] - queries[of][:, None, :]) ** 2).sum(axis=2))
    gap[lists < 0] = np.inf
    need = np.sort(gap.min(axis=1) / np.maximum(nearest_centroid, 1e-9))
    return max(1.0, float(need[min(len(need) - 1, int(np.ceil(recall * len(need))))])) * (1 + 1e-6) if len(need) else 1.0


def calibrate(vectors: DataFrame, queries: DataFrame, index: Index, dim: int, k: int, recall: float = RECALL,
              boundary_ratio: float = BOUNDARY_RATIO, replicas: int = REPLICAS, asked: int = CALIBRATED) -> float:
    """:func:`needed_ratio` of at most ``asked`` queries, those of least hash."""
    some = queries.orderBy(F.xxhash64(F.lit(17), "id"), "id").limit(asked).toPandas()
    if not len(some) or not len(index.centroids):
        return 1.0
    q_ids, q_rows = some["id"].to_numpy(np.int64), np.array(some["v"].tolist(), dtype=np.float64).reshape(len(some), dim)
    found = vectors.mapInArrow(releasing(_nearest_of_all(q_ids, q_rows, k)), "query long, id long, score double, v array<double>")
    order = Window.partitionBy("query").orderBy("score", "id")
    true = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query", "v").toPandas()
    return needed_ratio(index, q_rows, true["query"].to_numpy(np.int64), np.array(true["v"].tolist(), dtype=np.float64).reshape(-1, dim),
                        recall, boundary_ratio, replicas)


def nearest(vectors: DataFrame, queries: DataFrame, k: int, lists: int | None = None, recall: float = RECALL,
            boundary_ratio: float = BOUNDARY_RATIO, replicas: int = REPLICAS, beam: int = BEAM, sample: int = SAMPLE_ROWS,
            segment_rows: int = SEGMENT_ROWS, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """``vectors`` and ``queries`` (``id, v``: arrays of doubles) to ``query_id,
    rank, vec_id, score``: the ``k`` nearest found of each query by Euclidean
    distance, ties to the smaller id, without the vector of its own id.

    Every vector is indexed, and about the share ``recall`` of the true nearest is found. A query that finds fewer than ``k`` in its lists
    is compared with all vectors, in blocks. Vectors of a query's own length
    are searched only; null ids, null or empty vectors, those of zeros and
    those with a null or non-finite component take no part; rows that repeat an id and a vector count once.
    """
    valid = lambda df: df.where(f"id is not null and size(v) > 0 and {FINITE} and exists(v, x -> x <> 0)").select(
        "id", "v", F.size("v").alias("dim")).distinct()
    # of equal vectors, k + 1 can be among the nearest of a query that is one of them
    same = Window.partitionBy("v").orderBy("id")
    held = stage(valid(vectors).withColumn("same", F.row_number().over(same)).where(F.col("same") <= k + 1).drop("same"), "lists-vectors")
    asked = stage(valid(queries), "lists-queries")
    sizes = {r["dim"]: r["n"] for r in held.groupBy("dim").agg(F.count("*").alias("n")).collect()}
    dims = sorted(set(sizes) & {r["dim"] for r in asked.select("dim").distinct().collect()})
    found = None
    for dim in dims:
        own, mine = (x.where(F.col("dim") == dim).select("id", "v") for x in (held, asked))
        part = _nearest_of(own, mine, dim, sizes[dim], k, lists, recall, boundary_ratio, replicas, beam, sample, segment_rows, block_rows)
        found = part if found is None else found.unionByName(part)
    if found is None:
        return vectors.sparkSession.createDataFrame([], "query_id long, `rank` int, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return found.distinct().withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k) \
        .select("query_id", "rank", "vec_id", "score")


def _nearest_of(own: DataFrame, mine: DataFrame, dim: int, rows: int, k: int, lists: int | None, recall: float,
                boundary_ratio: float, replicas: int, beam: int, sample: int, segment_rows: int, block_rows: int) -> DataFrame:
    index = fit(own, dim, rows, lists, sample)
    ratio = calibrate(own, mine, index, dim, k, recall, boundary_ratio, replicas)
    kinds = "list long, id long, v array<double>"
    posted = stage(own.mapInArrow(releasing(_by_lists(index, dim, lambda v: boundary_lists(index, v, boundary_ratio, replicas))), kinds),
                   "lists-posted")
    apart = mine.repartition(max(1, min(PROBE_TASKS, mine.count() // 64)), "id")
    probes = stage(apart.mapInArrow(releasing(_by_lists(index, dim, lambda v: query_lists(index, v, ratio, beam))), kinds), "lists-probes")
    # both sides of a list are split by a hash: segments of vectors meet blocks of queries
    count = lambda df, n, name: df.groupBy("list").agg(F.ceil(F.count("*") / n).alias(name))
    grid = stage(count(posted, segment_rows, "segments").join(count(probes, block_rows, "blocks"), "list"), "lists-grid")
    spread = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    salt = lambda n: F.pmod(F.xxhash64("id"), F.col(n))
    sides = [posted.join(grid, "list").withColumn("segment", salt("segments")).withColumn("block", spread("blocks")),
             probes.join(grid, "list").withColumn("block", salt("blocks")).withColumn("segment", spread("segments"))]
    found = stage(_met(sides[1], sides[0], ["list", "segment", "block"], dim, k), "lists-found")
    # queries whose lists hold too few are compared with every vector
    enough = found.distinct().groupBy("query_id").count().where(F.col("count") >= k)
    short = stage(mine.join(enough.select(F.col("query_id").alias("id")), "id", "left_anti"), "lists-short")
    n = short.count()
    if not n:
        return found
    parts, groups = -(-rows // segment_rows), -(-n // block_rows)
    number = lambda m: F.pmod(F.xxhash64("id"), F.lit(m))
    every = lambda m: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(m - 1).cast("long")))
    all_vectors = own.withColumn("segment", number(parts)).withColumn("block", every(groups))
    all_queries = short.withColumn("block", number(groups)).withColumn("segment", every(parts))
    return found.unionByName(_met(all_queries, all_vectors, ["segment", "block"], dim, k))
