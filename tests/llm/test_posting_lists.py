"""Nearest neighbours over posting lists against brute force."""

import numpy as np
import pytest

from earnlens.llm import posting_lists, queries

KIND = "id long, v array<double>, list string, segment string, score string"


def brute(ids, rows, asked, k):
    out = {}
    for q, v in asked:
        same = [(float(np.sqrt(((np.array(x) - np.array(v)) ** 2).sum())), i) for i, x in zip(ids, rows) if i != q and len(x) == len(v)]
        out[q] = [(i, d) for d, i in sorted(same)[:k]]
    return out


def frame(spark, rows):
    return spark.createDataFrame([(i, v, "l", "s", "x") for i, v in rows], KIND)


def found(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r.query_id, r["rank"])):
        assert r["rank"] == len(out.setdefault(r.query_id, [])) + 1
        out[r.query_id].append((r.vec_id, r.score))
    return out


def clustered(n, dim, seed=0):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(12, dim)) * 3
    return (centres[rng.integers(12, size=n)] + rng.normal(size=(n, dim))).tolist()


def test_recall_and_exact_scores(spark):
    rows = clustered(3000, 16)
    df = frame(spark, enumerate(rows))
    got = found(posting_lists.nearest(df, df.where("id % 50 = 0"), 10, segment_rows=64, block_rows=8))
    want = brute(range(3000), rows, [(i, rows[i]) for i in range(0, 3000, 50)], 10)
    hits = sum(len({i for i, _ in got[q]} & {i for i, _ in want[q]}) for q in want)
    assert set(got) == set(want) and hits >= 0.9 * 10 * len(want)
    for q, near in got.items():
        for i, d in near:
            assert d == pytest.approx(np.linalg.norm(np.array(rows[i]) - np.array(rows[q])), abs=1e-12)


def test_lists_are_balanced_and_the_graph_finds_them():
    rows = np.array(clustered(4000, 8, 1))
    centroids = posting_lists.balanced_centroids(rows, 61)
    index = posting_lists.link(centroids)
    ids, far = posting_lists.nearest_lists(index, rows[:300], 24)
    d = np.sqrt(posting_lists.squared(rows[:300], centroids))
    assert (np.diff(far, axis=1) >= 0).all()
    assert np.mean([len(set(a[:10]) & set(b)) for a, b in zip(ids, np.argsort(d, axis=1)[:, :10])]) >= 9.5
    lists = posting_lists.boundary_lists(index, rows, 1.2, 4)
    copies = (lists >= 0).sum(axis=1)
    assert (lists[:, 0] >= 0).all() and 1 < copies.mean() < 4
    assert np.bincount(lists[:, 0], minlength=61).max() < 8 * len(rows) / 61
    every = posting_lists.query_lists(index, rows[:20], 1e9, beam=4)  # the view widens as far as needed
    assert ((every >= 0).sum(axis=1) == 61).all()


def test_a_third_of_all_rows_are_copies(spark):
    """Exact: of copies only the smallest ids can be returned."""
    rows = clustered(400, 6, 2)
    rows += [rows[7]] * 300
    df = frame(spark, enumerate(rows))
    got = found(posting_lists.nearest(df, df.where("id = 7 or id = 650 or id = 3"), 10, segment_rows=32, block_rows=2))
    assert got[7] == [(i, 0.0) for i in range(400, 410)]
    assert got[650] == [(i, 0.0) for i in [7, *range(400, 409)]]
    assert len(got[3]) == 10


def test_odd_rows(spark):
    """Nulls, zeros, other lengths, repeated rows, fewer rows than asked for."""
    rows = [(1, [1.0, 0.0]), (2, [0.0, 1.0]), (2, [0.0, 1.0]), (3, None), (None, [1.0, 1.0]), (4, []), (5, [0.0, 0.0]), (6, [1.0, 2.0, 3.0]),
            (7, [2.0, 0.0]), (8, [None, 1.0]), (9, [float("nan"), 1.0]), (10, [float("-inf"), 1.0])]
    df = frame(spark, rows)
    got = found(posting_lists.nearest(df, df, 10))
    assert got[1] == [(7, 1.0), (2, 2 ** 0.5)] and got[2] == [(1, 2 ** 0.5), (7, 5 ** 0.5)] and set(got) == {1, 2, 7}
    assert posting_lists.nearest(df.limit(0), df, 3).collect() == [] and posting_lists.nearest(df, df.limit(0), 3).collect() == []


def test_ties_go_to_the_smaller_id(spark):
    rows = [(i, [float(np.cos(i)), float(np.sin(i))]) for i in range(1, 30)] + [(0, [0.001, 0.0]), (40, [0.0, 0.001])]
    df = frame(spark, rows + [(i + 50, v) for i, v in rows])
    got = found(posting_lists.nearest(df, df.where("id = 0"), 4))
    assert got[0][:2] == [(50, 0.0), (40, got[0][1][1])] and got[0][2][0] == 90


def test_query_against_brute_force(spark):
    sf = "/root/testdata/sf0.01"
    table = spark.read.parquet(f"{sf}/embeddings.parquet").collect()
    ids, rows = [r.vec_id for r in table], [r.embedding for r in table]
    got = found(queries.QUERIES["op13_nearest_neighbours"](spark, sf))
    want = brute(ids, rows, [(i, v) for i, v in zip(ids, rows) if i % 100 == 0], 10)
    hits = sum(len({i for i, _ in got[q]} & {i for i, _ in want[q]}) for q in want)
    assert set(got) == set(want) and hits >= 0.9 * 10 * len(want)
