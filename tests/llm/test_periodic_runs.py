"""Periodic runs against a direct search over all periods."""

import random
from fractions import Fraction

import numpy as np
import pytest

from earnlens.llm import periodic_runs
from earnlens.llm.queries import with_planted_run

DOC = "doc_id long, text string, row string, words string, runs string"


def brute(words):
    n, out = len(words), {}
    for q in range(1, n // 3 + 1):
        i = 0
        while i + q < n:
            s = i
            while i + q < n and words[i] == words[i + q]:
                i += 1
            if i > s and i - s + q >= max(24, 3 * q):
                out.setdefault((s, i - s + q), q)
            i += 1 if i == s or i + q < n else 0
    return sorted((s, n, q) for (s, n), q in out.items())


def collapsed(words, runs):
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def noisy(rng, n, kinds, planted):
    w = [rng.choice(kinds) for _ in range(n)]
    for _ in range(planted):
        if n > 30:
            a, p = rng.randrange(n), rng.randrange(1, n // 3)
            for i in range(a + p, min(n, a + rng.randrange(n))):
                w[i] = w[i - p]
    return w


def test_fragments_of_random_texts():
    rng = random.Random(3)
    for _ in range(400):
        w = noisy(rng, rng.randrange(300), "abcde"[:rng.randrange(1, 6)] + "é", rng.randrange(4))
        found = {}
        for q, s, e in periodic_runs.fragments_of(periodic_runs.word_numbers([x.encode() for x in w])):
            found.setdefault(q, set()).update(range(s, e))
        got = []
        for q, places in found.items():
            for s in sorted(x for x in places if x - 1 not in places):
                e = s
                while e in places:
                    e += 1
                if e - s + q >= max(24, 3 * q):
                    got.append((s, e - s + q, q))
        assert sorted(got) == brute(w)


def test_z_function():
    s = [1, 1, 2, 1, 1, 2, 1, 1, 3]
    assert periodic_runs.z_function(s)[1:] == [1, 0, 5, 1, 0, 2, 1, 0]
    assert periodic_runs.prime_factors(360) == [2, 3, 5] and periodic_runs.prime_factors(1) == []


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(5)
    out = [None, "", " \n ", "one", "a " * 23, "a " * 24, "a\tb\n" * 40, "x y z " * 9 + "x y", "x y z " * 8]
    out += [" ".join(noisy(rng, rng.randrange(24, 500), ["a", "b", "c", "dd", "é", " "], 3)) for _ in range(40)]
    return out + out[6:9]  # repeated texts


@pytest.mark.parametrize("long_words", [1 << 17, 40])
def test_against_brute_force(spark, texts, long_words):
    """Also with the tiles of all texts of more than 40 words dealt to other tasks."""
    ids = list(range(len(texts) - 3)) + [6, 6, None]
    df = spark.createDataFrame([(i, t, "r", "w", "x") for i, t in zip(ids, texts)], DOC)
    got = periodic_runs.periodic_runs(df, long_words=long_words).collect()
    rows = sorted((-1 if r.doc_id is None else r.doc_id, r.n_words, [tuple(x) for x in r.runs],
                   r.strongest and tuple(r.strongest), r.collapsed) for r in got)
    want = []
    for i, t in zip(ids, texts):
        w = [x.decode() for x in (t or "").encode().split()]
        runs = brute(w)
        best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)
        want.append((-1 if i is None else i, len(w), runs, best, collapsed(w, runs)))
    assert rows == sorted(want, key=lambda r: (r[0], r[1], r[2]))


def test_one_word_over_and_over():
    n = 30_000
    got = periodic_runs.fragments_of(np.zeros(n, dtype=np.int32))
    assert got == [(1, 0, n - 1)]  # no multiple of the period is a run


def test_empty_table(spark):
    assert periodic_runs.periodic_runs(spark.createDataFrame([], DOC)).collect() == []


def test_planted_run_is_reversible_only_for_its_documents():
    words = [b"%d" % i for i in range(100)]
    changed = [d for d in range(200) if with_planted_run(d, words) != words]
    assert 5 <= len(changed) <= 40 and with_planted_run(None, words) == words and with_planted_run(changed[0], []) == []
