"""Deduplication operators against brute force, and their edge cases."""

import hashlib
import random
import re

import pytest

from earnlens.llm import exact_dedup, line_dedup, minhash_dedup, substring_dedup
from earnlens.llm.graph import components

DOC = "doc_id long, text string, lang string, _d string, n_len int, kept string"
WORDS = [f"w{i}" for i in range(400)]


def table(spark, texts, ids=None):
    """Rows with extra columns whose names clash with internal ones."""
    ids = range(len(texts)) if ids is None else ids
    return spark.createDataFrame([(i, t, "en", "x", 1, "y") for i, t in zip(ids, texts)], DOC)


def words_of(text, lower=False):
    text = text or ""
    if lower:
        text = re.sub("[A-Z]", lambda m: m[0].lower(), text)
    return re.findall(r"[^\x20\x09-\x0D]+", text)


def messy(seed, n=60):
    r = random.Random(seed)
    prose = lambda k: " ".join(r.choice(WORDS) for _ in range(k))
    base = [prose(r.randrange(5, 120)) for _ in range(8)]
    out = [None, "", " \t", "\n", "A", "a", prose(3000)]
    while len(out) < n:
        t = r.choice(base)
        kind = r.randrange(5)
        if kind == 0:
            t = t.replace(" ", r.choice(["  ", "\t", "\n", "\r\n "]))
        elif kind == 1:
            w = t.split()
            w[r.randrange(len(w))] = r.choice(WORDS)
            t = " ".join(w)
        elif kind == 2:
            t = prose(20) + " " + t + " " + prose(20)
        elif kind == 3:
            t = prose(r.randrange(1, 60)) + " \u0085é"
        out.append(t)
    return out


# -- exact

def brute_exact(ids, texts):
    norm = [re.sub(r"[\x20\x09-\x0D]+", " ", t or "") for t in texts]
    groups = {}
    for i, t in zip(ids, norm):
        groups.setdefault(t, []).append(i)
    return sorted((i, min(groups[t]), len(groups[t]), i == min(groups[t]), hashlib.sha256(t.encode()).hexdigest())
                  for i, t in zip(ids, norm))


@pytest.mark.parametrize("seed", [1, 2])
def test_exact_against_brute_force(spark, seed):
    texts = messy(seed)
    rows = exact_dedup.exact_duplicates(table(spark, texts), hash_all=True).collect()
    assert sorted(map(tuple, rows)) == brute_exact(range(len(texts)), texts)


def test_exact_hashes_survivors_only(spark):
    rows = exact_dedup.exact_duplicates(table(spark, ["a b", "a  b", "other", None])).collect()
    assert {r.doc_id: r.text_sha256 is None for r in rows} == {0: False, 1: False, 2: True, 3: True}


def test_exact_repeated_rows_and_null_ids(spark):
    df = table(spark, ["a", "a", "a", "b", "b", None, ""], [3, 3, 5, None, None, 7, 8])
    rows = [tuple(r)[:4] for r in exact_dedup.exact_duplicates(df).collect()]
    assert sorted(r[3] for r in rows if r[1] == 3) == [False, False, True]
    assert sorted(r[3] for r in rows if r[0] is None) == [False, True]
    assert sorted(r[:3] for r in rows if r[1] == 7) == [(7, 7, 2), (8, 7, 2)]
    kept = exact_dedup.drop_exact_duplicates(df)
    assert kept.columns == df.columns
    assert sorted((r.doc_id is None, r.doc_id, r.text or "") for r in kept.collect()) == [(False, 3, "a"), (False, 7, ""), (True, None, "b")]


# -- lines

def brute_lines(ids, texts):
    def key(line):
        return re.sub("[A-Z]", lambda m: m[0].lower(), line.strip(" \t\n\x0b\x0c\r"))
    held = {}
    for i, t in zip(ids, texts):
        for line in (t or "").split("\n"):
            if len(key(line)) >= 40:
                held.setdefault(key(line), set()).add(i)
    out = []
    for i, t in zip(ids, texts):
        lines = (t or "").split("\n")
        stay = [x for x in lines if not (len(held.get(key(x), ())) >= 5 and max(held[key(x)]) != i)]
        out.append((i, len(lines), len(lines) - len(stay), "\n".join(stay)))
    return sorted(out)


@pytest.mark.parametrize("batches", [1, 3, 5])
def test_lines_against_brute_force(spark, batches):
    r = random.Random(batches)
    pool = ["x" * 39, "y" * 40, "é" * 41, "A longer line that is repeated in very many texts, it is"] + \
           [f"line number {i} that is long enough to be counted as one" for i in range(12)]
    texts = [None, "", "\n", "\n\n", "no"]
    for _ in range(60):
        lines = [r.choice(pool) for _ in range(r.randrange(1, 9))]
        texts.append("\n".join(r.choice(["", " ", "\t"]) + (x.upper() if r.random() < 0.2 else x) + r.choice(["", "\r"]) for x in lines))
    got = line_dedup.drop_repeated_lines(table(spark, texts), batches=batches).collect()
    # only A-Z are lower-cased: É stays
    assert sorted(map(tuple, got)) == brute_lines(range(len(texts)), texts)


def test_lines_repeated_ids_and_runs(spark):
    line = "z" * 50
    df = table(spark, [line] * 4 + [line, line], [1, 2, 3, 4, 4, None])
    rows = line_dedup.drop_repeated_lines(df).collect()  # five ids, null the smallest
    assert sorted((r.doc_id is None, r.doc_id or 0, r.n_dropped) for r in rows) == [
        (False, 1, 1), (False, 2, 1), (False, 3, 1), (False, 4, 0), (False, 4, 0), (True, 0, 1)]
    runs = line_dedup.LineRuns(fanout=2)
    for ids in ([9, 8], [7], [6, 5], [1]):
        runs.add(line_dedup.line_hashes(table(spark, [line] * len(ids), ids)))
    assert [len(level) for level in runs.levels] == [0, 0, 1]  # compacted twice
    assert [(r.n_docs, r.top) for r in runs.merged().collect()] == [(6, 9)]


# -- near copies

def brute_near(texts):
    sets = []
    for t in texts:
        w = words_of(t, True)
        sets.append({tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    label = list(range(len(texts)))

    def root(x):
        while label[x] != x:
            x = label[x]
        return x

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a and b and 100 * len(a & b) >= 85 * len(a | b):
                x, y = sorted((root(i), root(j)))
                label[y] = x
    return sorted((i, len(s), root(i), root(i) == i) for i, s in enumerate(sets))


@pytest.mark.parametrize("seed", [3, 4])
def test_near_against_brute_force(spark, seed):
    texts = messy(seed, 80)
    got = minhash_dedup.near_duplicates(table(spark, texts)).collect()
    assert sorted(map(tuple, got)) == brute_near(texts)


def test_near_large_loose_group(spark, monkeypatch):
    """Copies of one text with many different edits: buckets that hold several
    components, gone over in several blocks."""
    monkeypatch.setattr(minhash_dedup, "BLOCK_FEW", 1500)
    monkeypatch.setattr(minhash_dedup, "BLOCK_ALL", 4000)
    r = random.Random(9)
    base = [f"b{i}" for i in range(120)]
    texts = []
    for _ in range(150):
        w = list(base)
        for _ in range(r.randrange(7)):
            w[r.randrange(len(w))] = f"e{r.randrange(10 ** 6)}"
        texts.append(" ".join(w))
    want = brute_near(texts)
    assert len({x[2] for x in want}) > 5
    assert sorted(map(tuple, minhash_dedup.near_duplicates(table(spark, texts)).collect())) == want


def test_near_ids(spark):
    text = " ".join(WORDS[:50])
    df = table(spark, [text, text + " more", text, None], [5, None, 5, 6])
    rows = minhash_dedup.near_duplicates(df).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0, r.component_id, r.kept) for r in rows) == [
        (False, 5, None, False), (False, 5, None, False), (False, 6, 6, True), (True, 0, None, True)]
    kept = minhash_dedup.drop_near_duplicates(table(spark, [text, text + " more", "", None]))
    assert sorted(r.doc_id for r in kept.collect()) == [0, 2, 3]


def test_posterior_bound():
    assert minhash_dedup.least_matches(120, 0.85, 1e-6) < 102 * 0.85
    assert minhash_dedup.least_matches(24, 0.85, 0.5) > minhash_dedup.least_matches(24, 0.85, 1e-6)


def test_components(spark):
    r = random.Random(2)
    links = [(i, i + 1) for i in range(40)] + [(100 + r.randrange(30), 100 + r.randrange(30)) for _ in range(25)] + [(200, 200 + i) for i in range(50)]
    got = {x.v: x.component for x in components(spark.createDataFrame(links, "a long, b long")).collect()}
    label = {}
    for a, b in links:
        label.setdefault(a, a)
        label.setdefault(b, b)
    for _ in label:
        for a, b in links:
            label[a] = label[b] = min(label[a], label[b])
    linked = {x for a, b in links if a != b for x in (a, b)}
    assert got == {v: label[v] for v in linked}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


# -- repeated runs

def brute_runs(texts, window=35):
    words = [words_of(t) for t in texts]
    places = {}
    for d, w in enumerate(words):
        for i in range(len(w) - window + 1):
            places.setdefault(tuple(w[i:i + window]), []).append((d, i))
    gone = [set() for _ in words]
    for at in places.values():
        if len(at) > 1:
            for d, i in at:
                gone[d].update(range(i, i + window))
    return sorted((d, len(w), len(gone[d]), " ".join(x for i, x in enumerate(w) if i not in gone[d])) for d, w in enumerate(words))


@pytest.mark.parametrize("seed", [5, 6, 7])
def test_runs_against_brute_force(spark, seed):
    r = random.Random(seed)
    prose = lambda k: [r.choice(WORDS) for _ in range(k)]
    shared = [prose(k) for k in (34, 35, 36, 60, 150)]
    texts = [None, "", " ", "x " * 90, "a b " * 60, " ".join(shared[4])]
    for _ in range(50):
        w = prose(r.randrange(0, 80))
        for _ in range(r.randrange(3)):
            s = r.choice(shared)
            a = r.randrange(0, max(1, len(s) - 34))
            w += s[a:a + r.randrange(30, 70)] + prose(r.randrange(0, 4))
        texts.append(r.choice([" ", "\n", "  "]).join(w))
    got = substring_dedup.drop_repeated_runs(table(spark, texts)).collect()
    assert sorted(map(tuple, got)) == brute_runs(texts)


def test_runs_repeated_rows_and_columns(spark):
    text = " ".join(WORDS[:40])
    df = table(spark, [text, text, "left  as\nit is", None], [1, 1, None, 2])
    cut = substring_dedup.cut_repeated_runs(df)
    assert cut.columns == [*df.columns, "_n_words", "_n_removed"]
    assert sorted((r.doc_id is None, r.doc_id or 0, r.text, r._n_removed, r.lang) for r in cut.collect() if r.text is not None) == [
        (False, 1, "", 40, "en"), (False, 1, "", 40, "en"), (True, 0, "left  as\nit is", 0, "en")]


@pytest.mark.parametrize("run", [
    exact_dedup.exact_duplicates, exact_dedup.drop_exact_duplicates, line_dedup.drop_repeated_lines,
    minhash_dedup.near_duplicates, minhash_dedup.drop_near_duplicates, substring_dedup.drop_repeated_runs])
def test_empty_tables(spark, run):
    assert run(spark.createDataFrame([], DOC)).count() == 0
