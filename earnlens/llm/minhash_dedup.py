"""MinHash near-duplicate detection with sequential Bayesian verification.

1. Every text becomes a set of word shingles and a MinHash signature; equal
   sets collapse into one class.
2. Classes that agree on a band share a bucket. Every class is paired with its
   bucket's smallest member only, so candidates grow with the input.
3. A pair's signatures are compared batch by batch. With a uniform prior and m
   of n hashes equal, the similarity s has the posterior Beta(m + 1, n - m + 1);
   a pair is dropped once P(s >= threshold) falls below the miss probability.
   Survivors are verified on their full sets.
4. Links become components. A bucket whose members are not all in one
   component is gone over again: its members outside its largest component
   meet all members of other components, in blocks; so no two components that
   share a bucket and have a link stay apart, and none inside one is needed.
5. New links that step 4 finds join the components once more.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh3_128_digest

from earnlens.llm.common import fresh, releasing, small_or_shuffle, stage, text_or_empty
from earnlens.llm.graph import components
from earnlens.llm.words import shingles

WIDTH = 5
HASHES = 120
#: Hashes compared before each test of the posterior.
BATCH = 24
#: Percent of the union.
THRESHOLD = 85
#: Chance of dropping a pair that is at the threshold or above, by the posterior.
MISS = 1e-6
#: Shingles of the two sides of a block in step 4 (about: members are dealt by a hash).
BLOCK_FEW, BLOCK_ALL = 250_000, 1_000_000

_rng = np.random.Generator(np.random.PCG64(20240229))
_MUL = _rng.integers(0, 2 ** 63, HASHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ADD = _rng.integers(0, 2 ** 63, HASHES, dtype=np.uint64)


def bands(percent: int, miss: float = MISS) -> tuple[int, int]:
    """Bands and hashes of a band: the longest bands at which a pair at the
    threshold agrees on none with a chance of about ``miss`` (up to twice it)."""
    s = percent / 100
    return next((HASHES // r, r) for r in range(HASHES, 0, -1)
                if HASHES % r == 0 and (r == 1 or (1 - s ** r) ** (HASHES // r) <= 2 * miss))


def signature(sh: np.ndarray) -> bytes:
    low = np.full(HASHES, 2 ** 32 - 1, dtype=np.uint32)
    for i in range(0, len(sh), 512):
        part = ((sh[i:i + 512, None] * _MUL + _ADD) >> np.uint64(32)).astype(np.uint32)
        np.minimum(low, part.min(axis=0), out=low)
    return low.tobytes()


def least_matches(n: int, threshold: float, miss: float) -> int:
    """The fewest of ``n`` equal hashes at which P(s >= threshold) >= ``miss``:
    that posterior is P(Binomial(n + 1, threshold) <= m)."""
    total = 0.0
    for m in range(n + 1):
        total += comb(n + 1, m) * threshold ** m * (1 - threshold) ** (n + 1 - m)
        if total >= miss:
            return m
    return n


def plausible(a: np.ndarray, b: np.ndarray, threshold: float, miss: float) -> np.ndarray:
    """Indexes of the rows at which signatures ``a`` and ``b`` stay plausible.
    ``a`` may be a single row."""
    alive = np.arange(len(b))
    equal = np.zeros(len(b), dtype=np.int32)
    for n in range(BATCH, HASHES + 1, BATCH):
        part = slice(n - BATCH, n)
        left = a[:, part] if len(a) == 1 else a[alive, part]
        equal = equal + (left == b[alive, part]).sum(axis=1, dtype=np.int32)
        stay = equal >= least_matches(n, threshold, miss)
        alive, equal = alive[stay], equal[stay]
        if not len(alive):
            break
    return alive


def _signatures(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, sets, sigs = [], [], []
            for text in batch.column("text"):
                sh = shingles(text.as_py(), width)
                n.append(len(sh))
                sets.append(xxh3_128_digest(sh.tobytes()) if len(sh) else None)
                sigs.append(signature(sh) if len(sh) else None)
            yield pa.RecordBatch.from_arrays(
                [batch.column("d"), pa.array(n, pa.int64()), pa.array(sets, pa.binary()), pa.array(sigs, pa.binary())],
                names=["d", "n_shingles", "set", "sig"])
    return run


def _matrix(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype=np.uint32).reshape(len(column), HASHES)


def _bayes(threshold: float, miss: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                keep = plausible(_matrix(batch.column("sa")), _matrix(batch.column("sb")), threshold, miss)
                yield batch.select(["a", "b"]).take(pa.array(keep))
    return run


def _verify(width: int, percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, right = None, None
        for batch in batches:
            keep = []
            for i, (ta, tb) in enumerate(zip(batch.column("ta"), batch.column("tb"))):
                tb = tb.as_py()
                if tb != last:
                    last, right = tb, shingles(tb, width)
                left = shingles(ta.as_py(), width)
                both = len(np.intersect1d(left, right, assume_unique=True))
                if both and 100 * both >= percent * (len(left) + len(right) - both):
                    keep.append(i)
            yield batch.select(["a", "b"]).take(pa.array(keep, pa.int64()))
    return run


def _sets(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = [shingles(t.as_py(), width).tobytes() for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("d"), pa.array(own, pa.binary())], names=["d", "members"])
    return run


def _blocks(percent: int, miss: float, n_bands: int, n_rows: int):
    """Sorted rows of blocks (key ``bucket, fb, ab``) to links between
    different components. Pairs that stay plausible are verified on their full
    sets, the likeliest first, until one links a member with a component; a
    pair that shares several bands is looked at in the first. Keeps one block
    in memory."""
    columns = ("few", "band", "d", "c", "sig", "members")

    def linked(a: np.ndarray, b: np.ndarray) -> bool:
        both = len(np.intersect1d(a, b, assume_unique=True))
        return 100 * both >= percent * (len(a) + len(b) - both)

    def links(rows: list[tuple]) -> pa.RecordBatch:
        rest = [r for r in rows if not r[0]]
        sig = np.frombuffer(b"".join(r[4] for r in rest), dtype=np.uint32).reshape(len(rest), HASHES)
        ids, comp = (np.array([r[i] for r in rest], dtype=np.int64) for i in (2, 3))
        sets = [np.frombuffer(r[5], dtype=np.uint64) for r in rest]
        out = []
        for _, band, d, c, s, members in (r for r in rows if r[0]):
            own, one = np.frombuffer(s, dtype=np.uint32), np.frombuffer(members, dtype=np.uint64)
            other = np.flatnonzero(comp != c)
            other = other[plausible(own[None], sig[other], percent / 100, miss)]
            equal = sig[other] == own
            first = equal.reshape(len(other), n_bands, n_rows).all(axis=2).argmax(axis=1)
            likely = np.argsort(-equal.sum(axis=1), kind="stable")
            met = set()
            for i in other[likely[first[likely] == band]].tolist():
                if comp[i] not in met and linked(one, sets[i]):
                    met.add(comp[i])
                    out.append((min(d, int(ids[i])), max(d, int(ids[i]))))
        return pa.RecordBatch.from_pydict({"a": pa.array([x for x, _ in out], pa.int64()), "b": pa.array([y for _, y in out], pa.int64())})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, rows = None, []
        for batch in batches:
            keys = zip(*(batch.column(c).to_pylist() for c in ("bucket", "fb", "ab")))
            for key, *row in zip(keys, *(batch.column(c).to_pylist() for c in columns)):
                if key != at:
                    if rows:
                        yield links(rows)
                    at, rows = key, []
                rows.append(tuple(row))
        if rows:
            yield links(rows)
    return run


def _exact(pairs: DataFrame, texts: DataFrame, width: int, percent: int) -> DataFrame:
    """The pairs whose full sets pass, as a stage."""
    ta = texts.select(F.col("d").alias("a"), F.col("text").alias("ta"))
    tb = texts.select(F.col("d").alias("b"), F.col("text").alias("tb"))
    both = pairs.join(ta, "a").join(tb, "b").select("a", "b", "ta", "tb")
    return stage(both.mapInArrow(releasing(_verify(width, percent)), "a long, b long").distinct(), "near-links")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text: str = "text", width: int = WIDTH,
                    percent: int = THRESHOLD, miss: float = MISS) -> DataFrame:
    """One row per input row: ``doc_id, n_shingles, component_id, kept``.

    Texts whose shingle sets share at least ``percent`` of their union are
    linked; ``component_id`` is the smallest id reachable. Texts without words
    (null, empty, white space) have no shingles and are linked with nothing.
    Rows that repeat an id are one vertex: each is returned with its own set
    size and the common component. A null id counts as the smallest id and is
    returned as null. Other columns are ignored; an empty table gives no rows.
    Set sizes and similarities are counted on 64-bit shingle hashes.
    """
    nothing = -(2 ** 63)
    rows = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(nothing)).alias("d"), text_or_empty(text).alias("text"))
    signed = stage(rows.mapInArrow(releasing(_signatures(width)), "d long, n_shingles long, `set` binary, sig binary"), "near-signed")
    classes = stage(signed.where("n_shingles > 0").groupBy("set").agg(F.min("d").alias("rep")), "near-classes")
    reps = signed.where("n_shingles > 0").join(
        classes.select(F.col("set").alias("s"), F.col("rep").alias("r")),
        (F.col("set") == F.col("s")) & (F.col("d") == F.col("r"))).select("d", "n_shingles", "sig")
    reps = stage(reps, "near-reps")

    n_bands, n_rows = bands(percent, miss)
    keys = F.array(*[F.xxhash64(F.lit(i), F.substring("sig", i * 4 * n_rows + 1, 4 * n_rows)) for i in range(n_bands)])
    in_band = reps.select("d", F.posexplode(keys).alias("band", "bucket"))
    buckets = in_band.groupBy("bucket").agg(F.count("*").alias("n"), F.min("d").alias("pivot")).where("n > 1")
    buckets = stage(buckets, "near-pivots")
    shared = stage(in_band.join(buckets, "bucket"), "near-buckets")

    pairs = shared.where("d <> pivot").select(F.col("d").alias("a"), F.col("pivot").alias("b")).distinct()
    sa = reps.select(F.col("d").alias("a"), F.col("sig").alias("sa"))
    sb = reps.select(F.col("d").alias("b"), F.col("sig").alias("sb"))
    signs = pairs.join(sa, "a").join(sb, "b").select("a", "b", "sa", "sb")
    likely = stage(signs.mapInArrow(releasing(_bayes(percent / 100, miss)), "a long, b long"), "near-likely")

    # texts of the classes that may still be compared, fetched once
    ids = stage(shared.select(F.col("d").alias("i")).distinct(), "near-ids")
    texts = stage(rows.join(small_or_shuffle(ids, 16), F.col("d") == F.col("i"), "left_semi"), "near-texts")
    links = _exact(likely, texts, width, percent)
    found = components(links)

    more = _between(shared, found, reps, texts, width, percent, miss)
    if more is not None:
        found = components(links.unionByName(more))

    named = classes.join(found, F.col("rep") == F.col("v"), "left").select(
        "set", F.coalesce("component", "rep").alias("component"))
    out = signed.select("d", "n_shingles", "set").join(named, "set", "left")
    # rows that repeat an id in several sets: the id is one vertex
    back = lambda c: F.when(F.col(c) != nothing, F.col(c))
    return out.select(back("d").alias("doc_id"), "n_shingles", F.coalesce("component", "d").alias("c")).select(
        "doc_id", "n_shingles", back("c").alias("component_id"),
        F.col("doc_id").eqNullSafe(back("c")).alias("kept"))


def _between(shared: DataFrame, found: DataFrame, reps: DataFrame, texts: DataFrame, width: int, percent: int,
             miss: float) -> DataFrame | None:
    """Links between different components that share a bucket, at least one
    for every two components that have any; None if every bucket lies in one
    component."""
    member = shared.where("n > 2").select("bucket", "band", "d").join(found, F.col("d") == F.col("v"), "left").select(
        "bucket", "band", "d", F.coalesce("component", "d").alias("c"))
    member = stage(member.join(reps.select("d", "n_shingles"), "d"), "near-members")
    sizes = member.groupBy("bucket", "c").agg(F.count("*").alias("m"), F.sum("n_shingles").alias("w"))
    split = sizes.groupBy("bucket").agg(
        F.max_by("c", F.struct("m", "c")).alias("main"), F.count("*").alias("parts"), F.sum("w").alias("w"),
        F.max_by("w", F.struct("m", "c")).alias("main_w")).where("parts > 1")
    ceil = lambda c, most: F.ceil(c / most).cast("int")
    split = stage(split.select("bucket", "main", ceil(F.col("w") - F.col("main_w"), BLOCK_FEW).alias("nf"),
                               ceil(F.col("w"), BLOCK_ALL).alias("na")), "near-split")
    if not split.limit(1).count():
        return None
    at = stage(member.join(split, "bucket"), "near-apart")
    ids = stage(at.select(F.col("d").alias("i")).distinct(), "near-apart-ids")
    some = texts.join(small_or_shuffle(ids, 16), F.col("d") == F.col("i"), "left_semi")
    sets = some.mapInArrow(releasing(_sets(width)), "d long, members binary").join(reps.select("d", "sig"), "d")
    at = at.join(stage(sets, "near-sets"), "d")
    own = lambda k: F.pmod(F.xxhash64("d"), F.col(k)).cast("int")
    every = lambda k: F.explode(F.sequence(F.lit(0), F.col(k) - 1))
    rest = ["band", "d", "c", "sig", "members"]
    few = at.where("c <> main").select("bucket", own("nf").alias("fb"), every("na").alias("ab"), F.lit(True).alias("few"), *rest)
    all_ = at.select("bucket", every("nf").alias("fb"), own("na").alias("ab"), F.lit(False).alias("few"), *rest)
    dealt = few.unionByName(all_).repartition("bucket", "fb", "ab").sortWithinPartitions("bucket", "fb", "ab")
    return stage(dealt.mapInArrow(releasing(_blocks(percent, miss, *bands(percent, miss))), "a long, b long").distinct(), "near-between")


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text: str = "text", percent: int = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` whose id is the smallest of their component, with
    all columns. Texts that share at least ``percent`` of their shingles are linked."""
    name, = fresh(docs.columns, "_gone")
    gone = near_duplicates(docs, id_col, text, percent=percent).where("not kept").select(F.col("doc_id").alias(name)).distinct()
    gone = small_or_shuffle(stage(gone, "near-gone"), 16)
    return docs.join(gone, F.col(id_col) == F.col(name), "left_anti")
