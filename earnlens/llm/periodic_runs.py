"""Periodic runs of words, by tiles that are scaled to the period.

A run is a stretch of words that repeats with smallest period q, cannot be
extended, and is at least ``max(SHORTEST, REPEATS * q)`` words long. In match
positions (i with word i equal to word i + q) it is an interval [s, e) of at
least 2q places. Periods are dealt into octaves; octave B holds those from B
to 2B - 1 (the least octave, of B = 8, also those below 8). Every multiple b
of B is the boundary of a tile of words [b - B, b + 4B). A tile counts for
period q if the words b .. b + B match those q further on: each run of an
octave has such tiles, and together they reach over both its ends. Hashes of
all B-word windows, doubled from octave to octave, tell which tiles can count;
in those, two Z-functions at the boundary give the exact reach forwards and
backwards of every period, and whether q is the smallest one. Fragments are
shuffled by document and period and stitched where they overlap.

A document's tiles are solved where its text is; those of texts longer than
``LONG_WORDS`` are dealt to other tasks, a segment of boundaries at a time.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from earnlens.llm.common import releasing, stage, text_or_empty

SHORTEST, REPEATS = 24, 3
#: Block of the least octave.
LEAST = 8
#: Texts of more words have their tiles dealt to other tasks, in segments of
#: about so many words.
LONG_WORDS = 1 << 17

Rewrite = Callable[[int | None, list[bytes]], list[bytes]]
FRAGMENT = pa.struct([("period", pa.int64()), ("s", pa.int64()), ("e", pa.int64())])
FRAGMENTS = "array<struct<period: bigint, s: bigint, e: bigint>>"
RUNS = "array<struct<start: bigint, length: bigint, period: bigint>>"


def word_numbers(words: list[bytes]) -> np.ndarray:
    """Equal words get equal numbers, different ones different numbers."""
    table: defaultdict[bytes, int] = defaultdict()
    table.default_factory = table.__len__
    return np.fromiter(map(table.__getitem__, words), np.int32, len(words))


def z_function(s: list[int], upto: int | None = None) -> list[int]:
    """How far ``s`` matches itself from each lag on, for lags below ``upto``."""
    n = len(s)
    stop = n if upto is None else min(n, upto)
    z = [0] * stop
    left = right = 0
    for i in range(1, stop):
        k = 0
        if i < right:
            k = z[i - left]
            if k < right - i:
                z[i] = k
                continue
            k = right - i
        while i + k < n and s[k] == s[i + k]:
            k += 1
        if k:
            z[i] = k
            left, right = i, i + k
    return z


def prime_factors(q: int) -> list[int]:
    out, p = [], 2
    while p * p <= q:
        if not q % p:
            out.append(p)
            while not q % p:
                q //= p
        p += 1
    return [*out, q] if q > 1 else out


def solve_tile(numbers: np.ndarray, b: int, block: int, lags: list[int]) -> list[tuple[int, int, int]]:
    """Fragments ``(period, s, e)`` of the tile at boundary ``b``, in match
    positions, cut at the tile's reach [b - block, b + 2 * block)."""
    most, n = max(lags), len(numbers)
    ahead = numbers[b:min(n, b + 4 * block)].tolist()
    forward = z_function(ahead, most + 1)
    lags = [q for q in lags if q < len(forward) and forward[q] >= block
            and all(forward[q // r] < q - q // r for r in prime_factors(q))]
    if not lags:
        return []
    back = min(b, block)
    head = numbers[b - back:b][::-1].tolist()
    tail = numbers[b - back:b + most][::-1].tolist()  # its place j is word b + most - 1 - j
    backward = z_function([*head, -1, *tail], back + 2 + most)
    return [(q, b - backward[back + 1 + most - q] if back else b, b + min(forward[q], 2 * block)) for q in lags]


def window_hashes(numbers: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """``(block, hashes of all windows of block words)`` for 8, 16, 32 ..;
    hashes only choose tiles, so that unequal windows of one hash do no harm."""
    h = (numbers.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    h ^= h >> np.uint64(29)
    size = 1
    while len(h) > size:
        h = h[:-size] * np.uint64(0xD1342543DE82EF95) + (h[size:] ^ (h[size:] >> np.uint64(31)))
        size *= 2
        if size >= LEAST:
            yield size, h


def candidates(h: np.ndarray, block: int, first: int, last: int) -> list[tuple[int, int]]:
    """``(boundary, lag)`` in order, for the boundaries of ``[first, last)``
    (multiples of ``block``) whose window has the hash of the window at that lag."""
    last = min(last, len(h))
    if first >= last:
        return []
    rows = -(-(last - first) // block)
    part = np.zeros((rows + 2) * block, dtype=np.uint64)
    part[:min(len(part), len(h) - first)] = h[first:first + len(part)]
    grid = part.reshape(-1, block)
    own, out = grid[:rows, :1], []
    at, lag = np.nonzero(grid[1:rows + 1] == own)
    out.append((at, lag + block))
    if block == LEAST:
        at, lag = np.nonzero(grid[:rows, 1:] == own)
        out.append((at, lag + 1))
    at, lag = (np.concatenate(x) for x in zip(*out))
    good = first + at * block + lag < len(h)
    at, lag = at[good], lag[good]
    order = np.lexsort((lag, at))
    return list(zip((first + at[order] * block).tolist(), lag[order].tolist()))


def solve(numbers: np.ndarray, h: np.ndarray, block: int, first: int, last: int) -> list[tuple[int, int, int]]:
    """The fragments of the tiles with boundaries in ``[first, last)``;
    neighbouring ones of a period are stitched at once."""
    out: list[tuple[int, int, int]] = []
    held: dict[int, tuple[int, int]] = {}
    found = candidates(h, block, first, last)
    i = 0
    while i < len(found):
        j, b = i, found[i][0]
        while j < len(found) and found[j][0] == b:
            j += 1
        for q, s, e in solve_tile(numbers, b, block, [q for _, q in found[i:j]]):
            before = held.get(q)
            if before is not None and s <= before[1]:
                held[q] = (min(before[0], s), max(before[1], e))
            else:
                if before is not None:
                    out.append((q, *before))
                held[q] = (s, e)
        i = j
    return out + [(q, *x) for q, x in held.items()]


def fragments_of(numbers: np.ndarray) -> list[tuple[int, int, int]]:
    """The fragments of all tiles of a text."""
    n, out = len(numbers), []
    if n < SHORTEST:
        return out
    for block, h in window_hashes(numbers):
        if block > LEAST and REPEATS * block > n:
            break
        out += solve(numbers, h, block, 0, n)
    return out


def _fragment_lists(found: list[list[tuple[int, int, int]]]) -> pa.ListArray:
    flat = np.array([x for f in found for x in f], dtype=np.int64).reshape(-1, 3)
    offsets = pa.array(np.concatenate(([0], np.cumsum([len(f) for f in found]))), pa.int32())
    return pa.ListArray.from_arrays(offsets, pa.StructArray.from_arrays(
        [pa.array(np.ascontiguousarray(flat[:, i])) for i in range(3)], fields=list(FRAGMENT)))


def _solve_texts(long_words: int, rewrite: Rewrite | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = TaskContext.get().partitionId() << 40
        for batch in batches:
            joined, counts, found = [], [], []
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").cast(pa.binary()).to_pylist()):
                words = text.split()
                if rewrite is not None:
                    words = rewrite(doc, words)
                joined.append(b" ".join(words))
                counts.append(len(words))
                found.append(fragments_of(word_numbers(words)) if len(words) <= long_words else [])
            n = batch.num_rows
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.arange(made, made + n)), batch.column("doc_id"), pa.array(counts, pa.int64()),
                 pa.array(joined, pa.binary()).cast(pa.string()), _fragment_lists(found)],
                names=["row", "doc_id", "n_words", "words", "fragments"])
            made += n
    return run


def _tiles(segment: int):
    """Long texts to segments of boundaries, octave by octave, each with the
    words its tiles reach."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, text in zip(batch.column("row").to_pylist(), batch.column("words").cast(pa.binary()).to_pylist()):
                numbers = word_numbers(text.split())
                n, block = len(numbers), LEAST
                while block == LEAST or REPEATS * block <= n:
                    step = max(block, segment // block * block)
                    for first in range(0, n, step):
                        low = max(0, first - block)
                        part = numbers[low:first + step + 4 * block]
                        yield pa.RecordBatch.from_pydict(
                            {"row": [row], "block": [block], "base": [low], "first": [first - low], "last": [first - low + step],
                             "numbers": [part.tobytes()]}, schema=TILES)
                    block *= 2
    return run


TILES = pa.schema([("row", pa.int64()), ("block", pa.int64()), ("base", pa.int64()), ("first", pa.int64()),
                   ("last", pa.int64()), ("numbers", pa.binary())])


def _solve_tiles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(batch.num_rows):
            r = batch.slice(i, 1).to_pylist()[0]
            numbers, found = np.frombuffer(r["numbers"], dtype=np.int32), []
            for block, h in window_hashes(numbers):
                if block == r["block"]:
                    found = solve(numbers, h, block, r["first"], r["last"])
                    break
            found = np.array(found, dtype=np.int64).reshape(-1, 3)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(found), r["row"])), pa.array(found[:, 0].copy()),
                 pa.array(found[:, 1] + r["base"]), pa.array(found[:, 2] + r["base"])], names=["row", "period", "s", "e"])


def stitch(fragments: DataFrame) -> DataFrame:
    """``row, period, s, e`` to the runs: ``row, start, length, period``."""
    own = Window.partitionBy("row", "period").orderBy("s", "e")
    reach = F.max("e").over(own.rowsBetween(Window.unboundedPreceding, -1))
    joined = fragments.withColumn("new", F.coalesce(F.col("s") > reach, F.lit(True)).cast("int")) \
        .withColumn("island", F.sum("new").over(own.rowsBetween(Window.unboundedPreceding, 0))) \
        .groupBy("row", "period", "island").agg(F.min("s").alias("start"), F.max("e").alias("e"))
    length = F.col("e") - F.col("start") + F.col("period")
    return joined.select("row", "start", length.alias("length"), "period") \
        .where((F.col("length") >= SHORTEST) & (F.col("length") >= REPEATS * F.col("period")))


def collapse(words: list[bytes], runs: np.ndarray) -> bytes:
    """The words that no run (``start, length, period``) holds after its first period."""
    edge = np.zeros(len(words) + 1, dtype=np.int64)
    np.add.at(edge, runs[:, 0] + runs[:, 2], 1)
    np.add.at(edge, runs[:, 0] + runs[:, 1], -1)
    keep = np.flatnonzero(np.cumsum(edge[:-1]) == 0)
    return b" ".join(map(words.__getitem__, keep.tolist()))


def _collapse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for text, runs in zip(batch.column("words").cast(pa.binary()).to_pylist(), batch.column("runs")):
            flat = runs.values
            out.append(collapse(text.split(), np.stack([flat.field(i).to_numpy() for i in range(3)], axis=1)))
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("n_words"), batch.column("runs"), pa.array(out, pa.binary()).cast(pa.string())],
            names=["doc_id", "n_words", "runs", "collapsed"])


def strongest(runs: Column) -> Column:
    """The run of greatest length / period (compared exactly, as integers),
    then of the smallest start, then of the smallest period; null without runs."""
    def better(a: Column, b: Column) -> Column:
        x, y = a["length"] * b["period"], b["length"] * a["period"]
        return (x > y) | ((x == y) & ((a["start"] < b["start"]) | ((a["start"] == b["start"]) & (a["period"] < b["period"]))))
    return F.aggregate(runs, F.try_element_at(runs, F.lit(1)), lambda best, r: F.when(better(r, best), r).otherwise(best))


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text: str = "text", rewrite: Rewrite | None = None,
                  long_words: int = LONG_WORDS) -> DataFrame:
    """One row per input row: ``doc_id, n_words, runs, strongest, collapsed``.

    ``runs`` are all runs of the words, by start and period; ``collapsed`` is
    the text of the words that stay, joined by one space: a run keeps its
    first period only. ``rewrite(doc_id, words)`` may change a text's words
    before. Null and empty texts have no words; rows that repeat are each
    returned, also under one id; a null id stays null; other columns are
    ignored; an empty table gives no rows.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text).alias("text"))
    solved = rows.mapInArrow(releasing(_solve_texts(long_words, rewrite)),
                             f"row long, doc_id long, n_words long, words string, fragments {FRAGMENTS}")
    solved = stage(solved, "run-fragments", compression="zstd")
    tiles = solved.where(F.col("n_words") > long_words).select("row", "words").mapInArrow(
        _tiles(long_words), "row long, block long, base long, `first` long, `last` long, numbers binary")
    dealt = tiles.repartition("row", "block", "base").mapInArrow(releasing(_solve_tiles), "row long, period long, s long, e long")
    short = solved.where(F.size("fragments") > 0).select("row", F.explode("fragments").alias("f")).select("row", "f.*")
    runs = stitch(short.unionByName(dealt)).groupBy("row").agg(
        F.array_sort(F.collect_list(F.struct("start", "period", "length"))).alias("runs"))
    runs = runs.withColumn("runs", F.transform("runs", lambda r: F.struct(r["start"], r["length"], r["period"])).cast(RUNS))
    empty = F.array().cast(RUNS)
    may = (F.size("fragments") > 0) | (F.col("n_words") > long_words)
    plain = solved.where(~may).select("doc_id", "n_words", empty.alias("runs"), F.col("words").alias("collapsed"))
    met = solved.where(may).select("row", "doc_id", "n_words", "words").join(runs, "row", "left")
    cut = met.select("doc_id", "n_words", "words", F.coalesce("runs", empty).alias("runs")).mapInArrow(
        releasing(_collapse), f"doc_id long, n_words long, runs {RUNS}, collapsed string")
    out = plain.unionByName(cut)
    return out.select("doc_id", "n_words", "runs", strongest(F.col("runs")).alias("strongest"), "collapsed")
