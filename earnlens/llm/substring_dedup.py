"""Removal of long repeated word runs over a compacted de Bruijn graph.

Nodes are token k-mers, chosen as anchors: of the k-mers inside every window
of ``WINDOW`` words the one of least hash, so that equal windows choose the
same anchor. An edge leads from an anchor to the next one of its document and
stands for all words between them. Joining occurrences with the degrees of
their nodes compacts the graph: along an occurrence whose nodes are repeated
and have one way in and one way out (a nonbranching path), every other
occurrence runs along the same words, so all its windows repeat. Only windows
over a branching node, or over the end of a path, stay open; for those, source
coordinates are verified: their own 128-bit hashes are counted. On a path two
occurrences count as equal where the 64-bit hashes of a node and of the edges on
both its sides agree; edges hold the node's words, so that at least 128 bits
tell different words apart.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from earnlens.llm.common import SPACE, fits, fresh, releasing, stage, text_or_empty
from earnlens.llm.words import Rolling, mix, word_hashes

#: Consecutive words whose repetition is removed, and words of an anchor.
WINDOW, KMER = 35, 8
#: Second rolling base: with the first it makes up a 128-bit window hash.
BASE2 = 0xD1342543DE82EF95
INVERSE2 = pow(BASE2, -1, 1 << 64)
KEY = ["d", "t"]


def least_positions(kmers: np.ndarray, span: int) -> np.ndarray:
    """For every run of ``span`` k-mers, where its (leftmost) least one is."""
    out = np.empty(len(kmers) - span + 1, dtype=np.int64)
    step = 1 << 16
    for i in range(0, len(out), step):
        part = np.lib.stride_tricks.sliding_window_view(kmers[i:i + step + span - 1], span)
        out[i:i + len(part)] = part.argmin(axis=1) + np.arange(i, i + len(part))
    return out


def anchors(roll: Rolling, window: int, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of all k-mers, the anchor of every window, the distinct anchors."""
    kmers = mix(roll.runs(np.arange(roll.n - k + 1), k))
    least = least_positions(kmers, window - k + 1)
    return kmers, least, np.unique(least)


def _occurrences(window: int, k: int):
    """Texts to anchor occurrences with the hashes of the edges on both sides.
    The way from a document's start to its first anchor is an edge too."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, pos, node, way_in, way_out = [], [], [], [], []
            for i, text in enumerate(batch.column("text")):
                words = word_hashes(text.as_py())
                n = len(words)
                if n < window:
                    continue
                roll = Rolling(words)
                kmers, _, at = anchors(roll, window, k)
                start = np.concatenate(([0], at))
                length = np.concatenate((at, [n - k])) - start + k
                edge = mix(roll.runs(start, length) + length.astype(np.uint64))
                edge[0] = ~edge[0]
                edge[-1] = edge[-1] ^ np.uint64(0x5555555555555555)
                rows.append(np.full(len(at), i))
                pos.append(at)
                node.append(kmers[at])
                way_in.append(edge[:-1])
                way_out.append(edge[1:])
            if rows:
                take = pa.array(np.concatenate(rows))
                longs = [pa.array(np.concatenate(x).view(np.int64)) for x in (node, way_in, way_out)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("d").take(take), batch.column("t").take(take),
                     pa.array(np.concatenate(pos).astype(np.int32)), *longs],
                    names=["d", "t", "pos", "node", "way_in", "way_out"])
    return run


def _merge(starts: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Windows (sorted starts) to the word runs that they cover."""
    cut = np.flatnonzero(np.diff(starts) > window)
    first = np.concatenate(([0], cut + 1)) if len(starts) else cut
    last = np.concatenate((cut, [len(starts) - 1])) if len(starts) else cut
    return starts[first], starts[last] + window


_RUNS = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("stop", T.IntegerType())]))
_OPEN = T.ArrayType(T.StructType([T.StructField("pos", T.IntegerType()), T.StructField("h1", T.LongType()),
                                  T.StructField("h2", T.LongType())]))
_PATHS = T.StructType([T.StructField("d", T.LongType()), T.StructField("t", T.LongType()),
                       T.StructField("runs", _RUNS), T.StructField("open", _OPEN)])


def _paths(window: int, k: int):
    """Texts with their repeated anchors to the runs that are certain and the
    windows that stay open."""
    def lists(counts: list[int], **columns: list[np.ndarray]) -> pa.ListArray:
        flat = [np.concatenate(c) if c else np.empty(0, dtype=np.int64) for c in columns.values()]
        kinds = [pa.int64() if n in ("h1", "h2") else pa.int32() for n in columns]
        offsets = pa.array(np.concatenate(([0], np.cumsum(counts))), pa.int32())
        return pa.ListArray.from_arrays(offsets, pa.StructArray.from_arrays(
            [pa.array(x.astype(k.to_pandas_dtype()), k) for x, k in zip(flat, kinds)], names=list(columns)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            starts, stops, pos, h1, h2 = [], [], [], [], []
            for text, flags in zip(batch.column("text"), batch.column("flags")):
                words = word_hashes(text.as_py())
                roll = Rolling(words)
                _, least, at = anchors(roll, window, k)
                state = np.zeros(len(words), dtype=np.int8)  # 1: on a nonbranching path, 2: branching
                flag = flags.values.to_numpy().astype(np.int64)
                state[flag >> 1] = 1 + (flag & 1)
                stop = np.zeros(len(words) + 1, dtype=np.int64)  # anchors that end a path, up to a word
                stop[at + 1] = state[at] != 1
                stop = np.cumsum(stop)
                t = np.arange(len(least))
                repeated = state[least] > 0
                clear = stop[t + window - k + 1] == stop[t]
                a, b = _merge(t[repeated & clear], window)
                starts.append(a)
                stops.append(b)
                t = t[repeated & ~clear]
                pos.append(t)
                h1.append(mix(roll.runs(t, window)).view(np.int64))
                h2.append(mix(Rolling(words, BASE2, INVERSE2).runs(t, window)).view(np.int64))
            yield pa.RecordBatch.from_arrays(
                [batch.column("d"), batch.column("t"), lists([len(x) for x in starts], start=starts, stop=stops),
                 lists([len(x) for x in pos], pos=pos, h1=h1, h2=h2)], names=["d", "t", "runs", "open"])
    return run


def _cut(window: int, columns: list[str], text: str, runs_at: str, starts_at: str, counts: list[str]):
    """Texts with their runs and verified windows to the words that stay;
    other columns pass through. A text that loses nothing is not changed."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, gone, kept = [], [], []
            for value, runs, starts in zip(*(batch.column(c) for c in (text, runs_at, starts_at))):
                value = value.as_py()
                words = (value or "").encode("utf-8", "surrogatepass").split()
                n.append(len(words))
                drop = np.zeros(len(words) + 1, dtype=np.int64)
                if runs.is_valid and len(runs.values):
                    np.add.at(drop, runs.values.field("start").to_numpy(), 1)
                    np.add.at(drop, runs.values.field("stop").to_numpy(), -1)
                if starts.is_valid:
                    a, b = _merge(np.unique(starts.values.to_numpy()).astype(np.int64), window)
                    drop[a] += 1
                    np.add.at(drop, b, -1)
                if drop.any():
                    words = [words[i] for i in np.flatnonzero(np.cumsum(drop[:-1]) == 0)]
                    value = b" ".join(words).decode("utf-8", "surrogatepass")
                gone.append(n[-1] - len(words))
                kept.append(value)
            own = [pa.array(kept, pa.string()) if c == text else batch.column(c) for c in columns]
            yield pa.RecordBatch.from_arrays([*own, pa.array(n, pa.int64()), pa.array(gone, pa.int64())],
                                             names=[*columns, *counts])
    return run


def repeated_runs(docs: DataFrame, id_col: str = "doc_id", text: str = "text", window: int = WINDOW,
                  k: int = KMER) -> DataFrame:
    """``d, t, runs, starts`` for every text with a repeated window: word runs
    of compacted paths and starts of single verified windows."""
    rows = keyed(docs, id_col, text)
    seen = stage(rows.mapInArrow(releasing(_occurrences(window, k)), "d long, t long, pos int, node long, way_in long, way_out long"),
                 "bruijn-occurrences")
    nodes = seen.groupBy("node").agg(
        F.count("*").alias("n"), *[f(c).alias(f"{f.__name__}_{c}") for c in ("way_in", "way_out") for f in (F.min, F.max)])
    nodes = nodes.where("n > 1").select(
        "node", ((F.col("min_way_in") != F.col("max_way_in")) | (F.col("min_way_out") != F.col("max_way_out")))
        .cast("int").alias("branching"))
    # a stage, so that the join's sides are two shuffles and a hot node is split
    nodes = stage(nodes, "bruijn-nodes")
    flags = seen.select(*KEY, "pos", "node").join(nodes, "node").groupBy(*KEY).agg(
        F.collect_list(F.col("pos") * 2 + F.col("branching")).alias("flags"))
    flags = stage(flags, "bruijn-flags")
    if fits(flags, 24):  # then only the texts that need it are shuffled
        rows = rows.join(F.broadcast(flags.select(*KEY)), KEY, "left_semi")
    with_flags = rows.join(flags, KEY)
    paths = stage(with_flags.mapInArrow(releasing(_paths(window, k)), _PATHS), "bruijn-paths")
    still = paths.select(*KEY, F.explode("open").alias("o")).select(*KEY, "o.pos", "o.h1", "o.h2")
    more = stage(still.groupBy("h1", "h2").agg(F.count("*").alias("n")).where("n > 1").select("h1", "h2"), "bruijn-windows")
    starts = still.join(more, ["h1", "h2"]).groupBy(*KEY).agg(F.collect_list("pos").alias("starts"))
    found = paths.select(*KEY, "runs").join(starts, KEY, "left").where("size(runs) > 0 or starts is not null")
    return found.dropDuplicates(KEY)  # rows that repeat id and text


def keyed(docs: DataFrame, id_col: str, text: str) -> DataFrame:
    """``d, t`` tell texts apart (rows that repeat both are the same text)."""
    return docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(-(2 ** 63))).alias("d"),
                       F.xxhash64(text_or_empty(text)).alias("t"), text_or_empty(text).alias("text"))


def cut_repeated_runs(docs: DataFrame, id_col: str = "doc_id", text: str = "text", window: int = WINDOW,
                      k: int = KMER) -> DataFrame:
    """The rows of ``docs`` with all their columns and ``_n_words,
    _n_removed``. A text that loses words becomes the words that stay, joined
    by one space; any other is left as it is."""
    d, t, runs, starts = fresh([*docs.columns, "_n_words", "_n_removed"], "_d", "_t", "_runs", "_starts")
    cover = stage(repeated_runs(docs, id_col, text, window, k).select(
        F.col("d").alias(d), F.col("t").alias(t), F.col("runs").alias(runs), F.col("starts").alias(starts)), "bruijn-cover")
    rows = docs.withColumns({d: F.coalesce(F.col(id_col).cast("long"), F.lit(-(2 ** 63))), t: F.xxhash64(text_or_empty(text))})
    if fits(cover, 24):  # then only the texts that lose words are shuffled
        some = F.broadcast(cover.select(d, t))
        none = [F.lit(None).cast(cover.schema[c].dataType).alias(c) for c in (runs, starts)]
        whole = rows.join(some, [d, t], "left_anti").select(*docs.columns, *none)
        rows = rows.join(some, [d, t], "left_semi").join(cover, [d, t]).select(*docs.columns, runs, starts).unionByName(whole)
    else:
        rows = rows.join(cover, [d, t], "left").select(*docs.columns, runs, starts)
    counts = ["_n_words", "_n_removed"]
    schema = T.StructType([*docs.schema.fields, *(T.StructField(c, T.LongType()) for c in counts)])
    return rows.mapInArrow(releasing(_cut(window, docs.columns, text, runs, starts, counts)), schema)


def drop_repeated_runs(docs: DataFrame, id_col: str = "doc_id", text: str = "text", window: int = WINDOW,
                       k: int = KMER) -> DataFrame:
    """One row per input row: ``doc_id, n_words, n_removed, kept`` (the words
    that stay, joined by one space).

    A word goes if it lies in a run of ``window`` words that also starts
    anywhere else in the table, in the same text too; all is judged on the
    input. Null, empty and short texts lose nothing. Every row counts: rows
    that repeat id and text repeat all their windows, and lose them. A null id
    is allowed. Other columns are ignored; an empty table gives no rows.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text).alias("text"))
    out = cut_repeated_runs(rows, window=window, k=k)
    words = F.btrim(F.regexp_replace("text", SPACE, " "), F.lit(" "))
    return out.select("doc_id", F.col("_n_words").alias("n_words"), F.col("_n_removed").alias("n_removed"),
                      F.when(F.col("_n_removed") > 0, F.col("text")).otherwise(words).alias("kept"))
