"""Best-fit packing by hierarchical residuals.

Documents are tokenised once into pieces of at most the capacity. Every
partition packs its pieces by best fit (longest first), emits its nearly full
bins, and passes its underfull bins on. They become items of the next round,
where eight partitions' bins meet and are best-fitted again, until one group
is left. Only bins move; pieces are joined with their final bin at the end.
"""

from __future__ import annotations

from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from earnlens.llm.byte_tokens import ByteEncoder, read_ranks
from earnlens.llm.common import fresh, releasing, small_or_shuffle, stage, text_or_empty

CAPACITY = 2048
END_ID = 0
#: Bins of at least this share of the capacity are emitted as they are.
NEARLY_FULL = 0.99
#: Underfull bins that a unit passes on, the emptiest first; the others are
#: emitted underfull. After best fit a unit has one bin of at most half the
#: capacity at most, so a round can save one bin for each unit; the bins that
#: are passed on are many more than that.
PASSED_ON = 512
#: Pieces packed at once, and units that meet in a round.
UNIT_ROWS, FAN_IN = 200_000, 8


def _pieces(ranks: str, pattern: str, capacity: int, with_ids: bool, added: dict[str, int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = ByteEncoder(read_ranks(ranks), pattern, added).encode
        for batch in batches:
            row, piece, start, length, crc, all_ids = [], [], [], [], [], []
            for i, text in enumerate(batch.column("text")):
                ids = np.array([*encode(text.as_py()), END_ID], dtype="<u4")
                first = len(ids) % capacity or capacity
                cuts = [0, *range(first, len(ids) + 1, capacity)]
                for p, (a, b) in enumerate(zip(cuts, cuts[1:])):
                    row.append(i)
                    piece.append(p)
                    start.append(a)
                    length.append(b - a)
                    crc.append(crc32(ids[a:b].tobytes()))
                    if with_ids:
                        all_ids.append(ids[a:b].astype(np.int32))
            columns = [batch.column("doc_id").take(pa.array(row, pa.int64())), pa.array(piece, pa.int32()),
                       *[pa.array(x, pa.int64()) for x in (start, length, crc)]]
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            if with_ids:
                columns, names = [*columns, pa.array(all_ids, pa.list_(pa.int32()))], [*names, "ids"]
            yield pa.RecordBatch.from_arrays(columns, names=names)
    return run


def tokenised_pieces(docs: DataFrame, ranks: str, pattern: str, id_col: str = "doc_id", text: str = "text",
                     capacity: int = CAPACITY, with_ids: bool = False,
                     added: dict[str, int] | None = None) -> DataFrame:
    """Documents to pieces: ``doc_id, piece, start, length, ids_crc32`` and,
    if asked for, ``ids``. A document is its token ids and an end id; a longer
    one is cut so that all pieces but the first are full. ``ranks`` and
    ``pattern`` are those of a byte-level BPE vocabulary. Null and empty texts
    are one piece of one id. ``added`` tokens in a text (token to id) split it and
    become their ids, as a tokenizer that has them does; without, they are ordinary text."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text).alias("text"))
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + (", ids array<int>" if with_ids else "")
    return rows.mapInArrow(releasing(_pieces(ranks, pattern, capacity, with_ids, added or {})), schema)


def best_fit(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bin and offset of every item, and the fill of every bin. Items go, the
    largest first, into the fullest bin that has room."""
    order = np.argsort(-sizes, kind="stable")
    bins, offsets = np.empty(len(sizes), dtype=np.int64), np.empty(len(sizes), dtype=np.int64)
    room = [[] for _ in range(capacity + 1)]  # bins by free space
    free = 0  # bit r: a bin has r free
    fills: list[int] = []
    for i, s in zip(order.tolist(), sizes[order].tolist()):
        above = free >> s
        if above:
            r = s + (above & -above).bit_length() - 1
            b = room[r].pop()
            if not room[r]:
                free &= ~(1 << r)
        else:
            r, b = capacity, len(fills)
            fills.append(0)
        bins[i], offsets[i] = b, fills[b]
        fills[b] += s
        if r > s:
            room[r - s].append(b)
            free |= 1 << (r - s)
    return bins, offsets, np.array(fills, dtype=np.int64)


def passed_on(fills: np.ndarray, capacity: int) -> np.ndarray:
    """Whether each bin goes on to the next round."""
    under = np.flatnonzero(fills < NEARLY_FULL * capacity)
    if len(under) > PASSED_ON:
        under = under[np.argsort(fills[under], kind="stable")[:PASSED_ON]]
    out = np.zeros(len(fills), dtype=bool)
    out[under] = True
    return out


def _pack_unit(capacity: int, unit_rows: int, names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base = TaskContext.get().partitionId() << 36
        made, units = 0, 0

        def unit(held: list[pa.RecordBatch]) -> pa.RecordBatch:
            nonlocal made, units
            rows = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            bins, offsets, fills = best_fit(rows.column("length").to_numpy(), capacity)
            columns = [*rows.columns, pa.array(base + made + bins), pa.array(offsets), pa.array(fills[bins]),
                       pa.array(passed_on(fills, capacity)[bins]),
                       pa.array(np.full(len(bins), base + units, dtype=np.int64))]
            made, units = made + len(fills), units + 1
            return pa.RecordBatch.from_arrays(columns, names=[*rows.schema.names, *names])

        held, n = [], 0
        for batch in batches:
            for i in range(0, batch.num_rows, unit_rows):
                part = batch.slice(i, unit_rows)
                if n and n + part.num_rows > unit_rows:
                    yield unit(held)
                    held, n = [], 0
                held.append(part)
                n += part.num_rows
        if n:
            yield unit(held)
    return run


def _merge_bins(capacity: int):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["fill", "bin"], ascending=[False, True], kind="stable")
        own, sizes = rows["bin"].to_numpy(), rows["fill"].to_numpy()
        bins, offsets, fills = best_fit(sizes, capacity)
        lead = np.empty(len(fills), dtype=np.int64)
        lead[bins[offsets == 0]] = own[offsets == 0]
        return pd.DataFrame({"bin": own, "into": lead[bins], "shift": offsets, "fill": fills[bins],
                             "on": passed_on(fills, capacity)[bins], "group": rows["group"].to_numpy()})
    return run


def pack(pieces: DataFrame, capacity: int = CAPACITY, unit_rows: int = UNIT_ROWS) -> DataFrame:
    """``pieces`` (any columns, with ``length`` from 1 to the capacity) plus
    ``sequence_id`` and ``offset``. An empty table gives no rows; ties of
    length keep their order, so a recomputed partition packs alike."""
    if {"sequence_id", "offset"} & {c.lower() for c in pieces.columns}:
        raise ValueError("pieces already have a place")
    bin_, offset, fill, on, unit, into, shift = names = fresh(pieces.columns, "bin", "offset", "fill", "on", "unit", "into", "shift")
    kinds = T.StructType([*pieces.schema.fields, *(T.StructField(n, T.BooleanType() if n == on else T.LongType()) for n in names[:5])])
    placed = stage(pieces.mapInArrow(releasing(_pack_unit(capacity, unit_rows, names[:5])), kinds), "pack-units")
    bins = placed.where(F.col(on) & (F.col(offset) == 0)).select(
        F.col(bin_).alias("bin"), F.col(fill).alias("fill"), F.col(unit).alias("group"))
    moved = None
    groups = placed.select(unit).distinct().count()
    while groups > 1:
        groups = -(-groups // FAN_IN)
        met = bins.withColumn("group", F.pmod(F.xxhash64("group"), F.lit(groups)).cast("long"))
        met = stage(met.groupBy("group").applyInPandas(
            _merge_bins(capacity), "bin long, into long, shift long, fill long, `on` boolean, `group` long"), "pack-merged")
        step = met.where("bin <> into").select("bin", "into", "shift")
        if moved is None:
            moved = step
        else:
            later = step.select(F.col("bin").alias("into"), F.col("into").alias("at"), F.col("shift").alias("more"))
            earlier = moved.join(later, "into", "left").select(
                "bin", F.coalesce("at", "into").alias("into"), (F.col("shift") + F.coalesce("more", F.lit(0))).alias("shift"))
            moved = earlier.unionByName(step)
        moved = stage(moved, "pack-moved")
        bins = met.where("`on` and bin = into").select("bin", "fill", "group")
    if moved is None:
        return placed.select(*pieces.columns, F.col(bin_).alias("sequence_id"), offset)
    moved = small_or_shuffle(moved, 24).select(F.col("bin").alias(bin_), F.col("into").alias(into), F.col("shift").alias(shift))
    return placed.join(moved, bin_, "left").select(
        *pieces.columns, F.coalesce(into, bin_).alias("sequence_id"),
        (F.col(offset) + F.coalesce(shift, F.lit(0))).alias("offset"))
