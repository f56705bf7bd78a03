"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import ctypes
import gc
import posixpath
import uuid
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from earnlens.session import checkpoint_dir
from earnlens.sources.tables import read_table  # noqa: F401

#: ASCII white space of the contracts, as a Java regular expression.
SPACE = r"[\x20\x09-\x0D]+"
#: The same characters, as a set to strip.
SPACE_CHARS = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Tables up to this size (estimated from their rows) may be broadcast; larger
#: ones are joined by a shuffle.
BROADCAST_BYTES = 8 << 20

#: Bytes of the Arrow batches that carry whole texts to Python tasks.
BATCH_BYTES = 8 << 20


def bounded_batches(spark: SparkSession) -> None:
    """Bounds Arrow batches by bytes, so that a task holds few long texts at
    once. A smaller bound of the session stays."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    held = spark.conf.get(key)
    if not held.rstrip("bB").isdigit() or not 0 < int(held.rstrip("bB")) <= BATCH_BYTES:
        spark.conf.set(key, str(BATCH_BYTES))


def stage(df: DataFrame, name: str, compression: str | None = None) -> DataFrame:
    """``df`` written as Parquet in the shared checkpoint folder and read back.

    Cuts the lineage like a reliable checkpoint, but keeps column pruning and
    filters, and survives lost executors.
    """
    spark = df.sparkSession
    path = posixpath.join(checkpoint_dir(spark), "stages", f"{name}-{uuid.uuid4().hex}")
    df.write.parquet(path, compression=compression)
    return spark.read.schema(df.schema).parquet(path)


def fits(df: DataFrame, row_bytes: int, limit: int = BROADCAST_BYTES) -> bool:
    """Whether the counted rows of ``df`` (a stage) fit into ``limit`` bytes;
    ``row_bytes`` is the size of a row in memory."""
    most = limit // row_bytes
    return df.limit(most + 1).count() <= most


def small_or_shuffle(df: DataFrame, row_bytes: int, limit: int = BROADCAST_BYTES) -> DataFrame:
    """``df`` with a broadcast hint if it :func:`fits`; unchanged otherwise,
    so that the join shuffles."""
    return F.broadcast(df) if fits(df, row_bytes, limit) else df


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def lower_ascii(c: Column) -> Column:
    return F.translate(c, UPPER, LOWER)


def id_hash(name: str = "doc_id") -> Column:
    """A fixed pseudo-random long of a row's id."""
    return F.xxhash64(F.lit(0x5EED), F.col(name))


def fresh(columns: list[str], *names: str) -> list[str]:
    """``names``, changed as far as needed so that none is in ``columns``
    (Spark ignores case)."""
    taken, out = {c.lower() for c in columns}, []
    for n in names:
        while n.lower() in taken:
            n = "_" + n
        taken.add(n)
        out.append(n)
    return out


def release() -> None:
    """Memory that is free goes back to the machine. Spark keeps Python workers
    for later tasks, and they would hold the most that any task took."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def releasing(run: Callable) -> Callable:
    """``run`` (batches to batches) for ``mapInArrow``, with :func:`release` at its end."""
    def released(batches):
        try:
            yield from run(batches)
        finally:
            release()
    return released
