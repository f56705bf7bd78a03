"""Line deduplication over levelled sorted runs (DataFrame functions only).

Documents arrive in batches. The index is a set of runs: tables of line
hashes, bucketed and sorted by the hash, a file for each bucket. A batch becomes
such a table too and is merge-joined with the runs to find the lines it holds
first: neither side is exchanged or sorted again. It then adds its own run; when
a level has ``FANOUT`` runs they are merged, bucket by bucket, into one run of
the next level. Batches are taken in descending order of document id, so the
first holder of a line is the largest id that holds it.
"""

from __future__ import annotations

import posixpath
import uuid
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from earnlens.llm.common import SPACE_CHARS, fits, lower_ascii, stage, text_or_empty
from earnlens.session import checkpoint_dir

#: Runs of a level that are merged into one of the next.
FANOUT = 2
#: Batches that :func:`drop_repeated_lines` deals a table into.
BATCHES = 3
MIN_CHARS, MIN_DOCS = 40, 5
HASH = ["h1", "h2"]


def line_key(line: Column) -> Column:
    """The line without ASCII white space at both ends, A-Z lower-cased."""
    return lower_ascii(F.btrim(line, F.lit(SPACE_CHARS)))


def split_lines(text: str = "text") -> Column:
    return F.split(text_or_empty(text), "\n", -1)


def row_keys(id_col: str, text: str) -> list[Column]:
    """Tells rows apart that share an id but not the text."""
    return [F.coalesce(F.col(id_col), F.lit(-(2 ** 63))).alias("_d"), F.xxhash64(text_or_empty(text)).alias("_t")]


def line_hashes(docs: DataFrame, id_col: str = "doc_id", text: str = "text", min_chars: int = MIN_CHARS) -> DataFrame:
    """One row per line whose key is long enough: ``_d, _t, pos, h1, h2``.
    Two 64-bit hashes make up the key's 128-bit hash."""
    lines = docs.select(*row_keys(id_col, text), F.posexplode(split_lines(text)).alias("pos", "line"))
    keyed = lines.select("_d", "_t", "pos", line_key(F.col("line")).alias("key")).where(F.length("key") >= min_chars)
    return keyed.select("_d", "_t", "pos", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(7), F.col("key")).alias("h2"))


#: Files of a bucket are read in their order, where there is one of each.
SORTED_SCAN = "spark.sql.legacy.bucketedTableScan.outputOrdering"


@dataclass
class LineRuns:
    """The index: levels of sorted runs with ``h1, h2, n_docs, top``; the
    number of documents that hold the line and its first holder (null in the
    runs of later batches)."""

    fanout: int = FANOUT
    levels: list[list[DataFrame]] = field(default_factory=list)

    def all_runs(self) -> list[DataFrame]:
        return [run for level in self.levels for run in level]

    def merged(self) -> DataFrame | None:
        """One row per line hash over all runs."""
        runs = self.all_runs()
        return merge(runs) if runs else None

    def add(self, lines: DataFrame) -> None:
        """Merge-joins a batch of line hashes with the runs, adds what it holds
        as its own run and compacts levels that are full."""
        own = lines.groupBy(*HASH).agg(F.count_distinct("_d").alias("n_docs"), F.max("_d").alias("top"))
        known = self.all_runs()
        if known:
            own = sorted_run(own)
            # first-held are the lines that no run holds
            held = [f"held{i}" for i in range(len(known))]
            for name, run in zip(held, known):
                own = own.join(run.select(*HASH, F.col("top").isNotNull().alias(name)), HASH, "left")
            seen = reduce(lambda a, b: a | b, [F.coalesce(F.col(name), F.lit(False)) for name in held])
            own = own.select(*HASH, "n_docs", F.when(~seen, F.col("top")).alias("top"))
        self._put(0, sorted_run(own))

    def _put(self, level: int, run: DataFrame) -> None:
        while len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append(run)
        if len(self.levels[level]) >= self.fanout:
            full, self.levels[level] = self.levels[level], []
            self._put(level + 1, sorted_run(merge(full)))


def merge(runs: list[DataFrame]) -> DataFrame:
    """Sorted runs merged by their hashes, two at a time; what two make up is a
    sorted run for the next one."""
    whole = runs[0]
    for i, run in enumerate(runs[1:]):
        more = run.select(*HASH, F.col("n_docs").alias("more"), F.col("top").alias("other"))
        whole = (sorted_run(whole) if i else whole).join(more, HASH, "full").select(
            *HASH, (F.coalesce("n_docs", F.lit(0)) + F.coalesce("more", F.lit(0))).alias("n_docs"),
            F.greatest("top", "other").alias("top"))
    return whole


def sorted_run(rows: DataFrame) -> DataFrame:
    """``rows`` as a table bucketed and sorted by the hash. Rows that a shuffle
    has dealt by the hash, or that come from such tables, lie in their buckets'
    tasks already, so that a bucket is one file. Hashes do not compress, and a
    codec's buffers for many small files would be all cost."""
    spark = rows.sparkSession
    name = f"line_run_{uuid.uuid4().hex}"
    path = posixpath.join(checkpoint_dir(spark), "stages", name)
    before = spark.conf.get(SORTED_SCAN)
    spark.conf.set(SORTED_SCAN, "true")
    try:
        rows.write.option("path", path).option("compression", "none").bucketBy(int(spark.conf.get("spark.sql.shuffle.partitions")), *HASH).sortBy(*HASH).saveAsTable(name)
    finally:
        spark.conf.set(SORTED_SCAN, before)
    return spark.table(name)


def repeated_lines(docs: DataFrame, id_col: str = "doc_id", text: str = "text", min_chars: int = MIN_CHARS,
                   min_docs: int = MIN_DOCS, batches: int = BATCHES) -> DataFrame:
    """The lines to drop: ``_d, _t, pos`` of every line whose key is held by
    at least ``min_docs`` documents, but for its holder of the largest id."""
    lines = stage(line_hashes(docs, id_col, text, min_chars), "line-hashes")
    # quantiles only balance the batches; any cuts give the same result
    cuts = lines.stat.approxQuantile("_d", [i / batches for i in range(1, batches)], 0.02) if batches > 1 else []
    cuts = sorted({int(c) for c in cuts}, reverse=True)
    edges = [None, *cuts, None]
    runs = LineRuns()
    for high, low in zip(edges, edges[1:]):
        batch = lines
        if high is not None:
            batch = batch.where(F.col("_d") < high)
        if low is not None:
            batch = batch.where(F.col("_d") >= low)
        runs.add(batch)
    hot = stage(runs.merged().where(F.col("n_docs") >= min_docs).select(*HASH, "top"), "line-hot")
    return lines.join(hot, HASH).where("_d <> top").select("_d", "_t", "pos")


def drop_repeated_lines(docs: DataFrame, id_col: str = "doc_id", text: str = "text", min_chars: int = MIN_CHARS,
                        min_docs: int = MIN_DOCS, batches: int = BATCHES) -> DataFrame:
    """One row per input row: ``doc_id, n_lines, n_dropped, kept`` (the text
    of the lines that stay, joined by a newline).

    A null or empty text is one empty line. Rows that repeat an id count as
    one document; a null id counts as the smallest. A line repeated inside a
    document stays or goes as a whole. Columns besides id and text are
    ignored. An empty table gives no rows.
    """
    drops = repeated_lines(docs, id_col, text, min_chars, min_docs, batches)
    # lines of a document bound this array
    gone = stage(drops.groupBy("_d", "_t").agg(F.array_sort(F.array_distinct(F.collect_list("pos"))).alias("gone")), "line-gone")
    rows = docs.select(F.col(id_col).alias("doc_id"), *row_keys(id_col, text), text_or_empty(text).alias("text"))
    if fits(gone, 24):  # then only the texts that lose lines are shuffled
        some = F.broadcast(gone.select("_d", "_t"))
        whole = rows.join(some, ["_d", "_t"], "left_anti").withColumn("gone", F.lit(None).cast("array<int>"))
        rows = rows.join(some, ["_d", "_t"], "left_semi").join(gone, ["_d", "_t"]).unionByName(whole)
    else:
        rows = rows.join(gone, ["_d", "_t"], "left")
    rows = rows.withColumn("ls", F.split("text", "\n", -1)).withColumn(
        "bounds", F.concat(F.array(F.lit(-1)), F.col("gone"), F.array(F.size("ls"))))
    # slices between dropped positions: linear in the lines of a document
    kept = F.expr("array_join(flatten(transform(sequence(0, size(gone)),"
                  " i -> slice(ls, bounds[i] + 2, bounds[i + 1] - bounds[i] - 1))), '\n')")
    return rows.select("doc_id", F.size("ls").cast("long").alias("n_lines"),
                       F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("n_dropped"),
                       F.when(F.col("gone").isNull(), F.col("text")).otherwise(kept).alias("kept"))
