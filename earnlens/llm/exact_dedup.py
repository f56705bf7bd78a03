"""Exact deduplication by progressive refinement (DataFrame functions only).

Rows are grouped by length, then by the hash of a prefix; only groups with at
least two rows survive a level. The full hash decides among the survivors.
Two scans: the first yields lengths and prefix hashes, the second the full
hashes of survivors. Only hashes are ever shuffled, never texts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from earnlens.llm.common import SPACE, fresh, small_or_shuffle, stage, text_or_empty

#: Characters of the prefix that the second level hashes.
PREFIX_CHARS = 96


def normalised(text: str = "text") -> Column:
    """Each run of ASCII white space becomes one space; null becomes empty."""
    return F.regexp_replace(text_or_empty(text), SPACE, " ")


def surviving_heads(docs: DataFrame, text: str = "text", prefix: int = PREFIX_CHARS) -> DataFrame:
    """The (length, prefix hash) groups of at least two rows: ``n_len, head``."""
    t = docs.select(normalised(text).alias("t"))
    heads = stage(t.select(F.length("t").alias("n_len"),
                           F.xxhash64(F.substring("t", 1, prefix)).alias("head")), "exact-heads")
    # counted before any shuffle, so that a group of very many copies is one row
    counts = heads.groupBy("n_len", "head").agg(F.count("*").alias("n"))
    lengths = counts.groupBy("n_len").agg(F.sum("n").alias("all")).where("`all` > 1").select("n_len")
    return stage(counts.join(lengths, "n_len", "left_semi").where("n > 1").select("n_len", "head"), "exact-groups")


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text: str = "text",
                     hash_all: bool = False, prefix: int = PREFIX_CHARS) -> DataFrame:
    """One row per input row: ``doc_id, keep_id, group_size, kept, text_sha256``.

    Texts are equal if identical after :func:`normalised`. ``keep_id`` is the
    smallest id of the group. A row that repeats the kept id and text is a
    duplicate too: one of them stays (``copy`` 1). A null id counts as larger
    than all others; a group of null ids keeps one row. Empty and null texts
    form one group. Other columns are ignored. ``text_sha256`` is null for
    rows that no other row shares length and prefix with, unless ``hash_all``.
    An empty table gives no rows.
    """
    heads = surviving_heads(docs, text, prefix).withColumn("shared", F.lit(True))
    rows = docs.select(F.col(id_col).alias("doc_id"), normalised(text).alias("t"))
    rows = rows.select("doc_id", F.length("t").alias("n_len"),
                       F.xxhash64(F.substring("t", 1, prefix)).alias("head"), "t")
    right = small_or_shuffle(heads, 32)
    if hash_all or right is heads:
        # every hash is wanted, or texts would have to be shuffled: hash first
        rows = rows.select("doc_id", "n_len", "head", F.sha2("t", 256).alias("sha"))
        rows = rows.join(right, ["n_len", "head"], "left")
        if not hash_all:
            rows = rows.withColumn("sha", F.when(F.col("shared"), F.col("sha")))
    else:
        rows = rows.join(right, ["n_len", "head"], "left").select(
            "doc_id", "n_len", "head", "shared", F.when(F.col("shared"), F.sha2("t", 256)).alias("sha"))
    rows = stage(rows, "exact-hashes")

    alone = rows.where("shared is null").select(
        "doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"),
        F.lit(True).alias("kept"), F.col("sha").alias("text_sha256"))
    key = ["n_len", "sha"]
    same = rows.where("shared").groupBy(*key, "doc_id").agg(F.count("*").alias("n"))
    groups = same.groupBy(*key).agg(F.min("doc_id").alias("keep_id"), F.sum("n").alias("group_size"))
    groups = stage(groups, "exact-kept")
    # the hot group of copies is one key here: both sides are shuffles of their
    # own, so the adaptive skew join splits the side of single rows
    shared = same.join(groups, key).select(
        "doc_id", "keep_id", "group_size", F.explode(F.sequence(F.lit(1), F.col("n").cast("int"))).alias("copy"),
        F.col("sha").alias("text_sha256"))
    shared = shared.select("doc_id", "keep_id", "group_size",
                           (F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("copy") == 1)).alias("kept"),
                           "text_sha256")
    return alone.unionByName(shared)


def drop_exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns.

    Of rows that repeat an id and its text, one stays. Full hashes are made of
    survivors of the first two levels, and here of rows whose id is dropped
    somewhere; all others pass by their id.
    """
    found = stage(exact_duplicates(docs, id_col, text), "exact-found")
    dropped = stage(found.where("not kept").select("doc_id", "text_sha256").distinct(), "exact-dropped")
    both = found.where("kept").select("doc_id", "text_sha256").join(
        dropped, found["doc_id"].eqNullSafe(dropped["doc_id"])
        & (found["text_sha256"] == dropped["text_sha256"]), "left_semi")
    # rows that repeat the kept id and text cannot be told apart by a key
    repeated = bool(both.limit(1).count())
    own, gone_id, gone_sha = fresh(docs.columns, "_sha", "_gone", "_gone_sha")
    ids = small_or_shuffle(dropped.select(F.col("doc_id").alias(gone_id)).distinct(), 32)
    met = F.col(id_col).eqNullSafe(F.col(gone_id))
    untouched = docs.join(ids, met, "left_anti")
    out = docs.join(ids, met, "left_semi").withColumn(own, F.sha2(normalised(text), 256))
    if repeated:
        first = [F.first(c).alias(c) for c in docs.columns if c != id_col]
        out = out.groupBy(id_col, own).agg(*first).select(*docs.columns, own)
        twice = both.select(F.col("doc_id").alias("_id"), F.col("text_sha256").alias("_its"))
        dropped = dropped.join(twice, (F.col("text_sha256") == F.col("_its"))
                               & F.col("doc_id").eqNullSafe(F.col("_id")), "left_anti")
    gone = small_or_shuffle(dropped.select(F.col("doc_id").alias(gone_id), F.col("text_sha256").alias(gone_sha)), 112)
    kept = out.join(gone, (F.col(own) == F.col(gone_sha)) & met, "left_anti").select(*docs.columns)
    return untouched.unionByName(kept)
