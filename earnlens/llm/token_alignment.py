"""Alignment of two tokenizers' tokens by diagonal run skipping.

Both tokenizers cut the same bytes, so their tokens are told by where they
end. While ends agree at the current shift between the two index sequences,
tokens are one to one: exponential probing compares longer and longer slices
of the end arrays there, and a binary search finds where the stretch stops.
The irregular group that follows is resolved token by token and gives the next
shift. Every overlap of an A with a B token on the way is a link.

How many documents hold an id pair linked is counted over the whole corpus.
Documents form blocks of bounded bytes; a block lists its pairs once, the
lists are summed, and each block gets back the counts of its own pairs. So
no task or broadcast holds the pairs of the corpus.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from earnlens.llm.byte_tokens import ByteEncoder, read_ranks
from earnlens.llm.common import releasing, stage, text_or_empty

#: The space mark of B's pieces.
MARK = "▁"
#: Bytes of text of a block, about: a block ends with the document that fills it.
BLOCK_BYTES = 8 << 20
CODEC = "zstd"


#: Tokens of the first probe of a stretch.
FIRST_PROBE = 8


def aligned(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All links, in order, of tokens that end at ``a`` and ``b`` (ascending,
    with the same last end): indices into ``a`` and into ``b``, and whether the
    link is the last one of its group, because both tokens end alike."""
    x, y = a.tolist(), b.tolist()
    # slices of the end arrays, as bytes, compare at once
    raw_x, raw_y = (ends.astype("<i8").tobytes() for ends in (a, b))
    stay_x: list[int] = []  # links after which only B goes on to its next token
    stay_y: list[int] = []
    i = j = links = 0
    n = len(x)
    while i < n:
        at, step = i, FIRST_PROBE
        while i < n and raw_x[8 * i:8 * (i + step)] == raw_y[8 * j:8 * (j + step)]:
            i += step
            j += step
            step *= 2
        if i >= n:
            links += n - at
            break
        while step > 1:
            step //= 2
            if raw_x[8 * i:8 * (i + step)] == raw_y[8 * j:8 * (j + step)]:
                i += step
                j += step
        links += i - at
        u, v = x[i], y[j]
        while u != v:
            if u < v:
                stay_y.append(links)
                i += 1
                u = x[i]
            else:
                stay_x.append(links)
                j += 1
                v = y[j]
            links += 1
        links += 1
        i += 1
        j += 1
    every, last = np.arange(links), np.ones(links, dtype=bool)
    sides = []
    for stay in (stay_x, stay_y):
        still = np.zeros(links + 1, dtype=np.int64)
        still[np.array(stay, dtype=np.int64) + 1] = 1
        sides.append(every - np.cumsum(still)[:-1])
        last[stay] = False
    return *sides, last


#: Words whose pieces a task remembers, and the longest of them.
REMEMBERED, LONGEST = 400_000, 64
WORD = re.compile(" +[^ ]*")


class WordPieces(dict):
    """Words with the spaces before them to the bytes of their ids (32 bits
    each). No piece holds a space mark but at its beginning, so a text's pieces
    are those of its words, one after another; the library encodes each word
    once, and its pieces' bytes are compared with the word's once (``changed``)."""

    def __init__(self, library, piece_bytes: list[bytes]):
        super().__init__()
        self.library, self.bytes = library, piece_bytes
        self.changed: set[str] = set()
        self.forgotten = 0
        self.apart = not any(MARK in library.id_to_piece(i).lstrip(MARK) for i in range(library.get_piece_size()))
        self.space = np.array([library.piece_to_id(MARK)], dtype="<i4").tobytes()

    def __missing__(self, word: str) -> bytes:
        own = self.library.encode(word[1:]) if len(word) > 1 else None
        ids = np.array(own, dtype="<i4").tobytes() if own is not None else self.space
        if own is not None and b"".join(map(self.bytes.__getitem__, own)) != word.encode("utf-8", "surrogatepass"):
            self.changed.add(word)
        if len(word) <= LONGEST:
            if len(self) >= REMEMBERED:
                self.clear()
                self.changed.clear()
                self.forgotten += 1
            self[word] = ids
        return ids

    def encode(self, text: str) -> np.ndarray | None:
        """The ids of space + text; None where their bytes are not the text's."""
        if self.apart and MARK not in text:
            words, before = WORD.findall(" " + text), self.forgotten
            ids = list(map(self.__getitem__, words))
            if self.changed and not self.changed.isdisjoint(words):
                return None
            if self.forgotten == before:  # no changed word of this text can be forgotten
                return np.frombuffer(b"".join(ids), dtype="<i4").astype(np.int64)
        ids = self.library.encode(text)
        same = b"".join(map(self.bytes.__getitem__, ids)) == (" " + text).encode("utf-8", "surrogatepass")
        return np.array(ids, dtype=np.int64) if same else None


class Aligner:
    """Two vocabularies over the same bytes: A a byte-level BPE (rank file and
    pattern), B a piece model that puts a space before the text."""

    def __init__(self, ranks: str, pattern: str, model: str):
        from sentencepiece import SentencePieceProcessor
        table = read_ranks(ranks)
        self.a = ByteEncoder(table, pattern)
        self.b = SentencePieceProcessor(model_file=model)
        self.n_a, self.n_b = max(table.values()) + 1, self.b.get_piece_size()
        self.a_size = np.zeros(self.n_a, dtype=np.int64)
        for token, i in table.items():
            self.a_size[i] = len(token)
        pieces = map(self.b.id_to_piece, range(self.n_b))
        self.b_bytes = [bytes([int(p[1:-1], 16)]) if self.b.is_byte(i) else p.replace(MARK, " ").encode() for i, p in enumerate(pieces)]
        self.words = WordPieces(self.b, self.b_bytes)
        self.b_size = np.array(list(map(len, self.b_bytes)), dtype=np.int64)
        a, b = ([str(i) for i in range(n)] for n in (self.n_a, self.n_b))
        #: Ids as they are spelt inside and at the end of a group's two sides.
        self.spelt = [(x + end).encode() for ids, ends in ((a, ",|"), (b, ",;")) for end in ends for x in ids]

    def tokens(self, texts: list[str]) -> list[tuple[np.ndarray, np.ndarray] | None]:
        """Ids by A of space + text and by B of the text; None for an empty
        text and where the tokens' bytes are not those of space + text."""
        out = []
        for text in texts:
            b = self.words.encode(text) if text else None
            if b is None:
                out.append(None)
                continue
            # A's tokens spell any bytes, so that their sizes tell whether these are all
            a = np.array(self.a.encode(" " + text), dtype=np.int64)
            out.append((a, b) if self.a_size[a].sum() == self.b_size[b].sum() else None)
        return out

    def align(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The links (indices of A and B tokens) and which of them end a group."""
        return aligned(np.cumsum(self.a_size[a]), np.cumsum(self.b_size[b]))

    def spell(self, a: np.ndarray, b: np.ndarray, a_last: np.ndarray, b_last: np.ndarray) -> bytes:
        """``a1,a2|b1;a3|b2,b3``, from the ids and the last index of every group on both sides."""
        codes = np.empty(len(a) + len(b), dtype=np.int64)
        before = np.concatenate(([0], b_last[:-1] + 1))
        own = a.copy()
        own[a_last] += self.n_a
        codes[np.arange(len(a)) + np.repeat(before, np.diff(a_last, prepend=-1))] = own
        own = b + 2 * self.n_a
        own[b_last] += self.n_b
        codes[np.arange(len(b)) + np.repeat(a_last + 1, np.diff(b_last, prepend=-1))] = own
        return b"".join(map(self.spelt.__getitem__, codes.tolist()))[:-1]


DOCS = "array<struct<doc_id: bigint, n_a: bigint, n_b: bigint, n_groups: bigint, n_links: bigint, groups_sha256: string, size: bigint, " \
       "groups: array<struct<a: array<int>, b: array<int>>>>>"
BLOCKS = f"block long, pairs array<bigint>, held array<bigint>, docs {DOCS}, picks binary, times binary"
ARROW_GROUP = pa.struct([("a", pa.list_(pa.int32())), ("b", pa.list_(pa.int32()))])
ARROW_DOC = pa.struct([*((n, pa.int64()) for n in ("doc_id", "n_a", "n_b", "n_groups", "n_links")), ("groups_sha256", pa.string()),
                       ("size", pa.int64()), ("groups", pa.list_(ARROW_GROUP))])


def _packed(x: np.ndarray) -> bytes:
    raw = x.astype("<u4").tobytes()
    return len(raw).to_bytes(8, "little") + pa.compress(raw, codec=CODEC, asbytes=True)


def _unpacked(x: bytes) -> np.ndarray:
    size = int.from_bytes(x[:8], "little")
    raw = pa.decompress(x[8:], decompressed_size=size, codec=CODEC, asbytes=True) if size else b""
    return np.frombuffer(raw, dtype="<u4").astype(np.int64)


def _blocks(ranks: str, pattern: str, model: str, block_bytes: int, with_groups: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = Aligner(ranks, pattern, model)
        number, filled = TaskContext.get().partitionId() << 36, 0
        docs: list[dict] = []
        pairs: list[np.ndarray] = []
        times: list[np.ndarray] = []

        def block() -> pa.RecordBatch:
            nonlocal number, filled, docs, pairs, times
            every = np.concatenate(pairs) if pairs else np.empty(0, dtype=np.int64)
            found, pick, held = np.unique(every, return_inverse=True, return_counts=True)
            # a document's pairs ascend: steps between them are small numbers
            cuts = np.cumsum([d["size"] for d in docs])[:-1]
            steps = np.diff(pick, prepend=0)
            first = np.concatenate(([0], cuts))
            first = first[first < len(pick)].astype(np.int64)
            steps[first] = pick[first]
            out = pa.RecordBatch.from_arrays(
                [pa.array([number], pa.int64()), pa.array([found], pa.list_(pa.int64())), pa.array([held], pa.list_(pa.int64())),
                 pa.array([docs], pa.list_(ARROW_DOC)), pa.array([_packed(steps)], pa.binary()),
                 pa.array([_packed(np.concatenate(times) if times else every)], pa.binary())],
                names=["block", "pairs", "held", "docs", "picks", "times"])
            number, filled, docs, pairs, times = number + 1, 0, [], [], []
            return out

        for batch in batches:
            for at in range(0, batch.num_rows, 100):
                part = batch.slice(at, 100)
                texts = part.column("text").to_pylist()
                for doc, text, tokens in zip(part.column("doc_id").to_pylist(), texts, aligner.tokens(texts)):
                    row = dict.fromkeys(("n_a", "n_b", "n_groups", "n_links", "size"), 0)
                    row |= {"doc_id": doc, "groups_sha256": "", "groups": [] if with_groups else None}
                    if tokens is not None:
                        a, b = tokens
                        left, right, last = aligner.align(a, b)
                        found, n = np.unique(a[left] * aligner.n_b + b[right], return_counts=True)
                        a_last, b_last = left[last], right[last]
                        row |= {"n_a": len(a), "n_b": len(b), "n_groups": len(a_last), "n_links": len(left), "size": len(found),
                                "groups_sha256": sha256(aligner.spell(a, b, a_last, b_last)).hexdigest()}
                        if with_groups:
                            row["groups"] = [{"a": x, "b": y} for x, y in zip(np.split(a, a_last[:-1] + 1), np.split(b, b_last[:-1] + 1))]
                        pairs.append(found)
                        times.append(n)
                    docs.append(row)
                    filled += len(text)
                    if filled >= block_bytes:
                        yield block()
        if docs:
            yield block()
    return run


def _totals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["doc_id", "n_a", "n_b", "n_groups", "n_links"]
    for batch in batches:
        for i in range(batch.num_rows):
            one = batch.slice(i, 1)
            docs = one.column("docs").flatten()
            size = docs.field("size").to_numpy()
            stop = np.cumsum(size)
            steps, times = _unpacked(one.column("picks")[0].as_py()), _unpacked(one.column("times")[0].as_py())
            # running sums of the steps, begun anew with every document
            run = np.concatenate(([0], np.cumsum(steps)))
            pick = run[1:] - np.repeat(run[stop - size], size)
            weights = one.column("weights").flatten()
            sums = []
            for field in ("best", "count"):
                by_pair = weights.field(field).to_numpy(zero_copy_only=False).astype(np.int64)
                total = np.concatenate(([0], np.cumsum(times * by_pair[pick])))
                sums.append(pa.array(total[stop] - total[stop - size]))
            yield pa.RecordBatch.from_arrays([*(docs.field(n) for n in names), *sums, docs.field("groups_sha256"), docs.field("groups")],
                                             names=[*names, "n_best", "count_sum", "groups_sha256", "groups"])


def align_documents(docs: DataFrame, ranks: str, pattern: str, model: str, id_col: str = "doc_id", text: str = "text",
                    with_groups: bool = False, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row per input row: ``doc_id, n_a, n_b, n_groups, n_links, n_best,
    count_sum, groups_sha256, groups``.

    A is the byte-level BPE of ``ranks`` and ``pattern``, B the piece
    ``model``. Groups are the least stretches that both cut alike; they are
    returned (ids of both sides) if ``with_groups``, otherwise null. A pair's
    count is the number of rows that hold it linked; ``count_sum`` adds it over
    a row's links, and ``n_best`` counts the links whose count is the highest of
    their A id. Null and empty texts, and texts that B changes, have no tokens:
    zeros and ''. Rows that repeat are each counted and returned; a null id
    stays null; other columns are ignored; an empty table gives no rows.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text).alias("text"))
    blocks = stage(rows.mapInArrow(releasing(_blocks(ranks, pattern, model, block_bytes, with_groups)), BLOCKS), "align-blocks")
    n_b = _piece_count(model)
    counts = blocks.select(F.explode(F.arrays_zip("pairs", "held")).alias("p")).select("p.*") \
        .groupBy(F.col("pairs").alias("pair")).agg(F.sum("held").alias("count"))
    # an A id meets at most as many ids as B has
    own = Window.partitionBy(F.floor(F.col("pair") / n_b))
    counts = stage(counts.withColumn("best", F.col("count") == F.max("count").over(own)), "align-counts")
    held = blocks.select("block", F.explode("pairs").alias("pair")).join(counts, "pair")
    weights = held.groupBy("block").agg(F.array_sort(F.collect_list(F.struct("pair", "count", "best"))).alias("weights"))
    met = blocks.select("block", "docs", "picks", "times").join(weights, "block", "left")
    met = met.select("docs", "picks", "times", F.coalesce("weights", F.array().cast("array<struct<pair: bigint, count: bigint, best: boolean>>")).alias("weights"))
    return met.mapInArrow(releasing(_totals), "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, "
                                              "groups_sha256 string, groups array<struct<a: array<int>, b: array<int>>>")


def _piece_count(model: str) -> int:
    from sentencepiece import SentencePieceProcessor
    return SentencePieceProcessor(model_file=model).get_piece_size()
