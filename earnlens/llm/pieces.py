"""SentencePiece encoding and decoding by a streaming Viterbi search.

The encoder reads a text character by character and keeps the best path to
each of the last positions, as many as the longest piece has characters. Once
all paths that survive run through one boundary, the ids up to it are
committed and forgotten, so memory does not grow with the text. Where no piece
of the vocabulary can span a place (before a space mark that follows other
characters, or beside a character of no longer piece), all paths converge by
construction; the stretches between such places are remembered.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from hashlib import sha256
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from earnlens.llm.common import releasing, text_or_empty

#: The space mark of the pieces.
MARK = "▁"
#: A character that no piece covers costs this much more than the worst piece.
UNKNOWN_PENALTY = 10.0
#: Scores below this mark pieces that are never to be used.
UNUSED_SCORE = -1e8
#: Stretches that a task remembers, and the longest of them.
REMEMBERED, LONGEST = 600_000, 48
#: Pairs of a word character and a sign that pieces may hold, for stretches to end between the two.
MOST_BRIDGES = 200


class Memory(dict):
    """Stretches to the bytes of their ids (32 bits each), found on first use."""

    def __init__(self, search):
        super().__init__()
        self.search = search

    def __missing__(self, stretch: str) -> bytes:
        ids = np.fromiter(self.search(stretch), dtype="<u4").tobytes()
        if len(stretch) <= LONGEST:
            if len(self) >= REMEMBERED:
                self.clear()
            self[stretch] = ids
        return ids


class Vocabulary:
    """Pieces with their scores; byte pieces stand for any other character."""

    def __init__(self, pieces: list[tuple[str, float]], byte_ids: dict[int, int], texts: list[str] | None = None):
        """``pieces`` by id; ids that are no ordinary piece have a score of
        ``-inf``. ``byte_ids`` gives the id of each byte."""
        used = [s for p, s in pieces if s > UNUSED_SCORE]
        self.unknown = min(used, default=0.0) - UNKNOWN_PENALTY
        # a character that is itself an unused piece costs what bytes cost
        self.score = {p: (i, self.unknown if s <= UNUSED_SCORE and len(p) == 1 else s)
                      for i, (p, s) in enumerate(pieces) if s > -np.inf}
        self.byte_ids = [byte_ids[b] for b in range(256)]
        self.byte_of = {i: b for b, i in byte_ids.items()}
        self.longest = max(map(len, self.score), default=1)
        #: Pieces by their characters from the last to the first: a node is
        #: [id or -1, score, next nodes].
        self.ends: dict[str, list] = {}
        for p, (i, cost) in self.score.items():
            level = self.ends
            for n, char in enumerate(reversed(p), 1):
                node = level.setdefault(char, [-1, 0.0, {}])
                if n == len(p):
                    node[0], node[1] = i, cost
                level = node[2]
        self.longest = max(map(len, self.score), default=1)
        lengths: dict[str, set[int]] = {}
        for p in self.score:
            if len(p) > 1:
                lengths.setdefault(p[-2:], set()).add(len(p))
        #: Lengths of the pieces that end in two characters, the longest first.
        self.lengths = {k: tuple(sorted(v, reverse=True)) for k, v in lengths.items()}
        self.text = [p.replace(MARK, " ") if p in self.score else "" for p, _ in pieces]
        #: Neighbouring characters that some piece holds; a place between any
        #: other two is spanned by no piece.
        inside = {x + y for p in self.score for x, y in zip(p, p[1:])}
        joined = {c for pair in inside for c in pair} - {MARK}
        words = {c for c in joined if c.isalnum()}
        kinds = [c for c in (words, joined - words) if c]
        runs = "(?:" + "|".join("[" + "".join(map(re.escape, sorted(c))) + "]+" for c in kinds) + ")" if kinds else "(?!)"
        # words and signs are run together at the pairs of the two only
        across = sorted(x + y for x, y in inside if MARK not in (x, y) and (x in words) != (y in words))
        bridge = "|".join(f"(?<={re.escape(x)})(?={re.escape(y)})" for x, y in across)
        if len(across) > MOST_BRIDGES:
            runs, bridge = "[" + "".join(map(re.escape, sorted(joined))) + "]+", ""
        run = runs + (f"(?:(?:{bridge}){runs})*" if bridge else "")
        inner = any(MARK in p.lstrip(MARK) for p in self.score)
        #: Stretches that no piece leaves.
        self.stretch = None if inner else re.compile(f"{MARK}+(?:{run})?|{run}|.", re.S)
        self.memory = Memory(self.stream)

    def bytes_of(self, char: str) -> list[int]:
        return [self.byte_ids[b] for b in char.encode("utf-8", "surrogatepass")]

    def stream(self, chars: str) -> Iterator[int]:
        """The ids of the best path through ``chars``, as they are committed.
        Of paths of one score, the one whose last piece is longer wins."""
        best, back, ids = [0.0], [0], [-1]  # by position, from the last commit on
        base, ends, unknown = 0, self.ends.get, self.unknown
        for end in range(1, len(chars) + 1):
            at = end - base - 1
            top, start_at, by = best[at] + unknown, end - 1, -1  # bytes
            node = ends(chars[end - 1])
            while node is not None:
                if node[0] >= 0:
                    s = best[at] + node[1]
                    if s >= top:
                        top, start_at, by = s, at + base, node[0]
                at -= 1
                if at < 0:
                    break
                node = node[2].get(chars[at + base])
            best.append(top)
            back.append(start_at)
            ids.append(by)
            if end == len(chars) or not end % self.longest:
                # follow the surviving paths back until they are one
                live = set(range(max(base, end - self.longest + 1), end + 1)) if end < len(chars) else {end}
                while len(live) > 1:
                    late = max(live)
                    live.remove(late)
                    live.add(back[late - base])
                meet = live.pop()
                if meet > base:
                    path, at = [], meet
                    while at > base:
                        path.append(at)
                        at = back[at - base]
                    for at in reversed(path):
                        i = ids[at - base]
                        if i >= 0:
                            yield i
                        else:
                            yield from self.bytes_of(chars[at - 1])
                    best, back, ids = best[meet - base:], back[meet - base:], ids[meet - base:]
                    base = meet

    def encode_bytes(self, text: str) -> bytes:
        """The ids of a text, 32 bits each. A space mark in the text itself is
        spelt in bytes, so that every text can be restored."""
        if not text:
            return b""
        out: list[bytes] = []
        for n, part in enumerate(text.split(MARK)):
            if n:
                out.append(np.array(self.bytes_of(MARK), dtype="<u4").tobytes())
            chars = (MARK if not n else "") + part.replace(" ", MARK)
            if self.stretch is None:
                out.append(np.fromiter(self.stream(chars), dtype="<u4").tobytes())
            else:
                out.extend(map(self.memory.__getitem__, self.stretch.findall(chars)))
        return b"".join(out)

    def encode(self, text: str) -> list[int]:
        return np.frombuffer(self.encode_bytes(text), dtype="<u4").tolist()

    def decode(self, ids: list[int]) -> str:
        """The text of ids; bytes that are no UTF-8 become replacement marks."""
        if self.byte_of.keys().isdisjoint(ids):
            text = "".join(map(self.text.__getitem__, ids))
        else:
            out, run = [], bytearray()
            for i in ids:
                b = self.byte_of.get(i)
                if b is not None:
                    run.append(b)
                    continue
                if run:
                    out.append(run.decode("utf-8", "replace"))
                    run.clear()
                out.append(self.text[i])
            text = "".join(out) + run.decode("utf-8", "replace")
        return text[1:] if text[:1] == " " else text


def load(model: str) -> Vocabulary:
    """The vocabulary of a model file with byte fallback, with its own scores."""
    from sentencepiece import SentencePieceProcessor
    sp = SentencePieceProcessor(model_file=model)
    ids = range(sp.get_piece_size())
    plain = lambda i: not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))
    return Vocabulary([(sp.id_to_piece(i), sp.get_score(i) if plain(i) else -np.inf) for i in ids],
                      {int(sp.id_to_piece(i)[1:-1], 16): i for i in ids if sp.is_byte(i)})


def _encode(model: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = load(model)
        for batch in batches:
            for i in range(0, batch.num_rows, 500):
                part = batch.slice(i, 500)
                ids, crc, digest, same = [], [], [], []
                for text in part.column("text").to_pylist():
                    raw = vocabulary.encode_bytes(text)
                    own = np.frombuffer(raw, dtype="<u4")
                    again = vocabulary.decode(own.tolist())
                    ids.append(own.astype(np.int32))
                    crc.append(crc32(raw))
                    digest.append(sha256(again.encode("utf-8", "surrogatepass")).hexdigest())
                    same.append(again == text)
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array([len(x) for x in ids], pa.int64()), pa.array(crc, pa.int64()),
                     pa.array(digest, pa.string()), pa.array(same, pa.bool_()), pa.array(ids, pa.list_(pa.int32()))],
                    names=["doc_id", "n_ids", "ids_crc32", "decoded_sha256", "round_trip", "ids"])
    return run


def encode_documents(docs: DataFrame, model: str, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per input row: ``doc_id, n_ids, ids_crc32, decoded_sha256,
    round_trip, ids``. The ids are decoded again; ``round_trip`` says whether
    that restores the text. Null and empty texts have no ids. Rows that repeat
    are each returned, other columns ignored; an empty table gives no rows."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text).alias("text"))
    return rows.mapInArrow(releasing(_encode(model)), "doc_id long, n_ids long, ids_crc32 long, decoded_sha256 string, "
                                           "round_trip boolean, ids array<int>")


def _decode(model: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = load(model)
        for batch in batches:
            texts = [vocabulary.decode(x or []) for x in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], names=["doc_id", "text"])
    return run


def decode_documents(encoded: DataFrame, model: str, id_col: str = "doc_id", ids: str = "ids") -> DataFrame:
    """``doc_id, text`` of rows with ``ids``; null ids are an empty text."""
    rows = encoded.select(F.col(id_col).cast("long").alias("doc_id"), F.col(ids).alias("ids"))
    return rows.mapInArrow(releasing(_decode(model)), "doc_id long, text string")
