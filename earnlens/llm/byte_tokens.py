"""Byte-level BPE ids of whole texts, also of texts with very long white space.

The pattern that cuts a text into words looks ahead after a run of white space
and gives up on runs of about a million characters. Its cut there is known
without looking: white space up to the last character before a word (or up to
the text's end) is one piece, and the rest goes on from that last character.
"""

from __future__ import annotations

import re
from base64 import b64decode

from tiktoken import Encoding

#: Unicode white space, as the pattern's ``\\s`` takes it.
BLANK = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: Runs of so many blanks are cut without the pattern.
LONG_BLANKS = 10_000


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {b64decode(a): int(b) for a, b in map(bytes.split, f)}


class ByteEncoder:
    """Ids by a rank file and a word pattern; ``added`` tokens (token to id) in
    a text split it and become their ids, without them they are ordinary text."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, added: dict[str, int] | None = None, long_blanks: int = LONG_BLANKS):
        self.encoding = Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.added = added or {}
        self.split = re.compile("(" + "|".join(map(re.escape, sorted(self.added, key=len, reverse=True))) + ")") if self.added else None
        self.blanks = re.compile(f"[{BLANK}]{{{long_blanks},}}")

    def ordinary(self, text: str) -> list[int]:
        out, at = [], 0
        for run in self.blanks.finditer(text):
            stop = run.end() if run.end() == len(text) else run.end() - 1
            out += self.encoding.encode_ordinary(text[at:run.start()])
            out += self.encoding._encode_single_piece(text[run.start():stop])
            at = stop
        return out + self.encoding.encode_ordinary(text[at:]) if at else self.encoding.encode_ordinary(text)

    def encode(self, text: str) -> list[int]:
        if self.split is None or self.split.search(text) is None:
            return self.ordinary(text)
        out = []
        for part in self.split.split(text):
            if part in self.added:
                out.append(self.added[part])
            elif part:
                out += self.ordinary(part)
        return out
