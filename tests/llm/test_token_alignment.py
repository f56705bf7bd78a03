"""Token alignment against brute force, and long white space in byte ids."""

import random
from collections import Counter
from hashlib import sha256

import numpy as np
import public_tokenizers
import pytest
from sentencepiece import SentencePieceProcessor
from tokenizers import Tokenizer

from earnlens.llm import byte_tokens, token_alignment

RANKS, MODEL = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.path("piece_bpe_32k.model")
DOC = "doc_id long, text string, block string, pairs string, weights string"


@pytest.fixture(scope="module")
def own():
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    return t


def overlaps(a, b):
    starts = lambda e: [0, *e[:-1]]
    return [(i, j) for i, (s, e) in enumerate(zip(starts(a), a)) for j, (u, v) in enumerate(zip(starts(b), b)) if max(s, u) < min(e, v)]


def test_links_of_random_cuts():
    rng = random.Random(0)
    for _ in range(500):
        n = rng.randrange(1, 70)
        a, b = ([x for x in range(1, n) if rng.random() < rng.choice([.2, .6, 1])] + [n] for _ in "ab")
        left, right, last = token_alignment.aligned(np.array(a), np.array(b))
        assert list(zip(left, right)) == overlaps(a, b)
        assert list(last) == [a[i] == b[j] for i, j in zip(left, right)]
    left, right, last = token_alignment.aligned(np.arange(1, 5001), np.arange(1, 5001))
    assert list(left) == list(right) == list(range(5000)) and last.all()
    assert [len(x) for x in token_alignment.aligned(*[np.empty(0, dtype=np.int64)] * 2)] == [0, 0, 0]


TEXTS = [None, "", " ", "a", "The quick brown fox", "The quick brown fox", "naïve café — 東京 \U0001f600", "</s> <s> <|endoftext|>", "a  b\n\n\tc",
         "x▁y", "internationalisation unbelievably " * 30, "1234567 890", " 　 z", "The quick red fox " * 20, " " * 300, "\x00\x01"]


@pytest.mark.parametrize("block_bytes", [1, 1 << 20])
def test_against_brute_force(spark, own, block_bytes):
    sp = SentencePieceProcessor(model_file=MODEL)
    piece = lambda i: bytes([int(sp.id_to_piece(i)[1:-1], 16)]) if sp.is_byte(i) else sp.id_to_piece(i).replace("▁", " ").encode()
    inverse = {c: b for b, c in _byte_letters().items()}
    letters = {i: t for t, i in own.get_vocab().items()}
    want, held, best = [], Counter(), Counter()
    for text in TEXTS:
        a = own.encode(" " + (text or ""), add_special_tokens=False).ids
        b = sp.encode(text or "")
        a_bytes, b_bytes = [bytes(inverse[c] for c in letters[i]) for i in a], [piece(i) for i in b]
        whole = (" " + (text or "")).encode()
        if not text or b"".join(a_bytes) != whole or b"".join(b_bytes) != whole:
            want.append(None)
            continue
        ends = lambda parts: [sum(map(len, parts[:i + 1])) for i in range(len(parts))]
        a_ends, b_ends = ends(a_bytes), ends(b_bytes)
        links = [(a[i], b[j]) for i, j in overlaps(a_ends, b_ends)]
        common = sorted(set(a_ends) & set(b_ends))
        groups, low = [], 0
        for c in common:
            groups.append(tuple(",".join(str(x) for x, e in zip(ids, at) if low < e <= c) for ids, at in ((a, a_ends), (b, b_ends))))
            low = c
        held.update(set(links))
        want.append((a, b, links, groups))
    for (x, _), n in held.items():
        best[x] = max(best[x], n)
    df = spark.createDataFrame([(i, t, "a", "b", "c") for i, t in enumerate(TEXTS)], DOC)
    out = token_alignment.align_documents(df, RANKS, public_tokenizers.PATTERN, MODEL, with_groups=True, block_bytes=block_bytes)
    got = {r.doc_id: r for r in out.collect()}
    assert len(got) == len(TEXTS) and want[9] is None and sum(w is not None for w in want) > 10
    for i, w in enumerate(want):
        r = got[i]
        if w is None:
            assert tuple(r)[1:] == (0, 0, 0, 0, 0, 0, "", [])
            continue
        a, b, links, groups = w
        assert (r.n_a, r.n_b, r.n_groups, r.n_links) == (len(a), len(b), len(groups), len(links))
        assert r.groups_sha256 == sha256(";".join("|".join(g) for g in groups).encode()).hexdigest()
        assert r.n_best == sum(held[x] == best[x[0]] for x in links) and r.count_sum == sum(held[x] for x in links)
        assert [(",".join(map(str, g.a)), ",".join(map(str, g.b))) for g in r.groups] == groups


def test_pieces_of_words_are_the_texts_pieces():
    aligner = token_alignment.Aligner(RANKS, public_tokenizers.PATTERN, MODEL)
    sp, words, spelt = aligner.b, aligner.words, aligner.b_bytes
    rng = random.Random(1)
    parts = ["a", "é", " ", "  ", "\n", "\t", ",", ".", "the", " the", "漢", "\U0001f600", "\x00", "</s>", "\xa0", "  \n ", "▁"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(1, 14))) for _ in range(5000)]
    texts.append(" " * 3000 + "x" * 5000 + " " + "word " * 100)
    for text in texts:
        want = sp.encode(text)
        same = b"".join(spelt[i] for i in want) == (" " + text).encode()
        got = words.encode(text)
        assert (got is None) == (not same) and (got is None or got.tolist() == want)
        tokens, = aligner.tokens([text])
        assert tokens is None if not same else aligner.a.encoding.decode_bytes(tokens[0].tolist()) == (" " + text).encode()
    assert max(map(len, words)) <= token_alignment.LONGEST


def test_forgetting_words_changes_nothing(monkeypatch):
    monkeypatch.setattr(token_alignment, "REMEMBERED", 3)
    aligner = token_alignment.Aligner(RANKS, public_tokenizers.PATTERN, MODEL)
    text = "one two three four five six seven eight nine ten"
    for _ in range(3):
        assert aligner.words.encode(text).tolist() == aligner.b.encode(text)
    assert len(aligner.words) <= 3 and aligner.words.forgotten > 2


def test_words_that_the_pieces_change():
    """Words whose pieces spell something else have no tokens, remembered or not."""
    class Library:
        def encode(self, text):
            return [1] + [2] * (len(text) > 2)

        def get_piece_size(self):
            return 3

        def id_to_piece(self, i):
            return ["<unk>", "▁", "x"][i]

        def piece_to_id(self, piece):
            return 1

    words = token_alignment.WordPieces(Library(), [b"", b" ", b"x"])
    assert words.encode("abc") is None and words.encode("abc") is None
    assert words.encode("").tolist() == [1]


def _byte_letters():
    """The letters that stand for bytes in the vocabulary file."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + n) for n, b in enumerate(other)}


def test_empty_table_and_repeated_rows(spark):
    args = (RANKS, public_tokenizers.PATTERN, MODEL)
    assert token_alignment.align_documents(spark.createDataFrame([], DOC), *args).collect() == []
    df = spark.createDataFrame([(7, "twice", "", "", ""), (7, "twice", "", "", ""), (None, "once", "", "", "")], DOC)
    got = sorted((r.doc_id or 0, r.n_links, r.count_sum, r.groups) for r in token_alignment.align_documents(df, *args).collect())
    assert [g[0] for g in got] == [0, 7, 7] and got[1] == got[2] and got[1][2] == 2 * got[1][1] and got[0][3] is None


def test_long_white_space_has_the_tokenizers_ids(own):
    ranks = byte_tokens.read_ranks(RANKS)
    encoder = byte_tokens.ByteEncoder(ranks, public_tokenizers.PATTERN)
    for text in (" " * 2_000_000 + "x", "\n" * 2_000_000, "\n \t" * 700_000 + "a", "a" + " \n" * 1_000_000 + " b"):
        assert encoder.ordinary(text) == own.encode(text, add_special_tokens=False).ids
    short = byte_tokens.ByteEncoder(ranks, public_tokenizers.PATTERN, long_blanks=4)
    rng = random.Random(2)
    parts = [" ", "\n", "\t", "a", "é", "　", "\x85", "\xa0", " ", "1", "!", "\x1c", "​", "<|endoftext|>", "᠎", "\r\n"]
    for _ in range(1500):
        text = "".join(rng.choice(parts) * rng.choice([1, 1, 2, 7, 20]) for _ in range(rng.randrange(8)))
        assert short.ordinary(text) == own.encode(text, add_special_tokens=False).ids
    given = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))  # its added token keeps its id
    added = byte_tokens.ByteEncoder(ranks, public_tokenizers.PATTERN, {"<|endoftext|>": 50256}, long_blanks=4)
    for text in ("a      <|endoftext|>      b", "<|endoftext|><|endoftext|>", "\n" * 9 + "<|endoftext|>", "plain"):
        assert added.encode(text) == given.encode(text, add_special_tokens=False).ids
