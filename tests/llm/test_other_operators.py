"""Extraction, scoring, formatting, packing, search and encoding operators."""

import hashlib
import itertools
import random
import zlib

import numpy as np
import pytest
import public_tokenizers
from pyspark.sql import functions as F

from earnlens.llm import chat, html_extract, packing, pieces, queries, topk_search, toxicity

DOC = "doc_id long, text string, score string, bin string, length string"


def table(spark, texts, ids=None):
    ids = range(len(texts)) if ids is None else ids
    return spark.createDataFrame([(i, t, "x", "y", "z") for i, t in zip(ids, texts)], DOC)


# -- 1 pages

def extract(spark, pages):
    rows = [(i, u, h, "x", "y") for i, (u, h) in enumerate(pages)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, host string, wrapper string")
    return {r.page_id: r.text for r in html_extract.extract_main_text(df).collect()}


def page(title, paragraphs, extra=""):
    body = "".join(f"<p>{p}</p>" for p in paragraphs)
    return (f"<html><head><title>t</title><script>var a='<p>no</p>'</script></head><body><nav><a href=/>Menu</a></nav>"
            f"<div class='ad'>Buy {title}</div><article><h1>{title}</h1>{body}{extra}</article>"
            f"<div id='comments'><p>nice {title}</p></div><aside>more {title}</aside><footer>&copy; {title}</footer></body></html>")


def test_article_without_its_surroundings(spark):
    got = extract(spark, [("http://a.org/1", page("One &amp; two", ["a\n  b<b>c</b>", "d&nbsp;e &lt;f&gt;"])),
                          ("http://a.org/2", page("Three", ["g"])), ("http://b.org", None), ("http://b.org/x", ""), (None, "plain")])
    assert got == {0: "One & two\na bc\nd e <f>", 1: "Three\ng", 2: "", 3: "", 4: "plain"}


def test_constant_nodes_are_template_and_varying_ones_content(spark):
    """A host without marked regions: alignment tells the slots."""
    def bare(i):
        return (f"<body><div class=x><div class=top>The same on every page</div><div class=text><p>story {i} begins</p>"
                f"<p>and goes on {i * 7}</p></div><div class=box>Call us now</div></div>"
                f"<div class=list><a href=1>link {i}</a> <a href=2>link {i + 1}</a></div></body>")
    got = extract(spark, [(f"http://c.org/{i}", bare(i)) for i in range(8)] + [("http://d.org/", bare(3))])
    assert got[2] == "story 2 begins\nand goes on 14"
    assert "story 3 begins" in got[8]  # one page shows no template


def test_broken_pages(spark):
    whole = page("T", ["one", "two"])
    pages = [("http://a.org/", whole[:i]) for i in range(0, len(whole), 7)] + [
        ("http://a.org/", "<div>" * 5000 + "deep"), ("http://a.org/", "<p>a<p>b<br>c</p></p></div><b>d"), ("http://a.org/", "a < b &am &amp x <")]
    got = extract(spark, pages)
    n = len(pages)
    assert (got[n - 3], got[n - 2], got[n - 1]) == ("deep", "a\nb c\nd", "a < b &am & x <")


def test_tree_matching():
    leaf = lambda k, *c: [k, False, False, 1, 0, 0, 0, list(c)]
    a = leaf("div", leaf("h1"), leaf("p"), leaf("ul", leaf("li")))
    b = leaf("div", leaf("p"), leaf("table"), leaf("ul", leaf("li"), leaf("li2")))
    assert html_extract.match_score(a, b) == 4  # div, p, ul, li
    assert html_extract.align(a[7], b[7]) == [(0, None), (1, 0), (None, 1), (2, 2)]


# -- 2 toxicity

def test_marginals_against_enumeration():
    rng = np.random.default_rng(0)
    lengths = np.array([3, 0, 6, 1])
    e = rng.normal(size=lengths.sum())
    model = toxicity.ToxicityModel(None, 0.3, (-1.0, 0.4, 0.7))
    step = np.array([[0, -1.0], [0.4, 0.7]])
    want, at = [], 0
    for n in lengths:
        weights = {}
        for y in itertools.product((0, 1), repeat=int(n)) if n else ():
            s = 0.3 * y[0] + sum(e[at + i] * y[i] for i in range(n)) + sum(step[y[i - 1], y[i]] for i in range(1, n))
            weights[y] = np.exp(s)
        want += [sum(w for y, w in weights.items() if y[i]) / sum(weights.values()) for i in range(n)]
        at += n
    assert np.allclose(model.marginals(e, lengths), want)


def test_held_out_accuracy_and_spans(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    rows = queries.op2_toxicity(spark, "/root/testdata/sf0.01").join(labels, "doc_id").where("held_out").collect()
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in rows)
    assert not [r for r in rows if r.predicted and not r.toxic]
    ranks = sum((a.score > b.score) + 0.5 * (a.score == b.score) for a in rows for b in rows if a.toxic and not b.toxic)
    toxic = sum(r.toxic for r in rows)
    assert ranks / (toxic * (len(rows) - toxic)) > 0.85
    text = {r.doc_id: r.text for r in docs.collect()}
    flagged = [text[r.doc_id][s.start:s.stop] for r in rows if r.predicted for s in r.toxic_spans]
    assert flagged and not any(" " in f for f in flagged)


def test_toxicity_edges(spark):
    ids = list(range(60))
    texts = [f"some words here {i} " + ("idiot trash" if i % 3 == 0 else "fine") for i in ids] + [None, "", " \n"]
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in ids] + [(None, 1), (5, None), (70, 1)], "doc_id long, toxic int")
    docs = table(spark, texts + ["idiot " * 20000, "idiot"], [*ids, 100, 101, None, 103, 104])
    model = toxicity.fit(docs, labels)
    got = {r.doc_id: r.score for r in toxicity.score(docs, model).collect()}
    assert got[100] == got[101] == got[None] < 0.5 < min(got[103], got[104])
    kept = toxicity.drop_toxic(docs, model, 0.5)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == {i for i in ids if i % 3} | {100, 101, None}
    nothing = toxicity.fit(docs, labels.limit(0))
    assert {r.score for r in toxicity.score(docs, nothing).collect()} == {0.5}
    assert toxicity.score(docs.limit(0), model).count() == 0


# -- 3 chats

def brute_fold(events):
    """The log folded one event after another, conversation by conversation."""
    out = {}
    order = sorted(events, key=lambda e: (e[2], e[3] != chat.OPEN, e[3], e[4] or "", e[5] or ""))
    for conv, message, seq, kind, role, text in order:
        m = out.setdefault((conv, message), {"seq": seq, "role": None, "text": "", "alive": False})
        if kind == chat.RETRACT:
            m.update(alive=False, text="")
            continue
        if kind == chat.OPEN and not m["alive"]:
            m.update(role=None, text="")
        if kind in (chat.EDIT, chat.REGENERATE):
            m["text"] = ""
        m["alive"] = True
        m["role"] = role if m["role"] is None else m["role"]
        m["text"] += text or ""
    return sorted((c, i, m["seq"], m["role"] or "", m["text"]) for (c, i), m in out.items() if m["alive"])


@pytest.mark.parametrize("seed", [1, 2])
def test_fold_against_brute_force(spark, seed):
    r = random.Random(seed)
    events, seq = [], 0
    for _ in range(400):
        seq += 1
        conv, message = r.randrange(4), f"m{r.randrange(6)}"
        kind = r.choice([chat.OPEN, chat.DELTA, chat.DELTA, chat.DELTA, chat.EDIT, chat.REGENERATE, chat.RETRACT])
        events.append((conv, message, seq, kind, r.choice(["user", "assistant", None]), r.choice([None, "", "a", "</s>", "b\\"])))
    df = spark.createDataFrame(events, "conv_id long, message_id string, seq long, kind string, role string, text string")
    got = chat.fold_events(df).collect()
    assert sorted((x.conv_id, x.message_id, x.seq, x.role, x.text) for x in got) == brute_fold(events)


def test_escape_round_trip():
    r = random.Random(3)
    parts = [*chat.CONTROLS, "\\", "<", "[", "s>", "/s>", "\\\\", "a", "INST]", "\n", "é"]
    for _ in range(3000):
        text = "".join(r.choice(parts) for _ in range(r.randrange(8)))
        role = "".join(r.choice(parts) for _ in range(r.randrange(3)))
        segment, a, b = chat.render(role, text)
        assert chat.parse(segment) == (role, text) and chat.unescape(segment[a:b]) == text
        assert not any(c in chat.escape(text) for c in chat.CONTROLS)


def test_read_back(spark):
    rows = [(1, 0, "user", "hi"), (1, 1, "assistant", "[INST]\\"), (1, 1, "assistant", "[INST]\\"), (1, None, None, None),
            (None, 0, "user", "x" * 100000), (2, 5, "assistant", "")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r.conv_id: r for r in chat.read_back(chat.format_chats(chat.fold_events(chat.turns_as_events(df)))).collect()}
    digest = lambda s: hashlib.sha256(s.encode()).hexdigest()
    assert got[1].n_turns == 4 and got[1].loss_chars == 14
    assert got[1].turns_sha256 == digest("\n\nuser\nhi\n" + "assistant\n[INST]\\\n" * 2)
    assert got[1].loss_sha256 == digest("[INST]\\" * 2)
    assert (got[2].loss_chars, got[2].n_turns, got[None].n_turns) == (0, 1, 1)
    assert chat.read_back(chat.format_chats(chat.fold_events(chat.turns_as_events(df.limit(0))))).count() == 0


# -- 4 packing

def brute_best_fit(sizes, capacity):
    fills = []
    for s in sorted(sizes, reverse=True):
        room = [f for f in fills if f + s <= capacity]
        if room:
            fills[fills.index(max(room))] += s
        else:
            fills.append(s)
    return sorted(fills)


def test_best_fit():
    r = random.Random(4)
    for _ in range(50):
        sizes = np.array([r.randrange(1, 101) for _ in range(r.randrange(1, 80))])
        bins, offsets, fills = packing.best_fit(sizes, 100)
        assert sorted(fills.tolist()) == brute_best_fit(sizes.tolist(), 100)
        for b in range(len(fills)):
            own = sorted(zip(offsets[bins == b], sizes[bins == b]))
            assert [o for o, _ in own] == [sum(s for _, s in own[:i]) for i in range(len(own))]


def test_packing_in_rounds(spark):
    r = random.Random(5)
    lengths = [r.choice([1, 30, 400, 700, 1100, 2048, r.randrange(1, 2049)]) for _ in range(3000)]
    df = spark.createDataFrame(list(enumerate(lengths)), "doc_id long, length long").repartition(8)
    rows = packing.pack(df, unit_rows=40).collect()  # many units, several rounds
    by = {}
    for x in rows:
        by.setdefault(x.sequence_id, []).append((x.offset, x.length))
    assert sorted(x.doc_id for x in rows) == list(range(3000))
    for own in by.values():
        own.sort()
        assert [o for o, _ in own] == [sum(s for _, s in own[:i]) for i in range(len(own))] and sum(s for _, s in own) <= 2048
    assert len(by) <= 1.02 * len(brute_best_fit(lengths, 2048))


def test_pieces_against_the_tokenizer(spark):
    from tokenizers import Tokenizer
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    texts = [None, "", " ", "a b\x85c 　d ½ Ⅷ don't\r\n\t x​ <|endoftext|> क्षि \U0001F468‍", "long word " * 3000, "a" * 70000]
    want = {}
    for i, x in enumerate(texts):
        ids = np.array([*t.encode(x or "", add_special_tokens=False).ids, 0], dtype="<u4")
        first = len(ids) % 2048 or 2048
        cuts = [0, *range(first, len(ids) + 1, 2048)]
        for p, (a, b) in enumerate(zip(cuts, cuts[1:])):
            want[i, p] = (a, b - a, zlib.crc32(ids[a:b].tobytes()))
    got = queries.pack_documents(table(spark, texts)).collect()
    assert {(r.doc_id, r.piece): (r.start, r.length, r.ids_crc32) for r in got} == want
    assert queries.pack_documents(table(spark, []).limit(0)).count() == 0


# -- 7 search

@pytest.mark.parametrize("dim,scale", [(3, 5), (16, 40), (4, 10 ** 8)])
def test_top_k_against_brute_force(spark, dim, scale, monkeypatch):
    monkeypatch.setattr(topk_search, "LEAF", 8)
    r = np.random.default_rng(dim)
    rows = [(i, [int(x) for x in r.integers(-scale, scale + 1, dim)]) for i in range(300)]
    rows += [(300 + i, rows[i % 7][1]) for i in range(60)]  # ties
    rows += [(500, [1] * (dim + 1)), (501, [2] * (dim + 1)), (502, None), (503, []), (None, [1] * dim)]
    df = spark.createDataFrame(rows, "id long, v array<long>")
    got = topk_search.top_k(df, df.where("id % 20 = 0"), 5, shard_rows=64, block_rows=7, lane=2).collect()
    want = []
    for q, a in rows:
        if q is None or q % 20 or not a:
            continue
        scores = sorted((-sum(x * y for x, y in zip(a, b)), v) for v, b in rows if v is not None and b and len(b) == len(a) and v != q)
        want += [(q, n, v, -s) for n, (s, v) in enumerate(scores[:5], 1)]
    assert sorted(map(tuple, got)) == sorted(want)
    assert topk_search.top_k(df.limit(0), df, 5).count() == 0


# -- 9 pieces

def brute_path(v, chars):
    best, back = [0.0] + [-np.inf] * len(chars), [None] * (len(chars) + 1)
    for e in range(1, len(chars) + 1):
        for s in range(e):
            hit = v.score.get(chars[s:e])
            if hit and best[s] + hit[1] > best[e]:
                best[e], back[e] = best[s] + hit[1], (s, [hit[0]])
        if best[e - 1] + v.unknown > best[e]:
            best[e], back[e] = best[e - 1] + v.unknown, (e - 1, v.bytes_of(chars[e - 1]))
    out, e = [], len(chars)
    while e:
        s, ids = back[e]
        out, e = ids + out, s
    return out


def test_viterbi_against_brute_force():
    v = pieces.load(public_tokenizers.path("piece_bpe_32k.model"))
    r = random.Random(6)
    for _ in range(400):
        text = "".join(r.choice(["ab", " ", "  ", "\n", "▁", "é", "\U0001F600", " the", "tion", "x", "\x00"]) for _ in range(r.randrange(40)))
        want = []
        for n, part in enumerate(text.split("▁") if text else []):
            want += (v.bytes_of("▁") if n else []) + brute_path(v, ("" if n else "▁") + part.replace(" ", "▁"))
        assert v.encode(text) == want and v.decode(want) == text


def test_stream_commits_early():
    """One long stretch without a place that no piece spans: ids come while
    the text is still being read, and equal those of the whole search."""
    words = ["a", "b", "ab", "aba", "bab", "abab▁", "▁a", "a▁b"]
    v = pieces.Vocabulary([(w, -float(i + 1)) for i, w in enumerate(words)] + [("", -np.inf)] * 256, {b: len(words) + b for b in range(256)})
    assert v.stretch is None  # a piece holds a mark inside
    r = random.Random(7)
    chars = "".join(r.choice("ab▁c") for _ in range(500))
    assert list(v.stream(chars)) == brute_path(v, chars)

    class Reader(str):
        furthest = 0

        def __getitem__(self, at):
            Reader.furthest = max(Reader.furthest, at if isinstance(at, int) else 0)
            return str.__getitem__(self, at)

    next(v.stream(Reader(chars)))
    assert Reader.furthest < 100


def test_piece_documents(spark):
    model = public_tokenizers.path("piece_bpe_32k.model")
    texts = [None, "", " a  b ", "▁ \t\n", "word " * 30000, "\U0001F600" * 50]
    rows = pieces.encode_documents(table(spark, texts), model)
    assert all(r.round_trip and r.n_ids == len(r.ids) for r in rows.collect())
    back = {r.doc_id: r.text for r in pieces.decode_documents(rows, model).collect()}
    assert back == {i: t or "" for i, t in enumerate(texts)}
    assert pieces.encode_documents(table(spark, []).limit(0), model).count() == 0


# -- queries

def test_every_query_has_its_columns(spark):
    from earnlens.llm.queries import QUERIES
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))
    held = queries.op2_toxicity(spark, "/root/testdata/sf0.001").select("doc_id", "held_out").collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in held)
    assert queries.op7_topk_search(spark, "/root/testdata/sf0.001").agg(F.max("rank")).first()[0] == 20


def test_copies_of_a_page_are_no_template(spark):
    """Copies of an article beside a page without paragraphs, and a host of
    copies only."""
    pages = [("http://a.org/x", page("Same", ["copied text"]))] * 6 + [("http://a.org/y", page("Other", []))] + \
            [("http://b.org/", page("Same", ["copied text"]))] * 6
    assert set(extract(spark, pages).values()) == {"Same\ncopied text", "Other"}
