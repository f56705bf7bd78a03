"""Wrappers of more nodes than a worker holds of one."""

import pandas as pd
import pyarrow as pa
from earnlens.llm import html_extract

LETTERS = "abcdefghij"


def name(i):
    return "z" + "".join(LETTERS[int(c)] for c in str(i))


def story(i):
    """Its last box is the same on the first pages and varies later."""
    return (f"<body><div class=x><div class=top>The same on every page</div><div class=text><p>story {i}</p></div>"
            f"<div class={name(i)}>token {i}</div><div class=last>{'seen' if i < 8 else f'told {i}'}</div></div></body>")


def sitemap(n):
    return "<body><div class=x>" + "".join(f"<div class={name(10 ** 6 + i)}>place {i}</div>" for i in range(n)) + "</div></body>"


def extract(spark, pages):
    df = spark.createDataFrame([(i, "http://h.org/", p) for i, p in enumerate(pages)], "page_id long, url string, html string")
    return {r.page_id: r.text for r in html_extract.extract_main_text(df.coalesce(1)).collect()}


def test_pages_after_a_large_one_count(spark):
    n = html_extract.NODES_HELD + 10
    got = extract(spark, [sitemap(n), *[story(i) for i in range(40)]])
    assert got[0].count("\n") == n - 1
    assert got[3] == "story 2\ntoken 2\nseen" and got[31] == "story 30\ntoken 30\ntold 30"


def test_a_host_of_ever_new_names(spark):
    pages = [story(i) + sitemap(30).replace("class=z", f"class=y{name(i)}z") for i in range(300)]
    got = extract(spark, pages)
    for i in (3, 7, 8, 299):
        lines = got[i].split("\n")
        assert lines[:3] == [f"story {i}", f"token {i}", "seen" if i < 8 else f"told {i}"] and len(lines) == 33


def test_partial_wrappers_hold_every_page():
    pages = [story(i) + sitemap(30).replace("class=z", f"class=y{name(i)}z") for i in range(300)]
    batch = pa.RecordBatch.from_pydict({"host": ["h"] * 300, "html": pages})
    rows = pd.concat(b.to_pandas() for b in html_extract._induce(iter([batch])))
    assert len(rows) > 1
    whole = html_extract._load_pair(html_extract._merge_hosts(rows).wrapper[0])[0]
    found = []

    def walk(w):
        found.append(w)
        for c in w[html_extract.CHILDREN]:
            walk(c)
    walk(whole)
    chars = sum(w[html_extract.CHARS] for w in found)
    assert chars == sum(u for p in pages for u in [sum(len(t) for t in html_extract.own_text(html_extract.parse(p)))])
    assert {w[html_extract.KEY] for w in found} >= {f"div.{name(i)}" for i in range(300)}
