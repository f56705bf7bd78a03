"""Main text of web pages by wrapper induction.

Every page becomes a small tree of its block elements (runs of like siblings
are one node). The trees of a host are aligned by simple tree matching and
merged into the host's wrappers, one of the pages that mark a main region and
one of the others. A wrapper counts, for each node, pages, text and link
characters, and whether its text is the same on all pages: partitions merge
what they hold, then the partial wrappers of a host are merged, so a host of
very many pages costs no task more than the others.

The wrapper decides what is content. Its main slot is found from the root
down: as long as one child holds most of the text that varies and is no link,
that child goes on, and what stands beside it is menu, advert or footer,
whatever its name. A main region's own name is a vote: it weighs its text more
and ends the way down. In the slot, constant nodes are template, and names of
adverts, comments and the like set their nodes apart. Extraction aligns each
page with its host's wrapper again and keeps the text of its content slots.
"""

from __future__ import annotations

import json
import re
import sys
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from html import unescape

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh3_64_intdigest

from earnlens.llm.common import BROADCAST_BYTES, small_or_shuffle, stage, text_or_empty

# Element names of the HTML standard.
RAW = {"script", "style", "textarea", "title", "noscript", "iframe", "xmp", "noembed", "noframes"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
BLOCK = {"html", "head", "body", "address", "article", "aside", "blockquote", "button", "caption", "center", "dd", "details",
         "dialog", "dir", "div", "dl", "dt", "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4",
         "h5", "h6", "header", "hgroup", "hr", "legend", "li", "main", "menu", "nav", "ol", "option", "p", "pre", "section",
         "select", "summary", "svg", "table", "tbody", "td", "template", "tfoot", "th", "thead", "tr", "ul", "label", "object",
         "canvas", "video", "audio", "map"}
#: An opening tag that ends an open element of the same group.
ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"},
        "option": {"option"}, "tbody": {"tbody", "thead", "tfoot"}, "body": {"head"}}
#: Elements that such an ending does not reach beyond.
SCOPE = {"ul", "ol", "dl", "table", "select", "menu"}
# Elements and name parts that are never the main text.
APART = {"head", "nav", "header", "footer", "aside", "form", "fieldset", "button", "select", "option", "label", "legend", "svg",
         "template", "dialog", "menu", "object", "canvas", "video", "audio", "map"}
APART_NAMES = {"ad", "ads", "advert", "adverts", "advertisement", "banner", "breadcrumb", "breadcrumbs", "comment", "comments",
               "consent", "contentinfo", "cookie", "cookies", "copyright", "disqus", "footer", "gdpr", "header", "hidden",
               "login", "masthead", "menu", "modal", "nav", "navbar", "navigation", "newsletter", "notice", "pagination",
               "popup", "promo", "promoted", "recommended", "related", "reply", "replies", "respond", "search", "share",
               "sharing", "sidebar", "signup", "skip", "social", "sponsor", "sponsored", "subscribe", "subscription",
               "toolbar", "widget", "alert", "complementary", "sidenav", "topbar", "dfp"}
MAIN_NAMES = {"article", "articlebody", "main"}
#: A node whose text is the same on so many pages of different texts, and on
#: all that have it, is template.
CONSTANT_PAGES = 4
#: A region in which links hold more of the text than this is no content.
LINK_SHARE = 0.6
#: Hosts a worker holds wrappers of before it passes them on, and nodes at which
#: a partial wrapper is passed on and the next one begun.
HOSTS_HELD, NODES_HELD = 2000, 4000
#: Characters of a judged wrapper; larger ones are not sent with every page.
LARGE = 1 << 16
#: Pages that one copy of a large wrapper meets (about: pages are dealt by a hash).
PAGES_MET = 2000

#: A child goes on as the main slot if it holds this share of the slot's varying
#: text; the text of a region that is named as the main one weighs so much more.
DOMINATES, VOTE = 0.6, 3
#: Elements that can be the main slot.
SLOTS = {"", "html", "body", "div", "main", "article", "section", "center", "table", "tbody", "tr", "td", "fieldset", "form", "details", "dd", "dl"}
#: Elements that say nothing without a class or an id.
UNNAMED = {"div", "section", "td"}
#: Sibling lists are aligned by a table of up to so many places, longer ones
#: piece by piece.
TABLE = 250_000

# trees are as deep as pages nest their elements; Python's own calls take no machine stack
sys.setrecursionlimit(max(sys.getrecursionlimit(), 1_000_000))

TOKEN = re.compile(r"""<!--.*?(?:--!?>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|<[!?/][^>]*+(?:>|\Z)""", re.S)
ATTRIBUTE = re.compile(r"""([^\s"'=<>/]+)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""")
NUMBER, NAME = re.compile(r"\d+"), re.compile(r"[a-z]+")


class Node:
    """A block element: its key (name and class), its children, and the text
    units directly in it as (order on the page, text, characters in links)."""

    __slots__ = ("key", "apart", "main", "children", "units")

    def __init__(self, key: str, apart: bool = False, main: bool = False):
        self.key, self.apart, self.main = key, apart, main
        self.children: list[Node] = []
        self.units: list[tuple[int, str, int]] = []


def _node(tag: str, attributes: str, inside_main: bool) -> Node:
    given = {k.lower(): unescape(v.strip("\"'")).lower() for k, v in ATTRIBUTE.findall(attributes)} if attributes.strip() else {}
    names = " ".join(given.get(a, "") for a in ("class", "id", "role", "itemprop"))
    parts = set(NAME.findall(names))
    hidden = "hidden" in attributes.lower().split() or given.get("aria-hidden") == "true" or \
        "display:none" in given.get("style", "").replace(" ", "")
    main = tag in ("article", "main") or not MAIN_NAMES.isdisjoint(names.split())
    apart = hidden or (not main and not APART_NAMES.isdisjoint(parts)) or \
        (main and not {"comment", "comments", "sidebar", "related", "promo", "ad"}.isdisjoint(parts)) or \
        (tag in APART and not (tag == "header" and inside_main and not parts & APART_NAMES))
    key = f"{tag}.{NUMBER.sub('#', names).strip()}" if names.strip() else tag
    return Node(key, apart, main)


def parse(html: str) -> Node:
    """The tree of a page's block elements. Tags that are left open or closed
    twice, and pages cut off anywhere, are read as far as they go."""
    root = Node("")
    stack: list[tuple[str, Node, bool]] = [("", root, False)]
    text: list[str] = []
    order, links, in_link, mains = 0, 0, 0, 0

    def flush() -> None:
        nonlocal order, links
        if text:
            words = " ".join(unescape("".join(text)).split())
            if words:
                stack[-1][1].units.append((order, words, min(links, len(words))))
                order += 1
            text.clear()
        links = 0

    def close(depth: int) -> None:
        nonlocal mains
        while len(stack) > depth:
            mains -= stack.pop()[2]

    i, n = 0, len(html)
    while i < n:
        j = html.find("<", i)
        if j < 0:
            j = n
        if j > i:
            text.append(html[i:j])
            links += (j - i) * (in_link > 0)
        if j == n:
            break
        m = TOKEN.match(html, j)
        if not m:
            if html[j + 1:j + 2].isalpha():
                break  # a tag that the page's end cuts off
            text.append("<")
            i = j + 1
            continue
        i = m.end()
        if m[2] is None:
            continue
        tag = m[2].lower()
        if m[1]:
            if tag == "a":
                in_link = max(0, in_link - 1)
            elif tag in BLOCK:
                depth = next((d for d in range(len(stack) - 1, 0, -1) if stack[d][0] == tag), 0)
                if depth:
                    flush()
                    close(depth)
            elif tag == "br":
                text.append("\n")
            continue
        if tag in RAW:
            end = re.compile(f"</{tag}(?=[\\s/>])", re.I).search(html, i)
            if not end:
                break
            stop = html.find(">", end.end())
            i = n if stop < 0 else stop + 1
            continue
        if tag == "a":
            in_link = 1
        elif tag == "br":
            text.append("\n")
        elif tag in BLOCK:
            flush()
            in_link = 0
            if tag in ("html", "head", "body"):
                if any(x[0] == tag for x in stack):
                    continue
            for d in range(len(stack) - 1, 0, -1):
                name = stack[d][0]
                if name in ENDS.get(tag, ()) or (name == "p"):
                    close(d)
                elif name in SCOPE or name in ("article", "section", "div", "td", "th", "main", "body"):
                    break
            node = _node(tag, m[3], mains > 0)
            stack[-1][1].children.append(node)
            if tag not in VOID and not m[3].endswith("/"):
                stack.append((tag, node, node.main))
                mains += node.main
    flush()
    _tell_apart(root)
    return root


def _tell_apart(root: Node) -> None:
    """Elements of no name are told apart by what is directly in them: kinds of
    children, text of their own, links."""
    todo = [root]
    while todo:
        n = todo.pop()
        todo += n.children
        if n.key in UNNAMED:
            kinds = sorted({c.key.split(".")[0] for c in n.children})
            own = ["text"] * any(len(t) > k for _, t, k in n.units) + ["link"] * any(k for _, _, k in n.units)
            n.key += ".:" + "+".join(kinds + own)


# -- wrappers: nested lists [key, apart, main, hashes of some different pages, text hash or None (varies), characters,
# link characters, children]
KEY, APART_AT, MAIN, PAGES, SAME, CHARS, LINKS, CHILDREN = range(8)


def own_text(node: Node) -> list[str]:
    """The text that no name sets apart; equal for copies of a page whose
    menus and adverts differ."""
    out, todo = [], [node]
    while todo:
        n = todo.pop()
        if not n.apart:
            out += [t for _, t, _ in n.units]
            todo += reversed(n.children)
    return out


def has_main(node: Node) -> bool:
    todo = [node]
    while todo:
        n = todo.pop()
        if not n.apart:
            if n.main:
                return True
            todo += n.children
    return False


def page_slots(page: Node) -> list:
    return slots(page, xxh3_64_intdigest("\n".join(own_text(page))))


def slots(node: Node, page: int) -> list:
    """A page's tree as the wrapper of that one page. Neighbouring siblings of
    the same key are one node."""
    text = "\n".join(t for _, t, _ in node.units)
    out = [node.key, node.apart, node.main, [page], xxh3_64_intdigest(text) if text else 0, sum(len(t) for _, t, _ in node.units),
           sum(k for _, _, k in node.units), []]
    for child in node.children:
        own = slots(child, page)
        if out[CHILDREN] and out[CHILDREN][-1][KEY] == own[KEY]:
            last = out[CHILDREN][-1]
            merged = merge(last, own)
            merged[SAME] = xxh3_64_intdigest(f"{last[SAME]} {own[SAME]}")
            out[CHILDREN][-1] = merged
        else:
            out[CHILDREN].append(own)
    return out


def match_score(a: list, b: list) -> int:
    """Simple tree matching: the largest number of node pairs that keep keys,
    parents and the order of siblings (of long lists, see :func:`matched`)."""
    if a[KEY] != b[KEY]:
        return 0
    xs, ys, total = a[CHILDREN], b[CHILDREN], 1
    for i, j in matched(xs, ys):
        total += match_score(xs[i], ys[j])
    return total


def _table(xs: list, ys: list) -> list[list[int]]:
    table = [[0] * (len(ys) + 1)]
    for x in xs:
        above, row = table[-1], [0]
        for j, y in enumerate(ys):
            score = match_score(x, y) if x[KEY] == y[KEY] else 0
            row.append(max(above[j + 1], row[j], above[j] + score))
        table.append(row)
    return table


def align(xs: list, ys: list) -> list[tuple[int | None, int | None]]:
    """Sibling lists aligned by their matching; unmatched ones with None."""
    out, i, j = [], 0, 0
    for m, n in [*matched(xs, ys), (len(xs), len(ys))]:
        out += [(k, None) for k in range(i, m)] + [(None, k) for k in range(j, n)]
        out.append((m, n))
        i, j = m + 1, n + 1
    return out[:-1]


def matched(xs: list, ys: list) -> list[tuple[int, int]]:
    """The pairs of a matching, in order. Keys that only one list has cannot
    match; the same keys in the same order, none twice, all do. A short rest is
    matched by a table of subtree scores. Of a long one, first and last siblings
    of the same keys are paired, then keys that both have once (the longest
    ascending run of them), and so on between those; where no key is left that
    is there once, the rest is cut in the middle. Time and memory grow with
    the lists' length, not with its square."""
    in_x, in_y = {x[KEY] for x in xs}, {y[KEY] for y in ys}
    left = [i for i, x in enumerate(xs) if x[KEY] in in_y]
    right = [j for j, y in enumerate(ys) if y[KEY] in in_x]
    keys = [xs[i][KEY] for i in left]
    if keys == [ys[j][KEY] for j in right] and (len(set(keys)) == len(keys) or len(xs) == len(ys)):
        return list(zip(left, right))
    out: list[tuple[int, int]] = []
    todo = [(0, len(left), 0, len(right))]
    while todo:
        a, b, c, d = todo.pop()
        if a >= b or c >= d:
            continue
        if (b - a) * (d - c) <= TABLE:
            out += [(left[a + i], right[c + j]) for i, j in _by_table([xs[i] for i in left[a:b]], [ys[j] for j in right[c:d]])]
            continue
        while a < b and c < d and xs[left[a]][KEY] == ys[right[c]][KEY]:
            out.append((left[a], right[c]))
            a, c = a + 1, c + 1
        while a < b and c < d and xs[left[b - 1]][KEY] == ys[right[d - 1]][KEY]:
            b, d = b - 1, d - 1
            out.append((left[b], right[d]))
        if (b - a) * (d - c) <= TABLE:
            todo.append((a, b, c, d))
            continue
        marks = _once(xs, left, a, b).items()
        there = _once(ys, right, c, d)
        anchors = _ascending([(i, there[k]) for k, i in marks if k in there])
        if not anchors:  # halves against halves
            m, n = (a + b) // 2, (c + d) // 2
            anchors, todo = [], todo + [(a, m, c, n), (m, b, n, d)]
            continue
        for i, j in anchors:
            out.append((left[i], right[j]))
            todo.append((a, i, c, j))
            a, c = i + 1, j + 1
        todo.append((a, b, c, d))
    return sorted(out)


def _once(nodes: list, places: list[int], a: int, b: int) -> dict[str, int]:
    """The keys that are there once, with their place among ``places``."""
    count = Counter(nodes[i][KEY] for i in places[a:b])
    return {nodes[places[i]][KEY]: i for i in range(a, b) if count[nodes[places[i]][KEY]] == 1}


def _ascending(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The longest run of pairs (ascending on the left) that ascends on the right."""
    ends: list[int] = []
    at: list[int] = []
    back: list[int] = []
    for n, (_, j) in enumerate(pairs):
        k = bisect_left(ends, j)
        back.append(at[k - 1] if k else -1)
        ends[k:k + 1], at[k:k + 1] = [j], [n]
    out, n = [], at[-1] if at else -1
    while n >= 0:
        out.append(pairs[n])
        n = back[n]
    return out[::-1]


def _by_table(xs: list, ys: list) -> list[tuple[int, int]]:
    table, out = _table(xs, ys), []
    i, j = len(xs), len(ys)
    while i and j:
        if xs[i - 1][KEY] == ys[j - 1][KEY] and table[i][j] == table[i - 1][j - 1] + match_score(xs[i - 1], ys[j - 1]):
            i, j = i - 1, j - 1
            out.append((i, j))
        elif table[i][j] == table[i][j - 1]:
            j -= 1
        else:
            i -= 1
    return out[::-1]


def merge(a: list, b: list) -> list:
    """Two wrappers whose roots have the same key as one."""
    same = a[SAME] if a[SAME] == b[SAME] else None
    children = []
    for i, j in align(a[CHILDREN], b[CHILDREN]):
        children.append(merge(a[CHILDREN][i], b[CHILDREN][j]) if i is not None and j is not None
                        else a[CHILDREN][i] if j is None else b[CHILDREN][j])
    pages = sorted({*a[PAGES], *b[PAGES]})[:CONSTANT_PAGES]
    return [a[KEY], a[APART_AT] and b[APART_AT], a[MAIN], pages, same, a[CHARS] + b[CHARS], a[LINKS] + b[LINKS], children]


def size(w: list) -> int:
    n, todo = 0, [w]
    while todo:
        own = todo.pop()
        n += 1
        todo += own[CHILDREN]
    return n


def dump(tree: list | None) -> str:
    """A tree, whose nodes have their children last, as flat JSON: nodes in
    order, each with the number of its children."""
    out, todo = [], [] if tree is None else [tree]
    while todo:
        n = todo.pop()
        out.append([*n[:-1], len(n[-1])])
        todo += reversed(n[-1])
    return json.dumps(out)


def load(text: str) -> list | None:
    open_: list[list] = []
    root = None
    for *fields, count in json.loads(text):
        node = [*fields, []]
        if open_:
            open_[-1][0][-1].append(node)
            open_[-1][1] -= 1
        else:
            root = node
        open_.append([node, count])
        while open_ and not open_[-1][1]:
            open_.pop()
    return root


def decide(wrapper: list, marked: bool) -> list:
    """The wrapper with each node's verdict in place of its counts: ``[key,
    content, children]``. ``marked``: its pages mark a main region; where none
    does, lists of links are no content either."""
    many = len(wrapper[PAGES]) >= CONSTANT_PAGES
    mass: dict[int, tuple[int, int, int, bool]] = {}  # of a subtree: varying text that is no link, all text, links, main inside

    def constant(w: list) -> bool:
        return many and w[SAME] is not None and len(w[PAGES]) >= CONSTANT_PAGES

    def weigh(w: list) -> tuple[int, int, int, bool]:
        own, chars, links, main = 0 if constant(w) else w[CHARS] - w[LINKS], w[CHARS], w[LINKS], w[MAIN]
        for c in w[CHILDREN]:
            a, b, k, m = weigh(c)
            own, chars, links, main = own + a, chars + b, links + k, main or m
        if w[APART_AT]:
            own, main = 0, False
        mass[id(w)] = own, chars, links, main
        return mass[id(w)]

    weigh(wrapper)
    slot = wrapper
    while not slot[MAIN]:
        weights = [mass[id(c)][0] * (VOTE if mass[id(c)][3] else 1) for c in slot[CHILDREN]]
        own = mass[id(slot)][0] - sum(mass[id(c)][0] for c in slot[CHILDREN])
        if not weights or max(weights) < max(1, DOMINATES * (own + sum(weights))):
            break
        best = slot[CHILDREN][weights.index(max(weights))]
        if best[KEY].split(".")[0] not in SLOTS:
            break
        slot = best

    def verdict(w: list, inside: bool, apart: bool) -> list:
        inside, apart = inside or w is slot, apart or w[APART_AT]
        _, chars, links, _ = mass[id(w)]
        if not marked and w is not slot and w[KEY].split(".")[0] not in ("", "html", "body") and links > LINK_SHARE * max(1, chars):
            apart = True
        children = []
        for c in w[CHILDREN]:
            children.append(verdict(c, inside, apart))
        return [w[KEY], inside and not apart and not constant(w), children]

    return verdict(wrapper, False, False)


def extract(page: Node, judged: list[list | None] | None) -> str:
    """The page's content, block by block, by its host's wrappers (of pages
    without and with a marked region); without them, all of its text. A node
    that the wrapper lacks is content like its parent, unless its name sets it
    apart. A page in which its host's main slot is empty is judged alone."""
    if judged is None:
        return _text_of(page, None)
    marked = has_main(page)
    w = judged[marked]
    out = _text_of(page, w) if w is not None else ""
    return out or _text_of(page, decide(page_slots(page), marked))


def _text_of(page: Node, judged: list | None) -> str:
    found: list[tuple[int, str]] = []

    def walk(node: Node, w: list | None, content: bool) -> None:
        content = w[1] if w is not None else content and not (node.apart and judged is not None)
        if content:
            found.extend((o, t) for o, t, _ in node.units)
        runs: list[list] = []
        for child in node.children:
            if runs and runs[-1][0] == child.key:
                runs[-1][1].append(child)
            else:
                runs.append([child.key, [child]])
        pairs = _aligned(runs, w) if w is not None else {}
        # what the wrapper lacks follows the slots around it: a constant node's child may well vary
        for i, (_, same) in enumerate(runs):
            for child in same:
                walk(child, pairs.get(i), content)

    walk(page, judged, True)
    return "\n".join(t for _, t in sorted(found))


def _aligned(runs: list, w: list) -> dict[int, list]:
    as_node = lambda key, children: [key, 0, 0, 0, 0, 0, 0, children]
    kids = w[2]
    if len(runs) == len(kids) and [r[0] for r in runs] == [k[0] for k in kids]:
        return dict(enumerate(kids))
    if len(w) == 3:  # places of its children by key, made once
        w.append({})
        for j, k in enumerate(kids):
            w[3].setdefault(k[0], []).append(j)
    left = [i for i, r in enumerate(runs) if r[0] in w[3]]
    right = sorted(j for key in {runs[i][0] for i in left} for j in w[3][key])
    keys = [runs[i][0] for i in left]
    if keys == [kids[j][0] for j in right] and len(set(keys)) == len(keys):
        return {i: kids[j] for i, j in zip(left, right)}

    def shape(n: Node) -> list:
        children = []
        for i, c in enumerate(n.children):
            if not i or n.children[i - 1].key != c.key:
                children.append(shape(c))
        return as_node(n.key, children)

    def judged_shape(k: list) -> list:
        children = []
        for c in k[2]:
            children.append(judged_shape(c))
        return as_node(k[0], children)

    pairs = matched([shape(runs[i][1][0]) for i in left], [judged_shape(kids[j]) for j in right])
    return {left[i]: kids[right[j]] for i, j in pairs}


def merge_pair(a: list, b: list) -> list:
    """Two hosts' wrappers (of pages without and with a marked region) as one."""
    return [merge(x, y) if x is not None and y is not None else x if y is None else y for x, y in zip(a, b)]


def _pair_size(pair: list) -> int:
    return sum(size(w) for w in pair if w is not None)


def _dump_pair(pair: list) -> str:
    return json.dumps([dump(w) for w in pair])


def _load_pair(text: str) -> list:
    return [load(w) for w in json.loads(text)]


def _induce(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[str, list] = {}
    most: dict[str, int] = {}

    def flush(hosts: list[str]) -> pa.RecordBatch:
        out = pa.RecordBatch.from_pydict({"host": hosts, "wrapper": [_dump_pair(held.pop(h)) for h in hosts]})
        for h in hosts:
            most.pop(h)
        return out

    for batch in batches:
        for host, html in zip(batch.column("host").to_pylist(), batch.column("html").to_pylist()):
            page = parse(html)
            own = page_slots(page)
            own = [None, own] if has_main(page) else [own, None]
            if host not in held:
                held[host], most[host] = own, max(NODES_HELD, 2 * _pair_size(own))
                continue
            held[host] = merge_pair(held[host], own)
            if _pair_size(held[host]) >= most[host]:
                yield flush([host])
        if len(held) > HOSTS_HELD:
            yield flush(list(held))
    if held:
        yield flush(list(held))


def _merge_hosts(rows: pd.DataFrame) -> pd.DataFrame:
    parts: list[tuple[int, list]] = []  # merged by twos, so that none meets all others one after another
    for text in rows["wrapper"].sort_values():
        level, w = 0, _load_pair(text)
        while parts and parts[-1][0] == level:
            level, w = level + 1, merge_pair(parts.pop()[1], w)
        parts.append((level, w))
    whole = parts.pop()[1]
    while parts:
        whole = merge_pair(parts.pop()[1], whole)
    return pd.DataFrame({"host": rows["host"].iloc[:1], "wrapper": [_dump_pair(whole)]})


def _judge(rows: pd.DataFrame) -> pd.DataFrame:
    out = _merge_hosts(rows)
    out["wrapper"] = [_dump_pair([None if w is None else decide(w, bool(i)) for i, w in enumerate(_load_pair(pair))])
                      for pair in out["wrapper"]]
    return out


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    known: dict[str, list | None] = {}
    for batch in batches:
        out = []
        for html, wrapper in zip(batch.column("html").to_pylist(), batch.column("wrapper").to_pylist()):
            if wrapper not in known:
                if len(known) > 500:
                    known.clear()
                known[wrapper] = _load_pair(wrapper) if wrapper else None
            out.append(extract(parse(html), known[wrapper]))
        yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(out, pa.string()),
                                          pa.array([len(x) for x in out], pa.int64())], names=["page_id", "url", "text", "n_chars"])


def _extract_dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted rows in which a host's wrapper comes before its pages."""
    known = None
    for batch in batches:
        at, out = [], []
        for i, (html, wrapper) in enumerate(zip(batch.column("html").to_pylist(), batch.column("wrapper").to_pylist())):
            if wrapper is not None:
                known = _load_pair(wrapper)
            else:
                at.append(i)
                out.append(extract(parse(html), known))
        ids = batch.select(["page_id", "url"]).take(pa.array(at, pa.int64()))
        yield pa.RecordBatch.from_arrays([*ids.columns, pa.array(out, pa.string()), pa.array([len(x) for x in out], pa.int64())],
                                         names=["page_id", "url", "text", "n_chars"])


def host_of(url: str = "url"):
    """The host of a URL in lower case; empty if there is none."""
    return F.lower(F.regexp_extract(F.coalesce(F.col(url), F.lit("")), r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]+)", 1))


#: Partial wrappers of a host that one task merges in the first step.
SALTS = 16


def induce_wrappers(pages: DataFrame) -> DataFrame:
    """``host, html`` to ``host, wrapper`` (JSON of :func:`decide`)."""
    parts = stage(pages.mapInArrow(_induce, "host string, wrapper string"), "html-wrappers")
    salted = parts.withColumn("salt", F.pmod(F.xxhash64("wrapper"), F.lit(SALTS)))
    return salted.groupBy("host", "salt").applyInPandas(lambda k, rows: _merge_hosts(rows), "host string, wrapper string") \
        .groupBy("host").applyInPandas(_judge, "host string, wrapper string")


def extract_main_text(pages: DataFrame, id_col: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """One row per page: ``page_id, url, text, n_chars``.

    Character references are decoded, white space inside a block becomes one
    space, blocks are joined by a newline. A null or empty page has an empty
    text; pages without a host share one wrapper. Pages that repeat are each
    returned. Other columns are ignored; an empty table gives no rows.
    """
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url).alias("url"), host_of(url).alias("host"),
                        text_or_empty(html).alias("html"))
    schema = "page_id long, url string, text string, n_chars long"
    wrappers = stage(induce_wrappers(rows.where("html <> ''").select("host", "html")), "html-judged")
    large = wrappers.where(F.length("wrapper") > LARGE)
    dealt = None
    if large.limit(1).count():
        hosts = rows.join(small_or_shuffle(large.select("host"), 64), "host", "left_semi").groupBy("host").agg(
            F.ceil(F.count("*") / PAGES_MET).cast("int").alias("salts"))
        hosts = stage(hosts, "html-large")
        wrappers = wrappers.where(F.length("wrapper") <= LARGE)
        few = small_or_shuffle(hosts, 64)
        own = rows.join(few, "host").select(
            "host", F.pmod(F.xxhash64("page_id", "url", "html"), F.col("salts")).cast("int").alias("salt"), F.lit(1).alias("kind"),
            "page_id", "url", "html", F.lit(None).cast("string").alias("wrapper"))
        nothing = lambda kind: F.lit(None).cast(kind)
        sent = large.join(few, "host").select(
            "host", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.lit(0).alias("kind"),
            nothing("long").alias("page_id"), nothing("string").alias("url"), nothing("string").alias("html"), "wrapper")
        dealt = sent.unionByName(own).repartition("host", "salt").sortWithinPartitions("host", "salt", "kind").select(
            "page_id", "url", "html", "wrapper").mapInArrow(_extract_dealt, schema)
        rows = rows.join(few, "host", "left_anti")
    if (wrappers.agg(F.sum(F.length("wrapper"))).first()[0] or 0) <= BROADCAST_BYTES:
        known = rows.join(F.broadcast(wrappers), "host", "left")
    else:  # hot hosts are split over salts
        salts = F.array(*[F.lit(i) for i in range(SALTS)])
        known = rows.withColumn("salt", F.pmod(F.xxhash64("page_id", "url"), F.lit(SALTS)).cast("int")).join(
            wrappers.withColumn("salt", F.explode(salts)), ["host", "salt"], "left")
    out = known.select("page_id", "url", "html", "wrapper").mapInArrow(_extract, schema)
    return out if dealt is None else out.unionByName(dealt)
