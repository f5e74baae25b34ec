"""Main-text extraction by union-free regular-expression inference.

A page becomes a stream of labels: tags with their class words, and # for text (inline markup is
part of a text). The streams of a host's pages are aligned one after the other, element by element.
Where the children of an element agree, they keep their places; where they don't, what both begin
and end with keeps its places and the rest is resolved: a label that is missing on one side becomes
optional, one that occurs more often on one side a repeated group, labels in changing order a
repeated group of optional ones, and every text a slot. The result, a regular expression without
unions, is the host's wrapper; it matches every page that it came from. All pages take part.

The wrapper carries what its slots hold over all pages: how much text, how much of it in links, and
whether it is always the same. A slot with one text on many different pages is part of the template
and left out. The main part is the article, main or likewise named element whose slots hold most
changing text; without one, the deepest element with nine tenths of it, and the headings before it.
A part that its name marks as boilerplate stays out of it, unless it holds most of the changing text.
A host with fewer than EVIDENCE different pages tells nothing so; its pages are read by the names alone.

Defined cases: a null or empty page has an empty text; a page without markup is its own text; a null
url is a host of its own; repeated rows give repeated rows and count as one page; pages cut off
anywhere are read to their end; elements deeper than DEPTH count as if their tags weren't there; of
several parts of equal standing a page's first is taken; empty tables give empty results; other
columns are ignored. A wrapper's size follows the number of labels of its host.
"""

from __future__ import annotations

import html as entities
import json
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from siltstone.llm.common import importable, map_slices, stored

#: Different pages of a host from which its wrapper decides.
EVIDENCE = 4
#: Siblings from which on a row is resolved at once, and depth of elements.
WIDE, DEPTH = 32, 100
#: Smallest page hashes that a slot keeps to tell how many different pages it is on.
SKETCH = 32
#: Hosts that a task holds before it passes their wrappers on, shares of a host that are aligned apart first, and parts of its pages in a join.
HELD, SALTS, SPREAD = 256, 32, 8

_RAW = "script|style|noscript|template|textarea|title|svg|iframe|select"
_TOKEN = re.compile(rf"<!--.*?(?:-->|\Z)|<(?P<raw>{_RAW})\b[^>]*>.*?(?:</(?P=raw)\s*>|\Z)|<(?P<end>/?)(?P<tag>[a-z][^\s/>]*)(?P<attrs>(?:\"[^\"]*\"|'[^']*'|[^>\"'])*)>|<[!?/][^>]*>|<[a-z][^>]*(?:>|\Z)", re.S | re.I)
_ATTR = re.compile(r"""(?:^|\s)(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_WORD = re.compile(r"[a-z]+")
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
#: Elements whose end tags may be left out; a new one of the group ends an open one.
IMPLIED = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
BLOCKS = frozenset("address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
SKIPPED = frozenset("nav aside footer form button dialog menu head input object".split())
HEADINGS = frozenset(("h1", "h2", "h3"))
#: Class, id or role words of boilerplate, and of main parts.
NOISE = frozenset("ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments commentlist consent contentinfo cookie cookies disclaimer discussion disqus footer gdpr header login masthead menu modal nav navbar navigation newsletter notice notices pagination popup promo promotion related replies reply respond search share sharing sidebar signup social sponsor sponsored subscribe subscription toolbar widget widgets complementary".split())
MAIN = frozenset("article content entry main post story".split())


class Node:
    """An element (label, children), or a text (label "#", its pieces)."""

    __slots__ = ("label", "tag", "words", "children", "linked")

    def __init__(self, label: str, tag: str, words: frozenset = frozenset()) -> None:
        self.label, self.tag, self.words, self.children, self.linked = label, tag, words, [], 0

    def text(self) -> str:
        return " ".join(entities.unescape("".join(self.children)).split())


def _named(attrs: str) -> tuple[str, frozenset]:
    """The part of a label that tells elements of one tag apart, and all words of class, id and role."""
    values = [(m[2] or m[3] or m[4] or "").lower() for m in _ATTR.finditer(attrs)] if "=" in attrs else []
    plain = sorted({w for v in values for x in v.split() for w in _WORD.findall(x) if w in NOISE or w in MAIN or not any(c.isdigit() for c in x)})
    return "".join(f".{w}" for w in plain), frozenset(w for v in values for w in _WORD.findall(v))


def parse(source: str | None) -> Node:
    """The page as a tree below a nameless root."""
    root = Node("", "")
    stack, text, links, done = [root], None, 0, 0
    opened = Counter()  # how many elements of a tag are on the stack
    source = source or ""

    def add(piece: str) -> None:
        nonlocal text
        if text is None:
            if not piece.strip():
                return
            text = Node("#", "#")
            stack[-1].children.append(text)
        text.children.append(piece)
        if links:
            text.linked += len(piece)

    def close() -> str:
        tag = stack.pop().tag
        opened[tag] -= 1
        return tag

    for m in _TOKEN.finditer(source):
        if m.start() > done:
            add(source[done : m.start()])
        done = m.end()
        if not (tag := m["tag"]):
            continue
        tag = tag.lower()
        if tag not in BLOCKS and tag not in SKIPPED:
            if tag == "a":
                links = 0 if m["end"] else 1
            elif tag in ("br", "img") and text is not None:
                text.children.append(" ")
            continue
        text, links = None, 0
        if m["end"]:
            if opened[tag]:
                while close() != tag:
                    pass
            continue
        if tag in VOID:
            continue
        if tag in IMPLIED:
            while stack[-1].tag in IMPLIED[tag]:
                close()
        elif stack[-1].tag == "p":
            close()
        name, words = _named(m["attrs"])
        node = Node(f"<{tag}{name}>", tag, words)
        if len(stack) <= DEPTH:
            stack[-1].children.append(node)
        else:
            node.children = stack[-1].children  # what is in it belongs to the last element above DEPTH
        stack.append(node)
        opened[tag] += 1
    if done < len(source):
        add(source[done:])
    return root


def _skipped(tag: str, inside: bool) -> bool:
    """Whether an element's tag marks it as boilerplate; ``inside``: within an article or main."""
    return tag in SKIPPED or tag == "header" and not inside


def _noise(tag: str, words: frozenset, inside: bool) -> bool:
    """Whether an element's words mark it as boilerplate."""
    return bool(NOISE & words) and not (tag in ("html", "body", "main") or tag == "header" and inside)


def _rank(tag: str, words: frozenset) -> int:
    """How its name makes an element a main part: 0 to 2, the lower the better; 9 if it doesn't."""
    if NOISE & words:
        return 9
    return 0 if tag == "article" else 1 if tag == "main" or tag in BLOCKS and "main" in words else 2 if tag in ("div", "section", "td") and MAIN & words else 9


def by_names(page: Node) -> str:
    """The main text by names alone: of the first article, else the first main, else what is named so."""
    best, todo, at = None, [page], 0
    while todo:
        node = todo.pop()
        at += 1
        rank = _rank(node.tag, node.words)
        if rank < 9 and (best is None or (rank, at) < best[:2]):
            best = (rank, at, node)
        todo += [c for c in reversed(node.children) if c.tag != "#"]
    lines: list[str] = []

    def take(node: Node, inside: bool) -> None:
        for c in node.children:
            if c.tag == "#":
                lines.append(c.text())
            elif not _skipped(c.tag, inside) and not _noise(c.tag, c.words, inside):
                take(c, inside or c.tag in ("article", "main"))

    start = best[2] if best else page
    take(start, start.tag in ("article", "main"))
    return "\n".join(x for x in lines if x)


# A wrapper is made of levels and items, in lists so that it can be written as JSON.
#   level: [head, mid, edges, tail, n]: items that keep their places at both ends; between them items
#     by label (None if all keep their places) with the labels that follow each label; n elements.
#   item: [label, least, most, a level], or ["#", least, most, a slot]; how often it occurs in a row.
#   slot: [n, smallest and largest hash, characters, characters in links, sketch of its pages].


def page_hash(page: Node) -> int:
    """A hash that near copies of a page mostly share: the smallest over all runs of 16 bytes of its text."""
    parts, todo = [], [page]
    while todo:
        node = todo.pop()
        if node.tag == "#":
            parts += node.children
        elif not _skipped(node.tag, True):
            todo += reversed(node.children)
    raw = "".join(parts).encode("utf-8", "replace")
    raw += bytes(max(0, 16 - len(raw)))
    least = (1 << 64) - 1
    for k in range(8):
        w = np.frombuffer(raw, "<u8", (len(raw) - k) // 8, k)
        h = (w[:-1] * np.uint64(0x9E3779B97F4A7C15)) ^ (w[1:] * np.uint64(0xC2B2AE3D27D4EB4F))
        h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        least = min(least, int((h ^ (h >> np.uint64(32))).min(initial=np.uint64(least))))
    return least


def level_of(node: Node, page: int) -> list:
    """The level of one element."""
    items = [["#", 1, 1, [1, h := xxh64_intdigest(t := c.text()), h, len(t), min(c.linked, len(t)), [page]]] if c.tag == "#" else [c.label, 1, 1, level_of(c, page)] for c in node.children]
    if len(items) > WIDE:
        mid, edges = {}, {}
        _push(mid, edges, items, True)
        return [[], mid, edges, [], 1]
    return [items, None, {}, [], 1]


def _push(mid: dict, edges: dict, items: list, front: bool) -> None:
    """Puts ``items`` before (or behind) what is in the middle."""
    if not items:
        return
    old = list(mid)
    last = items[0 if not front else -1][0]
    for k, x in enumerate(items):
        label = x[0]
        if label in mid:
            mid[label] = [label, mid[label][1] + x[1], mid[label][2] + x[2], _same(label, mid[label][3], x[3])]
        else:
            mid[label] = x
        if k:
            edges.setdefault(items[k - 1][0], {})[label] = 1
    for label in old:
        a, b = (last, label) if front else (label, last)
        edges.setdefault(a, {})[b] = 1


def _same(label: str, a: list, b: list) -> list:
    """One slot or level for what both sides hold at a place; ``a`` may be changed."""
    if label != "#":
        return align(a, b)
    fixed = a[1] == a[2] == b[1] == b[2]
    return [a[0] + b[0], min(a[1], b[1]), max(a[2], b[2]), a[3] + b[3], a[4] + b[4], sorted({*a[5], *b[5]})[:SKETCH] if fixed else []]


def _prefix(a: list, b: list) -> int:
    n = 0
    for x, y in zip(a, b, strict=False):
        if x[0] != y[0]:
            break
        n += 1
    return n


def align(a: list, b: list) -> list:
    """The level that matches what either matches; both may be changed."""
    n = a[4] + b[4]
    p = _prefix(a[0], b[0])
    head = [[x[0], x[1], x[2], _same(x[0], x[3], y[3])] for x, y in zip(a[0][:p], b[0][:p], strict=True)]
    if a[1] is None and b[1] is None and p == len(a[0]) == len(b[0]):
        return [head, None, {}, [], n]
    # What may keep its place at the end: the tail, or the rest of a row that has no middle yet.
    ends = [x[3] if x[1] is not None else x[0][p:] for x in (a, b)]
    q = _prefix(ends[0][::-1], ends[1][::-1])
    tail = [[x[0], x[1], x[2], _same(x[0], x[3], y[3])] for x, y in zip(ends[0][len(ends[0]) - q :], ends[1][len(ends[1]) - q :], strict=True)]
    mids = []
    for side, end in zip((a, b), ends, strict=True):
        mid, edges = (side[1], side[2]) if side[1] is not None else ({}, {})
        if side[1] is None:
            _push(mid, edges, end[: len(end) - q], True)
        else:
            _push(mid, edges, side[0][p:], True)
            _push(mid, edges, end[: len(end) - q], False)
        mids.append((mid, edges))
    (mid, edges), (other, more) = mids
    for label in mid:
        if label not in other:
            mid[label][1] = 0
    for label, x in other.items():
        if label in mid:
            m = mid[label]
            mid[label] = [label, min(m[1], x[1]), max(m[2], x[2]), _same(label, m[3], x[3])]
        else:
            mid[label] = [label, 0, x[2], x[3]]
    for label, after in more.items():
        edges.setdefault(label, {}).update(after)
    # Labels of the middle don't also stand at the ends: they would be repeated groups cut in two.
    while (cut := next((i for i, x in enumerate(head) if x[0] in mid), -1)) >= 0:
        _push(mid, edges, head[cut:], True)
        head = head[:cut]
    while (cut := next((i for i in range(len(tail) - 1, -1, -1) if tail[i][0] in mid), -1)) >= 0:
        _push(mid, edges, tail[: cut + 1], False)
        tail = tail[cut + 1 :]
        while (cut := next((i for i, x in enumerate(head) if x[0] in mid), -1)) >= 0:
            _push(mid, edges, head[cut:], True)
            head = head[:cut]
    return [head, mid, edges, tail, n]


def groups(level: list) -> list[list]:
    """The items of a middle in order: lists of labels that change places with each other."""
    mid, edges = level[1], level[2]
    index, low, on, stack, out = {}, {}, set(), [], []
    for start in sorted(mid):  # strongly connected components, without recursion
        if start in index:
            continue
        todo = [(start, iter(sorted(edges.get(start, ()))))]
        index[start] = low[start] = len(index)
        stack.append(start)
        on.add(start)
        while todo:
            v, after = todo[-1]
            for w in after:
                if w not in index:
                    index[w] = low[w] = len(index)
                    stack.append(w)
                    on.add(w)
                    todo.append((w, iter(sorted(edges.get(w, ())))))
                    break
                if w in on:
                    low[v] = min(low[v], index[w])
            else:
                todo.pop()
                if todo:
                    low[todo[-1][0]] = min(low[todo[-1][0]], low[v])
                if low[v] == index[v]:
                    found = []
                    while not found or found[-1] != v:
                        found.append(stack.pop())
                        on.discard(found[-1])
                    out.append(sorted(found))
    return [[mid[x] for x in labels] for labels in reversed(out)]


def expression(level: list) -> str:
    """A level as a regular expression over the labels of ``stream``."""

    def one(x: list, often: bool = True) -> str:
        inner = re.escape(x[0]) if x[0] == "#" else f"{re.escape(x[0])}{expression(x[3])}{re.escape('</>')}"
        sign = "?" if not often else "" if x[1] == x[2] == 1 else "?" if x[2] == 1 else "+" if x[1] else "*"
        return f"(?:{inner}){sign}" if sign else inner

    mid = [one(g[0]) if len(g) == 1 else f"(?:{''.join(one(x, False) for x in g)})+" for g in groups(level)] if level[1] is not None else []
    return "".join([*map(one, level[0]), *mid, *map(one, level[3])])


def stream(node: Node) -> str:
    return "".join("#" if c.tag == "#" else f"{c.label}{stream(c)}</>" for c in node.children)


def infer(pages: list[str | None]) -> list:
    """The wrapper of pages: [level, sketch of the pages]."""
    wrapper = None
    for source in pages:
        wrapper = more(wrapper, one_page(parse(source)))
    return wrapper


def one_page(page: Node) -> list:
    key = page_hash(page)
    return [level_of(page, key), [key]]


def more(a: list | None, b: list) -> list:
    return b if a is None else [align(a[0], b[0]), sorted({*a[1], *b[1]})[:SKETCH]]


def _distinct(sketch: list[int]) -> float:
    return len(sketch) if len(sketch) < SKETCH else (SKETCH - 1) * 2.0**64 / (sketch[-1] + 1)


def plan(wrapper: list) -> list | None:
    """What a wrapper decides, in levels [head, by label, tail] with items [label, kept] of texts and
    [label, order as a main part or -1, whether it is a heading before it, level] of elements; None
    without evidence. Parts that are left out are 0 in place of a level."""
    if _distinct(wrapper[1]) < EVIDENCE:
        return None
    found: list[dict] = []  # elements, parents first

    def fixed(slot: list) -> bool:
        return slot[1] == slot[2] and EVIDENCE <= (n := _distinct(slot[5])) and 2 * n >= slot[0]

    def rows(level: list) -> list[tuple[tuple, list]]:
        return [((where, k), x) for where, items in (("head", level[0]), ("mid", (level[1] or {}).values()), ("tail", level[3])) for k, x in enumerate(items)]

    def add(label: str, level: list, inside: bool, above: dict | None) -> dict:
        tag, *words = label.strip("<>").split(".")
        words = frozenset(words)
        e = {"tag": tag, "words": words, "level": level, "above": above, "skip": _skipped(tag, inside), "noise": _noise(tag, words, inside), "kids": {}}
        found.append(e)
        for at, x in rows(level):
            if x[0] != "#":
                e["kids"][at] = add(x[0], x[3], inside or tag in ("article", "main"), e)
        return e

    def weigh(key: str) -> None:
        """Changing text (out of links, for ``plain``) that isn't left out."""
        for e in reversed(found):
            e[key] = sum(max(0, x[3][3] - (x[3][4] if key == "plain" else 0)) for _, x in rows(e["level"]) if x[0] == "#" and not fixed(x[3]))
            e[key] += sum(k[key] for k in e["kids"].values() if not k["skip"] and not (key == "plain" and k["noise"]))

    root = add("", wrapper[0], False, None)
    weigh("mass")
    for e in found:  # a part that holds most of the changing text is none of the boilerplate that its words suggest
        if 2 * e["mass"] > root["mass"]:
            e["noise"] = False
        e["off"] = e["above"] is not None and (e["above"]["off"] or e["skip"] or e["noise"])
        e["rank"] = 9 if e["off"] else _rank(e["tag"], e["words"] - NOISE)
    weigh("plain")
    named = [e for e in found if e["rank"] < 9]
    most = max((e["mass"] / e["level"][4] for e in named), default=0)
    named.sort(key=lambda e: (2 * e["mass"] / e["level"][4] < most, e["rank"]))
    for order, e in enumerate(named):
        e["order"] = order
    core = None
    if not named:
        core, floor = root, 0.9 * root["plain"]
        while kid := next((k for k in core["kids"].values() if not k["skip"] and not k["noise"] and k["plain"] >= floor > 0), None):
            core = kid
        core["order"] = 0

    def make(e: dict, within: bool) -> list:
        level, within = e["level"], within or e is core

        def item(at: tuple, x: list) -> list:
            if x[0] == "#":
                linked = core is not None and x[3][4] > 0.8 * x[3][3]
                return ["#", 0 if fixed(x[3]) or linked else 1]
            kid = e["kids"][at]
            if kid["skip"] or kid["noise"]:
                return [x[0], -1, 0, 0]
            return [x[0], kid.get("order", -1), int(core is not None and not within and kid is not core and kid["tag"] in HEADINGS), make(kid, within)]

        placed = [(at, item(at, x)) for at, x in rows(level)]
        of = lambda where: [x for at, x in placed if at[0] == where]
        return [of("head"), {x[0]: x for x in of("mid")}, of("tail"), root.get("order", -1)]

    return make(root, False)


def by_plan(page: Node, decided: list) -> str | None:
    """The main text as a host's plan decides; None if its wrapper doesn't match the page."""
    best: list = [None, None, None]  # order, position, lines
    heads: list[tuple[int, str]] = []
    at = 0

    def walk(node: Node, level: list, into: list[list[str]]) -> bool:
        nonlocal at
        head, mid, tail = level[:3]
        rest = len(node.children) - len(tail)
        if rest < len(head):
            return False
        for k, c in enumerate(node.children):
            item = head[k] if k < len(head) else tail[k - rest] if k >= rest else mid.get(c.label)
            if item is None or item[0] != c.label:
                return False
            at += 1
            if c.tag == "#":
                if item[1] and (line := c.text()):
                    for lines in into:
                        lines.append(line)
            elif item[3]:
                inner = into
                if item[1] >= 0 and (best[0] is None or item[1] < best[0]):
                    best[:] = item[1], at, []
                    inner = [best[2]]
                elif item[2]:
                    heads.append((at, lines := []))
                    inner = [*into, lines]
                if not walk(c, item[3], inner):
                    return False
        return True

    whole: list[str] = []
    if decided[3] >= 0:
        best[:] = decided[3], 0, whole
    if not walk(page, decided, [whole]):
        return None
    if best[0] is None:
        return "\n".join(whole)
    return "\n".join([*(x for p, lines in heads if p < best[1] for x in lines), *best[2]])


def main_text(source: str | None, decided: list | None) -> tuple[str, bool]:
    """The main text of a page, and whether its host's wrapper decided it."""
    page = parse(source)
    found = by_plan(page, decided) if decided is not None else None
    return (found, True) if found is not None else (by_names(page), False)


def host_of(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1))


def _text(wrapper: list) -> str:
    return json.dumps(wrapper, ensure_ascii=False, separators=(",", ":"))


def wrappers(spark: SparkSession, pages: DataFrame) -> DataFrame:
    """(host, wrapper) for every host, from all of its pages, as JSON.

    Each task aligns its pages of a host before anything is shuffled; then shares of a host are
    aligned as sorted streams, and the wrappers of the shares. One wrapper is held at a time."""
    importable(spark)
    names, types = ["host", "share", "wrapper"], [pa.string(), pa.int32(), pa.string()]

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        share, held = TaskContext.get().partitionId() % SALTS, {}
        for batch in batches:
            for host, source in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if host not in held and len(held) >= HELD:
                    yield batch_of([(h, share, _text(w)) for h, w in held.items()])
                    held = {}
                held[host] = more(held.get(host), one_page(parse(source)))
        if held:
            yield batch_of([(h, share, _text(w)) for h, w in held.items()])

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, wrapper = None, None
        for batch in batches:
            for host, share, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if wrapper is not None and (host, share) != now:
                    yield batch_of([(*now, _text(wrapper))])
                    wrapper = None
                now, wrapper = (host, share), more(wrapper, json.loads(text))
        if wrapper is not None:
            yield batch_of([(*now, _text(wrapper))])

    schema = "host string, share int, wrapper string"
    parts = pages.select(host_of(F.col("url")).alias("host"), "html").mapInArrow(local, schema)
    shares = parts.repartition("host", "share").sortWithinPartitions("host", "share", "wrapper").mapInArrow(joined, schema)
    whole = shares.withColumn("share", F.lit(0)).repartition("host").sortWithinPartitions("host", "wrapper").mapInArrow(joined, schema)
    return whole.select("host", "wrapper")


def plans(found: DataFrame) -> DataFrame:
    """(host, plan) for every host whose wrapper decides, as JSON."""

    def make():
        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            decided = [plan(json.loads(w)) for w in batch.column(1).to_pylist()]
            return pa.RecordBatch.from_arrays([batch.column(0), pa.array([None if d is None else _text(d) for d in decided], pa.string())], names=["host", "plan"])

        return work

    return map_slices(found, make, "host string, plan string", rows=64).where("plan is not null")


def extract(spark: SparkSession, pages: DataFrame) -> DataFrame:
    """(page_id, url, text, by_wrapper) for every row. Hosts' plans are joined to the pages; where
    they are too many to be broadcast, the pages of a host are spread over SPREAD tasks at least."""
    importable(spark)
    known = stored(spark, plans(wrappers(spark, pages)), "plans").select(F.col("host").alias("of"), "plan", F.explode(F.sequence(F.lit(0), F.lit(SPREAD - 1))).alias("part"))
    rows = pages.select("page_id", "url", "html", host_of(F.col("url")).alias("host"), F.pmod(F.xxhash64("page_id", "html"), F.lit(SPREAD)).cast("int").alias("nth"))
    joined = rows.join(known, F.col("host").eqNullSafe(F.col("of")) & (F.col("nth") == F.col("part")), "left").select("page_id", "url", "html", "plan")
    id_type = pages.schema["page_id"].dataType.simpleString()

    def make():
        read: dict[str | None, list | None] = {None: None}

        def decided(text: str | None) -> list | None:
            if text not in read:
                if len(read) > HELD:
                    read.clear()
                    read[None] = None
                read[text] = json.loads(text)
            return read[text]

        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            found = [main_text(h, decided(p)) for h, p in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)]
            return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([t for t, _ in found], pa.string()), pa.array([m for _, m in found], pa.bool_())], names=["page_id", "url", "text", "by_wrapper"])

        return work

    return map_slices(joined, make, f"page_id {id_type}, url string, text string, by_wrapper boolean")
