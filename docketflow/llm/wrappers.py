"""Main text of pages by union-free regular expressions, one wrapper a host.

A wrapper is a tree of elements, each with an ordered set of children: text
slots (``#``), elements that every page has, optional ones and repeated groups.
A page's stream of tags is aligned with the wrapper of its host as it is read:
an element that the wrapper lacks becomes optional, one that some page lacks
becomes optional too, children that recur or come in another order become a repeated
group of optional members, and a text that differs from page to page makes its
place a slot.  Tasks do so for their own pages; wrappers of one host are then
aligned with each other, ``FAN`` at a time, so a host of any size is never in
one group.  A wrapper of over ``MOST_ELEMENTS`` elements is not made in one piece: its
elements are rows that Spark groups (``wide_wrappers``), with the same rules.

A finished wrapper tells what to keep: the part of the template that holds most
of the text in slots, without what its tag, its names, its links or its
unvarying text mark as menus, notices, adverts and the like.  A page that lacks
that part, or has no host, is its own wrapper.

Defined cases: null html and pages without text give an empty text; a null url,
or one without a host, is a host of its own page alone; repeated page_ids and
repeated pages are extracted each; an unvarying text counts as template only
where pages differ in other respects; tags may be missing, unclosed or crossed; a
page of any length is taken whole; an empty table gives no rows; extra columns
are ignored.
"""

from __future__ import annotations

import json
import zlib
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docketflow.llm.html_tokens import events, label_words, tag_of
from docketflow.llm.shared import table, written

#: Wrappers of one host that are aligned in one group.
FAN = 64
#: Elements of a wrapper, beyond which it is no longer one value but rows (``wide_wrappers``).
MOST_ELEMENTS = 20_000
#: Bytes of wrappers that are broadcast at most, and shares of a host's pages where they are merged.
MOST_BYTES, SALTS = 16 << 20, 16
#: Different pages that must agree before an unvarying text counts as template.
LEAST_PAGES = 5
_TEXT = "#"
_VARIES = -1
#: Tags of parts that are no article, and tags whose header is the article's own.
PARTS = frozenset(("nav", "footer", "aside", "form", "button", "dialog", "menu", "head", "fieldset", "legend", "label"))
BODIES = frozenset(("main", "article"))
ROOTS = frozenset(("html", "body", "main"))
#: Words of class, id and role names that mark parts that are no article.
WORDS = frozenset(
    (
        "ad", "ads", "adsense", "advert", "adverts", "advertisement", "advertising", "sponsor", "sponsored", "promo", "promoted", "promotion", "banner",
        "nav", "navbar", "navigation", "menu", "breadcrumb", "breadcrumbs", "pagination", "pager", "toolbar", "topbar", "header", "masthead", "footer", "contentinfo",
        "sidebar", "aside", "rail", "widget", "widgets", "complementary", "cookie", "cookies", "consent", "gdpr", "notice", "notices", "alert", "popup", "modal",
        "overlay", "dialog", "paywall", "newsletter", "subscribe", "subscription", "signup", "login", "share", "sharing", "social", "follow", "related",
        "recommended", "recommendations", "trending", "comment", "comments", "disqus", "respond", "reply", "replies", "discussion", "form", "search", "copyright", "disclaimer",
    )
)
#: Words beside "header" that make it the article's own.
OWN = frozenset(("article", "entry", "post", "story", "content", "section", "block", "card", "title"))
#: Words that say an element only lives with such a part.
ABOUT = frozenset(("no", "has", "with", "without", "enabled", "disabled", "open", "closed", "layout"))


@lru_cache(maxsize=50_000)
def by_name(label: str) -> bool:
    """Whether an element's tag or names alone say that it is no part of an article (a header is judged where it stands)."""
    tag, names = label_words(label)
    if label.endswith("!") or tag in PARTS:
        return True
    marks = [WORDS & set(words) for words in names if not ABOUT & set(words)]
    return tag not in ROOTS and any(m and not (m == {"header"} and OWN & set(sum(names, []))) for m in marks)


class Node:
    """An element or text slot of a wrapper with what was seen of it."""

    __slots__ = ("kids", "order", "loops", "many", "pages", "chars", "links", "value", "last")

    def __init__(self):
        self.kids: dict[str, Node] = {}
        self.order: list[str] = []
        self.loops: list[set[str]] = []  # children in repeated groups
        self.many: set[str] = set()  # children that an element has more than once
        self.pages = self.chars = self.links = 0
        self.value = 0  # of a text slot: the text's hash while it is the same in all pages
        self.last = -1

    def align(self, found: list[str]) -> None:
        """Takes in the children of one more element: new ones find their place, what recurs or changes places makes a group."""
        runs = [x for i, x in enumerate(found) if not i or found[i - 1] != x]
        first: dict[str, int] = {}
        last: dict[str, int] = {}
        for i, x in enumerate(runs):
            first.setdefault(x, i)
            last[x] = i
        end, span = -1, set()
        for i, x in enumerate(runs):
            if i > end and len(span) > 1:
                self.join(span)
                span = set()
            elif i > end:
                span = set()
            span.add(x)
            end = max(end, last[x])
        if len(span) > 1:
            self.join(span)
        if len(found) != len(runs):
            for x in {x for i, x in enumerate(found) if i and found[i - 1] == x}:
                self.join({x})
        if len(found) != len(first):
            self.many |= {x for x, n in Counter(found).items() if n > 1}
        place, after = {x: i for i, x in enumerate(self.order)}, -1
        for x in first:
            if x in place:
                if place[x] < after:  # another order than before
                    self.join(set(self.order[place[x] : after + 1]))
                after = max(after, place[x])
            else:
                self.order.insert(after + 1, x)
                after += 1
                place = {x: i for i, x in enumerate(self.order)}

    def join(self, labels: set[str]) -> None:
        joined, rest = set(labels), []
        for loop in self.loops:
            if loop & joined:
                joined |= loop
            else:
                rest.append(loop)
        self.loops = [*rest, joined]

    def add(self, other: Node) -> None:
        """Aligns another wrapper of the same host with this one."""
        if self.pages and other.pages and self.value != other.value:
            self.value = _VARIES
        elif not self.pages:
            self.value = other.value
        self.pages, self.chars, self.links = self.pages + other.pages, self.chars + other.chars, self.links + other.links
        self.align(other.order)
        for loop in other.loops:
            self.join(loop)
        self.many |= other.many
        for name, kid in other.kids.items():
            self.kids.setdefault(name, Node()).add(kid)

    def plain(self) -> list:
        return [self.pages, self.chars, self.links, self.value, self.order, [sorted(x) for x in self.loops], sorted(self.many), [self.kids[x].plain() for x in self.order]]

    @staticmethod
    def of(plain: list) -> Node:
        node = Node()
        node.pages, node.chars, node.links, node.value, node.order, loops, many, kids = plain
        node.many = set(many)
        node.loops = [set(x) for x in loops]
        node.kids = {x: Node.of(kid) for x, kid in zip(node.order, kids, strict=True)}
        return node

    def expression(self, label: str = "") -> str:
        """The wrapper as a regular expression over tags, ``#`` for slots."""
        if label == _TEXT:
            return "#" if self.value == _VARIES else "#text"
        parts, told = [], set()
        for x in self.order:
            loop = next((group for group in self.loops if x in group), None)
            if loop is None:
                own = self.kids[x].expression(x)
                parts.append(own if self.kids[x].pages == self.pages else f"({own})?")
            elif x not in told:
                told |= loop
                members = [self.kids[y].expression(y) for y in self.order if y in loop]
                parts.append(f"({members[0]})+" if len(members) == 1 else "(" + "".join(f"({y})?" for y in members) + ")+")
        return f"<{label}>{''.join(parts)}</{label}>" if label else "".join(parts)


class Wrapper:
    """A host's wrapper in the making: its root and hashes of up to LEAST_PAGES different pages."""

    def __init__(self, root: Node | None = None, different: list[int] | None = None):
        self.root, self.different = root or Node(), different or []
        self.size = 1  # elements, counted while pages are read
        self.wide = False

    def read(self, stream: list[tuple]) -> None:
        """Aligns the stream of one more page."""
        page = self.root.pages
        path, found = [self.root], [[]]
        self.root.pages += 1
        whole = 0
        for event in stream:
            if not event:
                node, labels = path.pop(), found.pop()
                node.align(labels)
                continue
            name = event[0] if len(event) == 1 else _TEXT
            found[-1].append(name)
            node = path[-1].kids.get(name)
            if node is None:
                node = path[-1].kids[name] = Node()
                self.size += 1
            new = node.last != page
            node.last = page
            node.pages += new
            if len(event) == 1:
                path.append(node)
                found.append([])
                continue
            text, links = event
            value = zlib.crc32(text.encode("utf-8", "surrogatepass"))
            whole = zlib.crc32(text.encode("utf-8", "surrogatepass"), whole)
            if not node.chars:
                node.value = value
            elif node.value != value:
                node.value = _VARIES
            node.chars += len(text)
            node.links += links
        self.root.align(found[0])
        self.see([whole])

    def see(self, pages: list[int]) -> None:
        self.different = sorted({*self.different, *pages})[:LEAST_PAGES]

    def add(self, other: Wrapper) -> None:
        self.root.add(other.root)
        self.see(other.different)

    def bounded(self, size: int, most: int) -> None:
        """Keeps the number of pages alone, and says so, if there are too many elements for one value."""
        if size > most:
            pages = self.root.pages
            self.root, self.size, self.wide = Node(), 1, True
            self.root.pages = pages

    def packed(self) -> bytes:
        return zlib.compress(json.dumps([self.root.plain(), self.different], ensure_ascii=False).encode("utf-8", "surrogatepass"), 1)

    @staticmethod
    def unpacked(raw: bytes) -> Wrapper:
        root, different = json.loads(zlib.decompress(raw).decode("utf-8", "surrogatepass"))
        return Wrapper(Node.of(root), different)

    def shrunk(self) -> Wrapper:
        """Without the elements of the fewest pages, if there are too many."""
        while (count := _elements(self.root)) > MOST_ELEMENTS:
            _prune(self.root, sorted(_pages(self.root))[count - MOST_ELEMENTS])
        return self

    def rules(self) -> dict:
        """The tree of what to drop and where the article is: {label: [drop, main, kids]}."""
        template = len(self.different) >= LEAST_PAGES
        total = _mass(self.root, "", False, template)
        kids = {x: _rule(kid, x, False, template, total) for x, kid in self.root.kids.items()}
        rule = [False, False, kids]
        _mark_main(rule, self.root, "", template)
        return rule


def _elements(node: Node) -> int:
    return 1 + sum(map(_elements, node.kids.values()))


def _pages(node: Node) -> list[int]:
    return [node.pages, *(n for kid in node.kids.values() for n in _pages(kid))]


def _prune(node: Node, most: int) -> None:
    node.kids = {x: kid for x, kid in node.kids.items() if kid.pages > most}
    node.order = [x for x in node.order if x in node.kids]
    node.loops = [loop & node.kids.keys() for loop in node.loops]
    for kid in node.kids.values():
        _prune(kid, most)


def _unvarying(node: Node, parent: str, template: bool) -> bool:
    return template and node.value != _VARIES and node.pages >= LEAST_PAGES and tag_of(parent) not in ("h1", "h2", "h3")


def _all_text(node: Node) -> tuple[int, int]:
    """Letters, and those in links, of an element."""
    chars, links = node.chars, node.links
    for kid in node.kids.values():
        c, li = _all_text(kid)
        chars, links = chars + c, links + li
    return chars, links


def _drops(node: Node, label: str, inside: bool, total: float) -> bool:
    """Whether an element is no part of an article; ``inside``: it stands in one."""
    tag = tag_of(label)
    chars, links = _all_text(node)
    if tag == "form" and total and chars - links > total / 2:  # a form about the whole page
        return False
    if by_name(label) or (tag == "header" and not inside):
        return True
    return tag in ("ul", "ol", "div", "section", "table", "td") and chars > 0 and links >= 0.8 * chars and _items(node) >= 3


def _items(node: Node) -> float:
    """Parts of an element in a page: the most children in it or in one of its own (a repeated group counts as three)."""
    own = 3.0 * sum(x in node.many for x in node.kids) + sum(kid.pages for x, kid in node.kids.items() if x not in node.many) / max(node.pages, 1)
    return max(own, max(map(_items, node.kids.values()), default=0))


def _mass(node: Node, label: str, inside: bool, template: bool, total: float = 0) -> float:
    """Letters outside links in slots of what is not dropped."""
    inside = inside or tag_of(label) in BODIES
    mass = 0
    for x, kid in node.kids.items():
        if x == _TEXT:
            mass += 0 if _unvarying(kid, label, template) else kid.chars - kid.links
        elif not _drops(kid, x, inside, total):
            mass += _mass(kid, x, inside, template, total)
    return mass


def _rule(node: Node, label: str, inside: bool, template: bool, total: float) -> list:
    drop = _drops(node, label, inside, total)
    inside = inside or tag_of(label) in BODIES
    kids = {}
    for x, kid in node.kids.items():
        kids[x] = [_unvarying(kid, label, template), False, {}] if x == _TEXT else _rule(kid, x, inside, template, total)
    return [drop, False, kids]


def _has_title(node: Node, label: str, rule: list, template: bool) -> bool:
    """Whether there is a title that varies, or any where pages do not tell."""
    if rule[0]:
        return False
    if tag_of(label) in ("h1", "h2"):
        return _TEXT in node.kids and (not template or node.kids[_TEXT].value == _VARIES)
    return any(_has_title(kid, x, rule[2][x], template) for x, kid in node.kids.items() if x != _TEXT)


def _mark_main(rule: list, node: Node, label: str, template: bool) -> None:
    """Goes down from the root while one child holds most of the text, and marks where it stops.

    A title beside that child keeps its parent; so do children that repeat, which
    are parts of one text.
    """
    inside = False
    while True:
        inside = inside or tag_of(label) in BODIES
        masses = {x: _mass(kid, x, inside, template) for x, kid in node.kids.items() if x != _TEXT and not rule[2][x][0]}
        text = node.kids.get(_TEXT)
        whole = sum(masses.values()) + (text.chars - text.links if text and not rule[2][_TEXT][0] else 0)
        if not masses:
            break
        best = max(masses, key=lambda x: (masses[x], x))
        repeated = best in node.many
        blocks = any(x != _TEXT for x in node.kids[best].kids)
        least = 0.5 if tag_of(best) in BODIES else 0.6
        titled = [_has_title(node.kids[x], x, rule[2][x], template) for x in (best, *(x for x in masses if x != best))]
        if not whole or masses[best] < least * whole or not blocks or repeated or (any(titled[1:]) and not titled[0]):
            break
        rule, node, label = rule[2][best], node.kids[best], best
    rule[1] = True


def kept_text(stream: list[tuple], rules: dict) -> str | None:
    """The blocks that a wrapper's rules keep, one a line; None if the page lacks the article's place."""
    blocks, found = [], rules[1]
    # Of each open element: its rule (None: unknown to the wrapper), whether it is in the article, whether it is dropped.
    path = [(rules, rules[1], rules[0])]
    for event in stream:
        if not event:
            path.pop()
            continue
        rule, inside, drop = path[-1]
        own = rule[2].get(event[0] if len(event) == 1 else _TEXT) if rule else None
        if len(event) == 1:
            gone = drop or (own[0] if own else by_name(event[0]))
            now = inside or bool(own and own[1])
            found = found or (now and not gone)
            path.append((own, now, gone))
        elif inside and not drop and not (own and own[0]):
            blocks.append(event[0])
    return "\n".join(blocks) if found and (blocks or not any(len(e) == 2 for e in stream)) else None


def main_text(stream: list[tuple], rules: dict | None) -> str:
    text = kept_text(stream, rules) if rules else None
    if text is None:
        own = Wrapper()
        own.read(stream)
        text = kept_text(stream, own.rules())
    return text or ""


def host_of(url):
    """The lower-case host of a url; '' where there is none."""
    return F.lower(F.coalesce(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1), F.lit("")))


_PACKED = "host string, n long, wrapper binary"


def _rows(found: dict[str, Wrapper]) -> Iterator[pa.RecordBatch]:
    for host, w in found.items():
        yield pa.RecordBatch.from_arrays([pa.array([host]), pa.array([w.root.pages], pa.int64()), pa.array([None if w.wide else w.packed()], pa.binary())], ["host", "n", "wrapper"])


def _inferred(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    found: dict[str, Wrapper] = {}
    size = 0
    for batch in batches:
        for host, page in zip(batch.column("host").to_pylist(), batch.column("html").to_pylist(), strict=True):
            w = found.setdefault(host, Wrapper())
            if w.wide:
                w.root.pages += 1
                continue
            before = w.size
            w.read(events(page or "", by_name))
            w.bounded(w.size, most)
            size += w.size - before
            if size > 5 * most:
                yield from _rows(found)
                found, size = {}, 0
        if len(found) > 2000:
            yield from _rows(found)
            found, size = {}, 0
    yield from _rows(found)


def _joined(group: pa.Table, most: int) -> pa.Table:
    parts = group.column("wrapper")
    whole = Wrapper()
    whole.wide = parts.null_count > 0
    for raw in [] if whole.wide else sorted(parts.to_pylist()):
        whole.add(Wrapper.unpacked(raw))
        whole.bounded(_elements(whole.root), most)
        if whole.wide:
            break
    whole.root.pages = sum(group.column("n").to_pylist())
    return pa.Table.from_batches(list(_rows({group.column("host")[0].as_py(): whole})))


def wrappers(pages: DataFrame) -> DataFrame:
    """(host, n, wrapper) of ``pages(url, html)``: a packed wrapper of the ``n`` pages of each host; null if it has over MOST_ELEMENTS elements."""
    bound = MOST_ELEMENTS
    rows = pages.select(host_of("url").alias("host"), "html").where("host <> ''").mapInArrow(lambda batches: _inferred(batches, bound), _PACKED)
    rows = written(rows.withColumn("slot", F.monotonically_increasing_id()), "part-wrappers")
    # Shares of a host's rows by hash; with one share left, a last round makes one row of each host.
    most = rows.groupBy("host").count().agg(F.max("count")).first()[0] or 1
    while most > 1:
        most = -(-most // FAN)
        share = F.pmod(F.xxhash64("slot"), F.lit(most))
        rows = rows.groupBy("host", share.alias("share")).applyInArrow(lambda g: _joined(g, bound), _PACKED)
        rows = written(rows.withColumn("slot", F.monotonically_increasing_id()), "part-wrappers")
    return rows.select(*_PACKED.replace(",", "").split()[::2])


def _expressions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [None if x is None else Wrapper.unpacked(x).root.expression() for x in batch.column("wrapper").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("host"), batch.column("n"), pa.array(texts, pa.string())], ["host", "n", "expression"])


def expressions(found: DataFrame) -> DataFrame:
    """(host, n, expression): wrappers in writing; null where there is none in one value."""
    return found.select("host", "n", "wrapper").mapInArrow(_expressions, "host string, n long, expression string")


def _extracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rules: dict[bytes, dict] = {}
    for batch in batches:
        texts = []
        for page, raw in zip(batch.column("html").to_pylist(), batch.column("wrapper").to_pylist(), strict=True):
            if raw is not None and raw not in rules:
                if len(rules) > 500:
                    rules.clear()
                rules[raw] = Wrapper.unpacked(raw).rules()
            texts.append(main_text(events(page or "", by_name), rules.get(raw)))
        yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string())], ["page_id", "url", "text"])


def extracted(pages: DataFrame) -> DataFrame:
    """(page_id, url, text) of ``pages(page_id, url, html)`` by the wrappers of their hosts."""
    pages = pages.select("page_id", "url", "html", host_of("url").alias("host"))
    found = wrappers(pages).select("host", "wrapper")
    wide = found.where("wrapper IS NULL").select("host")  # a row for each host of so many elements
    if not wide.isEmpty():
        from docketflow.llm import wide_wrappers

        rest = wide_wrappers.extracted(pages.join(F.broadcast(wide), "host", "left_semi"))
        return _by_value(pages.join(F.broadcast(wide), "host", "left_anti"), found.where("wrapper IS NOT NULL")).unionByName(rest)
    return _by_value(pages, found)


def _by_value(pages: DataFrame, found: DataFrame) -> DataFrame:
    """The texts of ``pages`` by wrappers that are one value each."""
    size = found.agg(F.coalesce(F.sum(F.octet_length("wrapper")), F.lit(0))).first()[0]
    if size <= MOST_BYTES:
        rows = pages.join(F.broadcast(found), "host", "left")
    else:
        salted = found.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        rows = pages.withColumn("salt", F.pmod(F.xxhash64("page_id", "url"), F.lit(SALTS)).cast("int")).join(salted.hint("merge"), ["host", "salt"], "left")
    return rows.select(F.col("page_id").cast("long").alias("page_id"), "url", "html", "wrapper").mapInArrow(_extracted, "page_id long, url string, text string")


def op12_wrappers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every row of ``pages``."""
    return extracted(table(spark, sf_dir, "pages", "page_id", "url", "html")).select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))


QUERIES = {"op12_wrappers": op12_wrappers}
ORACLE = {}
