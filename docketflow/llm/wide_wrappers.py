"""Wrappers of too many elements for one task: one row an element, and the rules of ``wrappers`` by joins and groups.

An element is known by a digest of its path.  Tasks align their own pages and
give out what they have as rows, which meet by path; letters, parts, titles and
the way down to the article are sums and maxima over the paths of elements.
A page then meets only the rules of its own elements that differ from what their names say.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docketflow.llm import wrappers as W
from docketflow.llm.html_tokens import events, tag_of
from docketflow.llm.shared import written

_ROOT = b"root"
_ELEMENTS = (
    "host string, path binary, parent binary, above array<binary>, label string, tag string, parent_tag string, named boolean, inside boolean, head int, many boolean, "
    "pages long, chars long, links long, value long, all_chars long, all_links long, different array<long>"
)
_NAMES = [c.split()[0] for c in _ELEMENTS.split(", ")]
_BINARIES = pa.list_(pa.binary())
_SCHEMA = pa.schema(
    [
        (name, {"string": pa.string(), "binary": pa.binary(), "array<binary>": _BINARIES, "array<long>": pa.list_(pa.int64()), "boolean": pa.bool_(), "int": pa.int32(), "long": pa.int64()}[kind])
        for name, kind in (c.split() for c in _ELEMENTS.split(", "))
    ]
)


def _path(parent: bytes, label: str) -> bytes:
    return blake2b(parent + label.encode("utf-8", "surrogatepass"), digest_size=16).digest()


def _given_out(host: str, w: W.Wrapper) -> Iterator[pa.RecordBatch]:
    """The elements of a wrapper in the making, parents first."""
    found, up, chars, links = [], [], [], []
    # ``head``: place of the deepest h1 or h2 above the parent.
    stack = [(w.root, "", _ROOT, [], "", False, -1, False, -1)]
    while stack:
        node, label, path, above, parent_tag, inside, head, many, parent = stack.pop()
        tag, at = tag_of(label), len(found)
        found.append((host, path, above[-1] if above else None, above, label, tag, parent_tag, label not in ("", W._TEXT) and W.by_name(label), inside, head, many, node.pages, node.chars, node.links, node.value))
        up.append(parent)
        chars.append(node.chars)
        links.append(node.links)
        below = above + [path]
        over = len(above) - 1 if parent_tag in ("h1", "h2") else head
        for x, kid in node.kids.items():
            stack.append((kid, x, _path(path, x), below, tag, inside or tag in W.BODIES, over, x in node.many, at))
    for i in range(len(found) - 1, 0, -1):
        chars[up[i]] += chars[i]
        links[up[i]] += links[i]
    rows = [(*row, c, n, w.different if not i else None) for i, (row, c, n) in enumerate(zip(found, chars, links, strict=True))]
    for i in range(0, len(rows), 5000):
        yield pa.RecordBatch.from_arrays([pa.array(column, kind.type) for column, kind in zip(zip(*rows[i : i + 5000], strict=True), _SCHEMA, strict=True)], schema=_SCHEMA)


def _aligned(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    found: dict[str, W.Wrapper] = {}
    size = 0
    for batch in batches:
        for host, page in zip(batch.column("host").to_pylist(), batch.column("html").to_pylist(), strict=True):
            w = found.setdefault(host, W.Wrapper())
            size -= w.size
            w.read(events(page or "", W.by_name))
            size += w.size
            if size > most:
                for h, x in found.items():
                    yield from _given_out(h, x)
                found, size = {}, 0
    for h, x in found.items():
        yield from _given_out(h, x)


def elements(pages: DataFrame) -> DataFrame:
    """A row for each element of the wrappers of ``pages(host, html)``."""
    most = W.MOST_ELEMENTS
    rows = written(pages.select("host", "html").mapInArrow(lambda batches: _aligned(batches, most), _ELEMENTS), "element-parts")
    same = [F.first(c).alias(c) for c in ("parent", "above", "label", "tag", "parent_tag", "named", "inside", "head")]
    sums = [F.sum(c).alias(c) for c in ("pages", "chars", "links", "all_chars", "all_links")]
    value = F.when(F.min("value") == F.max("value"), F.min("value")).otherwise(W._VARIES).alias("value")
    template = rows.where("parent IS NULL").select("host", F.explode("different").alias("page")).groupBy("host").agg((F.count_distinct("page") >= W.LEAST_PAGES).alias("template"))
    # One row a host of thousands of elements.
    return written(rows.groupBy("host", "path").agg(*same, *sums, value, F.bool_or("many").alias("many")).join(F.broadcast(template), "host"), "elements")


def _salted(left: DataFrame, right: DataFrame, keys: list[str], by: str, how: str = "inner") -> DataFrame:
    """A join in which the rows of a frequent key on the left are spread over tasks by their ``by``."""
    copies = right.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(W.SALTS - 1))))
    return left.withColumn("salt", F.pmod(F.xxhash64(by), F.lit(W.SALTS)).cast("int")).join(copies.hint("merge"), [*keys, "salt"], how).drop("salt")


def _deepest(slots: DataFrame, dropped: DataFrame) -> DataFrame:
    """``slots`` with the place of the deepest of ``dropped(host, path)`` above each in ``deepest``; -1 if there is none."""
    places = slots.select("host", "path", F.posexplode("above").alias("place", "at"))
    hit = _salted(places, dropped.select("host", F.col("path").alias("at")), ["host", "at"], "path").groupBy("host", "path").agg(F.max("place").alias("deepest"))
    return slots.join(hit.hint("merge"), ["host", "path"], "left").withColumn("deepest", F.coalesce("deepest", F.lit(-1)))


def _from(place: Column) -> Column:
    """The part of ``above`` from a place (0 is the root) on."""
    return F.slice("above", place + 1, F.greatest(F.size("above") - place, F.lit(0)))


def rules(found: DataFrame) -> DataFrame:
    """(host, path, drop, main): where the rules of ``elements`` differ from what names say."""
    path = ["host", "path"]
    below = found.where("parent IS NOT NULL").groupBy("host", F.col("parent").alias("path")).agg(
        F.count_if("many").alias("groups"), F.sum(F.when(~F.col("many"), F.col("pages")).otherwise(0)).alias("single"), (F.count_if(F.col("label") != W._TEXT) > 0).alias("blocks")
    )
    tags = found.where(F.col("label") != W._TEXT).join(below.hint("merge"), path, "left")
    own = F.lit(3.0) * F.col("groups") + F.col("single") / F.greatest("pages", F.lit(1))
    items = tags.select("host", F.explode(F.concat("above", F.array("path"))).alias("path"), F.coalesce(own, F.lit(0.0)).alias("own")).groupBy(*path).agg(F.max("own").alias("items"))
    listed = F.col("tag").isin("ul", "ol", "div", "section", "table", "td") & (F.col("all_chars") > 0) & (F.col("all_links") >= F.lit(0.8) * F.col("all_chars")) & (F.col("items") >= 3)
    gone = F.col("parent").isNotNull() & (F.col("named") | ((F.col("tag") == "header") & ~F.col("inside")) | listed)
    tags = written(tags.join(items.hint("merge"), path).withColumn("gone", gone), "element-tags")

    unvarying = F.col("template") & (F.col("value") != W._VARIES) & (F.col("pages") >= W.LEAST_PAGES) & ~F.col("parent_tag").isin("h1", "h2", "h3")
    slots = found.where(F.col("label") == W._TEXT).withColumn("unvarying", unvarying)
    slots = slots.withColumn("mass", F.when(F.col("unvarying"), 0).otherwise(F.col("chars") - F.col("links")))
    slots = written(_deepest(slots, tags.where("gone")), "element-slots")
    total = slots.where("deepest < 0").groupBy("host").agg(F.sum("mass").alias("total"))  # one row a host
    form = (F.col("tag") == "form") & (F.coalesce("total", F.lit(0)) != 0) & (F.col("all_chars") - F.col("all_links") > F.col("total") / 2)
    tags = written(tags.join(F.broadcast(total), "host", "left").withColumn("drop", F.col("gone") & ~F.coalesce(form, F.lit(False))), "element-drops")

    mass = slots.select("host", "mass", F.explode(_from(F.greatest("deepest", F.lit(0)))).alias("path")).groupBy(*path).agg(F.sum("mass").alias("mass"))
    heads = slots.where(F.col("parent_tag").isin("h1", "h2") & (~F.col("template") | (F.col("value") == W._VARIES))).drop("deepest")
    heads = _deepest(heads, tags.where("drop"))
    titled = heads.select("host", F.explode(_from(F.greatest("deepest", "head") + 1)).alias("path")).distinct().withColumn("titled", F.lit(True))
    kids = tags.where("parent IS NOT NULL AND NOT drop").join(mass.hint("merge"), path, "left").join(titled.hint("merge"), path, "left")
    kids = kids.withColumns({"mass": F.coalesce("mass", F.lit(0)), "titled": F.coalesce("titled", F.lit(False)), "blocks": F.coalesce("blocks", F.lit(False))})
    best = F.max_by(F.struct("path", "above", "tag", "blocks", "many", "mass", "titled"), F.struct("mass", "label")).alias("best")
    ways = kids.groupBy("host", "parent").agg(best, F.sum("mass").alias("whole"), F.count_if("titled").alias("titles"))
    ways = ways.join(slots.select("host", "parent", F.col("mass").alias("said")).hint("merge"), ["host", "parent"], "left").withColumn("whole", F.col("whole") + F.coalesce("said", F.lit(0)))
    least = F.when(F.col("best.tag").isin(*W.BODIES), 0.5).otherwise(0.6)
    on = (F.col("whole") != 0) & (F.col("best.mass") >= least * F.col("whole")) & F.col("best.blocks") & ~F.col("best.many") & (F.col("best.titled") | (F.col("titles") == 0))
    steps = written(ways.where(on).select("host", "best.path", "best.above"), "element-steps")
    # Reached from the root: every element above but the root is a step too.
    over = steps.select("host", "path", F.explode(_from(F.lit(1))).alias("at")).join(steps.select("host", F.col("path").alias("at")).hint("merge"), ["host", "at"]).groupBy(*path).count()
    reached = steps.join(over.hint("merge"), path, "left").where(F.coalesce("count", F.lit(0)) == F.size("above") - 1)
    main = reached.groupBy("host").agg(F.max_by("path", F.size("above")).alias("main"))  # one row a host
    tags = tags.join(F.broadcast(main), "host", "left").withColumn("main", F.col("path") == F.coalesce("main", F.lit(_ROOT)))
    return tags.where("main OR drop <> named").select("host", "path", "drop", "main").unionByName(slots.where("unvarying").select("host", "path", F.lit(True).alias("drop"), F.lit(False).alias("main")))


def _tree(stream: list[tuple], told: dict[bytes, tuple[bool, bool]]) -> dict:
    """The rules of a page's own elements, as ``Wrapper.rules`` has them."""
    root = [*told.get(_ROOT, (False, False)), {}]
    path = [(root, _ROOT)]
    for event in stream:
        if not event:
            path.pop()
            continue
        (rule, digest), name = path[-1], event[0] if len(event) == 1 else W._TEXT
        own = _path(digest, name)
        if name not in rule[2]:
            rule[2][name] = [*told.get(own, (len(event) == 1 and W.by_name(name), False)), {}]
        if len(event) == 1:
            path.append((rule[2][name], own))
    return root


def _paths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for host, doc, page in zip(batch.column("host").to_pylist(), batch.column("doc").to_pylist(), batch.column("html").to_pylist(), strict=True):
            found, path = {_ROOT}, [_ROOT]
            for event in events(page or "", W.by_name):
                if not event:
                    path.pop()
                    continue
                own = _path(path[-1], event[0] if len(event) == 1 else W._TEXT)
                found.add(own)
                if len(event) == 1:
                    path.append(own)
            yield pa.RecordBatch.from_arrays([pa.array([host] * len(found)), pa.array([doc] * len(found)), pa.array(sorted(found), pa.binary())], ["host", "doc", "path"])


def _kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = []
        for page, told in zip(batch.column("html").to_pylist(), batch.column("rules").to_pylist(), strict=True):
            stream = events(page or "", W.by_name)
            texts.append(W.main_text(stream, _tree(stream, {r["path"]: (r["drop"], r["main"]) for r in told or []})))
        yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string())], ["page_id", "url", "text"])


def extracted(pages: DataFrame) -> DataFrame:
    """(page_id, url, text) of ``pages(page_id, url, html, host)``, whose hosts have wrappers of any size."""
    # Equal pages of a host have equal texts, so a digest names a page.
    pages = pages.withColumn("doc", F.sha2(F.coalesce("html", F.lit("")), 256))
    told = _salted(pages.select("host", "doc", "html").mapInArrow(_paths, "host string, doc string, path binary"), rules(elements(pages)), ["host", "path"], "doc")
    told = told.groupBy("host", "doc").agg(F.collect_set(F.struct("path", "drop", "main")).alias("rules"))
    rows = pages.join(told.hint("merge"), ["host", "doc"], "left")
    return rows.select(F.col("page_id").cast("long").alias("page_id"), "url", "html", "rules").mapInArrow(_kept, "page_id long, url string, text string")
