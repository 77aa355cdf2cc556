"""MinHash near-duplicates by fast similarity sketching, banding and exact verification.

A sketch is filled in rounds: in each round every shingle falls into one
hashed coordinate with a value that grows with the round, and a coordinate
keeps its smallest value.  A set whose coordinates are all filled stops; after
as many rounds as there are coordinates, round ``i`` serves coordinate ``i``
alone, so all of them fill for a set of any size.  Sketches are cut in bands; sets that
share a band are candidates and are compared on their full sets.

A group of near copies is joined to components by stars, whose pairs grow with
its nodes: first each node with one pivot, then with the pivots of its other
bands, then with pivots drawn anew, each time only where components still
differ.  What is left open in a band is compared in full if longer sketches
allow a link; nodes of bands that leave very much open are first banded again
by more and longer keys.

Defined cases: null text, empty text and text without words give an empty set
linked with nothing; fewer words than a shingle has give one shingle; rows
with equal sets are one class (no pairs among them); rows of one doc_id with
different texts are nodes of their own, and the component is named by the
smallest doc_id of all its rows; a null id takes no part
and stands alone with a null component; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docketflow.llm.graph import components
from docketflow.llm.shared import buffers, chunks, distinct_ids, mix, numbered, ranges, run_hashes, slices, table, word_hashes, words, written

#: A band misses a pair at the threshold with probability (1 - 0.8**5)**32 = 3e-6, a finer one (1 - 0.8**10)**128 = 5e-7.
BANDS, ROWS = 32, 5
FINE_BANDS, FINE_ROWS = 128, 10
COORDINATES = BANDS * ROWS
#: Coordinates of the sketch that rules pairs out, and how many may differ in its two bits: 154 do at the
#: threshold, with a deviation of 11.4, so 205 is passed 3 times in a million.
MARKED, MOST_DIFFERENT = 1024, 205
#: Rounds of stars in all bands, and the partners in other components (the mean of a band) that are compared without longer keys.
STARS, WIDE = 2, 1000
_EMPTY = np.uint64(0xFFFFFFFFFFFFFFFF)


def shingle_sets(texts: pa.Array, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct k-word shingle hashes of every row, sorted, in one array; and row offsets."""
    data, offsets = buffers(texts)
    starts, ends, first = words(data, offsets)
    hashes = word_hashes(data, starts, ends, lower=True)
    n = np.diff(first)
    counts = np.maximum(n - k + 1, 0)
    parts = [run_hashes(hashes, k)[ranges(first[:-1], counts)] if len(hashes) >= k else hashes[:0]]
    rows = [np.repeat(np.arange(len(n)), counts)]
    for size in range(1, k):  # texts of fewer words than a shingle: all of them
        short = np.flatnonzero(n == size)
        if len(short):
            parts.append(run_hashes(hashes, size, seed=size)[first[short]])
            rows.append(short)
    shingles, row = np.concatenate(parts), np.concatenate(rows)
    order = np.lexsort((shingles, row))
    shingles, row = shingles[order], row[order]
    fresh = np.ones(len(row), bool)
    fresh[1:] = (shingles[1:] != shingles[:-1]) | (row[1:] != row[:-1])
    shingles, row = shingles[fresh], row[fresh]
    return shingles, np.searchsorted(row, np.arange(len(n) + 1))


def sketches(shingles: np.ndarray, offsets: np.ndarray, t: int = COORDINATES) -> np.ndarray:
    """A row of ``t`` values for each non-empty set (empty sets keep the empty mark)."""
    rows = len(offsets) - 1
    low = np.uint64(64 - (2 * t).bit_length())  # the round stands in the upper bits
    out = np.full(rows * t, _EMPTY, np.uint64)
    owner = np.repeat(np.arange(rows), np.diff(offsets))
    for i in range(2 * t):
        if not len(owner):
            break
        h = mix(shingles + np.uint64((i * 0x9E3779B97F4A7C15 + 12345) & (2**64 - 1)))
        place = ((h >> np.uint64(32)) * np.uint64(t)) >> np.uint64(32) if i < t else np.uint64(i - t)
        value = (np.uint64(i) << low) | (mix(h) >> (np.uint64(64) - low))
        np.minimum.at(out, owner * t + np.asarray(place, np.int64), value)
        live = np.flatnonzero((out.reshape(rows, t) == _EMPTY).any(axis=1))
        keep = np.isin(owner, live, assume_unique=False, kind="table")
        shingles, owner = shingles[keep], owner[keep]
    return out.reshape(rows, t)


def band_keys(sketch: np.ndarray, bands: int = BANDS) -> np.ndarray:
    """One key for each band, different for each band's place."""
    parts = mix(sketch.reshape(len(sketch), bands, sketch.shape[1] // bands) + np.arange(bands, dtype=np.uint64)[None, :, None])
    key = np.zeros(parts.shape[:2], np.uint64)
    for r in range(parts.shape[2]):
        key = mix(key * np.uint64(0x9E3779B97F4A7C15) + parts[:, :, r])
    return key


def marks(sketch: np.ndarray) -> np.ndarray:
    """Two bits of each coordinate, 32 in a word."""
    two = (mix(sketch) & np.uint64(3)).reshape(len(sketch), sketch.shape[1] // 32, 32)
    return np.bitwise_or.reduce(two << np.arange(0, 64, 2, dtype=np.uint64), axis=2)


def _lists(values: np.ndarray, counts: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(counts))), pa.int32()), pa.array(values))


def _described(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch):
                shingles, offsets = shingle_sets(part.column("text"), k)
                n = np.diff(offsets)
                total = np.zeros((2, len(shingles) + 1), np.uint64)
                np.cumsum(mix(shingles), out=total[0, 1:])
                np.cumsum(mix(shingles ^ np.uint64(0x5851F42D4C957F2D)), out=total[1, 1:])
                h = total[:, offsets[1:]] - total[:, offsets[:-1]]
                sketch = sketches(shingles, offsets)
                keys = band_keys(sketch[n > 0]).view(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("doc"), part.column("doc_id"), pa.array(n, pa.int64()), pa.array(h[0].view(np.int64)), pa.array(h[1].view(np.int64)),
                        _lists(keys.ravel(), np.where(n > 0, BANDS, 0)),
                    ],
                    ["doc", "doc_id", "n_shingles", "h1", "h2", "bands"],
                )

    return run


def _sets(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch):
                shingles, offsets = shingle_sets(part.column("text"), k)
                yield pa.RecordBatch.from_arrays([part.column("node"), _lists(shingles.view(np.int64), np.diff(offsets))], ["node", "shingles"])

    return run


def _sketched(column: str, coordinates: int, of):
    """``of`` the sketches of sets (node, shingles), in lists ``column``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "shingles", 1 << 16):
                lists = part.column("shingles")
                offsets = np.asarray(lists.offsets).astype(np.int64)
                found = of(sketches(np.asarray(lists.flatten()).view(np.uint64), offsets - offsets[0], coordinates)).view(np.int64)
                yield pa.RecordBatch.from_arrays([part.column("node"), _lists(found.ravel(), np.full(len(found), found.shape[1]))], ["node", column])

    return run


_marked = _sketched("mark", MARKED, marks)
_fine = _sketched("bands", FINE_BANDS * FINE_ROWS, lambda sketch: band_keys(sketch, FINE_BANDS))


def _confirmed(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "shingles_a"):
                flat, n = [], []
                for side in ("shingles_a", "shingles_b"):
                    flat.append(np.asarray(part.column(side).flatten()))
                    n.append(np.diff(np.asarray(part.column(side).offsets)).astype(np.int64))
                row = np.concatenate([np.repeat(np.arange(len(m)), m) for m in n])
                both = np.concatenate(flat)
                order = np.lexsort((both, row))
                both, row = both[order], row[order]
                same = (both[1:] == both[:-1]) & (row[1:] == row[:-1])
                shared = np.bincount(row[1:][same], minlength=part.num_rows)
                linked = 100 * shared >= percent * (n[0] + n[1] - shared)
                yield pa.RecordBatch.from_arrays([part.column("x"), part.column("y"), pa.array(linked)], ["x", "y", "linked"])

    return run


def _fit(a, b, percent: int) -> Column:
    """Sizes that allow a link."""
    return 100 * F.least(a, b) >= percent * F.greatest(a, b)


def _differing(a: Column, b: Column) -> Column:
    """In how many coordinates two marks differ."""
    total = F.lit(0)
    for i in range(MARKED // 32):
        x = a[i].bitwiseXOR(b[i])
        total += F.bit_count(x.bitwiseOR(F.shiftrightunsigned(x, 1)).bitwiseAND(F.lit(0x5555555555555555)))
    return total


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(x, y) of those of ``pairs(a, b, x, y)`` whose sets of nodes a and b reach the threshold; written.

    ``a`` is the pivot, which many pairs may share: it is joined last, when rows
    have their size, so that AQE splits it as a skewed key.
    """
    a, b = (sets.select(F.col("node").alias(c), F.col("shingles").alias(f"shingles_{c}")) for c in "ab")
    joined = pairs.join(b.hint("merge"), "b").join(a.hint("merge"), "a").select("x", "y", "shingles_a", "shingles_b")
    return written(joined.mapInArrow(_confirmed(percent), "x long, y long, linked boolean").where("linked").select("x", "y"), "links")


def _roots(parents: DataFrame) -> DataFrame:
    """(node, component) of a forest ``parents(node, parent)`` in which roots are their own parents."""
    while True:
        up = parents.select(F.col("node").alias("parent"), F.col("parent").alias("above"))
        higher = written(parents.join(up.hint("merge"), "parent").select("node", F.col("above").alias("parent"), (F.col("above") != F.col("parent")).alias("moved")), "parents")
        if higher.where("moved").isEmpty():
            return higher.select("node", F.col("parent").alias("component"))
        parents = higher.select("node", "parent")


def _merged(found: DataFrame, links: DataFrame) -> DataFrame:
    """``found(node, component)`` with the components that ``links(x, y)`` join made one."""
    if links.isEmpty():
        return found
    label = components(links.select(F.col("x").alias("a"), F.col("y").alias("b"))).select(F.col("node").alias("component"), F.col("component").alias("label"))
    return written(found.join(label.hint("merge"), "component", "left").select("node", F.coalesce("label", "component").alias("component")), "found")


def _star(rows: DataFrame, found: DataFrame, sets: DataFrame, percent: int, turn: int) -> tuple[DataFrame, DataFrame]:
    """One pivot for each band of ``rows(band, node, n)`` against its nodes in other components: the open bands' rows, and ``found`` anew."""
    part = written(rows.select("band", "node", "n").join(found.hint("merge"), "node"), "parts")
    by = F.xxhash64(F.lit(turn), "node") if turn else F.col("node")
    heads = part.groupBy("band").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.min_by(F.struct("node", "n", "component"), by).alias("head")).where("lo <> hi")
    part = written(part.join(heads.select("band", "head").hint("merge"), "band"), "open")
    pairs = part.where((F.col("component") != F.col("head.component")) & _fit("n", "head.n", percent))
    pairs = pairs.select(F.col("head.node").alias("a"), F.col("node").alias("b"), F.col("head.component").alias("x"), F.col("component").alias("y")).distinct()
    return part, _merged(found, _verified(pairs, sets, percent))


def _rest(rows: DataFrame, found: DataFrame, keys: DataFrame, sets: DataFrame, percent: int, wide: int | None) -> tuple[DataFrame, DataFrame | None]:
    """Compares the nodes of a band of ``rows`` that are in different components: ``found`` anew.

    ``keys(node, n, bands)``.  Bands in which a node has more than ``wide`` such
    partners on average are left: their nodes are the second result.
    """
    part = written(rows.select("band", "node").join(found.hint("merge"), "node"), "parts")
    sizes = part.groupBy("band", "component").count().groupBy("band").agg(F.sum("count").alias("c"), F.sum(F.col("count") * F.col("count")).alias("same"))
    open_ = sizes.where("c * c > same").select("band", (F.col("c") * F.col("c") - F.col("same") > F.col("c") * F.lit(wide or 0)).alias("wide"))
    part = written(part.join(open_.hint("merge"), "band"), "open")
    left = None
    if wide is not None:
        left = part.where("wide").select("node").distinct()
        part = part.where("NOT wide")
    asked = sets.join(part.select("node").distinct().hint("merge"), "node")
    long = written(asked.mapInArrow(_marked, "node long, mark array<long>"), "marks")
    full = part.join(keys.join(long.hint("merge"), "node").hint("merge"), "node")
    x, y = (full.select("band", *[F.col(c).alias(f"{c}_{side}") for c in ("node", "component", "n", "mark", "bands")]) for side in "ab")
    fits = (
        (F.col("component_a") < F.col("component_b"))
        & _fit("n_a", "n_b", percent)
        & (_differing(F.col("mark_a"), F.col("mark_b")) <= MOST_DIFFERENT)
        & (F.array_min(F.array_intersect("bands_a", "bands_b")) == F.col("band"))  # once, not in every shared band
    )
    pairs = x.join(y.hint("merge"), "band").where(fits).select(F.col("node_a").alias("a"), F.col("node_b").alias("b"), F.col("component_a").alias("x"), F.col("component_b").alias("y"))
    return _merged(found, _verified(pairs, sets, percent)), left


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row of ``docs(doc_id, text)``.

    Rows are linked when their sets of ``k``-word shingles share ``percent`` % of
    their union.  Equal sets are first made one node; see above for the rest.
    """
    docs = docs.select("doc_id", "text")
    unique = distinct_ids(docs)
    placed = row_components(numbered(docs, unique), k, percent)
    if unique:  # rows are their ids
        return placed.select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))
    placed = written(placed, "placed")
    name = placed.groupBy("component").agg(F.min("doc_id").alias("name"))
    return placed.join(name.hint("merge"), "component", "left").select("doc_id", "n_shingles", F.coalesce("name", "doc_id").alias("component_id"))


def row_components(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """(doc, doc_id, n_shingles, component) of every row of ``docs(doc, doc_id, text)``.

    ``doc`` tells rows apart; the component is the smallest of them, null for
    rows that take no part.
    """
    docs = docs.select("doc", "doc_id", "text")
    described = written(
        docs.select("doc", F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
            _described(k), "doc long, doc_id long, n_shingles long, h1 long, h2 long, bands array<long>"
        ),
        "described",
    )
    key = ["h1", "h2", "n_shingles"]
    full = described.where("doc_id IS NOT NULL AND n_shingles > 0")
    classes = written(full.groupBy(*key).agg(F.min(F.struct("doc", "bands")).alias("head")).select(*key, F.col("head.doc").alias("node"), "head.bands"), "classes")
    keys = classes.select("node", F.col("n_shingles").alias("n"), "bands")

    banded = keys.select("node", "n", F.explode(F.array_distinct("bands")).alias("band"))
    several = banded.groupBy("band").agg(F.count("*").alias("c"), F.min("node").alias("head")).where("c > 1").select("band", "head")
    shared = written(banded.join(several.hint("merge"), "band"), "shared")
    first = written(shared.groupBy("node").agg(F.min("head").alias("head")), "first")  # the smallest node of all bands
    texts = docs.select(F.col("doc").alias("node"), "text").join(first.hint("merge"), "node", "left_semi")
    sets = written(texts.mapInArrow(_sets(k), "node long, shingles array<long>"), "sets")

    pairs = first.where("head <> node").select(F.col("head").alias("a"), F.col("node").alias("b"), F.col("head").alias("x"), F.col("node").alias("y"))
    links = _verified(pairs, sets, percent).select(F.col("y").alias("node"), F.col("x").alias("parent"))
    found = _roots(first.join(links.hint("merge"), "node", "left").select("node", F.coalesce("parent", "node").alias("parent")))
    rows = shared
    for turn in range(STARS):
        rows, found = _star(rows, found, sets, percent, turn)
    found, wide = _rest(rows, found, keys, sets, percent, WIDE)
    wide = written(wide, "wide")
    if not wide.isEmpty():
        fine = written(sets.join(wide.hint("merge"), "node").mapInArrow(_fine, "node long, bands array<long>"), "fine")
        fine = fine.join(keys.drop("bands").hint("merge"), "node").select("node", "n", "bands")
        rows, found = _star(fine.select("node", "n", F.explode("bands").alias("band")), found, sets, percent, 1)
        found, _ = _rest(rows, found, fine, sets, percent, None)

    placed = described.select("doc", "doc_id", *key).join(classes.select(*key, "node").hint("merge"), key, "left")
    return placed.join(found.hint("merge"), "node", "left").select("doc", "doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull() & (F.col("n_shingles") > 0), F.coalesce("component", "node")).alias("component"))


def op7_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate components of ``documents``: 4-word shingles, Jaccard of 0.8 or more."""
    found = near_duplicates(table(spark, sf_dir, "documents", "doc_id", "text"), k=4)
    return found.select("doc_id", "n_shingles", "component_id", (F.col("doc_id") == F.col("component_id")).alias("kept"))


QUERIES = {"op7_minhash": op7_minhash}
ORACLE = {}
