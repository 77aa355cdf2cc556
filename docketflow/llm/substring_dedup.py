"""Substring dedup by seed and extend over winnowed anchors.

Every window of ``length`` words has one anchor: the smallest hash among its
runs of ``SEED`` words, so equal windows have equal anchors at equal places.
Anchors that occur once cannot lie in a repeated window.  For those that
repeat, each occurrence carries the hashes of the windows it is the anchor of,
which extend the seed to both sides, and is compared with one occurrence (the
first) of the same anchor, not with all.  Windows that differ from it are then
counted among themselves: windows of equal text either all match the first
occurrence or none does, so nothing is lost.  Overlapping repeated windows
make the maximal repeats, whose words go.

Defined cases: null or empty text has no words; fewer words than a window
removes none; exact copies remove each other; a repeat inside one document
counts; rows are told apart by doc_id (a repeated doc_id or a null one has a
number of its own from a hash of its row); extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docketflow.llm.shared import buffers, chunks, numbered, ranges, run_hashes, table, word_hashes, words, written

#: Words of a seed.  A window of 35 words has 20 of them.
SEED = 16


def sliding_argmin(values: np.ndarray, span: int) -> np.ndarray:
    """For each start, the place of the smallest of ``span`` values (the last among equals)."""
    n = len(values) - span + 1
    best = np.arange(n)
    for d in range(1, span):
        other = np.arange(d, n + d)
        best = np.where(values[other] <= values[best], other, best)
    return best


def windows(texts: pa.Array, length: int):
    """Of all rows: word spans, first words; and per window its start word and its anchor's word; seed hashes; window hashes."""
    data, offsets = buffers(texts)
    starts, ends, first = words(data, offsets)
    hashes = word_hashes(data, starts, ends)
    counts = np.maximum(np.diff(first) - length + 1, 0)
    begin = ranges(first[:-1], counts)
    none = np.zeros(0, np.int64)
    if not len(begin):
        return data, offsets, starts, ends, first, counts, none, none, none.astype(np.uint64), none.astype(np.uint64)
    seeds = run_hashes(hashes, SEED)
    anchor = sliding_argmin(seeds, length - SEED + 1)[begin]
    return data, offsets, starts, ends, first, counts, begin, anchor, seeds, run_hashes(hashes, length, seed=1)


def _anchors(length: int):
    """(doc_id, pos, anchor) of each distinct anchor of a document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch):
                _, _, _, _, first, counts, _, anchor, seeds, _ = windows(part.column("text"), length)
                row = np.repeat(np.arange(len(counts)), counts)
                keep = np.ones(len(anchor), bool)
                keep[1:] = (anchor[1:] != anchor[:-1]) | (row[1:] != row[:-1])
                anchor, row = anchor[keep], row[keep]
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc").take(pa.array(row)), pa.array((anchor - first[row]).astype(np.int32)), pa.array(seeds[anchor].view(np.int64) if len(anchor) else np.zeros(0, np.int64))],
                    ["doc", "pos", "anchor"],
                )

    return run


def _extended(length: int):
    """For the repeated anchors of a document (``at``): the hashes of the windows they are anchors of, by distance."""
    spread = length - SEED + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch):
                _, _, _, _, first, counts, begin, anchor, seeds, hashes = windows(part.column("text"), length)
                row = np.repeat(np.arange(len(counts)), counts)
                lists = part.column("at")
                wanted = np.zeros(int(first[-1]) + 1, bool)
                wanted[np.asarray(lists.flatten()) + first[np.repeat(np.arange(len(counts)), np.diff(np.asarray(lists.offsets)))]] = True
                keep = wanted[anchor]
                begin, anchor, row = begin[keep], anchor[keep], row[keep]
                fresh = np.ones(len(anchor), bool)
                fresh[1:] = (anchor[1:] != anchor[:-1]) | (row[1:] != row[:-1])
                head = np.flatnonzero(fresh)
                size = np.diff(np.append(head, len(anchor)))
                value = hashes[begin].view(np.int64) if len(begin) else np.zeros(0, np.int64)
                at = np.append(head, len(anchor)).astype(np.int32)
                farthest = (anchor[head] - begin[head]).astype(np.int32) if len(head) else np.zeros(0, np.int32)
                assert not len(size) or size.max() <= spread
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc").take(pa.array(row[head])), pa.array((anchor[head] - first[row[head]]).astype(np.int32)), pa.array(seeds[anchor[head]].view(np.int64) if len(head) else np.zeros(0, np.int64)), pa.array(farthest), pa.ListArray.from_arrays(pa.array(at), pa.array(value))],
                    ["doc", "pos", "anchor", "far", "windows"],
                )

    return run


def _compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Occurrence against the first one: bit d of ``mask`` is set if the windows d words before the anchor are equal."""
    for batch in batches:
        flat, owner, distance = [], [], []
        for side in ("", "first_"):
            lists = batch.column(side + "windows")
            n = np.diff(np.asarray(lists.offsets)).astype(np.int64)
            flat.append(np.asarray(lists.flatten()))
            owner.append(np.repeat(np.arange(len(n)), n))
            distance.append(np.repeat(np.asarray(batch.column(side + "far")), n) - (np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)))
        grid = np.zeros((batch.num_rows, 64), np.int64)
        there = np.zeros((batch.num_rows, 64), bool)
        grid[owner[1], distance[1]], there[owner[1], distance[1]] = flat[1], True
        equal = there[owner[0], distance[0]] & (grid[owner[0], distance[0]] == flat[0])
        mask = np.zeros(batch.num_rows, np.int64)
        np.bitwise_or.at(mask, owner[0][equal], np.int64(1) << distance[0][equal].astype(np.int64))
        other = ~equal
        n = np.bincount(owner[0][other], minlength=batch.num_rows)
        at = pa.array(np.concatenate(([0], np.cumsum(n))).astype(np.int32))
        rest = pa.StructArray.from_arrays([pa.array(distance[0][other].astype(np.int32)), pa.array(flat[0][other])], ["d", "w"])
        yield pa.RecordBatch.from_arrays([batch.column(c) for c in ("doc", "pos", "anchor")] + [pa.array(mask), pa.ListArray.from_arrays(at, rest)], ["doc", "pos", "anchor", "mask", "rest"])


def _whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Words of each text and the hash of all of them."""
    for batch in batches:
        for part in chunks(batch):
            data, offsets = buffers(part.column("text"))
            n = np.diff(words(data, offsets)[2])
            raw = data.tobytes()
            digest = [sha256(b" ".join(raw[i:j].split())).hexdigest() for i, j in zip(offsets[:-1], offsets[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([part.column("doc"), part.column("doc_id"), pa.array(n, pa.int64()), pa.array(digest, pa.string())], ["doc", "doc_id", "n_words", "all_sha256"])


def _cut(length: int):
    """What is left of a text without the words that repeated windows (``hit``: anchor places and masks) cover."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch):
                data, offsets = buffers(part.column("text"))
                starts, ends, first = words(data, offsets)
                lists = part.column("hit")
                row = np.repeat(np.arange(part.num_rows), np.diff(np.asarray(lists.offsets)))
                hit = lists.flatten()
                anchor, mask = first[row] + np.asarray(hit.field("pos")), np.asarray(hit.field("mask"))
                edge = np.zeros(len(starts) + 1, np.int64)
                for d in range(length - SEED + 1):
                    begin = anchor[(mask >> d) & 1 == 1] - d
                    np.add.at(edge, begin, 1)
                    np.add.at(edge, begin + length, -1)
                gone = np.cumsum(edge[:-1]) > 0
                raw, kept, removed = data.tobytes(), [], []
                for i, j in zip(first[:-1], first[1:], strict=True):
                    left = np.flatnonzero(~gone[i:j]) + i
                    kept.append(b" ".join([raw[b:e] for b, e in zip(starts[left], ends[left], strict=True)]))
                    removed.append(int(j - i - len(left)))
                digest = [sha256(x).hexdigest() for x in kept]
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc"), pa.array(removed, pa.int64()), pa.array(digest, pa.string()), pa.array(kept, pa.binary()).cast(pa.string())],
                    ["doc", "n_removed", "kept_sha256", "kept_text"],
                )

    return run


def repeated_windows(docs: DataFrame, length: int) -> tuple[DataFrame, DataFrame]:
    """Of ``docs(doc, text)``: texts with repeated anchors (doc, text), and hits (doc, pos, mask):
    bit d of ``mask`` says that the window starting d words before word ``pos`` also starts elsewhere."""
    anchors = docs.select("doc", "text").mapInArrow(_anchors(length), "doc long, pos int, anchor long")
    repeated = written(anchors.groupBy("anchor").count().where("count > 1").select("anchor"), "anchors")
    places = anchors.join(repeated.hint("merge"), "anchor").groupBy("doc").agg(F.collect_list("pos").alias("at"))
    seeded = written(docs.select("doc", "text").join(places.hint("merge"), "doc"), "seeded")

    seen = seeded.mapInArrow(_extended(length), "doc long, pos int, anchor long, far int, windows array<long>")
    first = written(
        seen.groupBy("anchor").agg(F.min(F.struct("doc", "pos", "far", "windows")).alias("f"))
        .select("anchor", F.col("f.doc").alias("first_doc"), F.col("f.pos").alias("first_pos"), F.col("f.far").alias("first_far"), F.col("f.windows").alias("first_windows")),
        "first",
    )
    pairs = seen.join(first.hint("merge"), "anchor").where("doc <> first_doc OR pos <> first_pos")
    compared = written(
        pairs.select("doc", "pos", "anchor", "far", "windows", "first_far", "first_windows").mapInArrow(
            _compared, "doc long, pos int, anchor long, mask long, rest array<struct<d:int,w:long>>"
        ),
        "compared",
    )
    own = compared.groupBy("anchor").agg(F.bit_or("mask").alias("mask")).join(first.select("anchor", "first_doc", "first_pos").hint("merge"), "anchor")
    rest = compared.select("doc", "pos", "anchor", F.inline("rest"))
    again = written(rest.groupBy("anchor", "d", "w").count().where("count > 1").select("anchor", "d", "w"), "again")
    others = rest.join(again.hint("merge"), ["anchor", "d", "w"]).select("doc", "pos", F.expr("shiftleft(1L, d)").alias("mask"))
    hits = compared.select("doc", "pos", "mask").union(own.select("first_doc", "first_pos", "mask")).where("mask <> 0").union(others)
    return seeded.select("doc", "text"), hits


def remove_repeats(docs: DataFrame, length: int = 50) -> DataFrame:
    """``docs`` (doc, text) cut: (doc, n_removed, kept_sha256, kept_text) of the rows that lose words."""
    seeded, hits = repeated_windows(docs, length)
    by_doc = hits.groupBy("doc").agg(F.collect_list(F.struct("pos", "mask")).alias("hit"))
    return seeded.join(by_doc.hint("merge"), "doc").mapInArrow(_cut(length), "doc long, n_removed long, kept_sha256 string, kept_text string")


def op6_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of ``documents`` that no repeated window of 35 words covers."""
    docs = numbered(table(spark, sf_dir, "documents", "doc_id", "text"))
    whole = docs.select("doc", "doc_id", "text").mapInArrow(_whole, "doc long, doc_id long, n_words long, all_sha256 string")
    cut = remove_repeats(docs, 35).select("doc", "n_removed", "kept_sha256")
    return whole.join(cut.hint("merge"), "doc", "left").select(
        "doc_id", "n_words", F.coalesce("n_removed", F.lit(0)).alias("n_removed"), F.coalesce("kept_sha256", "all_sha256").alias("kept_sha256")
    )


QUERIES = {"op6_substring": op6_substring}
ORACLE = {}
