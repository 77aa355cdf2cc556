"""Substring search over a haystack by an index of trigrams: candidates first, then the exact test."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Characters of a sorted run of the index, but for a longer text.
RUN_CHARACTERS = 4_000_000


def plain_text(summary: Column) -> Column:
    """A summary without link syntax: the words that are read."""
    return F.regexp_replace(F.trim(F.coalesce(summary, F.lit(""))), r"\[([^\]]+)\]\(https?://[^\s)]+\)", "$1")


def haystack(*parts: Column) -> Column:
    """The lower-case text a search looks in: the parts that are not empty, arrays one item after the other."""
    return F.lower(F.array_join(F.filter(F.flatten(F.array(*parts)), lambda p: F.coalesce(p, F.lit("")) != ""), " "))


def _sorted_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, gram) of batches (key, text): runs of some texts, each sorted by gram."""
    for batch in batches:
        keys, texts = batch.column(0), batch.column(1).to_pylist()
        ends = np.cumsum([len(t) for t in texts]) // RUN_CHARACTERS
        for run in np.split(np.arange(len(texts)), np.flatnonzero(np.diff(ends)) + 1):
            found = []
            for i in run:
                c = np.frombuffer(texts[i].encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
                found.append(np.unique(c[:-2] << np.uint64(42) | c[1:-1] << np.uint64(21) | c[2:]))
            if not found:
                continue
            of, codes = np.repeat(run, [len(f) for f in found]), np.concatenate(found)
            order = np.argsort(codes, kind="stable")
            codes = codes[order]
            new = np.append(True, codes[1:] != codes[:-1])
            names = ["".join(chr(c >> shift & 0x1FFFFF) for shift in (42, 21, 0)) for c in codes[new].tolist()]
            yield pa.RecordBatch.from_arrays([keys.take(pa.array(of[order])), pa.array(names, pa.string()).take(pa.array(np.cumsum(new) - 1))], [batch.schema.names[0], "gram"])


def write_index(rows: DataFrame, key: str, text: str, folder: str) -> None:
    """(key, gram) of every distinct trigram of each row's text.

    Every task writes its own rows, in sorted runs, so nothing is shuffled, no trigram is too
    frequent, and a file's statistics tell which of its pages have a trigram.
    """
    pairs = rows.where(F.length(text) >= 3).select(F.col(key), F.col(text).alias("text"))
    grams = pairs.mapInArrow(_sorted_grams, pairs.select(key).withColumn("gram", F.lit("")).schema)
    grams.write.mode("overwrite").parquet(folder)


def found(rows: DataFrame, index: DataFrame, key: str, text: str, terms: list[str]) -> DataFrame:
    """Rows whose text has all ``terms``, as a scan finds them; only rows that have all their trigrams are read in full.

    ``index``: the table ``write_index`` wrote.  Terms of under three letters have
    no trigram and are left to the exact test; with none but such, all rows are scanned.
    """
    terms = [t.lower() for t in terms if t]
    grams = sorted({t[i : i + 3] for t in terms for i in range(len(t) - 2)})
    exact = rows.where(F.forall(F.array(*[F.lit(t) for t in terms]), lambda t: F.contains(F.col(text), t))) if terms else rows
    if not grams:
        return exact
    hits = index.where(F.col("gram").isin(grams)).groupBy(key).agg(F.count("*").alias("n")).where(F.col("n") >= len(grams))
    return exact.join(hits.select(key).hint("merge"), key, "left_semi")
