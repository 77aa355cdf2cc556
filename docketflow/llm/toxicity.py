"""Toxicity by a linear classifier over character n-grams scaled by naive Bayes log-count ratios.

Features are the distinct hashed n-grams of the UTF-8 bytes of a text (A-Z
folded).  Each is scaled by the log ratio of its smoothed share of toxic and
of other training texts; a logistic regression over the scaled features gives
the weights.  Fitting takes at most ``PER_CLASS`` labelled rows of each label
(those with the smallest hashes of their ids, and of these of their texts); scoring reads all whole texts.

Defined cases: null and empty texts have no features and get the score of the
intercept; rows whose label or text is null do not train; without training
rows of both labels every score is 0; repeated rows score alike; ids that
several labels name are learned once for each label; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docketflow.llm.shared import bucket_of, buffers, chunks, table

#: Training rows of each label at most.
PER_CLASS = 2500
BUCKETS, LENGTHS = 1 << 18, (4, 5, 6)
_FOLD = np.arange(256, dtype=np.uint32)
_FOLD[65:91] += 32


def features(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-gram buckets of every row, in one array, and row offsets."""
    data, offsets = buffers(texts)
    code = _FOLD[data] + np.uint32(1)
    grams = []
    run = code.copy()
    for n in range(2, max(LENGTHS) + 1):
        run = run[:-1] * np.uint32(0x01000193) ^ code[n - 1 :] * np.uint32(0x9E3779B1) if len(run) > 1 else run[:0]
        if n in LENGTHS:
            h = run * np.uint32(0x85EBCA6B)
            grams.append(((h ^ (h >> np.uint32(15))) * np.uint32(0xC2B2AE35) >> np.uint32(14)).astype(np.int32))
    seen, out, ends = np.zeros(BUCKETS, np.int64), [], [0]
    for i, j in zip(offsets[:-1], offsets[1:], strict=True):
        own = np.concatenate([g[i : max(i, j - n + 1)] for n, g in zip(LENGTHS, grams, strict=True)])
        order = np.arange(len(own))
        seen[own] = order
        own = own[seen[own] == order]
        out.append(own)
        ends.append(ends[-1] + len(own))
    return np.concatenate(out) if out else np.zeros(0, np.int32), np.array(ends)


def sums(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    total = np.concatenate(([0.0], np.cumsum(values, dtype=np.float64)))
    return total[offsets[1:]] - total[offsets[:-1]]


def fit(parts: list[np.ndarray], ends: list[np.ndarray], label: np.ndarray, rounds: int = 60, penalty: float = 3e-3) -> tuple[np.ndarray, float]:
    """(weight of each bucket with its ratio multiplied in, intercept) of feature arrays, each with its row offsets.

    Arrays are cut to the strongest buckets one by one, so that only those stand in memory together.
    """
    first = np.cumsum([0, *(len(e) - 1 for e in ends)])
    p, q = np.zeros(BUCKETS), np.zeros(BUCKETS)
    for index, at, i, j in zip(parts, ends, first[:-1], first[1:], strict=True):
        toxic = np.repeat(label[i:j] > 0, np.diff(at))
        p += np.bincount(index[toxic], minlength=BUCKETS)
        q += np.bincount(index[~toxic], minlength=BUCKETS)
    ratio = np.log((p + 1.0) / (label.sum() + 2.0)) - np.log((q + 1.0) / ((1 - label).sum() + 2.0))
    ratio[p + q < 8] = 0.0
    strong = np.argsort(-np.abs(ratio) * np.sqrt(p + q), kind="stable")[: BUCKETS // 8]
    place = np.full(BUCKETS, -1, np.int32)
    place[strong] = np.arange(len(strong))
    columns, sizes = [], []
    for k, at in enumerate(ends):
        found = place[parts[k]]
        parts[k] = found[:0]
        keep = np.concatenate(([0], np.cumsum(found >= 0)))
        columns.append(found[found >= 0])
        sizes.append(np.diff(keep[at]))
    column, n = np.concatenate(columns), np.concatenate(sizes)
    row = np.repeat(np.arange(len(n), dtype=np.int32), n)
    value = ratio[strong].astype(np.float32)[column]
    ends = np.concatenate(([0], np.cumsum(n)))
    weight, intercept = np.zeros(len(strong)), 0.0
    m, v, mb, vb = np.zeros(len(strong)), np.zeros(len(strong)), 0.0, 0.0
    for step in range(1, rounds + 1):
        score = intercept + sums(weight[column] * value, ends)
        error = (1 / (1 + np.exp(-np.clip(score, -30, 30))) - label) / len(label)
        grad = np.bincount(column, error[row] * value, len(strong)) + penalty * weight
        gb = error.sum()
        m, v, mb, vb = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad**2, 0.9 * mb + 0.1 * gb, 0.99 * vb + 0.01 * gb**2
        scale = 0.02 * np.sqrt(1 - 0.99**step) / (1 - 0.9**step)
        weight -= scale * m / (np.sqrt(v) + 1e-8)
        intercept -= scale * mb / (np.sqrt(vb) + 1e-8)
    out = np.zeros(BUCKETS, np.float32)
    out[strong] = weight * ratio[strong]
    return out, float(intercept)


def _train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    parts, ends, label = [], [], []
    for batch in batches:
        for part in chunks(batch):
            i, at = features(part.column("text"))
            parts.append(i)
            ends.append(at)
            label.append(np.asarray(part.column("toxic")).astype(float))
    if parts and 0 < (y := np.concatenate(label)).sum() < len(y):
        weight, intercept = fit(parts, ends, y)
        yield pa.RecordBatch.from_arrays([pa.array([weight.tobytes()], pa.binary()), pa.array([intercept])], ["weight", "intercept"])


def train(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> tuple[np.ndarray, float] | None:
    """The classifier of ``docs(doc_id, text)`` and ``labels(doc_id, toxic)``; None without both labels.

    Its intercept is moved from the labels' odds in the rows it is fitted on to their odds in all labelled rows with a text.
    """
    labels = labels.where("doc_id IS NOT NULL AND toxic IN (0, 1)").select("doc_id", F.col("toxic").cast("int").alias("toxic")).distinct()
    chosen = [labels.where(F.col("toxic") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class) for y in (0, 1)]
    texts = docs.where("text IS NOT NULL")
    rows = texts.join(F.broadcast(chosen[0].union(chosen[1])), "doc_id")  # at most 2 * per_class ids
    # An id may stand for many rows: the bound is one on rows.
    place = F.row_number().over(Window.partitionBy("toxic").orderBy(F.xxhash64("doc_id", "text"), "doc_id"))
    rows = rows.select("doc_id", "text", "toxic").withColumn("i", place).where(F.col("i") <= per_class)
    found = rows.select("text", "toxic").repartition(1).mapInArrow(_train, "weight binary, intercept double").collect()
    if not found:
        return None
    of = {r["toxic"]: r["n"] for r in texts.select("doc_id").join(labels.hint("merge"), "doc_id").groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    shift = np.log(of[1] / min(of[1], per_class)) - np.log(of[0] / min(of[0], per_class))
    return np.frombuffer(found[0]["weight"], np.float32), found[0]["intercept"] + float(shift)


def scored(docs: DataFrame, model: tuple[np.ndarray, float] | None, keep: list[str] | None = None) -> DataFrame:
    """The columns ``keep`` (doc_id, if not given) of ``docs`` and a column ``score`` of their ``text``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # BUCKETS floats
    keep = keep or ["doc_id"]
    schema = docs.select(*keep).schema.add("score", "double")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch):
                if shared.value is None:
                    score = np.zeros(part.num_rows)
                else:
                    weight, intercept = shared.value
                    index, at = features(part.column("text"))
                    score = 1 / (1 + np.exp(-np.clip(intercept + sums(weight[index], at), -30, 30)))
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in keep), pa.array(score)], schema.names)

    return docs.select(*dict.fromkeys([*keep, "text"])).mapInArrow(run, schema)


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole text of ``documents`` scored; rows whose crc32(doc_id) mod 5 is 0 teach nothing."""
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    labels = table(spark, sf_dir, "labels", "doc_id", "toxic").where(bucket_of("doc_id", 5) != 0)
    found = scored(docs, train(docs, labels))
    return found.select("doc_id", F.coalesce(bucket_of("doc_id", 5) == 0, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


QUERIES = {"op4_toxicity": op4_toxicity}
ORACLE = {}
