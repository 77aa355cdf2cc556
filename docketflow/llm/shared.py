"""What the operators share: written tables and Arrow text as numpy arrays."""

from __future__ import annotations

import ctypes
import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import suppress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that a Python worker turns into arrays at a time.
CHUNK = 2 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors see; a new temporary one only where none is set and Spark runs in one process (tests)."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("docketflow.scratch", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("docketflow.scratch", base)
    return base.rstrip("/")


def new_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


def written(df: DataFrame, label: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder: cuts lineage and survives lost executors."""
    path = new_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def removed(table: DataFrame) -> None:
    """Removes a table that ``written`` wrote and that nothing reads any more."""
    spark = table.sparkSession
    for folder in {f.rsplit("/", 1)[0] for f in table.inputFiles()}:
        if not re.search("-[0-9a-f]{32}$", folder):
            raise ValueError(f"{folder} is no written table")
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def bucket_of(column: str, modulus: int):
    """crc32 of the id as text, modulo: the fold of a row (null id: null)."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % modulus


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and row offsets of a string array; null rows have length 0."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.cast(pa.large_string()).fill_null("")
    if not len(texts):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, off, data = texts.buffers()
    off = np.frombuffer(off, np.int64, len(texts) + 1, texts.offset * 8)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[off[0] : off[-1]], off - off[0]


def chunks(batch: pa.RecordBatch, column: str = "text", size: int = CHUNK) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with about ``size`` bytes of text (a longer text stands alone)."""
    if not batch.num_rows:
        return
    lengths = np.diff(buffers(batch.column(column))[1])
    at = 0
    group = (np.cumsum(lengths) - lengths) // size
    for cut in [*(np.flatnonzero(np.diff(group)) + 1), batch.num_rows]:
        yield batch.slice(at, cut - at)
        at = int(cut)


def slices(batch: pa.RecordBatch, column: str, size: int = CHUNK // 4) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with about ``size`` entries in its lists ``column`` (a longer list stands alone)."""
    if not batch.num_rows:
        return
    group = (np.asarray(batch.column(column).offsets)[:-1].astype(np.int64) - batch.column(column).offsets[0].as_py()) // size
    at = 0
    for cut in [*(np.flatnonzero(np.diff(group)) + 1), batch.num_rows]:
        yield batch.slice(at, cut - at)
        at = int(cut)


def trim() -> None:
    """Gives what a task has freed back to the system: the worker lives on beside JVM stages that need it."""
    pa.default_memory_pool().release_unused()
    with suppress(AttributeError, OSError):  # no such call outside glibc
        ctypes.CDLL(None).malloc_trim(0)


def distinct_ids(docs: DataFrame) -> bool:
    """Whether doc_id tells rows apart."""
    return docs.groupBy(F.col("doc_id").cast("long").alias("doc_id")).count().where("count > 1 OR doc_id IS NULL").isEmpty()


def numbered(docs: DataFrame, unique: bool | None = None) -> DataFrame:
    """``docs`` with a column ``doc`` that tells rows apart: doc_id where that does (``unique``, if known), else a written number."""
    if distinct_ids(docs) if unique is None else unique:
        return docs.withColumn("doc", F.col("doc_id").cast("long"))
    return written(docs.withColumn("doc", F.monotonically_increasing_id()), "numbered")


_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_BYTE = np.random.default_rng(7).integers(1, 1 << 63, 256, dtype=np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1)
_POWERS: dict[int, np.ndarray] = {}


def powers(base: np.uint64, n: int) -> np.ndarray:
    """base ** (0 .. n-1) modulo 2**64."""
    have = _POWERS.get(int(base))
    if have is None or len(have) < n:
        have = np.full(max(n, 1 << 16), base, np.uint64)
        have[0] = 1
        np.multiply.accumulate(have, out=have)
        if n <= 4 * CHUNK:
            _POWERS[int(base)] = have
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit (the splitmix64 finisher)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def words(data: np.ndarray, offsets: np.ndarray, space: np.ndarray = _SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all runs of bytes not in ``space`` (``[^\\x20\\x09-\\x0D]+``) and, per row, the first word's index (one more at the end)."""
    inside = np.zeros(len(data) + 1, bool)
    inside[:-1] = ~space[data]
    fresh = np.zeros(len(data) + 1, bool)
    fresh[offsets] = True
    before = np.zeros(len(data) + 1, bool)
    before[1:] = inside[:-1]
    starts = np.flatnonzero(inside & (~before | fresh))
    ends = np.flatnonzero(before & (~inside | fresh))
    return starts, ends, np.searchsorted(starts, offsets)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = False) -> np.ndarray:
    """A 64-bit hash of each word's bytes; ``lower`` folds A-Z."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((_BYTE[_LOWER] if lower else _BYTE)[data] * powers(_BASE, len(data)), out=total[1:])
    return mix((total[ends] - total[starts]) * powers(_INVERSE, len(data))[starts] + (ends - starts).astype(np.uint64))


def run_hashes(hashes: np.ndarray, k: int, seed: int = 0) -> np.ndarray:
    """A 64-bit hash of every ``k`` neighbouring entries (row borders are the caller's business)."""
    n = len(hashes)
    if n < k:
        return np.zeros(0, np.uint64)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(mix(hashes + np.uint64(seed)) * powers(_BASE, n), out=total[1:])
    return mix((total[k:] - total[: n - k + 1]) * powers(_INVERSE, n)[: n - k + 1])


def ranges(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """start, start+1, ... (count of them), for each start, in one array."""
    total = int(counts.sum())
    if not total:
        return np.zeros(0, np.int64)
    first = np.cumsum(counts) - counts
    return np.arange(total) + np.repeat(starts - first, counts)


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet").select(*columns)
