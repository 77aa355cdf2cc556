"""Token ids in files: a range-coded stream in blocks, with document borders.

A file is a Parquet table in the folder Spark writes, one row for each block
of at most 4096 ids: ``part`` and ``block`` (its place in the stream),
``first`` (ids of the part before it), ``n_ids``, ``payload`` (see
``range_coder``; it decodes without any other block), ``crc`` (of the
payload), and the documents it holds as runs (``ordinal`` in the part,
``doc_id``, ``n``).  Parts follow each other in ascending doc_id order; a
document may run over blocks.  Task retries and lost executors are the
business of Spark's own output commit.

Defined cases: null or empty text is the end id alone; a null doc_id sorts
first; rows with equal doc_id stand side by side, in text order, as documents
of their own; no documents make no blocks; a damaged block raises an error.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docketflow.llm import range_coder
from docketflow.llm.range_coder import BLOCK, LANES
from docketflow.llm.shared import _BASE, _INVERSE, CHUNK, chunks, mix, new_path, powers, ranges, table, trim

#: Distinct pieces a worker remembers (and a sixteenth of their characters) before it starts anew, and bits of the slots it finds them by.
MEMORY, _SLOTS = 1_500_000, 21
_FILE = "part int, block long, first long, n_ids int, payload binary, crc long, runs array<struct<ordinal:long,doc_id:long,n:int>>"


#: Classes of characters: white space, letters, numbers, others.
_CLASSES = (r"\s+", r"\p{L}+", r"\p{N}+")
#: The splitter that ``Splitter`` does in arrays.
BYTE_LEVEL = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

_SUMMED = "part int, ordinal long, doc_id long, first long, n long, crc long"

#: Characters by which a byte-level vocabulary writes bytes; the line feed, which parts pieces here, stays.
_BYTES = {b: 256 + k for k, b in enumerate([*range(33), *range(127, 161), 173]) if b != 10}


class Splitter:
    """Where the matches of ``BYTE_LEVEL`` begin in texts that stand one behind the other."""

    def __init__(self):
        every = "".join(map(chr, range(0x110000)))
        self.kind = np.full(len(every), 3, np.uint8)
        for k, c in enumerate(_CLASSES):
            for m in regex.finditer(c, every):
                self.kind[m.start() : m.end()] = k

    def starts(self, chars: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Flags of the matches' first characters; ``first`` flags those of texts."""
        kind = self.kind.take(chars)
        start = first.copy()
        start[1:] |= kind[1:] != kind[:-1]
        # The last of some white space before another character stands alone, or goes with it if it is a space.
        last = (kind[:-1] == 0) & (kind[1:] != 0) & ~first[1:]
        start[:-1] |= last
        start[1:] &= ~(last & (chars[:-1] == 32))
        at = np.flatnonzero((chars == 39) & start)
        after = [np.append(chars, np.uint32(0)).take(np.minimum(at + k, len(chars))) * ~np.append(first, True).take(np.minimum(at + k, len(chars))) for k in (1, 2)]
        after[1] *= after[0] > 0
        one = np.isin(after[0], [ord(c) for c in "stmd"])
        two = np.isin(after[0] * 256 + after[1] * (after[1] < 256), [ord(x) * 256 + ord(y) for x, y in ("re", "ve", "ll")]) & (after[0] < 256)
        at, size = at[one | two], np.where(one, 2, 3)[one | two]
        start[at + 1] = False
        rest = at + size
        start[rest[rest < len(start)]] = True
        return start


class Grown:
    """A numpy array that grows at its end."""

    def __init__(self, dtype: type):
        self.all, self.size = np.zeros(1024, dtype), 0

    def append(self, values: np.ndarray) -> None:
        if self.size + len(values) > len(self.all):
            self.all = np.concatenate((self.all, np.zeros(self.size + len(values), self.all.dtype)))
        self.all[self.size : self.size + len(values)] = values
        self.size += len(values)


class LibraryEncoder:
    """The tokenizers library's ids of texts, asked once for each distinct piece its byte-level splitter makes.

    With ``added``, the strings of the vocabulary's added tokens are cut out of
    a text before the splitter sees it and become those tokens, as the library
    does by default; without it, they are ordinary text.  Known pieces are
    found by a hash of their characters and compared whole.
    """

    def __init__(self, path: str, pattern: str, added: bool = False):
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer, pre_tokenizers

        self.model = Tokenizer.from_file(path)
        self.find = regex.compile(pattern).finditer
        self.splitter = Splitter() if pattern == BYTE_LEVEL else None
        self.added: list[str] = []
        if added:
            tokens = list(self.model.get_added_tokens_decoder().values())
            if any(t.single_word or t.lstrip or t.rstrip or (t.normalized and self.model.normalizer) for t in tokens):
                raise ValueError("added tokens that take more than their own string are not supported")
            self.added = sorted((t.content for t in tokens if t.content), key=len, reverse=True)
            self.cut = regex.compile("|".join(map(regex.escape, self.added))).finditer
        else:
            self.model.encode_special_tokens = True
        step = self.model.pre_tokenizer
        self.plain = bool(self.splitter) and self.model.normalizer is None and isinstance(step, pre_tokenizers.ByteLevel) and not step.add_prefix_space
        self.clear()

    def clear(self) -> None:
        self.hashes, self.sizes, self.chars_at, self.chars = Grown(np.uint64), Grown(np.int32), Grown(np.int32), Grown(np.uint32)
        self.counts, self.ids_at, self.ids = Grown(np.int32), Grown(np.int32), Grown(np.int32)
        self.slots = np.zeros(1 << _SLOTS, np.int32)
        self.others: dict[int, int] = {}  # pieces whose slot another one has

    def pieces(self, texts: list[str], joined: str, chars: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Flags of the first characters of pieces."""
        first = np.zeros(len(chars) + 1, bool)
        first[0] = True
        first[ends] = True
        tokens = []
        if any(x in joined for x in self.added):
            for text, end in zip(texts, ends.tolist(), strict=True):
                tokens += [(end - len(text) + m.start(), end - len(text) + m.end()) for m in self.cut(text)]
            for i, j in tokens:
                first[[i, j]] = True
        first = first[:-1]
        if self.splitter:
            start = self.splitter.starts(chars, first)
        else:
            start = first.copy()
            borders = [*np.flatnonzero(first).tolist(), len(chars)]
            for i, j in zip(borders[:-1], borders[1:], strict=True):
                start[[m.start() for m in self.find(joined, i, j)]] = True
        for i, j in tokens:
            start[i + 1 : j] = False
        return start

    def asked(self, pieces: list[str], plain: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The library's ids of pieces in one array, and how many each has. The ``plain`` ones, without white space but a leading space, go to its model at once, written as its byte-level step writes them."""
        lists: list = [None] * len(pieces)
        mine = [i for i in np.flatnonzero(plain).tolist() if pieces[i] not in self.added]
        tokenize = self.model.model.tokenize
        for i, word in zip(mine, "\n".join([pieces[i] for i in mine]).encode().decode("latin-1").translate(_BYTES).split("\n"), strict=False):
            lists[i] = [t.id for t in tokenize(word)]
        left = [i for i, x in enumerate(lists) if x is None]
        for a in range(0, len(left), 4096):  # the library's results are large objects
            part = left[a : a + 4096]
            for i, e in zip(part, self.model.encode_batch_fast([pieces[i] for i in part], add_special_tokens=False), strict=True):
                lists[i] = e.ids
        return np.array([i for x in lists for i in x], np.int32), np.array([len(x) for x in lists], np.int64)

    def learn(self, joined: str, chars: np.ndarray, hashes: np.ndarray, begin: np.ndarray, size: np.ndarray) -> None:
        """Takes up new pieces, each once."""
        mine = chars[ranges(begin, size)]
        plain = np.zeros(len(begin), bool)
        if self.plain:
            at = np.cumsum(size) - size
            space = np.concatenate(([0], np.cumsum(self.splitter.kind.take(mine) == 0)))
            plain = (space[at + size] - space[at] == (mine[at] == 32)) & (size > (mine[at] == 32))
        ids, counts = self.asked([joined[i : i + n] for i, n in zip(begin.tolist(), size.tolist(), strict=True)], plain)
        number = np.arange(self.hashes.size, self.hashes.size + len(begin))
        self.ids_at.append(np.cumsum(counts) - counts + self.ids.size)
        self.ids.append(ids)
        self.chars_at.append(np.cumsum(size) - size + self.chars.size)
        self.chars.append(mine)
        for grown, values in ((self.hashes, hashes), (self.sizes, size), (self.counts, counts)):
            grown.append(values)
        slot = (hashes >> np.uint64(64 - _SLOTS)).astype(np.int64)
        free = self.slots[slot] == 0
        self.slots[slot[free]] = number[free] + 1
        lost = self.slots[slot] != number + 1
        self.others.update(zip(hashes[lost].tolist(), number[lost].tolist(), strict=True))

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in one array, and how many each text has."""
        if self.hashes.size > MEMORY or self.chars.size > 16 * MEMORY:
            self.clear()
        joined, ends = "".join(texts), np.cumsum([len(t) for t in texts]).astype(np.int64)
        if not joined:
            return np.zeros(0, np.int32), np.zeros(len(texts), np.int64)
        chars = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
        begin = np.flatnonzero(self.pieces(texts, joined, chars, ends))
        size = np.diff(begin, append=len(chars))
        index = self.numbers(joined, chars, begin, size)
        if index is None:
            lists = [self.model.encode(t, add_special_tokens=False).ids for t in texts]
            return np.array([i for x in lists for i in x], np.int32), np.array([len(x) for x in lists], np.int64)
        counts = self.counts.all.take(index)
        ids = self.ids.all.take(ranges(self.ids_at.all.take(index), counts))
        total = np.concatenate(([0], np.cumsum(counts)))
        return ids, np.diff(total[np.searchsorted(begin, ends)], prepend=0)

    def numbers(self, joined: str, chars: np.ndarray, begin: np.ndarray, size: np.ndarray) -> np.ndarray | None:
        """Which known piece each piece is; new ones are learnt. None if different pieces have one hash."""
        total = np.zeros(len(chars) + 1, np.uint64)
        np.cumsum(chars * powers(_BASE, len(chars)), out=total[1:])
        hashes = mix((total[begin + size] - total[begin]) * powers(_INVERSE, len(chars)).take(begin) + size.astype(np.uint64))
        index = self.slots.take((hashes >> np.uint64(64 - _SLOTS)).astype(np.int64)).astype(np.int64) - 1
        miss = np.flatnonzero((index < 0) | (self.hashes.all.take(index) != hashes))
        if len(miss):
            unique, at, inverse = np.unique(hashes[miss], return_index=True, return_inverse=True)
            number = np.array([self.others.get(h, -1) for h in unique.tolist()], np.int64)
            new = np.flatnonzero(number < 0)
            number[new] = np.arange(self.hashes.size, self.hashes.size + len(new))
            at = miss[at[new]]
            self.learn(joined, chars, unique[new], begin[at], size[at])
            index[miss] = number[inverse]
        if not np.array_equal(self.sizes.all.take(index), size) or not np.array_equal(self.chars.all.take(ranges(self.chars_at.all.take(index), size)), chars):
            return None
        return index


@lru_cache(maxsize=2)
def library(path: str, pattern: str, added: bool = False) -> LibraryEncoder:
    return LibraryEncoder(path, pattern, added)


def _rows(part: int, block: int, ids: np.ndarray, runs: list[list[tuple[int, int | None, int]]]) -> pa.RecordBatch:
    cut = [ids[i : i + BLOCK] for i in range(0, len(ids), BLOCK)]
    data = range_coder.encode(cut)
    return pa.RecordBatch.from_arrays(
        [
            pa.array([part] * len(cut), pa.int32()),
            pa.array(range(block, block + len(cut)), pa.int64()),
            pa.array([(block + k) * BLOCK for k in range(len(cut))], pa.int64()),
            pa.array([len(x) for x in cut], pa.int32()),
            pa.array(data, pa.binary()),
            pa.array([zlib.crc32(x) for x in data], pa.int64()),
            pa.array([[{"ordinal": o, "doc_id": d, "n": n} for o, d, n in r] for r in runs], pa.list_(pa.struct([("ordinal", pa.int64()), ("doc_id", pa.int64()), ("n", pa.int32())]))),
        ],
        ["part", "block", "first", "n_ids", "payload", "crc", "runs"],
    )


def write_tokens(docs: DataFrame, folder: str, path: str, pattern: str, end: int = 2, added: bool = False) -> None:
    """Encodes ``docs(doc_id, text)``, ``end`` after each document, and writes the files to ``folder``; ``added``: see ``LibraryEncoder``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, part = library(path, pattern, added), TaskContext.get().partitionId()
        block, ordinal, filled, runs = 0, 0, 0, [[]]
        held: list[np.ndarray] = []
        last = np.array([end], np.int32)
        for batch in batches:
            for piece in chunks(batch, size=CHUNK // 4):
                ids, counts = model.encode(piece.column("text").fill_null("").to_pylist())
                for one in np.split(ids, np.cumsum(counts)[:-1]):
                    held += [one, last]
                for doc_id, n in zip(piece.column("doc_id").to_pylist(), (counts + 1).tolist(), strict=True):
                    while n:
                        if filled == BLOCK:
                            runs.append([])
                            filled = 0
                        take = min(n, BLOCK - filled)
                        runs[-1].append((ordinal, doc_id, take))
                        filled, n = filled + take, n - take
                    ordinal += 1
                if len(runs) > LANES:
                    ids = np.concatenate(held)
                    held = [ids[LANES * BLOCK :].copy()]
                    ids = ids[: LANES * BLOCK]
                    yield _rows(part, block, ids, runs[:LANES])
                    block, runs = block + LANES, runs[LANES:]
        ids = np.concatenate(held) if held else np.zeros(0, np.int32)
        held.clear()
        while len(ids):
            n = min(LANES * BLOCK, len(ids))
            full = -(-n // BLOCK)
            yield _rows(part, block, ids[:n], runs[:full])
            block, ids, runs = block + full, ids[n:], runs[full:]
        trim()

    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    docs.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text").mapInArrow(run, _FILE).write.parquet(folder)


def _decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs of every block with their ids."""
    for batch in batches:
        for at in range(0, batch.num_rows, LANES):
            part = batch.slice(at, LANES)
            data = part.column("payload").to_pylist()
            for x, crc, p, b in zip(data, part.column("crc").to_pylist(), part.column("part").to_pylist(), part.column("block").to_pylist(), strict=True):
                if zlib.crc32(x) != crc:
                    raise ValueError(f"block {b} of part {p} is damaged")
            blocks = range_coder.decode(data, part.column("n_ids").to_pylist())
            runs = part.column("runs")
            owner = np.repeat(np.arange(len(blocks)), np.diff(np.asarray(runs.offsets)))
            flat = runs.flatten()
            n = np.asarray(flat.field("n")).astype(np.int64)
            ids = np.concatenate(blocks) if blocks else np.zeros(0, np.int32)
            offset = np.cumsum(n) - n
            base = np.cumsum([0, *map(len, blocks[:-1])])[owner] if len(owner) else owner
            yield pa.RecordBatch.from_arrays(
                [
                    part.column("part").take(pa.array(owner)),
                    flat.field("ordinal"),
                    flat.field("doc_id"),
                    pa.array(np.asarray(part.column("first"))[owner] + offset - base),
                    pa.ListArray.from_arrays(pa.array(np.append(offset, len(ids)), pa.int32()), pa.array(ids, pa.int32())),
                ],
                ["part", "ordinal", "doc_id", "first", "ids"],
            )


def read_tokens(spark: SparkSession, folder: str, summed: bool = False) -> DataFrame:
    """(part, ordinal, doc_id, first, ids) of each run of a document in a block; runs of one document follow by ``first``.  ``summed``: n and crc of the ids in their place."""
    files = spark.read.schema(_FILE).parquet(folder)
    if summed:
        return files.mapInArrow(lambda batches: _checksums(_decoded(batches)), _SUMMED)
    return files.mapInArrow(_decoded, "part int, ordinal long, doc_id long, first long, ids array<int>")


@lru_cache(maxsize=1)
def _zeros() -> np.ndarray:
    """What 1, 2, 4 ... zero bytes behind a text make of its crc32: for each count, that of each byte value of the crc in each of its places."""
    bits = np.uint32(1) << np.arange(32, dtype=np.uint32)
    step = np.concatenate((np.array([0xEDB88320], np.uint32), bits[:-1]))  # of one zero bit, for each bit of a crc
    values = np.arange(256)
    tables = np.zeros((40, 4, 256), np.uint32)
    for k in range(-3, 40):
        table = np.zeros((4, 256), np.uint32)
        for i in range(32):
            table[i // 8] ^= np.where(values >> (i % 8) & 1, step[i], 0).astype(np.uint32)
        if k >= 0:
            tables[k] = table
        step = table[0, step & 255] ^ table[1, step >> 8 & 255] ^ table[2, step >> 16 & 255] ^ table[3, step >> 24]
    return tables


def crcs_before(crcs: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """What crc32s (uint32) add, by exclusive or, to those of texts that go on for ``sizes`` further bytes."""
    out = crcs.copy()
    for k, table in enumerate(_zeros()):
        who = np.flatnonzero((sizes >> k) & 1)
        if len(who):
            x = out[who]
            out[who] = table[0, x & 255] ^ table[1, x >> 8 & 255] ^ table[2, x >> 16 & 255] ^ table[3, x >> 24]
    return out


def crc_joined(first: int, second: int, size: int) -> int:
    """crc32 of A + B from those of A and of B and the length of B."""
    return int(crcs_before(np.array([first], np.uint32), np.array([size]))[0]) ^ second


def _checksums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids = batch.column("ids")
        at = np.asarray(ids.offsets).astype(np.int64)
        raw = memoryview(np.asarray(ids.flatten()).astype("<u4").tobytes())
        at = (at - at[0]) * 4
        crc = [zlib.crc32(raw[i:j]) for i, j in zip(at[:-1], at[1:], strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column(c) for c in ("part", "ordinal", "doc_id", "first")] + [pa.array(np.diff(at) // 4), pa.array(crc, pa.int64())], ["part", "ordinal", "doc_id", "first", "n", "crc"])


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        runs = batch.column("runs")
        start = np.asarray(runs.offsets).astype(np.int64)
        start, flat = start - start[0], runs.flatten()
        end = np.cumsum(np.asarray(flat.field("n")))
        after = np.repeat(end[start[1:] - 1], np.diff(start)) - end
        parts = crcs_before(np.asarray(flat.field("crc")).astype(np.uint32), 4 * after)
        out = np.bitwise_xor.reduceat(parts, start[:-1]) if len(parts) else parts
        yield pa.RecordBatch.from_arrays([batch.column(c) for c in ("part", "doc_id", "first", "n")] + [pa.array(out.astype(np.int64))], ["part", "doc_id", "first", "n", "crc"])


def documents_of(runs: DataFrame) -> DataFrame:
    """(part, doc_id, first, n, crc) of each document from its runs, summed or not."""
    short = runs if "crc" in runs.columns else runs.mapInArrow(_checksums, _SUMMED)
    whole = short.groupBy("part", "ordinal", "doc_id").agg(F.min("first").alias("first"), F.sum("n").alias("n"), F.array_sort(F.collect_list(F.struct("first", "n", "crc"))).alias("runs"))
    return whole.select("part", "doc_id", "first", "n", "runs").mapInArrow(_joined, "part int, doc_id long, first long, n long, crc long")


def op3_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text of ``documents`` written as coded ids, read back: its place, length and checksum."""
    import public_tokenizers

    folder = new_path(spark, "tokens")
    write_tokens(table(spark, sf_dir, "documents", "doc_id", "text"), folder, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN, added=True)
    found = documents_of(read_tokens(spark, folder, summed=True))
    sizes = spark.read.schema(_FILE).parquet(folder).groupBy("part").agg(F.sum("n_ids").alias("size"))
    base = F.coalesce(F.sum("size").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = sizes.select("part", base.alias("base"))  # a row for each written file
    return found.join(F.broadcast(starts), "part").select(
        "doc_id", (F.col("base") + F.col("first")).alias("start"), F.col("n").alias("n_tokens"), F.col("crc").alias("ids_crc32")
    )


QUERIES = {"op3_tokens": op3_tokens}
ORACLE = {}
