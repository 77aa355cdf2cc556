"""Alignment of two tokenizers' ids over byte offsets, with corpus-wide counts of linked pairs.

The first pass reads the documents, notes for each *part* (about ``PART``
bytes of text) the distinct linked pairs of ids and how many of its documents
hold each, and writes the texts with their part.  A pair belongs to the bucket of its
first id; the number of pairs a bucket can hold is bounded by the two
vocabularies.  Each bucket's distinct pairs are united over a tree of
``FAN`` parts a node and get a minimal perfect hash (levels of bit arrays
without collisions, places by rank).  Counts are then dense vectors indexed by
that hash, summed over the same tree.  The pairs of each part look their counts up through the hash,
where the key stored at the place is compared, and the second pass aligns the documents of
the part again and adds up what it found.

Both tokenizers cut a text before a space that follows a letter, digit or mark;
what lies between two such cuts is encoded, aligned and kept once a worker.

Defined cases: null and empty texts, and those whose joined token bytes differ from
space + text, have no tokens: zeros and an empty digest; rows of one id
are documents of their own and count each; ids may be null; a text of any
length is taken whole, a long one is a part by itself; an empty table gives no rows;
extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
from bisect import bisect
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docketflow.llm.shared import buffers, chunks, mix, ranges, table, written

#: Bytes of text of a part.
PART = 4 << 20
#: Parts of a node of the tree.
FAN = 256
#: Buckets of pairs: none holds more than its share of first ids times the second vocabulary.
BUCKETS = 256
#: Ids are below this; a pair is a * WIDTH + b.
WIDTH = 1 << 24
#: Pieces of text, and bytes of them, that a worker keeps before it starts anew.
MEMORY, MEMORY_BYTES = 150_000, 32 << 20
#: Bytes of pieces that are encoded in one call.
LUMP = 1 << 16


def byte_level() -> dict[str, int]:
    """The printable stand-in of each byte in byte-level vocabularies: printable Latin-1 stands for itself, the rest follow from U+0100."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


class Aligner:
    """Pieces of text with the groups and links of their two token sequences."""

    def __init__(self, a_path: str, b_path: str, pattern: str):
        import sentencepiece
        import tiktoken

        with open(a_path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        stand_in = byte_level()
        raw = {i: bytes(stand_in[c] for c in token) for token, i in model["vocab"].items() if all(c in stand_in for c in token)}
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        order = [model["vocab"]["".join(m)] for m in merges]
        if order != sorted(set(order)):
            raise ValueError("merges must be in the order of their ids")
        learnt = set(order)
        # An id that no merge makes, and no single byte, is a special token: plain text here.
        self.a = tiktoken.Encoding("aligned", pat_str=pattern, mergeable_ranks={x: i for i, x in raw.items() if i in learnt or len(x) == 1}, special_tokens={})
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        if any("▁" in p.lstrip("▁") for p in pieces):
            raise ValueError("pieces must not go on after a space")
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        self.a_size = np.array([len(raw.get(i, b"")) for i in range(max(raw) + 1)], np.int64)
        self.b_size = np.array([len(x) for x in self.b_bytes], np.int64)
        if max(len(self.a_size), len(self.b_size)) > WIDTH:
            raise ValueError("ids must be below WIDTH")
        # What stands behind an id in a digest: a comma in a group, a bar after A's last, a semicolon after B's.
        self.a_name, self.b_name = (np.array([[f"{i}{end}" for i in range(n)] for end in ends], object) for n, ends in ((len(self.a_size), ",|"), (len(self.b_size), ",;")))
        self.clear()

    def clear(self) -> None:
        self.place: dict[bytes, int] = {}
        self.held = 0
        self.digest: list[str] = []
        self.keys = np.zeros(0, np.int64)
        self.sizes = np.zeros((0, 5), np.int64)  # n_a, n_b, n_groups, n_links, whole
        self.first, self.count = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.pair, self.times = np.zeros(0, np.int32), np.zeros(0, np.int32)

    def encoded(self, fresh: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Ids of A and of B of all pieces, how many each piece has, and whether a piece's bytes are those of both.

        Pieces are encoded many in one text, as both tokenizers cut it between
        them, but after a piece that ends as ``cut`` would not have it; a piece that
        B would change stands alone.
        """
        size = np.array([len(p) for p in fresh], np.int64)
        ends = np.cumsum(size)
        whole = np.ones(len(fresh), bool)
        ids_a, ids_b = [], []
        at, stops = 0, [i + 1 for i, p in enumerate(fresh) if not 32 < p[-1] < 127 and not _splits(p)]
        while at < len(fresh):
            to = max(at + 1, int(np.searchsorted(ends, ends[at] - size[at] + LUMP)))
            to = min(to, stops[k] if (k := bisect(stops, at)) < len(stops) else to)
            raw = b"".join(fresh[at:to])
            text = raw.decode()
            a, b = self.a.encode_ordinary(text), self.b.encode(text[1:])
            if b"".join(map(self.b_bytes.__getitem__, b)) != raw:
                # Some piece is not what B makes of it: encode them by themselves.
                b = []
                for i in range(at, to):
                    own = self.b.encode(fresh[i].decode()[1:])
                    whole[i] = b"".join(map(self.b_bytes.__getitem__, own)) == fresh[i]
                    b += own if whole[i] else []
            ids_a.append(np.array(a, np.int64))
            ids_b.append(np.array(b, np.int64))
            at = to
        flat_a, flat_b = (np.concatenate([np.zeros(0, np.int64), *x]) for x in (ids_a, ids_b))
        own_a = np.searchsorted(ends, np.cumsum(self.a_size[flat_a]))
        flat_a, own_a = flat_a[whole[own_a]], own_a[whole[own_a]]
        own_b = np.searchsorted(np.cumsum(size[whole]), np.cumsum(self.b_size[flat_b]))
        return flat_a, flat_b, np.bincount(own_a, minlength=len(fresh)), np.bincount(np.flatnonzero(whole)[own_b], minlength=len(fresh)), whole

    def add(self, fresh: list[bytes], digests: bool) -> None:
        """Encodes new pieces, each of which begins with a space, and aligns them side by side."""
        flat_a, flat_b, n_a, n_b, whole = self.encoded(fresh)
        ends_a, ends_b = np.cumsum(self.a_size[flat_a]), np.cumsum(self.b_size[flat_b])
        ends = np.intersect1d(ends_a, ends_b, assume_unique=True)  # where groups end; pieces end there too
        of_a, of_b = np.searchsorted(ends, ends_a), np.searchsorted(ends, ends_b)
        size_a, size_b = np.bincount(of_a, minlength=len(ends)), np.bincount(of_b, minlength=len(ends))
        piece = np.repeat(np.arange(len(fresh)), n_a)[np.cumsum(size_a) - 1] if len(ends) else np.zeros(0, np.int64)
        # Every token of A with all of B's of its group: for a pair of ids its times in the piece.
        first_b = np.cumsum(size_b) - size_b
        pairs, own = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for i in range(0, len(flat_a), 1 << 20):
            g = of_a[i : i + (1 << 20)]
            pairs.append(np.repeat(flat_a[i : i + (1 << 20)] * WIDTH, size_b[g]) + flat_b[ranges(first_b[g], size_b[g])])
            own.append(np.repeat(piece[g], size_b[g]))
        pairs, own = np.concatenate(pairs), np.concatenate(own)
        order = np.lexsort((pairs, own))
        pairs, own = pairs[order], own[order]
        new = np.ones(len(pairs), bool)
        new[1:] = (pairs[1:] != pairs[:-1]) | (own[1:] != own[:-1])
        at = np.flatnonzero(new)
        times, owner, pairs = np.diff(np.append(at, len(pairs))), own[at], pairs[at]
        # Pairs get a number of the worker's own, by their order among all it knows.
        known = np.union1d(self.keys, pairs)
        self.pair = np.searchsorted(known, self.keys).astype(np.int32)[self.pair] if len(self.pair) else self.pair
        count = np.bincount(owner, minlength=len(fresh))
        self.first = np.concatenate((self.first, len(self.pair) + np.cumsum(count) - count))
        self.count = np.concatenate((self.count, count))
        self.pair = np.concatenate((self.pair, np.searchsorted(known, pairs).astype(np.int32)))
        self.times, self.keys = np.concatenate((self.times, times.astype(np.int32))), known
        n_groups = np.bincount(piece, minlength=len(fresh))
        sizes = (n_a, n_b, n_groups, np.bincount(piece, size_a * size_b, len(fresh)).astype(np.int64), whole.astype(np.int64))
        self.sizes = np.concatenate((self.sizes, np.stack(sizes, 1)))
        if digests:
            last_a, last_b = np.cumsum(size_a), np.cumsum(size_b)
            names = np.empty(len(flat_a) + len(flat_b), object)
            names[np.arange(len(flat_a)) + first_b[of_a]] = self.a_name[(ends_a == ends[of_a]).astype(np.int8), flat_a]
            names[np.arange(len(flat_b)) + last_a[of_b]] = self.b_name[(ends_b == ends[of_b]).astype(np.int8), flat_b]
            names, to = names.tolist(), np.concatenate(([0], last_a + last_b))[np.cumsum(n_groups)].tolist()
            self.digest += ["".join(names[i:j]) for i, j in zip([0, *to], to, strict=False)]
        self.place.update(zip(fresh, range(len(self.place), len(self.place) + len(fresh)), strict=True))

    def pieces(self, texts: pa.Array, digests: bool) -> tuple[np.ndarray, np.ndarray]:
        """The number of each piece of all texts in one array, and where each text's begin (one more at the end)."""
        if len(self.place) > MEMORY or self.held > MEMORY_BYTES or (digests and len(self.digest) < len(self.place)):
            self.clear()
        data, offsets = buffers(texts)
        starts, ends, rows = cut(data, offsets)
        raw, place = data.tobytes(), self.place
        texts = [raw[i:j] for i, j in zip(starts.tolist(), ends.tolist(), strict=True)]
        for i in np.unique(rows[:-1][np.diff(rows) > 0]).tolist():
            texts[i] = b" " + texts[i]
        fresh = list({p: None for p in texts if p not in place})
        if fresh:
            self.add(fresh, digests)
            self.held += sum(map(len, fresh))
        return np.array([place[p] for p in texts], np.int64), rows

    def links(self, pieces: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All (place in ``pieces``, link entry) of pieces."""
        return np.repeat(np.arange(len(pieces)), self.count[pieces]), ranges(self.first[pieces], self.count[pieces])


def _splits(piece: bytes) -> bool:
    """Whether ``cut`` may begin a piece after this one: by the lead byte of its last character."""
    lead = next(c for c in reversed(piece) if not 0x80 <= c < 0xC0)
    return 32 < lead < 127 or 0xC3 <= lead < 0xE0 or lead >= 0xE4


def cut(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the pieces of each row, and each row's first piece (one more at the end).

    A piece begins with the row or at a space, with something behind it, after a
    character that no tokenizer takes for white space: printable ASCII, or by
    its lead byte one from U+00C0 to U+07FF or above U+3FFF.
    """
    n = len(data)
    lead = np.zeros(n, np.uint8)  # the first byte of the character that ends before this place
    lead[1:] = data[:-1]
    for back in (2, 3, 4):
        inside = (lead >= 0x80) & (lead < 0xC0)
        inside[:back] = False
        lead[inside] = data[np.flatnonzero(inside) - back]
    begins = (data == 32) & (((lead > 32) & (lead < 127)) | ((lead >= 0xC3) & (lead < 0xE0)) | (lead >= 0xE4))
    filled = np.diff(offsets) > 0
    begins[offsets[1:][filled] - 1] = False
    begins[offsets[:-1][filled]] = True
    starts = np.flatnonzero(begins)
    return starts, np.append(starts[1:], n)[: len(starts)], np.searchsorted(starts, offsets)


@lru_cache(maxsize=2)
def aligner(a_path: str, b_path: str, pattern: str) -> Aligner:
    return Aligner(a_path, b_path, pattern)


def _distinct(values: np.ndarray) -> np.ndarray:
    """The distinct values in order."""
    values = np.sort(values)
    return values[np.append(True, values[1:] != values[:-1])] if len(values) else values


def documents(model: Aligner, texts: pa.Array, digests: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Pieces, the row of each, and per row the sums of n_a, n_b, n_groups, n_links (zeros for a row that is not whole) and whether it is whole."""
    pieces, rows = model.pieces(texts, digests)
    own = np.repeat(np.arange(len(texts)), np.diff(rows))
    whole = np.diff(rows) > 0
    whole[own[model.sizes[pieces, 4] == 0]] = False
    stays = whole[own]
    pieces, own = pieces[stays], own[stays]
    sums = np.zeros((len(texts), 4), np.int64)
    np.add.at(sums, own, model.sizes[pieces, :4])
    return pieces, own, sums, whole


def _first_pass(*paths: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, part, held = aligner(*paths), TaskContext.get().partitionId() << 32, 0
        keys, counts = [], []

        def close():
            every, own = np.unique(np.concatenate([np.zeros(0, np.int64), *keys]), return_inverse=True)
            total = np.bincount(own, np.concatenate([np.zeros(0, np.int64), *counts]), len(every)).astype(np.int64)
            return pa.RecordBatch.from_arrays([pa.array([part], pa.int64()), pa.nulls(1, pa.int64()), pa.nulls(1, pa.string()), pa.array([every.tobytes()]), pa.array([total.tobytes()])], ["part", "doc_id", "text", "keys", "counts"])

        for batch in (c for b in batches for c in chunks(b)):
            n = batch.num_rows
            pieces, own, _, _ = documents(model, batch.column("text"))
            once = _distinct(own * len(model.place) + pieces)
            place, entry = model.links(once % max(len(model.place), 1))
            each = _distinct((once // max(len(model.place), 1))[place] * max(len(model.keys), 1) + model.pair[entry])
            c = np.bincount(each % max(len(model.keys), 1), minlength=len(model.keys))
            keys.append(model.keys[c > 0])
            counts.append(c[c > 0])
            yield pa.RecordBatch.from_arrays([pa.array(np.full(n, part)), batch.column("doc_id"), batch.column("text"), pa.nulls(n, pa.binary()), pa.nulls(n, pa.binary())], ["part", "doc_id", "text", "keys", "counts"])
            held += batch.column("text").nbytes
            if held >= PART:
                yield close()
                part, held, keys, counts = part + 1, 0, [], []
        if keys:
            yield close()

    return run


def perfect_hash(keys: np.ndarray) -> list[bytes]:
    """Levels of bit arrays: a key whose place in a level is its own alone sets the bit there, the others go on to the next."""
    levels, rest = [], keys
    while len(rest):
        size = -(-max(2 * len(rest), 64) // 8) * 8
        at = _at(rest, len(levels), size)
        alone = np.bincount(at, minlength=size) == 1
        levels.append(np.packbits(alone).tobytes())
        rest = rest[~alone[at]]
    return levels


def _at(keys: np.ndarray, level: int, size: int) -> np.ndarray:
    return (mix(mix(keys.astype(np.uint64) + np.uint64(level * 0x9E3779B97F4A7C15 % (1 << 64)))) % np.uint64(size)).astype(np.int64)


def hashed(levels: list[bytes], keys: np.ndarray) -> np.ndarray:
    """The place of each key, 0 to the number of keys - 1; -1 where no level knows it (a stranger may also get another's place)."""
    out, base, rest = np.full(len(keys), -1, np.int64), 0, np.arange(len(keys))
    for level, raw in enumerate(levels):
        bits = np.unpackbits(np.frombuffer(raw, np.uint8))
        at = _at(keys[rest], level, len(bits))
        hit = bits[at] == 1
        rank = np.cumsum(bits, dtype=np.int64)
        out[rest[hit]] = base + rank[at[hit]] - 1
        base, rest = base + int(rank[-1]), rest[~hit]
    return out


def _array(scalar: pa.Scalar, kind=np.int64) -> np.ndarray:
    return np.frombuffer(scalar.as_py(), kind)


def _rows(names: list[str], types: list[pa.DataType], rows: list[tuple]) -> pa.Table:
    return pa.table([pa.array(list(column), t) for column, t in zip(zip(*rows, strict=True) if rows else [()] * len(names), types, strict=True)], names=names)


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The pairs of a part by bucket."""
    for batch in batches:
        for part, keys, counts in zip(batch.column("part").to_pylist(), batch.column("keys"), batch.column("counts"), strict=True):
            keys, counts = _array(keys), _array(counts)
            bucket = (mix(keys.astype(np.uint64) // np.uint64(WIDTH)) % np.uint64(BUCKETS)).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            ends = np.cumsum(np.bincount(bucket, minlength=BUCKETS))
            found = [(b, part, keys[order[i:j]].tobytes(), counts[order[i:j]].tobytes()) for b, (i, j) in enumerate(zip([0, *ends[:-1]], ends, strict=True)) if j > i]
            yield from _rows(["bucket", "part", "keys", "counts"], [pa.int64(), pa.int64(), pa.binary(), pa.binary()], found).to_batches()


def _union(group: pa.Table) -> pa.Table:
    keys = np.unique(np.concatenate([_array(k) for k in group.column("keys")]))
    return _rows(["bucket", "slot", "keys"], [pa.int64(), pa.int64(), pa.binary()], [(group.column("bucket")[0].as_py(), group.column("slot")[0].as_py() // FAN, keys.tobytes())])


def _summed(group: pa.Table) -> pa.Table:
    total = sum(_array(v) for v in group.column("vector"))
    return _rows(["bucket", "slot", "vector"], [pa.int64(), pa.int64(), pa.binary()], [(group.column("bucket")[0].as_py(), group.column("slot")[0].as_py() // FAN, total.tobytes())])


def _with_hash(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for bucket, keys in zip(batch.column("bucket").to_pylist(), batch.column("keys"), strict=True):
            keys = _array(keys)
            levels = perfect_hash(keys)
            stored = np.empty_like(keys)
            stored[hashed(levels, keys)] = keys
            rows.append((bucket, levels, stored.tobytes()))
        yield from _rows(["bucket", "levels", "keys"], [pa.int64(), pa.list_(pa.binary()), pa.binary()], rows).to_batches()


def _dense(pieces: pa.Table, known: pa.Table) -> pa.Table:
    """Counts of a node's parts as one vector in the order of the hash."""
    rows = []
    if pieces.num_rows:
        levels = known.column("levels")[0].as_py()
        total = np.zeros(known.column("n")[0].as_py(), np.int64)
        for keys, counts in zip(pieces.column("keys"), pieces.column("counts"), strict=True):
            total[hashed(levels, _array(keys))] += _array(counts)  # distinct keys: distinct places
        rows = [(pieces.column("bucket")[0].as_py(), pieces.column("slot")[0].as_py() // FAN, total.tobytes())]
    return _rows(["bucket", "slot", "vector"], [pa.int64(), pa.int64(), pa.binary()], rows)


def _with_best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Marks the pairs whose count is the highest of their first id; a bucket has all pairs of it."""
    for batch in batches:
        best = []
        for keys, counts in zip(batch.column("keys"), batch.column("vector"), strict=True):
            first, counts = _array(keys) // WIDTH, _array(counts)
            order = np.lexsort((-counts, first))
            begins = np.ones(len(order), bool)
            begins[1:] = first[order][1:] != first[order][:-1]
            most = np.empty_like(counts)
            most[order] = counts[order][begins][np.cumsum(begins) - 1]
            best.append((counts == most).tobytes())
        yield pa.RecordBatch.from_arrays([batch.column(c) for c in ("bucket", "levels", "keys", "vector")] + [pa.array(best, pa.binary())], ["bucket", "levels", "keys", "vector", "best"])


def _looked_up(pieces: pa.Table, known: pa.Table) -> pa.Table:
    rows = []
    if pieces.num_rows:
        levels, stored, total = known.column("levels")[0].as_py(), _array(known.column("keys")[0]), _array(known.column("vector")[0])
        best = _array(known.column("best")[0], bool)
        for part, keys in zip(pieces.column("part").to_pylist(), pieces.column("keys"), strict=True):
            wanted = _array(keys)
            at = hashed(levels, wanted)
            if (at < 0).any() or (stored[at] != wanted).any():
                raise ValueError("a pair is not under its hash")
            rows.append((part, keys.as_py(), total[at].tobytes(), best[at].tobytes()))
    return _rows(["part", "keys", "counts", "best"], [pa.int64(), pa.binary(), pa.binary(), pa.binary()], rows)


_RESULT = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"


def _second_pass(*paths: str):
    """Documents of a part, aligned again, with the counts of the part's pairs."""

    def run(docs: pa.Table, known: pa.Table) -> pa.Table:
        model = aligner(*paths)
        keys, counts, best = (np.concatenate([np.zeros(0, kind), *(_array(x, kind) for x in known.column(c))]) for c, kind in (("keys", np.int64), ("counts", np.int64), ("best", bool)))
        order = np.argsort(keys)
        keys, counts, best = keys[order], counts[order], best[order].astype(np.int64)
        out = []
        for batch in (c for b in docs.to_batches() for c in chunks(b)):
            pieces, own, sums, whole = documents(model, batch.column("text"), digests=True)
            used, own_piece = np.unique(pieces, return_inverse=True)
            place, entry = model.links(used)
            at = np.searchsorted(keys, model.keys[model.pair[entry]])
            by_piece = np.zeros((len(used), 2), np.int64)
            np.add.at(by_piece[:, 0], place, best[at] * model.times[entry])
            np.add.at(by_piece[:, 1], place, counts[at] * model.times[entry])
            found = np.zeros((batch.num_rows, 2), np.int64)
            np.add.at(found, own, by_piece[own_piece])
            ends = np.searchsorted(own, np.arange(batch.num_rows + 1)).tolist()
            digest, numbers = model.digest, pieces.tolist()
            sha = [hashlib.sha256("".join([digest[p] for p in numbers[i:j]])[:-1].encode()).hexdigest() if ok else "" for i, j, ok in zip(ends[:-1], ends[1:], whole.tolist(), strict=True)]
            columns = [pa.array(sums[:, i]) for i in range(4)] + [pa.array(found[:, i]) for i in range(2)] + [pa.array(sha, pa.string())]
            out.append(pa.RecordBatch.from_arrays([batch.column("doc_id"), *columns], ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]))
        return pa.Table.from_batches(out) if out else _rows(["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"], [pa.int64()] * 7 + [pa.string()], [])

    return run


def _up_the_tree(rows: DataFrame, slots: int, merge, schema: str) -> DataFrame:
    """One row a bucket from ``rows(bucket, slot, ..)``: ``FAN`` slots become one, until one is left."""
    while True:
        rows = rows.groupBy("bucket", "slot").applyInArrow(merge, schema)
        if slots <= 1:
            return rows
        slots = -(-slots // FAN)


def pair_counts(firsts: DataFrame) -> tuple[DataFrame, DataFrame, int]:
    """From ``firsts(part, keys, counts)``: pieces (bucket, slot, part, keys, counts), one row a bucket with hash, keys, counts and best, and the slots."""
    slots = max(1, -(-firsts.count() // FAN))
    pieces = firsts.mapInArrow(_pieces, "bucket long, part long, keys binary, counts binary")
    pieces = written(pieces.withColumn("slot", F.pmod(F.xxhash64("part"), F.lit(slots))), "pieces")
    union = _up_the_tree(pieces.select("bucket", "slot", "keys"), slots, _union, "bucket long, slot long, keys binary")
    known = written(union.select("bucket", "keys").mapInArrow(_with_hash, "bucket long, levels array<binary>, keys binary"), "hashes")
    every = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(slots - 1).cast("long"))).alias("slot")
    sides = pieces.groupBy("bucket", "slot").cogroup(known.select("bucket", "levels", (F.octet_length("keys") / 8).cast("long").alias("n"), every).groupBy("bucket", "slot"))
    vectors = sides.applyInArrow(_dense, "bucket long, slot long, vector binary")
    while slots > 1 and (slots := -(-slots // FAN)):
        vectors = vectors.groupBy("bucket", "slot").applyInArrow(_summed, "bucket long, slot long, vector binary")
    full = known.hint("merge").join(vectors.select("bucket", "vector"), "bucket").mapInArrow(_with_best, "bucket long, levels array<binary>, keys binary, vector binary, best binary")
    return pieces, written(full, "pair-counts"), max(1, -(-firsts.count() // FAN))


def aligned(docs: DataFrame, a_path: str, b_path: str, pattern: str) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) of ``docs(doc_id, text)``.

    A is byte-level BPE in a json file with its ``pattern``, B a piece model.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    first = written(docs.mapInArrow(_first_pass(a_path, b_path, pattern), "part long, doc_id long, text string, keys binary, counts binary"), "first-pass")
    pieces, known, slots = pair_counts(first.where("keys IS NOT NULL").select("part", "keys", "counts"))
    every = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(slots - 1).cast("long"))).alias("slot")
    sides = pieces.groupBy("bucket", "slot").cogroup(known.select("*", every).groupBy("bucket", "slot"))
    found = written(sides.applyInArrow(_looked_up, "part long, keys binary, counts binary, best binary"), "found")
    texts = first.where("keys IS NULL").select("part", "doc_id", "text")
    return texts.groupBy("part").cogroup(found.groupBy("part")).applyInArrow(_second_pass(a_path, b_path, pattern), _RESULT)


def op11_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text of ``documents`` in byte-level and in piece tokens: groups, links and how often their pairs are linked in the corpus."""
    import public_tokenizers

    return aligned(table(spark, sf_dir, "documents", "doc_id", "text"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"), public_tokenizers.PATTERN)


QUERIES = {"op11_alignment": op11_alignment}
ORACLE = {}
