"""Byte-level BPE encoding and decoding in padded numpy matrices.

Texts are cut by the split pattern; the distinct pieces of a batch that are
not yet known are put in buckets of like length, one padded matrix of token
ids each.  In every round each row looks up all its neighbouring pairs in a
hashed table, merges its leftmost pair of smallest rank and closes the gap;
rows without a mergeable pair leave.  A piece of more than ``LONG`` bytes is a
row of its own and merges in a round all places of that pair that cannot matter
to each other, so its rounds grow with the ranks it holds and not with its length.  A piece that is itself a token needs no
rounds, as in the tiktoken library.

Defined cases: null text is an empty text and has no ids; ids of special
tokens are never made; a text may be of any length (pieces, not texts, are
padded; a piece of up to ``LONG`` bytes takes at most as many rounds);
repeated rows and extra columns change nothing.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache
from hashlib import sha256

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

from docketflow.llm.shared import chunks, mix, ranges, table

#: Distinct pieces a worker remembers before it starts anew.
MEMORY = 400_000
#: Cells of a matrix.
CELLS = 1 << 20
#: Bytes of a piece beyond which it is merged alone.
LONG = 2000
_NONE = np.int32(2**31 - 1)


class Ranks:
    """Ranks of byte sequences, as lookup arrays: ``ranks`` maps a token's bytes to its id."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ids = ranks
        size = max(ranks.values()) + 1
        self.byte = np.array([ranks[bytes([b])] for b in range(256)], np.int32)
        tokens: list[bytes] = [b""] * size
        for token, i in ranks.items():
            tokens[i] = token
        self.length = np.array([len(t) for t in tokens], np.int64)
        self.start = np.cumsum(self.length) - self.length
        self.data = np.frombuffer(b"".join(tokens), np.uint8)
        self.text = [b"%d," % i for i in range(size)]
        pairs = [(ranks[t[:k]], ranks[t[k:]], i) for t, i in ranks.items() for k in range(1, len(t)) if t[:k] in ranks and t[k:] in ranks]
        left, right, merged = np.array(pairs, np.int64).T
        self._fill((left << 32) | right, merged.astype(np.int32))

    def _fill(self, keys: np.ndarray, values: np.ndarray) -> None:
        """Open addressing with linear probing; placed in rounds, first come at each slot."""
        self.mask = np.uint64((1 << int(np.ceil(np.log2(len(keys) * 4)))) - 1)
        self.keys = np.full(int(self.mask) + 1, -1, np.int64)
        self.values = np.full(int(self.mask) + 1, _NONE, np.int32)
        slot, self.probes = (mix(keys.view(np.uint64)) & self.mask).astype(np.int64), 0
        while len(keys):
            free = self.keys[slot] < 0
            _, one = np.unique(slot[free], return_index=True)
            won = np.flatnonzero(free)[one]
            self.keys[slot[won]], self.values[slot[won]] = keys[won], values[won]
            rest = np.ones(len(keys), bool)
            rest[won] = False
            keys, values, slot = keys[rest], values[rest], (slot[rest] + 1) & int(self.mask)
            self.probes += 1

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair's merger, _NONE where there is none."""
        key = (left.astype(np.int64) << 32) | right.astype(np.int64)
        out = np.full(key.shape, _NONE, np.int32)
        todo = np.flatnonzero((left >= 0) & (right >= 0))
        key = key.ravel()[todo]
        slot = (mix(key.view(np.uint64)) & self.mask).astype(np.int64)
        flat = out.ravel()
        for _ in range(self.probes):
            there = self.keys[slot]
            hit = there == key
            flat[todo[hit]] = self.values[slot[hit]]
            on = ~hit & (there >= 0)
            if not on.any():
                break
            todo, key, slot = todo[on], key[on], (slot[on] + 1) & int(self.mask)
        return flat.reshape(out.shape)

    def merged(self, tokens: np.ndarray) -> np.ndarray:
        """Rows of ids padded by -1, fully merged and closed up."""
        out, live = tokens, np.arange(len(tokens))
        work = tokens
        ranks = self.rank(work[:, :-1], work[:, 1:])
        while len(live):
            at = ranks.argmin(axis=1) if ranks.shape[1] else np.zeros(len(live), np.int64)
            best = ranks[np.arange(len(live)), at] if ranks.shape[1] else np.full(len(live), _NONE)
            done = best == _NONE
            if done.any():
                out[live[done], : work.shape[1]] = work[done]
                out[live[done], work.shape[1] :] = -1
                live, work, ranks, at, best = live[~done], work[~done], ranks[~done], at[~done], best[~done]
                if not len(live):
                    break
            row, width = np.arange(len(live)), work.shape[1]
            work[row, at] = best
            shift = np.arange(width - 1)[None, :] > at[:, None]
            work[:, :-1] = np.where(shift, work[:, 1:], work[:, :-1])
            work = work[:, :-1]
            old = ranks
            ranks = np.where(np.arange(width - 2)[None, :] > at[:, None], old[:, 1:], old[:, :-1]) if width > 2 else old[:, :0]
            for side in (at - 1, at):  # only the pairs beside the merger are new
                ok = np.flatnonzero((side >= 0) & (side < width - 2))
                if len(ok):
                    ranks[ok, side[ok]] = self.rank(work[ok, side[ok]], work[ok, side[ok] + 1])
        return out

    def merged_alone(self, ids: np.ndarray) -> np.ndarray:
        """One long row of ids, fully merged.

        In a round the places of the smallest rank merge from the left, each clear
        of the one before, up to the first whose merger makes a pair of smaller rank
        with a neighbour as it stands then: that pair would come next.
        """
        ranks = np.append(self.rank(ids[:-1], ids[1:]), _NONE)
        while (best := ranks.min()) != _NONE:
            at = np.flatnonzero(ranks == best)
            index = np.arange(len(at))
            head = np.ones(len(at), bool)
            head[1:] = np.diff(at) != 1
            at = at[(index - np.maximum.accumulate(np.where(head, index, 0))) % 2 == 0]  # every second place of a run
            before = np.where(at > 0, ids[at - 1], -1).astype(np.int32)
            before[1:][np.diff(at) == 2] = best  # merged just before
            after = np.where(at + 2 < len(ids), ids[np.minimum(at + 2, len(ids) - 1)], -1).astype(np.int32)
            token = np.full(len(at), best, np.int32)
            smaller = np.flatnonzero(np.minimum(self.rank(before, token), self.rank(token, after)) < best)
            if len(smaller):
                at = at[: smaller[0] + 1]
            ids[at] = best
            keep = np.ones(len(ids), bool)
            keep[at + 1] = False
            ids, ranks = ids[keep], ranks[keep]
            new = at - np.arange(len(at))
            for place in (new[new > 0] - 1, new):
                right = place + 1 < len(ids)
                ranks[place[right]] = self.rank(ids[place[right]], ids[place[right] + 1])
                ranks[place[~right]] = _NONE
        return ids

    def encode_pieces(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all pieces in one array, and how many each has."""
        whole = np.array([self.ids.get(p, -1) for p in pieces], np.int64)
        sizes = np.array([len(p) for p in pieces], np.int64)
        counts = np.ones(len(pieces), np.int64)
        rows: list[tuple[np.ndarray, np.ndarray]] = []
        for i in np.flatnonzero((whole < 0) & (sizes > LONG)):
            ids = self.merged_alone(self.byte[np.frombuffer(pieces[i], np.uint8)])
            counts[i] = len(ids)
            rows.append((np.array([i]), ids))
        todo = np.flatnonzero((whole < 0) & (sizes <= LONG))
        todo = todo[np.argsort(sizes[todo], kind="stable")]
        at = 0
        while at < len(todo):
            low = int(sizes[todo[at]])
            end = int(np.searchsorted(sizes[todo], low + low // 8, "right"))
            end = min(end, at + max(1, CELLS // max(low, 1)))
            group = todo[at:end]
            n = sizes[group]
            cells = np.full((len(group), int(n.max())), -1, np.int32)
            data = np.frombuffer(b"".join([pieces[i] for i in group]), np.uint8)
            cells[np.repeat(np.arange(len(group)), n), ranges(np.zeros(len(group), np.int64), n)] = self.byte[data]
            cells = self.merged(cells)
            full = cells >= 0
            counts[group] = full.sum(axis=1)
            rows.append((group, cells[full]))
            at = end
        starts = np.cumsum(counts) - counts
        out = np.empty(int(counts.sum()), np.int32)
        single = np.flatnonzero(whole >= 0)
        out[starts[single]] = whole[single]
        for group, ids in rows:
            out[ranges(starts[group], counts[group])] = ids
        return out, counts

    def decode(self, ids: np.ndarray) -> bytes:
        """Bytes of the ids' tokens, one after another."""
        ids = ids.astype(np.int64)
        return self.data[ranges(self.start[ids], self.length[ids])].tobytes()


class Encoder:
    """Texts to ids; remembers the pieces it has met."""

    def __init__(self, ranks: Ranks, pattern: str):
        self.ranks, self.find = ranks, regex.compile(pattern).findall
        self.clear()

    def clear(self) -> None:
        self.place: dict[str, int] = {}
        self.ids, self.starts, self.counts = np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in one array and offsets of the texts."""
        if len(self.place) > MEMORY:
            self.clear()
        found = [self.find(t) for t in texts]
        place = self.place
        fresh = list({p: None for pieces in found for p in pieces if p not in place})
        if fresh:
            ids, counts = self.ranks.encode_pieces([p.encode() for p in fresh])
            place.update(zip(fresh, range(len(place), len(place) + len(fresh)), strict=True))
            self.starts = np.concatenate((self.starts, len(self.ids) + np.cumsum(counts) - counts))
            self.ids, self.counts = np.concatenate((self.ids, ids)), np.concatenate((self.counts, counts))
        index = np.array([place[p] for pieces in found for p in pieces], np.int64)
        counts = self.counts[index]
        bounds = np.concatenate(([0], np.cumsum([len(p) for p in found]))).astype(np.int64)
        total = np.concatenate(([0], np.cumsum(counts)))
        return self.ids[ranges(self.starts[index], counts)], total[bounds]


@lru_cache(maxsize=2)
def encoder(path: str, pattern: str) -> Encoder:
    with open(path, "rb") as f:  # a vocabulary installed on every machine, not an input table
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return Encoder(Ranks(ranks), pattern)


def encoded(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """``docs(doc_id, text)`` as (doc_id, ids)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = encoder(path, pattern)
        for batch in batches:
            for part in chunks(batch):
                ids, at = code.encode(part.column("text").fill_null("").to_pylist())
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(ids, pa.int32()))], ["doc_id", "ids"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, ids array<int>")


def decoded(tokens: DataFrame, path: str, pattern: str) -> DataFrame:
    """``tokens(doc_id, ids)`` as (doc_id, data): the bytes the ids stand for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranks = encoder(path, pattern).ranks
        for batch in batches:
            lists = batch.column("ids").to_pylist() if batch.column("ids").null_count else [np.asarray(x.values) for x in batch.column("ids")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([ranks.decode(np.asarray(x or [], np.int64) if isinstance(x, list) else x) if x is not None else None for x in lists], pa.binary())], ["doc_id", "data"])

    return tokens.select("doc_id", "ids").mapInArrow(run, "doc_id long, data binary")


def digests(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """``docs(doc_id, text)`` encoded and decoded again: (doc_id, n_tokens, ids_sha256, decoded_sha256)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = encoder(path, pattern)
        for batch in batches:
            for part in chunks(batch):
                ids, at = code.encode(part.column("text").fill_null("").to_pylist())
                decimal = list(map(code.ranks.text.__getitem__, ids.tolist()))
                one = [sha256(b"".join(decimal[i:j])[:-1]).hexdigest() for i, j in zip(at[:-1], at[1:], strict=True)]
                size = np.concatenate(([0], np.cumsum(code.ranks.length[ids])))
                data = code.ranks.decode(ids)
                two = [sha256(data[i:j]).hexdigest() for i, j in zip(size[at[:-1]], size[at[1:]], strict=True)]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(np.diff(at), pa.int64()), pa.array(one, pa.string()), pa.array(two, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text of ``documents`` through byte-level BPE and back."""
    import public_tokenizers

    return digests(table(spark, sf_dir, "documents", "doc_id", "text"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


QUERIES = {"op2_bpe": op2_bpe}
ORACLE = {}
