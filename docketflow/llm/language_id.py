"""Language identification by cross-parsing with suffix automata.

For each language a suffix automaton of labelled text recognises all its
substrings.  A text is cut greedily into the longest phrases the automaton
knows; the language that needs the fewest, each weighed by the logarithm of
its training length, wins.  Texts are parsed in segments of ``SEGMENT``
letters, side by side in numpy lanes and over all languages at a time; a
segment's end ends a phrase.  Texts are lower-cased, each run of other
characters than letters is one space.  No letter is left out: a language of few
letters has a table of steps, one of many has hashed steps.

Defined cases: null text, empty text and text without a letter give ``und``
with score 0; ties go to the smaller language by code point; a null language
teaches nothing; without training rows every text is ``und``; repeated rows
give repeated answers; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docketflow.llm.shared import bucket_of, chunks, mix, ranges, table

#: Labelled rows of a language that are learned at most: whole texts, and no further one once they have so many characters.
ROWS_EACH, LETTERS_EACH = 100, 40_000
#: Letters of a segment, and distinct letters up to which a language has a table.
SEGMENT, TABLED = 1024, 94


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    return np.array([chr(i).isalpha() for i in range(0x110000)])


def normal(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all texts, one space for each run of non-letters, and row offsets."""
    lowered = [t.lower() for t in texts]
    code = np.frombuffer("".join(lowered).encode("utf-32-le", "surrogatepass"), np.uint32)
    offsets = np.concatenate(([0], np.cumsum([len(t) for t in lowered]))).astype(np.int64)
    letter = _letters()[code]
    keep = letter.copy()
    keep[1:] |= letter[:-1]  # the first character of a run of non-letters stands for it
    first = offsets[:-1][offsets[:-1] < len(code)]
    keep[first] = letter[first]
    total = np.concatenate(([0], np.cumsum(keep)))
    return np.where(letter, code, 32)[keep], total[offsets]


def automaton(word: np.ndarray) -> list[dict[int, int]]:
    """Transitions of the suffix automaton of ``word``; state 0 is the start."""
    step, link, length, last = [{}], [-1], [0], 0
    for c in word.tolist():
        new = len(step)
        step.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and c not in step[p]:
            step[p][c] = new
            p = link[p]
        if p >= 0:
            q = step[p][c]
            if length[p] + 1 == length[q]:
                link[new] = q
            else:
                twin = len(step)
                step.append(dict(step[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                while p >= 0 and step[p].get(c) == q:
                    step[p][c] = twin
                    p = link[p]
                link[q] = link[new] = twin
        last = new
    return step


class Tabled:
    """Steps of languages of few letters: a row of next states for each state, all languages in one array."""

    def __init__(self, words: list[np.ndarray], letters: list[np.ndarray], points: np.ndarray):
        width = max((len(x) for x in letters), default=0) + 1
        self.kind = np.zeros((len(words), len(points) + 1), np.uint8)  # 0: a letter that the language does not know
        tables, self.start, at = [], [], 0
        for i, (word, own) in enumerate(zip(words, letters, strict=True)):
            self.kind[i, np.searchsorted(points, own)] = np.arange(1, len(own) + 1)
            step = automaton(np.searchsorted(own, word) + 1)
            grid = np.full((len(step) + 1, width), -1, np.int64)  # the last row: between phrases
            rows = np.repeat(np.arange(len(step)), [len(t) for t in step])
            grid[rows, [c for t in step for c in t]] = [n for t in step for n in t.values()]
            restart = np.where(grid[0] >= 0, grid[0], len(step))  # an unknown letter is a phrase of its own
            # A step is twice the next state's place in the whole table, and 1 if a phrase begins with it.
            tables.append(np.where(grid >= 0, 2 * (grid * width + at), 2 * (restart[None, :] * width + at) + 1).astype(np.int64).ravel())
            self.start.append(at + len(step) * width)
            at += (len(step) + 1) * width
        self.table = np.concatenate(tables) if tables else np.zeros(0, np.int64)
        if len(self.table) < 1 << 30:
            self.table = self.table.astype(np.int32)

    def prepare(self, index: np.ndarray) -> np.ndarray:
        return self.kind[:, index]

    def moved(self, state: np.ndarray, code: np.ndarray) -> np.ndarray:
        return self.table[state + code]


class Hashed:
    """Steps of languages of any number of letters: (state, letter) to the next state, by open addressing."""

    def __init__(self, words: list[np.ndarray], points: np.ndarray):
        keys, values, self.root, self.start, at = [], [], [], [], 0
        for word in words:
            step = automaton(np.searchsorted(points, word))
            keys.append(np.array([((s + at) << 21) | c for s, t in enumerate(step) for c in t], np.int64))
            values.append(np.array([n + at for t in step for n in t.values()], np.int64))
            self.root.append(at)
            self.start.append(at + len(step))  # between phrases: a state without steps
            at += len(step) + 1
        keys, values = np.concatenate(keys), np.concatenate(values)
        self.mask = (1 << int(np.ceil(np.log2(len(keys) * 3)))) - 1
        self.keys, self.values = np.full(self.mask + 1, -1, np.int64), np.zeros(self.mask + 1, np.int64)
        slot = self._slot(keys)
        while len(keys):
            free = np.flatnonzero(self.keys[slot] < 0)
            won = free[np.unique(slot[free], return_index=True)[1]]
            self.keys[slot[won]], self.values[slot[won]] = keys[won], values[won]
            rest = np.ones(len(keys), bool)
            rest[won] = False
            keys, values, slot = keys[rest], values[rest], (slot[rest] + 1) & self.mask

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return (mix(keys.view(np.uint64)) & np.uint64(self.mask)).astype(np.int64)

    def _next(self, state: np.ndarray, code: np.ndarray) -> np.ndarray:
        """The next state, -1 where there is none."""
        key = (state << 21) | code
        out, todo, slot = np.full(len(key), -1, np.int64), np.arange(len(key)), self._slot(key)
        while len(todo):
            there = self.keys[slot]
            hit = there == key[todo]
            out[todo[hit]] = self.values[slot[hit]]
            on = ~hit & (there >= 0)
            todo, slot = todo[on], (slot[on] + 1) & self.mask
        return out

    def prepare(self, index: np.ndarray) -> np.ndarray:
        return np.broadcast_to(index, (len(self.root), len(index)))

    def moved(self, state: np.ndarray, code: np.ndarray) -> np.ndarray:
        found = self._next(state.ravel().astype(np.int64), code.ravel().astype(np.int64)).reshape(state.shape)
        root, start = (np.broadcast_to(np.array(x)[:, None], state.shape) for x in (self.root, self.start))
        lost = found < 0
        again = self._next(root[lost], code[lost].astype(np.int64))
        found[lost] = np.where(again >= 0, again, start[lost])  # an unknown letter is a phrase of its own
        return 2 * found + lost


class Parser:
    """Phrase counts of texts in every language; built from (language, code points) in order."""

    def __init__(self, samples: tuple[tuple[str, bytes], ...], tabled: int = TABLED):
        self.names = [name for name, _ in samples]
        words = [np.frombuffer(raw, np.uint32) for _, raw in samples]
        points = np.unique(np.concatenate(words))
        self.place = np.full(0x110000, len(points), np.int32)  # the last place: a letter that no language knows
        self.place[points] = np.arange(len(points))
        letters = [np.unique(w) for w in words]
        few = [i for i, x in enumerate(letters) if len(x) <= tabled]
        many = [i for i, x in enumerate(letters) if len(x) > tabled]
        self.parts = []
        if few:
            self.parts.append((few, Tabled([words[i] for i in few], [letters[i] for i in few], points)))
        if many:
            self.parts.append((many, Hashed([words[i] for i in many], points)))
        self.weight = np.array([np.log2(len(w) + 2) for w in words])

    def costs(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Weighed phrases of each text in each language, a letter; and which texts have letters."""
        code, offsets = normal(texts)
        index = self.place[code]
        n = np.diff(offsets)
        pieces = -(-n // SEGMENT)
        owner = np.repeat(np.arange(len(n)), pieces)
        start = offsets[:-1][owner] + SEGMENT * (ranges(np.zeros(len(n), np.int64), pieces))
        size = np.minimum(SEGMENT, offsets[1:][owner] - start)
        order = np.argsort(-size, kind="stable")
        start, size, owner = start[order], size[order], owner[order]
        active = np.searchsorted(-size, -np.arange(int(size.max(initial=0))), "left").tolist()
        phrases = np.zeros((len(n), len(self.names)))
        for which, steps in self.parts:
            letter = steps.prepare(index)
            state = np.repeat(np.array(steps.start, np.int64)[:, None], len(start), axis=1)
            ends = np.zeros((len(which), len(start)), np.int32)
            for t, m in enumerate(active):
                move = steps.moved(state[:, :m], letter[:, start[:m] + t])
                ends[:, :m] += (move & 1).astype(np.int32)
                state[:, :m] = move >> 1
            for i, e in zip(which, ends, strict=True):
                phrases[:, i] = np.bincount(owner, e, len(n))
        some = np.concatenate(([0], np.cumsum(code != 32)))
        return phrases * self.weight / np.maximum(n, 1)[:, None], some[offsets[1:]] > some[offsets[:-1]]


@lru_cache(maxsize=1)
def parser(samples: tuple[tuple[str, bytes], ...]) -> Parser:
    return Parser(samples)


def learn(docs: DataFrame, rows_each: int = ROWS_EACH, letters_each: int = LETTERS_EACH) -> tuple[tuple[str, bytes], ...]:
    """The labelled sample of each language of ``docs(doc_id, text, lang)``: whole texts of the rows with the smallest hashes.

    ``rows_each`` rows at most, each text once, and none after ``letters_each`` characters are reached.
    """
    rows = docs.where("lang IS NOT NULL AND text IS NOT NULL").select("lang", "text", F.xxhash64("text").alias("h"))
    firsts = rows.select("lang", "h", F.char_length("text").alias("n")).groupBy("lang", "h").agg(F.max("n").alias("n"))
    order = Window.partitionBy("lang").orderBy("h")
    chosen = firsts.withColumn("k", F.row_number().over(order)).where(F.col("k") <= rows_each)
    before = F.coalesce(F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    chosen = chosen.withColumn("before", before).where(F.col("before") < letters_each).select("lang", "h", "k")
    some = rows.join(F.broadcast(chosen), ["lang", "h"]).groupBy("lang", "k").agg(F.min("text").alias("text"))  # rows_each rows a language
    by: dict[str, list[tuple[int, str]]] = {}
    for row in some.toLocalIterator():
        by.setdefault(row["lang"], []).append((row["k"], row["text"]))
    samples = []
    for name in sorted(by, key=lambda x: x.encode()):
        word = normal([" ".join(t for _, t in sorted(by[name]))])[0]
        if (word != 32).any():
            samples.append((name, word.astype(np.uint32).tobytes()))
    return tuple(samples)


def identified(docs: DataFrame, samples: tuple[tuple[str, bytes], ...]) -> DataFrame:
    """``docs(doc_id, text)`` as (doc_id, lang_pred, score); score is the second cost over the sum of the two least."""
    shared = docs.sparkSession.sparkContext.broadcast(samples)  # rows_each texts a language at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch):
                texts = part.column("text").fill_null("").to_pylist()
                names, score = ["und"] * len(texts), np.zeros(len(texts))
                if shared.value:
                    model = parser(shared.value)
                    cost, ok = model.costs(texts)
                    best = cost.argmin(axis=1)
                    names = [model.names[b] if k else "und" for b, k in zip(best, ok, strict=True)]
                    two = np.sort(cost, axis=1)[:, :2]
                    share = two[:, 1] / np.maximum(two.sum(axis=1), 1e-12) if two.shape[1] > 1 else np.ones(len(texts))
                    score = np.where(ok, share, 0.0)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(names, pa.string()), pa.array(score)], ["doc_id", "lang_pred", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, lang_pred string, score double")


def op9_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every whole text of ``documents``; rows whose crc32(doc_id) mod 4 is 2 teach nothing."""
    docs = table(spark, sf_dir, "documents", "doc_id", "text", "lang")
    found = identified(docs, learn(docs.where(bucket_of("doc_id", 4) != 2)))
    return found.select("doc_id", F.coalesce(bucket_of("doc_id", 4) == 2, F.lit(False)).alias("held_out"), "lang_pred", "score")


QUERIES = {"op9_language": op9_language}
ORACLE = {}
