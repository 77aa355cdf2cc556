"""Phrases by SETM: sorted occurrence relations, extended a word at a time and counted by joins and groupings.

The occurrence relation is kept in parts of at most about ``PART`` words of one
language, in text order, one row a part: ``words`` holds the number of each word
in the part's own list (-1 between pieces and for words that are not frequent),
``groups`` the phrase of the present length that begins there (-1: none that is
frequent).  Both are sorted by piece and position, so the merge join of a phrase
with the word next to it in its piece reads them side by side.  What a part found
goes out as one row a distinct phrase with its count; phrases that reach the
least count get an id, come back to the parts that hold them, and the occurrences
of others are left out (semi-join) before the next length.

A phrase is known by the id of its first words and the id of its last, so
counts are those of exact strings; within a part, words are told apart by a
64-bit hash.  Ids are unique over languages.

Defined cases: null text is empty; a null language is ``und``; texts without
words give nothing; repeated rows count each; a text of any length is taken
whole, in as many parts as it needs (a part ends between chunks of text, so one
piece is never cut); an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docketflow.llm.shared import _LOWER, CHUNK, buffers, chunks, ranges, removed, table, trim, word_hashes, words, written

#: Words of one language after which a part is closed.
PART = 1 << 18
#: Words of all languages that a task holds before it closes every part.
HELD = 1 << 19
#: Frequent phrases that every task gets at most (24 bytes each), and frequent words (strings).
MOST_PHRASES, MOST_WORDS = 1_000_000, 300_000
_PART = "part long, lang string, n long, strings array<string>, counts array<long>, words binary"
_BREAK = np.zeros(256, bool)
_BREAK[[ord(c) for c in ".,;:!?\n\v\f\r"]] = True
_OUTSIDE = _BREAK.copy()
_OUTSIDE[[9, 32]] = True


def _strings(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> pa.Array:
    """The slices of UTF-8 bytes as a string array."""
    offsets = np.concatenate(([0], np.cumsum(ends - starts)))
    return pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(offsets), pa.py_buffer(data[ranges(starts, ends - starts)]))


class _Open:
    """A part being filled: word hashes in order, where pieces begin, and a string for each hash."""

    def __init__(self):
        self.hashes, self.fresh, self.seen, self.strings, self.n = [], [], [], [], 0

    def add(self, data, starts, ends, hashes, fresh):
        _, first = np.unique(hashes, return_index=True)
        self.hashes.append(hashes)
        self.fresh.append(fresh)
        self.seen.append(hashes[first])
        self.strings.append(_strings(data, starts[first], ends[first]))
        self.n += len(hashes)

    def row(self, part: int, lang: str) -> pa.RecordBatch:
        known, first = np.unique(np.concatenate(self.seen), return_index=True)
        strings = pa.chunked_array(self.strings).take(pa.array(first)).combine_chunks().cast(pa.string())
        at = np.searchsorted(known, np.concatenate(self.hashes))
        fresh = np.concatenate(self.fresh)
        stream = np.full(len(at) + int(fresh.sum()), -1, np.int32)
        stream[np.arange(len(at)) + np.cumsum(fresh)] = at
        values = [part, lang, len(at), strings, np.bincount(at, minlength=len(known)), stream.tobytes()]
        arrays = [pa.array([v], t) for v, t in zip(values[:3], (pa.int64(), pa.string(), pa.int64()), strict=True)]
        for v in (strings, pa.array(values[4], pa.int64())):
            arrays.append(pa.ListArray.from_arrays(pa.array([0, len(v)], pa.int32()), v))
        return pa.RecordBatch.from_arrays([*arrays, pa.array([values[5]], pa.binary())], ["part", "lang", "n", "strings", "counts", "words"])


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    open_parts: dict[str, _Open] = {}
    first, closed = TaskContext.get().partitionId() << 32, 0
    for batch in (c for b in batches for c in chunks(b, size=CHUNK // 4)):
        data, offsets = buffers(batch.column("text"))
        data = _LOWER[data]
        starts, ends, rows = words(data, offsets, _OUTSIDE)
        if not len(starts):
            continue
        hashes = word_hashes(data, starts, ends)
        piece = np.cumsum(_BREAK[data])[starts]
        fresh = np.ones(len(starts), bool)
        fresh[1:] = piece[1:] != piece[:-1]
        fresh[rows[:-1][rows[:-1] < len(starts)]] = True
        langs = batch.column("lang").dictionary_encode()
        names = langs.dictionary.to_pylist()
        lang = np.repeat(langs.indices.to_numpy(zero_copy_only=False), np.diff(rows))
        for i, name in enumerate(names):
            own = lang == i
            if not own.any():
                continue
            part = open_parts.setdefault(name, _Open())
            part.add(data, starts[own], ends[own], hashes[own], fresh[own])
            if part.n >= PART:
                yield open_parts.pop(name).row(first + closed, name)
                closed += 1
        if sum(p.n for p in open_parts.values()) >= HELD:
            for name in list(open_parts):
                yield open_parts.pop(name).row(first + closed, name)
                closed += 1
    for name in list(open_parts):
        yield open_parts.pop(name).row(first + closed, name)
        closed += 1
    trim()


def _ints(batch: pa.RecordBatch, column: str) -> np.ndarray:
    return np.frombuffer(batch.column(column)[0].as_py(), np.int32)


def _longs(batch: pa.RecordBatch, column: str) -> np.ndarray:
    return batch.column(column).flatten().to_numpy(zero_copy_only=False)


def extended(stream: np.ndarray, groups: np.ndarray, k: int, n_words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Merge join of phrases of ``k - 1`` words with the word next to each in its piece.

    Returns the places, the distinct pairs (phrase, word) as phrase * n_words +
    word, the pair of each place and the pairs' counts.  Both inner phrases of
    ``k - 1`` words must be frequent, as those of a frequent one are.
    """
    at = np.flatnonzero(groups[: max(len(groups) - k + 1, 0)] >= 0)
    at = at[stream[at + k - 1] >= 0]
    if k > 2:
        at = at[groups[at + 1] >= 0]
    pairs, own, counts = np.unique(groups[at].astype(np.int64) * n_words + stream[at + k - 1], return_inverse=True, return_counts=True)
    return at, pairs, own, counts


def _pairs(k: int):
    """Rows (part, pair, left, word, c) of the distinct phrases of ``k`` words of each part."""

    def run(batches):
        for row in (b.slice(i, 1) for b in batches for i in range(b.num_rows)):
            stream, ids, groups, left = _relation(row)
            _, pairs, _, counts = extended(stream, groups, k, max(len(ids), 1))
            part = row.column("part")[0].as_py()
            for i in range(0, len(pairs), 1 << 15):
                p = pairs[i : i + (1 << 15)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(p), part)), pa.array(np.arange(i, i + len(p), dtype=np.int32)), pa.array(left[p // len(ids)]), pa.array(ids[p % len(ids)]), pa.array(counts[i : i + len(p)])],
                    ["part", "pair", "left", "word", "c"],
                )
        trim()

    return run


def _state(part, lang, stream, word_ids, groups, group_ids) -> pa.RecordBatch:
    lists = [pa.ListArray.from_arrays(pa.array([0, len(v)], pa.int32()), pa.array(v, pa.int64())) for v in (word_ids, group_ids)]
    return pa.RecordBatch.from_arrays(
        [pa.array([part], pa.int64()), pa.array([lang], pa.string()), pa.array([stream.astype(np.int32).tobytes()]), lists[0], pa.array([None if groups is None else groups.astype(np.int32).tobytes()], pa.binary()), lists[1]],
        ["part", "lang", "words", "word_ids", "groups", "group_ids"],
    )


def _relation(row: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The words of a part with their ids and the phrases that begin there with theirs; of one word, those are the words."""
    stream, ids = _ints(row, "words"), _longs(row, "word_ids")
    if row.column("groups")[0].as_py() is None:
        return stream, ids, stream, ids
    return stream, ids, _ints(row, "groups"), _longs(row, "group_ids")


_STATE = "part long, lang string, words binary, word_ids array<long>, groups binary, group_ids array<long>"


def _kept(found: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The ids among ``found`` (-1: none), and for each entry the place of its id there (-1)."""
    there = found >= 0
    return found[there], np.where(there, np.cumsum(there) - 1, -1).astype(np.int32)


def _joined_ids(row: pa.RecordBatch, size: int) -> np.ndarray:
    """The ids that a join brought to a part's words or pairs; -1 for those it brought none."""
    found = row.column("found").flatten()
    ids = np.full(size, -1, np.int64)
    ids[found.field("pair").to_numpy()] = found.field("id").to_numpy()
    return ids


class _Words:
    """The frequent words of each language with their ids."""

    def __init__(self, rows: pa.Table):
        self.of = {}
        langs = rows.column("lang").combine_chunks().dictionary_encode()
        for i, lang in enumerate(langs.dictionary.to_pylist()):
            own = rows.filter(pc.equal(langs.indices, i))
            self.of[lang] = (own.column("word").combine_chunks(), own.column("id").to_numpy())

    def ids(self, row: pa.RecordBatch, size: int) -> np.ndarray:
        words, ids = self.of.get(row.column("lang")[0].as_py(), (pa.array([], pa.string()), np.zeros(0, np.int64)))
        at = pc.fill_null(pc.index_in(row.column("strings").flatten(), words), -1).to_numpy()
        return np.where(at >= 0, ids[at], -1) if len(ids) else np.full(size, -1, np.int64)


class _Phrases:
    """The frequent pairs (phrase, word) with their ids, as sorted arrays."""

    def __init__(self, rows: pa.Table):
        left, word = rows.column("left").to_numpy(), rows.column("word").to_numpy()
        self.lefts, self.words = np.unique(left), np.unique(word)
        keys = np.searchsorted(self.lefts, left) * len(self.words) + np.searchsorted(self.words, word)
        order = np.argsort(keys)
        self.keys, self.ids_of = keys[order], rows.column("id").to_numpy()[order]

    def ids(self, left: np.ndarray, word: np.ndarray) -> np.ndarray:
        if not len(self.keys):
            return np.full(len(left), -1, np.int64)
        a, b = (np.minimum(np.searchsorted(have, asked), len(have) - 1) for have, asked in ((self.lefts, left), (self.words, word)))
        keys = a * len(self.words) + b
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where((self.lefts[a] == left) & (self.words[b] == word) & (self.keys[at] == keys), self.ids_of[at], -1)


def _kept_words(shared=None):
    """The relation of one word: frequent words alone.  ``shared``: those words; without it, the rows bring the ids a join found."""

    def run(batches):
        for row in (b.slice(i, 1) for b in batches for i in range(b.num_rows)):
            stream, size = _ints(row, "words"), row.column("size")[0].as_py()
            ids, place = _kept(shared.value.ids(row, size) if shared else _joined_ids(row, size))
            stream = np.where(stream >= 0, place[np.maximum(stream, 0)], -1) if len(place) else stream
            yield _state(row.column("part")[0].as_py(), row.column("lang")[0].as_py(), stream, ids, None, ids[:0])
        trim()

    return run


def _kept_groups(k: int, shared=None):
    """The relation of ``k`` words: the occurrences of frequent phrases alone, and only the places they cover."""

    def run(batches):
        for row in (b.slice(i, 1) for b in batches for i in range(b.num_rows)):
            stream, word_ids, before, left = _relation(row)
            at, pairs, own, _ = extended(stream, before, k, max(len(word_ids), 1))
            n = max(len(word_ids), 1)
            ids, place = _kept(shared.value.ids(left[pairs // n], word_ids[pairs % n]) if shared else _joined_ids(row, len(pairs)))
            groups = np.full(len(stream), -1, np.int32)
            groups[at] = place[own]
            steps = np.zeros(len(stream) + 1, np.int32)
            begins = np.flatnonzero(groups >= 0)
            np.add.at(steps, begins, 1)
            np.add.at(steps, begins + k, -1)
            covered = np.cumsum(steps[:-1]) > 0
            # One place that is not covered stays before each stretch, as the break.
            stays = covered.copy()
            stays[:-1] |= covered[1:]
            yield _state(row.column("part")[0].as_py(), row.column("lang")[0].as_py(), np.where(covered, stream, -1)[stays], word_ids, groups[stays], ids)
        trim()

    return run


def _semi_joined(state: DataFrame, frequent: DataFrame, listed: DataFrame, on: list[str], most: int, kept, lookup) -> DataFrame:
    """``state`` without what is not ``frequent``: these are looked up in each part while they are few, else joined with ``listed`` and brought to the parts."""
    if frequent.limit(most + 1).count() <= most:
        shared = state.sparkSession.sparkContext.broadcast(lookup(frequent.select(*on, "id").toArrow()))
        return state.mapInArrow(kept(shared), _STATE)
    found = listed.join(frequent.select(*on, "id").hint("merge"), on).groupBy("part").agg(F.collect_list(F.struct("pair", "id")).alias("found"))
    return state.drop("strings").hint("merge").join(found, "part").mapInArrow(kept(None), _STATE)


def occurrences(docs: DataFrame) -> DataFrame:
    """``docs(lang, text)`` as parts of the occurrence relation."""
    docs = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), "text")
    return written(docs.mapInArrow(_parts, _PART), "occurrences")


def frequent_phrases(parts: DataFrame, least: int, longest: int) -> DataFrame:
    """(lang, ids, f) of all phrases of 1 to ``longest`` words that occur ``least`` times in a language, the words' (id, word), and (lang, n).

    ``ids`` are those of the phrase's words.  ``parts`` and each relation are removed once the next one stands.
    """
    listed = parts.select("part", "lang", F.posexplode(F.arrays_zip("strings", "counts")).alias("pair", "s")).select("part", "lang", "pair", F.col("s.strings").alias("word"), F.col("s.counts").alias("c"))
    first = listed.groupBy("lang", "word").agg(F.sum("c").alias("f")).where(F.col("f") >= least)
    first = written(first.withColumn("id", F.monotonically_increasing_id()), "words")
    totals = written(parts.groupBy("lang").agg(F.sum("n").alias("n")), "totals")
    sized = parts.select("part", "lang", "strings", "words", F.size("strings").alias("size"))
    state = written(_semi_joined(sized, first, listed, ["lang", "word"], MOST_WORDS, _kept_words, _Words), "relation-1")
    removed(parts)
    known = first.select("id", "lang", F.array("id").alias("ids"), "f")
    tables = [known]
    for k in range(2, longest + 1):
        pairs = state.mapInArrow(_pairs(k), "part long, pair int, left long, word long, c long")
        counts = pairs.groupBy("left", "word").agg(F.sum("c").alias("f")).where(F.col("f") >= least)
        counts = written(counts.withColumn("id", F.monotonically_increasing_id()), f"phrases-{k}")
        if k < longest:
            before = state
            state = written(_semi_joined(state, counts, pairs, ["left", "word"], MOST_PHRASES, lambda shared, k=k: _kept_groups(k, shared), _Phrases), f"relation-{k}")
            removed(before)
        # Ids of words are known by the last word, so the whole phrase follows from its beginning.
        begin = known.select(F.col("id").alias("left"), "lang", "ids")
        known = written(counts.join(begin.hint("merge"), "left").select("id", "lang", F.concat("ids", F.array("word")).alias("ids"), "f"), f"known-{k}")
        tables.append(known)
    every = tables[0].select("lang", "ids", "f")
    for t in tables[1:]:
        every = every.union(t.select("lang", "ids", "f"))
    removed(state)
    return every, first.select("id", "word"), totals


def scored(phrases: DataFrame) -> DataFrame:
    """(lang, ids, a, l, r, score) of the phrases of two words or more, by the cut that scores lowest."""
    of = phrases.where(F.size("ids") > 1).select("lang", "ids", F.col("f").alias("a"), F.explode(F.sequence(F.lit(1), F.size("ids") - 1)).alias("k"))
    of = of.withColumn("head", F.slice("ids", 1, F.col("k"))).withColumn("rest", F.slice("ids", F.col("k") + 1, F.size("ids") - F.col("k")))
    of = of.join(phrases.select(F.col("ids").alias("head"), F.col("f").alias("l")).hint("merge"), "head")
    of = of.join(phrases.select(F.col("ids").alias("rest"), F.col("f").alias("r")).hint("merge"), "rest")
    score = F.expr("CAST(CAST(a AS DECIMAL(28,0)) * 2000000 DIV (CAST(l AS DECIMAL(28,0)) + r) AS BIGINT)")
    cut = F.min(F.struct(score.alias("score"), "k", "l", "r"))
    return of.groupBy("lang", "ids", "a").agg(cut.alias("cut")).select("lang", "ids", "a", "cut.l", "cut.r", "cut.score")


def not_covered(phrases: DataFrame, candidates: DataFrame, percent: int) -> DataFrame:
    """``candidates`` without those inside a longer phrase that has ``percent`` % of their count or more."""
    longer = phrases.where(F.size("ids") > 2).select("ids", F.col("f").alias("most"))
    longer = longer.withColumn("n", F.explode(F.sequence(F.lit(2), F.size("ids") - 1)))
    inner = longer.select("most", "ids", "n", F.explode(F.sequence(F.lit(1), F.size("ids") - F.col("n") + 1)).alias("i")).select("most", F.slice("ids", F.col("i"), F.col("n")).alias("ids"))
    inner = inner.groupBy("ids").agg(F.max("most").alias("most"))
    fits = F.col("most").cast("decimal(28,0)") * 100 >= F.col("a").cast("decimal(28,0)") * percent
    return candidates.join(inner.hint("merge"), "ids", "left").where(F.coalesce(~fits, F.lit(True))).drop("most")


def collocations(docs: DataFrame, least: int = 30, longest: int = 4, percent: int = 80, top: int = 2000) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score) of each language's ``top`` phrases of ``docs(lang, text)``."""
    parts = occurrences(docs)
    phrases, spelt, totals = frequent_phrases(parts, least, longest)
    best = written(not_covered(phrases, scored(phrases), percent), "scored")
    placed = best.select("ids", F.posexplode("ids").alias("place", "id")).join(spelt.hint("merge"), "id")
    texts = placed.groupBy("ids").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "word"))), lambda x: x["word"]), " ").alias("phrase"))
    named = best.join(texts.hint("merge"), "ids")
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = named.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return ranked.join(totals.hint("merge"), "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 2000 best phrases of 2 to 4 words of each language of ``documents``."""
    return collocations(table(spark, sf_dir, "documents", "lang", "text"))


QUERIES = {"op13_collocations": op13_collocations}
ORACLE = {
    "op13_collocations": r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, row_number() OVER () AS d,
         unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\n\x0B\f\r]')) AS piece
  FROM documents
), worded AS (
  SELECT lang, list_filter(string_split_regex(piece, '[ \t]+'), lambda w: w <> '') AS ws FROM pieces
), grams AS (
  SELECT lang, unnest(flatten(list_transform(range(1, 5), lambda k: list_transform(range(1, len(ws) - k + 2), lambda i: ws[i:i + k - 1])))) AS ws FROM worded WHERE len(ws) > 0
), f AS (
  SELECT lang, ws, count(*) AS f FROM grams GROUP BY lang, ws HAVING count(*) >= 30
), n AS (
  SELECT lang, CAST(sum(len(ws)) AS BIGINT) AS n FROM worded GROUP BY lang
), cuts AS (
  SELECT lang, ws, f AS a, unnest(range(1, len(ws))) AS k FROM f WHERE len(ws) > 1
), cut AS (
  SELECT c.lang, c.ws, c.a, c.k, x.f AS l, y.f AS r, CAST(CAST(c.a AS HUGEINT) * 2000000 // (x.f + y.f) AS BIGINT) AS score
  FROM cuts c JOIN f x ON x.lang = c.lang AND x.ws = c.ws[1:c.k] JOIN f y ON y.lang = c.lang AND y.ws = c.ws[c.k + 1:len(c.ws)]
), best AS (
  SELECT * FROM cut QUALIFY row_number() OVER (PARTITION BY lang, ws ORDER BY score, k) = 1
), inner_of AS (
  SELECT lang, f, unnest(flatten(list_transform(range(2, len(ws)), lambda m: list_transform(range(1, len(ws) - m + 2), lambda i: ws[i:i + m - 1])))) AS ws FROM f WHERE len(ws) > 2
), covered AS (
  SELECT lang, ws, max(f) AS most FROM inner_of GROUP BY lang, ws
), kept AS (
  SELECT b.lang, array_to_string(b.ws, ' ') AS phrase, b.a, b.l, b.r, b.score
  FROM best b LEFT JOIN covered c ON c.lang = b.lang AND c.ws = b.ws WHERE c.most IS NULL OR 100 * c.most < 80 * b.a
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept
)
SELECT r.lang, r.rank, r.phrase, r.a, r.l, r.r, n.n, r.score FROM ranked r JOIN n ON n.lang = r.lang WHERE r.rank <= 2000
""",
}
