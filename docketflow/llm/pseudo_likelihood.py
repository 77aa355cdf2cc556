"""LM scoring by masked pseudo-likelihood of a bidirectional window network.

All words of the corpus (A-Z folded, known by a 64-bit hash) are counted in a
Spark table.  The most frequent ones, more of them the more words there are,
are classes of their own, the others share ``TAIL`` classes by hash.  A network
sees the ``WINDOW`` classes on each side of a place but not the one in it, and
gives a distribution over the classes in two steps, over groups of classes
that are neighbours by frequency and over the classes of a group, so that its
cost grows with the square root of the classes; a word has its share of its class's
count: log P(word) = log P(group) + log P(class | group) + log(n(word) / n(class)).  It is trained
in rounds over the whole corpus, each word being a target once: of R rounds,
round r predicts the places r, r + R, ... of every text.  Every partition
follows its own texts from the round's weights and Spark averages the
partitions' weights by the words they have predicted.  A document's score is the sum of the log probabilities of
all its words, each predicted from both sides.

Defined cases: null text, empty text and text without words have 0 words and a
score and mean of 0; places beyond the ends of a text are a class of their
own; a corpus without words leaves the first weights; repeated rows count as
often as they occur; extra columns are ignored; a null doc_id is kept.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docketflow.llm.shared import CHUNK, buffers, chunks, table, word_hashes, words, written

#: Words that are their own class at least, and classes of the others.
HEAD, TAIL = 192, 63
CLASSES = HEAD + TAIL + 1  # at least; the last one is the edge of a text
#: Counted words that workers hold at most; those of the others come by a join.
KNOWN = 1 << 18
WINDOW, EMBED, HIDDEN = 3, 16, 32
#: Rounds over the corpus, which share its places as targets.
ROUNDS, BATCH, RATE = 2, 1024, 0.01
#: Floats of a row in which weights travel.
SLICE = 1024


def head_size(vocabulary: int) -> int:
    """Words that are their own class, of a vocabulary: 192 up to 0.9 million words, 2,000 at a thousand million."""
    return max(HEAD, int(2 * np.cbrt(vocabulary)))


def group_size(classes: int) -> int:
    """Classes of a group; the last group may have places that no class fills."""
    return int(np.ceil(np.sqrt(classes)))


def _shapes(classes: int) -> dict[str, tuple[int, ...]]:
    size = group_size(classes)
    groups = -(-classes // size)
    return {
        "embed": (classes, EMBED), "inner": (2 * WINDOW * EMBED, HIDDEN), "bias": (HIDDEN,),
        "top": (HIDDEN, groups), "lead": (groups,), "outer": (groups, HIDDEN, size), "prior": (groups, size),
    }


def hashed(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every word of every row (A-Z folded), and each row's first word."""
    data, offsets = buffers(texts)
    starts, ends, first = words(data, offsets)
    return word_hashes(data, starts, ends, lower=True).view(np.int64), first


def counted(docs: DataFrame) -> DataFrame:
    """(word, n): every word of the whole corpus by its hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, size=4 * CHUNK):
                word, n = np.unique(hashed(part.column("text"))[0], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(word), pa.array(n)], ["word", "n"])

    return docs.select("text").mapInArrow(run, "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))


class Lexicon:
    """Classes of words and, of the most frequent ones, their log share of their class."""

    def __init__(self, word: np.ndarray, n: np.ndarray, tails: np.ndarray, vocabulary: int):
        """``word`` and ``n``: the most frequent words; ``tails``: words of the whole corpus by hash modulo ``TAIL``."""
        best = np.lexsort((word, -n))[: head_size(vocabulary)]
        self.head, self.classes = len(best), head_size(vocabulary) + TAIL + 1
        self.tails = tails - np.bincount(word[best] % TAIL, n[best], TAIL).astype(np.int64)
        kind = self.classes - 1 - TAIL + word % TAIL
        kind[best] = np.arange(len(best))
        share = np.zeros(len(word))
        shared = kind >= self.classes - 1 - TAIL
        share[shared] = np.log(n[shared] / self.tails[word[shared] % TAIL])
        self.least = int(n.min()) if len(n) else None  # rarer words are not held
        order = np.argsort(word)
        self.word, self.share = word[order], share[order]
        order = np.argsort(word[best])
        self.own, self.rank = word[best][order], order

    def kinds(self, word: np.ndarray) -> np.ndarray:
        """The class of each word."""
        out = self.classes - 1 - TAIL + word % TAIL
        if len(self.own):
            at = np.minimum(np.searchsorted(self.own, word), len(self.own) - 1)
            found = self.own[at] == word
            out[found] = self.rank[at[found]]
        return out

    def shares(self, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The log share of each word in its class (0 if not held), and whether it is held."""
        if not len(self.word):
            return np.zeros(len(word)), np.zeros(len(word), bool)
        at = np.minimum(np.searchsorted(self.word, word), len(self.word) - 1)
        found = self.word[at] == word
        return np.where(found, self.share[at], 0.0), found


def lexicon(counts: DataFrame, known: int) -> Lexicon:
    """The classes of ``counts(word, n)``; at most ``known`` words, the most frequent, are held one by one."""
    sizes = np.array([(r["n"], r["words"]) for r in counts.groupBy("n").agg(F.count("*").alias("words")).collect()], np.int64).reshape(-1, 2)  # a row for each count that occurs
    sizes = sizes[np.argsort(-sizes[:, 0])]
    fits = sizes[np.cumsum(sizes[:, 1]) <= known, 0]
    held = counts.where(F.col("n") >= int(fits[-1])).toArrow() if len(fits) else pa.table({"word": pa.array([], pa.int64()), "n": pa.array([], pa.int64())})
    tails = np.zeros(TAIL, np.int64)
    for r in counts.groupBy(F.pmod("word", F.lit(TAIL)).alias("t")).agg(F.sum("n").alias("n")).collect():
        tails[r["t"]] = r["n"]
    return Lexicon(held.column("word").to_numpy().copy(), held.column("n").to_numpy().copy(), tails, int(sizes[:, 1].sum()))


def contexts(kind: np.ndarray, first: np.ndarray, edge: int = CLASSES - 1) -> np.ndarray:
    """The classes around every word, one row each; those outside its text are the edge."""
    n = len(kind)
    padded = np.concatenate((np.full(WINDOW, edge), kind, np.full(WINDOW, edge)))
    begin = np.repeat(first[:-1], np.diff(first))
    end = np.repeat(first[1:], np.diff(first))
    at = np.arange(n)
    sides = [d for d in range(-WINDOW, WINDOW + 1) if d]
    return np.stack([np.where((at + d >= begin) & (at + d < end), padded[WINDOW + d : WINDOW + d + n], edge) for d in sides], axis=1)


def targets(first: np.ndarray, turn: int, rounds: int) -> np.ndarray:
    """Places that round ``turn`` predicts: each place of a text belongs to one round."""
    place = np.arange(first[-1]) - np.repeat(first[:-1], np.diff(first))
    return np.flatnonzero(place % rounds == turn)


def fresh(classes: int = CLASSES) -> dict[str, np.ndarray]:
    rng = np.random.default_rng(11)
    return {k: (rng.standard_normal(s) * (0.1 if len(s) > 1 else 0)).astype(np.float32) for k, s in _shapes(classes).items()}


def _wide(outer: np.ndarray, prior: np.ndarray) -> bool:
    """Whether logits may leave +-40 (h is within +-1)."""
    return bool((np.abs(outer).sum(axis=-2) + np.abs(prior)).max() > 40)


def _logits(h: np.ndarray, outer: np.ndarray, prior: np.ndarray, wide: bool) -> np.ndarray:
    """Logits that ``exp`` can take."""
    logits = h @ outer
    logits += prior
    if wide:
        logits -= logits.max(axis=1, keepdims=True)
    return logits


def by_group(kind: np.ndarray, size: int) -> tuple[np.ndarray, list[tuple[int, int, int]]]:
    """An order of places by the group of their class, and (group, begin, end) of those that occur."""
    group = (kind // size).astype(np.uint16)
    order = np.argsort(group, kind="stable")
    cuts = np.concatenate((np.flatnonzero(np.diff(group[order], prepend=-1)), [len(kind)])).tolist()
    return order, [(int(group[order[i]]), i, j) for i, j in zip(cuts[:-1], cuts[1:], strict=True)]


def log_probabilities(w: dict[str, np.ndarray], around: np.ndarray, kind: np.ndarray) -> np.ndarray:
    out = np.zeros(len(kind))
    size = group_size(len(w["embed"]))
    sides = [w["embed"] @ w["inner"][i : i + EMBED] for i in range(0, len(w["inner"]), EMBED)]
    top, outer = _wide(w["top"], w["lead"]), _wide(w["outer"], w["prior"])
    for at in range(0, len(kind), 4096):
        order, runs = by_group(kind[at : at + 4096], size)
        part, own, n = around[at : at + 4096][order], kind[at : at + 4096][order], len(order)
        h = np.tanh(sum((t[part[:, d]] for d, t in enumerate(sides)), w["bias"]))
        logits = _logits(h, w["top"], w["lead"], top)
        found = logits[np.arange(n), own // size] - np.log(np.exp(logits, out=logits).sum(axis=1))
        for g, i, j in runs:
            logits = _logits(h[i:j], w["outer"][g], w["prior"][g], outer)
            found[i:j] += logits[np.arange(j - i), own[i:j] - g * size] - np.log(np.exp(logits, out=logits).sum(axis=1))
        out[at + order] = found
    return out


def _error(h: np.ndarray, outer: np.ndarray, prior: np.ndarray, wide: bool, own: np.ndarray, n: int) -> np.ndarray:
    """Slope of the loss of ``n`` places in the logits of some of them: probability less truth."""
    d = _logits(h, outer, prior, wide)
    np.exp(d, out=d)
    d *= (1 / n) / d.sum(axis=1, keepdims=True)
    d[np.arange(len(own)), own] -= 1 / n
    return d


class Trainer:
    """Adam steps from given weights."""

    def __init__(self, w: dict[str, np.ndarray]):
        self.w = {k: v.copy() for k, v in w.items()}
        self.m = {k: np.zeros_like(v) for k, v in w.items()}
        self.v = {k: np.zeros_like(v) for k, v in w.items()}
        self.t = 0

    def step(self, around: np.ndarray, kind: np.ndarray) -> None:
        w, n, self.t = self.w, len(kind), self.t + 1
        size = group_size(len(w["embed"]))
        order, runs = by_group(kind, size)
        around, kind = around[order], kind[order]
        x = w["embed"].take(around, axis=0).reshape(n, -1)
        h = np.tanh(x @ w["inner"] + w["bias"])
        d = _error(h, w["top"], w["lead"], _wide(w["top"], w["lead"]), kind // size, n)
        dh = d @ w["top"].T
        grad = {"top": h.T @ d, "lead": d.sum(axis=0), "outer": np.zeros_like(w["outer"]), "prior": np.zeros_like(w["prior"])}
        wide = _wide(w["outer"], w["prior"])
        for g, i, j in runs:
            d = _error(h[i:j], w["outer"][g], w["prior"][g], wide, kind[i:j] - g * size, n)
            dh[i:j] += d @ w["outer"][g].T
            grad["outer"][g], grad["prior"][g] = h[i:j].T @ d, d.sum(axis=0)
        dh *= 1 - h * h
        grad |= {"inner": x.T @ dh, "bias": dh.sum(axis=0)}
        dx = (dh @ w["inner"].T).reshape(-1, EMBED)
        flat = around.ravel().astype(np.uint16)
        order = np.argsort(flat, kind="stable")
        begin = np.flatnonzero(np.diff(flat[order], prepend=-1))
        embed = np.zeros_like(w["embed"])
        embed[flat[order[begin]]] = np.add.reduceat(dx.take(order, axis=0), begin, axis=0)
        grad["embed"] = embed
        scale = float(RATE * np.sqrt(1 - 0.99**self.t) / (1 - 0.9**self.t))
        for k, g in grad.items():
            self.m[k] += 0.1 * (g - self.m[k])
            self.v[k] += 0.01 * (g * g - self.v[k])
            w[k] -= (scale * self.m[k] / (np.sqrt(self.v[k]) + 1e-6)).astype(np.float32)


def _flat(w: dict[str, np.ndarray]) -> np.ndarray:
    return np.concatenate([w[k].ravel() for k in _shapes(1)])


def _shaped(flat: np.ndarray, classes: int) -> dict[str, np.ndarray]:
    out, at = {}, 0
    for k, s in _shapes(classes).items():
        n = int(np.prod(s))
        out[k], at = flat[at : at + n].reshape(s).astype(np.float32), at + n
    return out


def averaged(docs: DataFrame, shared, weights, turn: int, rounds: int) -> dict[str, np.ndarray] | None:
    """One of the rounds: weights trained in every partition, averaged by the words predicted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trainer, seen, lex = Trainer(weights.value), 0, shared.value
        rng = np.random.default_rng([turn, TaskContext.get().partitionId()])
        for batch in batches:
            for part in chunks(batch):
                word, first = hashed(part.column("text"))
                kind = lex.kinds(word)
                around = contexts(kind, first, lex.classes - 1)
                at = rng.permutation(targets(first, turn, rounds))
                for i in range(0, len(at), BATCH):
                    trainer.step(around[at[i : i + BATCH]], kind[at[i : i + BATCH]])
                seen += len(at)
        if seen:
            flat = _flat(trainer.w).astype(np.float64) * seen
            parts = [flat[i : i + SLICE] for i in range(0, len(flat), SLICE)]
            yield pa.RecordBatch.from_arrays([pa.array(range(len(parts)), pa.int32()), pa.array([seen] * len(parts), pa.int64()), pa.array(parts, pa.list_(pa.float64()))], ["i", "n", "w"])

    rows = docs.select("text").mapInArrow(run, "i int, n long, w array<double>")
    place = rows.select("i", "n", F.posexplode("w").alias("j", "x"))
    sums = place.groupBy("i", "j").agg((F.sum("x") / F.sum("n")).alias("x"))
    found = sums.groupBy("i").agg(F.array_sort(F.collect_list(F.struct("j", "x"))).alias("x")).orderBy("i").collect()  # one network
    return _shaped(np.array([s["x"] for r in found for s in r["x"]]), len(weights.value["embed"])) if found else None


def scored(docs: DataFrame, rounds: int = ROUNDS, known: int = KNOWN) -> DataFrame:
    """``docs(doc_id, text)`` as (doc_id, n_words, log_likelihood, mean), under a network trained on them."""
    context = docs.sparkSession.sparkContext
    counts = written(counted(docs), "counts")
    lex = lexicon(counts, known)
    shared = context.broadcast(lex)  # ``known`` words at most
    weights = fresh(lex.classes)
    for turn in range(rounds):
        weights = averaged(docs, shared, context.broadcast(weights), turn, rounds) or weights
    final = context.broadcast(weights)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lex, row = shared.value, TaskContext.get().partitionId() << 40
        for batch in batches:
            for part in chunks(batch, size=1 << 20):
                word, first = hashed(part.column("text"))
                kind = lex.kinds(word)
                share, held = lex.shares(word)
                own = log_probabilities(final.value, contexts(kind, first, lex.classes - 1), kind) + share
                total = np.concatenate(([0.0], np.cumsum(own)))
                missing = np.concatenate(([0], np.cumsum(~held)))[first].astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.arange(row, row + part.num_rows)), part.column("doc_id"), pa.array(np.diff(first), pa.int64()), pa.array(total[first[1:]] - total[first[:-1]]), pa.ListArray.from_arrays(pa.array(missing), pa.array(word[~held]))],
                    ["row", "doc_id", "n_words", "score", "rare"],
                )
                row += part.num_rows

    found = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "row long, doc_id long, n_words long, score double, rare array<long>")
    found = written(found, "scores")
    of = F.array(*[F.lit(int(n)) for n in lex.tails])[F.pmod("word", F.lit(TAIL)).cast("int")]
    unheld = counts.where(F.col("n") < lex.least) if lex.least else counts
    shares = unheld.select("word", F.log(F.col("n") / of).alias("share"))
    rare = found.select("row", F.explode("rare").alias("word")).join(shares.hint("merge"), "word").groupBy("row").agg(F.sum("share").alias("share"))
    score = F.col("score") + F.coalesce("share", F.lit(0.0))
    return found.drop("rare").join(rare.hint("merge"), "row", "left").select("doc_id", "n_words", score.alias("log_likelihood"), (score / F.greatest("n_words", F.lit(1))).alias("mean"))


def op8_pseudo_likelihood(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole text of ``documents`` scored by a network trained on all of them."""
    return scored(table(spark, sf_dir, "documents", "doc_id", "text"))


QUERIES = {"op8_pseudo_likelihood": op8_pseudo_likelihood}
ORACLE = {}
