"""Cross-tokenizer alignment against plain loops over the libraries' own results."""

import hashlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from docketflow.llm import alignment
from docketflow.llm.shared import table

SF = "/root/testdata/sf0.001"
P = public_tokenizers.PATTERN
A, B = (public_tokenizers.path(x) for x in ("byte_bpe_50k.json", "piece_bpe_32k.model"))
ODD = [
    (1, None), (2, ""), (3, " "), (4, "word "), (5, " x  y "), (6, "a▁b c"), (7, "a" * 5000), (8, "日本 語 x"), (9, "é́ ü   z  k\x1c b\x85 m"),
    (10, "<|endoftext|> <s> it's\n\n  ok\t tab"), (11, "​ 　 q"), (12, "😀 😀﻿ x"), (13, "dup one"), (13, "dup one"), (None, "dup one"), (14, "a ́b c\x00d \x00 e"), (15, "\n \n x \r\n y"),
    (16, "ends in space  "), (17, "  begins so"), (18, "ends in ᚠ"), (19, "and　"), (20, "line\n"), (21, " é"), (22, "\ue000 \uffff x"), (23, "▁"), (24, "x ▁ y"), (25, "<0x41> <unk> ▁<s>"),
]


def plain(docs):
    import sentencepiece
    from tokenizers import Tokenizer

    ta = Tokenizer.from_file(A)
    ta.encode_special_tokens = True
    sp = sentencepiece.SentencePieceProcessor(model_file=B)
    stand_in, names = alignment.byte_level(), {i: t for t, i in ta.get_vocab().items()}
    found = []
    for i, text in docs:
        groups = None
        if text:
            a, b = ta.encode(" " + text, add_special_tokens=False).ids, sp.encode(text)
            raw_a = [bytes(stand_in[c] for c in names[x]) for x in a]
            raw_b = [bytes([int(sp.id_to_piece(x)[3:5], 16)]) if sp.is_byte(x) else sp.id_to_piece(x).replace("▁", " ").encode() for x in b]
            if b"".join(raw_a) == b"".join(raw_b) == (" " + text).encode():
                ends_a, ends_b = (np.cumsum([len(x) for x in raw]).tolist() for raw in (raw_a, raw_b))
                groups, at_a, at_b = [], 0, 0
                for end in sorted(set(ends_a) & set(ends_b)):
                    to_a, to_b = ends_a.index(end, at_a) + 1, ends_b.index(end, at_b) + 1
                    groups.append((a[at_a:to_a], b[at_b:to_b]))
                    at_a, at_b = to_a, to_b
        found.append((i, groups))
    count = Counter()
    for _, groups in found:
        count.update({(x, y) for ga, gb in groups or [] for x in ga for y in gb})
    most = Counter()
    for (x, _), c in count.items():
        most[x] = max(most[x], c)
    for i, groups in found:
        links = [(x, y) for ga, gb in groups or [] for x in ga for y in gb]
        text = ";".join(",".join(map(str, ga)) + "|" + ",".join(map(str, gb)) for ga, gb in groups or [])
        sizes = (sum(len(g[k]) for g in groups or []) for k in (0, 1))
        yield (i, *sizes, len(groups or []), len(links), sum(count[x] == most[x[0]] for x in links), sum(count[x] for x in links), hashlib.sha256(text.encode()).hexdigest() if groups is not None else "")


def in_order(rows):
    return sorted((tuple(r) for r in rows), key=lambda r: (r[0] is None, r[0] or 0, r[1:]))


@pytest.mark.parametrize("part, fan", [(alignment.PART, alignment.FAN), (1, 2)])
def test_equals_plain_loops(spark, monkeypatch, part, fan):
    """With small parts and nodes too, where chunks are parts and the tree has levels."""
    monkeypatch.setattr(alignment, "PART", part)
    monkeypatch.setattr(alignment, "FAN", fan)
    docs = spark.createDataFrame([(i, t, 1, b"x") for i, t in ODD], "doc_id long, text string, part long, keys binary").repartition(5)
    assert in_order(alignment.aligned(docs, A, B, P).collect()) == in_order(plain(ODD))


def test_equals_plain_loops_on_documents(spark):
    rows = [tuple(r) for r in table(spark, SF, "documents", "doc_id", "text").collect()]
    got = alignment.op11_alignment(spark, SF)
    assert in_order(got.collect()) == in_order(plain(rows))
    assert got.where("n_links > 0").count() > 0


def test_many_parts_sum_over_the_tree(spark):
    """Counts of nine parts through nodes of two: levels of dense vectors add up, and every key is where its hash says."""
    keys = [np.unique(np.random.default_rng(i).integers(0, 400, 300) * alignment.WIDTH + np.random.default_rng(i).integers(0, 3, 300)) for i in range(9)]
    rows = [(i, bytearray(k.tobytes()), bytearray(np.full(len(k), i + 1).tobytes())) for i, k in enumerate(keys)]
    want = Counter()
    for i, k in enumerate(keys):
        want.update(dict.fromkeys(k.tolist(), i + 1))
    before = alignment.FAN
    try:
        alignment.FAN = 2
        _, known, slots = alignment.pair_counts(spark.createDataFrame(rows, "part long, keys binary, counts binary"))
        found = known.collect()
    finally:
        alignment.FAN = before
    assert slots == 5
    got = {int(k): int(c) for r in found for k, c in zip(np.frombuffer(r.keys, np.int64), np.frombuffer(r.vector, np.int64), strict=True)}
    assert got == want
    best = {int(k) for r in found for k, b in zip(np.frombuffer(r.keys, np.int64), np.frombuffer(r.best, bool), strict=True) if b}
    top = Counter()
    for k, c in want.items():
        top[k // alignment.WIDTH] = max(top[k // alignment.WIDTH], c)
    assert best == {k for k, c in want.items() if c == top[k // alignment.WIDTH]}


def test_perfect_hash():
    keys = np.unique(np.random.default_rng(3).integers(0, 1 << 62, 20_000))
    levels = alignment.perfect_hash(keys)
    assert sorted(alignment.hashed(levels, keys)) == list(range(len(keys)))
    assert sum(map(len, levels)) * 8 < 5 * len(keys)
    strangers = np.setdiff1d(np.arange(5000), keys)
    places = alignment.hashed(levels, strangers)
    stored = np.empty_like(keys)
    stored[alignment.hashed(levels, keys)] = keys
    assert not ((places >= 0) & (stored[places] == strangers)).any()
    assert alignment.perfect_hash(keys[:0]) == [] and len(alignment.hashed([], keys[:3])) == 3


def test_no_documents(spark):
    assert alignment.aligned(spark.createDataFrame([], "doc_id long, text string"), A, B, P).count() == 0
    empty = alignment.aligned(spark.createDataFrame([(1, None), (2, "")], "doc_id long, text string"), A, B, P).orderBy("doc_id")
    assert [tuple(r) for r in empty.collect()] == [(1, 0, 0, 0, 0, 0, 0, ""), (2, 0, 0, 0, 0, 0, 0, "")]


def test_long_text_and_hot_rows(spark):
    """A text of 300,000 letters without a space, and one text in a third of the rows."""
    rows = [(0, "ab9" * 100_000)] + [(i, "the same text over and over") for i in range(1, 60)] + [(i, f"row {i} of others") for i in range(60, 170)]
    got = alignment.aligned(spark.createDataFrame(rows, "doc_id long, text string"), A, B, P).withColumn("hot", F.col("doc_id").between(1, 59)).collect()
    same = [r for r in got if r.hot]
    assert len(got) == 170 and len({tuple(r)[1:] for r in same}) == 1
    assert same[0].count_sum >= 59 * same[0].n_links
    assert in_order(tuple(r)[:8] for r in got if r.doc_id)[:5] == in_order(plain(rows[1:]))[:5]
