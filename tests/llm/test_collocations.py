"""Phrases against SQL on documents and plain loops on odd rows."""

import re
from collections import Counter, defaultdict

import duckdb
import pytest

from docketflow.llm import collocations

SF = "/root/testdata/sf0.001"
ODD = [
    ("en", "A b, a b. a B c a b c"), ("en", "a b c\td a b c  d; a b c d"), ("en", None), ("en", ""), (None, "x y x y x y x y"), ("und", "x y z"), ("fr", " \n.;!"),
    ("fr", "é É é É\x0bé É"), ("fr", "a b"), ("fr", "a b"), ("xx", "one"), ("en", "a a a a a a a a"), ("de", "p q r\x0cp q r\rp q r:p q s?p q s"), ("de", "w" * 5000 + " p q " + "w" * 5000),
]


def plain(rows, least, longest, percent, top):
    f, n = defaultdict(Counter), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in range(1, longest + 1):
                f[lang].update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    for lang, counts in f.items():
        found = []
        for p, a in counts.items():
            if len(p) < 2 or a < least:
                continue
            score, _, left, right = min((2000000 * a // (counts[p[:k]] + counts[p[k:]]), k, counts[p[:k]], counts[p[k:]]) for k in range(1, len(p)))
            longer = [c for q, c in counts.items() if c >= least and len(q) > len(p) and any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1))]
            if not any(100 * c >= percent * a for c in longer):
                found.append((-score, -a, " ".join(p).encode(), left, right))
        for rank, (score, a, p, left, right) in enumerate(sorted(found)[:top], 1):
            yield (lang, rank, p.decode(), -a, left, right, n[lang], -score)


@pytest.mark.parametrize("part, most", [(1 << 19, 1_000_000), (3, 0)])
def test_equals_plain_loops(spark, monkeypatch, part, most):
    """With parts of a few words and no broadcast, too."""
    for name, value in (("PART", part), ("HELD", 4 * part), ("MOST_PHRASES", most), ("MOST_WORDS", most)):
        monkeypatch.setattr(collocations, name, value)
    docs = spark.createDataFrame([(*r, "x", 1, b"y") for r in ODD], "lang string, text string, words string, part long, found binary").repartition(3)
    for least, longest, percent, top in ((1, 4, 80, 2000), (2, 4, 80, 3), (2, 3, 50, 2000), (3, 2, 80, 2000)):
        got = sorted(tuple(r) for r in collocations.collocations(docs, least, longest, percent, top).collect())
        assert got == sorted(plain(ODD, least, longest, percent, top))


def test_equals_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{SF}/documents.parquet')")
    want = sorted(con.execute(collocations.ORACLE["op13_collocations"]).fetchall())
    assert want and sorted(tuple(r) for r in collocations.op13_collocations(spark, SF).collect()) == want


def test_counts_past_64_bits(spark):
    """2,000,000 times a count of 2**62 is no long."""
    a = 1 << 62
    phrases = spark.createDataFrame([("en", [1], a), ("en", [2], a + 5), ("en", [1, 2], a - 7)], "lang string, ids array<long>, f long")
    row = collocations.scored(phrases).first()
    assert (row.a, row.l, row.r, row.score) == (a - 7, a, a + 5, 2000000 * (a - 7) // (2 * a + 5))
    assert collocations.not_covered(phrases, collocations.scored(phrases), 80).count() == 1


def test_no_documents(spark):
    for rows in ([], [("en", None)], [("en", "one. word")]):
        assert collocations.collocations(spark.createDataFrame(rows, "lang string, text string"), 1).count() == 0
