"""Each stage of the pipeline on a small table with odd rows, and all of them in turn."""

import hashlib

import corpus_pipeline as pipeline
import pytest
from pyspark.sql import functions as F

from docketflow.llm import mixing

PASSAGE = " ".join(f"shared{i}" for i in range(60))
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, node long, doc long"


def words(name, n=50):
    return " ".join(f"{name}{i}" for i in range(n))


ROWS = [
    (1, words("a"), "en", "s1"), (2, words("a") + " tail", "en", "s1"), (3, words("a"), None, None), (4, words("b", 30) + " " + PASSAGE, "en", "s2"), (5, PASSAGE + " " + words("c", 30), "fr", "s2"),
    (6, None, None, "s1"), (7, "", "en", None), (8, "one", "en", "s1"), (9, words("d"), "en", "s1"), (9, words("e"), "en", "s1"), (9, words("e"), "en", "s1"), (None, words("f"), "en", "s1"),
    (20, PASSAGE, "en", "s3"), (30, "rotten scoundrel " * 20, "en", "s1"), (31, words("g", 30_000), "en", "s1"),
]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("sf"))
    rows = [(i, t, lang, source, len(t or ""), 0.5, 7, 8) for i, t, lang, source in ROWS]
    rows += [(1000 + i, ("rotten scoundrel and villain " if i % 2 else "calm and gentle words ") + words(f"t{i}x", 12), "en", "s1", 0, 0.5, 7, 8) for i in range(120)]
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{path}/documents.parquet")
    labels = [(1000 + i, i % 2) for i in range(120)] + [(5000, None), (None, 1)]
    spark.createDataFrame(labels, "doc_id long, toxic int").write.parquet(f"{path}/labels.parquet")
    return path


@pytest.fixture(scope="module")
def docs(spark, folder):
    return spark.read.parquet(f"{folder}/documents.parquet")


def none(docs):
    return docs.limit(0)


def test_drop_toxic(spark, docs, folder):
    """Toxic documents go; blank ones and clean ones stay, repeated rows as often as they were."""
    calm = F.when((F.col("doc_id") != 30) & (F.length("text") > 3), F.concat(F.lit("calm and gentle words "), "text")).otherwise(F.col("text"))
    mild = docs.where("doc_id < 1000 OR doc_id IS NULL").withColumn("text", F.when(F.col("doc_id").isNull() | (F.col("doc_id") != 30), F.coalesce(calm, "text")).otherwise(F.col("text")))
    out = pipeline.scored(mild.unionByName(docs.where("doc_id >= 1000")), pipeline.train(docs, spark.read.parquet(f"{folder}/labels.parquet")), pipeline.COLUMNS).where("score < 0.5").select(*pipeline.COLUMNS)
    assert pipeline.drop_toxic(spark, docs, folder).columns == pipeline.COLUMNS
    kept = [r.doc_id for r in out.collect()]
    assert out.columns == pipeline.COLUMNS and 30 not in kept and not [i for i in kept if i and i >= 1000 and i % 2]
    assert kept.count(9) == 3 and {1, 2, 3, 4, 5, 6, 7, 8, 20, 31, None} <= set(kept)
    assert pipeline.drop_toxic(spark, none(docs), folder).count() == 0


def test_drop_near_duplicates(spark, docs, folder):
    """One of each group stays; repeated rows once; rows of one id with other texts, null ids and blank texts stay."""
    out = pipeline.drop_near_duplicates(spark, docs.where("doc_id < 1000 OR doc_id IS NULL"), folder)
    kept = sorted((r.doc_id or 0, (r.text or "")[:2]) for r in out.collect())
    assert out.columns == pipeline.COLUMNS
    assert [i for i, _ in kept] == [0, 1, 4, 5, 6, 7, 8, 9, 9, 20, 30, 31] and (9, "d0") in kept and (9, "e0") in kept
    assert pipeline.drop_near_duplicates(spark, none(docs), folder).count() == 0


def test_drop_repeated_passages(spark, docs, folder):
    """Every copy of a shared passage goes, and documents of nothing else; other texts stay as they are."""
    rows = docs.where("doc_id IN (4, 5, 6, 7, 8, 20, 31)")
    out = pipeline.drop_repeated_passages(spark, rows, folder)
    kept = {r.doc_id: (r.text, r.n_chars) for r in out.collect()}
    assert out.columns == pipeline.COLUMNS and set(kept) == {4, 5, 6, 7, 8, 31}
    assert kept[4] == (words("b", 30), len(words("b", 30))) and kept[5][0] == words("c", 30) and kept[6][0] is None and kept[7][0] == ""
    assert pipeline.drop_repeated_passages(spark, none(docs), folder).count() == 0


def test_mix_sources(spark, docs, folder):
    """Each row as often as the operator says, never more than twice; documents without words go, whatever rows share their id."""
    rows = docs.where("doc_id IN (1, 4, 5, 6, 7, 8, 9, 20, 31) OR doc_id IS NULL")
    more = [(500, words("x", 10), "en", "s1", 1), (500, "", "en", "s1", 0), (501, words("y", 90), "en", "s1", 1), (501, None, "en", "s2", 0), (501, words("z", 90), "en", "s2", 1), (502, words("v", 9), "fr", None, 2), (502, words("v", 9), "fr", None, 2)]
    rows = rows.unionByName(spark.createDataFrame(more, rows.select(*pipeline.COLUMNS).schema), allowMissingColumns=True)
    out = pipeline.mix_sources(spark, rows, folder)
    sizes = rows.select("doc_id", "source", "text", mixing.n_words(rows.text).alias("size"))
    want, got = {}, {}
    for r in mixing.mix(sizes, [5, 2, 1], 1.5, 2.0, also=("text",)).collect():
        want[r.doc_id, r.source, r.text] = want.get((r.doc_id, r.source, r.text), 0) + int(r.copies)
    for r in out.collect():
        got[r.doc_id, r.source, r.text] = got.get((r.doc_id, r.source, r.text), 0) + 1
    assert out.columns == pipeline.COLUMNS and got == {k: n for k, n in want.items() if n}
    assert all(k[2] and k[2].strip() for k in got) and max(got.values()) <= 4  # two rows in full share a key
    assert pipeline.mix_sources(spark, none(docs), folder).count() == 0


def test_encode(spark, docs, folder):
    import public_tokenizers
    import tiktoken

    from docketflow.llm import bpe

    ranks = bpe.encoder(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN).ranks
    ref = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks.ids, special_tokens={})
    got = sorted((r.doc_id or 0, r.n_tokens, r.ids) for r in pipeline.encode(spark, docs, folder).collect())
    want = sorted((r.doc_id or 0, len(x), x) for r in docs.collect() for x in [ref.encode_ordinary(r.text or "")])
    assert got == want and pipeline.encode(spark, none(docs), folder).count() == 0


def test_run_twice_gives_the_same(spark, folder):
    digest = lambda: hashlib.sha256(repr(sorted((r.doc_id or 0, r.n_tokens) for r in pipeline.run(spark, folder).select("doc_id", "n_tokens").collect())).encode()).hexdigest()
    assert digest() == digest()
