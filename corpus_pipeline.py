"""A training corpus from ``documents``: five stages, each on all the one before it kept.

Defined cases, of every stage: an empty table gives none; null and empty texts
are clean, no copies of anything and have no passages, and go in the mix, which
takes documents with words alone; a null id, language or source is a value like
others, and a null id is nobody's copy; rows repeated in full, texts of words
among them, are one from the near-duplicate stage on, rows of one id with different texts
are documents of their own; columns beyond those of documents are dropped, so
none can clash; texts of any length are taken whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docketflow.llm.bpe import encoded
from docketflow.llm.mixing import mix, n_words
from docketflow.llm.near_dup import row_components
from docketflow.llm.shared import distinct_ids, numbered, written
from docketflow.llm.substring_dedup import remove_repeats
from docketflow.llm.toxicity import scored, train

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: Ids of rejected documents that are broadcast at most (8 MB).
MOST_REJECTED = 1_000_000
#: Words of a passage that may not repeat.
PASSAGE = 35


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, trained on all of ``labels``, scores under 0.5."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic")
    docs = docs.select(*COLUMNS)
    return scored(docs, train(docs, labels), COLUMNS).where("score < 0.5").drop("score")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of smallest id of each group linked by 5-word shingles and a similarity of 0.8; repeated rows once."""
    docs = docs.select(*COLUMNS)
    unique = distinct_ids(docs)
    docs = numbered(docs, unique)
    found = row_components(docs, k=5, percent=80).where("component IS NOT NULL")
    if not unique:  # the smallest id, and of its rows the first
        found = written(found, "components")
        first = found.groupBy("component").agg(F.min(F.struct("doc_id", "doc")).alias("first"))
        found = found.join(first.hint("merge"), "component").select("doc", F.col("first.doc").alias("component"))
    rejected = written(found.where("doc <> component").select("doc"), "rejected")
    few = rejected.limit(MOST_REJECTED + 1).count() <= MOST_REJECTED
    return docs.join(F.broadcast(rejected) if few else rejected.hint("merge"), "doc", "left_anti").select(*COLUMNS)


def drop_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages that also stand elsewhere; untouched texts stay as they are, emptied documents go."""
    docs = numbered(docs.select(*COLUMNS))
    cut = written(remove_repeats(docs, PASSAGE).where("n_removed > 0").select("doc", "kept_text"), "cut")
    rows = docs.join(cut.hint("merge"), "doc", "left").where("kept_text IS NULL OR kept_text <> ''")
    rows = rows.withColumn("n_chars", F.when(F.col("kept_text").isNotNull(), F.char_length("kept_text").cast("long")).otherwise(F.col("n_chars")))
    return rows.withColumn("text", F.coalesce("kept_text", "text")).select(*COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them: sources weigh 5, 2, 1 in turn, no document more than twice."""
    docs = numbered(docs.select(*COLUMNS))
    mixed = mix(docs.select("doc_id", "doc", "source", n_words(F.col("text")).alias("size")), [5, 2, 1], share=1.5, cap=2.0, also=("doc",))
    taken = written(mixed.where("copies > 0").select("doc", F.col("copies").cast("int").alias("copies")), "taken")
    rows = docs.join(taken.hint("merge"), "doc")
    return rows.select(*COLUMNS, F.explode(F.sequence(F.lit(1), "copies"))).select(*COLUMNS)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids) of every row."""
    import public_tokenizers

    ids = encoded(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
    return ids.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids")


STAGES = [
    ("toxicity", drop_toxic),
    ("near_dedup", drop_near_duplicates),
    ("substring_dedup", drop_repeated_passages),
    ("mixing", mix_sources),
    ("bpe", encode),
]

#: A fitted classifier, hashed sketches and byte merges are beyond SQL; tests/llm has the brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
