"""SpotSigs fingerprints, by DataFrame functions alone.

A signature is a common word (an anchor) with the next ``CHAIN`` content
words after it, common words left out; a chain looks ``AHEAD`` words ahead and
an anchor without ``CHAIN`` content words there gives none.  The set of a text's signature hashes
is its fingerprint; likeness is the Jaccard similarity of two sets.

Defined cases: null text is an empty text; a text without an anchor takes all
runs of ``CHAIN`` words instead, a shorter one all its words; a text without
words has an empty fingerprint, like another empty one by 1 and any other by 0;
null doc_ids sort last; rows with one doc_id follow each other in text
order; a single document is its own next; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docketflow.llm.shared import table, written

# The anchors.
COMMON = (
    "a an and are as at be but by for from had has have he her his in is it not of on or she that the they this to was were with you "
    "der die das den dem des ein eine einer und ist im mit von zu auf für nicht sich "
    "le la les un une des du de et est en que qui dans pour sur au aux par "
    "el los las una y es por con para del al se lo su"
).split()
CHAIN, AHEAD = 2, 8
#: Rows of bucket heads that are broadcast at most.
MOST_HEADS = 100_000
#: Buckets (of at most 2**9 ids each) that a task takes in large tables.
BUCKETS_A_TASK = 64
_SHIFT = 9


def signatures(text: Column) -> Column:
    """The sorted distinct signature hashes of a text, array<long>."""
    words = F.filter(F.split(F.lower(text), "[^\\p{L}\\p{N}]+"), lambda w: w != "")

    def chain(all_words: Column) -> Column:
        def one(w: Column, i: Column) -> Column:
            after = F.slice(F.filter(F.slice(all_words, i + 2, AHEAD), lambda x: ~x.isin(COMMON)), 1, CHAIN)
            return F.when(w.isin(COMMON) & (F.size(after) == CHAIN), F.xxhash64(w, after))

        return F.array_compact(F.transform(all_words, one))

    def runs(all_words: Column) -> Column:
        n = F.greatest(F.size(all_words) - CHAIN + 1, F.least(F.size(all_words), F.lit(1)))
        return F.transform(F.slice(all_words, 1, n), lambda w, i: F.xxhash64(F.slice(all_words, i + 1, CHAIN)))

    # Bound once each, so that neither the split nor the chains are worked out again.
    bound = F.transform(F.array(words), lambda ws: F.transform(F.array(chain(ws)), lambda s: F.when(F.size(s) > 0, s).otherwise(runs(ws)))[0])[0]
    return F.array_sort(F.array_distinct(bound))


def likeness(a: Column, b: Column) -> Column:
    shared = F.size(F.array_intersect(a, b))
    union = F.size(a) + F.size(b) - shared
    return F.when((F.size(a) == 0) & (F.size(b) == 0), F.lit(1.0)).otherwise(shared / F.greatest(union, F.lit(1)))


def printed(signature: Column) -> Column:
    return F.array_join(F.transform(signature, lambda s: F.hex(s)), ",")


def next_above(keys: DataFrame) -> DataFrame:
    """(key, above): of distinct long keys the next larger one; null for the largest.

    Windows run over groups of at most 2**9 neighbouring keys; the gaps between
    groups are the same question for the groups' own numbers.
    """
    if keys.limit(10_001).count() <= 10_000:
        return keys.select("key", F.lead("key").over(Window.orderBy("key")).alias("above"))
    group = F.shiftright("key", _SHIFT)
    near = keys.select("key", group.alias("g"), F.lead("key").over(Window.partitionBy(group).orderBy("key")).alias("near"))
    least = written(near.groupBy("g").agg(F.min("key").alias("least")), "groups")
    jumps = next_above(least.select(F.col("g").alias("key")))
    targets = jumps.join(least.select(F.col("g").alias("above"), "least").hint("merge"), "above").select(F.col("key").alias("g"), "least")
    return near.join(targets.hint("merge"), "g", "left").select("key", F.coalesce("near", "least").alias("above"))


def with_next(docs: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """``docs(doc_id, text)`` with ``columns`` of its text and, as next_<name>, those of the next row by descending doc_id.

    Rows stand in buckets of at most 2**9 ids; the first row of each bucket also
    closes the bucket before it, so one exchange of the texts is enough and no
    window holds more than a bucket.
    """
    key = F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63)).cast("long"))
    docs = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), key.alias("key"), F.shiftright(key, _SHIFT).alias("bucket"), F.lit(0).alias("copy"))
    heads = written(docs.groupBy("bucket").agg(F.max("key").alias("key")), "heads")
    above = written(next_above(heads.select(F.col("bucket").alias("key"))), "above").select(F.col("key").alias("bucket"), "above")
    lowest = heads.agg(F.min("bucket").alias("lowest"))
    targets = above.crossJoin(F.broadcast(lowest))  # one row
    targets = heads.join(targets.hint("merge"), "bucket").select("key", F.coalesce("above", "lowest").alias("target"))
    targets = written(targets, "targets")
    few = targets.limit(MOST_HEADS + 1).count() <= MOST_HEADS
    ends = docs.join(F.broadcast(targets) if few else targets.hint("merge"), "key").select("doc_id", "text", "key", F.col("target").alias("bucket"), F.lit(1).alias("copy"))
    spark = docs.sparkSession
    parts = heads.count() // BUCKETS_A_TASK
    rows = docs.union(ends)
    rows = rows.repartition(parts, "bucket") if parts > int(spark.conf.get("spark.sql.shuffle.partitions")) else rows.repartition("bucket")
    for name, column in columns.items():
        rows = rows.withColumn(name, column)
    order = Window.partitionBy("bucket").orderBy("copy", F.desc("key"), "text")
    return rows.select("*", *[F.lead(name).over(order).alias(f"next_{name}") for name in ("text", *columns)]).where("copy = 0").drop("key", "bucket", "copy")


def near_pairs(prints: DataFrame, percent: int = 80) -> DataFrame:
    """(a, b) of the distinct fingerprints of ``prints(doc_id, signature)`` whose Jaccard similarity reaches ``percent`` %.

    Equal fingerprints are one row, that of their smallest doc_id.  Sets are
    partitioned by length, in classes that each span the ratio the similarity
    allows, so that a set meets its own class and the next alone.  In them each set is
    listed under the rarest of its signatures (as many as a set this like it
    must share one of), and what meets is compared in full.
    """
    sets = written(prints.where(F.size("signature") > 0).groupBy("signature").agg(F.min("doc_id").alias("doc_id")).select("doc_id", "signature", F.size("signature").alias("n")), "sets")
    parts = sets.select("doc_id", "n", F.explode("signature").alias("s"))
    counts = written(parts.groupBy("s").agg(F.count("*").alias("c")).where("c > 1"), "counts")
    listed = parts.join(counts.hint("merge"), "s").groupBy("doc_id", "n").agg(F.array_sort(F.collect_list(F.struct("c", "s"))).alias("rare"), F.count("*").alias("known"))
    # Signatures of one set alone come first in the order, and match nothing.
    must = F.col("n") - F.ceil(F.col("n") * percent / 100) + 1 - (F.col("n") - F.col("known"))
    short = written(listed.where(must > 0).select("doc_id", "n", F.explode(F.slice("rare", 1, must.cast("int")))).select("doc_id", "n", "col.s"), "prefixes")
    part = F.floor(F.log("n") / F.log(F.lit(100 / percent)))
    a = short.select("s", F.col("doc_id").alias("x"), F.col("n").alias("n_x"), F.explode(F.array(part, part + 1)).alias("part"))
    b = short.select("s", F.col("doc_id").alias("y"), F.col("n").alias("n_y"), part.alias("part"))
    fits = ((F.col("n_x") < F.col("n_y")) | ((F.col("n_x") == F.col("n_y")) & (F.col("x") < F.col("y")))) & (100 * F.col("n_x") >= percent * F.col("n_y"))
    met = a.hint("merge").join(b.hint("merge"), ["s", "part"]).where(fits)
    pairs = written(met.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), "pairs")
    left, right = (sets.select(F.col("doc_id").alias(x), F.col("signature").alias(f"s_{x}")) for x in "ab")
    return pairs.join(left.hint("merge"), "a").join(right.hint("merge"), "b").where(100 * likeness(F.col("s_a"), F.col("s_b")) >= percent).select("a", "b")


def op10_spotsigs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of ``documents``, of each with its second half replaced by the next one's first, and their likeness."""
    rows = with_next(table(spark, sf_dir, "documents", "doc_id", "text"), {"signature": signatures(F.col("text"))})
    n = F.char_length("text")
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), n - half), F.substring("next_text", F.lit(1), half))
    rows = rows.select("doc_id", n.cast("long").alias("n_chars"), edited.alias("edited"), "signature", "next_signature")
    rows = rows.withColumn("edited_signature", signatures(F.col("edited")))
    return rows.select(
        "doc_id", "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        printed(F.col("signature")).alias("fingerprint"), printed(F.col("edited_signature")).alias("edited_fingerprint"),
        likeness(F.col("signature"), F.col("edited_signature")).alias("near_edited"), likeness(F.col("signature"), F.col("next_signature")).alias("near_next"),
    )


QUERIES = {"op10_spotsigs": op10_spotsigs}
ORACLE = {}
