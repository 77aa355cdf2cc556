"""Mixing sources to target weights by Pareto order sampling.

A source's target is its weighted share of the words wanted; what exceeds a
source's cap goes to the others by weight.  Within a source every document has
a number of copies to expect, ``rate * lean`` with the mean over words at
target / size; its whole copies are certain and the fraction left is its
inclusion probability ``p``, unequal where leans are unequal.  Documents are
ranked by random odds over inclusion odds, ``(u / (1-u)) / (p / (1-p))``
(Pareto order sampling), and the smallest ranks are taken up to the size the
source still lacks.  The size is one of words, as a target is.

Defined cases: null text has size 0; a document of size 0 is never taken; null
is a source of its own (last); equal random numbers (repeated rows) are told
ordered by doc_id and size; a source without words has target 0;
an empty table gives no rows; clashing extra columns are dropped by the query.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docketflow.llm.shared import table, written

#: Rows of a table of sources that are broadcast at most.
MOST_SOURCES = 20_000
#: Slices of a source's order; the exact cut is sought in one of them.
SLICES = 1 << 14
#: The lean of a document by its size: log2(1 + words), held to this range.
LEAN_LOW, LEAN_HIGH = 4, 12


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit("[^\\x20\\x09-\\x0D]+")), F.lit(0)).cast("long")


def uniform(doc_id: Column, seed: int) -> Column:
    """A number in (0, 1) from an id and a seed, the same in every run and in SQL elsewhere."""
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), doc_id.cast("string")).cast("binary"))
    return (F.conv(F.substring(digest, 1, 12), 16, 10).cast("double") + 0.5) / F.lit(float(1 << 48))


def source_targets(sizes: DataFrame, weights: list[float], share: float, cap: float) -> DataFrame:
    """(source, source_size, target) of ``sizes(source, source_size)``, one row for each source.

    Sources by code point, null last, take ``weights`` in turn.  Together they
    get ``share`` of all words, none more than ``cap`` times its own.  The level
    L at which targets are min(cap * size, L * weight) is found from the order
    in which sources meet their caps: windows over one row a source.
    """
    place = F.row_number().over(Window.orderBy(F.asc_nulls_last("source"))) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (place % len(weights) + 1).cast("int"))
    s = sizes.withColumn("weight", weight).withColumn("most", F.col("source_size") * F.lit(float(cap)))
    every = Window.partitionBy()
    order = Window.orderBy(F.col("most") / F.col("weight"), F.asc_nulls_last("source"))
    s = s.withColumn("total", F.sum("source_size").over(every) * F.lit(float(share)))
    s = s.withColumn("capped", F.coalesce(F.sum("most").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
    s = s.withColumn("level", (F.col("total") - F.col("capped")) / F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing)))
    s = s.withColumn("place", F.row_number().over(order))
    s = s.withColumn("level", F.min_by("level", F.when(F.col("level") * F.col("weight") <= F.col("most"), F.col("place"))).over(every))
    return s.select("source", "source_size", F.coalesce(F.least("most", F.col("level") * F.col("weight")), "most").alias("target"))


def copy_rates(strata: DataFrame, targets: DataFrame, cap: float) -> DataFrame:
    """``targets`` with the rate at which min(cap, rate * lean) copies of every word make the target.

    ``strata(source, lean, words)``: strata meet the cap from the largest lean on,
    so each stratum in turn is tried as the first below it.
    """
    known = strata.join(targets.withColumnRenamed("source", "s").hint("shuffle_hash"), F.col("source").eqNullSafe(F.col("s"))).drop("s")
    down = Window.partitionBy("source").orderBy(F.desc("lean"))
    above = F.coalesce(F.sum("words").over(down.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    open_words = F.sum(F.col("words") * F.col("lean")).over(down.rowsBetween(0, Window.unboundedFollowing))
    known = known.withColumn("rate", (F.col("target") - above * F.lit(float(cap))) / F.nullif(open_words, F.lit(0.0)))
    valid = F.when(F.col("rate") * F.col("lean") <= cap, F.col("lean"))
    rate = F.coalesce(F.max_by("rate", valid), F.lit(cap / LEAN_LOW))
    return known.groupBy("source").agg(F.first("source_size").alias("source_size"), F.first("target").alias("target"), rate.alias("rate"))


def with_source(rows: DataFrame, by_source: DataFrame) -> DataFrame:
    """``rows`` with the columns of a table of one row a source: broadcast while it is small, else merged with skew split."""
    other = by_source.withColumn("_key", F.coalesce("source", F.lit(""))).withColumn("_null", F.col("source").isNull()).drop("source")
    rows = rows.withColumn("_key", F.coalesce("source", F.lit(""))).withColumn("_null", F.col("source").isNull())
    few = by_source.limit(MOST_SOURCES + 1).count() <= MOST_SOURCES
    return rows.join(F.broadcast(other) if few else other.hint("merge"), ["_key", "_null"], "left").drop("_key", "_null")


def mix(docs: DataFrame, weights: list[float], share: float = 1.0, cap: float = 2.0, seed: int = 1, also: tuple[str, ...] = ()) -> DataFrame:
    """``docs(doc_id, source, size)`` as (doc_id, source, size, source_size, target, copies, taken), and the columns ``also``.

    ``taken`` counts words, repeats included.  The order inside a source is cut
    by slices of the rank: the sums of SLICES slices a source are added up, and
    only the slice of the cut is sorted, so a source that holds most rows is
    never in one task.
    """
    lean = F.least(F.greatest(F.floor(F.log2(F.lit(1.0) + F.col("size"))), F.lit(LEAN_LOW)), F.lit(LEAN_HIGH)).cast("double")
    docs = written(docs.select("doc_id", "source", "size", *also, lean.alias("lean")), "sized")
    strata = written(docs.groupBy("source", "lean").agg(F.sum("size").alias("words")), "strata")
    targets = source_targets(strata.groupBy("source").agg(F.sum("words").alias("source_size")), weights, share, cap)
    rates = written(copy_rates(strata, targets, cap), "rates")

    rated = with_source(docs, rates)
    rated = rated.withColumn("expected", F.least(F.lit(float(cap)), F.col("rate") * F.col("lean")))
    rated = rated.withColumn("certain", F.floor("expected")).withColumn("p", F.col("expected") - F.col("certain"))
    rated = rated.withColumn("u", uniform(F.col("doc_id"), seed))
    odds = (F.col("u") / (1 - F.col("u"))) / F.nullif(F.col("p") / (1 - F.col("p")), F.lit(0.0))
    # odds / (1 + odds) keeps the order and lies between 0 and 1; none where nothing is left to chance.
    rated = rated.withColumn("rank", F.when(F.col("size") > 0, odds / (1 + odds)))
    rated = rated.withColumn("slice", F.floor(F.col("rank") * SLICES)).drop("expected", "lean", "rate", "u", "p")
    rated = written(rated, "rated")

    sums = written(rated.groupBy("source", "slice").agg(F.sum("size").alias("words"), F.sum(F.col("size") * F.col("certain")).alias("sure"), F.first("target").alias("target")), "slices")
    of = Window.partitionBy("source")
    lack = F.col("target") - F.sum("sure").over(of)
    before = F.coalesce(F.sum(F.when(F.col("slice").isNotNull(), F.col("words"))).over(of.orderBy(F.asc_nulls_first("slice")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sums = sums.withColumn("lack", lack).withColumn("before", before).where("slice IS NOT NULL AND before <= lack")
    # The last slice that begins below what the source lacks holds the cut.
    cuts = written(sums.groupBy("source").agg(F.max("slice").alias("cut"), (F.first("lack") - F.max("before")).alias("left")), "cuts")

    rated = with_source(rated, cuts)
    inside = rated.where("slice = cut")
    order = Window.partitionBy("source").orderBy("rank", "doc_id", "size", *also).rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum("size").over(order), F.lit(0))
    inside = inside.withColumn("more", (before + F.col("size") / 2 <= F.col("left")).cast("long"))
    outside = rated.where("NOT (slice <=> cut) OR slice IS NULL").withColumn("more", F.coalesce((F.col("slice") < F.col("cut")).cast("long"), F.lit(0)))
    copies = F.when(F.col("size") > 0, F.col("certain") + F.col("more")).otherwise(F.lit(0))
    return inside.union(outside).withColumn("copies", copies).select(
        "doc_id", "source", "size", *also, "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken")
    )


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All ``documents`` mixed: sources weigh 5, 2, 1 in turn and share 150 % of the words, at most twice their own."""
    docs = table(spark, sf_dir, "documents", "doc_id", "source", "text")
    mixed = mix(docs.select("doc_id", "source", n_words(F.col("text")).alias("size")), [5, 2, 1], share=1.5, cap=2.0)
    return mixed.select("doc_id", "size", "source_size", "target", "taken", "copies")


QUERIES = {"op1_mixing": op1_mixing}
ORACLE = {}
