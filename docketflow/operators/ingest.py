"""Incremental ingest: fingerprints, anti-joins, upserts and forward-only stamps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def fingerprint(*parts: Column) -> Column:
    """sha1 of the parts joined by '|', null as ''."""
    return F.sha1(F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]))


def entry_fingerprint(description: Column, short: Column, filed: Column, docs: Column) -> Column:
    """``fingerprint`` of an entry and of its ``docs`` (description, is_available, is_sealed, text) in their order (null: none)."""
    said = lambda c: F.when(F.coalesce(c, F.lit(False)), "True").otherwise("False")
    parts = lambda d: F.array(F.coalesce(d["description"], F.lit("")), said(d["is_available"]), said(d["is_sealed"]), F.when(d["text"].rlike(r"(?U)\S"), "1").otherwise("0"))
    own = F.array(*[F.coalesce(c.cast("string"), F.lit("")) for c in (description, short, filed)])
    return F.sha1(F.array_join(F.concat(own, F.flatten(F.transform(F.coalesce(docs, F.array()), parts))), "|"))


def unseen(feed: DataFrame, seen: DataFrame, *keys: str) -> DataFrame:
    """Rows of the feed whose keys (fingerprint among them) are not in ``seen``."""
    return feed.join(seen.select(*keys), [*keys], "left_anti")


def changed(incoming: DataFrame, stored: DataFrame, key: str, stamp: str) -> DataFrame:
    """Rows whose stamp is missing on either side or newer than the stored one."""
    kept = stored.select(key, F.col(stamp).alias("stored"))
    return incoming.join(kept, key, "left").where(F.col("stored").isNull() | F.col(stamp).isNull() | (F.col(stamp) > F.col("stored"))).drop("stored")


def upsert(stored: DataFrame, incoming: DataFrame, keys: list[str], overwrite: list[str], sticky: list[str]) -> DataFrame:
    """Next snapshot: ``overwrite`` columns from the incoming row where there is one, ``sticky`` ones only where it is not null."""
    new = incoming.select(*keys, F.lit(True).alias("_new"), *[F.col(c).alias(f"new_{c}") for c in overwrite + sticky])
    both = stored.select(*keys, *overwrite, *sticky).join(new, keys, "full_outer")
    columns = [F.when(F.col("_new"), F.col(f"new_{c}")).otherwise(F.col(c)).alias(c) for c in overwrite]
    return both.select(*keys, *columns, *[F.coalesce(f"new_{c}", c).alias(c) for c in sticky])


def bumped(stored: DataFrame, incoming: DataFrame, key: str, stamp: str) -> DataFrame:
    """Stamps that never move back: the largest of both sides."""
    return stored.select(key, stamp).unionByName(incoming.select(key, stamp)).groupBy(key).agg(F.max(stamp).alias(stamp))


def normalized_tags(tags: DataFrame) -> DataFrame:
    """``tags(case_id, pos, tag)``: trimmed, without blanks, the first of each spelling, as one ordered list a case."""
    clean = tags.withColumn("tag", F.regexp_replace("tag", r"^\s+|\s+$", "")).where("tag <> ''")
    first = Window.partitionBy("case_id", F.lower("tag")).orderBy("pos")
    one = clean.withColumn("r", F.row_number().over(first)).where("r = 1")
    return one.groupBy("case_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "tag"))), lambda s: s["tag"]), ",").alias("tags"))


def violations(extra: DataFrame, case_dockets: DataFrame) -> DataFrame:
    """Extra documents with a missing field or a docket that is not the case's, one row for each reason."""
    known = case_dockets.select("case_id", "docket_id", F.lit(True).alias("known")).distinct()
    checks = F.array(
        F.when(F.coalesce("url", F.lit("")) == "", F.lit("url")),
        F.when(F.trim(F.coalesce("note", F.lit(""))) == "", F.lit("note")),
        F.when(F.col("known").isNull(), F.lit("docket")),
    )
    return extra.join(known, ["case_id", "docket_id"], "left").select("case_id", "docket_id", "doc_id", F.explode(F.array_compact(checks)).alias("reason"))


def manifest(**tables: DataFrame) -> DataFrame:
    """Row counts of tables, one row each."""
    parts = [t.agg(F.count("*").alias("n")).select(F.lit(name).alias("table_name"), "n") for name, t in tables.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def only_new_cases(case_dockets: DataFrame, known: DataFrame) -> DataFrame:
    """Cases with at least one docket not known yet."""
    flag = known.select("docket_id", F.lit(True).alias("known")).distinct()
    return case_dockets.join(flag, "docket_id", "left").groupBy("case_id").agg(F.bool_or(F.col("known").isNull()).alias("fresh")).where("fresh").select("case_id")


def orphans(referenced: list[DataFrame], configured: DataFrame) -> DataFrame:
    """Docket ids in any table and not in the configuration."""
    ids = referenced[0].select("docket_id")
    for t in referenced[1:]:
        ids = ids.union(t.select("docket_id"))
    return ids.distinct().join(configured.select("docket_id"), "docket_id", "left_anti")
