"""Titles made from keys, and the names of a case that decide their form."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docketflow.functions.text import key_title, titled

# Words of a key that name a proceeding and no person, and abbreviations of keys.
PROCEEDING_WORDS = (
    "sentencing", "resentencing", "trial", "jury", "selection", "bench", "pretrial", "conference", "conf", "status", "scheduling", "initial", "appearance", "arraignment",
    "rearraignment", "detention", "bond", "bail", "hearing", "hearings", "motion", "motions", "change", "of", "plea", "oral", "argument", "telephonic", "evidentiary", "evid",
    "cipa", "fisa", "suppression", "suppress", "daubert", "franks", "markman", "final", "day", "probable", "cause", "show", "order", "review", "id", "preliminary",
    "injunction", "pi", "revocation", "competency", "settlement", "fairness", "in", "limine", "bill", "particulars", "mtd", "msj", "tro", "post", "pretrial", "charging",
    "excusal", "setting", "to", "standby", "trade", "secrets", "protective", "default", "judgment", "surrender", "extension", "superseding", "indictment", "waiver",
    "attorney", "appointment", "counsel", "briefing", "calendar", "call", "docket",
)
ABBREVIATIONS = {"conf": "Conference", "govt": "Government", "msj": "Motion for Summary Judgment", "tro": "Temporary Restraining Order"}


def _tokens(key: Column) -> Column:
    return F.filter(F.split(F.coalesce(key, F.lit("")), "-"), lambda t: t != "")


def _is_name(t: Column) -> Column:
    return ~F.lower(t).isin(*PROCEEDING_WORDS) & ~t.rlike("^[0-9]+$")


def name_tokens(key: Column) -> Column:
    """The tokens of a hearing key that name a person."""
    return F.filter(_tokens(key), _is_name)


def humanized(tokens: Column, expand: bool = True) -> Column:
    full = F.create_map(*[F.lit(x) for pair in ABBREVIATIONS.items() for x in pair])
    word = lambda t: F.coalesce(F.element_at(full, F.lower(t)), titled(t)) if expand else titled(t)
    return F.array_join(F.transform(tokens, word), " ")


def deadline_title(key: Column, expand: bool = True) -> Column:
    return F.when(F.size(_tokens(key)) > 0, humanized(_tokens(key), expand)).otherwise(key_title(key))


def hearing_title(key: Column, several: Column, expand: bool = True) -> Column:
    """'<Type>' in a case with one name at most, '<Type> - <Name>' where it has several; the plain key if no type is there."""
    kinds, names = F.filter(_tokens(key), lambda t: ~_is_name(t)), name_tokens(key)
    kind = humanized(kinds, expand)
    full = F.when(several & (F.size(names) > 0), F.concat(kind, F.lit(" - "), humanized(names, False))).otherwise(kind)
    return F.when(F.size(kinds) > 0, full).otherwise(key_title(key))


def case_names(rows: DataFrame) -> DataFrame:
    """(case_id, several): whether the keys of a case name more than one person.  Least and greatest name tell it; no set is built."""
    names = rows.select("case_id", F.explode_outer(name_tokens(F.col("hearing_key"))).alias("name"))
    ends = names.groupBy("case_id").agg(F.min(F.lower("name")).alias("a"), F.max(F.lower("name")).alias("z"))
    return ends.select("case_id", F.coalesce(F.col("a") != F.col("z"), F.lit(False)).alias("several"))


def healed_titles(rows: DataFrame) -> DataFrame:
    """(case_id, hearing_key, old, new): rows whose title is exactly one that a key gives, and not the present form of it."""
    key, title = F.col("hearing_key"), F.coalesce("title", F.lit(""))
    both = rows.join(case_names(rows), "case_id")
    new = hearing_title(key, F.col("several"))
    derived = (title == key_title(key)) | (title == new) | (title == hearing_title(key, F.col("several"), False))
    return both.where(derived & (title != new)).select("case_id", "hearing_key", F.col("title").alias("old"), new.alias("new"))


def healed_deadline_titles(rows: DataFrame) -> DataFrame:
    """(case_id, deadline_key, old, new): deadlines whose title only spells their key, in an older form than the present one."""
    key, title = F.col("deadline_key"), F.coalesce("title", F.lit(""))
    new = deadline_title(key)
    derived = (title == key_title(key)) | (title == new) | (title == deadline_title(key, False))
    return rows.where(derived & (title != new)).select("case_id", "deadline_key", F.col("title").alias("old"), new.alias("new"))
