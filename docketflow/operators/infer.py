"""Model calls over prompts: cache by content, misses to a user's scorer, answers to typed rows."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docketflow.operators.tables import written

ANSWER = "struct<actions:array<struct<type:string,hearing_key:string,local_date:string,reason:string>>>"


def request_key(*parts: Column) -> Column:
    """A content address of a request."""
    return F.sha2(F.to_json(F.struct(*parts)), 256)


def prompts(entries: DataFrame, related: DataFrame, most: int = 1500) -> DataFrame:
    """(entry_id, prompt): the entry's text and the heads of its related entries, in order, each cut at ``most`` characters."""
    heads = related.groupBy("entry_id").agg(F.array_sort(F.collect_list(F.struct("ref_entry_id", F.left("ref_text", F.lit(most)).alias("t")))).alias("r"))
    lines = F.transform(F.coalesce("r", F.array().cast("array<struct<ref_entry_id:bigint,t:string>>")), lambda x: F.concat(F.lit("["), x["ref_entry_id"].cast("string"), F.lit("] "), x["t"]))
    return entries.join(heads, "entry_id", "left").select("entry_id", F.concat_ws("\n", F.col("text"), F.array_join(lines, "\n")).alias("prompt"))


def verification_prompts(rows: DataFrame, shown: DataFrame, entries: DataFrame, fields: list[str], key: list[str], most: int = 1500) -> DataFrame:
    """(key, prompt) of rows to verify: their ``fields``, and the entries of ``shown(key, entry_id)``, newest last, each text cut at ``most`` characters.

    A null reads as 'none', a row without entries shows '(none)'.
    """
    said = lambda c: F.coalesce(c.cast("string"), F.lit("none"))
    text = F.left(F.trim(F.coalesce(F.nullif("description", F.lit("")), "short_description", F.lit(""))), F.lit(most))
    texts = entries.select("entry_id", "date_filed", "entry_number", text.alias("t"))
    lines = shown.hint("merge").join(texts.hint("merge"), "entry_id").groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("date_filed", "entry_number", "entry_id", "t"))).alias("lines"))
    line = lambda x: F.concat(F.lit("- ["), said(x["entry_number"]), F.lit("] "), said(x["entry_id"]), F.lit(" filed "), said(x["date_filed"]), F.lit(": "), x["t"])
    head = F.concat_ws("\n", *[F.concat(F.lit(f"{f}: "), said(F.col(f))) for f in fields])
    body = F.coalesce(F.array_join(F.transform("lines", line), "\n"), F.lit("(none)"))
    return rows.join(lines, key, "left").select(*key, F.concat_ws("\n", F.lit("TO VERIFY"), head, F.lit("RECENT ENTRIES"), body).alias("prompt"))


def _lines(rows: DataFrame, by: list[str], order: list[str], line: Column, name: str, between: str = "\n") -> DataFrame:
    """The ``line`` of each row of a group, in order, as one text."""
    listed = F.array_sort(F.collect_list(F.struct(*order, line.alias("line"))))
    return rows.groupBy(*by).agg(F.array_join(F.transform(listed, lambda x: x["line"]), between).alias(name))


def extraction_prompts(entries: DataFrame, dockets: DataFrame, known: DataFrame, documents: DataFrame, related: DataFrame, most_document: int = 6000, most_related: int = 1500) -> DataFrame:
    """(entry_id, prompt) of ``entries(entry_id, docket_id, entry_number, date_filed, text)``: what an extraction is asked.

    ``dockets(docket_id, docket_number, court_id)`` group copies of one docket; all of a group
    are shown under its smallest id.  ``known(docket_id, kind, key, status, title, at)`` has the rows of the group
    that are there already, ``documents(entry_id, place, text)`` the entry's texts, each cut at ``most_document`` characters,
    ``related(entry_id, ref_number, ref_text)`` the entries it refers to, each cut at ``most_related``; blank ones are left out.
    """
    group = Window.partitionBy("docket_number", "court_id")
    own = dockets.select("docket_id", "docket_number", "court_id", F.min("docket_id").over(group).alias("canonical"))
    said = lambda c: F.coalesce(c.cast("string"), F.lit("none"))
    none = F.lit("(none)")
    row = F.concat_ws(" ", F.lit("-"), "kind", "key", said(F.col("status")), said(F.col("title")), F.lit("at"), said(F.col("at")), F.lit("docket"), said(F.col("canonical")))
    rows = _lines(known.join(own.select("docket_id", "canonical").hint("merge"), "docket_id"), ["canonical"], ["kind", "key"], row, "rows")
    texts = documents.where(F.trim(F.coalesce("text", F.lit(""))) != "")
    texts = _lines(texts, ["entry_id"], ["place"], F.left("text", F.lit(most_document)), "texts", "\n---\n")
    heads = related.where(F.trim(F.coalesce("ref_text", F.lit(""))) != "")
    heads = _lines(heads, ["entry_id"], ["ref_number"], F.concat(F.lit("- ["), said(F.col("ref_number")), F.lit("] "), F.left(F.trim("ref_text"), F.lit(most_related))), "heads")
    # The parts of an entry meet by its id; then the known rows come by its docket, found for dockets before.  So an
    # entry is shuffled twice, and the known rows never with it.
    known_here = own.join(rows.hint("merge"), "canonical", "left").select("docket_id", "canonical", "rows")
    both = entries.join(texts.hint("merge"), "entry_id", "left").join(heads.hint("merge"), "entry_id", "left")
    both = both.join(known_here.hint("merge"), "docket_id", "left").withColumn("canonical", F.coalesce("canonical", "docket_id"))
    block = lambda title, c: F.when(F.col(c).isNotNull(), F.concat(F.lit(title + "\n"), F.col(c)))
    head = F.concat(F.lit("ENTRY "), said(F.col("entry_number")), F.lit(" of docket "), said(F.col("canonical")), F.lit(" filed "), said(F.col("date_filed")))
    return both.select("entry_id", F.concat_ws("\n", F.lit("KNOWN ROWS"), F.coalesce("rows", none), head, F.coalesce("text", F.lit("")), block("ATTACHED TEXTS", "texts"), block("RELATED ENTRIES", "heads")).alias("prompt"))


def dedupe_prompts(rows: DataFrame, by: list[str], fields: list[str], shown: DataFrame, entries: DataFrame, most: int = 1500) -> DataFrame:
    """(by, prompt) of clusters of rows that may be one: each row's ``fields``, and the entries ``shown(by, entry_id)``, newest last."""
    said = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("none"))
    each = F.concat_ws("\n", F.lit("---"), *[F.concat(F.lit(f"{f}: "), said(f)) for f in fields])
    text = F.left(F.trim(F.coalesce(F.nullif("description", F.lit("")), "short_description", F.lit(""))), F.lit(most))
    found = shown.select(*by, "entry_id").distinct().hint("merge").join(entries.select("entry_id", "date_filed", "entry_number", text.alias("t")).hint("merge"), "entry_id")
    line = F.concat(F.lit("- ["), said("entry_number"), F.lit("] filed "), said("date_filed"), F.lit(": "), F.col("t"))
    cluster = _lines(rows, by, [fields[0]], each, "rows").join(rows.groupBy(*by).agg(F.count("*").alias("n")).hint("merge"), by)
    both = cluster.join(_lines(found, by, ["date_filed", "entry_id"], line, "lines").hint("merge"), by, "left")
    return both.select(*by, F.concat_ws("\n", F.concat(F.lit("CANDIDATES "), F.col("n").cast("string")), "rows", F.lit("RECENT ENTRIES"), F.coalesce("lines", F.lit("(none)"))).alias("prompt"))


def budgeted(documents: DataFrame, by: list[str], order: list[str], most: Column, total: Column) -> DataFrame:
    """``documents(.., text)`` with the part of each text that is shown (``shown``): at most ``most`` characters of one, and ``total`` of a group in order.

    The one at the edge is cut, those after it show nothing; ``left_out`` counts what is missing.
    """
    n = F.least(F.length(F.coalesce("text", F.lit(""))), most)
    before = F.coalesce(F.sum(n).over(Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    size = F.greatest(F.lit(0), F.least(n, total - before)).cast("int")
    rows = documents.withColumn("n_shown", size)
    return rows.withColumn("shown", F.left(F.coalesce("text", F.lit("")), F.col("n_shown"))).withColumn("left_out", F.length(F.coalesce("text", F.lit(""))) - F.col("n_shown")).drop("n_shown")


#: Sections of a summary's prompt: characters of one document, and of all.
SECTIONS = {"primary": (60_000, 120_000), "disposition": (40_000, 120_000), "extra": (40_000, 80_000)}


def summary_prompts(dockets: DataFrame, documents: DataFrame, events: DataFrame, advisories: DataFrame, today: str, sections: dict[str, tuple[int, int]] = SECTIONS) -> DataFrame:
    """(docket_id, prompt): what a summary is written from.

    ``dockets(docket_id, docket_number, court)``, ``documents(docket_id, section,
    place, name, text)``, ``events(docket_id, line)``, ``advisories(docket_id, line)``.
    Documents stand in the order of their section and place, with a reference of their own each
    ([D1], ..), within the section's budgets; a text that is cut says how much is left out.
    """
    pick = lambda i: F.element_at(F.create_map(*[F.lit(x) for k, v in sections.items() for x in (k, v[i])]), F.col("section"))
    place = F.array_position(F.array(*[F.lit(s) for s in sections]), F.col("section"))
    docs = budgeted(documents.where(F.col("section").isin(*sections)), ["docket_id", "section"], ["place", "name"], pick(0), pick(1))
    numbered = docs.withColumn("ref", F.row_number().over(Window.partitionBy("docket_id").orderBy(place, "place", "name")))
    cut = F.when(F.col("left_out") > 0, F.concat(F.lit(" [.. "), F.col("left_out").cast("string"), F.lit(" characters left out]"))).otherwise("")
    block = F.concat(F.lit("--- [D"), F.col("ref").cast("string"), F.lit("] "), F.col("section"), F.lit(": "), F.col("name"), F.lit("\n"), F.col("shown"), cut)
    shown = numbered.select("docket_id", "ref", block.alias("block")).groupBy("docket_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ref", "block"))), lambda x: x["block"]), "\n").alias("documents"))
    lines = lambda rows, name: rows.groupBy("docket_id").agg(F.array_join(F.array_sort(F.collect_list("line")), "\n").alias(name))
    rows = dockets.join(shown.hint("merge"), "docket_id", "left").join(lines(events, "events").hint("merge"), "docket_id", "left").join(lines(advisories, "advisories").hint("merge"), "docket_id", "left")
    none = F.lit("(none)")
    head = F.concat(F.lit(f"TODAY {today}\nDOCKET "), F.coalesce("docket_number", none), F.lit(" in "), F.coalesce("court", none))
    return rows.select("docket_id", F.concat_ws("\n", head, F.col("advisories"), F.lit("EVENTS"), F.coalesce("events", none), F.lit("DOCUMENTS"), F.coalesce("documents", none), F.lit("Write two to four sentences.")).alias("prompt"))


def infer(rows: DataFrame, cache: DataFrame, scorer: Callable[[pd.Series], pd.Series]) -> DataFrame:
    """(id, key, response, cached) of ``rows(id, key, prompt)``: cached responses, and the scorer's for one row of each missing key.

    Filters belong before this: Spark cannot push them through the scorer.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield pd.DataFrame({"key": f["key"], "response": scorer(f["prompt"])})

    missing = rows.join(cache.select("key"), "key", "left_anti").groupBy("key").agg(F.min("prompt").alias("prompt"))
    # Written, so that no lost executor or second reader pays for the calls again.
    fresh = written(missing.mapInPandas(run, "key string, response string"), "responses").withColumn("cached", F.lit(False))
    known = cache.select("key", "response", F.lit(True).alias("cached"))
    return rows.select("id", "key").join(known.unionByName(fresh).hint("merge"), "key")


def parsed_actions(rows: DataFrame) -> DataFrame:
    """``rows(id, response)`` to one row an action: fences cut, text from the first brace; what cannot be read is one IGNORE."""
    body = F.regexp_extract(F.regexp_replace("response", "```(?:json)?", ""), r"(?s)(\{.*)", 1)
    answer = F.from_json(body, ANSWER)
    actions = F.coalesce(answer["actions"], F.from_json(F.lit('{"actions":[{"type":"IGNORE","reason":"unreadable"}]}'), ANSWER)["actions"])
    return rows.select("id", F.posexplode(actions).alias("action_idx", "a")).select("id", "action_idx", "a.*")


def parsed_verdicts(rows: DataFrame) -> DataFrame:
    """The first action as a verdict, else UNCLEAR."""
    body = F.regexp_extract(F.regexp_replace("response", "```(?:json)?", ""), r"(?s)(\{.*)", 1)
    first = F.try_element_at(F.from_json(body, ANSWER)["actions"], F.lit(1))
    return rows.select("id", F.coalesce(first["type"], F.lit("UNCLEAR")).alias("verdict"), F.coalesce(first["reason"], F.lit("no verdict")).alias("reason"))


def usage_log(lines: DataFrame) -> DataFrame:
    """Token counts from ``llm-tokens call k=v ...`` lines; what is no number is 0."""
    pairs = F.str_to_map(F.regexp_extract("value", r"llm-tokens call (.*)$", 1), F.lit(" "), F.lit("="))
    kept = lines.where(F.col("value").contains("llm-tokens call ")).withColumn("m", pairs)
    number = lambda k: F.coalesce(F.col("m")[k].try_cast("bigint"), F.lit(0)).alias(k)
    return kept.select(F.col("m")["purpose"].alias("purpose"), F.col("m")["model"].alias("model"), F.nullif(F.col("m")["docket"], F.lit("-")).alias("docket"), number("input"), number("output"), number("cached"))
