"""Titles from keys, folded lines, documents of an entry, log lines."""

from pyspark.sql import functions as F

from docketflow.functions import text as T
from docketflow.operators import documents, feed, runs, titles


def test_folding_keeps_characters_whole(spark):
    lines = ["x" * 75, "x" * 76, "é" * 80, "a" + "€" * 60, "", "😀" * 40]
    out = [r[0] for r in spark.createDataFrame([(x,) for x in lines], "t string").select(feed.folded(F.col("t"))).collect()]
    for line, got in zip(lines, out):
        parts = got.split("\r\n")
        assert all(len(p.encode()) <= 75 for p in parts) and parts[0] + "".join(p[1:] for p in parts[1:]) == line
        assert all(p[0] == " " for p in parts[1:])


def test_titles(spark):
    rows = [("a", "sentencing-vong"), ("a", "sentencing-smith"), ("b", "status-conf-schmitz"), ("b", "3rd-day-2"), ("c", "oral-argument"), ("d", "vong-2"), ("d", None)]
    df = spark.createDataFrame(rows, "case_id string, hearing_key string")
    out = df.join(titles.case_names(df), "case_id").select("hearing_key", titles.hearing_title(F.col("hearing_key"), F.col("several"))).collect()
    assert dict(map(tuple, out)) == {
        "sentencing-vong": "Sentencing - Vong", "sentencing-smith": "Sentencing - Smith", "status-conf-schmitz": "Status Conference - Schmitz", "3rd-day-2": "Day 2 - 3Rd",
        "oral-argument": "Oral Argument", "vong-2": "2", None: "",
    }


def test_chosen_text(spark):
    schema = "entry_id int, doc_id int, number int, attachment int, description string, text string, url string, is_sealed boolean"
    rows = [
        (1, 1, 5, 0, "Notice", "main", "u1", False), (1, 2, 5, 1, "INDICTMENT", "charge", "u2", True), (1, 3, 5, 2, "Exhibit", "ex", "u3", False),
        (2, 4, 6, None, None, " ", "", False), (2, 5, 6, 1, "Exhibit", "ex", None, False), (3, 6, 7, 0, "Notice", None, None, None),
    ]
    out = {r.entry_id: (r.text, r.url, r.all_text) for r in documents.chosen(spark.createDataFrame(rows, schema)).collect()}
    assert out == {1: ("charge", "u1", "[doc 5]\nmain\n\n[doc 5-1]\ncharge\n\n[doc 5-2]\nex"), 2: ("ex", None, "[doc 6-1]\nex"), 3: ("", None, "")}


def test_decisions(spark):
    lines = ["x decisions extract docket=1 entry=2 \"a\" -> ADD_HEARING(minor, 2024-02-01, 2024-01-01), MARK_HELD(), NOTHING(k)", "noise", ""]
    out = [tuple(r) for r in runs.decisions(spark.createDataFrame([(x,) for x in lines], "value string")).orderBy("pos").collect()]
    assert out == [(1, 2, 0, "ADD_HEARING", "", ["2024-01-01", "2024-02-01"]), (1, 2, 1, "MARK_HELD", "", [])]


def test_gates_search_a_text_once(spark):
    """Texts are made and searched once, attachments' notices only where there are documents; other letters than ASCII fold as before."""
    rows = [(1, "Hearing set", True, False), (2, "STATUſ of the case", True, False), (3, "brief due by 5/1/2024", False, True), (4, "\u00e9 hearing_ only", False, False), (5, None, False, False), (6, "Summons", False, False)]
    df = spark.createDataFrame([r[:2] for r in rows], "entry_id int, t string")
    out = T.gated(df, F.concat(F.col("t"), F.lit("")), "entry_id")
    assert {r.entry_id: (r.hearing, r.deadline) for r in out.collect()} == {r[0]: r[2:] for r in rows if r[2] or r[3]}
    assert out._jdf.queryExecution().optimizedPlan().toString().count("concat(") == 1
    docs = spark.createDataFrame([(1, 10), (1, 11), (3, None), (9, 12)], "entry_id int, doc_id int")
    found = documents.worklist(df, F.col("t").rlike("Hear|brief"), docs)
    assert sorted(map(tuple, found.collect()), key=str) == [(1, 10), (1, 11), (3, None)]
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("RLIKE") == 1 and not any("RLIKE" in line for line in plan.splitlines() if "Filter" in line)
