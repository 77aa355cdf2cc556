"""Written files read back: feeds, ordered counts, truth rows; and texts chosen for a document."""

import datetime as dt

from pyspark.sql import functions as F

from docketflow.operators import documents, feed, runs


def test_feed_files_hold_their_events_in_order(spark, tmp_path):
    rows = [("a", "h-2", "Two", dt.date(2024, 5, 2), "scheduled", 30), ("a", "h-1", "One; with, signs", dt.date(2024, 5, 1), "scheduled", 0), ("a", "h-3", "Gone", dt.date(2024, 5, 1), "cancelled", 0), ("b", "h-9", "x" * 200, dt.date(2024, 5, 3), "held", 60)]
    frame = spark.createDataFrame(rows, "case_id string, event_key string, title string, start_date date, status string, minutes int")
    feed.write_feed(frame, str(tmp_path / "f"))
    text = {r.case_id: r.value for r in spark.read.text(str(tmp_path / "f"), wholetext=True).collect()}
    a = text["a"]
    assert a.count("BEGIN:VEVENT") == 2 and a.index("One\\; with\\, signs") < a.index("Two") and "Gone" not in a
    assert "DTSTART;VALUE=DATE:20240501" in a and "TRANSP:TRANSPARENT" in a and "DTSTART;TZID=America/New_York:20240502T000000" in a and "DTEND;TZID=America/New_York:20240502T003000" in a
    assert all(len(line.encode()) <= 75 for line in text["b"].split("\r\n")) and "x" * 200 in text["b"].replace("\r\n ", "")


def test_counts_are_written_in_order_and_read_back(spark, tmp_path):
    rows = [("p", "c", "d1", None, 9), ("p", "c", "d1", 2, 8), ("o", "c", "d1", 5, 7), ("p", "b", "d2", 1, 6)]
    frame = spark.createDataFrame(rows, "provider string, case_id string, docket_number string, entry_number int, entry_id long")
    runs.write_entry_actions(frame, str(tmp_path / "c"))
    parts = sorted((tmp_path / "c").glob("part-*.csv"))
    lines = [x for p in parts for x in p.read_text().splitlines() if not x.startswith("provider")]
    assert [int(x.split(",")[-1]) for x in lines] == [7, 6, 8, 9]
    spark.createDataFrame([("1", "2", "1", "0"), ("2", "x", "1", ""), ("3", "1", "0", "0"), ("4", "1", "1", "1")], "entry_id string, h_scheduled string, reviewed string, bad_ocr string").write.option("header", True).csv(str(tmp_path / "t"))
    found = {r.entry_id: r.h_scheduled for r in runs.read_scored(spark, str(tmp_path / "t")).collect()}
    assert found == {"1": 2, "2": 0}


def test_the_text_that_speaks_for_a_document(spark):
    good, short = "plain words of a document " * 10, "stamp"
    rows = [(False, good, None, None), (False, short, good + "local", None), (False, short, None, good + "ocr"), (True, short, good, good), (None, None, short, short)]
    frame = spark.createDataFrame(rows, "s boolean, u string, l string, o string")
    got = [r[0] for r in frame.select(documents.text_choice(F.col("s"), F.col("u"), F.col("l"), F.col("o"))).collect()]
    assert got == [good, good + "local", good + "ocr", None, None]
