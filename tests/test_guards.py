"""Hand-written summaries, what the guards find in them, and their repair."""

import time

import pytest
from pyspark.sql import functions as F

from docketflow.operators import guards as G

SCHEMA = "key int, attempt int, text string, source string, known_dates array<string>, scheduled array<struct<title:string,dates:array<string>>>"
CASES = {
    1: ("Mr. Doe v. U.S. Bank was charged on May 6, 2026. He paid $5,000. Sentencing is scheduled for August 4, 2026.", "on 5/6/26 he paid 5000", ["2026-08-04"], [("Sentencing", ["2026-09-01"])], "Mr. Doe v. U.S. Bank was charged on May 6, 2026. He paid $5,000."),
    2: ("A forfeiture money judgment of $15,100 was entered against him, and he is appealing. He owes $15,100.00 in restitution; the operator notes that he has appealed.", "15,100.00", [], None, "He is appealing. He owes $15,100.00 in restitution; he has appealed."),
    3: ("According to the operator, he left.", "x", [], [], "He left."),
    4: ("He owes $9 in restitution, and a forfeiture money judgment of $9 against him.", "9", [], [], "He owes $9 in restitution."),
    5: (G.REFUSAL, "x", [], [], G.REFUSAL),
    6: ("Trial was previously set for May 1, 2024. On June 3, 2024 he left. It cost $3 million.", "May 1,\n\n2024", [], [("Jury Trial", ["2024-06-01"])], "Trial was previously set for May 1, 2024. It cost $3 million."),
    7: ("He left on June 3, 2024.", None, None, None, G.REFUSAL),
    8: ("A is 5. 1 he was 1. It was 2 on May 1, 2024. B", "", [], [], "A is 5. 1 he was 1. B"),
    9: (None, None, None, None, None),
}


@pytest.fixture(scope="module")
def drafts(spark):
    return spark.createDataFrame([(k, 1, *c[:4]) for k, c in CASES.items()], SCHEMA)


def test_repair(drafts):
    assert {r.key: r.text for r in G.guarded(drafts).collect()} == {k: c[4] for k, c in CASES.items()}


def test_record_claims(spark):
    rows = [("No new hearings. He remains at large.", "no word", ["No new hearings", "remains at large"]), ("He remains at large.", "a fugitive", []), ("No restitution.", "", [])]
    df = spark.createDataFrame(rows, "t string, s string, want array<string>")
    assert all(r.want == r.got for r in df.withColumn("got", G.record_claims(F.col("t"), F.col("s"))).collect())


def test_clean_retry_wins(spark):
    rows = [(1, 1, "It was on June 3, 2024.", "", [], []), (1, 2, "It was.", "", [], []), (2, 1, "A.", "", [], []), (2, 2, "B.", "", [], [])]
    out = {r.key: (r.attempt, r.text, r.repaired) for r in G.guarded(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert out == {1: (2, "It was.", False), 2: (1, "A.", False)}


def test_links(spark):
    rows = [
        ("He has  been [charged with](doc:D1) fraud", "He [has been charged](https://x/1) with fraud"),
        ("It [was](doc:D2) and [is not](doc:D9).", "It was and is not."),
        ("[found guilty of to](doc:D1) x", "[found guilty](https://x/1) of to x"),
    ]
    urls = F.create_map(F.lit("D1"), F.lit("https://x/1"), F.lit("D2"), F.lit(None).cast("string"))
    df = spark.createDataFrame(rows, "t string, want string")
    assert [(r.got, r.want) for r in df.withColumn("got", G.resolved_links(F.col("t"), urls)).collect()] == [(w, w) for _, w in rows]


def test_sentences_of_long_texts(spark):
    """Ten million characters; abbreviations tried at every one of them took half a minute."""
    rows = spark.range(1000).select(F.expr("repeat('the motion of Mr. Doe v. U.S. Bank is denied without any more words here. ', 133) || 'No. 7 is open. \"So\" it ends.'").alias("t"))
    rows = rows.coalesce(1).localCheckpoint()
    G_sentences = rows.select(F.size(G.sentences(F.col("t"))).alias("n"))
    G_sentences.limit(1).collect()
    began = time.monotonic()
    assert [(r.n, r["count"]) for r in G_sentences.groupBy("n").count().collect()] == [(3, 1000)]
    assert time.monotonic() - began < 8


def test_clean_texts_cost_little(spark):
    """A source is not searched for grounds of flight, nor a text by patterns whose words it lacks; other letters than ASCII fold as before."""
    rows = [("NO ſcheduling order. He is a fugitive.", "x", ["NO ſcheduling order", "is a fugitive"]), ("It iſ unKnown whether he left.", "x", ["It iſ unKnown whether"]), ("IT IS UNKNOWN WHETHER he left.", None, ["IT IS UNKNOWN WHETHER"]), (None, "x", [])]
    df = spark.createDataFrame(rows, "t string, s string, want array<string>")
    assert [r.got for r in df.withColumn("got", G.record_claims(F.col("t"), F.col("s"))).collect()] == [r[2] for r in rows]
    drafts = spark.createDataFrame([(1, 1, "He left on May 3, 2024; trial is set for May 3, 2024.", "", [], [("Trial", ["2024-06-01"])])], SCHEMA)
    plan = G.found(drafts, ("stale",))._jdf.queryExecution().optimizedPlan().toString()
    assert "imprisonment" not in plan and plan.count("change") <= 5
    assert G.found(drafts).first().found.asDict() == {"record": [], "ungrounded": ["May 3, 2024", "May 3, 2024"], "doubled": [], "stale": ["trial is set for May 3, 2024"]}
