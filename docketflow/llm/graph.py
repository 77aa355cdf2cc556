"""Connected components by repeated contraction, as joins and groupings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docketflow.llm.shared import written


def components(links: DataFrame) -> DataFrame:
    """(node, component) of every end of ``links(a, b)``; the component is its smallest node.

    Each round every node takes the smallest label next to it, links are
    rewritten to labels and those inside one label go.  Stars vanish in one
    round, chains shrink geometrically.  Every round is written, so a lost
    executor costs one round at most.  No links give no rows.
    """
    links = written(links.select("a", "b").where("a <> b").distinct(), "links")
    both = links.select(F.col("a").alias("node")).union(links.select("b")).distinct()
    result = both.select("node", F.col("node").alias("component"))
    while not links.isEmpty():
        ends = links.union(links.select("b", "a"))
        label = written(ends.groupBy(F.col("a").alias("node")).agg(F.least("node", F.min("b")).alias("label")), "labels")
        left = label.select(F.col("node").alias("a"), F.col("label").alias("la"))
        right = label.select(F.col("node").alias("b"), F.col("label").alias("lb"))
        links = written(
            links.join(left.hint("merge"), "a").join(right.hint("merge"), "b")
            .select(F.least("la", "lb").alias("a"), F.greatest("la", "lb").alias("b")).where("a <> b"),
            "links",
        )
        result = written(
            result.join(label.select(F.col("node").alias("component"), "label").hint("merge"), "component", "left")
            .select("node", F.coalesce("label", "component").alias("component")),
            "components",
        )
    return result
