"""Repairs of stored columns, each as a plan of changes before it is applied."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def significance(rows: DataFrame, classified: DataFrame, key: str = "hearing_key") -> DataFrame:
    """Rows without a significance that the classification gives one."""
    return rows.where("significance IS NULL").join(classified.select("case_id", key, F.col("significance").alias("new")), ["case_id", key]).select("case_id", key, "new")
