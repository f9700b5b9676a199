"""Counts, gaps and drift over the tables of a store."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def counts(tables: dict[str, DataFrame]) -> DataFrame:
    """table_name, row_count."""
    own = [df.agg(F.count(F.lit(1)).alias("row_count")).select(F.lit(name).alias("table_name"), "row_count") for name, df in tables.items()]
    return reduce(DataFrame.unionByName, own)


def history_gap(cursors: DataFrame, messages: DataFrame) -> DataFrame:
    """account_email, cursor, latest, gap, advisable: how far the cursor is ahead of what was kept."""
    latest = messages.groupBy("account_email").agg(F.max("history_id").alias("latest"))
    out = cursors.select("account_email", F.col("history_id").alias("cursor")).join(latest, "account_email", "full")
    gap = F.greatest(F.lit(0), F.coalesce(F.col("cursor") - F.col("latest"), F.lit(0)))
    return out.select("account_email", "cursor", "latest", gap.alias("gap"), (gap > 0).alias("advisable"))


def policy_pivot(entries: DataFrame, statuses=("active", "rejected")) -> DataFrame:
    return entries.groupBy("policy_version").pivot("status", list(statuses)).count().na.fill(0)


def validate(spark: SparkSession, names: list[str]) -> DataFrame:
    """Whether each table can be found."""
    return spark.createDataFrame([(n, spark.catalog.tableExists(n)) for n in names], "table_name string, ok boolean")


# fixed values: patterns of what a failed run says, in order
FAILURES = (("timeout", "timed? ?out|timeout"), ("connection", "connection (?:refused|reset)|unreachable"), ("size", "too large|context length|maximum.*tokens"), ("locked", "database is locked|lock"), ("dimension", "dimension"))


def classify_failure(message) -> F.col:
    text, out = F.lower(F.col(message)), None
    for name, pattern in FAILURES:
        out = F.when(text.rlike(pattern), name) if out is None else out.when(text.rlike(pattern), name)
    return out.otherwise("other")
