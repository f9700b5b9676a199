"""Attachment inventory: what is to be listed, what is to be written, and reports of both."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import materialize

COUNTS = ("selected", "materialized", "failed", "bytes_written", "inline_sourced", "fetched")


def inventory_candidates(messages: DataFrame, state: DataFrame, account: str | None = None, missing_only: bool = True, limit: int | None = None) -> DataFrame:
    """msg_id of the messages whose attachments are to be listed, newest first under a limit."""
    rows = messages if account is None else messages.filter(F.col("account_email") == account)
    if missing_only:
        rows = rows.join(state.select("msg_id").filter("msg_id IS NOT NULL"), "msg_id", "left_anti")
    rows = rows.filter("msg_id IS NOT NULL")
    return (rows if limit is None else rows.orderBy(F.coalesce("internal_ts", F.lit(0)).desc(), F.desc("msg_id")).limit(limit)).select("msg_id")


def to_write(attachments: DataFrame, stored: DataFrame | None, inline: DataFrame, missing_only: bool = True) -> DataFrame:
    """Attachments (attachment_key, path) with their bytes: those not stored yet, their own payload first.

    ``stored``: path of the files that exist; ``inline``: attachment_key, content.  ``content`` is null where it must be fetched."""
    rows = attachments.filter("attachment_key IS NOT NULL")
    if missing_only and stored is not None:
        rows = rows.join(stored.select("path"), "path", "left_anti")
    return rows.join(inline.filter("content IS NOT NULL").dropDuplicates(["attachment_key"]).select("attachment_key", "content"), "attachment_key", "left")


def stored_files(spark: SparkSession, root: str) -> DataFrame:
    """path (below ``root``), length of what lies there; contents are not read."""
    base = root.rstrip("/")
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(base).select("path", "length")
    return files.select(F.regexp_extract("path", r"(attachments/.*)$", 1).alias("path"), "length").filter("path <> ''")


def file_bytes(spark: SparkSession, root: str) -> DataFrame:
    """path, content of stored attachments."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root.rstrip("/"))
    return files.select(F.regexp_extract("path", r"(attachments/.*)$", 1).alias("path"), "content")


def write_missing(spark: SparkSession, attachments: DataFrame, inline: DataFrame, root: str, stored: DataFrame | None = None) -> DataFrame:
    """path, content_sha256, content_size_bytes of the attachments written now."""
    return materialize(to_write(attachments, stored, inline).filter("content IS NOT NULL").dropDuplicates(["path"]), root)


def state_counts(attachments: DataFrame) -> DataFrame:
    return attachments.groupBy(F.coalesce("inventory_state", F.lit("")).alias("inventory_state")).agg(F.count(F.lit(1)).alias("n"))


def outcome(content: Column, written: Column, size: Column, was_inline: Column) -> Column:
    """The counters of one attachment."""
    flag = lambda c: F.coalesce(c, F.lit(False)).cast("long")
    own = {"selected": F.lit(1).cast("long"), "materialized": flag(written), "failed": flag(~F.coalesce(written, F.lit(False))), "bytes_written": F.when(F.coalesce(written, F.lit(False)), size.cast("long")).otherwise(F.lit(0).cast("long")), "inline_sourced": flag(was_inline), "fetched": flag(content.isNotNull() & ~F.coalesce(was_inline, F.lit(False)))}
    return F.struct(*[own[c].alias(c) for c in COUNTS])


def summed(stats: DataFrame, *keys) -> DataFrame:
    """Counters of many runs or attachments added up, a missing one as 0."""
    return stats.groupBy(*keys).agg(*[F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(c) for c in COUNTS])
