"""Triage of mail into tiers, and the reputation of recurring streams."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.hashing import stream_id
from ..functions.text import col, keyword_hits, local_part, sender_domain, subject_family, unsubscribe_host

# fixed values: labels of bulk mail, words that make mail important, local parts that take no reply
BULK_LABELS = ("CATEGORY_PROMOTIONS", "CATEGORY_SOCIAL", "CATEGORY_FORUMS")
IMPORTANT = ("verify", "sign-in", "signin", "password", "passcode", "mfa", "2fa", "security alert", "billing", "invoice", "receipt", "statement", "payment failed", "recovery")
NO_REPLY = ("noreply", "no-reply", "donotreply", "do-not-reply", "notifications")


def bulk_score(labels, headers, sender) -> Column:
    h = col(headers)
    present = lambda name: F.coalesce(F.element_at(h, name), F.lit("")) != ""
    points = [
        (F.arrays_overlap(col(labels), F.array(*[F.lit(x) for x in BULK_LABELS])), 2),
        (present("list-id"), 2),
        (present("list-unsubscribe"), 1),
        (F.lower(F.element_at(h, "precedence")).isin("bulk", "list", "junk"), 1),
        (present("auto-submitted") & (F.lower(F.element_at(h, "auto-submitted")) != "no"), 1),
        (local_part(sender).rlike("^(?:" + "|".join(NO_REPLY) + ")"), 1),
    ]
    return sum((F.when(F.coalesce(c, F.lit(False)), n).otherwise(0) for c, n in points), F.lit(0))


def importance_score(text, bulk: Column, direct: Column) -> Column:
    """Distinct keywords, three at most, and one more for mail sent to the account itself without signs of bulk."""
    return F.least(F.lit(3), F.size(keyword_hits(text, IMPORTANT))) + F.when((bulk == 0) & F.coalesce(direct, F.lit(False)), 1).otherwise(0)


def tier(bulk: Column, importance: Column) -> Column:
    return F.when(importance >= 2, "full").when(bulk >= 4, "minimal").when(bulk >= 2, "light").otherwise("full")


def applied_tier(proposed: Column, enforce: bool) -> Column:
    """Observing changes nothing; enforcing applies light wherever not all work is due."""
    return F.when(F.lit(enforce) & (proposed != "full"), "light").otherwise("full")


def triaged(messages: DataFrame, enforce: bool = False) -> DataFrame:
    """``messages``: msg_id, account_email, from_addr, to_addr, subject, snippet, labels, headers (map), ts_ms."""
    m = messages.withColumn("bulk_score", bulk_score("labels", "headers", "from_addr"))
    direct = F.lower(F.trim(F.get(F.split("to_addr", ","), 0))) == F.lower("account_email")
    text = F.concat_ws(" ", "subject", "snippet")
    header = lambda n: F.coalesce(F.element_at("headers", n), F.lit(""))
    listed = F.arrays_overlap("labels", F.array(*[F.lit(x) for x in BULK_LABELS])) | (header("list-id") != "") | F.lower(header("precedence")).isin("bulk", "list", "junk")
    m = m.withColumns({"importance_score": importance_score(text, F.col("bulk_score"), direct), "sender_domain": sender_domain("from_addr"), "subject_family": subject_family("subject"), "stream_kind": F.when(listed, "bulk").otherwise("direct")})
    m = m.withColumn("stream_id", stream_id("account_email", "sender_domain", "subject_family", header("list-id"), unsubscribe_host(header("list-unsubscribe")), "stream_kind"))
    m = m.withColumn("triage_tier", tier(F.col("bulk_score"), F.col("importance_score")))
    m = m.withColumn("applied_tier", applied_tier(F.col("triage_tier"), enforce))
    return with_novelty(m, "stream_id", ["ts_ms", "msg_id"])


def with_novelty(rows: DataFrame, stream: str, order: list[str]) -> DataFrame:
    """1.0 for the first message of a stream, 0.0 after."""
    nth = F.row_number().over(Window.partitionBy(stream).orderBy(*order))
    return rows.withColumn("novelty_score", F.when(nth == 1, 1.0).otherwise(0.0))


def reputation(rows: DataFrame, stream: str, keys: list[str], tier_col: str, at: str) -> DataFrame:
    """A row per stream: its most frequent keys, counts by tier, first and last time, and full - minimal - 2 suppressed."""
    n = {t: F.count_if(F.col(tier_col) == t).alias(f"{t}_count") for t in ("full", "light", "minimal", "suppressed")}
    groups = rows.groupBy(stream, *keys).agg(F.count(F.lit(1)).alias("n"), F.max(at).alias("last"), *n.values(), F.min(at).alias("first"))
    total = groups.groupBy(stream).agg(
        F.sum("n").alias("observation_count"), *[F.sum(f"{t}_count").alias(f"{t}_count") for t in n], F.min("first").alias("first_seen"), F.max("last").alias("last_seen"),
        F.max_by(F.struct(*keys), F.struct("n", "last", *keys)).alias("k"),
    )
    score = (F.col("full_count") - F.col("minimal_count") - 2 * F.col("suppressed_count")).cast("double")
    return total.select(stream, "k.*", "observation_count", *[f"{t}_count" for t in n], "first_seen", "last_seen", score.alias("reputation_score"))
