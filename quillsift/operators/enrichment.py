"""Enrichment by keywords, and by a model where there is one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.jsons import enrich_filled, first_json
from ..functions.text import col, short_text
from .model_calls import json_answers, missing_text

FALLBACK = "heuristic-fallback"
# fixed values: keyword groups in order, and what they say of a message
GROUPS = (
    (("rent", "lease", "landlord", "tenant", "apartment", "property manager"), "housing", "reply", 9),
    (("invoice", "payment", "billing", "statement", "due"), "billing", "review", 7),
    (("verify", "security", "password", "alert", "suspicious"), "security", "review", 8),
    (("meeting", "schedule", "calendar", "appointment"), "scheduling", "schedule", 6),
)
DEFAULT = ("general", "review", 4)


def ladder(text: Column) -> Column:
    """category, action, importance by the first group with a keyword in the lower-cased text (inside words too)."""
    row = lambda c, a, i: F.struct(F.lit(c).alias("category"), F.lit(a).alias("action"), F.lit(i).alias("importance"))
    out = None
    for words, *said in GROUPS:
        hit = text.rlike("|".join(words))
        out = F.when(hit, row(*said)) if out is None else out.when(hit, row(*said))
    return out.otherwise(row(*DEFAULT))


def heuristic(subject, snippet, body) -> Column:
    text = F.lower(F.concat_ws(" ", *[F.coalesce(col(c), F.lit("")) for c in (subject, snippet, body)]))
    s, n = short_text(subject), short_text(snippet)
    evidence = F.coalesce(F.nullif(n, F.lit("")), F.nullif(s, F.lit("")), F.lit("Email triage fallback summary"))
    summary = F.trim(F.concat(F.coalesce(F.nullif(s, F.lit("")), F.lit("Email update")), F.lit(" — "), evidence), F.lit(" —"))
    return F.struct(ladder(text).alias("l"), short_text(summary, 180).alias("summary"))


def enriched(messages: DataFrame, model: Callable[[Column], Column] | None = None) -> DataFrame:
    """msg_id, category, importance, action, summary, model.  ``model``: prompt to JSON text; what it doesn't answer well falls back."""
    out = messages.withColumn("h", heuristic("subject", "snippet", "body_text"))
    plain = F.struct(F.col("h.l.category").alias("category"), F.col("h.l.importance").alias("importance"), F.col("h.l.action").alias("action"), F.col("h.summary").alias("summary"), F.lit(FALLBACK).alias("model"))
    if model is None:
        return out.withColumn("r", plain).select("msg_id", "r.*")
    answer = F.from_json(first_json(model(prompt("subject", "snippet", "body_text"))), "category string, importance string, action string, summary string")
    out = out.withColumn("a", answer)
    filled = enrich_filled(F.col("a.category"), F.col("a.action"), F.col("a.summary"), F.expr("try_cast(a.importance AS INT)"))
    good = F.coalesce(F.trim("a.category") != "", F.lit(False)) & F.coalesce(F.trim("a.summary") != "", F.lit(False))
    return out.withColumn("r", F.when(good, F.struct(filled["category"].alias("category"), filled["importance"].alias("importance"), filled["action"].alias("action"), filled["summary"].alias("summary"), F.lit("model").alias("model"))).otherwise(plain)).select("msg_id", "r.*")


def answered(messages: DataFrame, call: Callable[[str], str], repairs: int = 2, compact: int = 600) -> DataFrame:
    """``enriched`` by a service (prompt to answer): the full prompt, repairs of a bad answer, a prompt with a short body, keywords."""
    ask = json_answers(call, missing_text("category", "summary"), repairs)
    short = prompt("subject", "snippet", "body_text", compact)
    rows = messages.withColumn("answer", ask(prompt("subject", "snippet", "body_text"), short))
    return enriched(rows, lambda _: F.col("answer"))


def prompt(subject, snippet, body, cap: int = 4000) -> Column:
    """The message for a model, the body cut with a note."""
    body = F.coalesce(col(body), F.lit(""))
    cut = F.when(F.length(body) > cap, F.concat(F.substring(body, 1, cap), F.lit(" [truncated]"))).otherwise(body)
    return F.concat(F.lit("Subject: "), F.coalesce(col(subject), F.lit("")), F.lit("\nSnippet: "), F.coalesce(col(snippet), F.lit("")), F.lit("\nBody: "), cut)


def pending(messages: DataFrame, done: DataFrame, key: str, repair: bool = False) -> DataFrame:
    """Messages without an enrichment; with ``repair`` those with a fallback only, too."""
    if repair:
        done = done.filter(F.col("model") != FALLBACK)
    return messages.join(done, key, "left_anti")
