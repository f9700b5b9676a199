"""Profiles of contacts: signal tiers, roles, selected samples, and when to build anew."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import col, has_any_keyword, local_part, sender_domain, starts_with_hint

# fixed values: addresses and phrases of automatic mail, and words that show a role
NO_REPLY = ("noreply", "no-reply", "do-not-reply", "donotreply", "newsletter", "mailer-daemon", "notifications", "beehiiv", "substack", "mailchimp", "list-manage")
NO_REPLY_TEXT = ("do not reply", "unsubscribe", "manage preferences", "view in browser")
LOW_SIGNAL = ("update", "updates", "news", "digest", "newsletter", "notify", "notifications", "alert", "alerts", "receipt", "receipts", "billing")
LOW_SIGNAL_TEXT = ("weekly update", "daily update", "unsubscribe", "manage preferences", "view in browser", "privacy policy")
ROLES = (
    ("landlord/property_manager", ("landlord", "property manager", "lease", "rent", "tenant", "apartment"), ()),
    ("bank", ("bank", "statement", "transaction", "checking", "savings", "credit card"), ("bank", "chase", "wellsfargo", "citi", "capitalone", "amex")),
    ("support", ("support ticket", "helpdesk", "customer support", "case #", "issue resolved"), ("support", "help", "zendesk", "freshdesk")),
    ("notification", ("noreply", "do not reply", "notification", "alert", "reminder", "receipt"), ("notifications", "mailer", "noreply")),
)


def contains_any(text: Column, phrases) -> Column:
    return text.rlike("|".join(rf"\Q{p}\E" for p in phrases))


def no_reply(email, text) -> Column:
    return contains_any(F.lower(col(email)), NO_REPLY) | contains_any(col(text), NO_REPLY_TEXT)


def low_signal(email, text) -> Column:
    return starts_with_hint(local_part(email), LOW_SIGNAL) | contains_any(col(text), LOW_SIGNAL_TEXT)


def role(email, text) -> Column:
    """``text``: lower case."""
    domain = F.coalesce(F.nullif(sender_domain(email), F.lit("")), F.lower(col(email)))
    out = None
    for name, words, domains in ROLES:
        hit = has_any_keyword(col(text), words)
        hit = hit | contains_any(domain, domains) if domains else hit
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out.otherwise("contact")


def signal(email, messages, inbound, outbound, text) -> Column:
    """Tier (deep or quick) and evidence count."""
    n, i, o = col(messages), col(inbound), col(outbound)
    deep = ~no_reply(email, text) & ((o > 0) | ((n >= 3) & ~low_signal(email, text)))
    evidence = F.when(i + o > 0, i + o).otherwise(F.greatest(F.lit(1), F.least(n, F.lit(3)))) + F.when(deep, 2).otherwise(0)
    return F.struct(F.when(deep, "deep").otherwise("quick").alias("tier"), evidence.cast("long").alias("evidence_count"))


def grown(old, new, old_tier, new_tier) -> Column:
    """Whether there is enough new evidence to build again."""
    o, n = col(old), col(new)
    return F.when(o <= 0, True).when((col(old_tier) == "quick") & (col(new_tier) == "deep"), True).when(n <= o, False).otherwise(n - o >= F.greatest(F.lit(3), F.ceil(o * 0.25)))


def keeps_better(old_source, new_source, old_tier, new_tier) -> Column:
    """A model's profile isn't replaced by a heuristic one, unless the tier rose."""
    return (col(old_source) == "llm") & (col(new_source) == "heuristic") & ~((col(old_tier) == "quick") & (col(new_tier) == "deep"))


def relevance(contact, sender, recipient, direct, body) -> Column:
    c, s, r = F.lower(col(contact)), F.lower(F.coalesce(col(sender), F.lit(""))), F.lower(F.coalesce(col(recipient), F.lit("")))
    points = ((F.contains(s, c) | F.contains(r, c), 20), (col(direct), 6), (s == c, 4), (r == c, 3), (F.trim(F.coalesce(col(body), F.lit(""))) != "", 1))
    return sum((F.when(F.coalesce(p, F.lit(False)), n).otherwise(0) for p, n in points), F.lit(0))


def newest(samples: DataFrame, key: str, order: list, k: int = 40) -> DataFrame:
    """The first ``k`` rows of each key (a window group limit: no key is sorted whole)."""
    return samples.withColumn("__n", F.row_number().over(Window.partitionBy(key).orderBy(*order))).filter(F.col("__n") <= k).drop("__n")


def expand_threads(direct: DataFrame, messages: DataFrame, contact: str = "contact", threads: int = 8) -> DataFrame:
    """Other messages of each contact's first threads, within the span of its own ones there (widened by itself, a day at least).

    ``direct``: contact, thread_id, msg_id, ts_ms, rank; ``messages``: thread_id, msg_id, ts_ms and more."""
    spans = direct.groupBy(contact, "thread_id").agg(F.min("rank").alias("r"), F.min("ts_ms").alias("lo"), F.max("ts_ms").alias("hi"))
    spans = spans.withColumn("nth", F.row_number().over(Window.partitionBy(contact).orderBy("r"))).filter(F.col("nth") <= threads)
    wide = F.greatest(F.lit(86_400_000), F.col("hi") - F.col("lo"))
    near = spans.select(contact, "thread_id", (F.col("lo") - wide).alias("lo"), (F.col("hi") + wide).alias("hi")).join(messages, "thread_id").filter(F.col("ts_ms").between(F.col("lo"), F.col("hi"))).drop("lo", "hi")
    return near.join(direct.select(contact, "msg_id"), [contact, "msg_id"], "left_anti")


def budgeted(items: Column, budget: int, count: int, cost) -> Column:
    """Of an ordered array, greedily what fits: an item that overflows is skipped, not the end."""
    start = F.struct(F.array().cast("array<int>").alias("taken"), F.lit(0).cast("long").alias("used"))
    at = F.transform(items, lambda x, i: F.struct(i.alias("i"), cost(x).cast("long").alias("c")))
    out = F.aggregate(at, start, lambda a, x: F.when((a["used"] + x["c"] <= budget) & (F.size(a["taken"]) < count), F.struct(F.concat(a["taken"], F.array(x["i"])).alias("taken"), (a["used"] + x["c"]).alias("used"))).otherwise(a))
    return F.transform(out["taken"], lambda i: F.get(items, i))


def profile(rows: DataFrame) -> DataFrame:
    """Heuristic profiles.  ``rows``: contact_email, display_name, message_count, inbound, outbound, subjects, domains (arrays), text."""
    rows = rows.withColumn("signal", signal("contact_email", "message_count", "inbound", "outbound", "text")).withColumn("role", role("contact_email", "text"))
    quick = F.col("signal.tier") == "quick"
    words = F.filter(F.transform("subjects", lambda s: F.lower(F.split(s, " ")[0])), lambda w: w != "")
    topics = F.slice(F.array_sort(F.array_distinct(words)), F.lit(1), F.when(quick, 3).otherwise(5))
    label = F.when(quick, "low-signal email contact").otherwise("email contact")
    notes = F.format_string("messages=%d, domains=%s, heuristic_role=%s, tier=%s, inbound=%d, outbound=%d", "message_count", F.array_join(F.array_sort(F.array_distinct("domains")), ";"), "role", F.col("signal.tier"), "inbound", "outbound")
    return rows.select("contact_email", "role", topics.alias("common_topics"), F.lit("unknown").alias("tone"), F.concat(label, F.lit(" ("), F.coalesce("display_name", "contact_email"), F.lit(")")).alias("relationship"), notes.alias("notes"), "signal.*")


def first_seen_distinct(items: Column, within: int = 12, cap: int = 6) -> Column:
    return F.slice(F.array_distinct(F.slice(items, 1, within)), 1, cap)


def bounded_lines(lines: DataFrame, key: str, order: list, budget: int = 6000) -> DataFrame:
    """Lines in order while their lengths fit; the first is cut to fit if it must be."""
    w = Window.partitionBy(key).orderBy(*order)
    upto = F.sum(F.length("line")).over(w.rowsBetween(Window.unboundedPreceding, 0))
    out = lines.withColumns({"__upto": upto, "__nth": F.row_number().over(w)})
    return out.filter((F.col("__upto") <= budget) | (F.col("__nth") == 1)).withColumn("line", F.substring("line", 1, budget)).drop("__upto", "__nth")
