"""Labels, headers and the JSON contracts of model output."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import blank_to_null, col


def labels_upper(c) -> Column:
    """A JSON list of labels, upper case; an empty list for what isn't one."""
    return F.transform(F.coalesce(F.from_json(col(c), "array<string>"), F.array().cast("array<string>")), lambda x: F.upper(x))


def labels_text(labels) -> Column:
    return F.array_join(F.filter(F.transform(col(labels), lambda x: F.upper(F.trim(x))), lambda x: x != ""), " ")


def headers_map(headers) -> Column:
    """Header structs (name, value) to a map, names lower case, the last of a name wins, blank ones out."""
    clean = F.filter(F.transform(F.coalesce(col(headers), F.array().cast("array<struct<name:string,value:string>>")), lambda h: F.struct(F.lower(F.trim(h["name"])).alias("name"), F.trim(h["value"]).alias("value"))), lambda h: (h["name"] != "") & (h["value"] != ""))
    return F.aggregate(clean, F.create_map().cast("map<string,string>"), lambda m, h: F.map_concat(F.map_filter(m, lambda k, _: k != h["name"]), F.create_map(h["name"], h["value"])))


def enrich_issues(category, action, summary, importance) -> Column:
    """What a model's enrichment violates of its contract."""
    missing = lambda name, c: F.when(blank_to_null(c).isNull(), F.lit(f"{name} must be a non-empty string"))
    number = F.when(~F.coalesce(F.try_to_number(col(importance), F.lit("99")).between(1, 10), F.lit(False)), F.lit("importance must be an integer from 1 to 10"))
    return F.array_compact(F.array(missing("category", category), missing("action", action), missing("summary", summary), number))


def enrich_filled(category, action, summary, importance) -> Column:
    """The contract's defaults filled in, importance clamped."""
    n = F.coalesce(F.expr(f"try_cast({importance} AS INT)"), F.lit(4)) if isinstance(importance, str) else F.coalesce(importance.cast("int"), F.lit(4))
    return F.struct(
        F.coalesce(blank_to_null(category), F.lit("general")).alias("category"),
        F.least(F.lit(10), F.greatest(F.lit(1), n)).alias("importance"),
        F.coalesce(blank_to_null(action), F.lit("review")).alias("action"),
        F.coalesce(blank_to_null(summary), F.lit("")).alias("summary"),
    )


def profile_issues(profile: Column) -> Column:
    text = [F.when(blank_to_null(profile[k]).isNull(), F.lit(f"{k} must be a non-empty string")) for k in ("role", "tone", "relationship", "notes")]
    topics = F.filter(F.coalesce(profile["common_topics"], F.array().cast("array<string>")), lambda t: F.trim(t) != "")
    return F.array_compact(F.array(*text, F.when(F.size(topics) == 0, F.lit("common_topics must have an entry"))))


def profile_filled(profile: Column) -> Column:
    topics = F.filter(F.transform(F.coalesce(profile["common_topics"], F.array().cast("array<string>")), lambda t: F.trim(t)), lambda t: t != "")
    return F.struct(
        F.coalesce(blank_to_null(profile["role"]), F.lit("contact")).alias("role"),
        F.when(F.size(topics) > 0, topics).otherwise(F.array(F.lit("general"))).alias("common_topics"),
        *[F.coalesce(blank_to_null(profile[k]), F.lit("unknown")).alias(k) for k in ("tone", "relationship", "notes")],
    )


def evidence(items, cap: int = 10) -> Column:
    return F.slice(F.filter(F.transform(col(items), lambda x: F.trim(x)), lambda x: x != ""), 1, cap)


def with_meta(profile: Column, evidence_count, tier, source, message_count, updated_at) -> Column:
    meta = F.struct(col(evidence_count).cast("int").alias("evidence_count"), col(tier).alias("tier"), col(source).alias("source"), col(message_count).cast("int").alias("message_count_at_build"), col(updated_at).alias("updated_at"))
    return profile.withField("_meta", meta)


def existing_meta(profile, model) -> Column:
    """source, tier, evidence_count of a stored profile; what it doesn't say follows from whether a model made it."""
    own = lambda key: blank_to_null(F.get_json_object(col(profile), f"$._meta.{key}"))
    source = F.coalesce(own("source"), F.when(blank_to_null(model).isNull(), F.lit("heuristic")).otherwise(F.lit("llm")))
    tier = F.coalesce(own("tier"), F.when(source == "llm", F.lit("deep")).otherwise(F.lit("quick")))
    return F.struct(source.alias("source"), tier.alias("tier"), F.coalesce(own("evidence_count").try_cast("int"), F.lit(0)).alias("evidence_count"))


def json_keys(c) -> Column:
    return F.json_object_keys(col(c))


def first_json(c) -> Column:
    """The first balanced JSON object in free text: brackets aren't regular, so this one is an Arrow UDF."""
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(balanced_object, na_action="ignore")

    return F.pandas_udf(run, "string")(col(c))


def balanced_object(text: str) -> str | None:
    import json

    decoder, at = json.JSONDecoder(), text.find("{")
    while at >= 0:
        try:
            return text[at : decoder.raw_decode(text, at)[1]]
        except ValueError:
            at = text.find("{", at + 1)
    return None


def chat_text(c) -> Column:
    """The answer in a chat response: a string, parts with text, the reasoning, or a plain completion."""
    choice = lambda path: F.get_json_object(col(c), f"$.choices[0].{path}")
    content = choice("message.content")
    parts = F.array_join(F.from_json(F.get_json_object(col(c), "$.choices[0].message.content[*].text"), "array<string>"), "")
    return F.coalesce(F.when(content.startswith("["), parts).otherwise(blank_to_null(content)), blank_to_null(choice("message.reasoning_content")), choice("text"))
