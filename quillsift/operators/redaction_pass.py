"""The whole redaction pass over messages and their chunks, redaction by a model in pieces, and the map as JSON."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import strip_code_fences
from .chunking import fixed
from .redaction import apply_entries, apply_udf, detected, model_pairs, placeholder_dictionary, regex_redact, validated, with_entries


def model_redacted(docs: DataFrame, model: Callable[[Column], Column], size: int = 4000, id_col: str = "msg_id", text_col: str = "text") -> DataFrame:
    """``docs`` with ``redacted``: pieces of ``size`` characters answered by ``model``, in order, code fences off; a piece
    without an answer (null) goes through the patterns.  A null or empty text is empty."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    pieces = docs.select(id_col, F.posexplode(fixed(text, size)).alias("at", "piece"))
    pieces = pieces.withColumn("said", model(F.col("piece")))
    answer = F.when(F.col("said").isNull(), regex_redact("piece")).otherwise(strip_code_fences("said"))
    pieces = pieces.select(id_col, "at", F.when(F.col("piece") == "", F.lit("")).otherwise(answer).alias("out"))
    whole = pieces.groupBy(id_col).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "out"))), lambda p: p["out"]), "").alias("redacted"))
    return docs.join(whole, id_col, "left")


def redact_pass(messages: DataFrame, chunks: DataFrame, scope: str = "account_email", existing: DataFrame | None = None, model: Callable[[Column], Column] | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(dictionary, messages with ``redacted``, chunks with ``redacted``).

    ``messages``: msg_id, text and the scope; ``chunks``: chunk_id, msg_id, chunk_text.  Candidates come from both, by the
    patterns and from ``model`` (a reply with redactions for a text); all pass the validators.  New values get ordinals
    after those of ``existing``.  A chunk is redacted with its message's values, cut ones at its ends too."""
    here = detected(messages.select("msg_id", "text"), "msg_id", "text").withColumn("part", F.lit(0))
    cut = detected(chunks.select("chunk_id", "chunk_text"), "chunk_id", "chunk_text").join(chunks.select("chunk_id", "msg_id"), "chunk_id")
    found = here.unionByName(cut.select("msg_id", "ordinal", "key_name", "value").withColumn("part", F.lit(1)))
    if model is not None:
        both = messages.select("msg_id", "text").unionByName(chunks.select("msg_id", F.col("chunk_text").alias("text")))
        said = both.select("msg_id", "text", F.posexplode(model_pairs(model(F.col("text")))).alias("ordinal", "p")).select("msg_id", "text", "ordinal", "p.key_name", "p.value")
        said = validated(said.filter(F.contains(F.lower("text"), F.lower("value"))), "text", strict=True)
        found = found.unionByName(said.drop("text").withColumn("part", F.lit(2)))
    found = found.join(messages.select("msg_id", scope), "msg_id")
    dictionary = placeholder_dictionary(found, scope, [F.col("msg_id"), F.col("part"), F.col("ordinal")], existing)
    own = with_entries(messages, dictionary, scope, found, "msg_id")
    of_chunks = chunks.join(own.select("msg_id", "entries"), "msg_id", "left")
    whole = lambda text, entries: apply_entries(text, entries)
    ends = lambda text, entries: apply_entries(text, entries, edges=True)
    done = own.withColumn("redacted", regex_redact(apply_udf(whole)(F.col("text"), F.col("entries")))).drop("entries")
    parts = of_chunks.withColumn("redacted", regex_redact(apply_udf(ends)(F.col("chunk_text"), F.col("entries")))).drop("entries")
    return dictionary, done, parts


def listed(entries: DataFrame, scope_id: str | None = None, status: str | None = None, limit: int = 200) -> DataFrame:
    """The redaction table for people: by scope, key and placeholder."""
    rows = entries if scope_id is None else entries.filter(F.col("scope_id") == scope_id)
    if status is not None:
        rows = rows.filter(F.coalesce("status", F.lit("active")) == status)
    return rows.orderBy("scope_id", "key_name", F.length("placeholder"), "placeholder").limit(limit)


def map_to_json(known: dict, scope_id: str | None = None) -> str:
    """The mapping redactor's map ({(kind, normal value): (placeholder, value)}) as JSON."""
    kinds = sorted({kind for kind, _ in known})
    by_kind = {kind: {norm: p for (k, norm), (p, _) in known.items() if k == kind} for kind in kinds}
    places = {p: (kind, value) for (kind, _), (p, value) in known.items()}
    out = {"scope_id": scope_id, "entity_to_placeholder": by_kind, "placeholder_to_entity": {p: v for p, (_, v) in places.items()}}
    out |= {"placeholder_to_category": {p: k for p, (k, _) in places.items()}, "category_counts": {k: len(m) for k, m in by_kind.items()}}
    return json.dumps(out, sort_keys=True, ensure_ascii=False)


def map_from_json(text: str | None) -> dict:
    """Back again; what has another form than a map of maps is left out."""
    try:
        data = json.loads(text or "{}")
    except ValueError:
        return {}
    section = lambda name: data.get(name) if isinstance(data, dict) and isinstance(data.get(name), dict) else {}
    values = section("placeholder_to_entity")
    maps = {str(kind): m for kind, m in section("entity_to_placeholder").items() if isinstance(m, dict)}
    return {(kind, str(norm)): (str(p), str(values.get(p, norm))) for kind, m in maps.items() for norm, p in m.items()}
