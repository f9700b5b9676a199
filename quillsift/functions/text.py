"""String functions as Column builders: no Python on the executors."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space, spelled out: the engines differ in what \\s means beyond it.
WS = r"[ \t\n\x0B\f\r]"
#: Accented Latin letters and what they fold to, for the tokenizer.
ACCENTED = "àáâãäåçèéêëìíîïñòóôõöùúûüýÿÀÁÂÃÄÅÇÈÉÊËÌÍÎÏÑÒÓÔÕÖÙÚÛÜÝ"
FOLDED = "aaaaaaceeeeiiiinooooouuuuyyAAAAAACEEEEIIIINOOOOOUUUUY"


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def blank_to_null(c) -> Column:
    return F.nullif(F.trim(col(c)), F.lit(""))


def collapse(c) -> Column:
    """Runs of white space to one space, trimmed."""
    return F.trim(F.regexp_replace(col(c), WS + "+", " "))


def compose_source_text(subject, snippet, body) -> Column:
    """Subject, snippet and body under their names, a line each, absent ones left out."""
    part = lambda name, c: F.when(F.coalesce(col(c), F.lit("")) != "", F.concat(F.lit(f"{name}: "), col(c)))
    return F.trim(F.concat_ws("\n", part("Subject", subject), part("Snippet", snippet), part("Body", body)))


def normalize_for_indexing(c, cap: int = 20_000) -> Column:
    """Zero-width characters out, white space collapsed, cut at ``cap`` characters without a trailing space."""
    plain = F.regexp_replace(F.coalesce(col(c), F.lit("")), "[​‌‍⁠﻿]", "")
    return F.rtrim(F.substring(collapse(plain), 1, cap))


def snippet(c, cap: int = 220) -> Column:
    flat = F.trim(F.replace(F.coalesce(col(c), F.lit("")), F.lit("\n"), F.lit(" ")))
    return F.when(F.length(flat) > cap, F.concat(F.substring(flat, 1, cap), F.lit("…"))).otherwise(flat)


def short_text(c, cap: int = 140) -> Column:
    """Newlines to spaces; beyond ``cap`` characters, cut with an ellipsis that counts."""
    flat = F.trim(F.replace(F.coalesce(col(c), F.lit("")), F.lit("\n"), F.lit(" ")))
    return F.when(F.length(flat) <= cap, flat).otherwise(F.concat(F.rtrim(F.substring(flat, 1, max(1, cap - 1))), F.lit("…")))


def truncate(c, cap: int) -> Column:
    """White space collapsed; beyond ``cap`` characters, cut with three dots that count (caps of 3 and less: cut only)."""
    flat = collapse(F.coalesce(col(c), F.lit("")))
    cut = F.substring(flat, 1, cap) if cap <= 3 else F.concat(F.rtrim(F.substring(flat, 1, cap - 3)), F.lit("..."))
    return F.when(F.length(flat) <= cap, flat).otherwise(cut)


# fixed values: prefixes of replies, and what changes from mail to mail in a subject
SUBJECT_PREFIX = r"^(?:(?:re|fw|fwd)\s*:\s*)+"
SUBJECT_NOISE = r"\b(?:\d{1,4}[-/]\d{1,2}[-/]\d{1,4}|\d{1,2}:\d{2}(?::\d{2})?|\d{5,}|[a-f0-9]{8,})\b"


def subject_family(c) -> Column:
    """The subject without reply prefixes, dates, times, numbers, hex and punctuation."""
    base = F.regexp_replace(F.lower(F.trim(F.coalesce(col(c), F.lit("")))), SUBJECT_PREFIX, "")
    words = F.trim(F.regexp_replace(F.regexp_replace(base, SUBJECT_NOISE, " "), "[^a-z0-9]+", " "))
    return F.coalesce(F.nullif(words, F.lit("")), F.lit("no subject"))


def sender_domain(c) -> Column:
    address = F.lower(F.trim(F.coalesce(col(c), F.lit(""))))
    return F.when(F.contains(address, F.lit("@")), F.substring_index(address, "@", -1)).otherwise(F.lit(""))


def local_part(c) -> Column:
    address = F.lower(F.trim(F.coalesce(col(c), F.lit(""))))
    return F.substring_index(address, "@", 1)


def unsubscribe_host(c) -> Column:
    """Host (with its port) of the first address of a List-Unsubscribe header that has one."""
    parts = F.transform(F.split(F.coalesce(col(c), F.lit("")), ","), lambda x: F.regexp_replace(F.trim(x), "^<|>$", ""))
    hosts = F.transform(parts, lambda x: F.lower(F.try_parse_url(F.when(x.rlike("^[a-zA-Z]+://"), x), F.lit("AUTHORITY"))))
    return F.coalesce(F.get(F.filter(hosts, lambda h: h.isNotNull() & (h != "")), 0), F.lit(""))


def url_host(c) -> Column:
    return F.lower(F.regexp_extract(col(c), "^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)", 1))


def keyword_hits(c, keywords: tuple[str, ...]) -> Column:
    """The keywords that the lower-cased text contains, in their order."""
    text = F.lower(col(c))
    return F.filter(F.array(*[F.lit(k) for k in keywords]), lambda k: F.contains(text, k))


def has_keyword(text: Column, keyword: str) -> Column:
    """Containment for phrases, whole words for single words; ``text`` is lower case."""
    k = keyword.strip().lower()
    if not k:
        return F.lit(False)
    if any(x in k for x in " -#"):
        return F.contains(text, F.lit(k))
    return text.rlike(rf"\b\Q{k}\E\b")


def has_any_keyword(text: Column, keywords) -> Column:
    out = F.lit(False)
    for k in keywords:
        out = out | has_keyword(text, k)
    return out


def starts_with_hint(c: Column, hints) -> Column:
    """The text is a hint, or starts with one and a dot or hyphen."""
    return c.rlike("^(?:" + "|".join(hints) + ")(?:[.-].*)?$")


def html_to_text(c) -> Column:
    """Scripts, styles and comments out, tags to newlines, basic references decoded, blank lines dropped.  (For main text
    without page furniture there is an operator of its own.)"""
    text = F.regexp_replace(F.coalesce(col(c), F.lit("")), r"(?is)<(?:script|style)[^>]*>.*?</(?:script|style)>", "")
    text = F.regexp_replace(F.regexp_replace(text, r"(?s)<!--.*?-->", ""), r"(?s)<[^>]*>", "\n")
    text = unescape_html(text)
    return F.trim(F.regexp_replace(F.regexp_replace(text, r"[ \t\r\f]+", " "), r" ?\n[ \n]*", "\n"), F.lit("\n "))


# fixed values: the references that mail snippets use
REFERENCES = (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&apos;", "'"), ("&nbsp;", " "), ("&copy;", "©"), ("&middot;", "·"), ("&amp;", "&"))


def unescape_html(c) -> Column:
    out = col(c)
    for ref, char in REFERENCES:
        out = F.replace(out, F.lit(ref), F.lit(char))
    return out


def strip_code_fences(c) -> Column:
    text = F.trim(F.coalesce(col(c), F.lit("")))
    inner = F.regexp_replace(F.regexp_replace(text, r"^```[a-zA-Z0-9_-]*\n?", ""), r"\n?```$", "")
    return F.trim(F.when(text.startswith("```"), inner).otherwise(text))


def key_name(c) -> Column:
    clean = F.trim(F.regexp_replace(F.upper(F.trim(F.coalesce(col(c), F.lit("")))), "[^A-Za-z0-9]+", "_"), F.lit("_"))
    return F.coalesce(F.nullif(clean, F.lit("")), F.lit("CUSTOM"))


def digits(c) -> Column:
    return F.regexp_replace(col(c), r"[^0-9]", "")


def normalize_value(key, value) -> Column:
    """What two spellings of one sensitive value have in common."""
    v = F.trim(F.coalesce(col(value), F.lit("")))
    phone = F.regexp_replace(digits(v), "^1([0-9]{10})$", "$1")
    return F.when(col(key) == "PHONE", phone).when(col(key).isin("URL", "EMAIL"), F.regexp_replace(F.lower(v), "/+$", "")).otherwise(F.lower(collapse(v)))


# fixed values: delimiters that may wrap a value
WRAPPERS = (('"', '"'), ("'", "'"), ("`", "`"), ("[", "]"), ("{", "}"), ("(", ")"))


def unwrap(c, depth: int = 4) -> Column:
    """White space collapsed and up to ``depth`` pairs of delimiters taken off."""
    out = collapse(F.coalesce(col(c), F.lit("")))
    pattern = "|".join(f"(?:\\{a}.*\\{b})" for a, b in WRAPPERS)
    for _ in range(depth):
        inner = F.trim(out.substr(F.lit(2), F.length(out) - 2))
        out = F.when((F.length(out) >= 2) & out.rlike(f"(?s)^(?:{pattern})$") & (inner != ""), inner).otherwise(out)
    return out


def labels_from_options(c) -> Column:
    """Repeated, comma-separated label options to one list, upper case."""
    parts = F.flatten(F.transform(col(c), lambda x: F.split(x, ",")))
    return F.array_distinct(F.filter(F.transform(parts, lambda x: F.upper(F.trim(x))), lambda x: x != ""))


def without_time_terms(c) -> Column:
    """A mailbox query without its before:, after:, older: and newer: terms."""
    return collapse(F.regexp_replace(F.coalesce(col(c), F.lit("")), r"(?i)\b(?:before|after|older|newer|older_than|newer_than):\S+", " "))


def embedding_text(c) -> Column:
    return collapse(F.coalesce(col(c), F.lit("")))


def shrink_at_word(c, share: float = 0.6) -> Column:
    """The first ``share`` of a text, back to the last word boundary if there is one."""
    cut = F.substring(col(c), F.lit(1), F.greatest(F.lit(1), F.floor(F.length(col(c)) * share)).cast("int"))
    head = F.regexp_extract(cut, r"(?s)^(.*)\s", 1)
    return F.when(head != "", head).otherwise(cut)


def token_estimate(c) -> Column:
    """Tokens a model may see: a quarter of the characters, the words and signs, or more for text without spaces."""
    t = F.coalesce(col(c), F.lit(""))
    n = F.length(t)
    dense = F.when((t != "") & ~F.contains(t, F.lit(" ")), F.ceil(n / 1.5)).otherwise(F.lit(0))
    return F.greatest(F.lit(1), F.ceil(n / 4), F.regexp_count(t, F.lit(r"[A-Za-z0-9_]+|[^A-Za-z0-9_ \t\n\x0B\f\r]")), dense).cast("long")


def ordinal_letters(n) -> Column:
    """1 to A, 26 to Z, 27 to AA: bijective base 26 (up to six letters)."""
    n = col(n).cast("long")
    out = F.lit("")
    rest = n
    for _ in range(6):
        letter = F.char(65 + (rest - 1) % 26)
        out = F.when(rest > 0, F.concat(letter, out)).otherwise(out)
        rest = F.when(rest > 0, F.floor((rest - 1) / 26)).otherwise(F.lit(0).cast("long"))
    return out


def letters_ordinal(c) -> Column:
    """The inverse of ``ordinal_letters``."""
    return F.aggregate(F.split(col(c), ""), F.lit(0).cast("long"), lambda a, x: F.when(x == "", a).otherwise(a * 26 + F.ascii(x) - 64))


def line_before(text: Column, start: Column) -> Column:
    """What stands on the line before the 0-based position ``start``, tags taken out."""
    return F.regexp_replace(F.substring_index(F.substring(text, F.lit(1), start), "\n", -1), "<[^>]+>", "")


# fixed values: extensions of common MIME types
EXTENSIONS = {
    "application/json": ".json", "application/msword": ".doc", "application/pdf": ".pdf", "application/zip": ".zip", "image/gif": ".gif", "image/jpeg": ".jpg", "image/png": ".png",
    "text/calendar": ".ics", "text/csv": ".csv", "text/html": ".html", "text/plain": ".txt",
}


def safe_extension(filename, mime) -> Column:
    """A short plain extension of the file name, else the MIME type's, else .bin."""
    own = F.lower(F.regexp_extract(F.coalesce(col(filename), F.lit("")), r"(\.[A-Za-z0-9]{1,10})$", 1))
    table = F.create_map(*[F.lit(x) for kv in EXTENSIONS.items() for x in kv])
    return F.coalesce(F.nullif(own, F.lit("")), table[F.lower(F.coalesce(col(mime), F.lit("")))], F.lit(".bin"))


def fold_accents(c) -> Column:
    return F.translate(col(c), ACCENTED, FOLDED)


def tokens(c) -> Column:
    """Lower-case runs of letters and digits, accents folded."""
    return F.regexp_extract_all(F.lower(fold_accents(F.coalesce(col(c), F.lit("")))), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))
