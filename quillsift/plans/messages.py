"""Queries over documents, conversations and contacts as messages, with their DuckDB counterparts.

documents stand for messages (doc_id: msg_id, source: account, lang: label, first line: subject), conversations for
threads (turn: time), embeddings for vectors, customers and orders for contacts."""

from __future__ import annotations

import tempfile
import uuid

import pandas as pd
from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.hashing import content_hash, policy_hash
from ..functions.progress import eta_minutes as eta
from ..operators import attachments, chunking, enrichment, evals, profiles, redaction, redaction_pass, search, search_index, status, views
from ..functions.jsons import enrich_issues
from .catalog import register

NOW_MS = 1_800_000_000_000


def table(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def docs(spark, sf_dir, *columns):
    d = table(spark, sf_dir, "documents")
    return d.select(*columns) if columns else d


def subject(c="text"):
    return F.substring_index(F.col(c), "\n", 1)


@register("latest_by_source", "SELECT doc_id, n_chars FROM documents WHERE source = 'src3' ORDER BY n_chars DESC, doc_id LIMIT 10")
def latest_by_source(spark, sf_dir):
    return views.latest(docs(spark, sf_dir).filter(F.col("source") == "src3"), 10, "n_chars", "doc_id").select("doc_id", "n_chars")


@register("label_filter", "SELECT doc_id, lang, source FROM documents WHERE list_has_any([upper(lang), upper(source)], ['EN', 'SRC4']) AND NOT list_has_any([upper(lang), upper(source)], ['SRC1', 'ES'])")
def label_filter(spark, sf_dir):
    return docs(spark, sf_dir, "doc_id", "lang", "source").filter(views.labelled(F.array("lang", "source"), ("en", "src4"), ("SRC1", "es")))


@register("lexical_label_after_limit", """WITH top AS (SELECT doc_id, lang, n_chars FROM documents ORDER BY n_chars DESC, doc_id LIMIT 50) SELECT doc_id, n_chars FROM top WHERE upper(lang) = 'FR'""")
def lexical_label_after_limit(spark, sf_dir):
    """The variant that filters what a limit has left, so fewer rows may come back."""
    return views.latest(docs(spark, sf_dir, "doc_id", "lang", "n_chars"), 50, "n_chars", "doc_id").filter(F.upper("lang") == "FR").select("doc_id", "n_chars")


@register("point_lookup", "SELECT doc_id, lang, source, n_chars FROM documents WHERE doc_id = 42 LIMIT 1")
def point_lookup(spark, sf_dir):
    return docs(spark, sf_dir, "doc_id", "lang", "source", "n_chars").filter("doc_id = 42").limit(1)


@register("in_list", "SELECT doc_id, source FROM documents WHERE doc_id IN (1, 5, 17, 99, 100000)")
def in_list(spark, sf_dir):
    return docs(spark, sf_dir, "doc_id", "source").filter(F.col("doc_id").isin(1, 5, 17, 99, 100000))


@register("allow_list_semi", "SELECT doc_id, lang FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1)")
def allow_list_semi(spark, sf_dir):
    return docs(spark, sf_dir, "doc_id", "lang").join(table(spark, sf_dir, "labels").filter("toxic = 1"), "doc_id", "left_semi")


@register("substring_search", "SELECT c_custkey, c_name FROM customer WHERE contains(lower(c_name), '00001') OR contains(lower(c_mktsegment), 'auto') ORDER BY c_acctbal DESC, c_custkey LIMIT 25")
def substring_search(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    return c.filter(F.contains(F.lower("c_name"), F.lit("00001")) | F.contains(F.lower("c_mktsegment"), F.lit("auto"))).orderBy(F.desc("c_acctbal"), "c_custkey").limit(25).select("c_custkey", "c_name")


@register("pending_enrichment_anti", "SELECT doc_id FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)")
def pending_enrichment_anti(spark, sf_dir):
    done = table(spark, sf_dir, "labels").withColumn("model", F.lit("model"))
    return enrichment.pending(docs(spark, sf_dir, "doc_id"), done, "doc_id")


@register("degraded_or_pending", "SELECT d.doc_id FROM documents d LEFT JOIN labels l USING (doc_id) WHERE l.doc_id IS NULL OR l.quality = 0")
def degraded_or_pending(spark, sf_dir):
    done = table(spark, sf_dir, "labels").withColumn("model", F.when(F.col("quality") == 0, enrichment.FALLBACK).otherwise("model"))
    return enrichment.pending(docs(spark, sf_dir, "doc_id"), done, "doc_id", repair=True)


@register("stats_left_profiles", """SELECT c_custkey, c_name, CAST(coalesce(n, 0) AS BIGINT) AS orders, round(coalesce(total, 0), 2) AS total FROM customer LEFT JOIN
(SELECT o_custkey, count(*) AS n, sum(o_totalprice) AS total FROM orders GROUP BY 1) ON c_custkey = o_custkey""")
def stats_left_profiles(spark, sf_dir):
    o = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"), F.sum("o_totalprice").alias("total"))
    return table(spark, sf_dir, "customer").join(o, F.col("c_custkey") == F.col("o_custkey"), "left").select("c_custkey", "c_name", F.coalesce("n", F.lit(0)).alias("orders"), F.round(F.coalesce("total", F.lit(0.0)), 2).alias("total"))


@register("thread_expansion", """WITH direct AS (SELECT conv_id, turn FROM conversations WHERE role = 'user'),
span AS (SELECT conv_id, min(turn) AS lo, max(turn) AS hi FROM direct GROUP BY 1)
SELECT c.conv_id, c.turn, c.role FROM conversations c JOIN span s USING (conv_id) WHERE c.turn BETWEEN s.lo - greatest(1, s.hi - s.lo) AND s.hi + greatest(1, s.hi - s.lo)
AND NOT EXISTS (SELECT 1 FROM direct d WHERE d.conv_id = c.conv_id AND d.turn = c.turn)""")
def thread_expansion(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    direct = c.filter("role = 'user'").select("conv_id", "turn")
    span = direct.groupBy("conv_id").agg(F.min("turn").alias("lo"), F.max("turn").alias("hi"))
    wide = F.greatest(F.lit(1), F.col("hi") - F.col("lo"))
    near = c.join(span, "conv_id").filter(F.col("turn").between(F.col("lo") - wide, F.col("hi") + wide))
    return near.join(direct, ["conv_id", "turn"], "left_anti").select("conv_id", "turn", "role")


@register("tier_histogram", "SELECT coalesce(CAST(quality AS VARCHAR), 'none') AS tier, count(*) AS n FROM documents LEFT JOIN labels USING (doc_id) GROUP BY 1")
def tier_histogram(spark, sf_dir):
    d = docs(spark, sf_dir, "doc_id").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    return d.groupBy(F.coalesce(F.col("quality").cast("string"), F.lit("none")).alias("tier")).agg(F.count(F.lit(1)).alias("n"))


@register("distinct_count", "SELECT count(DISTINCT text) AS texts, count(DISTINCT source) AS sources, count(*) AS rows FROM documents")
def distinct_count(spark, sf_dir):
    return docs(spark, sf_dir, "text", "source").agg(F.countDistinct(F.sha2("text", 256)).alias("texts"), F.countDistinct("source").alias("sources"), F.count(F.lit(1)).alias("rows"))


@register("level_counts", """SELECT coalesce(a.lang, b.lang) AS level, coalesce(a.n, 0) AS messages, coalesce(b.n, 0) AS chunks FROM (SELECT lang, count(*) AS n FROM documents WHERE n_chars > 200 GROUP BY 1) a
FULL JOIN (SELECT lang, CAST(sum(1 + (n_chars - 1) // 900) AS BIGINT) AS n FROM documents WHERE n_chars > 0 GROUP BY 1) b USING (lang)""")
def level_counts(spark, sf_dir):
    d = docs(spark, sf_dir, "lang", "n_chars")
    a = d.filter("n_chars > 200").groupBy("lang").agg(F.count(F.lit(1)).alias("m"))
    b = d.filter("n_chars > 0").groupBy("lang").agg(F.sum(F.expr("1 + (n_chars - 1) DIV 900")).cast("long").alias("c"))
    return a.join(b, "lang", "full").select(F.col("lang").alias("level"), F.coalesce("m", F.lit(0)).alias("messages"), F.coalesce("c", F.lit(0)).alias("chunks"))


@register("policy_status_pivot", "SELECT 'v' || quality AS policy_version, count(*) FILTER (toxic = 0) AS active, count(*) FILTER (toxic = 1) AS rejected FROM labels GROUP BY 1")
def policy_status_pivot(spark, sf_dir):
    rows = table(spark, sf_dir, "labels").select(F.concat(F.lit("v"), F.col("quality").cast("string")).alias("policy_version"), F.when(F.col("toxic") == 1, "rejected").otherwise("active").alias("status"))
    return status.policy_pivot(rows)


@register("directional_counts", "SELECT conv_id, count(*) FILTER (role = 'user') AS inbound, count(*) FILTER (role <> 'user') AS outbound, count(*) AS n FROM conversations GROUP BY 1")
def directional_counts(spark, sf_dir):
    return table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.count_if(F.col("role") == "user").alias("inbound"), F.count_if(F.col("role") != "user").alias("outbound"), F.count(F.lit(1)).alias("n"))


@register("account_summary", "SELECT source, count(*) AS n, min(n_chars) AS least, max(n_chars) AS most FROM documents GROUP BY 1")
def account_summary(spark, sf_dir):
    return docs(spark, sf_dir, "source", "n_chars").groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.min("n_chars").alias("least"), F.max("n_chars").alias("most"))


@register("normalize_text", "SELECT doc_id, rtrim(substr(trim(regexp_replace(text, '[ \\t\\n\\x0B\\f\\r]+', ' ', 'g')), 1, 20000)) AS body FROM documents")
def normalize_text(spark, sf_dir):
    return docs(spark, sf_dir, "doc_id", "text").select("doc_id", T.normalize_for_indexing("text").alias("body"))


@register("compose_source_text", "SELECT doc_id, trim(concat_ws(chr(10), CASE WHEN split_part(text, chr(10), 1) <> '' THEN 'Subject: ' || split_part(text, chr(10), 1) END, CASE WHEN text <> '' THEN 'Body: ' || text END)) AS source_text FROM documents")
def compose_source_text(spark, sf_dir):
    return docs(spark, sf_dir, "doc_id", "text").select("doc_id", T.compose_source_text(subject(), F.lit(None).cast("string"), "text").alias("source_text"))


FLAT = "trim(replace(text, chr(10), ' '))"


@register("short_texts", f"""SELECT doc_id, CASE WHEN length({FLAT}) <= 140 THEN {FLAT} ELSE rtrim(substr({FLAT}, 1, 139)) || '…' END AS short, CASE WHEN length({FLAT}) > 220 THEN substr({FLAT}, 1, 220) || '…' ELSE {FLAT} END AS snippet FROM documents""")
def short_texts(spark, sf_dir):
    return docs(spark, sf_dir, "doc_id", "text").select("doc_id", T.short_text("text").alias("short"), T.snippet("text").alias("snippet"))


@register("subject_family", r"""WITH s AS (SELECT doc_id, regexp_replace(lower(trim(split_part(text, chr(10), 1))), '^(?:(?:re|fw|fwd)\s*:\s*)+', '') AS s FROM documents)
SELECT doc_id, coalesce(nullif(trim(regexp_replace(regexp_replace(s, '\b(?:\d{1,4}[-/]\d{1,2}[-/]\d{1,4}|\d{1,2}:\d{2}(?::\d{2})?|\d{5,}|[a-f0-9]{8,})\b', ' ', 'g'), '[^a-z0-9]+', ' ', 'g')), ''), 'no subject') AS family FROM s""")
def subject_family(spark, sf_dir):
    return docs(spark, sf_dir, "doc_id", "text").select("doc_id", T.subject_family(subject()).alias("family"))


@register("url_host", "SELECT page_id, lower(regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)', 1)) AS host FROM pages")
def url_host(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", T.url_host("url").alias("host"))


@register("html_to_text")
def html_to_text(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", T.html_to_text("html").alias("text"))


@register("content_hash", """SELECT doc_id, sha256(text) AS content_hash, sha256('{"index_level": "redacted", "redaction_policy_version": "2026-03-22-precision-2", "source_hash": "' || sha256(text) || '"}') AS policy_hash FROM documents""")
def content_hash_query(spark, sf_dir):
    return docs(spark, sf_dir, "doc_id", "text").select("doc_id", content_hash("text").alias("content_hash"), policy_hash("redacted", redaction.POLICY, "text").alias("policy_hash"))


@register("chunk_overlap", r"""WITH d AS (SELECT doc_id, trim(text) AS t FROM documents), w AS (SELECT doc_id, t, unnest(range(0, 1 + greatest(0, CAST(ceil((length(t) - 900) / 750.0) AS BIGINT)))) * 750 AS chunk_start FROM d WHERE length(t) > 0)
SELECT doc_id, CAST(chunk_start AS INT) AS chunk_start, CAST(least(length(t), chunk_start + 900) AS INT) AS chunk_end, trim(substr(t, chunk_start + 1, 900)) AS chunk_text FROM w WHERE trim(substr(t, chunk_start + 1, 900)) <> ''""")
def chunk_overlap(spark, sf_dir):
    w = docs(spark, sf_dir, "doc_id", "text").select("doc_id", F.explode(chunking.overlapping("text")).alias("w"))
    return w.select("doc_id", F.col("w.start").alias("chunk_start"), F.col("w.end").alias("chunk_end"), F.col("w.text").alias("chunk_text"))


@register("chunk_fixed", "SELECT doc_id, CAST(i AS INT) AS piece, substr(text, i * 1000 + 1, 1000) AS piece_text FROM (SELECT doc_id, text, unnest(range(0, greatest(1, CAST(ceil(length(text) / 1000.0) AS BIGINT)))) AS i FROM documents)")
def chunk_fixed(spark, sf_dir):
    return docs(spark, sf_dir, "doc_id", "text").select("doc_id", F.posexplode(chunking.fixed("text", 1000)).alias("piece", "piece_text"))


@register("message_chunks")
def message_chunks(spark, sf_dir):
    m = docs(spark, sf_dir, "doc_id", "text").select(F.col("doc_id").alias("msg_id"), subject().alias("subject"), F.col("text").alias("body_text"))
    return chunking.message_chunks(m)


REDACT = "text"
for _kind, _pattern in redaction.PATTERNS:
    _flags = "gi" if _pattern.startswith("(?i)") else "g"
    REDACT = f"regexp_replace({REDACT}, '{_pattern.removeprefix('(?i)')}', '[REDACTED_{_kind}]', '{_flags}')"


@register("regex_redact", f"SELECT doc_id, {REDACT} AS redacted FROM documents")
def regex_redact(spark, sf_dir):
    return docs(spark, sf_dir, "doc_id", "text").select("doc_id", redaction.regex_redact("text").alias("redacted"))


@register("changed_by_redaction", f"SELECT doc_id FROM documents WHERE text <> {REDACT}")
def changed_by_redaction(spark, sf_dir):
    return views.changed(docs(spark, sf_dir, "doc_id", "text").withColumn("r", redaction.regex_redact("text")), "text", "r").select("doc_id")


PII = " UNION ALL ".join(
    f"SELECT doc_id, '{k}' AS key_name, {n} AS pattern, trim(unnest(regexp_extract_all(text, '{p.removeprefix('(?i)')}', 0, '{'i' if p.startswith('(?i)') else 'c'}'))) AS value FROM documents" for n, (k, p) in enumerate(redaction.PATTERNS)
)


@register("pii_candidates", PII)
def pii_candidates(spark, sf_dir):
    return redaction.pii_candidates(docs(spark, sf_dir, "doc_id", "text")).drop("ordinal")


def found_emails(spark, sf_dir):
    d = docs(spark, sf_dir, "doc_id", "text", "source")
    return redaction.pii_candidates(d).filter("key_name IN ('EMAIL', 'URL')").join(d.select("doc_id", "source"), "doc_id")


@register("placeholder_dictionary", f"""WITH c AS ({PII}), v AS (SELECT source, key_name, regexp_replace(lower(value), '/+$', '') AS value_norm, min(doc_id) AS first_doc, count(*) AS hit_count FROM c JOIN documents USING (doc_id)
WHERE key_name IN ('EMAIL', 'URL') GROUP BY 1, 2, 3),
n AS (SELECT *, row_number() OVER (PARTITION BY source, key_name ORDER BY first_doc, value_norm) AS i FROM v)
SELECT source, key_name, value_norm, '<REDACTED_' || key_name || '_' || CASE WHEN i > 26 THEN chr(CAST(64 + (i - 1) // 26 AS INT)) ELSE '' END || chr(CAST(65 + (i - 1) % 26 AS INT)) || '>' AS placeholder, hit_count FROM n""")
def placeholder_dictionary(spark, sf_dir):
    found = found_emails(spark, sf_dir)
    order = [F.col("doc_id"), T.normalize_value("key_name", "value").alias("nv")]
    return redaction.placeholder_dictionary(found, "source", order).drop("original_value")


@register("unredact_roundtrip")
def unredact_roundtrip(spark, sf_dir):
    """Documents with dictionary values: redacted, and whether the placeholders restore what was there (case aside)."""
    d, found = docs(spark, sf_dir, "doc_id", "text", "source"), found_emails(spark, sf_dir)
    dictionary = redaction.placeholder_dictionary(found, "source", [F.col("doc_id"), F.col("ordinal")])
    rows = redaction.with_entries(d, dictionary, "source", found, "doc_id").filter("entries IS NOT NULL")
    rows = rows.withColumn("redacted", redaction.apply_udf(redaction.apply_entries)(F.col("text"), F.col("entries")))
    rows = redaction.unredacted(rows, "redacted")
    return rows.select("doc_id", F.size("entries").alias("entries"), (F.lower("restored") == F.lower("text")).alias("restored"), F.contains("redacted", F.lit("<REDACTED_")).alias("has_placeholder"))


@register("validated_candidates")
def validated_candidates(spark, sf_dir):
    return redaction.detected(docs(spark, sf_dir, "doc_id", "text"))


@register("deterministic_map_redact")
def deterministic_map_redact(spark, sf_dir):
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: redaction.map_redact(t)[0])

    return docs(spark, sf_dir, "doc_id", "text").select("doc_id", F.pandas_udf(run, "string")("text").alias("redacted"))


WORDS = "regexp_extract_all(lower(translate(text, 'àáâãäåçèéêëìíîïñòóôõöùúûüýÿÀÁÂÃÄÅÇÈÉÊËÌÍÎÏÑÒÓÔÕÖÙÚÛÜÝ', 'aaaaaaceeeeiiiinooooouuuuyyAAAAAACEEEEIIIINOOOOOUUUUY')), '[\\p{L}\\p{N}]+')"
TERMS = ("the", "thanedble", "leaux", "schtz")
BM25 = f"""w AS (SELECT doc_id, {WORDS} AS w FROM documents), s AS (SELECT count(*) AS n, avg(len(w)) AS avgdl FROM w),
t AS (SELECT doc_id, dl, term, count(*) AS tf FROM (SELECT doc_id, len(w) AS dl, unnest(w) AS term FROM w) WHERE term IN {TERMS} GROUP BY ALL),
d AS (SELECT term, count(*) AS df FROM t GROUP BY 1),
bm AS (SELECT doc_id AS id, sum(greatest(1e-6, ln((n - df + 0.5) / (df + 0.5))) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))) AS score FROM t JOIN d USING (term), s GROUP BY 1)"""


@register("bm25_topk", f"WITH {BM25} SELECT id, round(score, 6) AS score FROM bm ORDER BY bm.score DESC, id LIMIT 20")
def bm25_topk(spark, sf_dir):
    return search.bm25(docs(spark, sf_dir, "doc_id", "text"), list(TERMS)).orderBy(F.desc("score"), "id").limit(20).select("id", F.round("score", 6).alias("score"))


@register("phrase_match", f"SELECT doc_id AS id FROM documents WHERE contains(' ' || array_to_string({WORDS}, ' ') || ' ', ' of the ')")
def phrase_match(spark, sf_dir):
    return search.phrase(docs(spark, sf_dir, "doc_id", "text"), ["of", "the"])


COSINE = "SELECT vec_id AS id, list_cosine_similarity(embedding::DOUBLE[], (SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = 7)) AS score FROM embeddings"


def query_vector(spark, sf_dir, vec_id=7):
    """One stored vector, a point lookup."""
    return table(spark, sf_dir, "embeddings").filter(F.col("vec_id") == vec_id).first()["embedding"]


@register("cosine_topk", f"SELECT id, round(score, 6) AS score FROM ({COSINE}) WHERE score >= 0 ORDER BY round(score, 9) DESC, id LIMIT 20")
def cosine_topk(spark, sf_dir):
    return search.dense(table(spark, sf_dir, "embeddings"), query_vector(spark, sf_dir), 20).select("id", F.round("score", 6).alias("score"))


@register("chunk_rollup", f"""WITH h AS (SELECT id, score, label, row_number() OVER (ORDER BY round(score, 9) DESC, id) AS rank FROM ({COSINE}) JOIN embeddings ON vec_id = id WHERE score >= 0 QUALIFY rank <= 100)
SELECT label AS msg_id, round(max(score), 6) AS score, count(*) AS hits, CAST(min(rank) AS INT) AS first_rank, arg_min(id, rank) AS best_chunk FROM h GROUP BY 1""")
def chunk_rollup(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    hits = search.ranked(search.dense(e, query_vector(spark, sf_dir), 100)).join(e.select(F.col("vec_id").alias("id"), F.col("label").alias("msg_id")), "id")
    return search.roll_up(hits.withColumnRenamed("id", "chunk_index")).withColumn("score", F.round("score", 6))


@register("rrf_hybrid", f"""WITH {BM25}, lex AS (SELECT id, row_number() OVER (ORDER BY score DESC, id) AS r FROM bm QUALIFY r <= 100),
den AS (SELECT id, row_number() OVER (ORDER BY round(score, 9) DESC, id) AS r FROM ({COSINE}) WHERE score >= 0 QUALIFY r <= 100),
f AS (SELECT coalesce(lex.id, den.id) AS id, coalesce(1.0 / (60 + lex.r), 0) + coalesce(1.0 / (60 + den.r), 0) AS score, lex.r AS lr, den.r AS dr FROM lex FULL JOIN den ON lex.id = den.id)
SELECT id, round(score, 6) AS score, CAST(lr AS INT) AS lexical_rank, CAST(dr AS INT) AS dense_rank FROM f ORDER BY round(f.score, 9) DESC, id LIMIT 10""")
def rrf_hybrid(spark, sf_dir):
    """Flagship: BM25 and cosine candidates fused by reciprocal rank."""
    lexical = search.bm25(docs(spark, sf_dir, "doc_id", "text"), list(TERMS)).orderBy(F.desc("score"), "id").limit(100)
    dense = search.dense(table(spark, sf_dir, "embeddings"), query_vector(spark, sf_dir), 100)
    return search.fuse({"lexical": lexical, "dense": dense}).orderBy(F.desc(F.round("score", 9)), "id").limit(10).select("id", F.round("score", 6).alias("score"), "lexical_rank", "dense_rank")


@register("search_preview")
def search_preview(spark, sf_dir):
    return search.search(docs(spark, sf_dir), table(spark, sf_dir, "embeddings"), "the of", query_vector(spark, sf_dir))


@register("hash_embedding", """WITH w AS (SELECT item_id, unnest(list_distinct(regexp_extract_all(lower(text), '[a-z0-9]+'))) AS t FROM benchmark),
h AS (SELECT item_id, ('0x' || substr(sha256(t), 1, 8))::BIGINT % 16 AS i, CASE WHEN ('0x' || substr(sha256(t), 9, 2))::BIGINT % 2 = 0 THEN 1.0 ELSE -1.0 END AS v FROM w),
s AS (SELECT item_id, i, sum(v) AS v FROM h GROUP BY 1, 2), n AS (SELECT item_id, sqrt(sum(v * v)) AS n FROM s GROUP BY 1)
SELECT item_id, i, round(CAST(v AS DOUBLE) / n, 6) AS v FROM s JOIN n USING (item_id) WHERE v <> 0 AND n > 0""")
def hash_embedding(spark, sf_dir):
    from ..functions.vectors import hash_embedding as embed

    words = F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit("[a-z0-9]+"), F.lit(0)))
    out = table(spark, sf_dir, "benchmark").select("item_id", F.posexplode(embed(words, 16)).alias("i", "v"))
    return out.filter("v <> 0").select("item_id", F.col("i").cast("long").alias("i"), F.round("v", 6).alias("v"))


ENRICH = "CASE " + " ".join(f"WHEN regexp_matches(lower(text), '{'|'.join(words)}') THEN '{c}|{a}|{i}'" for words, c, a, i in enrichment.GROUPS) + " ELSE 'general|review|4' END"


@register("heuristic_enrichment", f"SELECT doc_id, split_part({ENRICH}, '|', 1) AS category, split_part({ENRICH}, '|', 2) AS action, CAST(split_part({ENRICH}, '|', 3) AS INT) AS importance FROM documents")
def heuristic_enrichment(spark, sf_dir):
    return docs(spark, sf_dir, "doc_id", "text").withColumn("l", enrichment.ladder(F.lower("text"))).select("doc_id", "l.category", "l.action", "l.importance")


@register("contact_role")
def contact_role(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.lower(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda x: x["text"]), " ")).alias("text"))
    return c.select("conv_id", profiles.role(F.lit("help@support.example.com"), "text").alias("role"))


@register("signal_tier", """WITH o AS (SELECT o_custkey AS k, count(*) AS n, count(*) FILTER (o_orderstatus = 'F') AS i, count(*) FILTER (o_orderstatus = 'O') AS o FROM orders GROUP BY 1)
SELECT k, CASE WHEN o > 0 OR n >= 3 THEN 'deep' ELSE 'quick' END AS tier, CASE WHEN i + o > 0 THEN i + o ELSE greatest(1, least(n, 3)) END + CASE WHEN o > 0 OR n >= 3 THEN 2 ELSE 0 END AS evidence_count FROM o""")
def signal_tier(spark, sf_dir):
    o = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("k")).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("o_orderstatus") == "F").alias("i"), F.count_if(F.col("o_orderstatus") == "O").alias("o"))
    return o.withColumn("s", profiles.signal(F.lit("someone@example.com"), "n", "i", "o", F.lit(""))).select("k", "s.tier", "s.evidence_count")


@register("growth_guard", "SELECT o_custkey AS k, CASE WHEN count(*) FILTER (o_totalprice < 150000) <= 0 THEN true WHEN count(*) <= count(*) FILTER (o_totalprice < 150000) THEN false ELSE count(*) - count(*) FILTER (o_totalprice < 150000) >= greatest(3, ceil(count(*) FILTER (o_totalprice < 150000) * 0.25)) END AS build FROM orders GROUP BY 1")
def growth_guard(spark, sf_dir):
    o = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("k")).agg(F.count(F.lit(1)).alias("new"), F.count_if(F.col("o_totalprice") < 150000).alias("old"))
    return o.select("k", profiles.grown("old", "new", F.lit("quick"), F.lit("quick")).alias("build"))


@register("greedy_budget", """WITH RECURSIVE c AS (SELECT conv_id, turn, length(text) AS n, row_number() OVER (PARTITION BY conv_id ORDER BY turn, text) AS r FROM conversations),
g AS (SELECT conv_id, r, turn, n <= 1500 AS take, CASE WHEN n <= 1500 THEN n ELSE 0 END AS used, CASE WHEN n <= 1500 THEN 1 ELSE 0 END AS cnt FROM c WHERE r = 1
UNION ALL SELECT c.conv_id, c.r, c.turn, g.used + c.n <= 1500 AND g.cnt < 4, g.used + CASE WHEN g.used + c.n <= 1500 AND g.cnt < 4 THEN c.n ELSE 0 END, g.cnt + CASE WHEN g.used + c.n <= 1500 AND g.cnt < 4 THEN 1 ELSE 0 END
FROM g JOIN c ON c.conv_id = g.conv_id AND c.r = g.r + 1)
SELECT conv_id, turn FROM g WHERE take""")
def greedy_budget(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", "text")
    items = c.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "text"))).alias("items"))
    return items.select("conv_id", F.explode(profiles.budgeted(F.col("items"), 1500, 4, lambda x: F.length(x["text"]))).alias("x")).select("conv_id", "x.turn")


@register("prefix_budget", """WITH c AS (SELECT conv_id, turn, text, sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn, text ROWS UNBOUNDED PRECEDING) AS upto, row_number() OVER (PARTITION BY conv_id ORDER BY turn, text) AS r FROM conversations)
SELECT conv_id, turn, substr(text, 1, 1000) AS line FROM c WHERE upto <= 1000 OR r = 1""")
def prefix_budget(spark, sf_dir):
    lines = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.col("text").alias("line"))
    return profiles.bounded_lines(lines, "conv_id", ["turn", "line"], 1000)


@register("newest_per_contact", "SELECT o_custkey, o_orderkey FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey) <= 3")
def newest_per_contact(spark, sf_dir):
    return profiles.newest(table(spark, sf_dir, "orders"), "o_custkey", [F.desc("o_orderdate"), "o_orderkey"], 3).select("o_custkey", "o_orderkey")


@register("round_robin_interleave", "WITH t AS (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS turn FROM documents) SELECT doc_id, source, CAST(turn AS INT) AS turn FROM t ORDER BY t.turn, source LIMIT 33")
def round_robin_interleave(spark, sf_dir):
    return views.round_robin(docs(spark, sf_dir, "doc_id", "source", "n_chars"), "source", [F.desc("n_chars"), "doc_id"], 33).select("doc_id", "source", "turn")


EVAL = f"""WITH q AS (SELECT vec_id AS case_id, label, embedding::DOUBLE[] AS e FROM embeddings WHERE vec_id < 20),
r AS (SELECT case_id, v.vec_id AS msg_id, v.label = q.label AS rel, row_number() OVER (PARTITION BY case_id ORDER BY round(list_cosine_similarity(q.e, v.embedding::DOUBLE[]), 9) DESC, v.vec_id) AS rank FROM q, embeddings v),
c AS (SELECT case_id, max(CASE WHEN rel AND rank <= 10 THEN 1 ELSE 0 END) AS hit, coalesce(1.0 / min(CASE WHEN rel AND rank <= 10 THEN rank END), 0) AS rr, coalesce(sum(CASE WHEN rel AND rank <= 10 THEN 1 / log2(rank + 1) END), 0) AS dcg,
count(*) FILTER (rel) AS wanted, count(*) FILTER (rel AND rank <= 10) AS found FROM r GROUP BY 1),
n AS (SELECT *, dcg / (SELECT sum(1 / log2(i + 1)) FROM range(1, 11) t(i) WHERE i <= c.wanted) AS ndcg FROM c)"""


def eval_cases(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    q = e.filter("vec_id < 20").select(F.col("vec_id").alias("case_id"), F.col("label").alias("case_label"), F.col("embedding").alias("q"))
    from ..functions.vectors import cosine

    pairs = e.join(F.broadcast(q), F.lit(True)).select("case_id", "case_label", F.col("vec_id").alias("msg_id"), "label", F.round(cosine("q", "embedding"), 9).alias("score"))
    ranked = pairs.withColumn("rank", F.row_number().over(Window.partitionBy("case_id").orderBy(F.desc("score"), "msg_id")))
    relevant = pairs.filter("label = case_label").select("case_id", "msg_id")
    return evals.per_case(ranked.select("case_id", "msg_id", "rank"), relevant, 10).join(q.select("case_id", "case_label"), "case_id")


SUMMARY = "count(*) AS cases, round(avg(hit), 6) AS hit_rate_at_k, round(avg(rr), 6) AS mrr, round(avg(ndcg), 6) AS ndcg_at_k, round(avg(found / wanted), 6) AS true_recall_at_k"


@register("mrr_ndcg_hit", f"{EVAL} SELECT {SUMMARY} FROM n")
def mrr_ndcg_hit(spark, sf_dir):
    return evals.summary(eval_cases(spark, sf_dir))


@register("eval_slices", f"{EVAL} SELECT 'label:' || label AS slice, {SUMMARY} FROM n JOIN q USING (case_id) GROUP BY 1")
def eval_slices(spark, sf_dir):
    rows = eval_cases(spark, sf_dir).withColumns({"label": F.col("case_label").cast("string"), "scope": F.lit(""), "account": F.lit("")})
    return evals.summary(rows.withColumn("slice", evals.slice_key("label", "scope", "account")), "slice")


WHOLE_EVAL = EVAL.replace("vec_id < 20", "vec_id % 50 = 0")


def whole_eval_cases(spark, sf_dir):
    """The cases of the stated query set, ids divisible by 50, against all vectors; what is relevant is counted by label."""
    e = table(spark, sf_dir, "embeddings")
    cases = e.filter("vec_id % 50 = 0").select(F.col("vec_id").alias("case_id"), F.col("label").alias("case_label"), F.col("embedding").alias("q"))
    top = evals.in_blocks(cases, e.select(F.col("vec_id").alias("msg_id"), "embedding"), 10)
    hits = top.join(e.select(F.col("vec_id").alias("msg_id"), "label"), "msg_id").join(cases.select("case_id", "case_label"), "case_id").filter("label = case_label")
    wanted = cases.join(e.groupBy(F.col("label").alias("case_label")).agg(F.count(F.lit(1)).alias("wanted")), "case_label").select("case_id", "wanted")
    return evals.judged(hits.select("case_id", "rank"), wanted, 10).join(cases.select("case_id", "case_label"), "case_id")


@register("retrieval_eval", f"{WHOLE_EVAL} SELECT {SUMMARY} FROM n")
def retrieval_eval(spark, sf_dir):
    return evals.summary(whole_eval_cases(spark, sf_dir))


@register("retrieval_eval_slices", f"{WHOLE_EVAL} SELECT 'label:' || label AS slice, {SUMMARY} FROM n JOIN q USING (case_id) GROUP BY 1")
def retrieval_eval_slices(spark, sf_dir):
    rows = whole_eval_cases(spark, sf_dir).withColumns({"label": F.col("case_label").cast("string"), "scope": F.lit(""), "account": F.lit("")})
    return evals.summary(rows.withColumn("slice", evals.slice_key("label", "scope", "account")), "slice")


def as_messages(spark, sf_dir):
    d = docs(spark, sf_dir, "doc_id", "text", "source", "lang", "n_chars")
    return d.select(F.col("doc_id").alias("msg_id"), F.lit("").alias("subject"), F.lit("").alias("snippet"), F.col("text").alias("body_text"), F.col("source").alias("account_email"), F.array("lang").alias("labels"), F.col("n_chars").cast("long").alias("internal_ts"))


def index_root(spark):
    """A new folder for an index; without a shared one only a local session has it."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root and not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return f"{(root or 'file://' + tempfile.mkdtemp(prefix='quillsift-')).rstrip('/')}/index-{uuid.uuid4().hex[:12]}"


SOURCE_TEXT = "SELECT doc_id, source, lang, n_chars, 'Body: ' || rtrim(substr(trim(regexp_replace(text, '[ \\t\\n\\x0B\\f\\r]+', ' ', 'g')), 1, 20000)) AS text FROM documents"


@register("index_bm25", f"""WITH {BM25.replace('FROM documents', f'FROM ({SOURCE_TEXT})')} SELECT id, round(score, 6) AS score FROM bm JOIN documents ON doc_id = id
WHERE source = 'src3' AND upper(lang) = 'EN' AND n_chars >= 100 ORDER BY bm.score DESC, id LIMIT 20""")
def index_bm25(spark, sf_dir):
    """Persisted postings, with the filters after the statistics of the whole index and before the limit."""
    index = search_index.SearchIndex(spark, index_root(spark), "full")
    index.add(as_messages(spark, sf_dir))
    own = index.allowed(account="src3", label="en", start=100).select(F.col("msg_id").alias("id"))
    return index.terms(list(TERMS)).join(own, "id", "left_semi").orderBy(F.desc("score"), "id").limit(20).select("id", F.round("score", 6).alias("score"))


@register("index_rebuild", "SELECT doc_id AS msg_id, CASE WHEN lang = 'fr' THEN 2 ELSE 1 END AS seg, source AS account_email FROM documents")
def index_rebuild(spark, sf_dir):
    """The segment each message is read from after a second run that found one language changed, and a third that found nothing."""
    index, rows = search_index.SearchIndex(spark, index_root(spark), "redacted"), as_messages(spark, sf_dir)
    index.add(rows)
    changed = rows.withColumn("body_text", F.when(F.array_contains("labels", "fr"), F.concat(F.lit("changed "), "body_text")).otherwise(F.col("body_text")))
    index.add(changed)
    if index.add(changed):
        raise RuntimeError("the third run found something to index")
    return index.state().select("msg_id", "seg", "account_email")


@register("index_search")
def index_search(spark, sf_dir):
    """Hybrid search over a redacted index."""
    root = index_root(spark)
    search_index.SearchIndex(spark, root, "redacted").add(as_messages(spark, sf_dir))
    return search_index.searched(spark, root, "the of", k=10)


@register("attachment_candidates", "SELECT o_orderkey AS msg_id FROM orders o WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R')")
def attachment_candidates(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("msg_id"), F.col("o_orderdate").alias("internal_ts"))
    return attachments.inventory_candidates(o, table(spark, sf_dir, "lineitem").filter("l_returnflag = 'R'").select(F.col("l_orderkey").alias("msg_id")))


@register("attachment_states", "SELECT o_orderstatus AS inventory_state, count(*) AS n FROM orders GROUP BY 1")
def attachment_states(spark, sf_dir):
    return attachments.state_counts(table(spark, sf_dir, "orders").select(F.col("o_orderstatus").alias("inventory_state")))


@register("attachment_stats", """SELECT l_linenumber, count(*) AS selected, count(*) FILTER (l_returnflag <> 'R') AS materialized, count(*) FILTER (l_returnflag = 'R') AS failed,
CAST(sum(CASE WHEN l_returnflag <> 'R' THEN l_partkey ELSE 0 END) AS BIGINT) AS bytes_written, count(*) FILTER (l_linestatus = 'F') AS inline_sourced, count(*) FILTER (l_linestatus <> 'F') AS fetched FROM lineitem GROUP BY 1""")
def attachment_stats(spark, sf_dir):
    one = attachments.outcome(F.lit("x"), F.col("l_returnflag") != "R", F.col("l_partkey"), F.col("l_linestatus") == "F")
    return attachments.summed(table(spark, sf_dir, "lineitem").select("l_linenumber", one.alias("o")).select("l_linenumber", "o.*"), "l_linenumber")


@register("eta_minutes", """SELECT event_id, CASE WHEN event_id >= 3 AND value >= 1 AND 100000000 > event_id
THEN greatest(1, CAST(round_even((100000000 - event_id) * value / event_id / 60.0, 0) AS INT)) END AS minutes FROM events""")
def eta_minutes(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", eta("event_id", F.lit(100000000), "value").alias("minutes"))


@register("redact_pass")
def redact_pass(spark, sf_dir):
    """Messages and chunks redacted with one dictionary: placeholders of each message in its text and in its chunks."""
    m = as_messages(spark, sf_dir)
    chunks = chunking.message_chunks(m).select("chunk_id", "msg_id", "chunk_text")
    _, whole, parts = redaction_pass.redact_pass(m.select("msg_id", F.col("body_text").alias("text"), "account_email"), chunks)
    held = lambda c: F.size(F.regexp_extract_all(c, F.lit("<REDACTED_[A-Z_]+>"), F.lit(0)))
    return whole.select("msg_id", held("redacted").alias("placeholders")).join(parts.groupBy("msg_id").agg(F.sum(held("redacted")).alias("in_chunks")), "msg_id")


@register("token_estimate", r"SELECT doc_id, CAST(greatest(1, ceil(length(text) / 4.0), len(regexp_extract_all(text, '[A-Za-z0-9_]+|[^A-Za-z0-9_ \t\n\x0B\f\r]')), CASE WHEN text <> '' AND NOT contains(text, ' ') THEN ceil(length(text) / 1.5) ELSE 0 END) AS BIGINT) AS n_tokens FROM documents")
def token_estimate(spark, sf_dir):
    return docs(spark, sf_dir, "doc_id", "text").select("doc_id", T.token_estimate("text").alias("n_tokens"))


@register("contract_issues", "SELECT event_id, (CASE WHEN coalesce(trim(event_type), '') = '' THEN 1 ELSE 0 END + CASE WHEN value IS NULL OR NOT round(value) BETWEEN 1 AND 10 THEN 1 ELSE 0 END) AS issues FROM events")
def contract_issues(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", "event_type", F.round("value").cast("long").cast("string").alias("importance"))
    return e.select("event_id", F.size(enrich_issues("event_type", F.lit("x"), F.lit("y"), "importance")).alias("issues"))
