"""Queries over events and the star schema: streams, cursors, triage, status."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.dates import DAY_MS, ms
from ..operators import status, triage, views
from ..streaming import jobs
from .catalog import register
from .messages import docs, table


def events(spark, sf_dir):
    return table(spark, sf_dir, "events")


@register("window_filter_events", "SELECT event_id, ts FROM events WHERE ts >= TIMESTAMP '2024-01-05' AND ts < TIMESTAMP '2024-01-12'")
def window_filter_events(spark, sf_dir):
    return events(spark, sf_dir).filter("ts >= TIMESTAMP_NTZ'2024-01-05' AND ts < TIMESTAMP_NTZ'2024-01-12'").select("event_id", "ts")


@register("cursor_full_outer", """WITH a AS (SELECT user_id, max(event_id) AS latest FROM events WHERE event_type = 'click' GROUP BY 1), c AS (SELECT user_id, max(event_id) AS cursor FROM events WHERE event_type = 'view' GROUP BY 1)
SELECT coalesce(a.user_id, c.user_id) AS account_email, cursor, latest, greatest(0, coalesce(cursor - latest, 0)) AS gap, greatest(0, coalesce(cursor - latest, 0)) > 0 AS advisable FROM a FULL JOIN c ON a.user_id = c.user_id""")
def cursor_full_outer(spark, sf_dir):
    e = events(spark, sf_dir).select(F.col("user_id").alias("account_email"), F.col("event_id").alias("history_id"), "event_type")
    cursors = e.filter("event_type = 'view'").groupBy("account_email").agg(F.max("history_id").alias("history_id"))
    return status.history_gap(cursors, e.filter("event_type = 'click'"))


@register("stream_reputation", """WITH g AS (SELECT user_id, event_type, count(*) AS n, max(ts) AS last, min(ts) AS first, count(*) FILTER (value >= 50) AS f, count(*) FILTER (value < 50 AND value >= 20) AS l, count(*) FILTER (value < 20) AS m FROM events GROUP BY 1, 2)
SELECT user_id, arg_max(event_type, {'n': n, 'last': last, 'e': event_type}) AS event_type, CAST(sum(n) AS BIGINT) AS observation_count, CAST(sum(f) AS BIGINT) AS full_count, CAST(sum(l) AS BIGINT) AS light_count, CAST(sum(m) AS BIGINT) AS minimal_count, CAST(0 AS BIGINT) AS suppressed_count,
min(first) AS first_seen, max(last) AS last_seen, CAST(sum(f) - sum(m) AS DOUBLE) AS reputation_score FROM g GROUP BY 1""")
def stream_reputation(spark, sf_dir):
    e = events(spark, sf_dir).withColumn("tier", F.when(F.col("value") >= 50, "full").when(F.col("value") >= 20, "light").when(F.col("value") < 20, "minimal"))
    return triage.reputation(e, "user_id", ["event_type"], "tier", "ts")


@register("latest_per_account", "SELECT user_id, event_id, event_type FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id) = 1")
def latest_per_account(spark, sf_dir):
    return views.latest_per(events(spark, sf_dir).withColumn("t", ms(F.col("ts"))), "user_id", "t", "event_id").select("user_id", "event_id", "event_type")


@register("freshness", "SELECT user_id, max(epoch_us(ts) // 1000) AS last_ms, greatest(0, (1800000000000 - max(epoch_us(ts) // 1000)) // 1000) AS seconds, round(greatest(0, (1800000000000 - max(epoch_us(ts) // 1000)) // 1000) / 3600, 2) AS hours FROM events GROUP BY 1")
def freshness(spark, sf_dir):
    from ..functions.dates import freshness as fresh

    e = events(spark, sf_dir).groupBy("user_id").agg(F.max(ms(F.col("ts"))).alias("last_ms"))
    return e.withColumn("f", fresh("last_ms", F.lit(1_800_000_000_000))).select("user_id", "last_ms", "f.seconds", "f.hours")


@register("oldest_positive", "SELECT user_id, min(CASE WHEN epoch_us(ts) // 1000 > 0 THEN epoch_us(ts) // 1000 END) AS oldest, 'before:' || strftime(date_trunc('day', min(ts)) + INTERVAL 1 DAY, '%Y/%m/%d') AS term FROM events GROUP BY 1")
def oldest_positive(spark, sf_dir):
    from ..functions.dates import before_term

    t = ms(F.col("ts"))
    return events(spark, sf_dir).groupBy("user_id").agg(F.min(F.when(t > 0, t)).alias("oldest")).withColumn("term", before_term("oldest"))


@register("novelty", "SELECT event_id, CASE WHEN row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) = 1 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS novelty_score FROM events")
def novelty(spark, sf_dir):
    e = events(spark, sf_dir).withColumn("stream", F.concat_ws("|", F.col("user_id").cast("string"), "event_type"))
    return triage.with_novelty(e, "stream", ["ts", "event_id"]).select("event_id", "novelty_score")


KEYWORDS = "[" + ", ".join(f"'{k}'" for k in triage.IMPORTANT) + "]"
BULK = "CASE WHEN lang = 'de' THEN 2 ELSE 0 END + CASE WHEN source = 'src1' THEN 2 ELSE 0 END"
IMPORTANCE = f"least(3, len(list_filter({KEYWORDS}, lambda k: contains(lower(text), k))))"


@register("triage_tiers", f"""SELECT doc_id, {BULK} AS bulk_score, CAST({IMPORTANCE} AS INT) AS importance_score, CASE WHEN {IMPORTANCE} >= 2 THEN 'full' WHEN {BULK} >= 4 THEN 'minimal' WHEN {BULK} >= 2 THEN 'light' ELSE 'full' END AS triage_tier,
CASE WHEN {IMPORTANCE} < 2 AND {BULK} >= 2 THEN 'light' ELSE 'full' END AS applied_tier FROM documents""")
def triage_tiers(spark, sf_dir):
    d = docs(spark, sf_dir, "doc_id", "text", "lang", "source")
    labels = F.when(F.col("lang") == "de", F.array(F.lit("CATEGORY_SOCIAL"))).otherwise(F.array(F.lit("INBOX")))
    headers = F.create_map(F.lit("list-id"), F.when(F.col("source") == "src1", "list").otherwise(""))
    d = d.withColumn("bulk_score", triage.bulk_score(labels, headers, F.lit("person@example.com")))
    d = d.withColumn("importance_score", triage.importance_score("text", F.col("bulk_score"), F.lit(False)))
    d = d.withColumn("triage_tier", triage.tier(F.col("bulk_score"), F.col("importance_score")))
    return d.select("doc_id", "bulk_score", "importance_score", "triage_tier", triage.applied_tier(F.col("triage_tier"), True).alias("applied_tier"))


@register("dedup_change_feed", "SELECT user_id, event_type, min(event_id) AS event_id FROM events GROUP BY 1, 2")
def dedup_change_feed(spark, sf_dir):
    return events(spark, sf_dir).groupBy("user_id", "event_type").agg(F.min("event_id").alias("event_id"))


@register("set_difference", "SELECT user_id FROM events WHERE event_type = 'view' EXCEPT SELECT user_id FROM events WHERE event_type = 'purchase'")
def set_difference(spark, sf_dir):
    e = events(spark, sf_dir)
    return e.filter("event_type = 'view'").select("user_id").subtract(e.filter("event_type = 'purchase'").select("user_id"))


@register("set_union_intersect", "(SELECT user_id FROM events WHERE value > 90 UNION SELECT user_id FROM events WHERE value < 1) INTERSECT SELECT user_id FROM events WHERE event_type = 'click'")
def set_union_intersect(spark, sf_dir):
    e = events(spark, sf_dir)
    return e.filter("value > 90").select("user_id").union(e.filter("value < 1").select("user_id")).distinct().intersect(e.filter("event_type = 'click'").select("user_id"))


def streamed(spark, sf_dir, make, keys, mode="complete"):
    """A stream run to its end with an idempotent sink: the last result of each key, as a table."""
    stream = make(jobs.events_stream(spark, sf_dir))
    root = spark.conf.get("spark.checkpoint.dir", None) or "file://" + tempfile.mkdtemp(prefix="quillsift-")
    root = f"{root.rstrip('/')}/stream-{uuid.uuid4().hex[:12]}"
    jobs.run_to_end(stream, f"{root}/checkpoint", lambda df, i: df.withColumn("batch", F.lit(i)).write.mode("overwrite").parquet(f"{root}/out/b={i}"), mode)
    out = spark.read.parquet(f"{root}/out").drop("b")
    nth = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("batch")))
    return out.withColumn("nth", nth).filter("nth = 1").drop("nth", "batch")


@register("streaming_hourly", "SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY 1, 2")
def streaming_hourly(spark, sf_dir):
    flat = lambda e: jobs.hourly(e, "3650 days").select(F.col("window.start").alias("start"), "event_type", "n", "total")
    return streamed(spark, sf_dir, flat, ["start", "event_type"]).withColumn("start", F.col("start").cast("timestamp_ntz"))


@register("stateful_counts", "SELECT user_id, count(*) AS n, max(event_id) AS last_event_id FROM events GROUP BY 1")
def stateful_counts(spark, sf_dir):
    return streamed(spark, sf_dir, jobs.counted, ["user_id"], "update")


@register("session_windows", """WITH e AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
s AS (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM e) SELECT user_id, min(ts) AS start, count(*) AS n FROM s GROUP BY user_id, s""")
def session_windows(spark, sf_dir):
    e = events(spark, sf_dir).withColumn("ts", F.col("ts").cast("timestamp"))
    out = e.groupBy(F.session_window("ts", "30 minutes"), "user_id").agg(F.count(F.lit(1)).alias("n"))
    return out.select("user_id", F.col("session_window.start").cast("timestamp_ntz").alias("start"), "n")


@register("status_report", " UNION ALL ".join(f"SELECT '{t}' AS table_name, count(*) AS row_count FROM {t}" for t in ("documents", "labels", "pages", "embeddings", "events", "conversations")))
def status_report(spark, sf_dir):
    return status.counts({t: table(spark, sf_dir, t) for t in ("documents", "labels", "pages", "embeddings", "events", "conversations")})


@register("status_rollup", "SELECT source, lang, count(*) AS n, CAST(sum(n_chars) AS BIGINT) AS chars FROM documents GROUP BY ROLLUP (source, lang)")
def status_rollup(spark, sf_dir):
    return docs(spark, sf_dir, "source", "lang", "n_chars").rollup("source", "lang").agg(F.count(F.lit(1)).alias("n"), F.sum("n_chars").alias("chars"))


@register("policy_drift", "SELECT count(*) FILTER (coalesce(lang, '') <> 'en') AS drift, count(*) AS n FROM documents")
def policy_drift(spark, sf_dir):
    return docs(spark, sf_dir, "lang").agg(views.drift("lang", "en").alias("drift"), F.count(F.lit(1)).alias("n"))


@register("upsert_latest", "SELECT user_id, event_type, event_id, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id DESC) = 1")
def upsert_latest(spark, sf_dir):
    from ..sources.tables import upserted

    e = events(spark, sf_dir).select("user_id", "event_type", "event_id", "value")
    return upserted(e.filter("event_id % 2 = 0"), e.filter("event_id % 2 = 1"), ["user_id", "event_type"], "event_id")


@register("thread_bounds", f"SELECT user_id, min(epoch_us(ts) // 1000) - greatest({DAY_MS}, max(epoch_us(ts) // 1000) - min(epoch_us(ts) // 1000)) AS from_ms, max(epoch_us(ts) // 1000) + greatest({DAY_MS}, max(epoch_us(ts) // 1000) - min(epoch_us(ts) // 1000)) AS to_ms FROM events GROUP BY 1")
def thread_bounds(spark, sf_dir):
    from ..functions.dates import thread_bounds as bounds

    t = ms(F.col("ts"))
    e = events(spark, sf_dir).groupBy("user_id").agg(F.min(t).alias("a"), F.max(t).alias("b"))
    return e.select("user_id", bounds("a", "b").alias("x")).select("user_id", "x.*")


@register("star_join", """SELECT n_name, count(*) AS n, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
WHERE o_orderdate >= TIMESTAMP '1995-01-01' GROUP BY 1""")
def star_join(spark, sf_dir):
    l, o, c, n = (table(spark, sf_dir, t) for t in ("lineitem", "orders", "customer", "nation"))
    j = l.join(o.filter("o_orderdate >= TIMESTAMP_NTZ'1995-01-01'"), F.col("l_orderkey") == F.col("o_orderkey")).join(c, F.col("o_custkey") == F.col("c_custkey"))
    per = j.groupBy("c_nationkey").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("revenue"))
    return per.join(n, F.col("c_nationkey") == F.col("n_nationkey")).select("n_name", "n", F.round("revenue", 2).alias("revenue"))
