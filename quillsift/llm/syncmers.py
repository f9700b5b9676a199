"""Document fingerprints from closed syncmers, DataFrame and SQL functions only.

Of each run of three words (a start and an end stand around the text) the hashes of its words are
its inner substrings; the run is kept if the smallest is at an edge.  That looks at nothing but the run
itself, so the same words give the same anchors in any context, at their place.  A fingerprint is the
``WIDTH`` smallest distinct hashes of a text's anchors (all of them if there are fewer), as hex; the likeness of
two is their share in common among the smallest of both together, an estimate of the Jaccard
similarity of the anchor sets.  ``anchors`` gives anchors with their positions for positional matching.

Edge cases: null text is empty; a text without words has an empty fingerprint, like only to an empty one;
equal texts have equal fingerprints; repeated rows are rows of their own, next to each other in order; one row
is its own neighbour; an empty table gives no rows; extra columns are not carried.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

WIDTH = 64
#: Rows in a stretch of neighbouring doc_ids, about.
STRETCH = 512
#: So many stretches are sent to all tasks, 40 bytes each; more are joined.
SMALL = 200_000
#: Stands for a null doc_id.
NO_ID = -(1 << 63)


def word_hashes(text: Column) -> Column:
    words = F.array_remove(F.split(F.lower(text), "[ \\x09-\\x0D]+"), "")
    marked = F.when(F.size(words) > 0, F.concat(F.array(F.lit("\x02")), words, F.array(F.lit("\x03")))).otherwise(F.array().cast("array<string>"))
    return F.transform(marked, lambda w: F.xxhash64(w))


def closed(h: Column, i: Column) -> Column:
    """Hash of the run at ``i``, null unless its smallest inner substring lies at an edge."""
    middle = h[i + 1]
    return F.when((h[i] <= middle) | (h[i + 2] <= middle), F.xxhash64(h[i], middle, h[i + 2]))


def per_text(text: Column, body) -> Column:
    """``body(hashes, positions)`` with the hashes computed once a text."""
    return F.element_at(F.transform(F.array(word_hashes(text)), lambda h: body(h, F.when(F.size(h) >= 3, F.sequence(F.lit(0), F.size(h) - 3)).otherwise(F.array().cast("array<int>")))), 1)


def fingerprint(text: Column) -> Column:
    """array<long>: the smallest distinct anchors, ascending."""
    found = per_text(text, lambda h, at: F.array_compact(F.transform(at, lambda i: closed(h, i))))
    return F.slice(F.sort_array(F.array_distinct(found)), 1, WIDTH)


def anchors(docs: DataFrame) -> DataFrame:
    """doc_id, anchor, position (in words) of every closed syncmer."""
    found = per_text(F.col("text"), lambda h, at: F.filter(F.transform(at, lambda i: F.struct(closed(h, i).alias("anchor"), i.alias("position"))), lambda a: a["anchor"].isNotNull()))
    return docs.select("doc_id", F.inline(found))


def as_text(fp: Column) -> Column:
    return F.array_join(F.transform(fp, lambda x: F.lpad(F.lower(F.hex(x)), 16, "0")), "")


def likeness(a: Column, b: Column) -> Column:
    """0 to 1; two empty fingerprints are alike."""
    both = F.array_intersect(a, b)
    union = F.slice(F.sort_array(F.array_union(a, b)), 1, F.greatest(F.size(a), F.size(b)))
    return F.when(F.size(union) == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(both, union)) / F.size(union))


def with_edits(docs: DataFrame) -> DataFrame:
    """doc_id, text and the next row's text for every row of ``docs`` (doc_id, text), by descending doc_id; after the last the first.

    Rows are dealt out by stretches of doc_ids and looked up there; the last row of each stretch gets
    the first of the next stretch by a join.  Only the stretches, a row each, are put in one order."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    lo, hi, n = docs.agg(F.min("doc_id"), F.max("doc_id"), F.count(F.lit(1))).first()
    lo, hi = lo or 0, hi or 0
    stretches = max(1, (n or 0) // STRETCH)
    width = min((1 << 63) - 1, max(1, hi // stretches - lo // stretches + 1))
    # rows without an id come last, in a stretch of their own
    last = F.expr(f"CAST({lo} AS BIGINT) DIV {width}L") - 1
    keyed = docs.withColumn("s", F.coalesce(F.expr(f"doc_id DIV {width}L"), last)).withColumn("h", F.xxhash64("text"))
    keyed = keyed.withColumn("doc_id", F.coalesce("doc_id", F.lit(NO_ID)))
    order = Window.partitionBy("s").orderBy(F.desc("doc_id"), "h")
    # the texts alone are shuffled: a fingerprint is quicker made again than moved
    inside = keyed.withColumn("next", F.lead("text").over(order)).filter(F.col("next").isNotNull()).select("doc_id", "text", "next")

    # the last row of each stretch, and the first of the stretch after it: narrow rows
    ends = keyed.groupBy("s").agg(F.min(F.struct(F.col("doc_id"), (-F.col("h").cast("decimal(20,0)")).alias("k"), "h")).alias("last"), F.max(F.struct(F.col("doc_id"), (-F.col("h").cast("decimal(20,0)")).alias("k"), "h")).alias("first"))
    down = Window.orderBy(F.desc("s"))
    top = ends.agg(F.max_by("first", "s").alias("top"))
    pairs = ends.select("last", F.lead("first").over(down).alias("first")).join(F.broadcast(top), F.lit(True))
    pairs = pairs.select(F.col("last.doc_id").alias("doc_id"), F.col("last.h").alias("h"), F.coalesce("first", "top").alias("first"))
    # a row per stretch: small enough to send along, or else a join
    sent = F.broadcast if stretches <= SMALL else (lambda df: df)
    heads = sent(pairs.select(F.col("first.doc_id").alias("doc_id"), F.col("first.h").alias("h")).distinct())
    head_rows = keyed.join(heads, ["doc_id", "h"]).dropDuplicates(["doc_id", "h"]).select(F.struct("doc_id", "h").alias("head"), F.col("text").alias("next"))
    last_rows = keyed.join(sent(pairs), ["doc_id", "h"]).dropDuplicates(["doc_id", "h"]).withColumn("head", F.struct(F.col("first.doc_id").alias("doc_id"), F.col("first.h").alias("h")))
    across = last_rows.join(head_rows, "head").select("doc_id", "text", "next")
    return inside.union(across)


def edited_pairs(docs: DataFrame) -> DataFrame:
    """The fingerprint query's rows, texts included."""
    rows = with_edits(docs)
    n = F.length("text")
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), n - half), F.substring(F.col("next"), F.lit(1), half))
    rows = rows.select("doc_id", n.cast("long").alias("n_chars"), "text", "next", edited.alias("edited"))
    return rows.withColumns({"fp": fingerprint(F.col("text")), "next_fp": fingerprint(F.col("next")), "edited_fp": fingerprint(F.col("edited"))})


def op6_syncmers(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    rows = edited_pairs(docs)
    return rows.select(
        F.when(F.col("doc_id") != NO_ID, F.col("doc_id")).alias("doc_id"),
        "n_chars",
        F.sha2("edited", 256).alias("edited_sha256"),
        as_text(F.col("fp")).alias("fingerprint"),
        as_text(F.col("edited_fp")).alias("edited_fingerprint"),
        likeness(F.col("fp"), F.col("edited_fp")).alias("near_edited"),
        likeness(F.col("fp"), F.col("next_fp")).alias("near_next"),
    )
