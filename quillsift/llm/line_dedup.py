"""Line dedup: an exact set-similarity join of lines, in DataFrame operations only.

A line is the set of its words (runs of anything but ASCII white space, A-Z lower-cased).  It is removed if an earlier
line, by doc_id and place, has a Jaccard similarity of 0.8 or more with it; what counts is the input, so
a line that is removed itself still removes later ones.  Lines of fewer than ``min_words`` distinct words
stay and remove nothing; the query and the pipeline take 1, so that only blank lines do.

Lines of the same text, A-Z lower-cased, are one class: the first stays to stand for it, the others go.  Words are ordered by rarity
(counts over all lines in 2**16 slots, ties by hash), and two similar lines share one of their first
``n - ceil(0.8 n) + 1`` words, on which the first lines are joined with filters by length, by position and by a 64-bit sketch,
whose differing bits are a lower bound for the differing words.  A semi-join finds the rows that pass
with any other, at most one for each row, however many lines a word has.  Their lines are fetched and verified on the words: first against
the earliest line under each shared word, which settles groups of near copies by a pair a line and word; what
is not removed by that meets all earlier lines that pass.

Edge cases: null text stays null, empty text empty; of repeated rows all but one lose the lines that the
first has; a null doc_id comes before all others, and rows of one doc_id are ordered by a hash of their text; lines are split at
\\n and joined by it, whole texts and lines of any length; of lines that are equal the one that comes first stays; an empty table gives
no rows; extra columns stay as they are, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import dropped, staged

SLOTS = 1 << 16
#: Lines of so many words have a sketch of 128 bits.
LONG = 64
NO_ID = -(1 << 63)
AT = ["doc_id", "h", "line"]
#: White space within a line besides the space itself, each of which is rare.
CONTROLS = ["\t", "\x0b", "\x0c", "\r"]
#: The rows a and b of a word pass the sketch, length and position filters: sets that share o of n + m words differ by n + m - 2 o.
#: By position a pair has to pass under the first word that its lines share, as each similar pair does; none of the words before is shared.
PASSES = f"""
    a.word = b.word AND (100 + {{p}}) * bit_count(a.s ^ b.s) <= (100 - {{p}}) * (a.n + b.n)
    AND {{p}} * greatest(a.n, b.n) <= 100 * least(a.n, b.n)
    AND (100 + {{p}}) * least(a.n - a.pos, b.n - b.pos) >= {{p}} * (a.n + b.n)
    AND (a.n < {LONG} OR b.n < {LONG} OR (100 + {{p}}) * (bit_count(a.z ^ b.z) + bit_count(a.s ^ a.z ^ b.s ^ b.z)) <= (100 - {{p}}) * (a.n + b.n))
"""
EARLIER = "struct(a.doc_id, a.h, a.line) < struct(b.doc_id, b.h, b.line)"


def spaced(line: Column) -> Column:
    """A line with spaces for other white space."""
    some = F.contains(line, F.lit(CONTROLS[0]))
    for c in CONTROLS[1:]:
        some = some | F.contains(line, F.lit(c))
    return F.when(some, F.translate(line, "".join(CONTROLS), "    ")).otherwise(line)


def lowered(line: Column) -> Column:
    """A-Z lower-cased, and other characters renamed, no two alike, to be compared only: the bytes of a line that has any are
    lower-cased as Latin-1 letters, which makes other lead bytes of some, told apart by the number of bytes that follow."""
    return F.when(F.octet_length(line) != F.length(line), F.lower(F.decode(line.cast("binary"), "ISO-8859-1"))).otherwise(F.lower(line))


def words_of(line: str) -> Column:
    return F.array_remove(F.array_distinct(F.split(lowered(spaced(F.col(line))), " ")), "")


def longs(numbers) -> Column:
    """An array literal."""
    return F.split(F.lit(",".join(map(str, numbers))), ",").cast("array<bigint>")


def levels(docs: DataFrame) -> Column:
    """An array literal: twice the logarithm of how many words fall on each slot of their hashes, in the bits of a
    code above its hash.  ``docs``: text, lowered and spaced."""
    slot = F.xxhash64("word").bitwiseAND(F.lit(SLOTS - 1)).cast("int")
    words = docs.select(F.explode(F.split(F.replace("text", F.lit("\n"), F.lit(" ")), " ")).alias("word"))
    counts = words.groupBy(slot.alias("slot")).agg(F.count(F.lit(1)).alias("n"))
    found = {r.slot: min(126, (r.n * r.n).bit_length()) for r in counts.collect()}  # SLOTS rows at most
    return longs(found.get(i, 0) << 56 for i in range(SLOTS))


def first_lines(docs: DataFrame, percent: int, min_words: int) -> DataFrame:
    """doc_id, h, line, n, s, z (sketch), firsts (the rarest words' codes) of the first line of each text.

    A word's code is its level and 56 bits of hash.  The sketch s has the parity of how many words fall on each of 64 bits, z of those
    of one half of all words, for long lines.  Texts are lower-cased whole, each once; words are made distinct and sorted outside of
    the functions with lambdas, which are interpreted with all that they read: compiled, both work on primitives."""
    low = docs.select("doc_id", "h", lowered(spaced(F.col("text"))).alias("text"))
    rank, bits, zero = levels(low), longs((1 << i) - (1 << 64) * (i == 63) for i in range(64)), F.lit(0).cast("long")
    lines = low.select("doc_id", "h", F.posexplode(F.split("text", "\n")).alias("line", "txt"))
    code = lambda w: F.coalesce(rank[w.bitwiseAND(F.lit(SLOTS - 1))], zero).bitwiseOR(F.shiftrightunsigned(w, 8))  # never null: sorted as primitives
    codes = F.transform(F.transform(F.split("txt", " "), lambda w: F.xxhash64(w)), code)
    codes = F.sort_array(F.array_distinct(F.array_remove(codes, code(F.xxhash64(F.lit(""))))))
    lines = lines.select(*AT, F.xxhash64("txt").alias("k1"), F.xxhash64(F.lit(1), "txt").alias("k2"), codes.alias("codes"))
    bit = lambda w: bits[w.bitwiseAND(F.lit(63))]
    s = F.aggregate("codes", zero, lambda s, w: s.bitwiseXOR(bit(w)))
    half = lambda w: F.shiftright(w, 26).bitwiseAND(F.lit(1))
    z = F.when(F.size("codes") < LONG, zero).otherwise(F.aggregate("codes", zero, lambda s, w: F.when(half(w) == 1, s.bitwiseXOR(bit(w))).otherwise(s)))
    n = F.size("codes")
    firsts = F.slice("codes", F.lit(1), n - F.expr(f"cast(({percent} * size(codes) + 99) div 100 as int)") + 1)
    drawn = lines.select(*AT, "k1", "k2", n.alias("n"), s.alias("s"), z.alias("z"), firsts.alias("firsts"))
    nth = F.row_number().over(Window.partitionBy("k1", "k2").orderBy(*AT))
    return drawn.withColumn("nth", nth).filter((F.col("nth") == 1) & (F.col("n") >= min_words)).drop("nth", "k1", "k2")


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """id of the later lines (b) whose words are similar enough to those of the earlier one (a)."""
    both = pairs.join(sets.withColumnsRenamed({"id": "a", "words": "u"}), "a").join(sets.withColumnsRenamed({"id": "b", "words": "v"}), "b")
    shared = F.size(F.array_intersect("u", "v"))
    return both.filter(100 * shared >= percent * (F.size("u") + F.size("v") - shared)).select(F.col("b").alias("id")).distinct()


def lines_of(docs: DataFrame, at: DataFrame, twice: bool) -> DataFrame:
    """id, words of the lines named (id, doc_id, h, line)."""
    wanted = at.groupBy("doc_id", "h").agg(F.collect_set(F.struct("line", "id")).alias("wanted"))  # of one document each
    some = docs.join(wanted, ["doc_id", "h"])
    some = some.dropDuplicates(["doc_id", "h"]) if twice else some
    lines = some.withColumn("lines", F.split("text", "\n")).select("lines", F.explode("wanted").alias("at"))
    return lines.select("at.id", F.get("lines", F.col("at.line")).alias("line")).select("id", words_of("line").alias("words"))


def kept_lines(docs: DataFrame, percent: int, min_words: int, twice: bool) -> DataFrame:
    """``docs``: doc_id, h, text.  doc_id, h, line of the lines with words enough that stay."""
    first = staged(first_lines(docs, percent, min_words).withColumn("id", F.monotonically_increasing_id()), "first")
    passes = PASSES.format(p=percent)
    rows = first.select("n", "s", "z", "id", F.posexplode("firsts").alias("pos", "word"))
    narrow = staged(rows.alias("a").join(rows.alias("b"), F.expr(f"a.id != b.id AND {passes}"), "left_semi"), "met")
    met = staged(narrow.join(first.select("id", *AT), "id"), "met")
    sets = staged(lines_of(docs, met.select("id", *AT).distinct(), twice), "sets")
    pairs = lambda a, b: a.alias("a").join(b.alias("b"), F.expr(f"{passes} AND {EARLIER}")).select(F.col("a.id").alias("a"), F.col("b.id").alias("b")).distinct()
    lead = met.groupBy("word").agg(F.min(F.struct(*AT, "id", "n", "pos", "s", "z")).alias("r")).select("word", "r.*")
    gone = staged(verified(pairs(lead, met), sets, percent), "gone")
    more = staged(verified(pairs(met, met.join(gone, "id", "left_anti")), sets, percent), "gone")
    kept = staged(first.join(gone.union(more), "id", "left_anti").select(*AT), "kept")
    dropped(first, narrow, met, sets, gone, more)
    return kept


def dedup_lines(docs: DataFrame, percent: int = 80, min_words: int = 5, details: bool = False, drop_emptied: bool = False) -> DataFrame:
    """``docs`` with the lines removed from ``text``; with ``details``, n_lines and n_removed follow.

    ``drop_emptied``: documents that lose lines and keep no word go (copies of earlier ones, mostly)."""
    doc_id = F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID))
    # where no doc_id occurs twice, it is enough to name a document
    twice = not docs.groupBy(doc_id.alias("doc_id")).count().filter("count > 1").isEmpty()
    keyed = docs.select(doc_id.alias("doc_id"), (F.xxhash64("text") if twice else F.lit(0).cast("long")).alias("h"), "text", F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != "text"]).alias("row"))
    kept = kept_lines(keyed.select("doc_id", "h", "text"), percent, min_words, twice)
    kept = kept.groupBy("doc_id", "h").agg(F.collect_set("line").alias("kept"))  # of one document each
    out = keyed.join(kept, ["doc_id", "h"], "left")
    nth = F.row_number().over(Window.partitionBy("doc_id", "h").orderBy("h")) if twice else F.lit(1)
    lines, every = F.split("text", "\n"), F.sequence(F.lit(0), F.size("lines") - 1)
    taking_part = F.filter(every, lambda i: (F.ltrim(F.get("lines", i), F.lit(" \t\n\x0b\x0c\r")) != "") if min_words == 1 else F.size(F.array_remove(F.array_distinct(F.split(lowered(spaced(F.get("lines", i))), " ")), "")) >= min_words)
    out = out.withColumn("lines", lines).withColumn("nth", nth)
    stay = F.when(F.col("kept").isNull() | (F.col("nth") > 1), F.array().cast("array<int>")).otherwise(F.col("kept"))
    out = out.withColumn("every", F.when(F.col("text").isNotNull(), every)).withColumn("gone", F.array_except(F.when(F.col("text").isNotNull(), taking_part), stay))
    some = F.size("gone") > 0
    text = F.when(some, F.array_join(F.transform(F.array_except("every", "gone"), lambda i: F.get("lines", i)), "\n")).otherwise(F.col("text"))
    out = out.select("row", text.alias("text"), F.col("text").isNull().alias("absent"), some.alias("some"), F.size("lines").alias("n"), F.size("gone").alias("m"))
    if drop_emptied:
        out = out.filter(F.col("absent") | ~F.col("some") | F.col("text").rlike("[^ \\x09-\\x0D]"))
    columns = [F.col("text") if c == "text" else F.col("row").getField(c).alias(c) for c in docs.columns]
    if details:
        columns += [F.when(F.col("absent"), 0).otherwise(F.col(c)).cast("long").alias(name) for c, name in (("n", "n_lines"), ("m", "n_removed"))]
    return out.select(*columns)


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = dedup_lines(docs, min_words=1, details=True)
    return out.select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))
