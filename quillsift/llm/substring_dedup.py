"""Substring dedup with a log-structured index of window fingerprints.

Documents come in batches, in the order of doc_id.  The index holds sorted, immutable, bucketed runs of the
historical windows' hashes: of each window of 20 words the anchor, the smallest hash of 8 words in it,
so neighbouring windows share theirs and a run has a seventh of the rows that all windows would be.  Equal
windows have equal anchors.  A batch's anchors are merge-joined with the runs; where an anchor has been
met before, or twice in the batch, the windows around it are verified: 128 bits of their 20 words (two independent hashes of every word), on both
sides, and the first of equal windows by doc_id and start stays.  What was verified is kept, in runs as well, so no document's
windows are hashed again for an anchor.  The batch is a run of its own, and before the next batch runs are compacted into one if
there are more than ``MAX_RUNS``.  A manifest in the index's folder names its runs, so that it can be opened again for a later batch.

Edge cases: null and empty texts have no words; rows with a null doc_id are one document, before all others;
rows that repeat a doc_id are ordered by a hash of their text, and rows equal in both are one document reported
as often as it occurs; texts shorter than a window lose nothing, very long ones are whole; of equal windows the first by doc_id and start stays; an empty table gives no rows;
extra columns are not carried.
"""

from __future__ import annotations

import hashlib
import json
import re
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bitmap, cleaned, dropped, file_system, in_bitmap, shared_root, staged
from .words import Hashed, slices

WINDOW = 20
ANCHOR = 8
BATCHES = 4
MAX_RUNS = 2
#: Stands for a null doc_id.
NO_ID = -(1 << 63)
find = re.compile(rb"[^\x20\x09-\x0D]+").findall


def fingerprints(column: pa.Array, whole: bool = False) -> Iterator[tuple[tuple, np.ndarray, np.ndarray]]:
    """For each text: with ``whole`` two hashes of each window; place of its anchor, hash of each anchor's words."""
    words = Hashed(column, lower=False, wide=whole)
    full = [words.rolled(WINDOW, which) for which in (0, 1)[: 2 * whole]]
    short, starts = words.rolled(ANCHOR), words.starts.tolist()
    for lo, hi in zip(starts, starts[1:]):
        n = max(0, hi - lo - WINDOW + 1)
        own = short[lo : hi - ANCHOR + 1] if n else short[:0]
        # the leftmost least of the anchors in each window, by doubling
        least, reach, span = np.arange(len(own)), 1, WINDOW - ANCHOR + 1
        while n and reach * 2 <= span:
            a, b = least[: len(least) - reach], least[reach:]
            least, reach = np.where(own[b] < own[a], b, a), reach * 2
        a, b = least[:n], least[span - reach : span - reach + n]
        yield tuple(x[lo : lo + n] for x in full), np.where(own[b] < own[a], b, a), own


def anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """doc_id, h, text -> anchor, doc_id, h, n (places in the document)."""
    for batch in batches:
        for part in slices(batch, 2):
            cols = [[], [], [], []]
            for doc_id, h, (_, place, short) in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), fingerprints(part.column(2))):
                if len(place):
                    found, n = np.unique(short[place[np.append(True, place[1:] != place[:-1])]].view(np.int64), return_counts=True)
                    for col, x in zip(cols, (found, np.full(len(found), doc_id), np.full(len(found), h, dtype=np.int64), n.astype(np.int32))):
                        col.append(x)
            if cols[0]:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in cols], names=["anchor", "doc_id", "h", "n"])


def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """doc_id, h, met (anchors), text -> window, more, doc_id, h, start of the windows at these anchors, and whether
    it starts earlier in the document (again)."""
    for batch in batches:
        for part in slices(batch, 3):
            cols, met = [[], [], [], [], [], []], part.column(2)
            for i, (doc_id, h, (full, place, short)) in enumerate(zip(part.column(0).to_pylist(), part.column(1).to_pylist(), fingerprints(part.column(3), True))):
                known = np.sort(met[i].values.to_numpy(zero_copy_only=False).astype(np.int64))
                own = short[place].view(np.int64)
                j = np.minimum(np.searchsorted(known, own), len(known) - 1)
                start = np.flatnonzero(known[j] == own)
                u, v = (f[start].view(np.int64) for f in full)
                order = np.lexsort((v, u))  # stable: the first start of equal windows comes first
                again = np.zeros(len(start), dtype=bool)
                again[order[1:]] = (u[order[1:]] == u[order[:-1]]) & (v[order[1:]] == v[order[:-1]])
                for col, x in zip(cols, (u, v, np.full(len(start), doc_id), np.full(len(start), h, dtype=np.int64), start.astype(np.int32), again)):
                    col.append(x)
            if cols[0]:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in cols], names=[*KEY, "doc_id", "h", "start", "again"])


KEY = ["window", "more"]
KINDS = {"runs": "anchor long, doc_id long, h long, n int", "hot": "anchor long", "known": "window long, more long, doc_id long, h long, n long"}


class FingerprintIndex:
    """Sorted runs, bucketed alike by their first column, so that runs are joined without a shuffle.  Of three kinds:

    ``runs``: anchors with the documents that have them; ``hot``: anchors that were met again, whose windows have all been
    verified; ``known``: these windows, with the first document and their number in the batch that met them.  With a folder that has an index in it, that is opened."""

    def __init__(self, spark: SparkSession, root: str | None = None):
        self.spark, self.root = spark, root or shared_root(spark)
        self.names: dict[str, list[str]] = {k: [] for k in KINDS}
        self.buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
        path, files = file_system(spark, f"{self.root}/manifest.json")
        if files.exists(path):
            found = json.loads(spark.read.text(f"{self.root}/manifest.json", wholetext=True).first()[0])
            self.names, self.buckets = found["names"], found["buckets"]

    def table(self, kind: str, name: str) -> DataFrame:
        if not self.spark.catalog.tableExists(name):
            key = KINDS[kind].split()[0]
            self.spark.sql(f"CREATE TABLE {name} ({KINDS[kind]}) USING parquet CLUSTERED BY ({key}) SORTED BY ({key}) INTO {self.buckets} BUCKETS LOCATION '{self.root}/{name}'")
        return self.spark.table(name)

    def all(self, kind: str) -> DataFrame | None:
        return union([self.table(kind, n) for n in self.names[kind]]) if self.names[kind] else None

    def write(self, kind: str, rows: DataFrame) -> str:
        """A run; never changed once written."""
        name, columns = f"run_{uuid.uuid4().hex[:16]}", [x.split()[0] for x in KINDS[kind].split(", ")]
        rows = rows.select(*columns).repartition(self.buckets, columns[0]).sortWithinPartitions(columns[0])
        with cleaned(self.spark):
            rows.write.bucketBy(self.buckets, columns[0]).sortBy(columns[0]).option("path", f"{self.root}/{name}").saveAsTable(name)
        return name

    def add(self, **new: str) -> None:
        """Take in runs by kind.  The manifest is replaced whole."""
        for kind, name in new.items():
            self.names[kind].append(name)
        self.note()

    def compact(self) -> None:
        """More than MAX_RUNS runs of a kind become one.  The manifest is replaced before the old ones go."""
        gone = []
        for kind, names in self.names.items():
            if len(names) > MAX_RUNS:
                self.names[kind] = [self.write(kind, self.all(kind))]
                gone += names
        if gone:
            self.note()
        for name in gone:
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")
            path, files = file_system(self.spark, f"{self.root}/{name}")
            files.delete(path, True)

    def note(self) -> None:
        path, files = file_system(self.spark, f"{self.root}/manifest.json")
        out = files.create(path, True)
        out.write(bytearray(json.dumps({"names": self.names, "buckets": self.buckets}).encode()))
        out.close()

    def meet(self, own: DataFrame) -> DataFrame | None:
        """(anchor, doc_id, h) of the history that the batch's anchors meet for the first time."""
        if not self.names["runs"]:
            return None
        found = union([self.table("runs", n).join(own.select("anchor"), "anchor", "left_semi").select("anchor", "doc_id", "h") for n in self.names["runs"]])
        hot = self.all("hot")
        return found if hot is None else found.join(hot, "anchor", "left_anti")

    def close(self) -> None:
        """Take the runs out of the session's catalogue; their files stay."""
        for name in (n for names in self.names.values() for n in names):
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")


def union(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for x in frames[1:]:
        out = out.union(x)
    return out


def repeated_windows(docs: DataFrame, index: FingerprintIndex, batch: DataFrame, where, twice: bool = True) -> DataFrame:
    """doc_id, h, starts of the batch's windows that start earlier too; the batch is in the index afterwards.

    ``docs``: all documents so far (doc_id, h, text); ``where``: Column true for the batch's rows; ``twice``: a doc_id may have several h."""
    index.compact()
    name = index.write("runs", batch.mapInArrow(anchors, KINDS["runs"]))
    own, past, hot, known = index.table("runs", name), index.meet(index.table("runs", name)), index.all("hot"), index.all("known")
    some = own.groupBy("anchor").agg(F.sum("n").alias("n")).filter("n > 1").select("anchor")
    if past is not None:
        past = staged(past, "past")
        some = some.union(past.select("anchor"))
        if hot is not None:
            some = some.union(hot)
    own = staged(own.join(some.distinct(), "anchor", "left_semi").select("anchor", "doc_id", "h"), "met")
    met = own if past is None else own.union(past)
    met = staged(met.groupBy("doc_id", "h").agg(F.collect_set("anchor").alias("met")), "met")
    # documents that have none of these anchors stay where they are read
    some = docs.filter(in_bitmap(bitmap(met, ["doc_id", "h"]), ["doc_id", "h"]))
    around = met.join(some, ["doc_id", "h"]).select("doc_id", "h", "met", "text")
    found = staged(around.mapInArrow(windows, "window long, more long, doc_id long, h long, start int, again boolean"), "windows")
    first = [F.min(F.struct("doc_id", "h")).alias("r")] if twice else [F.struct(F.min("doc_id").alias("doc_id"), F.first("h").alias("h")).alias("r")]
    new = index.write("known", found.filter("NOT again").groupBy(*KEY).agg(*first, F.count(F.lit(1)).alias("n")).select(*KEY, "r.*", "n"))
    first = index.table("known", new).filter("n > 1").select(*KEY, F.col("doc_id").alias("first"), F.col("h").alias("first_h"))
    own_rows = found.filter(where)
    later = own_rows.filter("NOT again").join(first, KEY).filter("doc_id != first OR h != first_h").select("doc_id", "h", "start")
    # what is repeated within a document is known without the others
    later = later.union(own_rows.filter("again").select("doc_id", "h", "start"))
    if known is not None:
        later = later.union(own_rows.filter("NOT again").join(known.select(*KEY), KEY, "left_semi").select("doc_id", "h", "start"))
    out = staged(later.groupBy("doc_id", "h").agg(F.collect_set("start").alias("starts")), "later")
    index.add(runs=name, hot=index.write("hot", own.select("anchor").distinct()), known=new)
    dropped(own, met, found, *([] if past is None else [past]))
    return out


def repeats(docs: DataFrame, batches: int = BATCHES, twice: bool = True) -> DataFrame:
    """doc_id, h, starts (of the windows to remove) for the documents (doc_id, h, text) that repeat something."""
    cuts = docs.approxQuantile("doc_id", [i / batches for i in range(1, batches)], 0.01) if batches > 1 else []
    cuts = sorted({int(c) for c in cuts})
    index, found = FingerprintIndex(docs.sparkSession), []
    doc_id = F.col("doc_id")
    for i in range(len(cuts) + 1):
        where = F.lit(True)
        if i > 0:
            where = where & (doc_id > cuts[i - 1])
        so_far = F.lit(True)
        if i < len(cuts):
            where, so_far = where & (doc_id <= cuts[i]), doc_id <= cuts[i]
        found.append(repeated_windows(docs.filter(so_far), index, docs.filter(where), where, twice))
    index.close()
    return union(found)


def strip(with_text: bool):
    """doc_id, starts, text -> doc_id, n_words, n_removed, kept_sha256 (and the kept text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "n_words", "n_removed", "kept_sha256", "kept"][: 4 + with_text]
        for batch in batches:
            cols = [[], [], [], [], []]
            for doc_id, starts, text in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist()):
                words = find(text.encode("utf-8", "replace")) if text else []
                n = len(words)
                if starts.is_valid and n:
                    edge = np.zeros(n + 1, dtype=np.int64)
                    at = starts.values.to_numpy(zero_copy_only=False).astype(np.int64)
                    edge[at] += 1
                    edge[at + WINDOW] -= 1
                    words = [words[i] for i in np.flatnonzero(np.cumsum(edge[:-1]) == 0)]
                kept = b" ".join(words)
                for col, x in zip(cols, (doc_id, n, n - len(words), hashlib.sha256(kept).hexdigest(), kept.decode("utf-8") if with_text else None)):
                    col.append(x)
            types = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)][: 4 + with_text], names=names)

    return run


def remove_repeats(docs: DataFrame, batches: int = BATCHES, with_text: bool = False) -> DataFrame:
    """A row per row of ``docs``: doc_id, n_words, n_removed, kept_sha256 (and kept, the words left, one space apart)."""
    doc_id = F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc_id")
    # where no doc_id occurs twice, it is enough to name a document
    twice = not docs.groupBy(doc_id).count().filter("count > 1").isEmpty()
    keyed = docs.select(doc_id, (F.xxhash64("text") if twice else F.lit(0).cast("long")).alias("h"), "text")
    found = repeats(keyed, batches, twice)
    found = staged(found, "starts")
    some = in_bitmap(bitmap(found, ["doc_id", "h"]), ["doc_id", "h"])
    rows = keyed.filter(some).join(found, ["doc_id", "h"], "left").select("doc_id", "starts", "text")
    rows = rows.union(keyed.filter(~some).select("doc_id", F.lit(None).cast("array<int>").alias("starts"), "text"))
    out = rows.mapInArrow(strip(with_text), "doc_id long, n_words long, n_removed long, kept_sha256 string" + ", kept string" * with_text)
    return out.withColumn("doc_id", F.when(F.col("doc_id") != NO_ID, F.col("doc_id")))


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
