"""Compression classifier for text quality.

Two zstandard dictionaries hold good and bad labelled text.  A document is cut into blocks of 1 KB, all
of them compressed with either dictionary.  The normalised difference of the two sums, and the size
under the good dictionary a byte (a text that folds away, one word again and again, has no difference
to show), go through a logistic curve fitted on labelled rows that are in neither dictionary.

The fit uses a bounded sample: ``rows_per_class`` labelled rows of each class, the first in a seeded
hash order; half of them fill the dictionaries, until ``dict_bytes`` are full, with ``row_pieces`` pieces of ``piece_chars`` characters of each,
spread evenly from the start of its text to the end (a shorter text is whole); the other half fit the curve, with their whole texts.  Every
document's whole text is scored.  Labels, lang, source and doc_id are no inputs of a score.

Edge cases: null and empty text get the score of a text without evidence (difference 0, as short a
text as can be); labels that are null are not used, of contradicting labels of one document the least
counts; without labelled rows of both classes every score is the smoothed share of good labels (0.5
with none).  Repeated rows get equal scores; a null doc_id has no label and is not held out; texts of any length are scored whole.  Extra columns stay as they are, whatever their names.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BLOCK = 1024


class Model:
    """Small and picklable: two dictionaries and three weights."""

    def __init__(self, good: bytes = b"", bad: bytes = b"", weights=None, prior: float = 0.5):
        self.good, self.bad, self.weights, self.prior = good, bad, weights, prior
        self._tools = None

    def __getstate__(self):
        return {"good": self.good, "bad": self.bad, "weights": self.weights, "prior": self.prior, "_tools": None}

    def sizes(self, text: str | None) -> tuple[int, int, int, int]:
        """Compressed bytes under the good and the bad dictionary, plain bytes, blocks: of the whole text."""
        if self._tools is None:
            self._tools = [
                zstandard.ZstdCompressor(level=3, dict_data=zstandard.ZstdCompressionDict(d, dict_type=zstandard.DICT_TYPE_RAWCONTENT), write_content_size=False, write_checksum=False, write_dict_id=False)
                for d in (self.good, self.bad)
            ]
        data = (text or "").encode("utf-8", "replace")
        blocks = [data[i : i + BLOCK] for i in range(0, len(data), BLOCK)]
        good, bad = (sum(len(tool.compress(b)) for b in blocks) for tool in self._tools)
        return good, bad, len(data), len(blocks)

    def score(self, text: str | None) -> float:
        if self.weights is None:
            return self.prior
        z = float(features(np.array([self.sizes(text)], dtype=float)) @ self.weights)
        return 1.0 / (1.0 + math.exp(-max(-30.0, min(30.0, z))))


def features(sizes: np.ndarray) -> np.ndarray:
    good, bad, plain, blocks = sizes.T
    return np.column_stack([np.ones(len(sizes)), 20 * (bad - good) / (plain + 20), 5 * good / (plain + 20 * np.maximum(blocks, 1))])


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-3, steps: int = 60) -> np.ndarray:
    """Newton's method."""
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        w += np.linalg.solve(x.T @ (x * (p * (1 - p))[:, None]) + ridge * np.eye(len(w)), x.T @ (y - p) - ridge * w)
    return w


def fit(docs: DataFrame, labels: DataFrame, rows_per_class: int = 3000, dict_bytes: int = 256 << 10, seed: int = 5, row_pieces: int = 8, piece_chars: int = 256) -> Model:
    """``labels``: doc_id, quality; the caller leaves out what must not be learned from."""
    spark = docs.sparkSession
    labels = labels.filter(F.col("doc_id").isNotNull() & F.col("quality").isNotNull()).groupBy("doc_id").agg(F.min("quality").alias("quality")).withColumn("k", F.xxhash64("doc_id", F.lit(seed)))
    ids = [(r.doc_id, r.quality, i % 2) for q in (0, 1) for i, r in enumerate(labels.filter(F.col("quality") == q).orderBy("k", "doc_id").limit(rows_per_class).collect())]
    if not ids:
        return Model()
    chosen = F.broadcast(spark.createDataFrame(ids, "doc_id long, quality int, part int"))  # 2 * rows_per_class rows at most
    rows = docs.select("doc_id", "text").join(chosen, "doc_id").filter("text is not null")
    length, room = F.length("text"), row_pieces * piece_chars
    at = lambda i: F.floor(i * (length - piece_chars) / F.lit(max(1, row_pieces - 1))).cast("int") + 1
    spread = F.array_join(F.transform(F.sequence(F.lit(0), F.lit(row_pieces - 1)), lambda i: F.substring("text", at(i), F.lit(piece_chars))), " ")
    pieces = rows.filter("part = 0").select("doc_id", "quality", F.when(length <= room, F.col("text")).otherwise(spread).alias("text")).collect()  # rows_per_class rows at most
    held = {0: bytearray(), 1: bytearray()}
    for r in sorted(pieces, key=lambda r: (hash((r.doc_id * 2654435761) % 4294967291), r.text)):
        if len(held[r.quality]) < dict_bytes:
            held[r.quality] += r.text.encode("utf-8", "replace")
    share = (sum(q for _, q, _ in ids) + 1) / (len(ids) + 2)
    model = Model(bytes(held[1][:dict_bytes]), bytes(held[0][:dict_bytes]), None, share)
    if len(model.good) < 8 or len(model.bad) < 8:
        return model

    def measure(batches):
        for pdf in batches:
            yield pd.DataFrame([(*model.sizes(t), q) for t, q in zip(pdf["text"], pdf["quality"])], columns=["g", "b", "n", "k", "q"])

    seen = rows.filter("part = 1").select("text", "quality").mapInPandas(measure, "g long, b long, n long, k long, q int").collect()
    x = np.array([r[:4] for r in seen], dtype=float).reshape(-1, 4)
    y = np.array([r[4] for r in seen], dtype=float)
    if len(set(y)) == 2:
        order = np.lexsort(np.column_stack([x, y]).T)  # the same sums in the same order, whatever the tasks
        # the sample may hold the classes evenly; the curve is fitted to their true shares
        model.weights = logistic(features(x[order]), y[order])
        model.weights[0] += prior_shift(labels, y)
    return model


def prior_shift(labels: DataFrame, y: np.ndarray) -> float:
    """Log odds of all labels less those of the sample."""
    n = {r.quality: r["count"] for r in labels.groupBy("quality").count().collect()}
    return math.log((n.get(1, 0) + 1) / (n.get(0, 0) + 1)) - math.log((y.sum() + 1) / (len(y) - y.sum() + 1))


def scorer(model: Model):
    @F.pandas_udf("double")
    def score(text: pd.Series) -> pd.Series:
        return pd.Series([model.score(t) for t in text], dtype="float64")

    return score


def remainder(doc_id) -> F.col:
    return F.crc32(doc_id.cast("string")) % 5


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """The rows of ``docs`` that score ``threshold`` at least; all labels are learned from."""
    model = fit(docs, labels)
    scored = docs.select(scorer(model)(F.col("text")).alias("score"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    return scored.filter(F.col("score") >= threshold).select(*[F.col("row").getField(c).alias(c) for c in docs.columns])


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality")
    model = fit(docs, labels.filter(remainder(F.col("doc_id")) != 0))
    scored = docs.select("doc_id", F.coalesce(remainder(F.col("doc_id")) == 0, F.lit(False)).alias("held_out"), scorer(model)(F.col("text")).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.3).cast("int"))
