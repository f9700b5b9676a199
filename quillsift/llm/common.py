"""Helpers shared by the training-data operators."""

from __future__ import annotations

import contextlib
import os
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words: runs of anything but space and the controls 9 to 13.  Same meaning in Java, Python and RE2.
WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: For str.translate and bytes.translate: lower-cases A-Z only.
ASCII_LOWER = {ord(a): b for a, b in zip(UPPER, LOWER)}
BYTES_LOWER = bytes.maketrans(UPPER.encode(), LOWER.encode())


def shared_root(spark: SparkSession) -> str:
    """A new folder in the one that every executor sees, spark.checkpoint.dir.  Where that is unset a temporary
    folder does for a local session; on a cluster it is an error."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        root = "file://" + os.path.join(tempfile.gettempdir(), "quillsift-shared")
        os.makedirs(root.removeprefix("file://"), exist_ok=True)
    return root.rstrip("/") + "/quillsift-" + uuid.uuid4().hex[:12]


#: Shuffle files go when the write that made them has ended: nothing reads them again.
CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextlib.contextmanager
def cleaned(spark: SparkSession):
    """What runs inside leaves no shuffle files."""
    was = spark.conf.get(CLEAN, None)
    spark.conf.set(CLEAN, "true")
    try:
        yield
    finally:
        spark.conf.unset(CLEAN) if was is None else spark.conf.set(CLEAN, was)


def collected(spark: SparkSession) -> None:
    """Have the garbage of the driver's heap collected where it takes more than half of what it may: plans and compiled code of stage
    after stage let a heap of some 100 MB in use grow to its limit, and only a full collection gives memory back.  Broadcasts that
    nothing refers to go with it.  In a local session, whose heap is that of its tasks, nothing is done."""
    heap = spark._jvm.java.lang.Runtime.getRuntime()
    if not spark._jsc.sc().isLocal() and 2 * heap.totalMemory() > heap.maxMemory():
        spark._jvm.java.lang.System.gc()


def staged(df: DataFrame, name: str = "t") -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back: lineage ends there, so a lost
    executor costs a re-read and not a recomputation."""
    path = f"{shared_root(df.sparkSession)}/{name}"
    with cleaned(df.sparkSession):
        df.write.parquet(path)
    collected(df.sparkSession)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def file_system(spark: SparkSession, path: str):
    """Hadoop's path, and the file system it is on."""
    found = spark._jvm.org.apache.hadoop.fs.Path(path)
    return found, found.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())


def dropped(*frames: DataFrame) -> None:
    """Delete staged tables that nothing reads any more."""
    for df in frames:
        for file in df.inputFiles()[:1]:
            path, files = file_system(df.sparkSession, file)
            files.delete(path.getParent(), True)


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


#: Bits of a bitmap.
BITS = 1 << 22


def bit(columns: list) -> Column:
    return F.pmod(F.xxhash64(*columns), F.lit(BITS))


def bitmap(rows: DataFrame, columns: list) -> Column:
    """A literal of fixed size with a bit for each row's hash.  It keeps most of the rows that aren't wanted out of a shuffle; those it
    lets through fall out in the join after it, so a full one costs time and nothing else."""
    one = F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod("b", F.lit(64)).cast("int"))
    words = rows.select(bit(columns).alias("b")).groupBy(F.shiftright("b", 6).cast("int").alias("w")).agg(F.bit_or(one).alias("x"))
    found = dict(words.collect())  # BITS / 64 rows at most
    return F.split(F.lit(",".join(str(found.get(i, 0)) for i in range(BITS // 64))), ",").cast("array<bigint>")


def in_bitmap(bits: Column, columns: list) -> Column:
    b = bit(columns)
    return F.call_function("shiftright", F.get(bits, F.shiftright(b, 6).cast("int")), F.pmod(b, F.lit(64)).cast("int")).bitwiseAND(F.lit(1)) == 1
