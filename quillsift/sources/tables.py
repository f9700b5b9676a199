"""Tables as Parquet folders: keyed upserts by rewrite, since Parquet has no MERGE."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def upserted(old: DataFrame | None, new: DataFrame, keys: list[str], version: str) -> DataFrame:
    """All rows, of each key the latest version; on a tie the new one."""
    every = new.withColumn("__new", F.lit(1))
    if old is not None:
        every = every.unionByName(old.withColumn("__new", F.lit(0)), allowMissingColumns=True)
    w = Window.partitionBy(*keys).orderBy(F.col(version).desc_nulls_last(), F.desc("__new"))
    return every.withColumn("__n", F.row_number().over(w)).filter(F.col("__n") == 1).drop("__n", "__new")


def replaced(old: DataFrame, new: DataFrame, owner: str, part: str, carried: list[str]) -> DataFrame:
    """The parts of the owners in ``new`` replace theirs; ``carried`` columns of a part that stays are kept."""
    kept = old.join(new.select(owner).distinct(), owner, "left_anti")
    state = old.select(owner, part, *[F.col(c).alias(f"__{c}") for c in carried])
    fresh = new.join(state, [owner, part], "left")
    for c in carried:
        own = F.col(c) if c in new.columns else F.lit(None)
        fresh = fresh.withColumn(c, F.coalesce(f"__{c}", own)).drop(f"__{c}")
    return kept.unionByName(fresh, allowMissingColumns=True)


def patched(rows: DataFrame, changes: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """``columns`` overwritten where ``changes`` has a value."""
    c = changes.select(*keys, *[F.col(x).alias(f"__{x}") for x in columns])
    out = rows.join(c, keys, "left")
    for x in columns:
        out = out.withColumn(x, F.coalesce(f"__{x}", x)).drop(f"__{x}")
    return out


def counted(seen: DataFrame, key: str, name: str, at: str) -> DataFrame:
    """Contact counters from deduplicated messages: a rerun counts nothing twice."""
    return seen.groupBy(key).agg(F.count(F.lit(1)).alias("message_count"), F.min(at).alias("first_seen"), F.max(at).alias("last_seen"), F.min_by(F.col(name), F.when(F.col(name).isNotNull(), F.col(at))).alias("display_name"))


class Catalog:
    """Tables in one folder, written whole and swapped, so a reader never sees half a table."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def versions(self, name: str) -> list[int]:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
        fs = path.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not fs.exists(path):
            return []
        done = [s.getPath() for s in fs.listStatus(path)]
        return sorted(int(p.getName()[1:]) for p in done if p.getName()[:1] == "v" and fs.exists(self.spark._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS")))

    def read(self, name: str) -> DataFrame | None:
        found = self.versions(name)
        return self.spark.read.parquet(f"{self.root}/{name}/v{found[-1]}") if found else None

    def write(self, name: str, rows: DataFrame) -> None:
        found = self.versions(name)
        rows.write.mode("overwrite").parquet(f"{self.root}/{name}/v{found[-1] + 1 if found else 1}")

    def upsert(self, name: str, rows: DataFrame, keys: list[str], version: str) -> None:
        self.write(name, upserted(self.read(name), rows, keys, version))


def attachment_path(key, extension):
    """attachments/<sixteen digits>/<two digits>/<key><extension>."""
    return F.concat_ws("/", F.lit("attachments"), F.substring(F.sha2(key, 256), 1, 16), F.substring(key, 1, 2), F.concat(key, extension))


def materialize(rows: DataFrame, root: str) -> DataFrame:
    """Writes ``content`` under ``root`` at ``path`` (a temporary name, then a rename); path, sha256, size of what was written."""
    def run(batches):
        import hashlib

        import pyarrow.fs as pafs

        fs, base = pafs.FileSystem.from_uri(root)
        for pdf in batches:
            out = []
            for path, content in zip(pdf["path"], pdf["content"]):
                target, digest = f"{base}/{path}", hashlib.sha256(content).hexdigest()
                fs.create_dir(target.rpartition("/")[0], recursive=True)
                with fs.open_output_stream(f"{target}.{digest[:8]}.tmp") as f:
                    f.write(content)
                fs.move(f"{target}.{digest[:8]}.tmp", target)
                out.append((path, digest, len(content)))
            yield pd.DataFrame(out, columns=["path", "content_sha256", "content_size_bytes"])

    return rows.select("path", "content").mapInPandas(run, "path string, content_sha256 string, content_size_bytes long")


def read_cases(spark: SparkSession, path: str) -> DataFrame:
    """Evaluation cases from a JSON array; a case without query or relevant ids is an error."""
    cases = spark.read.schema("query string, relevant_msg_ids array<string>, account_email string, label string, scope string").option("multiLine", True).json(path)
    bad = F.coalesce(F.trim("query"), F.lit("")) == ""
    return cases.withColumn("query", F.when(bad | (F.coalesce(F.size("relevant_msg_ids"), F.lit(0)) < 1), F.raise_error(F.lit("a case needs a query and relevant_msg_ids"))).otherwise(F.col("query")))
