"""Mail payloads as nested JSON: flattening to messages, attachments and headers, and a change feed as a stream source."""

from __future__ import annotations

import json
import os

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, SimpleDataSourceStreamReader

from ..functions.dates import mail_date
from ..functions.jsons import headers_map
from ..functions.text import html_to_text, snippet

DEPTH = 5
HEADERS = "array<struct<name:string,value:string>>"


def part_type(depth: int) -> str:
    deeper = f",parts:array<{part_type(depth - 1)}>" if depth else ""
    return f"struct<partId:string,mimeType:string,filename:string,headers:{HEADERS},body:struct<data:string,size:bigint,attachmentId:string>{deeper}>"


PAYLOAD = f"id string, threadId string, historyId string, internalDate string, labelIds array<string>, snippet string, payload {part_type(DEPTH)}"


def read_payloads(spark: SparkSession, path: str) -> DataFrame:
    """JSON files of payloads, a line each; lines that aren't JSON are null rows and dropped."""
    return spark.read.schema(PAYLOAD).json(path).filter("id IS NOT NULL")


def decoded(data) -> Column:
    """URL-safe base64 to bytes, null for what isn't."""
    plain = F.translate(data, "-_", "+/")
    return F.try_to_binary(F.rpad(plain, (F.ceil(F.length(plain) / 4) * 4).cast("int"), F.lit("=")), F.lit("base64"))


def parts(payloads: DataFrame) -> DataFrame:
    """id and every part, level by level down to DEPTH: part_id, mime_type, filename, headers (map), data, size, attachment_id, disposition."""
    flat = lambda c: F.struct(c["partId"].alias("part_id"), F.lower(F.coalesce(c["mimeType"], F.lit(""))).alias("mime_type"), F.coalesce(c["filename"], F.lit("")).alias("filename"), c["headers"].cast(HEADERS).alias("headers"), c["body"]["data"].alias("data"), c["body"]["size"].alias("size"), c["body"]["attachmentId"].alias("attachment_id"))
    empty = lambda d: F.array().cast(f"array<{part_type(d)}>")
    deeper = lambda level, d: F.flatten(F.transform(level, lambda p: F.coalesce(p["parts"], empty(d - 1))))
    level, levels = F.array("payload"), []
    for d in range(DEPTH, -1, -1):
        levels.append(F.transform(level, flat))
        if d:
            level = deeper(level, d)
    out = payloads.select("id", F.posexplode(F.concat(*levels)).alias("place", "p")).select("id", "place", "p.*").filter("part_id IS NOT NULL OR data IS NOT NULL OR mime_type != ''")
    out = out.withColumn("headers", headers_map("headers"))
    disposition = F.lower(F.coalesce(F.element_at("headers", "content-disposition"), F.lit("")))
    content_id = F.coalesce(F.element_at("headers", "content-id"), F.lit(""))
    inline = disposition.startswith("inline") | ((disposition == "") & (content_id != ""))
    return out.withColumns({"content_disposition": disposition, "content_id": content_id, "is_inline": inline, "is_attachment": (F.col("filename") != "") | F.col("attachment_id").isNotNull() | disposition.startswith("attachment")})


def attachments(payloads: DataFrame) -> DataFrame:
    return parts(payloads).filter("is_attachment").select(F.col("id").alias("msg_id"), "part_id", "attachment_id", "mime_type", "filename", F.coalesce("size", F.lit(0)).alias("size_bytes"), "content_disposition", "content_id", "is_inline")


def inline_bytes(payloads: DataFrame) -> DataFrame:
    """msg_id, part_id, content of the attachments that carry their bytes."""
    return parts(payloads).filter("is_attachment AND data IS NOT NULL").select(F.col("id").alias("msg_id"), "part_id", decoded(F.col("data")).alias("content"))


def messages(payloads: DataFrame, account: str) -> DataFrame:
    """Flat rows: plain text if there is any, else HTML made text, else the snippet; attachments' text stays out."""
    text = parts(payloads).filter("NOT is_attachment AND data IS NOT NULL").select("id", "place", "mime_type", decoded(F.col("data")).cast("string").alias("text"))
    joined = lambda mime: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("mime_type") == mime, F.struct("place", "text")))), lambda x: x["text"]), "\n")
    bodies = text.groupBy("id").agg(joined("text/plain").alias("plain"), joined("text/html").alias("html"))
    p = payloads.join(bodies, "id", "left").withColumn("h", headers_map(F.col("payload.headers")))
    header = lambda n: F.coalesce(F.element_at("h", n), F.lit(""))
    body = F.coalesce(F.nullif(F.trim("plain"), F.lit("")), F.nullif(html_to_text("html"), F.lit("")), F.coalesce("snippet", F.lit("")))
    ts = F.col("internalDate").try_cast("long")
    return p.select(
        F.col("id").alias("msg_id"), F.lit(account).alias("account_email"), F.col("threadId").alias("thread_id"), mail_date(header("date"), ts).alias("date_iso"), ts.alias("internal_ts"),
        header("from").alias("from_addr"), header("to").alias("to_addr"), header("subject").alias("subject"), snippet("snippet").alias("snippet"), body.alias("body_text"),
        F.coalesce("labelIds", F.array().cast("array<string>")).alias("labels"), F.col("historyId").try_cast("long").alias("history_id"), F.col("h").alias("headers"),
    )


def addresses(header) -> Column:
    """array<struct<name,email>> of an address header (encoded words are decoded: an Arrow UDF)."""
    def run(values: pd.Series) -> pd.Series:
        from email.header import decode_header, make_header
        from email.utils import getaddresses

        def name(n: str) -> str:
            try:
                return str(make_header(decode_header(n)))
            except (LookupError, UnicodeError, ValueError):
                return n

        return values.map(lambda v: [{"name": name(n), "email": e.lower()} for n, e in getaddresses([v or ""]) if "@" in e])

    return F.pandas_udf(run, "array<struct<name:string,email:string>>")(header)


class ChangeFeedReader(SimpleDataSourceStreamReader):
    """Pages of added messages, newline-delimited JSON in history order; the offset is the last history id."""

    def __init__(self, path: str, start: int | None):
        self.path, self.start = path, start

    def pages(self):
        for name in sorted(os.listdir(self.path)):
            with open(os.path.join(self.path, name), encoding="utf-8") as f:
                yield from (json.loads(line) for line in f if line.strip())

    def initialOffset(self) -> dict:
        """Where reading starts: at ``start``, or at the head of the feed."""
        return {"history_id": self.start if self.start is not None else max((int(p["historyId"]) for p in self.pages()), default=0)}

    def read(self, start: dict):
        rows, last = self.between(start["history_id"], None)
        return iter(rows), {"history_id": last}

    def readBetweenOffsets(self, start: dict, end: dict):
        return iter(self.between(start["history_id"], end["history_id"])[0])

    def between(self, lo: int, hi: int | None):
        found, last = {}, lo
        for page in self.pages():
            at = int(page["historyId"])
            if at <= lo or hi is not None and at > hi:
                continue
            last = max(last, at)
            for change in page.get("history", []):
                for added in change.get("messagesAdded", []):
                    m = added.get("message", {})
                    if m.get("id") and {"INBOX", "SENT"} & set(m.get("labelIds", [])):
                        found[m["id"]] = (m["id"], m.get("labelIds", []), at)
        return list(found.values()), last


class ChangeFeed(DataSource):
    """``spark.readStream.format("mail_changes").option("path", ...)``; option start: a history id."""

    @classmethod
    def name(cls) -> str:
        return "mail_changes"

    def schema(self) -> str:
        return "msg_id string, labels array<string>, history_id long"

    def simpleStreamReader(self, schema):
        start = self.options.get("start")
        return ChangeFeedReader(self.options["path"], int(start) if start is not None else None)
