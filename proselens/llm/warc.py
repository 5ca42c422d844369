"""WARC archives and an external merge of their capture indexes.

Records are composed with DataFrame functions and written as WARC files by Spark's text writer (gzip), so that they commit
like any other output and may lie in any file system that Spark writes. Archives are read back as binary files and parsed by
Content-Length. Each archive gives a capture run, sorted by URL key and timestamp. Runs are dealt out by ranges of the key and each
range merges its runs with a loser tree, which gives capture histories in one global order.
"""

from __future__ import annotations

import base64
import hashlib
import io
import math
import zlib

import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, fresh_path, partitions, pick, remove_path, written

ARCHIVE_BYTES = 16 << 20  # payload in an archive, about
RANGE_ROWS = 100_000      # captures of a range, about: what a task of the merge holds
LEAST_REVISIT = 0         # payloads of fewer bytes are never revisits
CRLF = "\r\n"
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"


def base32_sha1(sha1_hex):
    """Bare upper-case base32 of a SHA-1 in hexadecimal: four groups of 40 bits become eight digits each."""
    digits = [F.lpad(F.conv(F.substring(sha1_hex, 1 + 10 * g, 10), 16, 32), 8, "0") for g in range(4)]
    return F.translate(F.concat(*digits), "0123456789ABCDEFGHIJKLMNOPQRSTUV", ALPHABET)


def url_key(url):
    """Host labels reversed, then path and query; lower case. A URL without host is its own key."""
    u = F.lower(F.coalesce(url, F.lit("")))
    host, rest = F.regexp_extract(u, r"^[a-z]+://([^/?#]*)", 1), F.regexp_extract(u, r"^[a-z]+://[^/?#]*(.*)$", 1)
    return F.when(host == "", u).otherwise(F.concat(F.array_join(F.reverse(F.split(host, r"\.")), ","), F.lit(")"), rest))


def record(record_type, refers, url, ts, page_id, digest, size, payload):
    """A record without the two line ends that close it."""
    name = lambda i: F.concat(F.lit("<urn:page:"), F.coalesce(i.cast("string"), F.lit("none")), F.lit(">"))
    http = F.concat(F.lit(CRLF.join(["HTTP/1.1 200 OK", "Content-Type: text/html; charset=utf-8", "Content-Length: "])), size.cast("string"), F.lit(CRLF * 2))
    head = F.concat_ws(CRLF, F.lit("WARC/1.1"), F.concat(F.lit("WARC-Type: "), record_type),
                       F.concat(F.lit("WARC-Target-URI: "), F.regexp_replace(F.coalesce(url, F.lit("")), r"[\x00-\x20]", "%20")),
                       F.concat(F.lit("WARC-Date: "), ts), F.concat(F.lit("WARC-Record-ID: "), name(page_id)),
                       F.concat(F.lit("WARC-Payload-Digest: sha1:"), digest),
                       F.when(refers.isNotNull(), F.concat(F.lit("WARC-Refers-To: "), name(refers))),
                       F.when(refers.isNotNull(), F.lit("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")),
                       F.lit("Content-Type: application/http; msgtype=response"),
                       F.concat(F.lit("Content-Length: "), (F.octet_length(http) + F.octet_length(payload)).cast("string")))
    return F.concat(head, F.lit(CRLF * 2), http, payload)


def write(pages: DataFrame, path: str) -> None:
    """Write one record for each row of pages (page_id, url, html) as WARC files in path.

    Null html is an empty payload; a null page_id is written as none and never is the response that others refer to, unless all are null (then all are
    responses). Rows that repeat both page_id and payload of a response are responses too. Only small columns meet
    to find the first page of each payload; revisits carry no payload."""
    p = pick(pages, {"page_id": "long", "url": "string", "html": "string"})
    p = p.withColumn("html", F.coalesce("html", F.lit("")))
    p = p.withColumn("size", F.octet_length("html").cast("long")).withColumn("sha1", F.sha1(F.encode("html", "UTF-8")))
    first = written(p.groupBy("sha1", "size").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("rows")), "payloads")
    # most payloads are their own response; a join only by digest moves each html once
    p = p.join(first.withColumn("digest", base32_sha1(F.col("sha1"))), ["sha1", "size"])
    again = (F.col("size") >= LEAST_REVISIT) & F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    ts = F.date_format(F.timestamp_seconds(F.lit(1704067200) + F.coalesce("page_id", F.lit(0))), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    text = record(F.when(again, F.lit("revisit")).otherwise(F.lit("response")), F.when(again, F.col("first")), F.col("url"), ts, F.col("page_id"), F.col("digest"), F.col("size"),
                  F.when(again, F.lit("")).otherwise(F.col("html")))
    total = first.agg(F.sum("rows").alias("n"), F.sum(F.col("rows") * F.col("size")).alias("b")).first()
    each = max(1, int(ARCHIVE_BYTES / max(1.0, (total["b"] or 0) / max(1, total["n"] or 0))))
    p.select(text.alias("value")).write.option("lineSep", CRLF * 2).option("compression", "gzip").option("maxRecordsPerFile", each).text(path)
    discard(first)


def parse(stream):
    """(headers, payload) of each record of a stream of WARC bytes, by Content-Length."""
    while line := stream.readline():
        if not line.strip():
            continue
        head = {}
        while (line := stream.readline().rstrip(b"\r\n")):
            k, _, v = line.partition(b": ")
            head[k.decode("ascii", "replace").lower()] = v.decode("utf-8", "replace")
        block = stream.read(int(head["content-length"]))
        http, _, payload = block.partition(b"\r\n\r\n")
        head["http-length"] = int(http.rpartition(b"Content-Length: ")[2])
        yield head, payload


INDEX = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url_key string, capture_ts string, run string"
ORDER = ["url_key", "capture_ts", "page_id"]


def index(spark, path: str) -> DataFrame:
    """One row for each record of the archives in path; rows of an archive (run) in order of ORDER. Size and digest of responses are taken anew from the payload."""
    def number(s):
        s = s[len("<urn:page:") : -1]
        return None if s == "none" else int(s)

    def run(frames):
        for pdf in frames:
            for name, content in zip(pdf["path"], pdf["content"]):
                rows = []
                for h, payload in parse(io.BufferedReader(_Gunzip(content), 1 << 18)):
                    kind = h["warc-type"]
                    own = kind == "response"
                    digest = base64.b32encode(hashlib.sha1(payload).digest()).decode() if own else h["warc-payload-digest"].removeprefix("sha1:")
                    ts = h["warc-date"].translate({ord(c): None for c in "-:TZ"})
                    rows.append((number(h["warc-record-id"]), len(payload) if own else h["http-length"], digest, kind, None if own else number(h["warc-refers-to"]), h["warc-target-uri"], ts, name))
                out = pd.DataFrame(rows, columns=["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url", "capture_ts", "run"])
                yield out.astype({"page_id": "Int64", "refers_to": "Int64"})

    raw = spark.read.format("binaryFile").load(path).select("path", "content")
    rows = raw.mapInPandas(run, INDEX.replace("url_key", "url"))
    rows = rows.withColumn("url_key", url_key(F.regexp_replace("url", "%20", " "))).drop("url")
    return rows.select(*[c.split()[0] for c in INDEX.split(", ")])


class _Gunzip(io.RawIOBase):
    """The content of gzip members, a piece at a time."""

    def __init__(self, content: bytes):
        self.left, self.inflate = content, zlib.decompressobj(31)

    def readable(self):
        return True

    def readinto(self, buffer):
        while self.left:
            out = self.inflate.decompress(self.left, len(buffer))
            self.left = self.inflate.unconsumed_tail
            if self.inflate.eof:
                self.left, self.inflate = self.inflate.unused_data, zlib.decompressobj(31)
            if out:
                buffer[: len(out)] = out
                return len(out)
        return 0


class LoserTree:
    """Merge of sorted runs: inner nodes keep the losers of their matches, so that each row replays one path of log2(k) matches."""

    def __init__(self, runs):
        self.runs = [iter(r) for r in runs]
        self.k = len(self.runs)
        self.head = [next(r, None) for r in self.runs]
        self.tree = [-1] * self.k
        for i in range(self.k):
            self._enter(i)

    def _less(self, a: int, b: int) -> bool:
        x, y = self.head[a], self.head[b]
        return y is None or x is not None and (x < y or x == y and a < b)

    def _enter(self, winner: int) -> None:
        at = (winner + self.k) // 2
        while at:
            if self.tree[at] == -1:
                self.tree[at] = winner
                return
            if self._less(self.tree[at], winner):
                self.tree[at], winner = winner, self.tree[at]
            at //= 2
        self.tree[0] = winner

    def __iter__(self):
        while self.k and (row := self.head[self.tree[0]]) is not None:
            yield row
            winner = self.tree[0]
            self.head[winner] = next(self.runs[winner], None)
            self._enter(winner)


def merge(captures: DataFrame) -> DataFrame:
    """captures with merge_order: each row's place (from 0) in the global order by URL key, timestamp and page_id (null first).

    Ranges of the key are cut at sampled splitters over all three columns, so that one hot URL is split too; there are as many ranges as keep
    each at about RANGE_ROWS rows, so the rows that a task merges are bounded whatever the number of captures."""
    spark = captures.sparkSession
    names = captures.columns
    at = [names.index(c) for c in ORDER]
    run_at = names.index("run")

    def run(batches):
        by: dict = {}
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                key = tuple((row[i] is not None, row[i]) if row[i] is not None else (False, 0) for i in at)
                by.setdefault(row[run_at], []).append((key, len(by.get(row[run_at], ())), row))
        runs = [sorted(r) if any(a > b for a, b in zip(r, r[1:])) else r for r in (by[k] for k in sorted(by))]
        part, i, out = TaskContext.get().partitionId(), 0, []
        for _, _, row in LoserTree(runs):
            out.append((*row, part, i))
            i += 1
            if len(out) == 8192:
                yield frame(out)
                out = []
        if out:
            yield frame(out)

    types = [*(pa.int64() if t == "bigint" else pa.string() for _, t in captures.dtypes), pa.int32(), pa.int64()]

    def frame(rows):
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], [*names, "part", "at"])

    schema = ", ".join(f"{c} {t}" for c, t in captures.dtypes) + ", part int, at long"
    dealt = captures.repartitionByRange(max(partitions(spark), -(-captures.count() // RANGE_ROWS)), *[F.col(c) for c in ORDER])
    done = written(dealt.mapInArrow(run, schema), "captures")
    before = done.groupBy("part").count().withColumn("base", F.coalesce(F.sum("count").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    out = done.join(F.broadcast(before.select("part", "base")), "part")  # one row for each range
    return out.withColumn("merge_order", F.col("base") + F.col("at")).drop("part", "at", "base")


def archive(pages: DataFrame) -> DataFrame:
    """Write the pages as WARC files in the shared folder, read them back, and merge the index."""
    spark = pages.sparkSession
    path = fresh_path(spark, "warc")
    write(pages, path)
    # runs are sorted within their archive before they are dealt out
    runs = written(index(spark, path).sortWithinPartitions("run", *ORDER), "runs")
    remove_path(spark, path)
    out = merge(runs)
    discard(runs)
    return out


def query(spark, sf_dir):
    out = archive(spark.read.parquet(f"{sf_dir}/pages.parquet"))
    return out.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url_key", "capture_ts", "merge_order")


ORACLE = r"""
with p as (select page_id, coalesce(html, '') html, lower(coalesce(url, '')) u from pages),
d as (select page_id, octet_length(encode(html)) payload_bytes, sha1(html) h, u, regexp_extract(u, '^[a-z]+://([^/?#]*)', 1) host from p),
e as (select *, array_to_string(list_transform(range(32), lambda k: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
        cast(((cast('0x' || substr(h, 1 + 10 * (k // 8), 10) as bigint) >> (35 - 5 * (k % 8))) & 31) + 1 as bigint), 1)), '') payload_digest from d),
f as (select *, min(page_id) over (partition by payload_digest, payload_bytes) first from e),
g as (select page_id, payload_bytes, payload_digest, case when page_id <> first then 'revisit' else 'response' end record_type,
        case when page_id <> first then first end refers_to,
        case when host = '' then u else array_to_string(list_reverse(string_split(host, '.')), ',') || ')' || regexp_extract(u, '^[a-z]+://[^/?#]*(.*)$', 1) end url_key,
        strftime(make_timestamp((1704067200 + page_id) * 1000000), '%Y%m%d%H%M%S') capture_ts from f)
select *, row_number() over (order by url_key, capture_ts, page_id) - 1 merge_order from g
"""
