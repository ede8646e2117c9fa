"""WARC archives with revisit records for repeated payloads.

Headers (id, digest, length) are made where the payloads lie, and only headers
are shuffled by digest: the record with the largest id of each digest is the
response, the others are revisits that refer to it. The revisits are broadcast
to the payloads where a count shows that they are few; else the payloads move to
meet them. Each record is a gzip member of its own, as the format advises, so a
reader can begin at any record. Archives are written by Spark's text writer, one
member a row, so they reach any store and a lost task is simply written again.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import re
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import hot_join, sized, tidy

#: Fixed values of the format.
END = "\r\n\r\n"
VERSION = "WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DIGITS = "0123456789ABCDEFGHIJKLMNOPQRSTUV"
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"


def base32(sha: Column) -> Column:
    """A hexadecimal SHA-1 in base32: each five hex digits are four base32 digits."""
    groups = [F.lpad(F.conv(F.substring(sha, i, 5), 16, 32), 4, "0") for i in range(1, 41, 5)]
    return F.translate(F.concat(*groups), DIGITS, BASE32)


def headers(pages: DataFrame) -> DataFrame:
    """(page_id, url, payload_bytes, sha) of each row; a null payload counts as empty."""
    payload = F.coalesce(F.col("html").cast("string"), F.lit(""))
    return pages.select(
        F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"),
        F.octet_length(payload).cast("long").alias("payload_bytes"), F.sha1(payload.cast("binary")).alias("sha"),
    )


def resolve(heads: DataFrame, min_bytes: int = 0) -> DataFrame:
    """Adds record_type, refers_to and refers_url to headers.

    Of records with equal digest and length of at least min_bytes, that with the
    largest page_id is the response. A row that repeats a page_id with the same
    payload is a response too, as is one without page_id that has no equal. A
    digest shared by a third of all records is no hot spot: the maximum is
    combined before the shuffle, and such digests are joined by broadcast (at
    most 1000 keys by construction).
    """
    large = heads.where(F.col("payload_bytes") >= min_bytes)
    first = large.groupBy("sha").agg(F.max(F.struct("page_id", "url")).alias("first"), F.count("*").alias("copies")).where("copies > 1")
    out = hot_join(heads, first, "sha", "copies", heads.count())
    later = F.coalesce((F.col("payload_bytes") >= min_bytes) & F.col("first.page_id").isNotNull() & (F.col("page_id").isNull() | (F.col("page_id") < F.col("first.page_id"))), F.lit(False))
    return out.select(
        *heads.columns, F.when(later, "revisit").otherwise("response").alias("record_type"),
        F.when(later, F.col("first.page_id")).alias("refers_to"), F.when(later, F.col("first.url")).alias("refers_url"),
    )


def _name(page_id, sha, copy=0) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_OID, f'{page_id}:{sha}:{copy}')}>"


def _clean(value) -> str:
    return re.sub(r"[\r\n]", " ", value or "")


def record(page_id, url, html, size, sha, kind, refers_to, refers_url, copy=0) -> str:
    """One record without the separator that follows it."""
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}{END}"
    block += (html or "") if kind == "response" else ""
    head = [
        VERSION, f"WARC-Type: {kind}", f"WARC-Record-ID: {_name(page_id, sha, copy)}", f"WARC-Target-URI: {_clean(url)}",
        "WARC-Date: 2024-01-01T00:00:00Z", f"WARC-Payload-Digest: sha1:{sha}", f"X-Page-Id: {'' if page_id is None else page_id}",
    ]
    if kind == "revisit":
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {_name(refers_to, sha)}", f"WARC-Refers-To-Target-URI: {_clean(refers_url)}", f"X-Refers-To-Page-Id: {refers_to}"]
    head += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(block.encode())}"]
    return "\r\n".join(head) + END + block


def member(text: str) -> bytes:
    """A record with its separator as gzip members whose last byte, a zero, is left to the writer's line end.

    A member ends with the high byte of its length, which is zero under 16 MB; a
    longer record is followed by an empty member, which readers pass over.
    """
    pack = lambda raw: gzip.compress(raw, 6, mtime=0)
    out = pack((text + END).encode())
    return (out if out[-1] == 0 else out + pack(b""))[:-1]


def write(pages: DataFrame, resolved: DataFrame, path: str, per_file: int = 1000) -> None:
    """Writes archives with fresh headers, a gzip member a record; payloads only in responses.

    Rows meet their resolution by page_id and digest, so every row gets a record
    even where ids repeat or are null. Record ids come from page_id, digest and
    the number of the row among those equal in both.
    """
    fields = ["page_id", "url", "html", "payload_bytes", "payload_digest", "record_type", "refers_to", "refers_url", "copy"]

    def make(batches):
        for b in batches:
            rows = zip(*(b.column(x).to_pylist() for x in fields))
            yield pa.RecordBatch.from_arrays([pa.array([member(record(*r)) for r in rows], pa.binary())], names=["value"])

    html = F.col("html").cast("string")
    full = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), html.alias("html"))
    payload = F.coalesce("html", F.lit(""))
    full = full.withColumn("sha", F.sha1(payload.cast("binary"))).withColumn("payload_bytes", F.octet_length(payload).cast("long"))
    same = ["page_id", "sha"]
    repeats = resolved.groupBy(*same).agg(F.count("*").alias("c")).where("c > 1").limit(1).count()
    full = full.withColumn("copy", F.row_number().over(Window.partitionBy(*same).orderBy("url")) - 1 if repeats else F.lit(0))
    again = resolved.where("record_type = 'revisit'").select(F.col("page_id").alias("_id"), F.col("sha").alias("_sha"), "record_type", "refers_to", "refers_url").dropDuplicates(["_id", "_sha"])
    rows = full.join(sized(again, again.count()), full["page_id"].eqNullSafe(F.col("_id")) & (full["sha"] == F.col("_sha")), "left")
    rows = rows.select("page_id", "url", "html", "payload_bytes", base32(F.col("sha")).alias("payload_digest"), F.coalesce("record_type", F.lit("response")).alias("record_type"), "refers_to", "refers_url", "copy")
    members = rows.mapInArrow(tidy(make), "value binary").select(F.col("value").cast("string").alias("value"))
    # The cast keeps the bytes as they are, and so does the writer.
    members.write.option("lineSep", "\0").option("compression", "none").option("maxRecordsPerFile", per_file).text(path)


def parse(stream):
    """(headers, http headers, payload) of each record of an archive, by Content-Length; one record is held at a time."""
    while first := stream.readline():
        head = {}
        while (line := stream.readline()) != b"\r\n":
            if not line:
                raise ValueError("a record breaks off")
            key, sep, value = line.decode().rstrip("\r\n").partition(": ")
            if sep:
                head[key] = value
        size = int(head["Content-Length"])
        block = stream.read(size)
        if not first.startswith(b"WARC/") or len(block) != size or stream.read(4) != b"\r\n\r\n":
            raise ValueError("a record's length is wrong")
        top, _, payload = block.partition(b"\r\n\r\n")
        yield head, dict(x.split(": ", 1) for x in top.decode().split("\r\n")[1:] if ": " in x), payload


def read(spark: SparkSession, path: str) -> DataFrame:
    """A row for each record of the archives under path.

    A response's size and digest are taken from its payload, and a digest that
    differs from the header's raises; a revisit has them from its headers, and
    html null.
    """
    schema = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, html string"

    def rows(batches):
        for b in batches:
            for raw in b.column("content").to_pylist():
                out = []
                for head, http, payload in parse(gzip.GzipFile(fileobj=io.BytesIO(raw))):
                    sha, kind = head["WARC-Payload-Digest"].removeprefix("sha1:"), head["WARC-Type"]
                    size, html = int(http["Content-Length"]), None
                    if kind == "response":
                        if base64.b32encode(hashlib.sha1(payload).digest()).decode() != sha or len(payload) != size:
                            raise ValueError("a payload differs from its digest")
                        html = payload.decode()
                    number = lambda x: int(x) if x.strip() else None
                    out.append((number(head["X-Page-Id"]), head["WARC-Target-URI"], size, sha, kind, number(head.get("X-Refers-To-Page-Id", "")), html))
                    if len(out) == 200:
                        yield _batch(out)
                        out = []
                yield _batch(out)

    kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string()]
    names = [x.split()[0] for x in schema.split(", ")]

    def _batch(out):
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate(kinds)], names=names)

    return spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("content").mapInArrow(tidy(rows), schema)
