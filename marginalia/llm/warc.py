"""WARC archives with revisit resolution.

Records are written as text by Spark's own file writer (a record is a string that ends in the
line separator CR LF), gzip-compressed per file, so commits, retries and any file system that
Spark reaches work as for any table. Files hold about ``FILE_BYTES`` of payload: records are counted
by the mean payload, those of more than four times the mean in files of their own by the largest.
They are read back as binary files and parsed by Content-Length in a stream. Deduplication shuffles digests, not payloads, to find the record
that stays (the largest page_id); pages then meet the digests that repeat in one equi-join,
which adaptive execution may broadcast or split. Revisit records carry fresh headers and no
payload; reading joins them to their original responses.

Defined results: null html is an empty payload; a null url leaves the header out; rows that
repeat the largest page_id of a payload are all responses; a null page_id is smaller than any
other and comes back as null; a revisit whose response is missing has null payload_bytes; an empty
table gives an empty archive and no rows; other columns, whatever their names, are not looked at.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, prepare, scratch_dir, table

MIN_BYTES, FILE_BYTES = 0, 32 << 20
#: Fixed values of the formats.
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
URN = "urn:page:"


def digest(payload: Column) -> Column:
    """Bare base32 SHA-1: every 5 hexadecimal digits are 4 base32 digits."""
    sha = F.sha1(payload.cast("binary"))
    out = []
    for i in range(0, 40, 5):
        n = F.conv(F.substring(sha, i + 1, 5), 16, 10).cast("int")
        out += [F.substring(F.lit(BASE32), F.shiftright(n, s).bitwiseAND(31) + 1, F.lit(1)) for s in (15, 10, 5, 0)]
    return F.concat(*out)


def with_types(pages: DataFrame, min_bytes: int = MIN_BYTES) -> DataFrame:
    """page_id, url, payload, digest, response: the page whose record the payload stands in."""
    p = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("payload")).withColumn("digest", digest(F.col("payload")))
    heads = p.where(F.octet_length("payload") >= min_bytes).select("page_id", "digest")
    again = materialize(heads.groupBy("digest").agg(F.max("page_id").alias("response"), F.count("*").alias("n")).where("n > 1").drop("n"), "digests")
    joined = p.join(again.withColumnRenamed("digest", "__digest"), (F.col("digest") == F.col("__digest")) & (F.octet_length("payload") >= min_bytes), "left").drop("__digest")
    same = F.col("response").isNull() | F.col("page_id").eqNullSafe(F.col("response"))
    return joined.withColumn("response", F.when(~same, F.col("response")))


def record(date: Column) -> Column:
    """The text of one record, short of its last CR LF."""
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))
    urn = lambda c: F.concat(F.lit(f"<{URN}"), F.coalesce(c.cast("string"), F.lit("null")), F.lit(">"))
    revisit = F.col("response").isNotNull()
    block = F.concat(F.lit(HTTP), F.when(revisit, F.lit("")).otherwise(F.col("payload")))
    url = F.regexp_replace("url", r"\s", "%20")
    return F.concat(
        F.lit("WARC/1.1\r\n"),
        line("WARC-Type", F.when(revisit, F.lit("revisit")).otherwise(F.lit("response"))),
        line("WARC-Record-ID", urn(F.col("page_id"))),
        line("WARC-Date", date),
        F.coalesce(line("WARC-Target-URI", url), F.lit("")),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))),
        F.when(revisit, F.concat(line("WARC-Refers-To", urn(F.col("response"))), line("WARC-Profile", F.lit(PROFILE)))).otherwise(F.lit("")),
        line("Content-Type", F.lit("application/http; msgtype=response")),
        line("Content-Length", F.octet_length(block).cast("string")),
        F.lit("\r\n"), block, F.lit("\r\n"),
    )


def write_archives(pages: DataFrame, path: str, min_bytes: int = MIN_BYTES) -> None:
    """A deduplicated archive of ``pages`` (page_id, url, html) in the folder ``path``."""
    date, size = F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss'Z'"), F.octet_length("payload")
    out = with_types(pages, min_bytes)
    n = F.octet_length("html")
    mean, largest = (int(x or 0) + 1024 for x in pages.agg(F.avg(n), F.max(n)).first())  # with room for a header
    parts = [(size <= 4 * mean, mean)] + [(size > 4 * mean, largest)] * (largest > 4 * mean)
    for own, each in parts:
        rows = out.where(own).select(record(date).alias("value"))
        rows.write.mode("append").option("lineSep", "\r\n").option("maxRecordsPerFile", max(1, FILE_BYTES // each)).text(path, compression="gzip")


def inflated(data: bytes, step: int = 1 << 20) -> Iterator[bytes]:
    """Plain bytes of a file that may consist of gzip members, a part at a time."""
    if data[:2] != b"\x1f\x8b":
        yield data
        return
    while data:
        d = zlib.decompressobj(31)
        while not d.eof:
            part = d.decompress(data, step)
            data = d.unconsumed_tail
            if part:
                yield part
            elif not data:
                break
        data = d.unused_data


class Parts:
    """Reads lines and counted bytes from parts."""

    def __init__(self, parts: Iterator[bytes]):
        self.parts, self.buf, self.at = parts, b"", 0

    def more(self) -> bool:
        part = next(self.parts, None)
        if part is None:
            return False
        self.buf, self.at = self.buf[self.at :] + part, 0
        return True

    def until(self, mark: bytes) -> bytes | None:
        while (end := self.buf.find(mark, self.at)) < 0:
            if not self.more():
                return None
        out, self.at = self.buf[self.at : end], end + len(mark)
        return out

    def take(self, n: int) -> bytes:
        got, out = 0, []
        while got < n:
            if self.at == len(self.buf) and not self.more():
                break
            out.append(self.buf[self.at : self.at + n - got])
            self.at += len(out[-1])
            got += len(out[-1])
        return b"".join(out)


def parse(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """The headers (names lower-cased) and the block of each record of a file."""
    parts = Parts(inflated(data))
    while (head := parts.until(b"\r\n\r\n")) is not None:
        lines = head.decode("utf-8", "replace").lstrip("\r\n").split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"no WARC record: {lines[0][:60]!r}")
        fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
        yield fields, parts.take(int(fields["content-length"]))
        parts.take(4)


HEADERS = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long"


def read_headers(spark: SparkSession, path: str) -> DataFrame:
    """A row per record of the archives in ``path``; a response's digest is checked."""
    prepare(spark)

    def number(urn: str | None) -> int | None:
        m = re.fullmatch(rf"<{URN}(-?\d+)>", urn or "")
        return int(m[1]) if m else None

    def run(batches):
        for b in batches:
            rows = []
            for (content,) in zip(b.column(0).to_pylist()):
                for h, block in parse(content):
                    kind, said = h.get("warc-type"), h.get("warc-payload-digest", "").removeprefix("sha1:")
                    n = None
                    if kind == "response":
                        payload = block.partition(b"\r\n\r\n")[2]
                        n = len(payload)
                        if base64.b32encode(hashlib.sha1(payload).digest()).decode() != said:
                            raise ValueError(f"digest of {h.get('warc-record-id')} differs")
                    rows.append((number(h.get("warc-record-id")), h.get("warc-target-uri"), n, said, kind, number(h.get("warc-refers-to"))))
            cols = list(zip(*rows)) or [()] * 6
            types = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names=["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to"])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path)
    return files.select("content").mapInArrow(run, HEADERS)


def resolve(heads: DataFrame) -> DataFrame:
    """Headers with each revisit's payload_bytes taken from its original response."""
    revisits = heads.where("record_type = 'revisit'").drop("payload_bytes")
    original = heads.where("record_type = 'response'").select(F.col("page_id").alias("__id"), F.col("payload_digest").alias("__digest"), "payload_bytes")
    # one row per response that anything may refer to; written, so that the join can be split
    original = materialize(original.groupBy("__id", "__digest").agg(F.max("payload_bytes").alias("payload_bytes")), "responses")
    found = revisits.join(original, (F.col("refers_to") == F.col("__id")) & (F.col("payload_digest") == F.col("__digest")), "left").drop("__id", "__digest")
    return heads.where("record_type <> 'revisit'").unionByName(found)


def op7_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{scratch_dir(spark)}/archive"
    write_archives(table(spark, sf_dir, "pages"), path)
    heads = materialize(read_headers(spark, path), "headers")
    return resolve(heads).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


_DIGIT = "substr('{b}', ((CAST('0x' || substr(sha1(p), 5 * (i // 4) + 1, 5) AS INTEGER) >> (15 - 5 * (i % 4))) & 31) + 1, 1)".replace("{b}", BASE32)
OP7_SQL = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS p FROM pages),
d AS (SELECT page_id, strlen(p) AS n, array_to_string([{_DIGIT} FOR i IN range(32)], '') AS digest, max(page_id) OVER (PARTITION BY p) AS last FROM p)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, digest AS payload_digest,
       CASE WHEN page_id = last OR n < {MIN_BYTES} THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> last AND n >= {MIN_BYTES} THEN last END AS refers_to
FROM d
"""
