"""WARC archives: written as monolithic gzip, normalised to one member a record, read back.

1. *Write*: every page becomes a record (headers, payload).  Spark's text writer
   with gzip and the record terminator as its line separator writes each task's
   records into one gzip stream; records keep their bytes.  A file holds about
   ``file_bytes`` bytes of records.
2. *Normalise*: each file is inflated once as a stream; each record is
   compressed again as a gzip member of its own, and its offset, length and
   headers go to a sidecar index (Parquet).  The text writer needs a separator,
   so an empty gzip member (20 bytes) follows every record; any gzip reader skips it.
3. *Read*: archives are walked member by member; of single records the index
   tells the place.

All files go through Spark's readers and writers, so they can lie in any store.

Of records whose payloads are equal (SHA-1 and length), that with the largest
page_id is the response and the others are revisits without payload that refer
to it; payloads below ``min_revisit`` bytes are always responses.

Defined cases: a null html is an empty payload; a null page_id counts as the
smallest, and among equal rows with equal ids exactly one is the response; a
null url is written as an empty target; an empty table gives no records.  The pages
are read twice and have to come in the same order, as those of a stored table do.
"""
from __future__ import annotations

import base64
import hashlib
import itertools
import re
import zlib

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import member_test, scratch, staged

CRLF = "\r\n"
TERMINATOR = CRLF * 2
#: An empty gzip member.
EMPTY_MEMBER = bytes.fromhex("1f8b08000000000000030300000000000000" "0000")
FILE_BYTES = 32 << 20
HEAD = re.compile(rb"WARC/1\.1\r\n(.*?)\r\n\r\n", re.S)


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def base32(hexed):
    """Upper-case base32 of 40 hexadecimal digits, as a column."""
    alphabet = F.lit("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")
    parts = []
    for group in range(8):
        bits = F.conv(F.substring(hexed, 5 * group + 1, 5), 16, 10).cast("long")
        for k in (15, 10, 5, 0):
            parts.append(F.substring(alphabet, (F.shiftright(bits, k).bitwiseAND(F.lit(31)) + 1).cast("int"), F.lit(1)))
    return F.concat(*parts)


def classified(pages: DataFrame, min_revisit: int = 0) -> DataFrame:
    """``row, page_id, url, html, payload_bytes, payload_digest, record_type, refers_to`` of every page."""
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.coalesce(F.col("url").cast("string"), F.lit("")).alias("url"),
                        F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    payload = F.col("html").cast("binary")
    rows = rows.withColumn("row", F.monotonically_increasing_id()) \
        .withColumn("payload_bytes", F.octet_length(F.col("html").cast("binary")).cast("long")) \
        .withColumn("sha1", F.sha1(F.col("html").cast("binary")))
    slim = staged(rows.drop("html"), "payloads")
    best = slim.filter(F.col("payload_bytes") >= min_revisit).groupBy("sha1", "payload_bytes") \
        .agg(F.max(F.struct(F.col("page_id").isNotNull().alias("known"), "page_id", "row")).alias("best"), F.count(F.lit(1)).alias("n")) \
        .filter("n > 1").select("sha1", "payload_bytes", "best")
    again = staged(slim.join(best, ["sha1", "payload_bytes"]).filter("row <> best.row")
                   .withColumn("refers_to", F.col("best.page_id")).drop("best"), "revisits")
    # Payloads stay where they were read: responses pass by, and revisits need none.
    maybe = member_test(again.select(F.xxhash64("row").alias("k")), "k")
    marked = rows.withColumn("maybe", maybe(F.xxhash64("row")))
    response = marked.filter("not maybe").drop("maybe") \
        .unionByName(marked.filter("maybe").drop("maybe").join(again.select("row"), "row", "left_anti"))
    return response.withColumns({"refers_to": F.lit(None).cast("long"), "record_type": F.lit("response")}) \
        .unionByName(again.withColumns({"html": F.lit(""), "record_type": F.lit("revisit")})) \
        .withColumn("payload_digest", base32(F.col("sha1"))).drop("sha1")


def _record(c=F.col):
    """A WARC record without its terminator, as bytes."""
    def header(name, value):
        return F.concat(F.lit(f"{name}: "), value, F.lit(CRLF))

    def number(column):
        return F.coalesce(c(column).cast("string"), F.lit(""))

    revisit = c("record_type") == "revisit"
    head = F.concat(
        F.lit("WARC/1.1" + CRLF),
        header("WARC-Type", c("record_type")),
        header("WARC-Record-ID", F.concat(F.lit("<urn:row:"), c("row").cast("string"), F.lit(">"))),
        header("WARC-Target-URI", F.regexp_replace("url", r"[\r\n]+", " ")),
        header("WARC-Payload-Digest", F.concat(F.lit("sha1:"), c("payload_digest"))),
        header("X-Page-ID", number("page_id")),
        header("X-Payload-Length", number("payload_bytes")),
        F.when(revisit, F.concat(
            header("WARC-Profile", F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")),
            header("X-Refers-To-Page", number("refers_to")))).otherwise(F.lit("")),
        header("Content-Type", F.lit("text/html; charset=utf-8")),
        header("Content-Length", F.when(revisit, F.lit("0")).otherwise(number("payload_bytes"))),
        F.lit(CRLF))
    return F.concat(head.cast("binary"), F.when(revisit, F.lit("")).otherwise(c("html")).cast("binary"))


def write_monolithic(records: DataFrame, path: str, file_bytes: int = FILE_BYTES) -> None:
    """Write ``records`` (of :func:`classified`) as WARC files, each one gzip stream."""
    size = records.agg(F.avg(F.col("payload_bytes") + 600).alias("m")).first()["m"] or 1.0
    records.select(_record().cast("string").alias("value")).write.option("lineSep", TERMINATOR).option("compression", "gzip") \
        .option("maxRecordsPerFile", max(1, int(file_bytes / size))).text(path)


def fields_of(head: bytes) -> dict[str, str]:
    """Header fields, line by line: what a value holds is no field."""
    return dict(line.split(": ", 1) for line in head.decode("utf-8", "surrogateescape").split(CRLF))


def members(content: bytes):
    """Record bytes (with terminator) of a monolithic archive, inflated as one stream."""
    stream = zlib.decompressobj(wbits=31)
    buffer, at = bytearray(), 0
    view = memoryview(content)
    step = 1 << 20
    k = 0
    while True:
        data = b""
        if k < len(view) and not stream.eof:
            data = stream.decompress(view[k:k + step])
            k += step
        elif k >= len(view) or stream.eof:
            data = stream.flush()
        buffer += data
        while (m := HEAD.match(buffer, at)) is not None:
            length = int(fields_of(m[1])["Content-Length"])
            stop = m.end() + length + len(TERMINATOR)
            if stop > len(buffer):
                break
            yield bytes(buffer[at:stop])
            at = stop
        del buffer[:at]
        at = 0
        if not data and (stream.eof or k >= len(view)):
            if buffer:
                raise ValueError("the archive ends inside a record")
            return


def headers(record: bytes) -> tuple[dict[str, str], bytes]:
    m = HEAD.match(record)
    fields = fields_of(m[1])
    return fields, record[m.end():m.end() + int(fields["Content-Length"])]


def _compress(record: bytes) -> bytes:
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    return z.compress(record) + z.flush()


INDEX = ("archive string, seq long, offset long, length long, record_id string, record_type string, url string, "
          "page_id long, payload_digest string")


def _rewrite(batches):
    for b in batches:
        for content in b["content"]:
            rows = []
            for record in members(content):
                rows.append(_compress(record))
                if len(rows) == 2000:
                    yield pd.DataFrame({"member": rows})
                    rows = []
            if rows:
                yield pd.DataFrame({"member": rows})


def walk(content: bytes):
    """Offset, length and bytes of every record of a normalised archive."""
    view, at = memoryview(content), 0
    while at < len(view):
        stream, k, record = zlib.decompressobj(wbits=31), at, bytearray()
        while not stream.eof:
            record += stream.decompress(view[k:k + 65536])
            k += 65536
        length = min(k, len(view)) - at - len(stream.unused_data)
        yield at, length, bytes(record)
        at += length + len(EMPTY_MEMBER)


def _entries(batches):
    """Offset, length and headers of every record of normalised archives."""
    for b in batches:
        for path, content in zip(b["path"], b["content"]):
            name, rows = path.rsplit("/", 1)[-1], []
            for at, length, record in walk(content):
                fields, _ = headers(record)
                page = fields.get("X-Page-ID", "")
                rows.append((name, len(rows), at, length, fields["WARC-Record-ID"], fields["WARC-Type"],
                             fields.get("WARC-Target-URI", ""), int(page) if page else None,
                             fields["WARC-Payload-Digest"].removeprefix("sha1:")))
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in INDEX.split(", ")]).astype({"page_id": "Int64"})


def normalise(spark: SparkSession, source: str, path: str) -> DataFrame:
    """Rewrite the archives at ``source`` with a member for each record, to ``path``.

    Returns the index, which is also written to ``path-index``.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(source).select("content")
    files.mapInPandas(_rewrite, "member binary").select(F.col("member").cast("string").alias("value")) \
        .write.option("lineSep", EMPTY_MEMBER.decode("latin-1")).option("encoding", "ISO-8859-1").text(path)
    index = _files(spark, path).mapInPandas(_entries, INDEX)
    index.write.parquet(path + "-index")
    return spark.read.schema(index.schema).parquet(path + "-index")


def _files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).filter("length > 0").select("path", "content")


def _row(archive: str, record: bytes) -> tuple:
    fields, payload = headers(record)
    page, to = fields.get("X-Page-ID", ""), fields.get("X-Refers-To-Page", "")
    revisit = fields["WARC-Type"] == "revisit"
    return (archive, int(page) if page else None, fields.get("WARC-Target-URI", ""),
            int(fields["X-Payload-Length"]) if revisit else len(payload),
            fields["WARC-Payload-Digest"].removeprefix("sha1:") if revisit else base32_sha1(payload),
            fields["WARC-Type"], int(to) if to else None, payload)


RECORD = ("archive string, page_id long, url string, payload_bytes long, payload_digest string, record_type string, "
          "refers_to long, payload binary")


def _records(rows):
    names = [c.split()[0] for c in RECORD.split(", ")]
    for group in iter(lambda: list(itertools.islice(rows, 1000)), []):
        yield pd.DataFrame(group, columns=names).astype({"page_id": "Int64", "refers_to": "Int64"})


def _walk(batches):
    for b in batches:
        for path, content in zip(b["path"], b["content"]):
            name = path.rsplit("/", 1)[-1]
            yield from _records(_row(name, record) for _, _, record in walk(content))


def _slices(batches):
    for b in batches:
        for name, content, places in zip(b["archive"], b["content"], b["places"]):
            yield from _records(_row(name, zlib.decompress(content[p["offset"]:p["offset"] + p["length"]], wbits=31)) for p in places)


def read_records(spark: SparkSession, path: str, index: DataFrame | None = None) -> DataFrame:
    """The records of normalised archives: all of them, or those in ``index``, each at its place.

    Responses: length and digest of the payload that was read; revisits: as their headers say.
    """
    if index is None:
        return _files(spark, path).mapInPandas(_walk, RECORD)
    places = index.groupBy("archive").agg(F.array_sort(F.collect_list(F.struct("offset", "length"))).alias("places"))
    files = _files(spark, path).select(F.element_at(F.split("path", "/"), -1).alias("archive"), "content")
    return files.join(places, "archive").mapInPandas(_slices, RECORD)


def round_trip(pages: DataFrame, min_revisit: int = 0, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Write, normalise and read back ``pages``: ``page_id, payload_bytes, payload_digest, record_type, refers_to, url``."""
    spark = pages.sparkSession
    raw, path = scratch(spark, "warc"), scratch(spark, "archives")
    write_monolithic(classified(pages, min_revisit), raw, file_bytes)
    normalise(spark, raw, path)
    return read_records(spark, path).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url")
