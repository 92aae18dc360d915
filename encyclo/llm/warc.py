"""WARC derivatives: linked metadata and plain-text conversion records of responses.

``responses`` makes response records of crawled pages, ``read_records`` reads
records from WARC files.  ``derive`` turns each response into a ``metadata``
record (JSON: title, links, source headers and digests) and a ``conversion``
record (plain text).  Both refer to the response by WARC-Refers-To, keep its
target, date and source headers, and carry digests of their own block and of
the source's payload.  ``serialise`` gives a record's bytes, one gzip member
each, so members of any number of partitions concatenate to a valid file.

Record ids are name-based, so a repeated task makes the same ids.  All of
``responses`` and ``derive`` are column expressions: nothing is shuffled.

Null urls, bodies and dates read as empty; a page without html has an empty
text, no title and no links.  Repeated pages make repeated records.  Columns
that clash with the records' are not carried over.
"""

from __future__ import annotations

import gzip
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

VERSION = "WARC/1.1"
DATE = "1970-01-01T00:00:00Z"

# The five entities of XML and the no-break space, in decoding order.
ENTITIES = [("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")]
HIDDEN = r"(?is)<script(?:\s[^>]*)?>.*?</script>|<style(?:\s[^>]*)?>.*?</style>|<head(?:\s[^>]*)?>.*?</head>|<!--.*?-->"
BREAKS = r"(?i)<(br|p|div|li|ul|ol|tr|td|th|table|h[1-6]|article|section|nav|header|footer|body|html|title)\b[^>]*>|</(p|div|li|ul|ol|tr|td|th|table|h[1-6]|article|section|nav|header|footer|body|html|title)>"
TAGS = r"(?s)<[a-zA-Z/!][^>]*>"

RECORD = T.StructType([
    T.StructField("record_id", T.StringType()), T.StructField("type", T.StringType()),
    T.StructField("headers", T.MapType(T.StringType(), T.StringType())), T.StructField("block", T.BinaryType())])


def digest(block: Column) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(block, 256))


def record_id(kind: str, *parts: Column) -> Column:
    """Name-based urn:uuid of a record."""
    h = F.md5(F.concat_ws("|", F.lit(kind), *parts).cast("binary"))
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *[F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]), F.lit(">"))


def decoded(text: Column) -> Column:
    for entity, character in ENTITIES:
        text = F.replace(text, F.lit(entity), F.lit(character))
    return text


def plain_text(html: Column) -> Column:
    """Visible text: hidden elements and tags out, a line per block element."""
    text = F.regexp_replace(F.regexp_replace(F.regexp_replace(html, HIDDEN, " "), BREAKS, "\n"), TAGS, "")
    text = F.regexp_replace(F.regexp_replace(decoded(text), r"[ \t\r\f]+", " "), r" ?\n[ \n]*", "\n")
    return F.regexp_replace(text, r"^[ \n]+|[ \n]+$", "")


def title_of(html: Column) -> Column:
    return F.trim(decoded(F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1)))


def links_of(html: Column) -> Column:
    return F.regexp_extract_all(html, F.lit(r'(?i)<a [^>]*href="([^"]*)"'), F.lit(1))


def responses(pages: DataFrame, url_col: str = "url", html_col: str = "html", id_col: str = "page_id", date: str = DATE) -> DataFrame:
    """Response records (id, record_id, type, headers, block) of crawled pages; the block is the HTTP message."""
    url = F.coalesce(F.col(url_col), F.lit(""))
    body = F.coalesce(F.col(html_col), F.lit("")).cast("binary")
    head = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "),
                    F.octet_length(body).cast("string"), F.lit("\r\n\r\n")).cast("binary")
    block = F.concat(head, body)
    rid = record_id("response", F.col(id_col).cast("string"), url, F.sha2(body, 256))
    headers = F.map_from_arrays(
        F.array(*[F.lit(k) for k in ("WARC-Type", "WARC-Record-ID", "WARC-Date", "WARC-Target-URI", "Content-Type",
                                     "WARC-Payload-Digest", "WARC-Block-Digest", "Content-Length")]),
        F.array(F.lit("response"), rid, F.lit(date), url, F.lit("application/http; msgtype=response"), digest(body),
                digest(block), F.octet_length(block).cast("string")))
    return pages.select(F.col(id_col).alias("id"), rid.alias("record_id"), F.lit("response").alias("type"),
                        headers.alias("headers"), block.alias("block"))


def http_parts(block: Column) -> tuple[Column, Column]:
    """HTTP header lines and body of a response block (without an empty line: all headers, no body)."""
    at = F.instr(F.decode(block, "ISO-8859-1"), "\r\n\r\n")  # a character per byte
    cut = F.when(at > 0, at).otherwise(F.octet_length(block) + 1)
    return (F.decode(F.substring(block, F.lit(1), cut - 1), "UTF-8"),
            F.substring(block, cut + 4, F.greatest(F.octet_length(block) - cut - 3, F.lit(0))))


def derive(records: DataFrame) -> DataFrame:
    """Metadata and conversion records (id, record_id, type, headers, block) of the response records."""
    found = records.where(F.col("type") == "response")
    source, body = http_parts(F.col("block"))
    h = F.col("headers")
    of = found.select("id", F.col("record_id").alias("source_id"), h.alias("h"), source.alias("source"),
                      F.decode(body, "UTF-8").alias("html"), digest(body).alias("payload"))
    uri, date = F.coalesce(F.col("h")["WARC-Target-URI"], F.lit("")), F.coalesce(F.col("h")["WARC-Date"], F.lit(DATE))
    meta = F.to_json(F.struct(
        title_of(F.col("html")).alias("title"), links_of(F.col("html")).alias("links"), F.col("source").alias("http_headers"),
        F.struct(F.col("source_id").alias("record_id"), F.col("payload").alias("payload_digest"),
                 F.coalesce(F.col("h")["WARC-Block-Digest"], F.lit("")).alias("block_digest"),
                 F.coalesce(F.col("h")["Content-Length"], F.lit("")).alias("content_length")).alias("source")))
    made = of.select("id", "source_id", "payload", uri.alias("uri"), date.alias("date"), F.explode(F.array(
        F.struct(F.lit("metadata").alias("type"), F.lit("application/json").alias("mime"), meta.cast("binary").alias("block")),
        F.struct(F.lit("conversion").alias("type"), F.lit("text/plain; charset=utf-8").alias("mime"),
                 plain_text(F.col("html")).cast("binary").alias("block")))).alias("r")).select("*", "r.*")
    rid = F.when(F.col("type") == "metadata", record_id("metadata", F.col("source_id"))).otherwise(record_id("conversion", F.col("source_id")))
    headers = F.map_from_arrays(
        F.array(*[F.lit(k) for k in ("WARC-Type", "WARC-Record-ID", "WARC-Date", "WARC-Target-URI", "WARC-Refers-To",
                                     "WARC-Refers-To-Target-URI", "WARC-Refers-To-Date", "Content-Type", "WARC-Source-Payload-Digest",
                                     "WARC-Block-Digest", "Content-Length")]),
        F.array(F.col("type"), rid, F.col("date"), F.col("uri"), F.col("source_id"), F.col("uri"), F.col("date"), F.col("mime"),
                F.col("payload"), digest(F.col("block")), F.octet_length("block").cast("string")))
    return made.select("id", rid.alias("record_id"), "type", headers.alias("headers"), "block")


def record_bytes(headers: dict, block: bytes) -> bytes:
    lines = "".join(f"{k}: {v}\r\n" for k, v in headers.items())
    return f"{VERSION}\r\n{lines}\r\n".encode() + block + b"\r\n\r\n"


def serialise(records: DataFrame) -> DataFrame:
    """``records`` plus ``member``: the record as a gzip member."""
    def run(batches: Iterator[pa.RecordBatch]):
        for b in batches:
            head, block = (b.column(b.schema.get_field_index(c)).to_pylist() for c in ("headers", "block"))
            made = [gzip.compress(record_bytes(dict(h), x), mtime=0) for h, x in zip(head, block)]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(made, pa.binary())], names=[*b.schema.names, "member"])
    return records.mapInArrow(run, T.StructType([*records.schema, T.StructField("member", T.BinaryType())]))


def parse(data: bytes) -> Iterator[tuple[dict, bytes]]:
    """(headers, block) of all records of a WARC file's bytes, compressed or not."""
    if data[:2] == b"\x1f\x8b":
        data = gzip.decompress(data)
    at = 0
    while at < len(data):
        end = data.index(b"\r\n\r\n", at)
        lines = data[at:end].decode().split("\r\n")[1:]
        headers = dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in lines)
        size = int(headers["Content-Length"])
        yield headers, data[end + 4:end + 4 + size]
        at = end + 4 + size + 4


def read_records(spark, path: str) -> DataFrame:
    """Records of all WARC files under ``path``; ``id`` is the file and the place in it."""
    def run(batches):
        for b in batches:
            for name, content in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                for k, (headers, block) in enumerate(parse(content)):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([f"{name}#{k}"]), pa.array([headers.get("WARC-Record-ID")]), pa.array([headers.get("WARC-Type")]),
                         pa.array([list(headers.items())], pa.map_(pa.string(), pa.string())), pa.array([block], pa.binary())],
                        names=["id", "record_id", "type", "headers", "block"])
    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInArrow(run, T.StructType([T.StructField("id", T.StringType()), *RECORD]))
