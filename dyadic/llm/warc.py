"""WARC derivatives: responses become linked metadata records and plain-text conversion records.

Records are rows (record_id, type, uri, date, headers, block): `headers` are the WARC fields in order, `block` the bytes.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import html
import re
import uuid
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Stands for the crawl time that the pages table does not hold.
DATE = "2024-01-01T00:00:00Z"
FIELD = T.StructType([T.StructField("name", T.StringType()), T.StructField("value", T.StringType())])
RECORD = T.StructType([
    T.StructField("record_id", T.StringType()), T.StructField("type", T.StringType()), T.StructField("uri", T.StringType()),
    T.StructField("date", T.StringType()), T.StructField("headers", T.ArrayType(FIELD)), T.StructField("block", T.BinaryType()),
])
_HIDDEN = re.compile(r"<!--.*?(?:-->|\Z)|<(script|style|head|template|noscript)\b.*?(?:</\1\s*>|\Z)", re.S | re.I)
_BREAKS = re.compile(r"<(?:br|/?(?:p|div|li|ul|ol|h[1-6]|tr|table|article|section|nav|header|footer|aside|main|blockquote|pre|dl|dt|dd|form|hr))\b[^>]*>", re.I)
_TAGS = re.compile(r"<[a-z/!?][^>]*>", re.I)
_SPACES = re.compile(r"[^\S\n]+")
_LINES = re.compile(r" ?\n[ \n]*")


def digest(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(*parts: str) -> str:
    """The same parts give the same id, so reruns and retried tasks agree."""
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, chr(0).join(parts))}>"


def plain_text(markup: str) -> str:
    """Visible text of a whole page: hidden elements and tags go, block elements end lines, entities are resolved."""
    text = _TAGS.sub("", _BREAKS.sub("\n", _HIDDEN.sub("", markup)))
    return _LINES.sub("\n", _SPACES.sub(" ", html.unescape(text).replace("\r", "\n"))).strip(" \n")


def record(kind: str, uri: str | None, date: str, block: bytes, rid: str, content_type: str, extra: list[tuple[str, str]]) -> dict:
    headers = [("WARC-Type", kind), ("WARC-Record-ID", rid), ("WARC-Date", date)]
    headers += [("WARC-Target-URI", uri)] if uri else []
    headers += [*extra, ("WARC-Block-Digest", digest(block)), ("Content-Type", content_type), ("Content-Length", str(len(block)))]
    return {"record_id": rid, "type": kind, "uri": uri, "date": date, "headers": [{"name": n, "value": v} for n, v in headers], "block": block}


def split_http(block: bytes) -> tuple[str, list[tuple[str, str]], bytes]:
    """Status line, headers and body of an HTTP response; a block without an end of headers is all body."""
    head, gap, body = block.partition(b"\r\n\r\n")
    if not gap:
        return "", [], block
    first, *lines = head.decode("latin-1").split("\r\n")
    fields: list[tuple[str, str]] = []
    for line in lines:
        name, colon, value = line.partition(":")
        if colon and not line[:1].isspace():
            fields.append((name.strip(), value.strip()))
        elif fields:  # a folded line carries on the one before
            fields[-1] = (fields[-1][0], f"{fields[-1][1]} {line.strip()}")
    return first, fields, body


def _decoded(fields: dict[str, str], body: bytes) -> str:
    packing = fields.get("content-encoding", "").lower()
    try:
        if packing in ("gzip", "x-gzip"):
            body = gzip.decompress(body)
        elif packing == "deflate":
            body = zlib.decompress(body)
    except (OSError, EOFError, zlib.error):
        pass  # such a body is read as it stands
    named = re.search(r"charset\s*=\s*[\"']?([\w.:-]+)", fields.get("content-type", ""), re.I)
    try:
        return body.decode(named[1] if named else "utf-8", "replace")
    except LookupError:
        return body.decode("utf-8", "replace")


def derive(rid: str, uri: str | None, date: str, headers: list[tuple[str, str]], block: bytes) -> Iterator[dict]:
    """The metadata record of a response and, for text, its conversion record.

    Both refer to the response by WARC-Refers-To and keep its date as WARC-Refers-To-Date. The metadata block holds the
    status line, every HTTP header, and the source's WARC fields and digests; a payload digest that the source lacks is
    computed. Each derived record names the other one in the block or by WARC-Concurrent-To.
    """
    status, http, body = split_http(block)
    source = {n.lower(): v for n, v in headers}
    payload = source.get("warc-payload-digest") or digest(body)
    by_name = {n.lower(): v for n, v in http}
    kind = by_name.get("content-type", "").split(";")[0].strip().lower()
    readable = not kind or kind.startswith("text/") or kind == "application/xhtml+xml"
    meta, text = record_id("metadata", rid), record_id("conversion", rid)
    link = [("WARC-Refers-To", rid), ("WARC-Refers-To-Date", date)] + ([("WARC-Refers-To-Target-URI", uri)] if uri else [])
    lines = [("http-status", status)] + [(f"http-{n.lower()}", v) for n, v in http]
    lines += [(f"source-{n.lower()}", v) for n, v in headers] + [("source-payload-digest", payload)]
    lines += [("derived-conversion", text)] if readable else []
    fields = "".join(f"{n}: {v}\r\n" for n, v in lines).encode("utf-8", "surrogatepass")
    yield record("metadata", uri, date, fields, meta, "application/warc-fields", link)
    if readable:
        decoded = _decoded(by_name, body)
        plain = decoded if kind == "text/plain" else plain_text(decoded)
        link = link + [("WARC-Concurrent-To", meta), ("WARC-Source-Payload-Digest", payload)]
        yield record("conversion", uri, date, plain.encode("utf-8", "surrogatepass"), text, "text/plain; charset=utf-8", link)


def responses(pages: DataFrame, date: str = DATE) -> DataFrame:
    """Response records of `pages` (page_id, url, html) in the form a crawler writes, one per row.

    A null html is an empty body, a null url leaves the target URI out. The id is made of page_id, url and html, so
    repeated rows are repeated records of one id.
    """

    def make(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pages in batches:
            rows = []
            for page, url, markup in zip(pages["page_id"], pages["url"], pages["html"]):
                body = (markup or "").encode("utf-8", "surrogatepass")
                block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(body) + body
                rid = record_id("response", page or "", url or "", digest(body))
                rows.append(record("response", url, date, block, rid, "application/http; msgtype=response", [("WARC-Payload-Digest", digest(body))])
                            | {"page_id": page})
            yield pd.DataFrame(rows, columns=["page_id", *RECORD.names])

    asked = pages.select(F.col("page_id").cast("string").alias("page_id"), "url", "html")
    return asked.mapInPandas(make, T.StructType([T.StructField("page_id", T.StringType()), *RECORD.fields]))


def derivatives(records: DataFrame) -> DataFrame:
    """Metadata and conversion records of the responses among `records`, with their `refers_to` and the columns beside them.

    Records of other types give nothing. A response without text gives only metadata. Null headers and blocks are empty.
    Repeated responses give repeated records; an empty table gives none. Responses are taken one by one, whole.
    """
    beside = [f for f in records.schema.fields if f.name not in (*RECORD.names, "refers_to")]
    out = T.StructType([*beside, T.StructField("refers_to", T.StringType()), *RECORD.fields])

    def make(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for r in batch.to_dict("records"):
                headers = [(h["name"], h["value"]) for h in (r["headers"] if r["headers"] is not None else [])]
                for made in derive(r["record_id"], r["uri"], r["date"], headers, r["block"] or b""):
                    rows.append({f.name: r[f.name] for f in beside} | {"refers_to": r["record_id"]} | made)
            yield pd.DataFrame(rows, columns=out.names)

    return records.filter("type = 'response'").mapInPandas(make, out)


def serialised(r: dict) -> bytes:
    head = "WARC/1.0\r\n" + "".join(f"{h['name']}: {h['value']}\r\n" for h in r["headers"]) + "\r\n"
    return head.encode("utf-8", "surrogatepass") + bytes(r["block"]) + b"\r\n\r\n"


def write_warc(records: DataFrame, path: str) -> None:
    """Write records as WARC files, one a partition, through Spark's own writer, so any store it knows will do.

    Spark's text writer passes bytes on and ends each row with two line breaks, as a WARC record ends.
    """
    def make(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"raw": [serialised(r)[:-4] for r in batch.to_dict("records")]})

    rows = records.select(*RECORD.names).mapInPandas(make, "raw binary")
    rows.select(F.col("raw").cast("string")).write.mode("errorifexists").option("lineSep", "\r\n\r\n").text(path)


def parse(data: bytes, name: str = "") -> Iterator[dict]:
    """Records of one WARC file, plain or gzipped, by their Content-Length. A cut-off record raises an error."""
    if data[:2] == b"\x1f\x8b":
        data = gzip.decompress(data)
    at = 0
    while at < len(data):
        end = data.find(b"\r\n\r\n", at)
        if not data.startswith(b"WARC/", at) or end < 0:
            raise ValueError(f"{name}: no WARC record at byte {at}")
        lines = data[at:end].decode("utf-8", "replace").split("\r\n")[1:]
        headers = [(n.strip(), v.strip()) for n, _, v in (x.partition(":") for x in lines)]
        by_name = {n.lower(): v for n, v in headers}
        size = int(by_name["content-length"])
        block = data[end + 4:end + 4 + size]
        if len(block) < size:
            raise ValueError(f"{name}: the record at byte {at} is cut off")
        yield {"record_id": by_name.get("warc-record-id"), "type": by_name.get("warc-type"), "uri": by_name.get("warc-target-uri"),
               "date": by_name.get("warc-date"), "headers": [{"name": n, "value": v} for n, v in headers], "block": block}
        at = end + 4 + size
        while data.startswith(b"\r\n", at):
            at += 2


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """Records of all WARC files under `path`. A file is one task's work, as its gzip members cannot be found from inside."""
    def make(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name, data in zip(batch["path"], batch["content"]):
                yield pd.DataFrame(list(parse(data, name)), columns=RECORD.names)

    files = spark.read.format("binaryFile").load(path)
    return files.filter("length > 0").select("path", "content").mapInPandas(make, RECORD)
