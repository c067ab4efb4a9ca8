"""WARC derivatives: from response records to linked metadata and plain-text conversion records.

A response record has the columns record_id, target_uri, date, http_headers and payload.  Each
gives a metadata record (JSON with its headers, title and links) and a conversion record (its
text), which both refer to the response's id and carry its headers and digests on.  Records
are written as gzip files of WARC/1.1 records and read back by their headers and lengths.
"""

from __future__ import annotations

import base64
import hashlib
import html as entities
import json
import re
import uuid
from collections.abc import Iterator
from urllib.parse import urljoin

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from orderflow.llm.common import slices, small_batches
from orderflow.llm.htmltext import INLINE, TOKEN

VERSION = "WARC/1.1"
END = "\r\n"
SPACE = uuid.UUID("5b9a3c1e-6f0d-5c2a-9d53-0b6d9c1f7a42")
RECORD = (
    "record_type string, record_id string, refers_to string, target_uri string, date string, content_type string, "
    "block_digest string, source_block_digest string, source_payload_digest string, source_headers string, "
    "content_length long, content string"
)
LINK = re.compile(r"""\b(href|src|action)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
LINKING = {"a": "href", "area": "href", "link": "href", "img": "src", "script": "src", "iframe": "src", "form": "action"}
TITLE = re.compile(r"<title\b[^>]*>(.*?)(?:</title\s*>|\Z)", re.S | re.I)


def digest(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(*parts: str) -> str:
    """The same id for the same record on every run."""
    return f"<urn:uuid:{uuid.uuid5(SPACE, '|'.join(parts))}>"


def responses(
    pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html", date: str = "1970-01-01T00:00:00Z"
) -> DataFrame:
    """Response records of fetched pages, with the key handed on.

    NULL html is an empty body and a NULL url no target; equal rows are one record repeated.
    """
    body = F.coalesce(F.col(html), F.lit(""))
    name = F.md5(F.concat_ws("|", F.coalesce(F.col(key).cast("string"), F.lit("")), F.coalesce(url, F.lit("")), F.sha1(body)))
    parts = [F.substring(name, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    headers = ["HTTP/1.1 200 OK", "Content-Type: text/html; charset=utf-8"]
    return pages.select(
        key,
        F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *parts), F.lit(">")).alias("record_id"),
        F.col(url).alias("target_uri"),
        F.lit(date).alias("date"),
        F.concat(F.lit(END.join([*headers, "Content-Length: "])), F.octet_length(body).cast("string")).alias("http_headers"),
        body.alias("payload"),
    )


def plain_text(html: str) -> str:
    """All text outside markup, scripts and styles: a line per block, single spaces."""
    blocks: list[list[str]] = [[]]
    for match in TOKEN.finditer(html):
        _, _, name, _, text = match.groups()
        if text is not None:
            blocks[-1].append(text)
        elif name and name.lower() not in INLINE:
            blocks.append([])
    lines = (" ".join(entities.unescape("".join(b)).split()) for b in blocks if b)
    return "\n".join(line for line in lines if line)


def described(html: str, base: str | None) -> tuple[str, list[dict]]:
    """Title and links, each with its element and absolute target."""
    title = TITLE.search(html)
    links = []
    for match in TOKEN.finditer(html):
        raw, closing, name, attributes, _ = match.groups()
        if raw:
            name, attributes = raw, match.group(0).partition(">")[0]
        if not name or closing or name.lower() not in LINKING:
            continue
        for kind, a, b, c in LINK.findall(attributes):
            if kind.lower() == LINKING[name.lower()]:
                target = entities.unescape(a or b or c).strip()
                try:
                    target = urljoin(base or "", target)
                except ValueError:
                    pass
                links.append({"path": f"{name.upper()}@/{kind.lower()}", "url": target})
    return " ".join(entities.unescape(title.group(1)).split()) if title else "", links


def _derived(record: str, uri: str | None, date: str | None, headers: str | None, payload: str | None) -> list[tuple]:
    headers, body = headers or "", (payload or "").encode()
    block = headers.encode() + b"\r\n\r\n" + body
    digests = digest(block), digest(body)
    title, links = described(payload or "", uri)
    lines = headers.split(END)
    metadata = {
        "Envelope": {
            "WARC-Header-Metadata": {
                "WARC-Record-ID": record, "WARC-Target-URI": uri, "WARC-Date": date, "WARC-Type": "response",
                "WARC-Block-Digest": digests[0], "WARC-Payload-Digest": digests[1], "Content-Length": len(block),
            },
            "Payload-Metadata": {
                "HTTP-Response-Metadata": {
                    "Response-Message": lines[0],
                    "Headers": [[k.strip(), v.strip()] for k, _, v in (line.partition(":") for line in lines[1:]) if k],
                    "HTML-Metadata": {"Title": title, "Links": links},
                }
            },
        }
    }
    out = []
    contents = (
        ("metadata", "application/json", json.dumps(metadata, ensure_ascii=False, sort_keys=True)),
        ("conversion", "text/plain; charset=utf-8", plain_text(payload or "")),
    )
    for kind, content_type, content in contents:
        data = content.encode("utf-8", "replace")
        row = (kind, record_id(kind, record), record, uri, date, content_type, digest(data), *digests, headers, len(data), content)
        out.append(row)
    return out


def _beside(names: list[str], keep: list[str]) -> dict[str, str]:
    """The kept columns' names, none of them among ``names`` or twice."""
    taken, given = {n.lower() for n in names}, {}
    for column in keep:
        name = column
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        given[column] = name
    return given


def derive(records: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """A metadata and a conversion record per response; columns in ``keep`` come first.

    One that is named like a record's own column gets underscores before its name.

    Responses are independent, so nothing is shuffled.  A NULL payload or header counts as
    empty; a record without an id is skipped, for nothing could refer to it.  Texts of any
    length are handled one response at a time.
    """
    keep = list(keep or [])
    small_batches(records.sparkSession)
    source = ["record_id", "target_uri", "date", "http_headers", "payload"]
    given = _beside([c.split()[0] for c in RECORD.split(", ")], keep)

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [c.split()[0] for c in RECORD.split(", ")]
        kinds = [pa.int64() if c.endswith("long") else pa.string() for c in RECORD.split(", ")]
        for batch in slices(batches, "payload", 4 << 20):
            rows, of = [], []
            for i, row in enumerate(zip(*(batch.column(c).to_pylist() for c in source))):
                rows.extend(_derived(*row))
                of.extend([i] * 2)
            handed = [batch.column(c).take(pa.array(of, pa.int32())) for c in keep]
            columns = [pa.array(c, t) for c, t in zip(zip(*rows), kinds)]
            yield pa.RecordBatch.from_arrays([*handed, *columns], [*given.values(), *names])

    frame = records.where(F.col("record_id").isNotNull()).select(*dict.fromkeys([*keep, *source]))
    handed = "".join(f"`{given[c]}` {frame.schema[c].dataType.simpleString()}, " for c in keep)
    return frame.mapInArrow(build, handed + RECORD)


def _header(name: str, value: Column) -> Column:
    """A header line; line ends in a value (of a url, say) are written as in urls and begin no other header."""
    held = F.replace(F.replace(value.cast("string"), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    return F.concat(F.lit(f"{name}: "), held)


def serialised(records: DataFrame) -> DataFrame:
    """Derived records as WARC text, in one column ``value``."""
    lines = F.concat_ws(
        END,
        F.lit(VERSION),
        _header("WARC-Type", F.col("record_type")),
        _header("WARC-Record-ID", F.col("record_id")),
        _header("WARC-Refers-To", F.col("refers_to")),
        _header("WARC-Target-URI", F.col("target_uri")),
        _header("WARC-Date", F.col("date")),
        _header("WARC-Block-Digest", F.col("block_digest")),
        _header("WARC-Source-Block-Digest", F.col("source_block_digest")),
        _header("WARC-Source-Payload-Digest", F.col("source_payload_digest")),
        _header("WARC-Source-HTTP-Headers", F.regexp_replace(F.base64(F.encode("source_headers", "UTF-8")), r"\s+", "")),
        _header("Content-Type", F.col("content_type")),
        _header("Content-Length", F.col("content_length")),
    )
    return records.select(F.concat(lines, F.lit(END * 2), F.col("content")).alias("value"))


def write_records(records: DataFrame, path: str) -> None:
    """Gzip files of records, each followed by two line ends; Spark's own text writer."""
    serialised(records).write.mode("overwrite").option("compression", "gzip").option("lineSep", END * 2).text(path)


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """The records of such files: their headers as a map, and the content by its length."""
    # No content holds a carriage return, so only a record can begin like this.
    begin = f"{VERSION}{END}WARC-Type: "
    value = F.concat(F.lit("WARC-Type: "), F.regexp_replace("value", f"^{begin}", ""))
    rows = spark.read.option("lineSep", f"{END * 2}{begin}").text(path).select(value.alias("value"))
    at = F.locate(END * 2, F.col("value"))
    headers = F.split(F.substring("value", F.lit(1), at - 1), END)
    pairs = F.transform(
        headers, lambda h: F.struct(F.regexp_extract(h, "^([^:]*): ", 1), F.regexp_replace(h, "^[^:]*: ", ""))
    )
    rows = rows.select(F.map_from_entries(pairs).alias("headers"), F.substring("value", at + 4, F.length("value")).alias("rest"))
    length = F.col("headers")["Content-Length"].cast("int")
    return rows.select("headers", F.decode(F.substring(F.encode("rest", "UTF-8"), F.lit(1), length), "UTF-8").alias("content"))
