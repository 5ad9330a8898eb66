"""WARC derivatives: metadata and plain-text conversion records of responses.

Pages become response records; from each one the builder makes a metadata
record (title, language, links) and a conversion record (the page's plain
text). Both refer to the response by its identifier and carry its target URI
and date; digests are SHA-1 in base 32 as in WARC files.

Pages are read whole at any length, in time that grows with their length: each
search that fails once is not made again further on.

Defined results: a null url leaves the target URI out, a null html is an empty
page; both still give three records. Bytes that are not UTF-8 become replacement
characters. Of several titles the first counts. Repeated rows give equal records;
an empty table gives none. Extra columns are not read.
"""

from __future__ import annotations

import base64
import hashlib
import html as entities
import re
import uuid
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm.common import strings, table

DATE = "1970-01-01T00:00:00Z"
SPACE = uuid.UUID("7f3c2d52-7f0e-5a3b-9c39-6a7f5f5a7c11")
END = "\r\n\r\n"

_HIDDEN = re.compile(r"<!--|<(script|style|noscript|template|head)\b", re.I)
_CLOSED = {x: re.compile(rf"</{x}\s*>", re.I) for x in ("script", "style", "noscript", "template", "head", "title")}
_TAG = re.compile(r"<(?:/?([a-zA-Z][a-zA-Z0-9]*)|[!/?])[^>]*>")
_BREAK = frozenset("p div br li ul ol h1 h2 h3 h4 h5 h6 tr table section article header footer nav main blockquote pre hr title body html".split())
_CELL = frozenset("td th option select button input label img iframe".split())
_TITLE = re.compile(r"<title[^>]*>", re.I)
_HTML = re.compile(r"<html\b[^>]*>", re.I)
_LANG = re.compile(r"\blang\s*=\s*[\"']?([\w-]+)", re.I)
_ANCHOR = re.compile(r"<a\b[^>]*", re.I)
_HREF = re.compile(r"\bhref\s*=\s*", re.I)
_VALUE = re.compile(r"[^\s>]+")
_BLANKS, _LINES = re.compile(r"[^\S\n]+"), re.compile(r"\s*\n\s*")


def digest(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def shown(page: str) -> str:
    """The page with a blank in place of each comment and each element whose content is not shown; unclosed ones stay."""
    out, at, gone = [], 0, set()
    for m in _HIDDEN.finditer(page):
        kind = (m[1] or "!").lower()
        if m.start() < at or kind in gone:
            continue
        if kind == "!":
            end = page.find("-->", m.end()) + 3
            closed = end > 2
        else:
            opened = page.find(">", m.end()) if ">" not in gone else -1
            if opened < 0:
                gone.add(">")
                continue
            c = _CLOSED[kind].search(page, opened + 1)
            closed, end = c is not None, c.end() if c else 0
        if not closed:
            gone.add(kind)
            continue
        out += [page[at : m.start()], " "]
        at = end
    return "".join(out) + page[at:]


def _instead(tag: re.Match) -> str:
    kind = (tag[1] or "").lower()
    return "\n" if kind in _BREAK else " " if kind in _CELL else ""


def plain_text(page: str) -> str:
    """The page's visible text: a line for each block, a blank between cells, nothing in place of inline tags."""
    text = shown(page)
    end = text.rfind(">") + 1  # no tag ends beyond
    text = _TAG.sub(_instead, text[:end]) + text[end:]
    return _LINES.sub("\n", _BLANKS.sub(" ", entities.unescape(text))).strip()


def title_of(page: str) -> str | None:
    m = _TITLE.search(page, 0, page.rfind(">") + 1)
    end = _CLOSED["title"].search(page, m.end()) if m else None
    return page[m.end() : end.start()] if end else None


def language_of(page: str) -> str | None:
    for m in _HTML.finditer(page, 0, page.rfind(">") + 1):
        if said := _LANG.search(m[0]):
            return said[1].lower()
    return None


def links_of(page: str) -> list[str]:
    """Targets of the page's anchors, in order; a quoted one may hold any character but its quote."""
    out, at, gone = [], 0, set()
    for m in _ANCHOR.finditer(page):
        h = _HREF.search(page, m.start(), m.end()) if m.start() >= at else None
        if h is None:
            continue
        start, quote = h.end(), page[h.end() : h.end() + 1]
        if quote in ('"', "'") and quote not in gone:
            end = page.find(quote, start + 1)
            if end >= 0:
                out.append(page[start + 1 : end])
                at = end
                continue
            gone.add(quote)
        if value := _VALUE.match(page, start):
            out.append(value[0])
            at = value.end()
    return out


@dataclass
class Record:
    """A record's named fields, in order, and its block."""

    fields: dict[str, str]
    block: bytes

    @property
    def id(self) -> str:
        return self.fields["WARC-Record-ID"]

    def serialized(self) -> bytes:
        head = "".join(f"{k}: {v}\r\n" for k, v in self.fields.items())
        return f"WARC/1.1\r\n{head}\r\n".encode() + self.block + END.encode()


def _record(kind: str, ident: uuid.UUID, uri: str | None, content_type: str, block: bytes, **more: str) -> Record:
    fields = {"WARC-Type": kind, "WARC-Record-ID": f"<urn:uuid:{ident}>", "WARC-Date": DATE}
    if uri is not None:
        fields["WARC-Target-URI"] = " ".join(uri.split())
    fields |= {k.replace("_", "-"): v for k, v in more.items()}
    return Record(fields | {"WARC-Block-Digest": digest(block), "Content-Type": content_type, "Content-Length": str(len(block))}, block)


def response(page_id, url: str | None, page: str | None) -> Record:
    body = (page or "").encode("utf-8", "replace")
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(body)}\r\n\r\n".encode()
    ident = uuid.uuid5(SPACE, f"response\n{page_id}\n{url}\n{digest(body)}")
    return _record("response", ident, url, "application/http; msgtype=response", head + body, WARC_Payload_Digest=digest(body))


def derived(source: Record) -> tuple[Record, Record]:
    """The metadata and the conversion record of a response."""
    head, _, body = source.block.partition(b"\r\n\r\n")
    page = body.decode("utf-8", "replace")
    uri, ident = source.fields.get("WARC-Target-URI"), source.id
    title, lang = title_of(page), language_of(page)
    lines = [("title", " ".join(entities.unescape(title).split()))] if title is not None else []
    lines += [("language", lang)] if lang else []
    lines += [("http-" + k.strip().lower(), v.strip()) for k, _, v in (x.partition(":") for x in head.decode("latin-1").split("\r\n")[1:])]
    lines += [("outlink", " ".join(entities.unescape(x).split())) for x in links_of(page)]
    kept = {"WARC_Refers_To": ident, "WARC_Refers_To_Date": source.fields["WARC-Date"]} | ({"WARC_Refers_To_Target_URI": uri} if uri is not None else {})
    meta = _record("metadata", uuid.uuid5(SPACE, "metadata\n" + ident), uri, "application/warc-fields", "".join(f"{k}: {v}\r\n" for k, v in lines).encode(), **kept)
    said = plain_text(page).encode()
    conversion = _record("conversion", uuid.uuid5(SPACE, "conversion\n" + ident), uri, "text/plain; charset=utf-8", said, **kept, WARC_Payload_Digest=digest(said), WARC_Source_Payload_Digest=source.fields["WARC-Payload-Digest"])
    return meta, conversion


def parsed(data: bytes) -> list[Record]:
    """The records of a WARC file's bytes."""
    out, at = [], 0
    while at < len(data):
        stop = data.index(b"\r\n\r\n", at)
        first, *lines = data[at:stop].decode().split("\r\n")
        if first != "WARC/1.1":
            raise ValueError(f"no WARC/1.1 record at byte {at}")
        fields = dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in lines)
        size = int(fields["Content-Length"])
        out.append(Record(fields, data[stop + 4 : stop + 4 + size]))
        at = stop + 4 + size + len(END)
    return out


RECORDS = "page_id {}, kind string, record_id string, refers_to string, target_uri string, block_digest string, payload_digest string, content_length long, headers string, content string"


def records(pages: DataFrame, kinds: tuple[str, ...] = ("response", "metadata", "conversion")) -> DataFrame:
    """A row for each record of each page: its fields and its block as text."""
    shape = RECORDS.format(dict(pages.dtypes)["page_id"])
    names = [x.split()[0] for x in shape.split(", ")]

    def run(batches):
        for batch in batches:
            ids, rows = [], []
            for page_id, url, page in zip(batch.column("page_id").to_pylist(), strings(batch.column("url")), strings(batch.column("html"))):
                source = response(page_id, url, page)
                for r in (source, *derived(source)):
                    f = r.fields
                    if f["WARC-Type"] in kinds:
                        ids.append(page_id)
                        head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in f.items())
                        rows.append((f["WARC-Type"], r.id, f.get("WARC-Refers-To"), f.get("WARC-Target-URI"), f["WARC-Block-Digest"], f.get("WARC-Payload-Digest"), len(r.block), head, r.block.decode()))
            kinds_ = [pa.string()] * 6 + [pa.int64(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(ids, batch.column("page_id").type), *(pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds_))], names)

    return pages.select("page_id", "url", "html").mapInArrow(run, shape)


def write_warc(rows: DataFrame, path: str) -> None:
    """Writes records as WARC files; the sink's line separator is the end of a record."""
    rows.select(F.concat("headers", F.lit("\r\n"), "content").alias("value")).write.option("lineSep", END).mode("errorifexists").text(path)


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = records(table(spark, sf_dir, "pages"), kinds=("metadata", "conversion"))
    return got.select(
        "page_id", "kind", "record_id", "refers_to", "target_uri", "block_digest", "payload_digest", "content_length", "headers", "content",
        F.sha2(F.col("headers").cast("binary"), 256).alias("headers_sha256"),
        F.sha2(F.col("content").cast("binary"), 256).alias("content_sha256"),
    )
