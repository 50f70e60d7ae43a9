"""WARC derivatives: response records become linked metadata and plain-text conversion records."""

from __future__ import annotations

import base64
import hashlib
import html
import json
import re
import uuid
from itertools import islice

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.llm.common import tidied

RECORD = "record_id string, type string, target_uri string, date string, refers_to string, content_type string, headers map<string,string>, block_digest string, payload_digest string, content_length long, block string"
FIELDS = [x.split()[0] for x in RECORD.split(", ")]
VERSION = "WARC/1.1"
CHUNK = 500
DATE = "1970-01-01T00:00:00Z"

# Elements whose content is no text, elements that end a line, and where links are.
SILENT = ("script", "style", "noscript", "template", "svg", "iframe")
LINES = "address article aside blockquote br dd div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr li main nav ol p pre section table tbody td tfoot th thead title tr ul body head html".split()
LINKS = {"a": "href", "area": "href", "link": "href", "img": "src", "script": "src", "iframe": "src", "form": "action", "source": "src", "video": "src", "audio": "src"}

_NAME = re.compile(r"</?([A-Za-z][A-Za-z0-9:-]*)")
_STOP = re.compile("[>\"']")
_NUMBER = re.compile(r"&#([0-9]{8,});?")
_ATTRIBUTE = re.compile(r"([A-Za-z_:][-A-Za-z0-9_:.]*)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?")
_ENDS = {x: re.compile(rf"</{x}\s*>", re.I) for x in (*SILENT, "title", "textarea")}
_BLANKS = re.compile(r"[ \t\r\f\v\xa0]+")
_LINE_ENDS = re.compile(r" ?\n[ \n]*")


def digest(octets: bytes) -> str:
    """Labelled SHA-1 in base 32, as WARC writers give it."""
    return "sha1:" + base64.b32encode(hashlib.sha1(octets).digest()).decode("ascii")


def record_id(*parts: str) -> str:
    """A record's identifier from its content's: the same input gives the same record, on any executor and any try."""
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, chr(0).join(parts))}>"


def _plain(text: str) -> str:
    """Entities decoded; a number of more digits than any code point has is none."""
    if "&#" in text:
        text = _NUMBER.sub(lambda m: f"&#{n};" if len(n := m[1].lstrip("0")) < 8 else "\ufffd", text)
    return html.unescape(text)


def tags(text: str):
    """(start, end, name, closing, attributes) of the tags of a page, comments and declarations with an empty name, in one pass.

    A quoted ``>`` ends no tag; where that leaves a tag without an end, quotes count no more from there on. A ``<`` without
    any ``>`` after it is text. The caller may send the place from which to go on.
    """
    at, quoted, last = 0, True, text.rfind(">")
    held = {q: text.rfind(q) for q in "\"'"}
    while (a := text.find("<", at)) >= 0:
        if text.startswith("<!--", a):
            end = text.find("-->", a + 4)
            end = end + 3 if end >= 0 else len(text)
            at = (yield a, end, "", False, "") or end
            continue
        if a > last:
            return
        if text.startswith(("<!", "<?"), a):
            end = text.find(">", a) + 1
            at = (yield a, end, "", False, "") or end
            continue
        m = _NAME.match(text, a)
        if not m:
            at = a + 1
            continue
        end = m.end()
        while quoted:
            stop = _STOP.search(text, end)
            if not stop:
                quoted = False
                break
            end = stop.end()
            if stop[0] == ">":
                break
            if held[stop[0]] >= end:
                end = text.find(stop[0], end) + 1
        if not quoted:
            end = text.find(">", m.end()) + 1
        at = (yield a, end, m[1].lower(), text[a + 1] == "/", text[m.end() : end - 1]) or end


def _attributes(text: str) -> dict[str, str]:
    out: dict[str, str] = {}
    for name, value in _ATTRIBUTE.findall(text):
        value = value[1:-1] if value[:1] in ('"', "'") else value
        out.setdefault(name.lower(), _plain(value))
    return out


def parse_html(text: str) -> dict:
    """title, language, links [(element, attribute, value)], metas [(name, content)] and plain text of a page, in one pass, however badly formed."""
    out, links, metas, title, language, at = [], [], [], None, None, 0
    found, go_on = tags(text), None
    while True:
        try:
            start, end, name, closing, rest = found.send(go_on)
        except StopIteration:
            break
        out.append(_plain(text[at:start]).replace("\n", " "))
        at, go_on = end, None
        if name in LINES:
            out.append("\n")
        if closing or not name:
            continue
        if name in LINKS and (value := _attributes(rest).get(LINKS[name])) is not None:
            links.append((name, LINKS[name], value.strip()))
        elif name == "meta" and (own := _attributes(rest)) and "content" in own and ("name" in own or "property" in own):
            metas.append((own.get("name", own.get("property")), own["content"]))
        elif name == "html" and language is None:
            language = _attributes(rest).get("lang")
        if name in _ENDS and not rest.endswith("/"):
            over = _ENDS[name].search(text, at)
            stop = over.start() if over else len(text)
            if name == "title":
                title = title if title is not None else _BLANKS.sub(" ", _plain(text[at:stop]).replace("\n", " ")).strip()
                out += [_plain(text[at:stop]).replace("\n", " "), "\n"]
            elif name == "textarea":
                out.append(_plain(text[at:stop]))
            at = go_on = over.end() if over else len(text)
    out.append(_plain(text[at:]).replace("\n", " "))
    plain = _LINE_ENDS.sub("\n", _BLANKS.sub(" ", "".join(out))).strip()
    return {"title": title, "language": language, "links": links, "metas": metas, "text": plain}


def _count(digits: str) -> int | None:
    """A number written in ASCII digits, up to 18 of them; None for anything else."""
    return int(digits) if re.fullmatch("[0-9]{1,18}", digits) else None


def split_http(block: str) -> tuple[int | None, dict[str, str], str]:
    """Status (None unless in ASCII digits), headers (names lower-case; repeated ones joined) and body of an HTTP response; a block without a status line is all body."""
    if not block.startswith("HTTP/"):
        return None, {}, block
    head, _, body = block.partition("\r\n\r\n")
    first, *lines = head.split("\r\n")
    status = first.split(" ")[1] if first.count(" ") else ""
    headers: dict[str, str] = {}
    for x in lines:
        name, colon, value = x.partition(":")
        if colon:
            name = name.strip().lower()
            headers[name] = f"{headers[name]}, {value.strip()}" if name in headers else value.strip()
    return _count(status), headers, body


def derive(response: dict) -> list[dict]:
    """The metadata and the conversion record of one response record; both refer to it, keep its address and date, and carry own digests."""
    block = response["block"] or ""
    status, headers, body = split_http(block)
    page = parse_html(body)
    source = response["record_id"]
    uri, date = response["target_uri"], response["date"] or DATE
    payload = response["payload_digest"] or digest(body.encode("utf-8", "surrogatepass"))
    envelope = {
        "WARC-Record-ID": source, "WARC-Target-URI": uri, "WARC-Date": date, "WARC-Payload-Digest": payload,
        "WARC-Headers": dict(sorted((response["headers"] or {}).items())), "HTTP-Status": status, "HTTP-Headers": dict(sorted(headers.items())),
        "Title": page["title"], "Language": page["language"], "Metas": page["metas"], "Links": page["links"],
    }
    meta = json.dumps(envelope, ensure_ascii=False, separators=(",", ":"))
    own = {"target_uri": uri, "date": date, "refers_to": source, "payload_digest": payload}
    out = []
    for kind, content, text, other in (("metadata", "application/json", meta, "conversion"), ("conversion", "text/plain", page["text"], "metadata")):
        octets = text.encode("utf-8", "surrogatepass")
        linked = {"WARC-Concurrent-To": record_id(source or "", uri or "", other)}
        if kind == "conversion" and page["language"]:
            linked["WARC-Identified-Content-Language"] = page["language"]
        out.append({"record_id": record_id(source or "", uri or "", kind), "type": kind, "content_type": content, "headers": linked, "block_digest": digest(octets), "content_length": len(octets), "block": text, "n_links": len(page["links"]), **own})
    return out


def derivatives(responses: DataFrame, key: str | None = None) -> DataFrame:
    """Records (see RECORD, and ``n_links`` long) derived from the response records of ``responses`` (RECORD): two each, metadata and conversion.

    ``refers_to`` is the response's record id; address, date and payload digest are kept (the digest computed if absent); the
    metadata record holds the source's WARC and HTTP headers, title, metas and links; the two records name each other in
    WARC-Concurrent-To. Records of other types give nothing. A null block is empty: an empty conversion and a metadata record
    without links. Null ids and addresses stay null. Repeated rows give repeated records, with equal identifiers. ``key``:
    a column of ``responses`` to keep in front. Other columns are ignored. One pass in Arrow batches, nothing shuffled.
    """
    keep = [key] if key else []
    chosen = responses.where("type = 'response'").select(*keep, *FIELDS)
    names = [*keep, *FIELDS, "n_links"]
    schema = (f"{key} {dict(responses.dtypes)[key]}, " if key else "") + RECORD + ", n_links long"

    def over(batches):
        for batch in batches:
            kinds = [*(batch.schema.field(x).type for x in keep), *[pa.map_(pa.string(), pa.string()) if x == "headers" else pa.int64() if x == "content_length" else pa.string() for x in FIELDS], pa.int64()]
            for a in range(0, max(1, batch.num_rows), CHUNK):  # few pages at a time are Python objects
                rows = []
                for k in range(a, min(a + CHUNK, batch.num_rows)):
                    row = {name: batch.column(i)[k].as_py() for i, name in enumerate([*keep, *FIELDS])}
                    row["headers"] = dict(row["headers"] or [])
                    rows += [r | {x: row[x] for x in keep} for r in derive(row)]
                columns = [pa.array([list(r[n].items()) if n == "headers" else r[n] for r in rows], kind) for n, kind in zip(names, kinds, strict=True)]
                yield pa.RecordBatch.from_arrays(columns, names=names)

    return chosen.mapInArrow(tidied(over), schema)


def responses_of(pages: DataFrame) -> DataFrame:
    """Response records (page_id and RECORD) for rows of ``pages`` (page_id, url, html): an HTTP head with the body's type and length, a header with the page's id, SHA-256 digests by Spark.

    Null markup is an empty body, a null address or id stays null (the header is empty then). Repeated rows give equal records.
    """
    body = F.coalesce(F.col("html").cast("string"), F.lit(""))
    octets = F.octet_length(body).cast("string")
    head = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), octets, F.lit("\r\n\r\n"))
    page = F.coalesce(F.col("page_id").cast("string"), F.lit(""))
    name = F.md5(F.concat_ws("\0", page, F.coalesce("url", F.lit(""))))
    urn = F.concat(F.lit("<urn:uuid:"), F.regexp_replace(name, "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5"), F.lit(">"))
    block = F.concat(head, body)
    sha256 = lambda x: F.concat(F.lit("sha256:"), F.sha2(x, 256))
    return pages.select(
        "page_id", urn.alias("record_id"), F.lit("response").alias("type"), F.col("url").cast("string").alias("target_uri"), F.lit(DATE).alias("date"),
        F.lit(None).cast("string").alias("refers_to"), F.lit("application/http; msgtype=response").alias("content_type"), F.create_map(F.lit("WARC-X-Page-ID"), page).alias("headers"),
        sha256(block).alias("block_digest"), sha256(body).alias("payload_digest"), F.octet_length(block).cast("long").alias("content_length"), block.alias("block"),
    )


def serialised(records: DataFrame) -> DataFrame:
    """(record string): each record with its header lines, as it stands in a WARC file but for the two line ends after it."""
    line = lambda name, c: F.when(F.col(c).isNotNull(), F.concat(F.lit(f"{name}: "), F.col(c).cast("string"), F.lit("\r\n"))).otherwise("")
    more = F.array_join(F.transform(F.array_sort(F.map_entries(F.coalesce("headers", F.create_map().cast("map<string,string>")))), lambda e: F.concat(e["key"], F.lit(": "), e["value"], F.lit("\r\n"))), "")
    length = F.concat(F.lit("Content-Length: "), F.octet_length(F.coalesce("block", F.lit(""))).cast("string"), F.lit("\r\n\r\n"))
    parts = [F.lit(f"{VERSION}\r\n"), line("WARC-Type", "type"), line("WARC-Record-ID", "record_id"), line("WARC-Target-URI", "target_uri"), line("WARC-Date", "date"), line("WARC-Refers-To", "refers_to")]
    parts += [line("WARC-Block-Digest", "block_digest"), line("WARC-Payload-Digest", "payload_digest"), more, line("Content-Type", "content_type"), length, F.coalesce("block", F.lit(""))]
    return records.select(F.concat(*parts).alias("record"))


def write(records: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Writes records as gzipped WARC files by Spark's own text writer, so to any file system it knows; failed tasks leave nothing behind."""
    serialised(records).write.mode(mode).option("lineSep", "\r\n\r\n").option("compression", "gzip").text(path)


KNOWN = {"warc-record-id", "warc-type", "warc-target-uri", "warc-date", "warc-refers-to", "content-type", "warc-block-digest", "warc-payload-digest", "content-length"}
SEPARATOR = "\r\n\r\nWARC/"


def parse_head(head: bytes) -> dict[str, str]:
    """The header lines of a record, names lower-case; the first line is the version."""
    out: dict[str, str] = {}
    for x in head.decode("utf-8", "replace").split("\r\n")[1:]:
        name, _, value = x.partition(":")
        out[name.strip().lower()] = value.strip()
    return out


def parse(pieces):
    """Records of (file, piece) rows: what lies between separators, in order.

    A piece that is shorter than its record's Content-Length goes on with the next one of its file, as the separator was
    part of the block. What a file's broken end leaves, and pieces without a length, give nothing.
    """
    name, held, size, start, got, head = None, [], None, 0, 0, {}
    for file, piece in pieces:
        if size is not None and file == name:
            held += [SEPARATOR.encode(), piece]
            got += len(SEPARATOR) + len(piece)
        else:
            name, held, got = file, [piece], len(piece)
            end = piece.find(b"\r\n\r\n")
            end = end if end >= 0 else len(piece)  # the block itself begins like a record: the separator ended the head
            start, head = end + 4, parse_head(piece[:end])
            size = _count(head.get("content-length", ""))
        if size is None or got - start < size:
            continue
        block = b"".join(held)[start : start + size]
        size = None
        yield {
            "record_id": head.get("warc-record-id"), "type": head.get("warc-type"), "target_uri": head.get("warc-target-uri"), "date": head.get("warc-date"), "refers_to": head.get("warc-refers-to"),
            "content_type": head.get("content-type"), "headers": {k: v for k, v in head.items() if k not in KNOWN}, "block_digest": head.get("warc-block-digest"),
            "payload_digest": head.get("warc-payload-digest"), "content_length": len(block), "block": block.decode("utf-8", "replace"),
        }


def read(spark: SparkSession, path: str) -> DataFrame:
    """Records (RECORD) of the WARC files under ``path``, gzipped (whole or by record; names end in .gz) or plain.

    Spark's own text reader streams and inflates each file and cuts it at record separators, so a task holds a batch of
    records, never a file. A broken end gives what is whole before it; an empty folder an empty result. Not read: a record
    of a plain file whose block holds the separator itself just where Spark splits the file between two tasks.
    """

    def over(batches):
        kinds = [pa.map_(pa.string(), pa.string()) if n == "headers" else pa.int64() if n == "content_length" else pa.string() for n in FIELDS]
        records = parse((batch.column(1)[k].as_py(), batch.column(0)[k].as_py()) for batch in batches for k in range(batch.num_rows))
        while rows := list(islice(records, CHUNK)):
            yield pa.RecordBatch.from_arrays([pa.array([list(r[n].items()) if n == "headers" else r[n] for r in rows], k) for n, k in zip(FIELDS, kinds, strict=True)], names=FIELDS)

    lines = spark.read.option("lineSep", SEPARATOR).option("recursiveFileLookup", "true").text(path)
    whole = lines.select(F.col("value").cast("binary").alias("piece"), F.col("_metadata.file_path").alias("file"))
    return whole.mapInArrow(tidied(over), RECORD)
