"""Book formats: the catalogue's fields and the details of one file's bytes. Pure Python, called per Arrow batch by ``ingest``.

A parser gives (book, details); a broken file gives what can be had, at worst an empty book, which then gets its file's stem as title.
"""

from __future__ import annotations

import base64
import io
import re
import zipfile
import zlib

from folioscope.schema import EMPTY_BOOK, EMPTY_DETAILS, author, person, sequence
from folioscope.sources import charset, xmltree
from folioscope.sources.xmltree import Node, XmlError

ENDS = "".join(map(chr, range(33)))
COVER_PARAGRAPHS = 50


def _clean(text: str) -> str:
    return text.strip(ENDS)


def _texts(nodes: list[Node]) -> list[str]:
    """One value for each element with text."""
    return [_clean(held[0]) for x in nodes if (held := x.contents())]


def _new() -> tuple[dict, dict]:
    return {k: [] for k in EMPTY_BOOK}, dict(EMPTY_DETAILS)  # a parser puts lists in place of those of the details, and adds to none


# FB2 -------------------------------------------------------------------------------------------------------------------

_PARTS = {"last": "last-name", "first": "first-name", "middle": "middle-name", "nick": "nickname"}


def _fb2_parts(node: Node, names: dict[str, str]) -> dict[str, str]:
    return {k: v[0] for k, tag in names.items() if (own := node.search(tag)) and (v := _texts(own))}


def _fb2_people(nodes: list[Node]) -> list[dict]:
    every = [_fb2_parts(x, _PARTS | {"home_page": "home-page", "email": "email", "id": "id"}) for x in nodes]
    return [person(**x) for x in every if x]


def _fb2_series(nodes: list[Node]) -> list[dict]:
    """Series with a name; a number counts only beside one."""
    named = [(_clean(x.attributes.get("name", "")), _clean(x.attributes.get("number", "")) or None) for x in nodes]
    return [sequence(name=name, number=number) for name, number in named if name]


def fb2(content: bytes, details: bool = True) -> tuple[dict, dict]:
    """FictionBook. Where the document is malformed, its ``description`` alone is read; an error if that is malformed too."""
    book, more = _new()
    text = charset.decode(content)
    try:
        root = xmltree.parse(text)
    except XmlError:
        m = re.search(r"<description\b.*?</description\s*>", text, re.S)
        if not m:
            raise
        root = xmltree.parse(m[0])
    info = Node("info", children=root.search("title-info"))
    book["authors"] = [author(**p) for x in info.search("author") if (p := _fb2_parts(x, _PARTS))]
    book["titles"] = _texts(info.search("book-title"))
    book["sequences"] = _fb2_series(info.search("sequence"))
    book["genres"] = _texts(info.search("genre"))
    book["dates"] = _texts(info.search("date"))
    if not details:
        return book, more
    more["annotation"] = ["".join(map(xmltree.write, x.children)) for x in info.search("annotation")]
    more["keywords"], more["language"], more["source_language"] = _texts(info.search("keywords")), _texts(info.search("lang")), _texts(info.search("src-lang"))
    more["translator"] = _fb2_people(info.search("translator"))
    source = Node("info", children=root.search("src-title-info"))
    more["source_book_title"], more["source_book_author"] = _texts(source.search("book-title")), _fb2_people(source.search("author"))
    more["source_book_translator"], more["source_book_sequence"] = _fb2_people(source.search("translator")), _fb2_series(source.search("sequence"))
    more["source_book_genre"], more["source_book_date"] = _texts(source.search("genre")), _texts(source.search("date"))
    more["source_book_language"], more["source_book_source_language"] = _texts(source.search("lang")), _texts(source.search("src-lang"))
    more["source_book_keywords"] = _texts(source.search("keywords"))
    made = Node("info", children=root.search("document-info"))
    more["ebook_author"], more["ebook_publisher"] = _fb2_people(made.search("author")), _fb2_people(made.search("publisher"))
    for key, tag in {"ebook_program_used": "program-used", "ebook_date": "date", "ebook_source_url": "src-url", "ebook_source_ocr": "src-ocr", "ebook_id": "id", "ebook_version": "version"}.items():
        nodes = [x for top in made.children for x in top.children if x.name == tag]
        more[key] = _texts(nodes)
    more["ebook_history"] = ["".join(map(xmltree.write, x.children)) for x in made.search("history")]
    paper = Node("info", children=root.search("publish-info"))
    for key, tag in {"paper_book_name": "book-name", "paper_book_publisher": "publisher", "paper_book_city": "city", "paper_book_year": "year", "paper_book_isbn": "isbn"}.items():
        more[key] = _texts(paper.search(tag))
    more["paper_book_sequence"] = _fb2_series(paper.search("sequence"))
    more["custom_info"] = [": ".join(filter(None, (x.attributes.get("info-type"), _clean(x.content())))) for x in root.search("custom-info")]
    more["cover"] = _fb2_cover(root, info)
    return book, more


def _fb2_cover(root: Node, info: Node) -> dict | None:
    for page in info.search("coverpage"):
        for image in page.search("image"):
            target = next((v.lstrip("#") for k, v in image.attributes.items() if k.endswith("href")), None)
            for binary in root.search("binary", "id", target) if target else []:
                try:
                    return {"kind": "base64", "data": base64.b64decode(binary.content()), "h": None, "w": None}
                except ValueError:
                    continue
    paragraphs = [_clean(p.content()) for body in root.search("body") for p in body.search("p")][:COVER_PARAGRAPHS]
    return {"kind": "text", "data": "\n".join(paragraphs).encode("utf-8"), "h": None, "w": None} if paragraphs else None


# Dublin Core, EPUB, ODT ------------------------------------------------------------------------------------------------


def _dc(root: Node, name: str) -> list[str]:
    return [_clean(t) for x in root.search(f"dc:{name}") for t in x.contents()]


def _dc_role(root: Node, role: str) -> list[str]:
    """Creators or contributors of a role: named by a refining meta element, or by an attribute on the element itself."""
    refined = []
    for x in root.search("meta", "property", "role"):
        if role in x.contents() and "refines" in x.attributes:
            target = x.attributes["refines"].lstrip("#")
            refined += [_clean(t) for kind in ("dc:creator", "dc:contributor") for y in root.search(kind, "id", target) for t in y.contents()]
    own = [_clean(t) for kind in ("dc:creator", "dc:contributor") for x in root.search(kind) if any(":role" in k and v == role for k, v in x.attributes.items()) for t in x.contents()]
    return refined + own


def dublin_core(root: Node) -> tuple[dict, dict]:
    book, more = _new()
    book["titles"], book["genres"], book["dates"] = _dc(root, "title"), _dc(root, "subject"), _dc(root, "date")
    book["authors"] = [author(full=x) for x in (_dc_role(root, "aut") or _dc(root, "creator")) if x]
    more["annotation"] = _dc(root, "description")[:1]
    more["language"], more["paper_book_publisher"], more["ebook_id"], more["source_book_dublin_core"] = _dc(root, "language"), _dc(root, "publisher"), _dc(root, "identifier"), _dc(root, "source")
    more["translator"] = [person(full=x) for x in _dc_role(root, "trl") if x]
    return book, more


def _member(z: zipfile.ZipFile, content: bytes, name: str) -> bytes | None:
    from folioscope.sources.archives import member

    try:
        return member(z, content, z.getinfo(name))
    except KeyError:
        return None


def _beside(base: str, href: str) -> str:
    import posixpath
    from urllib.parse import unquote

    return posixpath.normpath(posixpath.join(posixpath.dirname(base), unquote(href.split("#")[0])))


def epub(content: bytes) -> tuple[dict, dict]:
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        box = _member(z, content, "META-INF/container.xml")
        files = xmltree.parse(charset.decode(box), strict=False).search("rootfile", "full-path") if box else []
        if not files:
            raise XmlError("no root file")
        path = files[0].attributes["full-path"]
        root = xmltree.parse(charset.decode(_member(z, content, path) or b""), strict=False)
        book, more = dublin_core(root)
        more["cover"] = _epub_cover(z, content, path, root)
        return book, more


def _epub_cover(z: zipfile.ZipFile, content: bytes, path: str, root: Node) -> dict | None:
    """The manifest's image whose id speaks of a cover, else the first picture of the page whose id does."""
    items = [x for x in root.search("item", "href") if "cover" in x.attributes.get("id", "").lower()]
    for x in items:
        if "image" in x.attributes.get("media-type", "") and (data := _member(z, content, _beside(path, x.attributes["href"]))):
            return {"kind": "image", "data": data, "h": None, "w": None}
    for x in items:
        if "html" in x.attributes.get("media-type", ""):
            at = _beside(path, x.attributes["href"])
            page = xmltree.parse(charset.decode(_member(z, content, at) or b""), strict=False)
            for image in page.search(where=lambda n: n.name in ("img", "image")):
                target = image.attributes.get("src") or next((v for k, v in image.attributes.items() if k.endswith("href")), None)
                if target and (data := _member(z, content, _beside(at, target))):
                    return {"kind": "image", "data": data, "h": None, "w": None}
    return None


def odt(content: bytes) -> tuple[dict, dict]:
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        root = xmltree.parse(charset.decode(_member(z, content, "meta.xml") or b""), strict=False)
        book, more = dublin_core(root)
        more["ebook_program_used"] = _texts(root.search("meta:generator"))
        more["keywords"] = _texts(root.search("meta:keyword"))
        if data := _member(z, content, "Thumbnails/thumbnail.png"):
            more["cover"] = {"kind": "image", "data": data, "h": None, "w": None}
        return book, more


# PDF, DJVU, text -------------------------------------------------------------------------------------------------------

_PDF_STRING = re.compile(rb"/(Title|Author|Keywords|CreationDate|Producer|Creator|Subject)\s*(\((?:\\.|[^\\()]|\((?:\\.|[^\\()])*\))*\)|<[0-9A-Fa-f\s]*>)", re.S)
_OCTAL = re.compile(rb"\\([0-7]{1,3}|\r\n|.)", re.S)
# What stands after a backslash in a PDF string.
_PDF_ESCAPES = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\f", b"\n": b"", b"\r": b"", b"\r\n": b""}


def _pdf_string(raw: bytes) -> str:
    if raw[:1] == b"<":
        digits = re.sub(rb"\s", b"", raw[1:-1])
        data = bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode("ascii"))
    else:
        data = _OCTAL.sub(lambda m: bytes([int(m[1], 8) & 255]) if m[1][:1] in b"01234567" else _PDF_ESCAPES.get(m[1], m[1]), raw[1:-1])
    for mark, name in ((b"\xfe\xff", "utf-16-be"), (b"\xff\xfe", "utf-16-le"), (b"\xef\xbb\xbf", "utf-8")):
        if data.startswith(mark):
            return _clean(data[len(mark) :].decode(name, "replace"))
    return _clean(charset.decode(data))


def pdf(content: bytes) -> tuple[dict, dict]:
    """The information dictionary: author, title, creation date; keywords, program. Object streams are inflated. No page is drawn, so there is no cover."""
    if b"%PDF" not in content[:1024]:
        raise ValueError("not a PDF file")
    book, more = _new()
    parts = [content]
    for m in re.finditer(rb"/ObjStm.{0,400}?stream\r?\n", content, re.S):
        try:
            parts.append(zlib.decompressobj().decompress(content[m.end() :]))
        except zlib.error:
            continue
    found: dict[str, str] = {}
    for part in parts:
        for name, raw in _PDF_STRING.findall(part):
            if value := _pdf_string(raw):
                found[name.decode("ascii")] = value
    if "Title" in found:
        book["titles"] = [found["Title"]]
    if "Author" in found:
        book["authors"] = [author(full=found["Author"])]
    if m := re.match(r"D:(\d{4})(\d\d)?(\d\d)?", found.get("CreationDate", "")):
        book["dates"] = [f"{m[3] or '01'}.{m[2] or '01'}.{m[1]}"]
    more["keywords"] = [found["Keywords"]] if "Keywords" in found else []
    more["ebook_program_used"] = [found[x] for x in ("Creator", "Producer") if x in found][:1]
    if m := re.search(rb"/ID\s*\[\s*<([0-9A-Fa-f]+)>", content):
        more["ebook_id"] = [m[1].decode("ascii")]
    return book, more


def quoted_after(text: str, tag: str) -> str:
    m = re.search(re.escape(tag) + r'[^"]*"([^"]*)"', text)
    return m[1] if m else ""


def djvu(content: bytes) -> tuple[dict, dict]:
    """Annotation tags of uncompressed chunks, in small letters or with a capital. No page is drawn, so there is no cover."""
    if content[:8] != b"AT&TFORM":
        raise ValueError("not a DJVU file")
    book, more = _new()
    text, at = "", 12
    while (at := content.find(b"ANTa", at)) >= 0:
        size = int.from_bytes(content[at + 4 : at + 8], "big")
        text += charset.decode(content[at + 8 : at + 8 + size])
        at += 8 + size
    tag = lambda x: _clean(quoted_after(text, x) or quoted_after(text, x.capitalize()))
    if x := tag("author"):
        book["authors"] = [author(full=x)]
    if x := tag("title"):
        book["titles"] = [x]
    if x := tag("series"):
        book["sequences"] = [sequence(full=x)]
    if x := tag("year"):
        book["dates"] = [x]
    for key, name in {"annotation": "annote", "keywords": "keywords", "djvu_publisher": "publisher", "ebook_program_used": "software"}.items():
        more[key] = [x] if (x := tag(name)) else []
    return book, more


def txt(content: bytes) -> tuple[dict, dict]:
    book, more = _new()
    more["cover"] = {"kind": "txt", "data": charset.decode(content).encode("utf-8"), "h": None, "w": None}
    return book, more


def md(content: bytes) -> tuple[dict, dict]:
    book, more = txt(content)
    more["cover"]["kind"] = "md"
    return book, more


PARSERS = {".fb2": fb2, ".epub": epub, ".odt": odt, ".pdf": pdf, ".djvu": djvu, ".txt": txt, ".md": md}
#: Formats whose empty files hold no book.
NEVER_EMPTY = {".fb2", ".epub", ".odt", ".pdf", ".djvu"}


def unread(stem: str, date: str) -> tuple[dict, dict]:
    """(book, details) of a file that isn't opened."""
    book, more = _new()
    return book | {"titles": [stem], "dates": [date]}, more


def parse(extension: str, content: bytes, stem: str, date: str, details: bool = True) -> tuple[dict, dict] | None:
    """(book, details) of one file; None for an unknown format and for an empty file of a format that can't be. A file that can't be parsed is a book by its stem and date."""
    parser = PARSERS.get(extension)
    if parser is None or (not content and extension in NEVER_EMPTY):
        return None
    try:
        book, more = fb2(content, details) if parser is fb2 else parser(content)
    except Exception:  # any way in which a stranger's file can be broken
        book, more = _new()
    book["titles"] = [x for x in book["titles"] if x] or [stem]
    book["dates"] = [x for x in book["dates"] if x] or [date]
    return book, more
