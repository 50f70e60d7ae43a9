"""Books made here, in every format, through the whole way from files to tables."""

import base64
import gzip
import io
import struct
import tarfile
import zipfile
import zlib

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from folioscope.schema import BOOKS, DETAILS, EMPTY_DETAILS, GENRES
from folioscope.sources import archives, charset, formats, genres, ingest, inpx, legacy, xmltree
from folioscope.sources.archive_write import pack

FB2 = """<?xml version="1.0" encoding="{enc}"?><FictionBook xmlns:l="x"><description><title-info><genre>sf</genre>
<author><first-name>Ann</first-name><last-name> Pen </last-name></author><author/><book-title>{title}</book-title>
<sequence name="Row" number="2"/><sequence number="3"/><date>1999</date><annotation><p>Short &amp; good</p></annotation>
<coverpage><image l:href="#c.png"/></coverpage><lang>en</lang></title-info><document-info><program-used>pen</program-used></document-info>
<publish-info><isbn>12</isbn></publish-info></description><body><p>One</p></body><binary id="c.png">{cover}</binary></FictionBook>"""


def fb2(title="A Tale", enc="utf-8"):
    return FB2.format(title=title, enc=enc, cover=base64.b64encode(b"PNG").decode()).encode(enc)


def zipped(entries):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, data in entries.items():
            z.writestr(zipfile.ZipInfo(name, (2001, 2, 3, 0, 0, 0)), data)
    return out.getvalue()


OPF = """<package><metadata><dc:title id="t">E Book</dc:title><dc:creator id="a1">Ann Pen</dc:creator><dc:creator id="a2">Tom Tr</dc:creator>{more}
<dc:subject>novel</dc:subject><dc:date>2000</dc:date></metadata><manifest><item id="cover-img" media-type="image/png" href="img/c.png"/></manifest></package>"""
ROLES = '<meta property="role" refines="#a1">aut</meta><meta property="role" refines="#a2">trl</meta>'
BOX = '<container><rootfiles><rootfile full-path="OEBPS/x.opf"/></rootfiles></container>'


def epub(more=ROLES):
    return zipped({"META-INF/container.xml": BOX, "OEBPS/x.opf": OPF.format(more=more), "OEBPS/img/c.png": b"PNG"})


def test_fb2():
    book, more = formats.fb2(fb2())
    assert book["authors"] == [{"full": None, "last": "Pen", "first": "Ann", "middle": None, "nick": None}]
    assert book["titles"] == ["A Tale"] and book["sequences"] == [{"full": None, "name": "Row", "number": "2"}] and book["genres"] == ["sf"] and book["dates"] == ["1999"]
    assert more["cover"]["data"] == b"PNG" and more["annotation"] == ["<p>Short &amp; good</p>"] and more["ebook_program_used"] == ["pen"] and more["paper_book_isbn"] == ["12"] and more["language"] == ["en"]
    assert formats.fb2(fb2("Сказка", "cp1251"))[0]["titles"] == ["Сказка"]
    broken = fb2().replace(b"</body>", b"</bad>")
    assert formats.fb2(broken)[0]["titles"] == ["A Tale"]
    worse = broken.replace(b"</author>", b"", 1)
    assert formats.parse(".fb2", worse, "stem", "01.01.2000")[0]["titles"] == ["stem"]
    assert formats.parse(".fb2", b"", "stem", "d") is None and formats.parse(".txt", b"", "stem", "d")[0]["titles"] == ["stem"]


def test_dublin_core():
    book, more = formats.epub(epub())
    assert [a["full"] for a in book["authors"]] == ["Ann Pen"] and [t["full"] for t in more["translator"]] == ["Tom Tr"] and more["cover"]["data"] == b"PNG"
    assert [a["full"] for a in formats.epub(epub(""))[0]["authors"]] == ["Ann Pen", "Tom Tr"]
    own = epub("").replace(b"", b"")
    assert formats.parse(".epub", own, "s", "d")[0]["genres"] == ["novel"]
    attribute = OPF.format(more="").replace('id="a2"', 'opf:role="aut"')
    assert [a["full"] for a in formats.dublin_core(xmltree.parse(attribute))[0]["authors"]] == ["Tom Tr"]
    assert formats.parse(".epub", zipped({"x": b"y"}), "stem", "d")[0]["titles"] == ["stem"]
    odt = zipped({"meta.xml": "<o><dc:title>Odd</dc:title><dc:creator>Bo</dc:creator><meta:generator>Pen 1</meta:generator></o>", "Thumbnails/thumbnail.png": b"T"})
    book, more = formats.odt(odt)
    assert book["titles"] == ["Odd"] and more["ebook_program_used"] == ["Pen 1"] and more["cover"]["data"] == b"T"


def test_pdf_and_djvu():
    info = b"<</Title (A \\(small\\) book\\051)/Author <FEFF0041> /CreationDate (D:20010203000000)/Keywords (k)>>"
    book, more = formats.pdf(b"%PDF-1.4\n1 0 obj" + info + b"endobj")
    assert book["titles"] == ["A (small) book)"] and book["authors"][0]["full"] == "A" and book["dates"] == ["03.02.2001"] and more["keywords"] == ["k"]
    packed = b"%PDF-1.5\n2 0 obj<</Type/ObjStm/N 1/First 4>>stream\n" + zlib.compress(b"1 0 " + info) + b"\nendstream"
    assert formats.pdf(packed)[0]["titles"] == ["A (small) book)"]
    notes = b'(metadata (Title "D Book") (author "Ann") (year "1980") (publisher "P"))'
    file = b"AT&TFORM" + struct.pack(">I", len(notes) + 12) + b"DJVUANTa" + struct.pack(">I", len(notes)) + notes
    book, more = formats.djvu(file)
    assert book["titles"] == ["D Book"] and book["authors"][0]["full"] == "Ann" and book["dates"] == ["1980"] and more["djvu_publisher"] == ["P"]


def cpio(entries):
    out = b""
    for name, data in [*entries.items(), ("TRAILER!!!", b"")]:
        head = b"070701" + b"".join(b"%08X" % v for v in (1, 0o100644, 0, 0, 1, 981158400, len(data), 0, 0, 0, 0, len(name) + 1, 0))
        out += head + name.encode() + b"\0"
        out += b"\0" * (-len(out) % 4) + data
        out += b"\0" * (-len(out) % 4)
    return out


def iso(name, data):
    def record(ident, place, size, flags):
        n = 33 + len(ident) + (len(ident) + 1) % 2
        r = bytes([n, 0]) + struct.pack("<I", place) + struct.pack(">I", place) + struct.pack("<I", size) + struct.pack(">I", size) + bytes([101, 2, 3, 0, 0, 0, 0, flags, 0, 0, 1, 0, 0, 1, len(ident)]) + ident
        return r.ljust(n, b"\0")

    root = record(b"\0", 18, 2048, 2)
    volume = (b"\1CD001\1".ljust(156, b"\0") + root).ljust(2048, b"\0")
    return b"\0" * 16 * 2048 + volume + b"\xffCD001\1".ljust(2048, b"\0") + (root + record(b"\1", 18, 2048, 2) + record(name, 19, len(data), 0)).ljust(2048, b"\0") + data.ljust(2048, b"\0")


def test_archives():
    inner = zipped({"deep.fb2": fb2("Deep"), "empty.txt": b""})
    outer = zipped({"a.txt": b"text", "in.zip": inner, "x.fbd": fb2("Described"), "x.pdf": b"%PDF-1", "y.fbd": fb2("Adopted"), "y.bin": b"?", "lone.fbd": fb2("Lone"), "z.bin": b"?"})
    got = {tuple(hops): (book["titles"], side) for hops, side, book, _ in archives.books(".zip", outer)}
    assert got == {("a.txt",): (["a"], None), ("in.zip", "deep.fb2"): (["Deep"], None), ("x.pdf",): (["Described"], "x.fbd"), ("y.bin",): (["Adopted"], "y.fbd")}
    assert next(archives.books(".zip", outer))[2]["dates"] == ["03.02.2001"]
    packed = io.BytesIO()
    with tarfile.open(fileobj=packed, mode="w:gz") as t:
        info = tarfile.TarInfo("b.md")
        info.size, info.mtime = 4, 981158400
        t.addfile(info, io.BytesIO(b"text"))
    assert [(h, b["dates"]) for h, _, b, _ in archives.books(".tar.gz", packed.getvalue())] == [(["b.md"], ["03.02.2001"])]
    assert [x.path for x in archives.entries(".cpio", cpio({"c.txt": b"abc", "dd.txt": b"x"}))] == ["c.txt", "dd.txt"]
    made = list(archives.entries(".iso", iso(b"D.TXT;1", b"hello")))
    assert [(x.path, x.content, x.date) for x in made] == [("D.TXT", b"hello", "03.02.2001")]
    assert list(archives.entries(".zip", b"no zip")) == list(archives.entries(".7z", b"x")) == []
    assert ingest.book_bytes(outer, "/q.zip", ["in.zip", "deep.fb2"]) == fb2("Deep")
    with pytest.raises(FileNotFoundError):
        ingest.book_bytes(outer, "/q.zip", ["none"])


def test_charsets():
    assert [charset.detect(x) for x in ("é".encode(), "﻿a".encode("utf-16-le"), "Привет".encode("cp1251"), "café".encode("latin-1"), b"")] == ["utf-8", "utf-16-le", "cp1251", "latin-1", "utf-8"]
    assert charset.decode(b"\xef\xbb\xbfa") == "a" and charset.decode(b"<?xml encoding='nonsense'?>a").endswith("a")


RUSSIAN = "Все счастливые семьи похожи друг на друга, каждая несчастливая семья несчастлива по-своему. Всё смешалось в доме Облонских."
WIDE = {
    "shift_jis": "吾輩は猫である。名前はまだ無い。どこで生れたかとんと見当がつかぬ。", "euc_jp": "吾輩は猫である。名前はまだ無い。どこで生れたかとんと見当がつかぬ。",
    "gb18030": "学而时习之，不亦说乎？有朋自远方来，不亦乐乎？我们今天在这里学习中国的历史和文化。", "big5": "學而時習之，不亦說乎？有朋自遠方來，不亦樂乎？我們今天在這裡學習中國的歷史和文化。",
    "euc_kr": "나는 오늘 학교에 갔다. 친구들과 함께 점심을 먹고 도서관에서 책을 읽었다.",
}


def test_charsets_of_one_and_two_bytes():
    for name in charset.CYRILLIC:
        for text in (RUSSIAN, RUSSIAN[:30], RUSSIAN.upper() + " " + RUSSIAN):
            assert charset.detect(text.encode(name, "ignore")) == name, (name, text)
            assert charset.decode(text.encode(name, "ignore")) == text.encode(name, "ignore").decode(name)
    for name, text in WIDE.items():
        assert charset.detect(text.encode(name)) == name, name
        assert charset.decode(text.encode(name)) == text
    western = "Là où j'étais, le café coûtait très cher ; naïve façade, Straße über Öl."
    assert charset.detect(western.encode("latin-1")) == "latin-1" and charset.detect((western + " “quoted” – 5 €").encode("cp1252")) == "cp1252"
    assert charset.detect(b"\x81\x8d\xff") == "latin-1"


def test_xml():
    text = "<a x='1&amp;2'><b>t&lt;</b><c/><![CDATA[<raw>]]></a>"
    root = xmltree.parse(text)
    assert root.search("b")[0].contents() == ["t<"] and root.search(attribute="x", value="1&2")[0].name == "a"
    assert xmltree.write(root) == '<a x="1&amp;2"><b>t&lt;</b><c/>&lt;raw&gt;</a>'
    for broken in ("<a><b></a>", "<a>", "plain"):
        with pytest.raises(xmltree.XmlError):
            xmltree.parse(broken)
        xmltree.parse(broken, strict=False)


def test_collection(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    for name, data in {"a.fb2": fb2(), "sub/copy.fb2": fb2(), "b.txt": b"text", "sub/e.EPUB": epub(), "no.exe": b"x", "c.zip": zipped({"d.fb2": fb2("In Zip")}), "bad.zip": b"zip"}.items():
        (tmp_path / name).write_bytes(data)
    files, books = ingest.create(spark, str(tmp_path), str(tmp_path / "missing"))
    titles = sorted(r["titles"][0] for r in books.collect())
    assert titles == ["A Tale", "E Book", "In Zip", "b"]
    assert files.count() == 4 and {r["root_kind"] for r in files.collect()} == {"dir"}
    more = ingest.details_of(spark, str(tmp_path / "c.zip"), ["d.fb2"]).collect()
    assert len(more) == 1 and bytes(more[0]["cover"]["data"]) == b"PNG" and more[0]["language"] == ["en"]
    assert ingest.crawl(spark, str(tmp_path / "missing")).count() == 0


def test_inpx(spark, tmp_path):
    f = inpx.FIELD
    line = lambda *x: f.join([*x, ""])
    lines = [
        line("Pen,Ann,:Quill,Bo,C,:", "sf:prose:", "One", "Row", "2", "1", "", "", "", "fb2", "2001-01-01"),
        line("Pen,Ann:", "", "Two", "", "7", "2", "", "", "", "fb2", ""),
        line("", "", "", "", "", "3", "", "", "", "fb2"),
        line("A,,:", "sf", "Cut", "", "", "4"),
    ]
    text = "\r\n".join(lines) + "\r\nlost without end"
    (tmp_path / "books").mkdir()
    (tmp_path / "books" / "list.zip").write_bytes(zipped({"1.fb2": fb2()}))
    (tmp_path / "x.inpx").write_bytes(zipped({"list.inp": text, "other.inp": text, "version.info": "1"}))
    files = ingest.files_of(ingest.crawl(spark, str(tmp_path / "books")), hashes=False)
    rows = sorted(inpx.load(spark, str(tmp_path / "x.inpx"), files, str(tmp_path / "books")).collect(), key=lambda r: r["titles"][0])
    assert [r["titles"][0] for r in rows] == ["Cut", "One", "Two"]
    assert [(a["last"], a["first"], a["middle"]) for a in rows[1]["authors"]] == [("Pen", "Ann", None), ("Quill", "Bo", "C")]
    assert rows[1]["genres"] == ["sf", "prose"] and rows[0]["genres"] == [] and rows[1]["path_in_file"] == ["1.fb2"] and rows[0]["path_in_file"] is None
    assert rows[2]["authors"][0]["first"] is None and rows[2]["sequences"] == [] and rows[1]["sequences"][0]["number"] == "2"


def framed(width, *fields):
    kind = {2: "<H", 4: "<I", 8: "<Q"}[width]
    return b"".join(struct.pack(kind, len(x)) + x for x in fields)


def test_legacy(spark, tmp_path):
    book = framed(2, b"in.zip\nx.fb2", b"A, B,lost", b"One, Two, Three", b"", b"sf", b"1999")
    plain = framed(2, b"", b"Solo", b"Title", b"Row", b"", b"")
    entry = framed(2, b"d/a.zip", b"hash") + framed(8, book, plain)
    data = framed(2, b"/lib/") + framed(8, entry)
    (tmp_path / "old").write_bytes(data)
    rows = legacy.read(spark, "books", str(tmp_path / "old")).collect()
    assert rows[0]["file_path"] == "/lib/d/a.zip" and rows[0]["path_in_file"] == ["in.zip", "x.fb2"]
    assert [a["full"] for a in rows[0]["authors"]] == ["A", "B"] and rows[0]["titles"] == ["One, Two, Three", "Two, Three"]
    assert [a["full"] for a in rows[1]["authors"]] == ["Solo"] and rows[1]["sequences"][0]["full"] == "Row"
    scanned = legacy.books_of(spark.read.format("binaryFile").load(str(tmp_path / "old")))
    assert scanned.count() == 2
    with pytest.raises(legacy.Broken):
        list(legacy.collection(data[:-3])[1])
    (tmp_path / "marks").write_bytes(framed(8, framed(2, b"/a", b"", b"A, B", b"T", b"S", b"g", b"d")))
    marks = legacy.read(spark, "bookmarks", str(tmp_path / "marks")).collect()
    assert [a["full"] for a in marks[0]["authors"]] == ["A", "B"] and marks[0]["path_in_file"] is None
    (tmp_path / "notes").write_bytes(framed(4, b"x", b"/a", b"in", b"n.txt"))
    listed = legacy.read(spark, "notes", str(tmp_path / "notes"))
    assert listed.collect()[0]["note_file"] == "n.txt"
    texts = spark.createDataFrame([("/notes/n.txt", "Gut é".encode())], "file_path string, content binary")
    assert legacy.with_texts(listed, texts).collect()[0]["note_text"] == "Gut é"
    (tmp_path / "cut").write_bytes(data[:-3])
    with pytest.raises(Exception, match="more than there are"):
        legacy.read(spark, "books", str(tmp_path / "cut")).collect()
    assert legacy.read(spark, "books", str(tmp_path / "cut"), strict=False).count() == 0


def test_genre_files(spark, tmp_path):
    (tmp_path / "g.csv").write_text("fiction en_EN;Belletristik de_DE\nfiction;Belletristik\n")
    (tmp_path / "c.csv").write_text("Code;Group;en_EN;de_DE\nsf;fiction;Science;Zukunft\nold;gone;Old;Alt\n")
    groups = genres.load_groups(spark, str(tmp_path / "g.csv"), "de_DE")
    rows = genres.load_genres(spark, str(tmp_path / "c.csv"), "de_DE", groups).collect()
    assert [(r["code"], r["translation"]) for r in rows] == [("sf", "Zukunft")] and groups.first()["translation"] == "Belletristik"
    assert genres.load_genres(spark, str(tmp_path / "c.csv"), "xx").where("code = 'sf'").first()["translation"] == "sf"
    assert [x.split()[0] for x in GENRES.split(", ")] == ["code", "group", "lang", "translation"]


def test_stream(spark, tmp_path):
    from folioscope.streaming.refresh import follow

    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.fb2").write_bytes(fb2())
    args = (spark, str(tmp_path / "in"), str(tmp_path / "table"), str(tmp_path / "check"))
    follow(*args).awaitTermination()
    (tmp_path / "in" / "b.txt").write_bytes(b"later")
    follow(*args).awaitTermination()
    assert sorted(r["titles"][0] for r in spark.read.parquet(str(tmp_path / "table")).where(F.col("file_path").isNotNull()).collect()) == ["A Tale", "b"]


def test_archive_helpers(spark, tmp_path):
    from folioscope.sources.archive_write import listing, pack, without

    inner = pack(".tar.gz", {"d.txt": b"1", "e.txt": b"2"})
    outer = pack(".zip", {"a.fb2": fb2(), "a.fbd": b"x", "in.tar.gz": inner})
    assert pack(".zip", {"a": b"1"}) == pack(".zip", {"a": b"1"})
    assert [x.path for x in archives.entries(".zip", without(".zip", outer, ["a.fb2"]))] == ["in.tar.gz"]
    less = without(".zip", outer, ["in.tar.gz", "d.txt"])
    assert ingest.book_bytes(less, "x.zip", ["in.tar.gz", "e.txt"]) == b"2"
    assert without(".tar.gz", pack(".tar.gz", {"d": b"1"}), ["d"]) is None
    with pytest.raises(FileNotFoundError):
        without(".zip", outer, ["none"])
    (tmp_path / "x.zip").write_bytes(outer)
    assert sorted(r["entry"] for r in listing(ingest.crawl(spark, str(tmp_path))).collect()) == ["a.fb2", "a.fbd", "in.tar.gz"]


def test_control(spark, tmp_path):
    from folioscope.operators import control
    from folioscope.sources import store

    assert control.run_stoppable(spark, "t", lambda: spark.range(3).collect()) != []
    with pytest.raises(Exception, match="DIVIDE_BY_ZERO"):
        control.run_stoppable(spark, "t", lambda: spark.range(3).select(F.lit(1) / (F.col("id") - 1)).collect())

    def stopped():
        import threading
        import time

        timer = threading.Timer(3, control.stop, (spark, "slow"))
        timer.start()
        began = time.time()
        endless = spark.range(0, 1 << 36, 1, 4).select(F.max(F.xxhash64("id")))
        out = control.run_stoppable(spark, "slow", lambda: endless.collect())
        timer.join()
        return out, time.time() - began

    assert control.progress(spark) == {}
    assert stopped()[0] == [] and control.run_stoppable(spark, "slow", lambda: spark.range(2).collect()) != []

    @control.plugin("evens")
    def evens(df):
        return control.matching(df, F.col("id") % 2 == 0)

    assert control.apply("evens", spark.range(5)).count() == 3 and control.without(spark.range(5), F.col("id") > 2).count() == 3
    with pytest.raises(ValueError, match="already"):
        control.plugin("evens")(evens)
    store.create_views(spark, str(tmp_path / "none"), "v_")
    assert spark.sql("SELECT count(*) AS n FROM v_books").first()["n"] == 0


def test_a_file_over_the_limit_keeps_its_row(spark, tmp_path, monkeypatch):
    (tmp_path / "a.txt").write_text("some words of a book")
    (tmp_path / "small.txt").write_text("few")
    with open(tmp_path / "large.zip", "wb") as f:
        f.truncate(ingest.MAX_FILE_BYTES + (100 << 20))  # a hole: it takes no room
    files, books = ingest.create(spark, str(tmp_path))
    rows = {r["titles"][0]: r for r in books.collect()}
    assert set(rows) == {"a", "large", "small"} and rows["large"]["path_in_file"] is None and len(rows["large"]["dates"]) == 1
    hashes = {r["file_path"].rsplit("/", 1)[1]: r["file_hash"] for r in files.collect()}
    assert hashes["large.zip"] is None and hashes["a.txt"] is not None


def test_rehash_reads_only_what_changed(spark, tmp_path, monkeypatch):
    import datetime
    import os

    for name in ("a.txt", "b [1].txt", "c.txt"):
        (tmp_path / name).write_text(f"text of {name}")
        os.utime(tmp_path / name, (1_000_000_000, 1_000_000_000))
    known = ingest.files_of(ingest.crawl(spark, str(tmp_path))).withColumn("file_hash", F.lit(b"kept"))
    known = spark.createDataFrame(known.where("file_path not like '%c.txt'").collect(), known.schema)
    (tmp_path / "b [1].txt").write_text("text of b {1}.txt")  # as long, but later
    since = datetime.datetime(2002, 1, 1)
    for most in (10, 0):
        monkeypatch.setattr(ingest, "NAMED_FILES", most)
        got = {r["file_path"].rsplit("/", 1)[1]: r for r in ingest.rehash(known, since, str(tmp_path)).collect()}
        true = {r["file_path"].rsplit("/", 1)[1]: r for r in ingest.files_of(ingest.crawl(spark, str(tmp_path))).collect()}
        assert bytes(got["a.txt"]["file_hash"]) == b"kept" and set(got) == set(true)
        assert all(got[x] == true[x] for x in ("b [1].txt", "c.txt"))


def test_refresh_of_collections(spark, tmp_path):
    from folioscope.operators import maintain
    from folioscope.schema import COLLECTION
    from folioscope.sources import store

    root, lib = str(tmp_path / "store"), tmp_path / "lib"
    lib.mkdir()
    (lib / "a.fb2").write_bytes(fb2("First"))
    (lib / "b.txt").write_text("b")
    files, books = ingest.create(spark, str(lib))
    store.save(spark, root, info=spark.createDataFrame([("native", str(lib), None)], COLLECTION), files=files, books=books)
    store.save(spark, root, books=maintain.edit_book(store.books(spark, root), str(lib / "a.fb2"), None, {"titles": F.array(F.lit("Edited"))}))
    titles = lambda: sorted(r["titles"][0] for r in store.books(spark, root).collect())
    for fast in (False, True):
        (lib / f"new{fast}.txt").write_text(f"new {fast}")
        store.refresh(spark, root, fast=fast)
        assert "Edited" in titles() and f"new{fast}" in titles()
    (lib / "b.txt").unlink()
    (lib / "a.fb2").write_bytes(fb2("Another title"))
    (lib / "copy.fb2").write_bytes(fb2("Another title"))
    store.refresh(spark, root)
    assert titles() == ["Another title", "newFalse", "newTrue"]
    assert store.load(spark, root, "files").where("file_hash is null").count() == 0
    # Another type becomes a native collection, built anew.
    (tmp_path / "x.inpx").write_bytes(zipped({"list.inp": ""}))
    other = str(tmp_path / "other")
    store.save_inpx(spark, other, str(tmp_path / "x.inpx"), str(lib))
    assert store.books(spark, other).count() == 0
    store.refresh(spark, other)
    assert store.load(spark, other, "info").first()["type"] == "native" and store.books(spark, other).count() == 3


@pytest.mark.parametrize("piece", ["<!--", "<![CDATA[", "<?", "<!", "<a ", "<a '", "<a \"", "<", "</a>", "<a x='>' "])
def test_xml_takes_time_in_proportion(piece):
    import time

    began = time.time()
    xmltree.parse(piece * (400_000 // len(piece)), strict=False)
    assert time.time() - began < 5


def test_books_leave_their_files(spark, tmp_path):
    from folioscope.schema import COLLECTION
    from folioscope.sources import store
    from folioscope.sources.archive_write import remove_book

    root, lib = str(tmp_path / "store"), tmp_path / "lib"
    lib.mkdir()
    (lib / "a.zip").write_bytes(zipped({"x.fb2": fb2("X"), "x.fbd": fb2("X"), "in.zip": zipped({"y.fb2": fb2("Y"), "z.fb2": fb2("Z")})}))
    (lib / "b.txt").write_text("b")
    (lib / "c.rar").write_bytes(rar5({"q.fb2": (fb2("Q"), 0)}))
    store.save(spark, root, info=spark.createDataFrame([("native", str(lib), None)], COLLECTION))
    store.refresh(spark, root, str(lib))
    titles = lambda: sorted(r["titles"][0] for r in store.books(spark, root).collect())
    assert titles() == ["Q", "X", "Y", "Z", "b"]
    assert remove_book(spark, str(lib / "a.zip"), ["in.zip", "y.fb2"]) and remove_book(spark, str(lib / "a.zip"), ["x.fb2"])
    assert not remove_book(spark, str(lib / "c.rar"), ["q.fb2"]) and not remove_book(spark, str(lib / "b.txt"))
    store.refresh(spark, root)
    assert titles() == ["Z"] and sorted(p.name for p in lib.iterdir() if not p.name.startswith(".")) == ["a.zip"]
    assert not remove_book(spark, str(lib / "a.zip"), ["in.zip", "z.fb2"])


def test_deep_xml():
    root = xmltree.parse("<a>" * 20_000 + "x" + "</a>" * 20_000)
    assert xmltree.write(root) == "<a>" * 20_000 + "x" + "</a>" * 20_000


def seven_zip(entries, coder="lzma2", encoded=True):
    """A 7z file written by the format's description: one solid folder of all entries."""
    import lzma

    def number(n):
        return bytes([n]) if n < 0x80 else bytes([0xC0 | n >> 16, n & 255, n >> 8 & 255]) if n < 1 << 21 else b"\xf0" + struct.pack("<I", n)

    def pack(data, kind):
        filters = {"lzma": {"id": lzma.FILTER_LZMA1, "dict_size": 1 << 16, "lc": 3, "lp": 0, "pb": 2}, "lzma2": {"id": lzma.FILTER_LZMA2, "dict_size": 1 << 16}}
        if kind == "copy":
            return data, b"\x01\x00"
        if kind == "deflate":
            z = zlib.compressobj(9, zlib.DEFLATED, -15)
            return z.compress(data) + z.flush(), b"\x03\x04\x01\x08"
        if kind == "ppmd":
            return data, b"\x23\x03\x04\x01" + b"\x05" + b"\x06\0\0\1\0"
        out = lzma.compress(data, lzma.FORMAT_RAW, filters=[filters[kind]])
        return out, b"\x23\x03\x01\x01\x05\x5d" + struct.pack("<I", 1 << 16) if kind == "lzma" else b"\x21\x21\x01\x08"

    def streams(at, size, unpacked, method, counts=b""):
        return b"\x06" + number(at) + number(1) + b"\x09" + number(size) + b"\0" + b"\x07\x0b\x01\0\x01" + method + b"\x0c" + number(unpacked) + b"\0" + counts + b"\0"

    full = {k: v for k, v in entries.items() if v}
    plain = b"".join(full.values())
    body, method = pack(plain, coder)
    sizes = b"".join(number(len(x)) for x in list(full.values())[:-1])
    counts = b"\x08\x0d" + number(len(full)) + b"\x09" + sizes + b"\x0a\x01" + b"\0" * 4 * len(full) + b"\0"
    names = b"\0" + "".join(f"{k}\0" for k in entries).encode("utf-16-le")
    empty = sum((not v) << (7 - k) for k, v in enumerate(entries.values())) if len(entries) <= 8 else 0
    times = b"\x01\0" + struct.pack("<Q", 126256896000000000) * len(entries)  # 3 February 2001
    prop = lambda kind, data: bytes([kind]) + number(len(data)) + data
    head = b"\x01\x04" + streams(0, len(body), len(plain), method, counts) + b"\x05" + number(len(entries)) + prop(0x0E, bytes([empty])) + prop(0x11, names) + prop(0x14, times) + b"\0\0"
    if encoded:
        small, method = pack(head, "lzma")
        body, head = body + small, b"\x17" + streams(len(body), len(small), len(head), method)
    return b"7z\xbc\xaf\x27\x1c\0\x04" + b"\0" * 4 + struct.pack("<QQ", len(body), len(head)) + b"\0" * 4 + body + head


def rar4(entries):
    out = b"Rar!\x1a\x07\0" + struct.pack("<HBHH", 0, 0x73, 0, 13) + b"\0" * 6
    for name, (data, method, flags) in entries.items():
        own = struct.pack("<IIBIIBBHI", len(data), len(data) or 0, 3, 0, (21 << 25) | (2 << 21) | (3 << 16), 29, method, len(name), 0) + name.encode()
        out += struct.pack("<HBHH", 0, 0x74, 0x8000 | flags, 7 + len(own)) + own + data
    return out + struct.pack("<HBHH", 0, 0x7B, 0, 7)


def rar5(entries):
    def block(kind, rest, data=b""):
        head = bytes([kind, 2]) + bytes([len(data) & 127 | 128, len(data) >> 7]) + rest if data else bytes([kind, 0]) + rest
        return b"\0" * 4 + bytes([len(head)]) + head + data

    out = b"Rar!\x1a\x07\x01\0" + block(1, b"\0")
    for name, (data, method) in entries.items():
        size = bytes([len(data) & 127 | 128, len(data) >> 7])
        out += block(2, b"\x02" + size + b"\0" + struct.pack("<I", 981158400) + bytes([method << 7 & 127 | 128, method]) + b"\0" + bytes([len(name.encode())]) + name.encode(), data)
    return out + block(5, b"\0")


@pytest.mark.parametrize("coder", ["copy", "lzma", "lzma2", "deflate"])
@pytest.mark.parametrize("encoded", [False, True])
def test_seven_zip(coder, encoded):
    entries = {"dir/a.fb2": fb2("In Seven") * 1, "é.txt": "text é".encode() * 300, "empty.txt": b"", "in.zip": zipped({"d.fb2": fb2("Deep")})}
    data = seven_zip(entries, coder, encoded)
    assert [(x.path, x.content, x.date) for x in archives.entries(".7z", data)] == [(k, v, "03.02.2001") for k, v in entries.items() if v]
    assert [(h, b["titles"]) for h, _, b, _ in archives.books(".7z", data)] == [(["dir/a.fb2"], ["In Seven"]), (["é.txt"], ["é"]), (["in.zip", "d.fb2"], ["Deep"])]
    for n in range(0, len(data), 37):  # broken anywhere: fewer entries, no crash
        list(archives.entries(".7z", data[:n]))


def test_archives_of_unknown_methods(tmp_path):
    from folioscope.sources.archive_write import extract, without

    sealed = seven_zip({"a.fb2": b"x" * 50, "b.bin": b"y" * 9}, "ppmd")
    assert [(x.path, x.content) for x in archives.entries(".7z", sealed)] == [("a.fb2", None), ("b.bin", None)]
    assert [(h, b["titles"], b["dates"]) for h, _, b, _ in archives.books(".7z", sealed)] == [(["a.fb2"], ["a"], ["03.02.2001"])]
    stored = {"a.fb2": fb2("Stored"), "d\\b.txt": b"t"}
    old = rar4({k: (v, 0x30, 0) for k, v in stored.items()} | {"c.fb2": (b"zzz", 0x33, 0), "dir": (b"", 0x30, 0xE0)})
    assert [(x.path, x.content, x.date) for x in archives.entries(".rar", old)] == [("a.fb2", fb2("Stored"), "03.02.2001"), ("d/b.txt", b"t", "03.02.2001"), ("c.fb2", None, "03.02.2001")]
    new = rar5({"a.fb2": (fb2("Fifth"), 0), "é.txt": (b"packed", 3)})
    assert [(x.path, x.content, x.date) for x in archives.entries(".rar", new)] == [("a.fb2", fb2("Fifth"), "03.02.2001"), ("é.txt", None, "03.02.2001")]
    assert [b["titles"] for _, _, b, _ in archives.books(".rar", new)] == [["Fifth"], ["é"]]
    with pytest.raises(NotImplementedError):
        without(".rar", new, ["a.fb2"])
    for data in (old, new):
        for n in range(0, len(data), 11):
            list(archives.entries(".rar", data[:n]))
    made = extract(".zip", zipped({"x/a.txt": b"1", "b.txt": b"2"}), str(tmp_path / "out"))
    assert sorted(open(p, "rb").read() for p in made) == [b"1", b"2"]
    with pytest.raises(ValueError, match="outside"):
        extract(".zip", zipped({"../a.txt": b"1"}), str(tmp_path / "out"))


def test_books_are_handed_on_together(spark, monkeypatch):
    """Many files' books make one batch, up to so many rows or bytes of covers; a column of empty lists alone, and one of lists and nulls, keep their values."""
    schema = ingest._arrow(spark, f"{BOOKS}, {DETAILS}")
    book = lambda k: formats.parse(".txt", b"text %d" % k, f"t{k}", "01.01.2001")
    rows = [(f"/{k}", ["x"] if k % 2 else None, None, *book(k)) for k in range(2500)]
    batches = list(ingest._handed_on(iter(rows), schema, True))
    assert [b.num_rows for b in batches] == [1024, 1024, 452]
    want = [{"file_path": p, "path_in_file": h, "fbd_path": s} | b | m for p, h, s, b, m in rows]
    assert pa.Table.from_batches(batches).equals(pa.Table.from_pylist(want, schema=schema))
    monkeypatch.setattr(ingest, "BATCH_BYTES", 10)
    assert [b.num_rows for b in ingest._handed_on(iter(rows[:5]), schema, True)] == [2, 2, 1]


def test_rows_that_become_files_are_dealt_out(spark, monkeypatch):
    from folioscope.plans import ingest_queries, tables

    monkeypatch.setattr(tables, "FILES_A_TASK", 50)
    made = ingest_queries._files(spark, "/root/testdata/sf0.001", ".txt", F.encode("p_name", "UTF-8"))
    assert made.rdd.getNumPartitions() == 4 and made.count() == 200


def test_members_of_a_held_zip():
    """Read at one go where the entry is as its header says; else as the library reads it, with its errors."""
    data = pack(".zip", {"é.txt": b"a" * 1000, "b.txt": b"b"})
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        assert [archives.member(z, data, x) for x in z.infolist()] == [b"a" * 1000, b"b"]
        monkey = z.read
        z.read = None  # isn't needed
        assert archives.member(z, data, z.infolist()[0]) == b"a" * 1000
        z.read = monkey
    at = data.index(b"b.txt") + 5
    broken = data[:at] + bytes([data[at] ^ 255]) + data[at + 1 :]
    with zipfile.ZipFile(io.BytesIO(broken)) as z, pytest.raises((zipfile.BadZipFile, zlib.error)):
        archives.member(z, broken, z.infolist()[1])


def test_members_of_a_held_tar(monkeypatch):
    """Taken out of the bytes that are held; one that breaks off, and a packed one without a name for it, are left to the library."""
    data = pack(".tar", {"a.txt": b"a" * 1000, "b.txt": b"b" * 1000})
    of = lambda x: [(e.path, e.content) for e in archives.entries(".tar", x)]
    every = [("a.txt", b"a" * 1000), ("b.txt", b"b" * 1000)]
    assert of(gzip.compress(data)) == every and of(data[: data.index(b"b" * 1000) + 10]) == every[:1]
    monkeypatch.setattr(tarfile.TarFile, "extractfile", None)  # isn't needed
    assert of(data) == every


def test_books_of_held_zips(monkeypatch):
    made = pack(".zip", {"meta.xml": b"<o><dc:title>T</dc:title></o>", "Thumbnails/thumbnail.png": b"PNG"})
    monkeypatch.setattr(zipfile.ZipFile, "read", None)  # isn't needed
    book, more = formats.odt(made)
    assert book["titles"] == ["T"] and more["cover"]["data"] == b"PNG"
    assert formats.epub(epub())[0]["titles"] == ["E Book"]


def test_searches_walk_a_tree_once():
    class Children(list):
        walks = 0

        def __getitem__(self, at):
            Children.walks += 1
            return super().__getitem__(at)

    root = xmltree.parse('<a><b k="1">x<c/></b><c k="1"/><b/></a>')
    root.children = Children(root.children)
    assert [len(root.search(x)) for x in ("a", "b", "c", "d")] == [1, 2, 2, 0] and Children.walks == 1
    assert [x.name for x in root.search("c", "k")] == [x.name for x in root.search("c", "k", "1")] == ["c"] and root.search("c", "k", "2") == []
    root.search("b").clear()
    assert len(root.search("b")) == 2 and [x.name for x in root.search(where=lambda n: n.attributes)] == ["b", "c"]


def test_a_book_without_details_has_no_lists_of_its_own():
    """Empty lists for each detail of a book cost as much as a small file's parsing; no parser adds to them."""
    assert formats._new()[1]["keywords"] is EMPTY_DETAILS["keywords"]
    for ext, data in ((".fb2", fb2()), (".epub", epub()), (".odt", zipped({"meta.xml": "<o/>"})), (".pdf", b"%PDF-1.4 <</Title (own)/Keywords (a)>>"), (".txt", b"x"), (".md", b"x")):
        formats.parse(ext, data, "s", "d")
    assert all(not v for v in EMPTY_DETAILS.values())


def test_archives_of_a_catalogue_are_bounded(spark, monkeypatch):
    """More books make more archives and catalogue files, not larger ones."""
    import __spark_entry__
    from folioscope.plans import index_queries

    monkeypatch.setattr(index_queries, "SHELVED", 50)
    lists, folder = index_queries._catalogue(spark, "/root/testdata/sf0.001")
    sizes = [len(zipfile.ZipFile(io.BytesIO(bytes(r["content"]))).namelist()) for r in ingest.crawl(spark, folder).collect()]
    assert sum(sizes) == 200 and max(sizes) <= 10 and spark.read.format("binaryFile").load(lists).count() >= 4
    assert __spark_entry__.queries()["inpx_collection"](spark, "/root/testdata/sf0.001").count() == 200
