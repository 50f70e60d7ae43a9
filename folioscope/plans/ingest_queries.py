"""Queries that write each part as a file's bytes, read the files with the ingest's parsers, and must find the part again."""

from __future__ import annotations

import struct
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.functions.text import xml_escape
from folioscope.operators import catalog
from folioscope.plans.queries import query
from folioscope.plans.tables import FILES_SQL, dealt, files, scratch, table
from folioscope.sources import archives, genres, ingest, inpx, legacy, store
from folioscope.sources.archive_write import listing, pack, without
from folioscope.sources.charset import to_text

CRAWLED = "file_path string, root_path string, file_size long, modified timestamp, content binary"


def _files(spark: SparkSession, sf_dir: str, ext: str, content) -> DataFrame:
    """Crawled files, one a part, with content from a column of bytes."""
    path = F.concat(F.lit("/lib/"), F.col("p_partkey").cast("string"), F.lit(ext))
    rows = dealt(table(spark, sf_dir, "part"), "p_partkey").select(path.alias("file_path"), F.lit("/lib").alias("root_path"), F.lit("2001-02-03 00:00:00").cast("timestamp").alias("modified"), content.alias("content"))
    return rows.select("file_path", "root_path", F.octet_length("content").cast("long").alias("file_size"), "modified", "content")


def _made(df: DataFrame, make: Callable[[str, bytes], bytes]) -> DataFrame:
    """Crawled files with other bytes made of each one's path and bytes."""

    def over(batches):
        for batch in batches:
            made = [make(batch.column(0)[k].as_py(), batch.column(4)[k].as_py()) for k in range(batch.num_rows)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(map(len, made), pa.int64()), batch.column(3), pa.array(made, pa.binary())], names=batch.schema.names)

    return df.select("file_path", "root_path", "file_size", "modified", "content").mapInArrow(over, CRAWLED)


def _parse(made: DataFrame, details: bool = False) -> DataFrame:
    """Books of files that Python makes. The files are written first: the parse asks for large ones by their sizes, and else each would be made three times."""
    path = f"{scratch(made.sparkSession)}/made"
    made.write.parquet(path)
    return ingest.parse(made.sparkSession.read.schema(CRAWLED).parquet(path), details=details)


def _fb2_bytes():
    e = lambda c: xml_escape(F.col(c).cast("string"))
    lit = F.lit
    return F.encode(
        F.concat(
            lit('<?xml version="1.0" encoding="UTF-8"?><FictionBook><description><title-info><genre>'), e("p_type"),
            lit("</genre><author><last-name>"), e("p_brand"), lit("</last-name></author><author/><book-title>"), F.when(F.col("p_size") % 3 == 0, "").otherwise(e("p_name")),
            lit('</book-title><sequence name="'), e("p_brand"), lit('" number="'), e("p_size"), lit('"/><date>'), e("p_size"), lit("</date></title-info></description><body><p>x</p></body></FictionBook>"),
        ),
        "UTF-8",
    )


def _id():
    return F.regexp_extract("file_path", r"(\d+)\.[^/]*$", 1).cast("long").alias("id")


_TITLE = "CASE WHEN p_size % 3 = 0 THEN CAST(p_partkey AS VARCHAR) ELSE p_name END"


@query(f"SELECT p_partkey AS id, {_TITLE} AS title, p_brand AS author, p_type AS genre, concat(p_brand, '/', p_size) AS series, CAST(p_size AS VARCHAR) AS date FROM part")
def ingest_fb2(spark, sf_dir):
    rows = ingest.parse(_files(spark, sf_dir, ".fb2", _fb2_bytes()))
    return rows.select(
        _id(), F.col("titles")[0].alias("title"), F.array_join(F.transform("authors", lambda a: a["last"]), ",").alias("author"), F.array_join("genres", ",").alias("genre"),
        F.concat_ws("/", F.col("sequences")[0]["name"], F.col("sequences")[0]["number"]).alias("series"), F.col("dates")[0].alias("date"),
    )


@query(f"SELECT p_partkey AS id, 'a.fb2' AS place, CASE WHEN p_size % 3 = 0 THEN 'a' ELSE p_name END AS title FROM part UNION ALL SELECT p_partkey, 'in.tar.gz/b.fb2', CASE WHEN p_size % 3 = 0 THEN 'b' ELSE p_name END FROM part")
def ingest_nested_archives(spark, sf_dir):
    """Books in a zip, and in an archive inside it."""
    files = _made(_files(spark, sf_dir, ".zip", _fb2_bytes()), lambda _, data: pack(".zip", {"a.fb2": data, "in.tar.gz": pack(".tar.gz", {"b.fb2": data, "empty.txt": b""})}))
    return _parse(files).select(_id(), F.array_join("path_in_file", "/").alias("place"), F.col("titles")[0].alias("title"))


@query("SELECT p_partkey AS id, CAST(p_partkey AS VARCHAR) AS title, '03.02.2001' AS date FROM part")
def ingest_text_defaults(spark, sf_dir):
    """A text has its file's stem as title and the file's date."""
    rows = ingest.parse(_files(spark, sf_dir, ".txt", F.encode("p_name", "UTF-8")))
    return rows.select(_id(), F.col("titles")[0].alias("title"), F.col("dates")[0].alias("date"))


@query("SELECT p_partkey AS id, p_name AS title, p_brand AS author, p_type AS genre FROM part")
def ingest_legacy_store(spark, sf_dir):
    """A store in the old binary form for each part."""
    raw = F.encode(F.concat_ws("\x01", F.col("p_partkey").cast("string"), "p_brand", "p_name", "p_type"), "UTF-8")

    def make(_, data: bytes) -> bytes:
        key, brand, name, kind = data.split(b"\x01")
        short = lambda *xs: b"".join(struct.pack("<H", len(x)) + x for x in xs)
        framed = lambda x: struct.pack("<Q", len(x)) + x
        return short(b"/lib") + framed(short(key + b".fb2", b"") + framed(short(b"", brand, name, b"", kind, b"")))

    rows = legacy.books_of(_made(_files(spark, sf_dir, ".base", raw), make))
    return rows.select(_id(), F.col("titles")[0].alias("title"), F.col("authors")[0]["full"].alias("author"), F.col("genres")[0].alias("genre"))


@query("SELECT page_id, md5(html) AS digest FROM pages")
def charset_round_trip(spark, sf_dir):
    """Pages in UTF-8, or in UTF-16 with a mark, read as what they are."""
    utf16 = F.concat(F.unhex(F.lit("FFFE")), F.encode("html", "UTF-16LE"))
    pages = table(spark, sf_dir, "pages")
    return pages.select("page_id", F.md5(to_text(F.when(F.col("page_id") % 2 == 0, utf16).otherwise(F.encode("html", "UTF-8")))).alias("digest"))


# Formats ---------------------------------------------------------------------------------------------------------------


def _fields(spark: SparkSession, sf_dir: str, ext: str, make: Callable[[dict[str, str]], bytes]) -> DataFrame:
    """Crawled files, one a part, made by Python from the part's key, name, brand, type and size."""
    names = ("key", "name", "brand", "kind", "size")
    raw = F.encode(F.concat_ws("\x01", F.col("p_partkey").cast("string"), "p_name", "p_brand", "p_type", F.col("p_size").cast("string")), "UTF-8")
    return _made(_files(spark, sf_dir, ext, raw), lambda _, data: make(dict(zip(names, data.decode("utf-8").split("\x01"), strict=True))))


def _dublin_core(x: dict[str, str], more: str = "") -> str:
    return f'<metadata><dc:title>{x["name"]}</dc:title><dc:creator id="a">{x["brand"]}</dc:creator><dc:contributor id="t">Tr {x["brand"]}</dc:contributor><dc:subject>{x["kind"]}</dc:subject><dc:date>{x["size"]}</dc:date><dc:language>en</dc:language>{more}</metadata>'


def _epub(x: dict[str, str]) -> bytes:
    roles = '<meta property="role" refines="#a">aut</meta><meta property="role" refines="#t">trl</meta>'
    opf = f'<package>{_dublin_core(x, roles)}<manifest><item id="my-cover" media-type="image/png" href="img/c.png"/></manifest></package>'
    return pack(".zip", {"META-INF/container.xml": b'<container><rootfiles><rootfile full-path="O/x.opf"/></rootfiles></container>', "O/x.opf": opf.encode(), "O/img/c.png": x["name"].encode()})


@query("SELECT p_partkey AS id, p_name AS title, p_brand AS author, concat('Tr ', p_brand) AS translator, p_type AS genre, CAST(p_size AS VARCHAR) AS date, 'en' AS lang, md5(p_name) AS cover FROM part")
def ingest_epub(spark, sf_dir):
    """Electronic books: roles of people by refining elements, and the cover named in the list of contents."""
    rows = _parse(_fields(spark, sf_dir, ".epub", _epub), details=True)
    return rows.select(
        _id(), F.col("titles")[0].alias("title"), F.array_join(F.transform("authors", lambda a: a["full"]), ",").alias("author"), F.col("translator")[0]["full"].alias("translator"),
        F.col("genres")[0].alias("genre"), F.col("dates")[0].alias("date"), F.col("language")[0].alias("lang"), F.md5(F.col("cover.data")).alias("cover"),
    )


@query("SELECT p_partkey AS id, p_name AS title, concat(p_brand, ',Tr ', p_brand) AS author, 'Pen 1' AS program, md5(p_brand) AS cover FROM part")
def ingest_odt(spark, sf_dir):
    """Office documents: people without roles, the program, the picture beside the text."""
    made = _fields(spark, sf_dir, ".odt", lambda x: pack(".zip", {"meta.xml": f'<o>{_dublin_core(x).replace("dc:contributor", "dc:creator")}<meta:generator>Pen 1</meta:generator></o>'.encode(), "Thumbnails/thumbnail.png": x["brand"].encode()}))
    rows = _parse(made, details=True)
    return rows.select(_id(), F.col("titles")[0].alias("title"), F.array_join(F.transform("authors", lambda a: a["full"]), ",").alias("author"), F.col("ebook_program_used")[0].alias("program"), F.md5(F.col("cover.data")).alias("cover"))


@query("SELECT p_partkey AS id, concat(p_name, ' (new)') AS title, p_brand AS author, '03.02.2001' AS date, p_type AS keywords FROM part")
def ingest_pdf(spark, sf_dir):
    """Titles with escaped brackets or in UTF-16, in a plain dictionary or inside an inflated object stream."""
    import zlib

    def make(x: dict[str, str]) -> bytes:
        if int(x["key"]) % 2:
            title = b"(" + x["name"].encode() + b" \\(new\\))"
        else:
            title = b"<" + ("\ufeff" + x["name"] + " (new)").encode("utf-16-be").hex().encode() + b">"
        info = b"<</Title " + title + b"/Author (" + x["brand"].encode() + b")/Keywords (" + x["kind"].encode() + b")/CreationDate (D:20010203101112Z)>>"
        return b"%PDF-1.5\n1 0 obj" + info + b"endobj" if int(x["key"]) % 3 else b"%PDF-1.5\n2 0 obj<</Type/ObjStm/N 1/First 4>>stream\n" + zlib.compress(b"1 0 " + info) + b"\nendstream"

    rows = _parse(_fields(spark, sf_dir, ".pdf", make), details=True)
    return rows.select(_id(), F.col("titles")[0].alias("title"), F.col("authors")[0]["full"].alias("author"), F.col("dates")[0].alias("date"), F.col("keywords")[0].alias("keywords"))


@query("SELECT p_partkey AS id, p_name AS title, p_brand AS author, p_type AS series, CAST(p_size AS VARCHAR) AS date FROM part")
def ingest_djvu(spark, sf_dir):
    """Annotation tags, in small letters or with a capital."""

    def make(x: dict[str, str]) -> bytes:
        case = str.capitalize if int(x["key"]) % 2 else str
        notes = "(metadata " + " ".join(f'({case(k)} "{x[v]}")' for k, v in (("title", "name"), ("author", "brand"), ("series", "kind"), ("year", "size"))) + ")"
        return b"AT&TFORM" + struct.pack(">I", len(notes) + 12) + b"DJVUANTa" + struct.pack(">I", len(notes)) + notes.encode()

    rows = _parse(_fields(spark, sf_dir, ".djvu", make))
    return rows.select(_id(), F.col("titles")[0].alias("title"), F.col("authors")[0]["full"].alias("author"), F.col("sequences")[0]["full"].alias("series"), F.col("dates")[0].alias("date"))


@query("SELECT p_partkey AS id, CASE WHEN p_partkey % 4 = 3 THEN CAST(p_partkey AS VARCHAR) ELSE p_name END AS title FROM part")
def ingest_broken_xml(spark, sf_dir):
    """Book files whose text is malformed are read by their description; where that is malformed too, the stem is the title."""

    def make(x: dict[str, str]) -> bytes:
        body, end = {0: ("<p>ok</p>", ""), 1: ("<p>no end", ""), 2: ("</q><b>", ""), 3: ("<p>no end", "</nothing>")}[int(x["key"]) % 4]
        return f'<FictionBook><description><title-info><book-title>{x["name"]}</book-title>{end}</title-info></description><body>{body}</body></FictionBook>'.encode()

    return _parse(_fields(spark, sf_dir, ".fb2", make)).select(_id(), F.col("titles")[0].alias("title"))


@query("SELECT p_partkey AS id, p_name AS annotation, 'fr' AS lang, p_brand AS isbn, concat(p_type, ': ', p_size) AS custom, concat('Orig ', p_name) AS source_title, md5(concat(p_name, chr(10), p_brand)) AS cover FROM part")
def ingest_fb2_details(spark, sf_dir):
    """The details of a book beside the catalogue's fields; without a picture its first paragraphs stand for the cover."""

    def make(x: dict[str, str]) -> bytes:
        return (
            f'<FictionBook><description><title-info><book-title>t</book-title><annotation>{x["name"]}</annotation><lang>fr</lang></title-info><src-title-info><book-title>Orig {x["name"]}</book-title></src-title-info>'
            f'<publish-info><isbn>{x["brand"]}</isbn></publish-info><custom-info info-type="{x["kind"]}">{x["size"]}</custom-info></description><body><p>{x["name"]}</p><p>{x["brand"]}</p></body></FictionBook>'
        ).encode()

    rows = _parse(_fields(spark, sf_dir, ".fb2", make), details=True)
    first = {"annotation": "annotation", "language": "lang", "paper_book_isbn": "isbn", "custom_info": "custom", "source_book_title": "source_title"}
    return rows.select(_id(), *[F.col(k)[0].alias(v) for k, v in first.items()], F.md5(F.col("cover.data")).alias("cover"))


# Archives --------------------------------------------------------------------------------------------------------------


def _shelf(x: dict[str, str]) -> bytes:
    """A zip with a described book, a described file of unknown format, a description without a file, and an archive inside."""
    side = lambda title: f"<FictionBook><description><title-info><book-title>{title}</book-title></title-info></description></FictionBook>".encode()
    inner = pack(".tar", {"deep.txt": x["brand"].encode()})
    return pack(".zip", {"a.pdf": b"%PDF-1.4 <</Title (own)>>", "a.fbd": side(x["name"]), "b.bin": b"?", "b.fbd": side(x["kind"]), "lone.fbd": side("x"), "c.bin": b"?", "in.tar": inner, "empty.txt": b""})


@query("""
SELECT p_partkey AS id, 'a.pdf' AS place, 'a.fbd' AS described, p_name AS title FROM part
UNION ALL SELECT p_partkey, 'b.bin', 'b.fbd', p_type FROM part UNION ALL SELECT p_partkey, 'in.tar/deep.txt', NULL, 'deep' FROM part
""")
def ingest_described_files(spark, sf_dir):
    """Descriptions beside files in archives: they replace a book's own data, and make books of files of unknown format."""
    rows = _parse(_fields(spark, sf_dir, ".zip", _shelf))
    return rows.select(_id(), catalog.place_text(F.col("path_in_file")).alias("place"), F.col("fbd_path").alias("described"), F.col("titles")[0].alias("title"))


@query("SELECT p_partkey AS id, entry, CAST(size AS BIGINT) AS size FROM (SELECT p_partkey, 'c.bin' AS entry, 1 AS size FROM part UNION ALL SELECT p_partkey, 'b.bin', 1 FROM part UNION ALL SELECT p_partkey, 'a.pdf', 25 FROM part)")
def archive_listing(spark, sf_dir):
    """Entries with their sizes, of a zip's directory alone."""
    rows = listing(_fields(spark, sf_dir, ".zip", _shelf)).where("entry like '%.bin' or entry like '%.pdf'")
    return rows.select(_id(), "entry", "size")


@query("SELECT p_partkey AS id, md5(p_brand) AS digest FROM part")
def extract_nested_book(spark, sf_dir):
    """Bytes of a book inside an archive in an archive."""
    made = _made(_fields(spark, sf_dir, ".zip", _shelf), lambda path, data: ingest.book_bytes(data, path, ["in.tar", "deep.txt"]))
    return made.select(_id(), F.md5("content").alias("digest"))


@query("SELECT p_partkey AS id, CASE WHEN p_partkey % 2 = 0 THEN 'b.bin,in.tar/deep.txt' ELSE 'a.pdf,b.bin' END AS places FROM part")
def remove_book_from_archive(spark, sf_dir):
    """Archives written anew without a book and its description, or without the only one of an inner archive, and read again."""

    def less(path: str, data: bytes) -> bytes:
        even = int(archives.stem_of(path)) % 2 == 0
        return without(".zip", data, ["a.pdf"] if even else ["in.tar", "deep.txt"])

    rows = _parse(_made(_fields(spark, sf_dir, ".zip", _shelf), less))
    return rows.select(_id(), catalog.place_text(F.col("path_in_file")).alias("place")).groupBy("id").agg(F.array_join(F.sort_array(F.collect_list("place")), ",").alias("places"))


# Catalogues and old stores ---------------------------------------------------------------------------------------------


@query("SELECT p_partkey AS id, p_name AS title, concat('/lib/shelf', p_partkey % 7, '.zip') AS file_path FROM part WHERE p_partkey % 7 <> 3")
def inpx_load(spark, sf_dir):
    """Catalogue files with a list for each of seven archives, matched with the six that are there, of which one has a copy."""

    def make(x: dict[str, str]) -> bytes:
        line = inpx.FIELD.join([f'{x["brand"]},:', "sf:", x["name"], "", "", x["key"], "", "", "", "fb2", "2001-02-03", ""])
        return pack(".zip", {f'shelf{int(x["key"]) % 7}.inp': f"{line}\r\n".encode(), "version.info": b"1"})

    lines = inpx.lines_in(_fields(spark, sf_dir, ".inpx", make))
    there = spark.createDataFrame([(f"/lib/shelf{k}.zip",) for k in (0, 1, 2, 4, 5, 6)] + [("/lib/shelf2.zipx",), ("/other/shelf3.zip",)], "file_path string")
    rows = inpx.matched(lines, there, "/lib")
    return rows.select(F.regexp_extract(F.col("path_in_file")[0], r"^(\d+)", 1).cast("long").alias("id"), F.col("titles")[0].alias("title"), "file_path")


def _framed(width: str, *xs: bytes) -> bytes:
    return b"".join(struct.pack(width, len(x)) + x for x in xs)


@query("SELECT p_partkey AS id, 'in.zip/x.fb2' AS place, concat(p_brand, '|', p_type) AS authors, p_name AS title FROM part")
def legacy_bookmark_store(spark, sf_dir):
    """Old bookmarks: places by hops, lists by comma and blank."""
    made = _fields(spark, sf_dir, ".marks", lambda x: _framed("<Q", _framed("<H", f'/lib/{x["key"]}.zip'.encode(), b"in.zip\nx.fb2", f'{x["brand"]}, {x["kind"]}'.encode(), x["name"].encode(), b"", b"", b"")))
    rows = legacy.bookmarks_of(made)
    return rows.select(_id(), catalog.place_text(F.col("path_in_file")).alias("place"), F.array_join(F.transform("authors", lambda a: a["full"]), "|").alias("authors"), F.col("titles")[0].alias("title"))


@query("SELECT p_partkey AS id, concat(p_partkey, '.note') AS note_file, CASE WHEN p_size % 2 = 0 THEN p_name END AS note_text FROM part")
def legacy_note_store(spark, sf_dir):
    """Old notes with the texts of their files, where these are there."""
    made = _fields(spark, sf_dir, ".notes", lambda x: _framed("<I", b"skipped", f'/lib/{x["key"]}.fb2'.encode(), b"", f'{x["key"]}.note'.encode()))
    texts = table(spark, sf_dir, "part").where("p_size % 2 = 0").select(F.concat(F.lit("/notes/"), F.col("p_partkey").cast("string"), F.lit(".note")).alias("file_path"), F.encode("p_name", "UTF-8").alias("content"))
    return legacy.with_texts(legacy.notes_of(made), texts).select(_id(), "note_file", "note_text")


@query("SELECT p_partkey AS id, concat('a.zip/', p_brand, '/', p_partkey, '.fb2') AS place FROM part")
def legacy_hops(spark, sf_dir):
    hops = catalog.hops_of(F.concat(F.lit("a.zip\n"), F.col("p_brand"), F.lit("\n"), F.col("p_partkey").cast("string"), F.lit(".fb2")))
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), catalog.place_text(hops).alias("place"))


@query('SELECT CAST(n_nationkey AS VARCHAR) AS code, CAST(n_regionkey AS VARCHAR) AS "group", concat(n_name, \' (de)\') AS translation FROM nation WHERE n_regionkey < 4')
def genre_dictionary(spark, sf_dir):
    """Dictionaries from CSV files, in one of their languages, without genres of missing groups."""
    folder = scratch(spark)
    nation, region = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region").where("r_regionkey < 4")
    code = F.concat_ws(";", F.col("n_nationkey").cast("string"), F.col("n_regionkey").cast("string"), "n_name", F.concat("n_name", F.lit(" (de)")))
    heading = lambda text: spark.createDataFrame([(text,)], "value string").coalesce(1)
    heading("Code;Group;en_EN;de_DE").union(nation.select(code)).coalesce(1).write.text(f"{folder}/codes")
    heading("key en_EN;label de_DE").union(region.select(F.concat_ws(";", F.col("r_regionkey").cast("string"), "r_name"))).coalesce(1).write.text(f"{folder}/groups")
    groups = genres.load_groups(spark, f"{folder}/groups", "de_DE")
    return genres.load_genres(spark, f"{folder}/codes", "de_DE", groups).select("code", "group", "translation")


# Collections -----------------------------------------------------------------------------------------------------------


@query("SELECT lang, doc_id FROM documents")
def crawl_folders(spark, sf_dir):
    """Text files written by folder, found again at any depth, and read; other files are passed over."""
    folder = scratch(spark)
    docs = table(spark, sf_dir, "documents").select("lang", F.col("doc_id").cast("string").alias("value"))
    docs.repartition(3, "value").write.partitionBy("lang").text(folder)
    crawled = ingest.crawl(spark, folder, f"{folder}-missing")
    lines = crawled.select(F.regexp_extract("file_path", r"lang=([^/]*)/", 1).alias("lang"), F.explode(F.split(F.decode("content", "UTF-8"), "\n")).alias("line"))
    return lines.where("line <> ''").select("lang", F.col("line").cast("long").alias("doc_id"))


@query(f"SELECT file_path, CASE WHEN doc_id % 2 = 0 THEN 'second' ELSE 'first' END AS note_text FROM {FILES_SQL}")
def store_versions(spark, sf_dir):
    """A table of a collection, replaced by one that is computed from it."""
    root = scratch(spark)
    place, name = F.lit(None).cast("array<string>").alias("path_in_file"), F.lit("n").alias("note_file")
    store.save(spark, root, notes=files(spark, sf_dir).select("file_path", place, name, F.lit("first").alias("note_text")))
    own = store.load(spark, root, "notes").join(files(spark, sf_dir).select("file_path", "doc_id"), "file_path")
    store.save(spark, root, notes=own.select("file_path", "path_in_file", "note_file", F.when(F.col("doc_id") % 2 == 0, "second").otherwise(F.col("note_text")).alias("note_text")))
    return store.load(spark, root, "notes").select("file_path", "note_text")


@query("SELECT 'native' AS type, '/lib' AS books_dir, count(*) AS n_books FROM part")
def collection_info(spark, sf_dir):
    """A collection's type and books directory, read before its books are counted."""
    from folioscope.schema import COLLECTION

    info = catalog.require_info(spark.createDataFrame([("native", "/lib", None)], COLLECTION))
    return catalog.count_books(table(spark, sf_dir, "part")).select(F.lit(info["type"]).alias("type"), F.lit(info["books_dir"]).alias("books_dir"), "n_books")
