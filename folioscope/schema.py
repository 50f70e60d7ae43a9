"""The catalogue's tables. Nested arrays keep the order in which a record gave its parts."""

from __future__ import annotations

AUTHOR = "struct<full:string,last:string,first:string,middle:string,nick:string>"
SEQUENCE = "struct<full:string,name:string,number:string>"
COVER = "struct<kind:string,data:binary,h:int,w:int>"
#: An author as the details name one.
PERSON = "struct<full:string,last:string,first:string,middle:string,nick:string,home_page:string,email:string,id:string>"

COLLECTION = "type string, books_dir string, inpx_path string"
FILES = "file_path string, root_kind string, root_path string, link_path string, file_hash binary, file_size long"
BOOK = f"authors array<{AUTHOR}>, titles array<string>, sequences array<{SEQUENCE}>, genres array<string>, dates array<string>"
BOOKS = f"file_path string, path_in_file array<string>, fbd_path string, {BOOK}"
NOTES = "file_path string, path_in_file array<string>, note_file string, note_text string"
GENRES = "code string, group string, lang string, translation string"

_PERSONS = "source_book_author ebook_author translator source_book_translator ebook_publisher".split()
_SEQUENCES = "source_book_sequence paper_book_sequence".split()
_STRINGS = (
    "source_book_title source_book_genre ebook_date language source_language source_book_language source_book_source_language source_book_date keywords source_book_keywords "
    "source_book_dublin_core ebook_program_used ebook_source_url ebook_source_ocr ebook_id ebook_version ebook_history paper_book_publisher paper_book_name paper_book_city "
    "paper_book_year paper_book_isbn custom_info djvu_publisher annotation"
).split()
DETAILS = ", ".join([*(f"{x} array<{PERSON}>" for x in _PERSONS), *(f"{x} array<{SEQUENCE}>" for x in _SEQUENCES), *(f"{x} array<string>" for x in _STRINGS), f"cover {COVER}"])
DETAIL_NAMES = [*_PERSONS, *_SEQUENCES, *_STRINGS, "cover"]
EMPTY_BOOK: dict[str, list] = {"authors": [], "titles": [], "sequences": [], "genres": [], "dates": []}
EMPTY_DETAILS: dict = {x: [] for x in DETAIL_NAMES[:-1]} | {"cover": None}


def author(full: str | None = None, last: str | None = None, first: str | None = None, middle: str | None = None, nick: str | None = None) -> dict:
    return {"full": full, "last": last, "first": first, "middle": middle, "nick": nick}


def person(full: str | None = None, **parts: str | None) -> dict:
    return {"full": full} | {x: parts.get(x) for x in ("last", "first", "middle", "nick", "home_page", "email", "id")}


def sequence(full: str | None = None, name: str | None = None, number: str | None = None) -> dict:
    return {"full": full, "name": name, "number": number}
