"""Scalar text functions, Column to Column. Nulls stay null unless said otherwise."""

from __future__ import annotations

import html
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Characters that XML writes as entities, in the order in which they are replaced.
ENTITIES = [("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ("'", "&apos;"), ('"', "&quot;")]


def byte_view(text: Column) -> Column:
    """A text whose characters are the UTF-8 bytes of the given one: lengths and places are in bytes then."""
    return F.decode(F.encode(text, "UTF-8"), "ISO-8859-1")


def trim_controls(text: Column) -> Column:
    """Without characters 0 to 32 at both ends."""
    return F.btrim(text, F.lit("".join(map(chr, range(33)))))


def collapse_spaces(text: Column) -> Column:
    """Runs of spaces become one; only U+0020 counts."""
    return F.regexp_replace(text, " {2,}", " ")


def normalise(text: Column) -> Column:
    return collapse_spaces(trim_controls(text))


def normalise_author(text: Column) -> Column:
    """As ``normalise``, and no space after a full stop, so that initials compare alike."""
    return F.replace(normalise(text), F.lit(". "), F.lit("."))


def strip_escapes(text: Column) -> Column:
    """Without control characters other than tab and line feed; tabs become spaces; runs of spaces become one."""
    return collapse_spaces(F.translate(F.regexp_replace(text, r"[\x00-\x08\x0B-\x1F]", ""), "\t", " "))


def final_cleaning(text: Column) -> Column:
    """At most two spaces or line ends in a row, no line end in front, nothing of 0 to 32 at the end."""
    x = F.regexp_replace(text, " {3,}", "  ")
    x = F.regexp_replace(x, r"^\n+", "")
    x = F.regexp_replace(x, r"[\x00-\x20]+$", "")
    return F.regexp_replace(x, r"\n{3,}", "\n\n")


def xml_escape(text: Column) -> Column:
    for char, entity in ENTITIES:
        text = F.replace(text, F.lit(char), F.lit(entity))
    return text


def xml_unescape(text: Column) -> Column:
    """The five named entities; ``&amp;`` last, so that what it uncovers stays as it is."""
    for char, entity in reversed(ENTITIES):
        text = F.replace(text, F.lit(entity), F.lit(char))
    return text


_NUMERIC = re.compile(r"&#([xX][0-9a-fA-F]+|[0-9]+);")
_NAMED = {entity: char for char, entity in ENTITIES}
_ANY = re.compile(rf"{'|'.join(map(re.escape, _NAMED))}|{_NUMERIC.pattern}")


def unescape_python(text: str) -> str:
    """Named and numeric entities (decimal and hexadecimal) in one pass; numbers that are no character stay."""

    def one(m: re.Match) -> str:
        if m[0] in _NAMED:
            return _NAMED[m[0]]
        code = int(m[1][1:], 16) if m[1][0] in "xX" else int(m[1].lstrip("0")[:9] or "0")
        return chr(code) if 0 < code < 0x110000 and not 0xD800 <= code < 0xE000 else m[0]

    return _ANY.sub(one, text) if "&" in text else text


@F.pandas_udf(T.StringType())
def xml_unescape_all(texts: pd.Series) -> pd.Series:
    return texts.map(unescape_python, na_action="ignore")


def replace_symbols(text: Column, table: list[tuple[str, str]]) -> Column:
    """Each symbol of ``table`` (replacement, symbol) replaced, in the table's order. What a replacement makes isn't looked at again by the same entry; empty symbols are passed over."""
    for replacement, symbol in table:
        if symbol:
            text = F.replace(text, F.lit(symbol), F.lit(replacement))
    return text


def quoted_value(text: Column, tag: str) -> Column:
    """What stands between the first pair of double quotes after ``tag``; empty where there is none."""
    return F.regexp_extract(text, re.escape(tag) + r'[^"]*"([^"]*)"', 1)


def ddmmyyyy(ts: Column) -> Column:
    """``dd.mm.YYYY`` of a timestamp, in the session's time zone (UTC for the catalogue's own dates)."""
    return F.date_format(ts, "dd.MM.yyyy")


def default_to(text: Column, other: Column) -> Column:
    """``other`` where the text is null or empty."""
    return F.coalesce(F.nullif(text, F.lit("")), other)


def split_list(text: Column, separator: str) -> Column:
    """Items of a list in which each item is ended by ``separator``: what follows the last one is no item; empty items go."""
    parts = F.split(text, re.escape(separator))
    return F.filter(F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0))), lambda x: x != "")


def compare_key(text: Column, locale: str | None = None) -> Column:
    """Sort key of a text: lower case by bytes, or by a locale's collation where one is named (``UNICODE``, ``de``, ...)."""
    return F.lower(text) if locale is None else F.collate(F.lower(text), locale)


def full_name(last: Column, first: Column, middle: Column, nick: Column) -> Column:
    """``Last First Middle aka Nick``: separators only between parts that are there. All missing: empty."""
    some = lambda c: F.nullif(c, F.lit(""))
    return F.concat_ws(" aka ", F.nullif(F.concat_ws(" ", some(last), some(first), some(middle)), F.lit("")), some(nick))


def markup_parts(markup: str):
    """(start, end, kind) of the tags of a text, in order: ``comment``, ``cdata``, ``other`` (declarations and instructions) or ``tag``.

    One pass, however the markup is broken: what never ends is text, and so is a ``<`` before anything but a name, ``/``, ``!`` or ``?``.
    """
    last, done = markup.rfind(">"), {x: markup.rfind(x) for x in ("-->", "]]>")}
    at = 0
    while (a := markup.find("<", at)) >= 0 and a <= last:
        for begin, end, kind in (("<!--", "-->", "comment"), ("<![CDATA[", "]]>", "cdata")):
            if markup.startswith(begin, a) and done[end] >= a + len(begin):
                at = markup.find(end, a + len(begin)) + 3
                yield a, at, kind
                break
        else:
            c = markup[a + 1 : a + 2]
            if c in ("!", "?", "/") or (c.isascii() and c.isalpha()):
                at = markup.find(">", a) + 1
                yield a, at, "other" if c in "!?" else "tag"
            else:
                at = a + 1


def strip_tags_python(markup: str) -> str:
    """Text of every content and CDATA part, entities of content decoded. Broken markup keeps what is no tag."""
    out, at = [], 0
    for start, end, kind in markup_parts(markup):
        out += [decoded(markup[at:start]), markup[start + 9 : end - 3] if kind == "cdata" else ""]
        at = end
    return "".join([*out, decoded(markup[at:])])


_LONG_NUMBER = re.compile(r"&#([0-9]{8,});?")


def decoded(text: str) -> str:
    """Entities decoded; a number of more digits than any code point has is none."""
    if "&#" in text:
        text = _LONG_NUMBER.sub(lambda m: f"&#{n};" if len(n := m[1].lstrip("0")) < 8 else "\ufffd", text)
    return html.unescape(text)


@F.pandas_udf(T.StringType())
def strip_tags(markup: pd.Series) -> pd.Series:
    return markup.map(strip_tags_python, na_action="ignore")


# The default table of tags (start, end; None: the tag stays as it is).
TAGS = {
    "p": ("", "<br><br>"), "empty-line": ("", "<br>"), "sub": ('<span style="vertical-align: sub; font-size: smaller;">', "</span>"),
    "sup": ('<span style="vertical-align: super; font-size: smaller;">', "</span>"), "strong": ("<b>", "</b>"), "emphasis": ("<em>", "</em>"),
    "strikethrough": ("<s>", "</s>"), "a": None, "span": None, "br": None, "b": None, "em": None, "s": None,
}


_NAME = re.compile(r"</?([A-Za-z][\w:.-]*)")


def replace_tags_python(markup: str, table: dict[str, tuple[str, str] | None] | None = None) -> str:
    """Tags of ``table`` become their replacements, or stay where it says None; other tags go, their content stays."""
    table = TAGS if table is None else table
    out, at = [], 0
    for start, end, kind in markup_parts(markup):
        m = _NAME.match(markup, start) if kind == "tag" else None
        if kind == "tag" and not m:  # "</" before anything but a name is text
            continue
        out.append(markup[at:start])
        at = end
        if m and m[1] in table:
            own = table[m[1]]
            closing, empty = markup[start + 1] == "/", markup[end - 2] == "/"
            out.append(markup[start:end] if own is None else own[1] if closing else own[0] + own[1] * empty)
    return "".join([*out, markup[at:]])


def replace_tags(markup: Column, table: dict[str, tuple[str, str] | None] | None = None) -> Column:
    @F.pandas_udf(T.StringType())
    def run(x: pd.Series) -> pd.Series:
        return x.map(lambda v: replace_tags_python(v, table), na_action="ignore")

    return run(markup)
