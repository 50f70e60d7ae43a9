"""Character sets of byte strings."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Byte-order marks and the encodings they stand for.
MARKS = [(b"\xef\xbb\xbf", "utf-8"), (b"\xff\xfe\x00\x00", "utf-32-le"), (b"\x00\x00\xfe\xff", "utf-32-be"), (b"\xff\xfe", "utf-16-le"), (b"\xfe\xff", "utf-16-be")]
_DECLARED = re.compile(rb"<\?xml[^>]*encoding\s*=\s*[\"']([A-Za-z0-9._-]+)[\"']")
# Eight-bit sets of Cyrillic letters, the most frequent Russian small letters, and sets of two-byte signs.
CYRILLIC = ("cp1251", "koi8-r", "cp866", "iso8859-5")
FREQUENT = frozenset("оеаинтсрвлкмдпу")
TWO_BYTES = ("shift_jis", "euc_jp", "gb18030", "big5", "euc_kr")
_UPPER = re.compile(rb"[\x80-\xff]+")
_SMALL, _LARGE = re.compile("[а-яё]"), re.compile("[А-ЯЁ]")
#: Upper bytes looked at for a guess by frequency.
SAMPLE = 4000


def _cyrillic(content: bytes) -> str | None:
    """The set in which most upper bytes, those side by side, are Cyrillic letters, small and frequent ones above all; None if in no set most are letters."""
    found = _UPPER.findall(content[: 16 * SAMPLE])
    together, total = b"".join(x for x in found if len(x) > 1)[:SAMPLE], sum(map(len, found))
    best, least = None, 0.0
    for name in CYRILLIC:
        text = together.decode(name, "replace")
        small, large = len(_SMALL.findall(text)), len(_LARGE.findall(text))
        if small + large > 0.7 * min(total, SAMPLE):
            score = small + large / 2 + sum(c in FREQUENT for c in text)
            if score > least:
                best, least = name, score
    return best


def _share(text: str, *ranges: tuple[int, int]) -> float:
    wide = [c for c in text if ord(c) > 127]
    return sum(any(a <= ord(c) <= b for a, b in ranges) for c in wide) / len(wide) if wide else 0.0


def _two_bytes(content: bytes) -> str | None:
    """A set of two-byte signs that reads the whole string without error, with signs of the kind it is used for; None if there is none."""
    found = _UPPER.findall(content)
    if sum(len(x) == 1 for x in found) > len(found) / 3 and not re.search(rb"[\x80-\xff][\x40-\x7e][\x80-\xff]", content):
        return None
    best, least = None, 0.6
    for name in TWO_BYTES:
        try:
            text = content.decode(name)
        except UnicodeDecodeError:
            continue
        kana, han, hangul = _share(text, (0x3041, 0x30FE)), _share(text, (0x4E00, 0x9FFF), (0x3001, 0x3011), (0xFF01, 0xFF5E)), _share(text, (0xAC00, 0xD7A3))
        # Of han signs, those that are many in these sets' first levels decide: they are what is written most.
        first = _share(text, (0x4E00, 0x9FFF)) * _frequent(content, name)
        score = {"shift_jis": kana * 2 + han, "euc_jp": kana * 2 + han, "gb18030": han * 0.9 + first, "big5": han * 0.9 + first, "euc_kr": hangul * 2}[name] * (kana + han + hangul > 0.8)
        if name in ("shift_jis", "euc_jp") and kana < 0.1:
            score = 0.0
        if score > least:
            best, least = name, score
    return best


def _frequent(content: bytes, name: str) -> float:
    """Share of two-byte signs in the first level of a set, the rows of its frequent signs."""
    pairs, at, total = 0, 0, 0
    low, high = {"gb18030": (0xB0, 0xD7), "big5": (0xA4, 0xC6)}.get(name, (0x100, 0x100))
    while at < min(len(content), SAMPLE):
        if content[at] < 0x80:
            at += 1
            continue
        total += 1
        pairs += low <= content[at] <= high
        at += 2
    return pairs / total if total else 0.0


def detect(content: bytes) -> str:
    """Encoding of a byte string: its mark, its XML declaration, UTF-8 if it is valid; else by what its upper bytes would be.

    Cyrillic sets where most upper bytes are letters there that stand side by side; two-byte sets of China, Japan and Korea; cp1252
    where signs of its own are, else latin-1. The last three are guesses, as any byte string is valid in several sets.
    """
    for mark, name in MARKS:
        if content.startswith(mark):
            return name
    if m := _DECLARED.search(content[:512]):
        name = m[1].decode("ascii")
        try:
            content[:64].decode(name, "ignore")
            return name.lower()
        except LookupError:
            pass
    try:
        content.decode("utf-8")
        return "utf-8"
    except UnicodeDecodeError:
        pass
    wide, narrow = _two_bytes(content), _cyrillic(content)
    if wide and (not narrow or wide in ("shift_jis", "euc_jp")):
        return wide
    if narrow and wide:
        # Words of one language: a Cyrillic text has few signs, a text of two-byte ones many.
        letters = content.decode(narrow, "replace").lower()
        own = [c for c in letters if ord(c) > 127]
        return narrow if sum(c in FREQUENT for c in own) > 0.6 * len(own) else wide
    if narrow:
        return narrow
    return "cp1252" if re.search(rb"[\x80-\x9f]", content) and not re.search(rb"[\x81\x8d\x8f\x90\x9d]", content) else "latin-1"


def decode(content: bytes, encoding: str | None = None) -> str:
    name = encoding or detect(content)
    for mark, of in MARKS:
        if of == name and content.startswith(mark):
            content = content[len(mark) :]
            break
    try:
        return content.decode(name, "replace")
    except LookupError:
        return content.decode("utf-8", "replace")


@F.pandas_udf(T.StringType())
def detect_charset(content: pd.Series) -> pd.Series:
    return content.map(lambda x: detect(bytes(x)), na_action="ignore")


@F.pandas_udf(T.StringType())
def to_text(content: pd.Series) -> pd.Series:
    return content.map(lambda x: decode(bytes(x)), na_action="ignore")
