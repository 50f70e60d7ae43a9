"""Fuzzy search over books, filters and orders of its results."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscope.functions.match import Rule, joined, normalise_needle
from folioscope.functions.text import compare_key, full_name, normalise, normalise_author
from folioscope.operators.shared import held


@dataclass(frozen=True)
class Author:
    """A request for an author: by parts, or by the whole name (``full``) for an exact one."""

    last: str = ""
    first: str = ""
    middle: str = ""
    nick: str = ""
    full: str = ""


@dataclass(frozen=True)
class Title:
    text: str


@dataclass(frozen=True)
class Genre:
    code: str


@dataclass(frozen=True)
class Sequence:
    name: str
    number: str = ""


def _fits(source: Column, needle: str, coef: float, author: bool = False) -> Column:
    rule = Rule.of(needle, coef)
    clean = F.lower((normalise_author if author else normalise)(source))
    return F.lit(False) if rule is None else rule.column(clean)


def _any(column: str, needle: str, coef: float) -> Column:
    rule = Rule.of(normalise_needle(needle), coef)
    return F.lit(False) if rule is None else rule.any_of(joined(F.col(column)))


def _author(a: Column, request: Author, coef: float) -> Column:
    parts = {x: normalise_needle(getattr(request, x)) for x in ("last", "first", "middle", "nick")}
    wanted = {k: v for k, v in parts.items() if v}
    stored = full_name(a["last"], a["first"], a["middle"], a["nick"])
    free = F.coalesce(F.nullif(a["full"], F.lit("")), F.lit(""))
    structured = stored != ""
    if not wanted:  # the exact rule: equality of whole normalised names
        needle = normalise_needle(request.full, author=True)
        name = F.when(structured, stored).otherwise(free)
        return F.lit(bool(needle)) & (F.lower(normalise_author(name)) == F.lit(needle))
    by_parts = F.lit(True)
    for part, needle in wanted.items():
        by_parts = by_parts & _fits(F.coalesce(a[part], F.lit("")), needle, coef)
    # A stored whole name is compared with the request's parts put together as a name is.
    head = " ".join(v for k, v in wanted.items() if k != "nick")
    whole = " aka ".join(x for x in (head, wanted.get("nick", "")) if x)
    return F.when(structured, by_parts).otherwise(_fits(free, whole, coef, author=True))


def _sequence(s: Column, request: Sequence, coef: float) -> Column:
    name, number = normalise_needle(request.name), normalise_needle(request.number)
    whole = f"{name} {number}".strip() if name else ""
    by_name = _fits(F.coalesce(s["name"], F.lit("")), name, coef)
    if number:  # stored numbers keep their case
        by_name = by_name & (F.coalesce(s["number"], F.lit("")) == F.lit(number))
    return F.when(F.coalesce(s["name"], F.lit("")) != "", by_name).otherwise(_fits(F.coalesce(s["full"], F.lit("")), whole, coef))


def predicate(request: object, coef: float) -> Column | None:
    """Condition of one request on a row of books; None for a kind that the search doesn't know, which it ignores."""
    match request:
        case Title(text):
            return _any("titles", text, coef)
        case Genre(code):
            return _any("genres", code, coef)
        case Sequence():
            return F.exists("sequences", lambda s: _sequence(s, request, coef))
        case Author():
            return F.exists("authors", lambda a: _author(a, request, coef))
    return None


def search(books: DataFrame, requests: list[object], coef: float = 0.75) -> DataFrame:
    """Books that meet every request; all books without one. One filter over one scan: nothing is shuffled.

    Titles and genres are tested in generated code; authors and series, whose parts belong together, item by item.

    Results have the file's path and the book; the file's hash and size are not read.
    """
    test = F.lit(True)
    for request in requests:
        own = predicate(request, coef)
        test = test if own is None else test & F.coalesce(own, F.lit(False))
    columns = [c for c in ("file_path", "path_in_file", "fbd_path", "authors", "titles", "sequences", "genres", "dates") if c in books.columns]
    return books.where(test).select(*columns)


def filter_contains(rows: DataFrame, column: str, text: str) -> DataFrame:
    """Rows whose display column contains ``text``, whatever the case; an empty text changes nothing."""
    return rows.where(F.contains(F.lower(column), F.lit(text.lower()))) if text else rows


def order_by_text(rows: DataFrame, column: str, *ties: str, descending: bool = False, inverted: bool = False, locale: str | None = None) -> DataFrame:
    """Rows in the order of a display column, lower-cased, with tie-breaking columns. ``inverted``: as the catalogue's views do, ascending shows the last first. Dates sort as text."""
    return rows.orderBy(text_order(column, descending, inverted, locale), *ties)


def placed(rows: DataFrame, *order: Column) -> DataFrame:
    """``rows`` with their ``place`` (from 1) in an order. Sorted by ranges, counted by range, so that no task has all rows; the driver gets one number a range.

    The sorted rows are cut by a checkpoint in the shared folder, as both looks at them must see the same ranges.
    """
    ranged = held(rows.orderBy(*order).withColumns({"__range": F.spark_partition_id(), "__at": F.monotonically_increasing_id()}))
    sizes = {r["__range"]: r["count"] for r in ranged.groupBy("__range").count().collect()}
    before, total = [], 0
    for k in range(max(sizes, default=-1) + 1):
        before.append(total)
        total += sizes.get(k, 0)
    if not before:
        return rows.withColumn("place", F.lit(1).cast("long"))
    start = F.element_at(F.array(*map(F.lit, before)), F.col("__range") + 1)
    return ranged.withColumn("place", (start + F.col("__at").bitwiseAND(F.lit((1 << 33) - 1)) + 1).cast("long")).drop("__range", "__at")


def text_order(column: str, descending: bool = False, inverted: bool = False, locale: str | None = None) -> Column:
    """Sort key of a display column: see ``order_by_text``."""
    key = compare_key(F.col(column), locale)
    return key.desc() if descending != inverted else key.asc()


def first_match(rows: DataFrame, test: Column, *order: str) -> DataFrame:
    """The first row that meets a condition, by a stated order."""
    return rows.where(test).orderBy(*order).limit(1)
