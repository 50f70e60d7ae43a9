"""Lists, counts, displays and dictionary joins over a collection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscope.functions.text import full_name, normalise_author

#: Rows up to which a dictionary is broadcast; a larger one is joined by a shuffle.
DICTIONARY_ROWS = 100_000


def require_info(info: DataFrame) -> dict:
    """The collection's type, books directory and INPX path; an error where it has none."""
    row = info.limit(1).collect()
    if not row:
        raise ValueError("the collection has no information record")
    return row[0].asDict()


def author_names(a: Column) -> Column:
    """Full name of an author: from its parts, else as it is stored."""
    return F.coalesce(F.nullif(full_name(a["last"], a["first"], a["middle"], a["nick"]), F.lit("")), a["full"], F.lit(""))


def list_authors(books: DataFrame) -> DataFrame:
    """(author): every distinct name once, whatever its case (the smallest spelling stays), in lower-case order. Empty names are none. Minima are combined before the shuffle."""
    names = books.select(F.explode(F.transform("authors", lambda a: normalise_author(author_names(a)))).alias("author"))
    return names.where("author <> ''").groupBy(F.lower("author").alias("key")).agg(F.min("author").alias("author")).orderBy("key").select("author")


def count_books(books: DataFrame) -> DataFrame:
    return books.agg(F.count("*").alias("n_books"))


def count_files(files: DataFrame) -> DataFrame:
    return files.agg(F.count("*").alias("n_files"))


def count_unparsed(files: DataFrame, books: DataFrame) -> DataFrame:
    """Files that have no book yet."""
    return files.join(books.select("file_path"), "file_path", "left_anti").agg(F.count("*").alias("n_unparsed"))


def books_of_file(books: DataFrame, path: str) -> DataFrame:
    return books.where(F.col("file_path") == path)


def displayed(books: DataFrame) -> DataFrame:
    """``books`` with a line of text for each multi-valued field: authors, title (the first), series, genres, dates, joined by comma and blank."""
    series = lambda s: F.coalesce(F.nullif(F.concat_ws(" ", F.nullif(s["name"], F.lit("")), F.nullif(s["number"], F.lit(""))), F.lit("")), s["full"], F.lit(""))
    joined = lambda x: F.array_join(F.filter(x, lambda v: v.isNotNull() & (v != "")), ", ")
    return books.withColumns({
        "author_text": joined(F.transform("authors", author_names)),
        "title_text": F.coalesce(F.get("titles", F.lit(0)), F.lit("")),
        "series_text": joined(F.transform("sequences", series)),
        "genre_text": joined(F.col("genres")),
        "date_text": joined(F.col("dates")),
    })


def place_text(path_in_file: Column) -> Column:
    """The place in a file as a path; empty for a book that is a file itself."""
    return F.coalesce(F.array_join(path_in_file, "/"), F.lit(""))


def hops_of(text: Column) -> Column:
    """The places of an old store, hop by hop on lines of their own; null for none."""
    return F.when(text != "", F.split(text, "\n"))


def same_place(left: DataFrame, right: DataFrame) -> Column:
    """A record's key against a mark's: the file, and the place in it where the book has one. A book without a place meets every mark of its file."""
    return (left["file_path"] == right["file_path"]) & (left["path_in_file"].isNull() | left["path_in_file"].eqNullSafe(right["path_in_file"]))


def with_notes(books: DataFrame, notes: DataFrame) -> DataFrame:
    """Books that have a note: a left-semi join by file path, with the place as its condition. The planner chooses the side to broadcast by size."""
    return books.join(notes, same_place(books, notes), "left_semi")


def notes_of(notes: DataFrame, file_path: str, path_in_file: list[str] | None = None) -> DataFrame:
    test = F.col("file_path") == file_path
    if path_in_file is not None:
        test = test & F.col("path_in_file").eqNullSafe(F.array(*map(F.lit, path_in_file)))
    return notes.where(test)


def dictionary(dim: DataFrame) -> DataFrame:
    """A dictionary, marked for broadcast if a look at its first rows shows that it is small."""
    return F.broadcast(dim) if dim.limit(DICTIONARY_ROWS + 1).count() <= DICTIONARY_ROWS else dim


def translate_genres(books: DataFrame, genres: DataFrame, lang: str) -> DataFrame:
    """(…, genre_names): codes translated into ``lang``, in their order; an unknown code stays itself. Needs ``file_path`` and ``path_in_file``.

    The dictionary is read as one map where it is small, so the books aren't exploded or shuffled.
    """
    own = genres.where(F.col("lang") == lang).where("translation is not null and translation <> ''").groupBy("code").agg(F.min("translation").alias("translation"))
    if own.limit(DICTIONARY_ROWS + 1).count() <= DICTIONARY_ROWS:
        names = own.agg(F.map_from_entries(F.collect_list(F.struct("code", "translation"))).alias("names"))
        own_names = books.withColumn("__names", names.scalar())  # a subquery that runs once
        return own_names.withColumn("genre_names", F.transform("genres", lambda g: F.coalesce(F.element_at("__names", g), g))).drop("__names")
    row = F.monotonically_increasing_id()
    each = books.withColumn("__row", row).select("*", F.posexplode_outer("genres").alias("__at", "__code"))
    joined = each.join(own, each["__code"] == own["code"], "left")
    kept = [F.first(c).alias(c) for c in books.columns]
    named = F.transform(F.array_sort(F.collect_list(F.when(F.col("__code").isNotNull(), F.struct("__at", F.coalesce("translation", "__code").alias("n"))))), lambda x: x["n"])
    return joined.groupBy("__row").agg(*kept, named.alias("genre_names")).drop("__row")


def genre_tree(genres: DataFrame, groups: DataFrame) -> DataFrame:
    """(group, codes): a group's genres in order. Genres of a missing group are left out; groups without genres are too."""
    known = genres.join(dictionary(groups.select("group").distinct()), "group", "left_semi")
    return known.groupBy("group").agg(F.sort_array(F.collect_set("code")).alias("codes"))
