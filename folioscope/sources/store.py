"""The catalogue's own store: a folder of Parquet tables, replaced as a whole or changed row by row through a log beside them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from folioscope.operators import word_index
from folioscope.operators.maintain import current, stage_table, switch_table
from folioscope.schema import BOOKS, COLLECTION, FILES, NOTES
from folioscope.sources import changelog

TABLES = {"info": COLLECTION, "files": FILES, "books": BOOKS, "bookmarks": BOOKS, "notes": NOTES}
#: What tells the records of a table apart.
KEYS = {"info": ("type",), "files": ("file_path",), "books": changelog.KEY, "bookmarks": changelog.KEY, "notes": changelog.KEY}
#: Rows of one file of a table, so that no file grows without bound.
MAX_RECORDS = 5_000_000


def save(spark: SparkSession, root: str, **tables: DataFrame) -> None:
    """Writes tables of a collection under ``root``; they may be computed from those they replace: all are written before the first is put in place.

    Changes of a table that were logged before are part of what it was; the new one stands for itself.
    """
    if unknown := set(tables) - set(TABLES):
        raise ValueError(f"no such table: {', '.join(sorted(unknown))}")
    staged = {name: stage_table(spark, df, f"{root}/{name}", MAX_RECORDS) for name, df in tables.items()}
    for name, version in staged.items():
        changelog.number_base(spark, f"{root}/{name}", version)
        switch_table(spark, f"{root}/{name}", version)


def load(spark: SparkSession, root: str, name: str) -> DataFrame:
    """A table of a collection, with its logged changes; an empty one where it hasn't been written."""
    at = current(spark, f"{root}/{name}")
    return changelog.read(spark, f"{root}/{name}", KEYS[name]) if at else spark.createDataFrame([], TABLES[name])


def table(spark: SparkSession, root: str, name: str) -> str:
    """The folder of a table, for the functions of ``changelog``; one that hasn't been written is made first."""
    path = f"{root}/{name}"
    if current(spark, path) is None:
        changelog.create(spark, path, spark.createDataFrame([], TABLES[name]))
    return path


def compact(spark: SparkSession, root: str) -> None:
    """Puts the logged changes of all tables into them."""
    for name in TABLES:
        if current(spark, f"{root}/{name}") is not None:
            changelog.compact(spark, f"{root}/{name}", KEYS[name])


def build_index(spark: SparkSession, root: str) -> None:
    """Writes the index of the collection's books for ``search_many``; it is as new as the books were then."""
    word_index.build(spark, books(spark, root), f"{root}/words")


def search_many(spark: SparkSession, root: str, requests: DataFrame) -> DataFrame:
    """See ``word_index.search_batch``."""
    return word_index.search_batch(spark, f"{root}/words", requests)


def refresh(spark: SparkSession, root: str, *paths: str, fast: bool = False) -> None:
    """Brings a collection up to its directories' files. Edits of books in unchanged files stay.

    A native one is compared by sizes (``fast``) or hashes; only added and changed files are parsed. One of another type (INPX, an
    old store) is built anew from its books directory, as a native one. ``paths``: the directories of a native collection that
    has no file yet; else its files say which.
    """
    from folioscope.operators import maintain
    from folioscope.operators.catalog import require_info
    from folioscope.sources import ingest

    info = require_info(load(spark, root, "info"))
    if info["type"] != "native":
        files, found = ingest.create(spark, info["books_dir"])
        save(spark, root, info=spark.createDataFrame([("native", info["books_dir"], None)], COLLECTION), files=files, books=found)
        return
    old = load(spark, root, "files")
    roots = list(paths) or [r["root_path"] for r in old.select("root_path").distinct().collect()]
    crawled = ingest.crawl(spark, *roots)
    now = ingest.files_of(crawled, hashes=not fast)
    changes = maintain.classify_refresh(old, now, fast=fast)
    fresh = maintain.to_parse(changes, crawled)
    if fast:  # hashes only of what is read anyway
        now = old.join(changes.where("change = 'same'").select("file_path"), "file_path", "left_semi").unionByName(ingest.files_of(fresh))
    books_now = maintain.refresh(load(spark, root, "books"), changes, ingest.parse(fresh))
    kept = maintain.dedup_by_hash(now)
    books_now = books_now.join(kept.select("file_path"), "file_path", "left_semi").select(*[f.name for f in spark.createDataFrame([], BOOKS).schema])
    _, kept = maintain.prune_empty(kept.select("root_path"), kept, books_now)
    save(spark, root, files=kept, books=books_now)


def save_inpx(spark: SparkSession, root: str, inpx_path: str, books_dir: str) -> None:
    """An INPX collection stores only where its catalogue and its books are; its books are read anew by each query, as a view is."""
    save(spark, root, info=spark.createDataFrame([("inpx", books_dir, inpx_path)], COLLECTION))


def books(spark: SparkSession, root: str) -> DataFrame:
    """Books of a collection of either kind."""
    info = load(spark, root, "info").limit(1).collect()
    if info and info[0]["type"] == "inpx":
        from folioscope.sources import inpx
        from folioscope.sources.ingest import crawl, files_of

        return inpx.load(spark, info[0]["inpx_path"], files_of(crawl(spark, info[0]["books_dir"]), hashes=False), info[0]["books_dir"])
    return load(spark, root, "books")


def create_views(spark: SparkSession, root: str, prefix: str = "") -> None:
    """Names a collection's tables for SQL: ``books``, ``files``, ``bookmarks``, ``notes``, ``info``, with a prefix if there is one."""
    for name in TABLES:
        (books(spark, root) if name == "books" else load(spark, root, name)).createOrReplaceTempView(f"{prefix}{name}")
