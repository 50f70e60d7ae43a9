"""The catalogue's queries over the test tables, each with its SQL for DuckDB (None where SQL can't say it)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.functions import hashing, paths, text
from folioscope.functions.match import Rule, normalise_needle, prefix_match
from folioscope.operators import catalog, maintain, relocate
from folioscope.operators.search import Author, Genre, Sequence, Title, filter_contains, first_match, placed, search, text_order
from folioscope.plans.tables import FILES_SQL, books, files, people, table
from folioscope.sources import inpx
from folioscope.streaming.refresh import activity

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[name or f.__name__] = f
        if sql:
            SQL[name or f.__name__] = sql
        return f

    return add


# Regular expressions mean the same to Java and RE2.
def _norm(x: str) -> str:
    return f"regexp_replace(regexp_replace({x}, '^[\\x00-\\x20]+|[\\x00-\\x20]+$', '', 'g'), ' {{2,}}', ' ', 'g')"


def _author_norm(x: str) -> str:
    return f"replace({_norm(x)}, '. ', '.')"


def _rule(needle: str, coef: float, source: str, author: bool = False) -> str:
    rule = Rule.of(normalise_needle(needle, author), coef)
    return rule.sql(f"lower({(_author_norm if author else _norm)(source)})") if rule else "false"


# Search ----------------------------------------------------------------------------------------------------------------


def _title_search(name: str, needle: str, coef: float) -> None:
    @query(f"SELECT p_partkey AS id, p_name AS title FROM part WHERE {_rule(needle, coef, 'p_name')}", name)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = books(spark, sf_dir)
        hits = search(rows.withColumn("fbd_path", F.col("id").cast("string")), [Title(needle)], coef)
        return hits.select(F.col("fbd_path").cast("long").alias("id"), F.col("titles")[0].alias("title"))


for _name, _needle, _coef in (
    ("search_title_075", "small widg", 0.75),
    ("search_title_099", "Widget", 0.99),
    ("search_title_050", "ring", 0.5),
    ("search_title_exact_clamped", "red  plate ", 1.0),
    ("search_coef_zero", "hot", 0.0),
):
    _title_search(_name, _needle, _coef)


@query(f"SELECT doc_id FROM documents WHERE {_rule('éonier', 0.75, 'text')}")
def search_title_multibyte(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return d.where(prefix_match(F.lower(text.normalise(F.col("text"))), "éonier", 0.75)).select("doc_id")


_LONG = "and the " + "words that stand nowhere " * 4


@query(f"SELECT doc_id FROM documents WHERE {_rule(_LONG, 0.05, 'text')}")
def search_title_long_needle(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return d.where(prefix_match(F.lower(text.normalise(F.col("text"))), _LONG, 0.05)).select("doc_id")


def _parts(spark: SparkSession, sf_dir: str, requests: list, coef: float) -> DataFrame:
    """Searches the part books and gives their ids, by the number in their paths."""
    hits = search(books(spark, sf_dir), requests, coef)
    return hits.select(F.regexp_extract("file_path", r"(\d+)\.fb2$", 1).cast("long").alias("id"))


@query("SELECT p_partkey AS id FROM part")
def search_all_no_request(spark, sf_dir):
    return _parts(spark, sf_dir, [], 0.75)


@query(f"SELECT p_partkey AS id FROM part WHERE {_rule('old', 0.75, 'p_name')} AND {_rule('promo', 0.75, 'p_type')}")
def search_title_and_genre(spark, sf_dir):
    return _parts(spark, sf_dir, [Title("old"), Genre("promo")], 0.75)


@query(f"SELECT p_partkey AS id FROM part WHERE {_rule('stan', 0.99, 'p_type')}")
def search_genre_prefix(spark, sf_dir):
    return _parts(spark, sf_dir, [Genre("STAN")], 0.99)


@query(f"SELECT p_partkey AS id FROM part WHERE {_rule('brand#1', 0.99, 'p_brand')} AND CAST(p_size AS VARCHAR) = '11'")
def search_series_name_number(spark, sf_dir):
    return _parts(spark, sf_dir, [Sequence("Brand#1", "11")], 0.99)


@query(f"SELECT p_partkey AS id FROM part WHERE {_rule('brand#12 7', 0.9, 'concat(p_brand, chr(32), p_size)')}")
def search_series_freeform(spark, sf_dir):
    null = F.lit(None).cast("string")
    rows = books(spark, sf_dir).withColumn("sequences", F.transform("sequences", lambda s: F.struct(F.concat_ws(" ", s["name"], s["number"]).alias("full"), null.alias("name"), null.alias("number"))))
    return search(rows, [Sequence("Brand#12", "7")], 0.9).select(F.regexp_extract("file_path", r"(\d+)\.fb2$", 1).cast("long").alias("id"))


@query(f"SELECT p_partkey AS id FROM part WHERE lower({_author_norm('p_brand')}) = 'brand#12'")
def search_author_exact_norm(spark, sf_dir):
    return _parts(spark, sf_dir, [Author(full=" BRAND#12 ")], 0.75)


@query(f"SELECT p_partkey AS id FROM part WHERE {_rule('brand#2', 0.99, 'p_brand', author=True)}")
def search_author_freeform(spark, sf_dir):
    return _parts(spark, sf_dir, [Author(last="Brand#2")], 0.99)


@query(f"SELECT c_custkey AS id FROM customer WHERE {_rule('cust', 0.75, 'split_part(c_name, chr(35), 1)')} AND {_rule('00000012', 0.99, 'split_part(c_name, chr(35), 2)')} AND {_rule('build', 0.99, 'c_mktsegment')}")
def search_author_parts(spark, sf_dir):
    hits = search(people(spark, sf_dir), [Author(last="Cust", first="00000012", middle="Build")], 0.99)
    return hits.select(F.regexp_extract("file_path", r"(\d+)$", 1).cast("long").alias("id"))


@query(f"SELECT DISTINCT l_orderkey AS id FROM lineitem JOIN supplier ON l_suppkey = s_suppkey WHERE {_rule('supplier#00000001', 0.99, 's_name')}")
def search_nested_any_author(spark, sf_dir):
    """Files of many books, each by one author: a file is found if any of its books is, so books are tested before they are brought together."""
    null = F.lit(None).cast("string")
    author = F.struct(F.col("s_name").alias("full"), null.alias("last"), null.alias("first"), null.alias("middle"), null.alias("nick"))
    authors = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").cast("string").alias("file_path"), F.array(author).alias("authors"))
    hits = search(authors, [Author(last="Supplier#00000001")], 0.99).select(F.col("file_path").cast("long").alias("l_suppkey"))
    found = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey").join(hits, "l_suppkey", "left_semi")
    return found.select(F.col("l_orderkey").alias("id")).distinct()


@query("SELECT l_orderkey AS id FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY l_orderkey HAVING bool_or(s_suppkey % 7 = 3) AND bool_or(s_suppkey % 5 = 1)")
def search_nested_two_authors(spark, sf_dir):
    """Records of many authors: each request must be met by one of them."""
    l, null = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey"), F.lit(None).cast("string")
    last, first = F.concat(F.lit("seven"), (F.col("l_suppkey") % 7).cast("string")), F.concat(F.lit("five"), (F.col("l_suppkey") % 5).cast("string"))
    author = F.struct(null.alias("full"), last.alias("last"), first.alias("first"), null.alias("middle"), null.alias("nick"))
    nested = l.groupBy(F.col("l_orderkey").cast("string").alias("file_path")).agg(F.collect_set(author).alias("authors"))
    return search(nested, [Author(last="seven3"), Author(first="five1")], 0.99).select(F.col("file_path").cast("long").alias("id"))


# Results ---------------------------------------------------------------------------------------------------------------


@query("SELECT p_partkey AS id, p_name AS title_text FROM part WHERE contains(lower(p_name), 'ate')")
def filter_title_contains(spark, sf_dir):
    return filter_contains(catalog.displayed(books(spark, sf_dir)), "title_text", "ATE").select("id", "title_text")


@query(f"SELECT file_path FROM {FILES_SQL} WHERE contains(lower(file_path), 'src1/1')")
def filter_path_contains(spark, sf_dir):
    return filter_contains(files(spark, sf_dir), "file_path", "SRC1/1").select("file_path")


@query("SELECT DISTINCT p_brand AS author FROM part WHERE contains(lower(p_brand), '#2')")
def filter_author_contains(spark, sf_dir):
    return filter_contains(catalog.list_authors(books(spark, sf_dir)), "author", "#2")


@query(f"SELECT min(a) AS author FROM (SELECT {_author_norm('p_brand')} AS a FROM part UNION ALL SELECT {_author_norm('upper(p_brand)')} FROM part) WHERE a <> '' GROUP BY lower(a)")
def list_authors_distinct(spark, sf_dir):
    rows = books(spark, sf_dir).select("authors")
    upper = rows.select(F.transform("authors", lambda a: a.withField("full", F.upper(a["full"]))).alias("authors"))
    return catalog.list_authors(rows.union(upper))


@query("SELECT count(*) AS n_books FROM part")
def count_books(spark, sf_dir):
    return catalog.count_books(books(spark, sf_dir))


@query("SELECT count(*) AS n_files FROM documents")
def count_files(spark, sf_dir):
    return catalog.count_files(files(spark, sf_dir))


@query("SELECT count(*) AS n_unparsed FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def count_unparsed(spark, sf_dir):
    all_files = files(spark, sf_dir)
    parsed = all_files.join(table(spark, sf_dir, "labels").select("doc_id"), "doc_id", "left_semi")
    return catalog.count_unparsed(all_files, parsed)


@query(f"SELECT file_path, file_hash, file_size FROM {FILES_SQL}")
def files_all(spark, sf_dir):
    return files(spark, sf_dir).select("file_path", "file_hash", "file_size")


@query("SELECT p_partkey AS id, p_name AS title FROM part WHERE concat('/lib/part/', p_partkey, '.fb2') = '/lib/part/17.fb2'")
def books_of_file(spark, sf_dir):
    return catalog.books_of_file(books(spark, sf_dir), "/lib/part/17.fb2").select("id", F.col("titles")[0].alias("title"))


@query("SELECT c_custkey AS id, concat(split_part(c_name, '#', 1), ' ', split_part(c_name, '#', 2), ' ', c_mktsegment) AS author_text FROM customer")
def display_authors(spark, sf_dir):
    rows = people(spark, sf_dir).withColumn("sequences", F.expr("cast(array() as array<struct<full:string,name:string,number:string>>)")).withColumns({"genres": F.expr("cast(array() as array<string>)"), "dates": F.expr("cast(array() as array<string>)")})
    return catalog.displayed(rows).select("id", "author_text")


@query("SELECT p_partkey AS id, concat(p_brand, ' ', p_size) AS series_text FROM part")
def display_series(spark, sf_dir):
    return catalog.displayed(books(spark, sf_dir)).select("id", "series_text")


@query("SELECT l_orderkey AS id, string_agg(DISTINCT l_returnflag, ', ' ORDER BY l_returnflag) AS genre_text FROM lineitem GROUP BY l_orderkey")
def display_genres(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(F.sort_array(F.collect_set("l_returnflag")).alias("genres"))
    return rows.select("id", F.array_join("genres", ", ").alias("genre_text"))


@query("SELECT p_partkey AS id, row_number() OVER (ORDER BY lower(p_type) DESC, p_partkey) AS place FROM part")
def sort_rank_title_inverted(spark, sf_dir):
    """The views' order, in which ascending shows the last first, as places."""
    rows = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), "p_type")
    return placed(rows, text_order("p_type", inverted=True), F.col("id")).select("id", "place")


@query("SELECT p_partkey AS id, row_number() OVER (ORDER BY lower(p_type), p_partkey) AS place FROM part")
def sort_rank_title_reversed(spark, sf_dir):
    """The other direction of that order."""
    rows = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), "p_type")
    return placed(rows, text_order("p_type", descending=True, inverted=True), F.col("id")).select("id", "place")


@query(f"SELECT doc_id, row_number() OVER (ORDER BY lower(file_path) DESC) AS place FROM {FILES_SQL}")
def sort_files_inverted(spark, sf_dir):
    return placed(files(spark, sf_dir).select("doc_id", "file_path"), text_order("file_path", inverted=True)).select("doc_id", "place")


@query(f"SELECT author, row_number() OVER (ORDER BY lower(author) DESC) AS place FROM (SELECT min({_author_norm('c_name')}) AS author FROM customer GROUP BY lower({_author_norm('c_name')}))")
def sort_authors_inverted(spark, sf_dir):
    rows = table(spark, sf_dir, "customer").select(F.expr("array(struct(c_name as full, cast(null as string) as last, cast(null as string) as first, cast(null as string) as middle, cast(null as string) as nick))").alias("authors"))
    return placed(catalog.list_authors(rows), text_order("author", inverted=True))


@query("SELECT p_partkey AS id, p_name AS title FROM part WHERE p_size > 40 ORDER BY p_name, p_partkey LIMIT 1")
def first_match_by_title(spark, sf_dir):
    """The feature is a single row: the first that meets a condition."""
    return first_match(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("title"), "p_size"), F.col("p_size") > 40, "title", "id").select("id", "title")


@query("SELECT o_orderkey AS id, strftime(o_orderdate, '%d.%m.%Y') AS date_text, row_number() OVER (ORDER BY strftime(o_orderdate, '%d.%m.%Y'), o_orderkey) AS place FROM orders")
def sort_date_text(spark, sf_dir):
    """The order by date as text, ``dd.mm.yyyy``: days before months before years."""
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), text.ddmmyyyy(F.col("o_orderdate")).alias("date_text"))
    return placed(rows, text_order("date_text"), F.col("id"))


@query("SELECT doc_id, file_path FROM " + FILES_SQL + " WHERE doc_id IN (SELECT doc_id FROM labels)")
def books_with_notes(spark, sf_dir):
    place = F.expr("cast(null as array<string>)").alias("path_in_file")
    own = files(spark, sf_dir).select("doc_id", "file_path", place)
    notes = files(spark, sf_dir).join(table(spark, sf_dir, "labels").select("doc_id"), "doc_id", "left_semi").select("file_path", place)
    return catalog.with_notes(own, notes).select("doc_id", "file_path")


@query("SELECT user_id, event_type, value FROM events WHERE user_id = 8 AND event_type = 'click'")
def notes_of_book(spark, sf_dir):
    notes = table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("file_path"), F.array("event_type").alias("path_in_file"), "user_id", "event_type", "value")
    return catalog.notes_of(notes, "8", ["click"]).select("user_id", "event_type", "value")


def _genres(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("string").alias("code"), F.col("n_regionkey").cast("string").alias("group"), F.lit("en").alias("lang"), F.when(F.col("n_nationkey") % 5 > 0, F.col("n_name")).alias("translation"))


@query("SELECT c_custkey AS id, coalesce(CASE WHEN n_nationkey % 5 > 0 THEN n_name END, CAST(c_nationkey AS VARCHAR)) AS genre FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey")
def genre_translate(spark, sf_dir):
    rows = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.array(F.col("c_nationkey").cast("string")).alias("genres"))
    return catalog.translate_genres(rows, _genres(spark, sf_dir), "en").select("id", F.col("genre_names")[0].alias("genre"))


@query('SELECT CAST(n_regionkey AS VARCHAR) AS "group", string_agg(CAST(n_nationkey AS VARCHAR), \',\' ORDER BY CAST(n_nationkey AS VARCHAR)) AS codes FROM nation WHERE n_regionkey IN (SELECT r_regionkey FROM region WHERE r_regionkey < 4) GROUP BY 1')
def genre_tree(spark, sf_dir):
    groups = table(spark, sf_dir, "region").where("r_regionkey < 4").select(F.col("r_regionkey").cast("string").alias("group"))
    return catalog.genre_tree(_genres(spark, sf_dir), groups).select("group", F.array_join("codes", ",").alias("codes"))


# Maintenance -----------------------------------------------------------------------------------------------------------


@query(f"SELECT min(file_path) AS file_path, file_hash FROM {FILES_SQL} GROUP BY file_hash")
def dedup_by_hash(spark, sf_dir):
    return maintain.dedup_by_hash(files(spark, sf_dir)).select("file_path", "file_hash")


@query(f"SELECT min(file_path) AS file_path FROM {FILES_SQL} WHERE doc_id % 4 > 0 GROUP BY file_hash UNION ALL SELECT file_path FROM {FILES_SQL} WHERE doc_id % 4 = 0")
def dedup_keep_unhashed(spark, sf_dir):
    rows = files(spark, sf_dir).withColumn("file_hash", F.when(F.col("doc_id") % 4 > 0, F.col("file_hash")))
    return maintain.dedup_by_hash(rows).select("file_path")


@query(f"SELECT DISTINCT root_path FROM {FILES_SQL} WHERE doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1)")
def prune_empty_dirs(spark, sf_dir):
    own = files(spark, sf_dir)
    parsed = own.join(table(spark, sf_dir, "labels").where("toxic = 1"), "doc_id", "left_semi")
    roots, _ = maintain.prune_empty(own.select("root_path").distinct(), own, parsed)
    return roots.select("root_path")


def _snapshots(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Before: without every seventh file. Now: without every fifth, and every third has another content."""
    own = files(spark, sf_dir)
    now = own.where("doc_id % 5 <> 0").withColumns({"file_size": F.col("file_size") + F.when(F.col("doc_id") % 6 == 0, 1).otherwise(0), "file_hash": F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("x"), "file_hash")).otherwise(F.col("file_hash"))})
    return own.where("doc_id % 7 <> 0"), now


def _change_sql(changed: str) -> str:
    return f"SELECT file_path, CASE WHEN doc_id % 7 = 0 THEN 'added' WHEN doc_id % 5 = 0 THEN 'vanished' WHEN {changed} THEN 'changed' ELSE 'same' END AS change FROM {FILES_SQL} WHERE doc_id % 7 <> 0 OR doc_id % 5 <> 0"


@query(_change_sql("doc_id % 3 = 0"))
def refresh_classify_full(spark, sf_dir):
    return maintain.classify_refresh(*_snapshots(spark, sf_dir))


@query(_change_sql("doc_id % 6 = 0"))
def refresh_classify_fast(spark, sf_dir):
    return maintain.classify_refresh(*_snapshots(spark, sf_dir), fast=True)


@query(f"SELECT file_path, CASE WHEN doc_id % 7 = 0 OR doc_id % 3 = 0 THEN 'new' ELSE 'old' END AS origin FROM {FILES_SQL} WHERE doc_id % 5 <> 0")
def refresh_merge(spark, sf_dir):
    old, now = _snapshots(spark, sf_dir)
    changes = maintain.classify_refresh(old, now)
    parsed = maintain.to_parse(changes, now).select("file_path", F.lit("new").alias("origin"))
    return maintain.refresh(old.select("file_path", F.lit("old").alias("origin")), changes, parsed)


@query(f"SELECT min(file_path) AS file_path FROM {FILES_SQL} GROUP BY file_hash")
def add_files_union_dedup(spark, sf_dir):
    own = files(spark, sf_dir)
    return maintain.add_files(own.where("doc_id % 2 = 0"), own.where("doc_id % 3 <> 1 or doc_id % 2 = 1")).select("file_path")


@query("SELECT p_partkey AS id, CASE WHEN p_partkey = 17 THEN 'A New Title' ELSE p_name END AS title FROM part")
def edit_book_entry(spark, sf_dir):
    rows = maintain.edit_book(books(spark, sf_dir), "/lib/part/17.fb2", None, {"titles": maintain.clean_strings(F.array(F.lit(""), F.lit("A New Title")))})
    return rows.select("id", F.col("titles")[0].alias("title"))


@query("SELECT p_partkey AS id FROM part WHERE NOT (p_brand = 'Brand#3' AND p_type = 'PROMO')")
def remove_book_cascade(spark, sf_dir):
    rows = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.lit("/lib/a.zip").alias("file_path"), F.array(F.concat("p_brand", F.lit("-"), "p_type", F.lit(".rar")), F.col("p_name")).alias("path_in_file"))
    return maintain.remove_book(rows, "/lib/a.zip", ["Brand#3-PROMO.rar", "red plate"]).select("id")


def _marks(spark: SparkSession, sf_dir: str, test: str) -> DataFrame:
    return table(spark, sf_dir, "events").where(test).select(F.col("user_id").cast("string").alias("file_path"), F.array("event_type").alias("path_in_file")).distinct()


@query("SELECT DISTINCT CAST(user_id AS VARCHAR) AS file_path, event_type AS place FROM events WHERE event_id % 3 = 0 OR event_type IN ('click', 'error')")
def bookmark_insert_absent(spark, sf_dir):
    out = maintain.add_bookmarks(_marks(spark, sf_dir, "event_id % 3 = 0"), _marks(spark, sf_dir, "event_type in ('click', 'error')"))
    return out.select("file_path", F.col("path_in_file")[0].alias("place"))


@query("SELECT DISTINCT CAST(user_id AS VARCHAR) AS file_path, event_type AS place FROM events WHERE NOT (user_id % 10 = 3 AND event_type = 'click') AND user_id % 10 <> 4")
def bookmark_delete(spark, sf_dir):
    gone = _marks(spark, sf_dir, "user_id % 10 = 3 and event_type = 'click'").union(_marks(spark, sf_dir, "user_id % 10 = 4").select("file_path", F.expr("cast(null as array<string>)")).distinct())
    return maintain.remove_bookmarks(_marks(spark, sf_dir, "true"), gone).select("file_path", F.col("path_in_file")[0].alias("place"))


@query("""
SELECT CAST(doc_id AS VARCHAR) AS file_path, CASE WHEN doc_id % 3 = 0 THEN 'new' ELSE 'old' END AS note_text FROM labels WHERE quality = 1 AND doc_id % 3 <> 1
UNION ALL SELECT CAST(doc_id AS VARCHAR), 'new' FROM labels WHERE quality = 0 AND doc_id % 3 = 0
""")
def note_upsert(spark, sf_dir):
    place = F.expr("cast(null as array<string>)").alias("path_in_file")
    labels = table(spark, sf_dir, "labels")
    notes = labels.where("quality = 1").select(F.col("doc_id").cast("string").alias("file_path"), place, F.lit("old").alias("note_text"))
    changes = labels.where("doc_id % 3 < 2").select(F.col("doc_id").cast("string").alias("file_path"), place, F.when(F.col("doc_id") % 3 == 0, "new").otherwise("").alias("note_text"))
    return maintain.upsert_notes(notes, changes).select("file_path", "note_text")


# Paths -----------------------------------------------------------------------------------------------------------------


@query(f"SELECT doc_id, substring(file_path, 6) AS file_path, 'anchor.txt' AS anchor FROM {FILES_SQL}")
def export_relative(spark, sf_dir):
    return relocate.export_base(files(spark, sf_dir).select("doc_id", "file_path"), "/lib", "anchor.txt")


@query(f"SELECT doc_id, concat('/mnt/books', file_path) AS file_path FROM (SELECT doc_id, substring(file_path, 5) AS file_path FROM {FILES_SQL})")
def import_absolute(spark, sf_dir):
    exported = relocate.export_base(files(spark, sf_dir).select("doc_id", "file_path"), "/lib", "anchor.txt")
    return relocate.import_base(exported, "/mnt/books/", "anchor.txt")


_NAMES = "concat('/x/', replace(p_name, ' ', '.'), CASE p_size % 5 WHEN 0 THEN '.FB2' WHEN 1 THEN '.tar.gz' WHEN 2 THEN '' WHEN 3 THEN '.tar.v2.XZ' ELSE '.epub' END)"


def _named(spark: SparkSession, sf_dir: str) -> DataFrame:
    end = F.expr("case p_size % 5 when 0 then '.FB2' when 1 then '.tar.gz' when 2 then '' when 3 then '.tar.v2.XZ' else '.epub' end")
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.concat(F.lit("/x/"), F.replace("p_name", F.lit(" "), F.lit(".")), end).alias("path"))


@query(f"SELECT p_partkey AS id, regexp_extract(lower(regexp_extract({_NAMES}, '[^/]*$')), '(\\.tar.*)$|(\\.[^.]*)$') AS ext FROM part")
def path_extension(spark, sf_dir):
    return _named(spark, sf_dir).select("id", paths.extension(F.col("path")).alias("ext"))


@query(f"SELECT p_partkey AS id, regexp_replace(regexp_extract({_NAMES}, '[^/]*$'), '\\.[^.]*$', '') AS stem FROM part")
def path_stem(spark, sf_dir):
    return _named(spark, sf_dir).select("id", paths.stem(F.col("path")).alias("stem"))


@query("SELECT p_partkey AS id FROM part WHERE p_size % 5 IN (0, 1, 4)")
def supported_filter(spark, sf_dir):
    return _named(spark, sf_dir).where(paths.supported(F.col("path"))).select("id")


@query("SELECT p_partkey AS id, concat('/lib/', p_brand, '/x.fb2') AS normal, concat('../', p_brand, '/x.fb2') AS beside FROM part")
def paths_lexical(spark, sf_dir):
    """Paths without detours, and relative to a folder beside them."""
    rows = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.concat(F.lit("/lib/./a/..//"), "p_brand", F.lit("/x.fb2")).alias("path"))
    normal = paths.lexically_normal(F.col("path"))
    return rows.select("id", normal.alias("normal"), paths.relative_to(normal, "/lib/other").alias("beside"))


@query("""
SELECT p_partkey AS id, CASE WHEN p_size % 3 = 0 THEN '' ELSE concat(p_brand, '/') END AS authors, CASE WHEN p_size % 4 = 0 THEN '' WHEN p_size % 2 = 0 THEN p_type ELSE concat(p_type, '#', p_size) END AS series,
  p_name AS titles FROM part
""")
def clean_fields(spark, sf_dir):
    """What the editor leaves of a book's fields: authors with a name's part, series with a name, titles with text."""
    null = "cast(null as string)"
    p = table(spark, sf_dir, "part").withColumn("last", F.when(F.col("p_size") % 3 > 0, F.col("p_brand")).otherwise("")).withColumn("name", F.when(F.col("p_size") % 4 > 0, F.col("p_type")))
    authors = F.expr(f"array(struct('x' as full, last, '' as first, {null} as middle, 'n' as nick), struct('whole' as full, '' as last, '' as first, '' as middle, '' as nick))")
    series = F.expr(f"array(struct({null} as full, name, if(p_size % 2 = 0, '', cast(p_size as string)) as number))")
    a, s = maintain.clean_authors(authors), maintain.clean_sequences(series)
    return p.select(
        F.col("p_partkey").alias("id"), F.array_join(F.transform(a, lambda x: F.concat(F.coalesce(x["last"], F.lit("?")), F.lit("/"), F.coalesce(x["first"], x["nick"], F.lit("")))), ",").alias("authors"),
        F.array_join(F.transform(s, lambda x: F.concat_ws("#", x["name"], x["number"])), ",").alias("series"), F.array_join(maintain.clean_strings(F.array(F.lit(""), "p_name", F.lit(None))), ",").alias("titles"),
    )


# Catalogue records -----------------------------------------------------------------------------------------------------


def _inpx(spark: SparkSession, sf_dir: str) -> DataFrame:
    fields = [F.concat("p_brand", F.lit(",B,C,:X,Y:")), F.concat(F.lower("p_type"), F.lit(":tail:lost")), F.when(F.col("p_size") % 9 == 0, "").otherwise(F.col("p_name")), F.col("p_brand"), F.col("p_size").cast("string"), F.col("p_partkey").cast("string"), *[F.lit("-")] * 3, F.lit("fb2"), F.lit("2001-02-03"), F.lit("rest")]
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.concat_ws(inpx.FIELD, *fields).alias("line"))


@query("SELECT p_partkey AS id, p_name AS title, concat(p_partkey, '.fb2') AS place, concat(lower(p_type), ',tail') AS genres, concat(p_brand, '/', p_size) AS series, '2001-02-03' AS date FROM part WHERE p_size % 9 <> 0")
def inpx_parse(spark, sf_dir):
    rows = inpx.parse_lines(_inpx(spark, sf_dir))
    series = F.concat_ws("/", F.col("sequences")[0]["name"], F.col("sequences")[0]["number"])
    return rows.select("id", F.col("titles")[0].alias("title"), F.col("path_in_file")[0].alias("place"), F.array_join("genres", ",").alias("genres"), series.alias("series"), F.col("dates")[0].alias("date"))


@query("SELECT p_partkey AS id, concat(p_brand, '/B/C;X//') AS authors FROM part WHERE p_size % 9 <> 0")
def inpx_authors_split(spark, sf_dir):
    """The last part of an author counts only if a comma ends it."""
    part = lambda a, x: F.coalesce(a[x], F.lit(""))
    rows = inpx.parse_lines(_inpx(spark, sf_dir))
    return rows.select("id", F.array_join(F.transform("authors", lambda a: F.concat_ws("/", part(a, "last"), part(a, "first"), part(a, "middle"))), ";").alias("authors"))


@query("SELECT p_partkey AS id, concat(p_name, '|', p_brand) AS items FROM part")
def legacy_list_split(spark, sf_dir):
    rows = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.concat("p_name", F.lit(",,"), "p_brand", F.lit(","), "p_type").alias("listed"))
    return rows.select("id", F.array_join(text.split_list(F.col("listed"), ","), "|").alias("items"))


# Texts -----------------------------------------------------------------------------------------------------------------


@query("SELECT page_id, md5(regexp_replace(translate(regexp_replace(concat(chr(9), '  a', chr(7), html), '[\\x00-\\x08\\x0B-\\x1F]', '', 'g'), chr(9), ' '), ' {2,}', ' ', 'g')) AS digest FROM pages")
def clean_control_chars(spark, sf_dir):
    raw = F.concat(F.lit("\t  a\x07"), F.col("html"))
    return table(spark, sf_dir, "pages").select("page_id", F.md5(text.strip_escapes(raw)).alias("digest"))


@query("SELECT conv_id, turn, md5(regexp_replace(replace(text, ',', ',   '), ' {2,}', ' ', 'g')) AS digest FROM conversations")
def collapse_spaces(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.md5(text.collapse_spaces(F.replace("text", F.lit(","), F.lit(",   ")))).alias("digest"))


@query(f"SELECT conv_id, turn, md5({_author_norm('concat(chr(10), text, chr(32))')}) AS digest FROM conversations")
def normalise_author(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.md5(text.normalise_author(F.concat(F.lit("\n"), "text", F.lit(" ")))).alias("digest"))


@query("SELECT conv_id, turn, md5(regexp_replace(regexp_replace(regexp_replace(regexp_replace(concat(chr(10), replace(replace(text, ',', '    '), '.', concat(chr(10), chr(10), chr(10), chr(10)))), ' {3,}', '  ', 'g'), '^\\n+', ''), '[\\x00-\\x20]+$', ''), '\\n{3,}', concat(chr(10), chr(10)), 'g')) AS digest FROM conversations")
def final_cleaning(spark, sf_dir):
    raw = F.concat(F.lit("\n"), F.replace(F.replace("text", F.lit(","), F.lit("    ")), F.lit("."), F.lit("\n\n\n\n")))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.md5(text.final_cleaning(raw)).alias("digest"))


_ESCAPED = "replace(replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '''', '&apos;'), '\"', '&quot;')"


@query(f"SELECT page_id, md5({_ESCAPED}) AS digest, CAST(length({_ESCAPED}) AS BIGINT) AS n FROM pages")
def xml_escape(spark, sf_dir):
    escaped = text.xml_escape(F.col("html"))
    return table(spark, sf_dir, "pages").select("page_id", F.md5(escaped).alias("digest"), F.length(escaped).cast("long").alias("n"))


_PAGE = "concat('&amp;lt; &apos;', html)"
_UNESCAPED = "replace(replace(replace(replace(replace({0}, '&quot;', '\"'), '&apos;', ''''), '&gt;', '>'), '&lt;', '<'), '&amp;', '&')"


@query(f"SELECT page_id, md5({_UNESCAPED.format(_PAGE)}) AS digest FROM pages")
def xml_entities(spark, sf_dir):
    """The pages' own entities."""
    return table(spark, sf_dir, "pages").select("page_id", F.md5(text.xml_unescape(F.concat(F.lit("&amp;lt; &apos;"), "html"))).alias("digest"))


@query("SELECT p_partkey AS id, concat(p_name, '<&#0;', p_brand) AS plain FROM part")
def xml_numeric_entities(spark, sf_dir):
    """Decimal and hexadecimal numbers, named entities, and a number that is no character."""
    first, brand = F.ascii("p_name").cast("string"), F.lower(F.hex(F.ascii("p_brand")))
    raw = F.concat(F.lit("&#"), first, F.lit(";"), F.expr("substring(p_name, 2)"), F.lit("&lt;&#0;&#x"), brand, F.lit(";"), F.expr("substring(p_brand, 2)"))
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), text.xml_unescape_all(raw).alias("plain"))


@query("SELECT conv_id, turn, md5(replace(replace(text, 'e', '3'), '33', '..')) AS digest FROM conversations")
def symbol_replacement(spark, sf_dir):
    """A table of symbols, in its order: the second entry sees what the first has made."""
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.md5(text.replace_symbols(F.col("text"), [("3", "e"), ("x", ""), ("..", "33")])).alias("digest"))


@query("SELECT page_id, regexp_extract(html, 'lang[^\"]*\"([^\"]*)\"', 1) AS lang FROM pages")
def quoted_value_after_tag(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", text.quoted_value(F.col("html"), "lang").alias("lang"))


@query("SELECT conv_id, turn, md5(concat(text, '<raw> & ', text, ' 1 < 2 ')) AS digest FROM conversations")
def strip_tags(spark, sf_dir):
    """Texts put into markup, and taken out again: entities, character data, comments, attributes, a sign that is no tag."""
    own = text.xml_escape(F.col("text"))
    raw = F.concat(F.lit("<?xml v?><p a='1'>"), own, F.lit("</p><!-- <b>no</b> --><![CDATA[<raw> & ]]><x:y/>"), own, F.lit(" 1 < 2 "))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.md5(text.strip_tags(raw)).alias("digest"))


@query("SELECT conv_id, turn, md5(concat('<b>', replace(text, '<', '&lt;'), '</b><br><br><a href=\"x\">', turn, '</a>kept<br>')) AS digest FROM conversations")
def replace_tags(spark, sf_dir):
    """The default table: replaced tags, tags that stay, tags that go."""
    own, turn = F.replace("text", F.lit("<"), F.lit("&lt;")), F.col("turn").cast("string")
    raw = F.concat(F.lit("<strong>"), own, F.lit('</strong></p><a href="x">'), turn, F.lit("</a><section id='1'>kept</section><!-- gone --><empty-line/>"))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.md5(text.replace_tags(raw)).alias("digest"))


@query("SELECT doc_id, sha256(text) AS digest FROM documents")
def file_hash_sha(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", hashing.sha256_hex(F.col("text")).alias("digest"))


@query()
def file_hash_blake2b(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.lower(F.hex(hashing.blake2b_256(F.encode("text", "UTF-8")))).alias("digest"))


@query()
def crc32_name(spark, sf_dir):
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), hashing.crc32(F.col("p_name")).alias("crc"))


@query("SELECT o_orderkey AS id, strftime(o_orderdate, '%d.%m.%Y') AS date_text FROM orders")
def date_ddmmyyyy(spark, sf_dir):
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), text.ddmmyyyy(F.col("o_orderdate")).alias("date_text"))


@query("SELECT p_partkey AS id, CASE WHEN p_size % 2 = 0 THEN p_name ELSE CAST(p_partkey AS VARCHAR) END AS title FROM part")
def title_date_default(spark, sf_dir):
    title = F.when(F.col("p_size") % 4 == 1, "").when(F.col("p_size") % 2 == 0, F.col("p_name"))
    path = F.concat(F.lit("/lib/"), F.col("p_partkey").cast("string"), F.lit(".fb2"))
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), text.default_to(title, paths.stem(path)).alias("title"))


@query("SELECT time_bucket(INTERVAL '1 hour', ts) AS window_start, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def activity_windows(spark, sf_dir):
    """An extension: the reference has no windows."""
    return activity(table(spark, sf_dir, "events"))


def queries() -> dict[str, Query]:
    from folioscope.plans import index_queries, ingest_queries  # noqa: F401  their queries register themselves

    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    queries()
    return dict(SQL)
