"""Queries over indexes, change logs, trees and other things that a collection keeps on disk."""

from __future__ import annotations

import uuid
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.functions import hashing
from folioscope.operators import control, maintain, table_function, tree, views, word_index
from folioscope.operators.search import Title, placed, search, text_order
from folioscope.plans.queries import _norm, _rule, query
from folioscope.plans.tables import FILES_SQL, books, files, people, scratch, table
from folioscope.sources import bucketed, changelog, ingest, inpx, links, seen, store
from folioscope.sources.archive_write import pack
from folioscope.streaming import changes

# Search by an index ----------------------------------------------------------------------------------------------------


def _fits(source: str) -> str:
    """The word-prefix rule for the columns needle, n, t and tail of a table of needles."""
    size, place = f"octet_length(encode({source}))", f"strpos(substring({source}, 2), concat(' ', t))"
    octets = f"octet_length(encode(substring({source}, 1, CAST({place} AS BIGINT))))"
    return f"({size} >= n AND ((starts_with({source}, t) AND {size} > tail) OR ({place} > 0 AND {octets} < {size} - tail)))"


def _needles(source: str, coef: float) -> str:
    """Needles of ASCII letters with the rule's constants; weights are added up one by one."""
    weight = "list_reduce(list_transform(range(0, k), lambda i: CAST(1 AS DOUBLE) / n), lambda a, b: a + b)"
    return f"(SELECT *, substring(needle, 1, list_filter(range(1, n + 1), lambda k: {weight} >= {coef})[1]) AS t, CAST(floor(n * (1 - CAST({coef} AS DOUBLE))) AS BIGINT) AS tail FROM (SELECT needle, length(needle) AS n FROM {source}))"


def _requests(spark: SparkSession, rows: DataFrame, **fields) -> DataFrame:
    """A table of requests of which the given columns are set."""
    names = {x.split()[0]: x.split()[1] for x in word_index.REQUESTS.split(", ")}
    return rows.select(*[fields.get(k, F.lit("")).cast(v).alias(k) for k, v in names.items()])


_WORDS = "SELECT DISTINCT needle FROM (SELECT unnest(string_split(lower(text), ' ')) AS needle FROM benchmark) WHERE regexp_full_match(needle, '[a-z]{6,}')"


@query(f"SELECT r.needle AS request, d.doc_id FROM {_needles(f'({_WORDS})', 0.75)} r JOIN (SELECT doc_id, lower({_norm('substring(text, 1, 200)')}) AS title FROM documents) d ON {_fits('d.title')}")
def search_batch_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every longer word of the benchmark, looked for in the titles of all documents (the first 200 characters of their texts) by an index of their words."""
    null = F.expr("cast(array() as array<string>)")
    own = books(spark, sf_dir)
    titles = table(spark, sf_dir, "documents").select("doc_id", F.array(F.substring("text", 1, 200)).alias("titles"), null.alias("genres"), F.expr("array()").cast(own.schema["authors"].dataType).alias("authors"), F.expr("array()").cast(own.schema["sequences"].dataType).alias("sequences"))
    path = f"{scratch(spark)}/words"
    word_index.build(spark, titles, path)
    words = table(spark, sf_dir, "benchmark").select(F.explode(F.split(F.lower("text"), " ")).alias("needle")).where(F.regexp_like("needle", F.lit("^[a-z]{6,}$"))).distinct()
    asked = _requests(spark, words, request=F.col("needle"), kind=F.lit("title"), text=F.col("needle"), coef=F.lit(0.75))
    return word_index.search_batch(spark, path, asked).select("request", "doc_id")


@query("SELECT CAST(o_custkey AS VARCHAR) AS request, c_custkey AS id FROM (SELECT DISTINCT o_custkey, lpad(CAST(o_custkey AS VARCHAR), 9, '0') AS digits FROM orders) JOIN customer ON split_part(c_name, '#', 2) = digits AND c_mktsegment LIKE 'BU%'")
def search_batch_authors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For every customer of an order a request of two tests: an author of two parts, and a title; answered by one pass over the index's parts that they name."""
    own = people(spark, sf_dir).withColumns({"genres": F.array(F.lit("x")), "sequences": F.expr("array()").cast("array<struct<full:string,name:string,number:string>>")})
    path = f"{scratch(spark)}/words"
    word_index.build(spark, own, path, part_rows=1 << 16)
    digits = F.lpad(F.col("o_custkey").cast("string"), 9, "0")
    keys = table(spark, sf_dir, "orders").select("o_custkey").distinct()
    request = F.col("o_custkey").cast("string")
    authors = _requests(spark, keys, request=request, kind=F.lit("author"), first=digits, middle=F.lit("BU"), coef=F.lit(0.99))
    titles = _requests(spark, keys, request=request, kind=F.lit("title"), text=F.concat(F.lit("customer#"), digits), coef=F.lit(0.5))
    return word_index.search_batch(spark, path, authors.union(titles)).select("request", F.col("id"))


# Change logs -----------------------------------------------------------------------------------------------------------


@query("""
SELECT p_partkey AS id, CASE WHEN p_partkey = 17 AND p_size % 10 NOT IN (3, 4) THEN 'A New Title' WHEN p_size % 10 = 3 AND p_partkey % 2 = 0 THEN concat(upper(p_name), ' twice')
  WHEN p_size % 10 = 3 THEN upper(p_name) WHEN p_size % 10 = 4 THEN 'again' ELSE p_name END AS title
FROM part WHERE p_size % 10 <> 4 OR p_size % 20 = 4
""")
def change_log_books(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edits, removals and returns of books as numbered changes beside the stored table, before and after the log is put into it."""
    path, own = f"{scratch(spark)}/books", books(spark, sf_dir)
    changelog.create(spark, path, own)
    number = F.element_at(F.col("sequences"), 1)["number"].cast("int")
    upper = lambda rows: rows.withColumn("titles", F.transform("titles", lambda t: F.upper(t)))
    changelog.edit_book(spark, path, "/lib/part/17.fb2", None, {"titles": F.array(F.lit("A New Title"))})
    changelog.change(spark, path, upper, keys=own.where(number % 10 == 3))
    changelog.change(spark, path, lambda rows: rows.where("false"), keys=own.where(number % 10 == 4))
    changelog.compact(spark, path)
    back = own.where(number % 20 == 4).withColumn("titles", F.array(F.lit("again")))
    changelog.change(spark, path, lambda rows: rows.unionByName(back), keys=back)
    twice = lambda rows: rows.withColumn("titles", F.transform("titles", lambda t: F.concat(t, F.lit(" twice"))))
    changelog.change(spark, path, twice, keys=own.where((number % 10 == 3) & (F.col("id") % 2 == 0)))
    return changelog.read(spark, path).select("id", F.col("titles")[0].alias("title"))


@query("""
SELECT CAST(doc_id AS VARCHAR) AS file_path, CASE WHEN doc_id % 3 = 0 THEN 'new' ELSE 'old' END AS note_text FROM labels WHERE quality = 1 AND doc_id % 3 <> 1 AND toxic = 0
UNION ALL SELECT CAST(doc_id AS VARCHAR), 'new' FROM labels WHERE quality = 0 AND doc_id % 3 = 0 AND toxic = 0
""")
def change_log_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Notes that come, change and go as changes; then those of some books are removed."""
    place = F.expr("cast(null as array<string>)").alias("path_in_file")
    labels, path = table(spark, sf_dir, "labels"), f"{scratch(spark)}/notes"
    key = F.col("doc_id").cast("string").alias("file_path")
    changelog.create(spark, path, labels.where("quality = 1").select(key, place, F.lit("old").alias("note_text")))
    changelog.upsert_notes(spark, path, labels.where("doc_id % 3 < 2").select(key, place, F.when(F.col("doc_id") % 3 == 0, "new").otherwise("").alias("note_text")))
    changelog.remove_notes(spark, path, labels.where("toxic = 1").select(key, place))
    return changelog.read(spark, path).select("file_path", "note_text")


@query("SELECT DISTINCT CAST(user_id AS VARCHAR) AS file_path, event_type AS place FROM events WHERE (event_id % 3 = 0 OR event_type IN ('click', 'error')) AND user_id % 10 <> 4")
def change_log_bookmarks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bookmarks: those that aren't there come, then all of some files go."""
    events, path = table(spark, sf_dir, "events"), f"{scratch(spark)}/bookmarks"
    marks = lambda test: events.where(test).select(F.col("user_id").cast("string").alias("file_path"), F.array("event_type").alias("path_in_file")).distinct()
    changelog.create(spark, path, marks("event_id % 3 = 0"))
    changelog.add_bookmarks(spark, path, marks("event_type in ('click', 'error')"))
    changelog.remove_bookmarks(spark, path, marks("user_id % 10 = 4").select("file_path", F.expr("cast(null as array<string>)").alias("path_in_file")).distinct())
    return changelog.read(spark, path).select("file_path", F.col("path_in_file")[0].alias("place"))


# Trees and crawls ------------------------------------------------------------------------------------------------------

_PARENT = "CASE WHEN p_partkey % 97 > 0 THEN p_partkey - 1 WHEN p_partkey // 97 % 5 = 3 THEN p_partkey + 10 WHEN p_partkey // 97 % 5 = 4 THEN -1 END"


@query(
    tree.flatten_sql(
        f"(SELECT CAST(p_partkey AS VARCHAR) AS id, CAST({_PARENT} AS VARCHAR) AS parent, CASE WHEN p_partkey % 97 = 0 THEN 'dir' WHEN p_size % 7 = 0 THEN 'symlink' ELSE 'dir' END AS kind, p_brand AS name FROM part "
        "UNION ALL SELECT concat('f', p_partkey), CAST(p_partkey AS VARCHAR), 'file', p_name FROM part)"
    )
)
def tree_flatten(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chains of up to 97 directories and links with a file in each; some end in a cycle, some at a directory that isn't there."""
    p = table(spark, sf_dir, "part")
    parent = F.expr(_PARENT.replace("//", "div")).cast("string")
    kind = F.when(F.col("p_partkey") % 97 == 0, "dir").when(F.col("p_size") % 7 == 0, "symlink").otherwise("dir")
    own = F.col("p_partkey").cast("string")
    folders = p.select(own.alias("id"), parent.alias("parent"), kind.alias("kind"), F.col("p_brand").alias("name"))
    files = p.select(F.concat(F.lit("f"), own).alias("id"), own.alias("parent"), F.lit("file").alias("kind"), F.col("p_name").alias("name"))
    return tree.flatten(folders.union(files))


@query("""
SELECT concat('d', s, '/', doc_id, '.txt') AS file, CASE WHEN k = 1 THEN concat('d', s, '/', doc_id, '.link.txt') END AS link, 'dir' AS root_kind
FROM (SELECT doc_id, doc_id % 7 AS s, unnest(CASE WHEN doc_id % 10 = 0 THEN [0, 1] ELSE [0] END) AS k FROM documents)
""")
def crawl_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Folders of files with links to files, a link in each folder back to the first one, and a broken one: every file by itself and by its links, each folder once."""
    root = scratch(spark).removeprefix("file:")
    root = "/" + root.lstrip("/")

    def over(batches):
        import os

        for batch in batches:
            for doc_id in batch.column(0).to_pylist():
                folder = f"{root}/d{doc_id % 7}"
                os.makedirs(folder, exist_ok=True)
                with open(f"{folder}/{doc_id}.txt", "w") as f:
                    f.write("x")
                for name, target in [("back", root), ("broken.txt", f"{root}/none.txt")] + ([(f"{doc_id}.link.txt", f"{folder}/{doc_id}.txt")] if doc_id % 10 == 0 else []):
                    if not os.path.lexists(f"{folder}/{name}"):
                        try:
                            os.symlink(target, f"{folder}/{name}")
                        except FileExistsError:  # another task was first
                            pass
            yield batch

    table(spark, sf_dir, "documents").select("doc_id").mapInArrow(over, "doc_id long").count()
    rows = links.crawl_links(spark, root)
    inner = lambda c: F.regexp_extract(c, r"(d\d/[^/]*)$", 1)
    return rows.select(inner("file_path").alias("file"), F.when(F.col("link_path").isNotNull(), inner("link_path")).alias("link"), "root_kind")


# Streams and buckets ---------------------------------------------------------------------------------------------------


@query(f"""
SELECT file_path, CASE WHEN doc_id % 5 = 0 THEN 'vanished' WHEN doc_id % 7 = 0 THEN 'added' ELSE 'changed' END AS change
FROM {FILES_SQL} WHERE CASE WHEN doc_id % 5 = 0 THEN doc_id % 7 <> 0 WHEN doc_id % 7 = 0 THEN true ELSE doc_id % 3 = 0 END
""")
def refresh_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two looks at a directory as a stream, the second after a restart from the checkpoint: what the second one found changed."""
    base, own = scratch(spark), files(spark, sf_dir)
    old = own.where("doc_id % 7 <> 0")
    now = own.where("doc_id % 5 <> 0").withColumn("file_hash", F.when((F.col("doc_id") % 3 == 0) & (F.col("doc_id") % 7 != 0), "other").otherwise(F.col("file_hash")))
    for k, look in enumerate((old, now)):
        changes.add_scan(look.withColumn("file_hash", F.encode("file_hash", "UTF-8")), f"{base}/scans", datetime(2024, 1, 1 + k, tzinfo=timezone.utc))
        changes.record(changes.changes(changes.scans(spark, f"{base}/scans")), f"{base}/changes/look={k}", f"{base}/checkpoint").awaitTermination()
    return spark.read.schema("file_path string, change string, look int").parquet(f"{base}/changes").where("look = 1").select("file_path", "change")


@query(f"""
SELECT coalesce(a.file_path, b.file_path) AS file_path, CASE WHEN a.file_path IS NULL THEN 'added' WHEN b.file_path IS NULL THEN 'vanished' WHEN b.doc_id % 3 = 0 THEN 'changed' ELSE 'same' END AS change
FROM (SELECT * FROM {FILES_SQL} WHERE doc_id % 7 <> 0) a FULL JOIN (SELECT * FROM {FILES_SQL} WHERE doc_id % 5 <> 0) b ON a.file_path = b.file_path
""")
def refresh_bucketed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A refresh of tables that were dealt out by path when they were written: their join moves nothing."""
    base, own = scratch(spark), files(spark, sf_dir)
    buckets = max(8, int(spark.conf.get("spark.sql.shuffle.partitions")))
    bucketed.save(spark, own.where("doc_id % 7 <> 0"), f"{base}/old", buckets)
    bucketed.save(spark, own.where("doc_id % 5 <> 0").withColumn("file_hash", F.when(F.col("doc_id") % 3 == 0, "other").otherwise(F.col("file_hash"))), f"{base}/now", buckets)
    return maintain.classify_refresh(bucketed.load(spark, f"{base}/old"), bucketed.load(spark, f"{base}/now"))


@query("SELECT p_partkey AS id FROM part WHERE p_partkey IN (SELECT doc_id FROM labels WHERE toxic = 0) AND p_size % 2 = 0")
def notes_bucketed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Books with a note, from tables dealt out by path; notes of other places in a file don't count."""
    base = scratch(spark)
    place = F.array(F.when(F.col("p_size") % 2 == 0, "a").otherwise("b"))
    shelf = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_partkey").cast("string").alias("file_path"), place.alias("path_in_file"))
    notes = table(spark, sf_dir, "labels").where("toxic = 0").select(F.col("doc_id").cast("string").alias("file_path"), F.array(F.lit("a")).alias("path_in_file"), F.lit("n").alias("note_text"))
    bucketed.save(spark, shelf, f"{base}/books", 8)
    bucketed.save(spark, notes, f"{base}/notes", 8)
    return bucketed.with_notes(bucketed.load(spark, f"{base}/books"), bucketed.load(spark, f"{base}/notes")).select("id")


# Views -----------------------------------------------------------------------------------------------------------------


@query("SELECT * FROM (SELECT o_orderkey AS id, o_orderpriority AS priority, row_number() OVER (ORDER BY lower(o_orderpriority) DESC, o_orderkey) AS place FROM orders) WHERE place BETWEEN 4001 AND 7500 OR place <= 10")
def view_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages of a stored order of all orders by a column of few values: each reads the parts that hold it."""
    path = f"{scratch(spark)}/view"
    views.build(spark, table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("priority")), path, F.lower("priority").desc(), F.col("id"), part_rows=2000)
    return views.page(spark, path, 1, 10).unionByName(views.page(spark, path, 4001, 3500))


@query("SELECT doc_id FROM documents WHERE contains(lower(substring(text, 1, 300)), 'the r') UNION ALL SELECT doc_id FROM documents WHERE contains(lower(substring(text, 1, 300)), 'éon')")
def view_containing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A filter by a part of a text over a stored view: bitmaps of three letters say which parts of it are read."""
    path = f"{scratch(spark)}/view"
    views.build(spark, table(spark, sf_dir, "documents").select("doc_id", F.substring("text", 1, 300).alias("head")), path, F.col("doc_id"), texts=("head",), part_rows=500)
    return views.containing(spark, path, "head", "The R").select("doc_id").unionAll(views.containing(spark, path, "head", "ÉON").select("doc_id"))


# What a collection is told, and tells -----------------------------------------------------------------------------------


def _written(rows: DataFrame, root: str, make) -> None:
    """Writes a file for each row below a mounted folder: (relative path, bytes) by ``make`` of the row's values."""

    def over(batches):
        import os

        for batch in batches:
            for values in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                name, data = make(*values)
                os.makedirs(os.path.dirname(f"{root}/{name}"), exist_ok=True)
                with open(f"{root}/{name}", "wb") as f:
                    f.write(data)
            yield batch.select([0])

    rows.mapInArrow(over, rows.select(rows.columns[0]).schema).count()


def _mounted(spark: SparkSession) -> str:
    return "/" + scratch(spark).removeprefix("file:").lstrip("/")


@query("SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'kept' ELSE 'read' END AS origin FROM documents")
def hash_reuse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hashes known by path are kept for files that haven't been modified; the others are read. The known ones are marked, so the result says which was which."""
    root = _mounted(spark)
    _written(table(spark, sf_dir, "documents").select("doc_id"), root, lambda i: (f"{i}.txt", f"text {i}".encode()))
    crawled = ingest.listed(spark, root)
    number = F.regexp_extract("file_path", r"(\d+)\.txt$", 1).cast("long")
    known = ingest.files_of(crawled, hashes=False).where(number % 2 == 0).withColumn("file_hash", F.encode(F.lit("known"), "UTF-8"))
    rows = ingest.rehash(known, datetime(2100, 1, 1), root)
    fresh = hashing.blake2b_256(F.encode(F.concat(F.lit("text "), number.cast("string")), "UTF-8"))
    return rows.select(number.alias("doc_id"), F.when(F.col("file_hash") == F.encode(F.lit("known"), "UTF-8"), "kept").when(F.col("file_hash") == fresh, "read").otherwise("wrong").alias("origin"))


#: Keys of the parts that five archives and a catalogue file share: there are more of them in a larger table, none is larger.
SHELVED = 100_000


def _catalogue(spark: SparkSession, sf_dir: str) -> tuple[str, str]:
    """A folder of INPX files with a list for each of five archives of part books, and the folder of the archives."""
    root = _mounted(spark)
    block, key = F.floor(F.col("p_partkey") / SHELVED).cast("string"), F.col("p_partkey").cast("string")
    shelf = F.concat(block, F.lit("-"), (F.col("p_partkey") % 5).cast("string"))
    shelves = table(spark, sf_dir, "part").select(shelf.alias("shelf"), F.concat(key, F.lit("|"), F.col("p_name")).alias("book")).groupBy("shelf").agg(F.sort_array(F.collect_list("book")).alias("books"))

    def archive(shelf: str, own: list[str]) -> tuple[str, bytes]:
        return f"books/shelf{shelf}.zip", pack(".zip", {f"{x.split('|')[0]}.txt": b"text" for x in own})

    def lists(block: str, own: list) -> tuple[str, bytes]:
        line = lambda x: inpx.FIELD.join(["Pen,Ann,:", "sf:", x.split("|")[1], "", "", x.split("|")[0], "", "", "", "txt", "", ""])
        return f"lists/list{block}.inpx", pack(".zip", {f"shelf{x['shelf']}.inp": "".join(f"{line(b)}\r\n" for b in x["books"]).encode() for x in own})

    _written(shelves, root, archive)
    _written(shelves.groupBy(F.substring_index("shelf", "-", 1).alias("block")).agg(F.collect_list(F.struct("shelf", "books")).alias("own")), root, lists)
    return f"{root}/lists", f"{root}/books"


@query("SELECT p_partkey AS id, p_name AS title FROM part")
def inpx_collection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A collection that stores only where its catalogue and its books are; every list of the catalogue is a task."""
    lists, folder = _catalogue(spark, sf_dir)
    root = f"{scratch(spark)}/store"
    store.save_inpx(spark, root, lists, folder)
    return store.books(spark, root).select(F.regexp_extract(F.col("path_in_file")[0], r"^(\d+)", 1).cast("long").alias("id"), F.col("titles")[0].alias("title"))


@query("SELECT p_partkey AS id, CAST(p_partkey AS VARCHAR) AS title, 'native' AS type FROM part")
def inpx_rebuilt(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A refresh of such a collection builds it anew from its files, as a native one: titles come from the files now."""
    lists, folder = _catalogue(spark, sf_dir)
    root = f"{scratch(spark)}/store"
    store.save_inpx(spark, root, lists, folder)
    store.refresh(spark, root)
    kind = store.load(spark, root, "info").first()["type"]
    return store.books(spark, root).select(F.regexp_extract(F.col("path_in_file")[0], r"^(\d+)", 1).cast("long").alias("id"), F.col("titles")[0].alias("title"), F.lit(kind).alias("type"))


@query("SELECT p_partkey AS id, row_number() OVER (ORDER BY lower(p_name), p_partkey) AS place FROM part")
def sort_title_locale(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Titles in the order of a locale's collation; for plain letters it is that of the bytes."""
    rows = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.upper("p_name").alias("title"))
    return placed(rows, text_order("title", locale="UNICODE"), F.col("id")).select("id", "place")


@query("SELECT p_partkey AS id, p_name AS title FROM part WHERE " + _rule("small widg", 0.75, "p_name"))
def search_table_function(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The search from SQL, as a function of any table."""
    table_function.register(spark)
    books(spark, sf_dir).createOrReplaceTempView("fs_part_books")
    return spark.sql("SELECT id, titles[0] AS title FROM search_books(TABLE(fs_part_books), 'titles', 'small widg', 0.75)")


@query("SELECT count(*) AS processed, count(*) AS total, CAST(1 AS DOUBLE) AS ratio FROM documents")
def progress_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ratio of an operation at its end: rows that went through a place of its plan, of all there are."""
    rows = files(spark, sf_dir)
    total = rows.count()
    hashed, seen = control.counted(rows, "hashing")
    hashed.write.parquet(f"{scratch(spark)}/files")
    done = seen.get["processed"]
    return spark.createDataFrame([(done, total, done / total if total else 1.0)], "processed long, total long, ratio double")


@query("SELECT p_partkey AS id FROM part WHERE false")
def search_cancelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A search that is stopped from elsewhere gives nothing."""
    import threading

    rows = search(books(spark, sf_dir), [Title("ring")], 0.5).join(table(spark, sf_dir, "lineitem").select("l_orderkey"), F.expr("substring(file_path, 11, 1) = substring(cast(l_orderkey as string), 1, 1)"))
    tag = f"folioscope-{uuid.uuid4().hex}"
    over = threading.Event()

    def stop() -> None:
        while not over.wait(0.05):
            control.stop(spark, tag)

    other = threading.Thread(target=stop, daemon=True)
    other.start()
    try:
        found = control.run_stoppable(spark, tag, lambda: rows.select(F.sha2("file_path", 512).alias("h")).distinct().sort("h").collect())
    finally:
        over.set()
        other.join()
    return spark.createDataFrame([(0,) for _ in found], "id long")


@query(f"SELECT min(file_path) AS file_path FROM {FILES_SQL} WHERE doc_id % 3 <> 0 AND file_hash NOT IN (SELECT file_hash FROM {FILES_SQL} WHERE doc_id % 3 = 0) GROUP BY file_hash")
def additions_by_stored_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files that a collection takes: bit tables rule out most that are new, so few are looked for among the stored hashes."""
    path, own = f"{scratch(spark)}/hashes", files(spark, sf_dir).withColumn("file_hash", F.unhex("file_hash"))
    seen.build(spark, own.where("doc_id % 3 = 0"), path)
    return seen.additions(spark, own.where("doc_id % 3 <> 0").select("file_path", "file_hash"), path).select("file_path")
