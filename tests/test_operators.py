import pytest
from pyspark.sql import functions as F

from folioscope.functions.text import full_name  # noqa: F401
from folioscope.operators import catalog, maintain, relocate
from folioscope.operators.search import Author, Genre, Sequence, Title, first_match, order_by_text, search
from folioscope.schema import BOOKS, NOTES, author, sequence
from folioscope.sources import store


def book(path, place=None, authors=(), titles=(), sequences=(), genres=(), dates=()):
    return (path, place, None, [tuple(a.values()) for a in authors], list(titles), [tuple(s.values()) for s in sequences], list(genres), list(dates))


@pytest.fixture(scope="module")
def books(spark):
    rows = [
        book("/a.fb2", None, [author(last="Smith", first="J. R.", middle=""), author(nick="Owl")], ["War and  Peace"], [sequence(name="Big Books", number="VII")], ["prose_classic"], ["01.02.1990"]),
        book("/b.zip", ["x.fb2"], [author(full="smith, john")], ["Peaceful days", "Other"], [sequence(full="Big Books 7")], ["sf"]),
        book("/b.zip", ["in.rar", "y.fb2"], [author(full="Smith John")], ["Warm"], [], []),
        book("/c.txt", None, [], [], [], []),
    ]
    return spark.createDataFrame(rows, BOOKS)


def found(books, *requests, coef=0.99):
    return sorted(r["titles"][0] if r["titles"] else "" for r in search(books, list(requests), coef).collect())


def test_search(books):
    assert len(found(books)) == 4
    assert found(books, Title("peace")) == ["Peaceful days", "War and  Peace"]
    assert found(books, Title("peacock"), coef=0.5) == ["Peaceful days", "War and  Peace"] and found(books, Title("")) == []
    assert found(books, Genre("prose")) == ["War and  Peace"]
    assert found(books, Sequence("big", "vii")) == [] and found(books, Sequence("big")) == ["Peaceful days", "War and  Peace"]
    assert found(books, Sequence("big books", "7")) == ["Peaceful days"]
    assert found(books, Author(full="Smith J. R.")) == ["War and  Peace"]
    assert found(books, Author(last="smith", first="j")) == ["War and  Peace", "Warm"]
    assert found(books, Author(last="smith", nick="owl")) == []  # not on the same author
    assert found(books, Author(last="smith")) == ["Peaceful days", "War and  Peace", "Warm"]
    assert found(books, object(), Title("warm")) == ["Warm"]


def test_lists_and_displays(books, spark):
    assert [r[0] for r in catalog.list_authors(books).collect()] == ["Owl", "Smith J.R.", "Smith John", "smith, john"]
    d = catalog.displayed(books).orderBy("file_path", F.size("path_in_file")).collect()
    assert d[0]["author_text"] == "Smith J. R., Owl" and d[0]["series_text"] == "Big Books VII" and d[3]["title_text"] == ""
    assert catalog.count_books(books).first()[0] == 4
    assert [r["file_path"] for r in order_by_text(books.select("file_path").distinct(), "file_path", inverted=True).collect()] == ["/c.txt", "/b.zip", "/a.fb2"]
    assert first_match(books, F.col("file_path") > "/a.z", "file_path").first()["file_path"] == "/b.zip"
    with pytest.raises(ValueError, match="information"):
        catalog.require_info(spark.createDataFrame([], "type string"))


def test_notes(books, spark):
    notes = spark.createDataFrame([("/b.zip", ["x.fb2"], "n1", "t"), ("/a.fb2", ["deep"], "n2", "t"), ("/b.zip", ["x.fb2"], "n3", "t")], NOTES)
    assert sorted(r["titles"][0] for r in catalog.with_notes(books, notes).collect()) == ["Peaceful days", "War and  Peace"]
    assert catalog.notes_of(notes, "/b.zip", ["x.fb2"]).count() == 2 and catalog.notes_of(notes, "/b.zip", ["z"]).count() == 0


def test_genres(spark, books):
    dim = spark.createDataFrame([("sf", "fiction", "en", "Science"), ("prose_classic", "prose", "en", "")], "code string, group string, lang string, translation string")
    got = {r["file_path"] + str(r["path_in_file"]): r["genre_names"] for r in catalog.translate_genres(books, dim, "en").collect()}
    assert got["/a.fb2None"] == ["prose_classic"] and got["/b.zip['x.fb2']"] == ["Science"] and got["/c.txtNone"] == []
    catalog_rows, catalog.DICTIONARY_ROWS = catalog.DICTIONARY_ROWS, 0
    try:
        slow = {r["file_path"] + str(r["path_in_file"]): r["genre_names"] for r in catalog.translate_genres(books, dim, "en").collect()}
    finally:
        catalog.DICTIONARY_ROWS = catalog_rows
    assert slow == got
    tree = catalog.genre_tree(dim, spark.createDataFrame([("fiction",)], "group string")).collect()
    assert [(r["group"], r["codes"]) for r in tree] == [("fiction", ["sf"])]


def test_dedup_is_idempotent_and_keeps_nulls(spark):
    rows = [("/b", b"1"), ("/a", b"1"), ("/c", None), ("/d", None), ("/a2", b"2")]
    df = spark.createDataFrame(rows, "file_path string, file_hash binary")
    once = maintain.dedup_by_hash(df)
    assert sorted(r["file_path"] for r in once.collect()) == ["/a", "/a2", "/c", "/d"]
    assert sorted(maintain.dedup_by_hash(once).collect()) == sorted(once.collect())
    assert maintain.dedup_by_hash(df.where("false")).count() == 0


def test_refresh_of_same_files_changes_nothing(spark, books):
    files = spark.createDataFrame([("/a.fb2", b"1", 5), ("/b.zip", b"2", 6), ("/c.txt", b"3", 7)], "file_path string, file_hash binary, file_size long")
    changes = maintain.classify_refresh(files, files)
    assert {r["change"] for r in changes.collect()} == {"same"}
    key = lambda df: sorted(str(r) for r in df.collect())
    assert key(maintain.refresh(books, changes, books.where("false"))) == key(books)
    assert {r["change"] for r in maintain.classify_refresh(files.withColumn("file_hash", F.lit(None).cast("binary")), files).collect()} == {"changed"}


def test_edit_and_remove(books):
    edited = maintain.edit_book(books, "/b.zip", ["x.fb2"], {"titles": F.array(F.lit("New"))})
    assert sorted(r["titles"][0] for r in edited.collect() if r["titles"]) == ["New", "War and  Peace", "Warm"]
    assert maintain.remove_book(books, "/b.zip", ["in.rar", "y.fb2"]).count() == 3
    assert maintain.remove_book(books, "/b.zip").count() == 2
    cleaned = books.select(maintain.clean_authors(F.col("authors")).alias("a"), maintain.clean_sequences(F.col("sequences")).alias("s")).collect()
    assert len(cleaned[0]["a"]) == 1 and cleaned[1]["a"] == [] and cleaned[1]["s"] == []


def test_marks(spark, books):
    marks = spark.createDataFrame([("/b.zip", ["x.fb2"])], "file_path string, path_in_file array<string>")
    more = spark.createDataFrame([("/b.zip", ["x.fb2"]), ("/a.fb2", None), ("/a.fb2", None)], "file_path string, path_in_file array<string>")
    both = maintain.add_bookmarks(marks, more)
    assert both.count() == 2 and maintain.add_bookmarks(both, more).count() == 2
    assert maintain.remove_bookmarks(both, more.where("path_in_file is null")).count() == 1
    notes = spark.createDataFrame([("/a", None, "n", "old"), ("/b", ["p"], "m", "old")], NOTES)
    changes = spark.createDataFrame([("/a", None, "n", ""), ("/b", ["p"], "m", "new"), ("/c", None, "k", "first")], NOTES)
    assert sorted((r["file_path"], r["note_text"]) for r in maintain.upsert_notes(notes, changes).collect()) == [("/b", "new"), ("/c", "first")]


def test_relocation_round_trip(spark):
    df = spark.createDataFrame([("/lib/a/x.txt", "/lib/a"), ("/other/y.txt", "/lib")], "file_path string, root_path string")
    out = relocate.export_base(df, "/lib", "mark")
    assert sorted(r["file_path"] for r in out.collect()) == ["../other/y.txt", "a/x.txt"]
    back = relocate.import_base(out, "/lib", "mark")
    assert sorted(back.collect()) == sorted(df.withColumn("root_path", F.when(F.col("root_path") == "/lib", "/lib").otherwise(F.col("root_path"))).collect())
    with pytest.raises(ValueError, match="anchor"):
        relocate.import_base(out, "/lib", "wrong")
    with pytest.raises(ValueError, match="exported"):
        relocate.export_base(df, "/lib", "mark", "inpx")


def test_store_swaps_whole_tables(spark, books, tmp_path):
    root = str(tmp_path / "collection")
    assert store.load(spark, root, "books").count() == 0
    store.save(spark, root, books=books)
    store.save(spark, root, books=store.load(spark, root, "books").where("file_path <> '/c.txt'"))
    assert store.books(spark, root).count() == 3
    assert [p.name for p in (tmp_path / "collection").iterdir()] == ["books"]
    reading = store.books(spark, root)
    store.save(spark, root, books=reading.where("file_path = '/a.fb2'"), notes=reading.select("file_path", "path_in_file", F.lit("n").alias("note_file"), F.lit("t").alias("note_text")))
    assert reading.count() == 3 and store.books(spark, root).count() == 1 and store.load(spark, root, "notes").count() == 3
    versions = [p.name for p in (tmp_path / "collection" / "books").iterdir() if p.name.startswith("version-")]
    assert len(versions) == 2  # the one that is read, and the one before it
    with pytest.raises(ValueError, match="no such table"):
        store.save(spark, root, other=reading)


def test_places(spark):
    import random

    from folioscope.operators.search import placed, text_order

    r = random.Random(2)
    rows = [(k, r.choice(["a", "B", "c", "D", "É"]) * r.randrange(1, 3)) for k in range(500)]
    df = spark.createDataFrame(rows, "id long, t string").repartition(7)
    for down in (False, True):
        got = {x["id"]: x["place"] for x in placed(df, text_order("t", inverted=down), F.col("id")).collect()}
        want = sorted(rows, key=lambda x: x[0])
        want.sort(key=lambda x: x[1].lower().encode(), reverse=down)
        assert got == {k: i + 1 for i, (k, _) in enumerate(want)}
    assert placed(df.where("false"), F.col("id")).count() == 0
    german = [x["t"] for x in df.select("t").distinct().orderBy(text_order("t", locale="de")).collect()]
    assert [x[0] for x in german] == ["a", "a", "B", "B", "c", "c", "D", "D", "É", "É"]


def test_place_texts(spark):
    df = spark.createDataFrame([(["a.zip", "b.fb2"], "x\ny"), (None, "")], "p array<string>, t string")
    assert [tuple(r) for r in df.select(catalog.place_text(F.col("p")), catalog.hops_of(F.col("t"))).collect()] == [("a.zip/b.fb2", ["x", "y"]), ("", None)]
