"""Trees of any depth, crawls with links, a refresh as a stream, and joins that move nothing."""

import os
import random
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from folioscope.operators import maintain, tree
from folioscope.sources import bucketed, changelog, links
from folioscope.streaming import changes

# Trees -----------------------------------------------------------------------------------------------------------------


def plain_flatten(rows):
    by_id = {}
    for i, parent, kind, name in rows:
        if i is not None:
            by_id[i] = min(by_id.get(i, (parent, kind, name)), (parent, kind, name), key=lambda e: tuple((x is not None, x or "") for x in e))
    out = []
    for i, (_, kind, _) in by_id.items():
        at, names, link, seen = i, [], None, set()
        while at in by_id and at not in seen and by_id[at][0] is not None:
            seen.add(at)
            names.append(by_id[at][2] or "")
            at = by_id[at][0]
            if at in by_id and by_id[at][1] == "symlink" and link is None:
                link = at
        if kind == "file" and at in by_id and by_id[at][0] is None:
            out.append((i, at, by_id[at][1], link, len(names), "/".join([by_id[at][2] or "", *reversed(names)])))
    return sorted(out, key=repr)


def test_any_tree(spark):
    r = random.Random(4)
    for size in (0, 1, 30, 200):
        rows = []
        for k in range(size):
            parent = None if r.random() < 0.08 else str(r.randrange(size)) if r.random() < 0.15 else str(max(0, k - r.randint(1, 3)))
            rows.append((str(k), parent, r.choice(["dir", "dir", "symlink", "file"]), r.choice(["a", "b", "", None])))
        rows += [(None, "0", "file", "x")] + rows[:2] + [("self", "self", "file", "s"), ("lost", "nowhere", "file", "l"), ("c1", "c2", "dir", "c"), ("c2", "c1", "dir", "c"), ("below", "c1", "file", "b")]
        got = sorted(map(tuple, tree.flatten(spark.createDataFrame(rows, tree.ENTRY)).collect()), key=repr)
        assert got == plain_flatten(rows)


def test_a_deep_tree(spark):
    n = 3000
    rows = spark.range(n).select(F.col("id").cast("string").alias("id"), F.when(F.col("id") > 0, (F.col("id") - 1).cast("string")).alias("parent"), F.when(F.col("id") == n - 1, "file").otherwise("dir").alias("kind"), F.lit("d").alias("name"))
    out = tree.flatten(rows).collect()
    assert [(r["id"], r["root"], r["depth"], len(r["path"])) for r in out] == [(str(n - 1), "0", n - 1, 2 * n - 1)]


# Links -----------------------------------------------------------------------------------------------------------------


def test_crawl_tells_links_apart(spark, tmp_path):
    a, b = tmp_path / "a", tmp_path / "b"
    for d in (a / "sub" / "deep", b, a / "denied"):
        d.mkdir(parents=True)
    for p in (a / "1.txt", a / "sub" / "2.fb2", a / "sub" / "deep" / "3.TXT", b / "4.txt", a / "no.exe", a / "denied" / "5.txt"):
        p.write_text("x" * 7)
    (a / "loop").symlink_to(a)
    (a / "sub" / "up").symlink_to(tmp_path)
    (a / "four.txt").symlink_to(b / "4.txt")
    (a / "broken.txt").symlink_to(tmp_path / "none")
    (a / "named.exe").symlink_to(b / "4.txt")
    (tmp_path / "to_b").symlink_to(b)
    (tmp_path / "to_4.txt").symlink_to(b / "4.txt")
    os.chmod(a / "denied", 0)
    try:
        readable = os.access(a / "denied", os.R_OK)  # root may read all
        got = {(r["file_path"], r["root_kind"], r["root_path"], r["link_path"]) for r in links.crawl_links(spark, str(a), str(tmp_path / "missing"), str(tmp_path / "to_b"), str(tmp_path / "to_4.txt"), str(a / "1.txt"), str(a)).collect()}
    finally:
        os.chmod(a / "denied", 0o755)
    root, s = str(a), str
    want = {
        (s(a / "1.txt"), "dir", root, None), (s(a / "sub" / "2.fb2"), "dir", root, None), (s(a / "sub" / "deep" / "3.TXT"), "dir", root, None),
        (s(b / "4.txt"), "dir", root, s(a / "four.txt")), (s(b / "4.txt"), "dir", root, s(a / "named.exe")),
        # by the link to the folder above, each place once: b and the links beside it
        (s(a / "sub" / "up" / "b" / "4.txt"), "dir", root, None), (s(b / "4.txt"), "dir", root, s(a / "sub" / "up" / "to_4.txt")),
        (s(tmp_path / "to_b" / "4.txt"), "dir", s(tmp_path / "to_b"), None), (s(b / "4.txt"), "symlink", s(tmp_path / "to_4.txt"), s(tmp_path / "to_4.txt")), (s(a / "1.txt"), "file", s(a / "1.txt"), None),
    }
    if readable:
        want.add((s(a / "denied" / "5.txt"), "dir", root, None))
    assert got == want
    files = {r["file_path"]: r for r in links.files_of(links.crawl_links(spark, str(a), str(b))).collect()}
    assert files[s(b / "4.txt")]["link_path"] is None and files[s(b / "4.txt")]["root_path"] == s(b) and files[s(a / "1.txt")]["file_size"] == 7
    assert links.crawl_links(spark, str(tmp_path / "missing")).count() == 0


# A refresh as a stream --------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("fast", [False, True])
def test_stream_of_changes_is_the_refresh_of_each_step(spark, tmp_path, fast):
    r = random.Random(11 + fast)
    folder, check = str(tmp_path / "scans"), str(tmp_path / "check")
    schema = "file_path string, file_size long, file_hash binary"
    before = spark.createDataFrame([], schema)
    for step in range(5):
        rows = [] if step == 3 else [(f"/{k}", r.choice([1, 2, None]), r.choice([b"x", b"y", None])) for k in range(8) if r.random() < 0.7]
        now = spark.createDataFrame(rows, schema)
        changes.add_scan(now, folder, datetime(2024, 5, 1, tzinfo=timezone.utc) + timedelta(hours=step))
        # started anew from its checkpoint at each step
        changes.record(changes.changes(changes.scans(spark, folder), fast), f"{tmp_path}/out/step={step}", check).awaitTermination()
        got = sorted((x["file_path"], x["change"]) for x in spark.read.schema(changes.CHANGE).parquet(f"{tmp_path}/out/step={step}").collect())
        assert got == sorted((x["file_path"], x["change"]) for x in maintain.classify_refresh(before, now, fast).where("change <> 'same'").collect()), step
        before = now


def test_looks_that_come_in_pieces(spark, tmp_path):
    """A look whose rows come in several batches, two looks at once, and one that comes again."""
    folder, check = str(tmp_path / "scans"), str(tmp_path / "check")
    schema = "file_path string, file_size long, file_hash binary"
    look = lambda k, names: changes.add_scan(spark.createDataFrame([(x, 1, b"h") for x in names], schema).coalesce(1), str(tmp_path / f"look{k}"), datetime(2024, 5, k, tzinfo=timezone.utc), shares=2)
    for k, names in ((1, "abcdef"), (2, "bcdefg"), (3, "xyz"), (4, "")):
        look(k, names)
    os.makedirs(folder)

    def pieces(k):
        rows = spark.read.parquet(str(tmp_path / f"look{k}")).orderBy(F.col("n").isNull(), "file_path").collect()
        return [spark.createDataFrame(rows[a : a + 3], changes.SCAN) for a in range(0, len(rows), 3)]

    def run(step, *frames):
        for df in frames:
            df.coalesce(1).write.mode("append").parquet(folder)
        changes.record(changes.changes(changes.scans(spark, folder)), f"{tmp_path}/out/step={step}", check).awaitTermination()
        return sorted((x["change"], x["file_path"]) for x in spark.read.schema(changes.CHANGE).parquet(f"{tmp_path}/out/step={step}").collect())

    first = pieces(1)
    got = [run(k, df) for k, df in enumerate(first)]
    assert sorted(x for g in got for x in g) == [("added", x) for x in "abcdef"] and got[0] == []
    assert run(10, *pieces(2), *pieces(3)) == sorted([("vanished", "a"), ("added", "g"), *(("vanished", x) for x in "bcdefg"), *(("added", x) for x in "xyz")])
    assert run(11, *pieces(2)) == []
    assert run(12, *pieces(4)) == [("vanished", x) for x in "xyz"]


def test_books_follow_a_stream(spark, tmp_path):
    folder, books = str(tmp_path / "scans"), str(tmp_path / "books")
    schema = "file_path string, path_in_file array<string>, title string"
    changelog.create(spark, books, spark.createDataFrame([("/other", None, "kept")], schema))
    parse = lambda df: df.select("file_path", F.array(F.lit("e")).alias("path_in_file"), F.concat(F.lit("of "), "file_path").alias("title"))
    for step, look in enumerate([{"/a": b"1", "/b": b"1"}, {"/b": b"2", "/c": b"1"}]):
        changes.add_scan(spark.createDataFrame([(k, 1, v) for k, v in look.items()], "file_path string, file_size long, file_hash binary"), folder, datetime(2024, 5, 1 + step, tzinfo=timezone.utc))
        changes.follow(changes.changes(changes.scans(spark, folder)), books, parse, str(tmp_path / "check")).awaitTermination()
        assert {x["file_path"] for x in changelog.read(spark, books).collect()} == {"/other", *look}
    assert changelog.state(spark, books).last >= 2


# Joins that move nothing ------------------------------------------------------------------------------------------------


def moves(df):
    plan = df._jdf.queryExecution().executedPlan().toString()
    return plan.count("Exchange")


def test_joins_of_dealt_tables_move_nothing(spark, tmp_path):
    was = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        place = F.when(F.col("id") % 3 > 0, F.array(F.col("id").cast("string")))
        rows = spark.range(500).select((F.col("id") % 90).cast("string").alias("file_path"), place.alias("path_in_file"), F.lit(1).cast("long").alias("file_size"), F.lit(b"x").alias("file_hash"))
        one = rows.dropDuplicates(["file_path"])
        for name, df in {"old": one.where("file_path % 7 > 0"), "now": one.where("file_path % 5 > 0"), "books": rows, "notes": rows.where("file_path % 4 = 0"), "marks": rows.where("file_path % 2 = 0")}.items():
            bucketed.save(spark, df, str(tmp_path / name), 4)
        t = {n: bucketed.load(spark, str(tmp_path / n)) for n in ("old", "now", "books", "notes", "marks")}
        refresh = maintain.classify_refresh(t["old"], t["now"])
        assert moves(refresh) == 0 and moves(maintain.classify_refresh(one, one)) >= 1
        assert sorted(map(repr, refresh.collect())) == sorted(map(repr, maintain.classify_refresh(one.where("file_path % 7 > 0"), one.where("file_path % 5 > 0")).collect()))
        from folioscope.operators.catalog import with_notes

        noted = bucketed.with_notes(t["books"], t["notes"])
        assert moves(noted) == 0 and sorted(map(repr, noted.collect())) == sorted(map(repr, with_notes(rows, spark.createDataFrame(rows.where("file_path % 4 = 0").collect(), rows.schema)).collect()))
        new = bucketed.new_bookmarks(t["marks"], t["books"])
        own = spark.createDataFrame(rows.where("file_path % 2 = 0").collect(), rows.schema)
        assert moves(new) == 0 and sorted(map(repr, new.collect())) == sorted(map(repr, rows.join(own, maintain._marks(rows, own), "left_anti").collect()))
        assert moves(maintain.to_parse(refresh.where("change <> 'same'"), t["now"])) <= 1  # of the changes, at most: never of the table
        # another session learns of the buckets from the folder
        spark.sql(f"DROP TABLE {bucketed._name(bucketed.current(spark, str(tmp_path / 'old')))}")
        assert moves(maintain.classify_refresh(bucketed.load(spark, str(tmp_path / "old")), t["now"])) == 0
        with pytest.raises(ValueError):
            bucketed.load(spark, str(tmp_path / "none"))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", was)


# The store -------------------------------------------------------------------------------------------------------------


def test_store_with_links_changes_and_index(spark, tmp_path):
    from test_ingest import fb2, zipped

    from folioscope.operators import word_index
    from folioscope.operators.search import Title, search
    from folioscope.schema import COLLECTION
    from folioscope.sources import ingest, store

    lib, root = tmp_path / "lib", str(tmp_path / "store")
    (lib / "sub").mkdir(parents=True)
    (tmp_path / "away").mkdir()
    for name, data in {"lib/a.fb2": fb2("Alpha Tale"), "lib/sub/copy.fb2": fb2("Alpha Tale"), "away/b.fb2": fb2("Beta Tale"), "lib/c.zip": zipped({"d.fb2": fb2("Delta Song")})}.items():
        (tmp_path / name).write_bytes(data)
    (lib / "b.fb2").symlink_to(tmp_path / "away" / "b.fb2")
    (lib / "sub" / "up").symlink_to(lib)
    files, books = links.create(spark, str(lib))
    rows = {os.path.basename(r["file_path"]): r for r in files.collect()}
    assert set(rows) == {"a.fb2", "b.fb2", "c.zip"} and rows["b.fb2"]["link_path"] == str(lib / "b.fb2") and rows["a.fb2"]["link_path"] is None
    plain = {os.path.basename(r["file_path"]): bytes(r["file_hash"]) for r in ingest.files_of(ingest.crawl(spark, str(lib))).collect()}
    assert bytes(rows["a.fb2"]["file_hash"]) == plain["a.fb2"]
    store.save(spark, root, info=spark.createDataFrame([("native", str(lib), None)], COLLECTION), files=files, books=books)
    titles = lambda: sorted(r["titles"][0] for r in store.books(spark, root).collect())
    assert titles() == ["Alpha Tale", "Beta Tale", "Delta Song"]
    changelog.edit_book(spark, store.table(spark, root, "books"), str(lib / "c.zip"), ["d.fb2"], {"titles": F.array(F.lit("Delta Tune"))})
    assert titles() == ["Alpha Tale", "Beta Tale", "Delta Tune"]
    notes = store.table(spark, root, "notes")
    place = "file_path string, path_in_file array<string>, note_file string, note_text string"
    changelog.upsert_notes(spark, notes, spark.createDataFrame([(str(lib / "a.fb2"), None, None, "good")], place))
    assert [r["note_text"] for r in store.load(spark, root, "notes").collect()] == ["good"]
    store.build_index(spark, root)
    asked = spark.createDataFrame([*word_index.request_rows("1", [Title("tal")]), *word_index.request_rows("2", [Title("tune")])], word_index.REQUESTS)
    assert sorted((r["request"], r["titles"][0]) for r in store.search_many(spark, root, asked).collect()) == [("1", "Alpha Tale"), ("1", "Beta Tale"), ("2", "Delta Tune")]
    store.compact(spark, root)
    assert titles() == ["Alpha Tale", "Beta Tale", "Delta Tune"] and not changelog.state(spark, f"{root}/books").entries
    changelog.remove_book(spark, store.table(spark, root, "books"), str(lib / "a.fb2"))
    store.save(spark, root, books=search(store.books(spark, root), [Title("tune")]).select(*store.books(spark, root).columns))  # a rewrite stands for itself
    assert titles() == ["Delta Tune"] and store.load(spark, root, "bookmarks").count() == 0


def test_listing_by_tasks_is_the_crawl(spark, tmp_path, monkeypatch):
    """Directories that tasks list hold what Spark's own reader finds; a rehash of a mounted folder lists nothing on the driver."""
    from datetime import datetime

    from folioscope.sources import ingest

    for name in ("a.txt", "x/b.txt", "x/y=1/ü c.md", "_no/d.txt", ".no/e.txt", "x/_f.txt", "x/g.bin", "x/h%20.txt"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(name.encode())
    root = str(tmp_path)
    columns = ("file_path", "root_path", "file_size", "modified")
    got = sorted(map(tuple, ingest.listed(spark, root, f"{root}/a.txt", f"{root}/missing").select(*columns).collect()))
    assert got == sorted(map(tuple, ingest.crawl(spark, root, f"{root}/a.txt", f"{root}/missing").select(*columns).collect())) and len(got) == 5
    want = {tuple(r) for r in ingest.files_of(ingest.crawl(spark, root)).collect()}
    monkeypatch.setattr(ingest, "crawl", None)
    known = spark.createDataFrame([(f"{root}/a.txt", 5, b"known")], "file_path string, file_size long, file_hash binary")
    out = {tuple(r) for r in ingest.rehash(known, datetime(2100, 1, 1), root).collect()}
    assert {r[0] for r in out} == {r[0] for r in want} and out - want == {(f"{root}/a.txt", "dir", root, None, b"known", 5)}
