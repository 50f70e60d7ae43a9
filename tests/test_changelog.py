"""A table read with its log is the table that full rewrites would have made, whatever changes come and wherever they break off."""

import random

import pytest
from pyspark.sql import functions as F

from folioscope.operators import maintain
from folioscope.sources import changelog

ROWS = "file_path string, path_in_file array<string>, title string, titles array<string>"


def rows_of(spark, n, seed=1):
    r = random.Random(seed)
    places = [None, ["a"], ["b"], ["x.rar", "a"], ["x.rar", "b"], []]
    return spark.createDataFrame([(f"/f{r.randrange(6)}" if r.random() < 0.95 else None, r.choice(places), f"t{i}", [f"t{i}"]) for i in range(n)], ROWS)


def said(df):
    return sorted(map(repr, df.select("file_path", "path_in_file", "title").collect()))


def files_in(path):
    return sorted(str(x.relative_to(path)) for x in path.rglob("*.parquet"))


def test_any_changes_are_those_of_full_rewrites(spark, tmp_path):
    r, path = random.Random(7), str(tmp_path / "t")
    now = rows_of(spark, 40)
    changelog.create(spark, path, now)
    for step in range(14):
        kind, file = step % 5, f"/f{r.randrange(6)}"
        place = r.choice([None, ["a"], ["x.rar", "a"], []])
        if kind == 0:
            fields = {"title": F.concat("title", F.lit("!"))}
            changelog.edit_book(spark, path, file, place, fields)
            now = maintain.edit_book(now, file, place, fields)
        elif kind == 1:
            changelog.remove_book(spark, path, file, place)
            now = maintain.remove_book(now, file, place)
        elif kind == 2:
            more = rows_of(spark, 3, seed=100 + step)
            changelog.add_bookmarks(spark, path, more)
            now = maintain.add_bookmarks(now, more)
        elif kind == 3:
            gone = rows_of(spark, 2, seed=200 + step)
            changelog.remove_bookmarks(spark, path, gone)
            now = maintain.remove_bookmarks(now, gone)
        else:
            changelog.compact(spark, path)
        now = spark.createDataFrame(now.collect(), ROWS)
        if kind != 2:
            assert said(changelog.read(spark, path)) == said(now), (step, kind)
        else:  # of repeated new bookmarks either title may stay
            assert sorted(map(repr, changelog.read(spark, path).select("file_path", "path_in_file").collect())) == sorted(map(repr, now.select("file_path", "path_in_file").collect()))
            now = spark.createDataFrame(changelog.read(spark, path).collect(), ROWS)


def test_a_change_writes_only_its_rows(spark, tmp_path):
    path = tmp_path / "t"
    rows = spark.range(5000).select(F.concat(F.lit("/"), "id").alias("file_path"), F.expr("cast(null as array<string>)").alias("path_in_file"), F.col("id").cast("string").alias("title"), F.array(F.lit("x")).alias("titles"))
    changelog.create(spark, str(path), rows)
    before = files_in(path)
    assert changelog.edit_book(spark, str(path), "/17", None, {"title": F.lit("new")}) == 1
    new = [x for x in files_in(path) if x not in before]
    assert set(before) <= set(files_in(path)) and sum(spark.read.parquet(str(path / x)).count() for x in new) == 1
    assert changelog.edit_book(spark, str(path), "/nowhere", None, {"title": F.lit("new")}) == 0
    plan = changelog.read(spark, str(path), test=F.col("file_path") == "/17")._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(file_path,/17)" in plan and "SortMergeJoin" not in plan
    assert {r["title"] for r in changelog.read(spark, str(path), test=F.col("file_path") == "/17").collect()} == {"new"}


def test_changes_that_break_off_leave_nothing(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "t")
    with pytest.raises(ValueError):
        changelog.read(spark, path)
    changelog.create(spark, path, rows_of(spark, 20))
    before = said(changelog.read(spark, path))

    def broken(*args):
        raise OSError("gone")

    for step in ("_claim", "_put_base"):
        with monkeypatch.context() as m:
            m.setattr(changelog, step, broken)
            with pytest.raises(OSError):
                changelog.remove_book(spark, path, "/f1") if step == "_claim" else (changelog.change(spark, path, lambda rows: rows, F.lit(True)), changelog.compact(spark, path))
        assert said(changelog.read(spark, path)) == before
    with monkeypatch.context() as m:  # the new base is written, but not named
        m.setattr(changelog, "switch_table", broken)
        with pytest.raises(OSError):
            changelog.compact(spark, path)
    assert said(changelog.read(spark, path)) == before
    monkeypatch.setattr(changelog, "STALE_MS", -1)
    changelog.compact(spark, path)
    assert said(changelog.read(spark, path)) == before
    assert len([x for x in (tmp_path / "t").iterdir() if x.name.startswith("rows-")]) <= 1


def test_changes_at_once_are_all_kept(spark, tmp_path):
    path = str(tmp_path / "t")
    changelog.create(spark, path, rows_of(spark, 20))
    calls = []

    def edit(rows):
        if not calls:  # another change comes first
            calls.append(changelog.edit_book(spark, path, "/f1", None, {"title": F.concat("title", F.lit("+"))}))
        return rows.withColumn("title", F.concat("title", F.lit("*")))

    want = sorted(x["title"] + ("+*" if x["file_path"] == "/f1" else "") for x in rows_of(spark, 20).collect())
    assert changelog.change(spark, path, edit, F.col("file_path") == "/f1") == 2
    assert sorted(r["title"] for r in changelog.read(spark, path).collect()) == want
