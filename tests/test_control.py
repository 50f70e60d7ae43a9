"""Progress of what runs, and the search as a table function."""

import random
import time

import pytest

from folioscope.functions.match import Rule, normalise_needle
from folioscope.operators import control, table_function
from folioscope.operators.search import Title, search


def test_ratios_rise_to_one(spark):
    def slow(batches):
        for batch in batches:
            time.sleep(0.3)
            yield batch

    said = []
    with control.Watch(spark, 0.03, lambda *x: said.append(x)) as watch:
        rows = spark.range(0, 12, 1, 12).mapInArrow(slow, "id long")
        assert rows.groupBy((rows.id % 3).alias("k")).count().count() == 3
    assert watch.ratios and all(a == sorted(a) and a[-1] == 1 for a in watch.ratios.values())
    assert max(len(a) for a in watch.ratios.values()) > 2 and len(said) >= len(watch.ratios)
    assert all(name and share == 1 for name, share in watch.seen.values())


def test_rows_that_went_through(spark):
    df, seen = control.counted(spark.range(100), "x")
    assert df.where("id < 10").count() == 10 and seen.get["processed"] == 100


def test_table_function_is_the_search(spark):
    r = random.Random(8)
    words = ["small", "Widget", "é", "éonier", "a", " ", "ring"]
    rows = [(k, [" ".join(r.choice(words) for _ in range(r.randint(0, 4))) for _ in range(r.randint(0, 2))], "x") for k in range(150)]
    books = spark.createDataFrame(rows, "id long, titles array<string>, coef string")
    books.createOrReplaceTempView("some_books")
    table_function.register(spark)
    for needle, coef in (("wid", 0.75), ("éon", 0.5), ("small  Widget", 0.9), ("", 0.5), ("ring", 1.0)):
        got = sorted(x["id"] for x in spark.sql("SELECT * FROM search_books(TABLE(some_books), 'titles', :n, :c)", args={"n": needle, "c": coef}).collect())
        own = books.withColumnRenamed("coef", "file_path").withColumn("path_in_file", books["titles"])
        want = sorted(x["path_in_file"] for x in search(own, [Title(needle)], coef).collect())
        assert sorted(next(t for k, t, _ in rows if k == i) for i in got) == want, needle
    with pytest.raises(Exception, match="no column"):
        spark.sql("SELECT * FROM search_books(TABLE(some_books), 'nothing', 'x', 0.5)").collect()
    assert not table_function.matches(Rule.of(normalise_needle("x"), 0.5), None)
