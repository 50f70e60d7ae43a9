"""Pages and filters of stored views against whole orders and scans."""

import random
import re

import pytest
from pyspark.sql import functions as F

from folioscope.operators import views
from folioscope.operators.search import filter_contains


def shelf(spark, n=600):
    r = random.Random(3)
    words = ["small", "Widget", "é", "ÉON", "", "a", "b%_", "日本語の本", "x" * 300]
    rows = [(k % 250, r.choice([None, "", *(" ".join(r.choice(words) for _ in range(r.randint(1, 3))) for _ in range(6))]), r.choice("ab")) for k in range(n)]
    return spark.createDataFrame(rows, "id int, title string, kind string")


def test_every_page_is_that_of_the_whole_order(spark, tmp_path):
    rows, path = shelf(spark), str(tmp_path / "view")
    with pytest.raises(ValueError):
        views.page(spark, path, 1, 1)
    views.build(spark, rows, path, F.lower("title").desc_nulls_last(), F.col("id"), F.col("kind"), part_rows=100)
    assert views.count(spark, path) == 600
    want = [tuple(r) for r in rows.orderBy(F.lower("title").desc_nulls_last(), "id", "kind").collect()]
    for first, n in ((1, 50), (1, 1), (77, 130), (600, 5), (601, 5), (590, 100), (1, 1000), (10, 0)):
        got = views.page(spark, path, first, n).collect()
        assert [r["place"] for r in got] == list(range(first, min(600, first + n - 1) + 1))
        key = lambda r: ((r[1] or "").lower(), r[1] is None, r[0], r[2])
        assert [key(r) for r in got] == [key(r) for r in want[first - 1 : first - 1 + n]]
    plan = views.page(spark, path, 77, 10)._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[[^\]]*part#", plan)
    views.build(spark, rows.where("false"), path, F.col("id"), texts=("title",))
    assert views.count(spark, path) == 0 and views.page(spark, path, 1, 5).count() == 0 and views.containing(spark, path, "title", "widget").count() == 0


def test_filters_read_only_parts_that_match(spark, tmp_path):
    rows, path = shelf(spark), str(tmp_path / "view")
    views.build(spark, rows, path, F.col("title"), F.col("id"), texts=("title",), part_rows=40)
    for text in ("widget", "WIDGET", "all w", "éon", "日本語", "本", "", "a", "xxxx", "b%_", "nowhere", "x" * 301, "small small"):
        got = sorted(map(repr, views.containing(spark, path, "title", text).select("id", "title", "kind").collect()))
        assert got == sorted(map(repr, filter_contains(rows, "title", text).collect())), text
    assert views.containing(spark, path, "kind", "A").count() == rows.where("kind = 'a'").count()
    many = len(spark.read.parquet(f"{views.current(spark, path)}/sizes").collect())
    plan = views.containing(spark, path, "title", "日本語")._jdf.queryExecution().executedPlan().toString()
    assert many > 10 and re.search(r"PartitionFilters: \[[^\]]*part#", plan)
    read = views.containing(spark, path, "title", "日本語").select(F.input_file_name().alias("f")).distinct().count()
    assert read < many
