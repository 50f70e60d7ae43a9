"""The search of many requests over a stored index gives what each single search gives."""

import random

import pytest

from folioscope.operators import word_index
from folioscope.operators.search import Author, Genre, Sequence, Title, search

AUTHOR = "struct<full:string,last:string,first:string,middle:string,nick:string>"
BOOK = f"file_path string, authors array<{AUTHOR}>, titles array<string>, sequences array<struct<full:string,name:string,number:string>>, genres array<string>, key string"


def shelf(seed, n):
    r = random.Random(seed)
    words = ["small", "smaller", "widget", "Ring", "é", "éon", "éonier", "日本", "a", "A.", " ", "\t", "ring\x01", "x" * 60, "x" * 61, ""]
    some = lambda most=4: r.choice([" ", "  ", ". "]).join(r.choice(words) for _ in range(r.randint(0, most)))
    maybe = lambda f: None if r.random() < 0.2 else f()

    def author():
        if r.random() < 0.4:
            return (maybe(some), None, "", None, "")
        return (maybe(some), maybe(some), maybe(some), maybe(some), maybe(some))

    def book(i):
        return (f"/b/{i}", maybe(lambda: [author() for _ in range(r.randint(0, 3))]), maybe(lambda: [maybe(some) for _ in range(r.randint(0, 3))]), maybe(lambda: [(maybe(some), maybe(some), r.choice([None, "", "1", "2"])) for _ in range(r.randint(0, 2))]), maybe(lambda: [maybe(some) for _ in range(r.randint(0, 2))]), "clash")

    def test():
        kind = r.randrange(4)
        if kind == 0:
            return Title(some(3))
        if kind == 1:
            return Genre(some(2))
        if kind == 2:
            return Sequence(some(2), r.choice(["", "1", "2"]))
        return Author(*(r.choice(["", some(2)]) for _ in range(4)), full=some(3))

    requests = [([test() for _ in range(r.choice([1, 1, 1, 2, 3]))], r.choice([0.0, 0.3, 0.5, 0.75, 0.99, 1.0, -1.0, 7.0])) for _ in range(60)]
    return [book(i) for i in range(n)], requests


@pytest.mark.parametrize("seed", [2])
def test_batch_is_the_union_of_single_searches(spark, tmp_path, seed):
    rows, requests = shelf(seed, 250)
    books = spark.createDataFrame(rows + rows[:3], BOOK)
    path = str(tmp_path / "index")
    word_index.build(spark, books, path, part_rows=500)
    table = [row for k, (tests, coef) in enumerate(requests) for row in word_index.request_rows(str(k), tests, coef)]
    asked = spark.createDataFrame([*table, *table[:5], ("odd", "colour", "red", "", "", "", "", "", 0.5), (None, "title", "small", "", "", "", "", "", 0.5)], word_index.REQUESTS)
    got = sorted((r["request"], r["file_path"]) for r in word_index.search_batch(spark, path, asked).collect())
    want = sorted((str(k), r["file_path"]) for k, (tests, coef) in enumerate(requests) for r in search(books, tests, coef).select("file_path").collect())
    assert got == want and len({k for k, _ in want}) > 20


def test_index_is_replaced_and_pruned(spark, tmp_path):
    rows, _ = shelf(3, 300)
    path = str(tmp_path / "index")
    with pytest.raises(ValueError):
        word_index.search_batch(spark, path, spark.createDataFrame([], word_index.REQUESTS))
    word_index.build(spark, spark.createDataFrame(rows, BOOK), path, part_rows=200)
    asked = spark.createDataFrame(word_index.request_rows("1", [Title("smaller")]), word_index.REQUESTS)
    index = word_index.current(spark, path)
    parts, every = word_index._parts(index, word_index.terms(asked)), spark.read.parquet(f"{index}/fences").count()
    assert 0 < len(parts) < every / 2
    out = word_index.search_batch(spark, path, asked)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("PartitionFilters: [part") == 1 and "BatchScan" not in plan  # the books; the words are read before
    word_index.build(spark, spark.createDataFrame(rows[:0], BOOK), path)
    assert word_index.search_batch(spark, path, asked).count() == 0


def test_long_needles_are_compared_whole(spark, tmp_path):
    long = "and " + "so on " * 30
    books = spark.createDataFrame([("/1", None, [f"{long}end"], None, None, ""), ("/2", None, [f"x {long}other"], None, None, ""), ("/3", None, ["and so on"], None, None, "")], BOOK)
    path = str(tmp_path / "index")
    word_index.build(spark, books, path)
    for coef in (0.2, 0.99):
        for needle in (f"{long}end", f"{long}other", "so on so on", long * 2):
            asked = spark.createDataFrame(word_index.request_rows("1", [Title(needle)], coef), word_index.REQUESTS)
            got = {r["file_path"] for r in word_index.search_batch(spark, path, asked).collect()}
            assert got == {r["file_path"] for r in search(books, [Title(needle)], coef).collect()}


def test_a_rare_test_leads(spark, tmp_path, monkeypatch):
    """Of a request's tests the rarest finds the books; one that all books meet brings no pair of its own."""
    rows = [(f"/{k}", [(None, "Same", f"n{k:04d}", None, None)], ["Same title"], None, None, "") for k in range(300)]
    books, path, counts = spark.createDataFrame(rows, BOOK), str(tmp_path / "index"), []
    word_index.build(spark, books, path)
    kept = word_index.held
    monkeypatch.setattr(word_index, "held", lambda df: (lambda out: (counts.append((tuple(out.columns), out.count())), out)[1])(kept(df)))
    table = [row for k in range(0, 300, 3) for row in word_index.request_rows(str(k), [Title("same"), Author(last="same", first=f"n{k:04d}")], 0.99)]
    got = sorted((r["request"], r["file_path"]) for r in word_index.search_batch(spark, path, spark.createDataFrame(table, word_index.REQUESTS)).collect())
    assert got == sorted((str(k), f"/{k}") for k in range(0, 300, 3))
    assert [n for names, n in counts if names == ("request", "book")] == [100, 100]  # the books found by the leading test, and those that meet all
