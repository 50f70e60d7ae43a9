"""A stored index of the words of books, ranged by their bytes, and the search of many requests at once over it."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.functions.match import Rule, normalise_needle
from folioscope.functions.text import full_name, normalise, normalise_author
from folioscope.operators.maintain import current, switch_table, version_name
from folioscope.operators.search import Author, Genre, Sequence, Title
from folioscope.operators.shared import held

#: Bytes of a text from a word on that the index keeps. What is asked for beyond them is compared with the book itself.
KEY_BYTES = 48
#: Rows of one part of the index.
PART_ROWS = 1 << 20
#: Lengths of the beginnings by which requests and words meet.
LEVELS = (1, 2, 4, 8, 16, 32)
#: Rows that a task makes at a time.
BATCH = 1 << 14

REQUESTS = "request string, kind string, text string, last string, first string, middle string, nick string, number string, coef double"
TERM = "request string, test string, way int, term int, terms int, field string, prefix binary, size int, tail int, number string, whole boolean"
WORD = "field string, key binary, book long, item int, at int, size int, far int, number string"


def _items() -> Column:
    """The searched texts of a book, as an array: the field, the item that parts belong to, its number, the normalised text."""
    null, empty = F.lit(None).cast("string"), F.lit("")

    def each(column: str, field: str, text, test=None, number=None) -> Column:
        rows = F.transform(F.col(column), lambda x, i: F.struct(F.lit(field).alias("field"), i.cast("int").alias("item"), (number(x) if number else null).alias("number"), F.when(test(x) if test else F.lit(True), F.lower(text(x))).alias("text")))
        return F.filter(F.coalesce(rows, F.array()), lambda x: F.coalesce(x["text"], empty) != "")

    stored = lambda a: full_name(a["last"], a["first"], a["middle"], a["nick"])
    whole = lambda a: F.coalesce(a["full"], empty)
    named = lambda s: F.coalesce(s["name"], empty) != ""
    parts = [each("authors", p, lambda a, p=p: normalise(F.coalesce(a[p], empty)), lambda a: stored(a) != "") for p in ("last", "first", "middle", "nick")]
    return F.concat(
        each("titles", "title", normalise),
        each("genres", "genre", normalise),
        *parts,
        each("authors", "free", lambda a: normalise_author(whole(a)), lambda a: stored(a) == ""),
        each("authors", "name", lambda a: normalise_author(F.when(stored(a) != "", stored(a)).otherwise(whole(a)))),
        each("sequences", "series", lambda s: normalise(s["name"]), named, lambda s: F.coalesce(s["number"], empty)),
        each("sequences", "series_free", lambda s: normalise(F.coalesce(s["full"], empty)), lambda s: ~named(s)),
    )


def _texts(books: DataFrame) -> DataFrame:
    return books.select("book", F.explode(_items()).alias("x")).select("book", "x.field", "x.item", "x.number", "x.text")


def _words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each word of each text: the bytes from there on, where they begin, the text's bytes, and how many there are from the word's blank on."""
    names = [x.split()[0] for x in WORD.split(", ")]
    rows: list[tuple] = []

    def flushed() -> pa.RecordBatch:
        columns = list(zip(*rows, strict=True))
        rows.clear()
        kinds = (pa.string(), pa.binary(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.string())
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=names)

    for batch in batches:
        for book, field, item, number, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            octets = text.encode("utf-8")
            blank = 0
            while blank >= 0:
                at = blank + (blank > 0)
                rows.append((field, octets[at : at + KEY_BYTES], book, item, at, len(octets), len(octets) - blank, number))
                if len(rows) >= BATCH:
                    yield flushed()
                blank = octets.find(b" ", max(1, at)) if field != "name" else -1
    if rows:
        yield flushed()


def build(spark: SparkSession, books: DataFrame, path: str, part_rows: int = PART_ROWS) -> None:
    """Writes the index of ``books`` to the folder ``path``; an index that is there is replaced when the new one is whole.

    It has three tables: the books, numbered by the part that they stand in; a row for each word of each searched text, sorted by
    field and bytes over parts of about ``part_rows`` rows (equal words by book, so that a very frequent one fills several); and
    the first and last word of every part. Nulls and empty texts have no words.
    """
    version = version_name()
    at = f"{path}/{version}"
    numbered = books.withColumn("book", F.monotonically_increasing_id())
    numbered.withColumn("part", F.shiftright("book", 33)).write.partitionBy("part").parquet(f"{at}/books")
    numbered.limit(0).write.parquet(f"{at}/schema")
    words = held(_texts(_books(spark, at)).mapInArrow(_words, WORD))
    parts = max(1, -(-words.count() // part_rows))
    ranged = words.repartitionByRange(parts, "field", "key", "book").withColumn("part", F.spark_partition_id())
    ranged.sortWithinPartitions("part", "field", "key").write.partitionBy("part").parquet(f"{at}/words")
    place = F.struct("field", "key")
    written = spark.read.schema(f"{WORD}, part int").parquet(f"{at}/words")
    written.groupBy("part").agg(F.min(place).alias("first"), F.max(place).alias("last")).coalesce(1).write.parquet(f"{at}/fences")
    switch_table(spark, path, version)


def request_rows(request: str, tests: list[object], coef: float = 0.75) -> list[tuple]:
    """Rows of a table of requests (see REQUESTS) for what ``search`` takes; kinds that the search doesn't know make none, as it ignores them."""
    out = []
    for x in tests:
        match x:
            case Title(text):
                out.append((request, "title", text, "", "", "", "", "", coef))
            case Genre(code):
                out.append((request, "genre", code, "", "", "", "", "", coef))
            case Sequence(name, number):
                out.append((request, "series", name, "", "", "", "", number, coef))
            case Author(last, first, middle, nick, full):
                out.append((request, "author", full, last, first, middle, nick, "", coef))
    return out


def _ways(row: dict) -> list[list[tuple]]:
    """The ways in which one item of a book meets a test: in each way all of its terms (field, needle, number or None, whether the whole text is meant) must be met by the same item."""
    text = row["text"] or ""
    if row["kind"] in ("title", "genre"):
        return [[(row["kind"], normalise_needle(text), None, False)]]
    if row["kind"] == "series":
        name, number = normalise_needle(text), normalise_needle(row["number"] or "")
        return [[("series", name, number or None, False)], [("series_free", f"{name} {number}".strip() if name else "", None, False)]]
    wanted = {x: y for x in ("last", "first", "middle", "nick") if (y := normalise_needle(row[x] or ""))}
    if not wanted:
        return [[("name", normalise_needle(text, author=True), None, True)]]
    head = " ".join(v for k, v in wanted.items() if k != "nick")
    return [[(k, v, None, False) for k, v in wanted.items()], [("free", " aka ".join(x for x in (head, wanted.get("nick", "")) if x), None, False)]]


def terms(requests: DataFrame) -> DataFrame:
    """(see TERM): what each request asks of the index. A needle that matches nothing has an empty prefix, which no word meets."""

    def over(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [x.split()[0] for x in TERM.split(", ")]
        for frame in frames:
            out = []
            for row in frame.to_dict("records"):
                for way, parts in enumerate(_ways(row)):
                    for k, (field, needle, number, whole) in enumerate(parts):
                        octets = needle.encode("utf-8")
                        rule = Rule(octets, len(octets), 0) if whole else Rule.of(needle, row["coef"])
                        own = (rule.prefix, rule.size, rule.tail) if rule else (b"", 0, 0)
                        out.append((row["request"], row["test"], way, k, len(parts), field, *own, number, whole))
            yield pd.DataFrame(out, columns=names)

    known = requests.where("request is not null and kind in ('title', 'genre', 'series', 'author')").select(*[x.split()[0] for x in REQUESTS.split(", ")]).distinct()
    return known.withColumn("test", F.to_json(F.struct(*[c for c in known.columns if c != "request"]))).mapInPandas(over, TERM)


def _parts(index: str, asked: DataFrame) -> list[int]:
    """The parts of the index in which a word may stand that meets one of the terms: a look at the first and last word of each."""
    fences = asked.sparkSession.read.parquet(f"{index}/fences")  # a row a part
    low = F.substring("prefix", 1, KEY_BYTES)
    ranges = asked.where(F.octet_length("prefix") > 0).select("field", low.alias("low"), F.concat(low, F.lit(b"\xff" * KEY_BYTES)).alias("high")).distinct()
    meets = (F.col("first") <= F.struct(F.col("field"), F.col("high").alias("key"))) & (F.col("last") >= F.struct(F.col("field"), F.col("low").alias("key")))
    return [r["part"] for r in fences.join(ranges, meets, "left_semi").select("part").collect()]


def _leading(begins: DataFrame, keyed: DataFrame) -> DataFrame:
    """Of each request the terms by which its books are found: those of the test with the fewest words to meet, of each of its ways the term with the fewest.

    A book that meets all tests meets one of them, so none is lost; a term that most books meet beside a rare one brings no pairs of its own.
    """
    words = begins.join(keyed.select("field", "level", "head").distinct(), ["field", "level", "head"], "left_semi").groupBy("field", "level", "head").agg(F.count("*").alias("cost"))
    costs = keyed.join(words, ["field", "level", "head"], "left").withColumn("cost", F.coalesce("cost", F.lit(0)))
    by_way = costs.groupBy("request", "test", "way").agg(F.min(F.struct("cost", "term")).alias("best"))
    by_test = by_way.groupBy("request", "test").agg(F.sum("best.cost").alias("cost"), F.collect_list(F.struct("way", F.col("best.term").alias("term"))).alias("ways"))
    first = by_test.groupBy("request").agg(F.min(F.struct("cost", "test", "ways")).alias("x"))
    named = first.select("request", F.col("x.test").alias("test"), F.explode("x.ways").alias("w")).select("request", "test", "w.way", "w.term")
    return keyed.join(named, ["request", "test", "way", "term"], "left_semi")


def search_batch(spark: SparkSession, path: str, requests: DataFrame) -> DataFrame:
    """(request, and the columns of a book) for every request of a table (see REQUESTS; a row a test) and every book that meets all its tests: what ``search`` gives for each alone.

    Only the parts of the index are read in which a word can stand that a request begins with, and of the books only the parts
    that hold hits. Requests and words meet by their beginnings of equal length, the longest of LEVELS that the request has, so
    the join has keys; only each request's rarest test is met in this way, and of the books found so its other terms are looked for by
    book. Hits are counted by item, then by test. Repeated rows of a request count once; null requests and kinds
    that are unknown are ignored; a request without a test, and one with a needle that matches nothing, give no book.
    """
    index = current(spark, path)
    if index is None:
        raise ValueError(f"no index at {path}")
    asked = held(terms(requests))
    level = F.lit(0)
    for n in LEVELS:
        level = F.when(F.octet_length("prefix") >= n, n).otherwise(level)
    asked = asked.withColumn("level", level)
    found = asked.agg(F.collect_set("level"), F.max(F.octet_length("prefix"))).first()
    levels, longest = sorted(set(found[0]) - {0}), found[1] or 0
    words = spark.read.schema(f"{WORD}, part int").parquet(f"{index}/words").where(F.col("part").isin(_parts(index, asked)))
    begins = words.withColumn("level", F.explode(F.array(*map(F.lit, levels)) if levels else F.array().cast("array<int>"))).where(F.octet_length("key") >= F.col("level"))
    begins = begins.withColumn("head", F.expr("substring(key, 1, level)")).withColumnsRenamed({"size": "text_size", "number": "own_number"})
    keyed = asked.where("level > 0").withColumn("head", F.expr("substring(prefix, 1, level)")).withColumn("start", F.substring("prefix", 1, KEY_BYTES))
    fits = F.startswith("key", "start") & (F.col("text_size") >= F.col("size")) & (F.col("far") > F.col("tail")) & (F.col("number").isNull() | (F.col("number") == F.col("own_number")))
    fits = fits & (~F.col("whole") | (F.col("text_size") == F.col("size")))
    few = held(begins.join(_leading(begins, keyed), ["field", "level", "head"]).where(fits).select("request", "book").distinct())
    own = words.withColumnsRenamed({"size": "text_size", "number": "own_number"})
    hits = few.join(keyed, "request").join(own, ["book", "field"]).where(fits)
    if longest > KEY_BYTES:
        texts = _texts(_books(spark, index, hits)).select("book", "field", "item", F.encode("text", "UTF-8").alias("octets"))
        some = hits.where(F.octet_length("prefix") > KEY_BYTES).join(texts, ["book", "field", "item"]).where(F.expr("substring(octets, at + 1, octet_length(prefix)) = prefix")).drop("octets")
        hits = hits.where(F.octet_length("prefix") <= KEY_BYTES).unionByName(some)
    met = hits.groupBy("request", "test", "way", "book", "item").agg(F.count_distinct("term").alias("n"), F.first("terms").alias("terms")).where("n = terms")
    tests = asked.groupBy("request").agg(F.count_distinct("test").alias("tests"))
    every = met.groupBy("request", "book").agg(F.count_distinct("test").alias("n")).join(tests, "request").where("n = tests").select("request", "book")
    every = held(every)
    return every.join(_books(spark, index, every), "book").drop("book")


def _books(spark: SparkSession, index: str, hits: DataFrame | None = None) -> DataFrame:
    """The books of the index, or of those parts of it that hold hits."""
    books = spark.read.schema(spark.read.parquet(f"{index}/schema").schema.add("part", "integer")).parquet(f"{index}/books")
    if hits is not None:
        parts = [r["part"] for r in hits.select(F.shiftright("book", 33).alias("part")).distinct().collect()]
        books = books.where(F.col("part").isin(parts))
    return books.drop("part")
