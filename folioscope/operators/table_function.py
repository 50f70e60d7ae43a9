"""The search as a table function for SQL: ``SELECT * FROM search_books(TABLE(books), 'title', 'small widg', 0.75)``."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

from folioscope.functions.match import Rule, normalise_needle


def matches(rule: Rule | None, source: str | None) -> bool:
    """The word-prefix rule for one source, normalised as the search does (see ``functions.match``)."""
    if rule is None or source is None:
        return False
    octets = normalise_needle(source).encode("utf-8")
    if len(octets) < rule.size:
        return False
    if octets.startswith(rule.prefix) and len(octets) > rule.tail:
        return True
    at = octets.find(b" " + rule.prefix, 1)
    return at > 0 and len(octets) - at > rule.tail


class SearchBooks:
    """Rows of a table of which a text column, or one of the items of an array of texts, meets a needle. The result has the table's columns, whatever they are."""

    @staticmethod
    def analyze(rows: AnalyzeArgument, column: AnalyzeArgument, needle: AnalyzeArgument, coef: AnalyzeArgument) -> AnalyzeResult:
        if not rows.isTable:
            raise ValueError("the first argument must be a table")
        if not column.isConstantExpression or column.value not in rows.dataType.names:
            raise ValueError(f"no column {column.value}")
        return AnalyzeResult(schema=rows.dataType)

    def __init__(self):
        self.rules: dict[tuple[str, float], Rule | None] = {}

    def eval(self, row, column: str, needle: str, coef):
        key = (needle, float(coef))
        if key not in self.rules:
            self.rules[key] = Rule.of(normalise_needle(needle), key[1])
        value = row[column]
        if any(matches(self.rules[key], x) for x in (value if isinstance(value, list) else [value])):
            yield tuple(row)


def register(spark: SparkSession, name: str = "search_books") -> None:
    """Makes the function known to a session's SQL. Rows are tested one by one in Python; ``search`` is the fast way from DataFrames."""
    spark.udtf.register(name, udtf(SearchBooks))
