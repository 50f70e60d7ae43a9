"""Genre dictionaries from CSV files: ``Code;Group;<languages>…`` and ``<languages>…`` for groups."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _rows(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, sep=";", header=True, encoding="UTF-8", ignoreLeadingWhiteSpace=True, ignoreTrailingWhiteSpace=True)


def language_column(columns: list[str], locale: str) -> str:
    """The column whose heading contains the locale; the first one without such a heading."""
    return next((c for c in columns if locale and locale in c), columns[0])


def load_genres(spark: SparkSession, path: str, locale: str, groups: DataFrame | None = None) -> DataFrame:
    """(code, group, lang, translation); without a column for the locale the translation is the code. Genres of groups that ``groups`` lacks are left out."""
    rows = _rows(spark, path)
    code, group, *_ = rows.columns
    own = rows.select(F.col(f"`{code}`").alias("code"), F.col(f"`{group}`").alias("group"), F.lit(locale).alias("lang"), F.col(f"`{language_column(rows.columns, locale)}`").alias("translation"))
    own = own.where("code is not null and code <> ''")
    return own if groups is None else own.join(groups.select("group"), "group", "left_semi").select("code", "group", "lang", "translation")


def load_groups(spark: SparkSession, path: str, locale: str) -> DataFrame:
    """(group, lang, translation): the first column is the key and a label too."""
    rows = _rows(spark, path)
    return rows.select(F.col(f"`{rows.columns[0]}`").alias("group"), F.lit(locale).alias("lang"), F.col(f"`{language_column(rows.columns, locale)}`").alias("translation")).where("group is not null and group <> ''")
