"""Paths: extensions, stems, relocation."""

from __future__ import annotations

import posixpath

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Extensions of books and archives that a collection takes.
SUPPORTED = "fb2 epub pdf djvu odt txt md zip 7z tar.gz tar.xz tar.bz2 tar iso cpio jar rar".split()


def file_name(path: Column) -> Column:
    return F.regexp_extract(path, "[^/]*$", 0)


def parent(path: Column) -> Column:
    """All before the last slash; empty without one."""
    return F.regexp_replace(path, "/?[^/]*$", "")


def extension(path: Column) -> Column:
    """Lower-case extension with its dot: from the first ``.tar`` of the name, else from its last dot; empty without a dot."""
    return F.regexp_extract(F.lower(file_name(path)), r"(\.tar.*)$|(\.[^.]*)$", 0)


def stem(path: Column) -> Column:
    """The name without its last extension; a name that begins with its only dot is all stem."""
    name = file_name(path)
    return F.when(F.regexp_like(name, F.lit(r"^\.[^.]*$")), name).otherwise(F.regexp_replace(name, r"\.[^.]*$", ""))


def has_extension(path: Column) -> Column:
    return extension(path) != ""


def supported(path: Column) -> Column:
    return extension(path).isin(["." + x for x in SUPPORTED])


def relative_to(path: Column, base: str) -> Column:
    """A path below ``base`` relative to it, by text alone; others by ``lexically_relative``."""
    base = posixpath.normpath(base).rstrip("/") + "/"
    return F.when(F.startswith(path, F.lit(base)), F.substring(path, len(base) + 1, 2**31 - 1)).otherwise(lexically_relative(base)(path))


def lexically_relative(base: str):
    @F.pandas_udf(T.StringType())
    def run(x: pd.Series) -> pd.Series:
        return x.map(lambda v: posixpath.relpath(posixpath.normpath(v), posixpath.normpath(base)) if v.startswith("/") == base.startswith("/") else v, na_action="ignore")

    return run


@F.pandas_udf(T.StringType())
def lexically_normal(x: pd.Series) -> pd.Series:
    """Without ``.``, doubled slashes and, where they follow a name, ``..``; symbolic links play no part."""
    return x.map(lambda v: ("/" + posixpath.normpath(v).lstrip("/")) if v.startswith("/") else posixpath.normpath(v), na_action="ignore")


def absolute(path: Column, base: str) -> Column:
    """A relative path below ``base``; an absolute one stays. Only paths with ``.``, ``..`` or doubled slashes leave generated code."""
    joined = F.when(F.startswith(path, F.lit("/")), path).otherwise(F.concat(F.lit(base.rstrip("/") + "/"), path))
    return F.when(F.regexp_like(joined, F.lit(r"/\.{0,2}(/|$)")), lexically_normal(joined)).otherwise(joined)
