"""Export of a collection with relative paths, and its import elsewhere."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscope.functions.paths import absolute, relative_to

PATHS = ("file_path", "root_path", "link_path", "books_dir")


def export_base(rows: DataFrame, base: str, anchor: str, collection_type: str = "native") -> DataFrame:
    """Rows with paths relative to ``base``, and the name of the anchor file that marks it. Only native collections can be exported."""
    if collection_type != "native":
        raise ValueError(f"a collection of type {collection_type} can't be exported")
    own = [c for c in PATHS if c in rows.columns]
    return rows.withColumns({c: relative_to(F.col(c), base) for c in own}).withColumn("anchor", F.lit(anchor))


def anchor_of(rows: DataFrame) -> str | None:
    """Name of the anchor file of an exported collection, if it is one."""
    found = rows.select("anchor").where("anchor is not null").orderBy("anchor").limit(1).collect() if "anchor" in rows.columns else []
    return found[0]["anchor"] if found else None


def import_base(rows: DataFrame, base: str, anchor: str) -> DataFrame:
    """Rows with paths below ``base``, where the anchor file has been found under this name; an error if it isn't the collection's."""
    if (own := anchor_of(rows)) != anchor:
        raise ValueError(f"the collection's anchor is {own}, not {anchor}")
    return rows.withColumns({c: absolute(F.col(c), base) for c in PATHS if c in rows.columns}).drop("anchor")
