"""Collections as a tree of entries: every file under a directory or link, at any depth."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscope.operators.shared import held

#: Columns of a tree's entries: directories, symbolic links and files; a root has no parent.
ENTRY = "id string, parent string, kind string, name string"


def flatten(entries: DataFrame) -> DataFrame:
    """(id, root, root_kind, link, depth, path) of every file of a tree (see ENTRY) that hangs on a root, at any depth.

    ``path`` is made of the names from the root on; ``link`` is the nearest symbolic link above the file, null if there is none;
    a root's depth is 0, and a file without a parent is its own root. Each round doubles what every entry knows of the way up, so
    the rounds grow with the logarithm of the depth, and an entry with very many children is one key of a join whose other side
    is unique. Entries on a cycle, below one, or below a missing parent hang on no root: they never arrive, and the rounds end when
    none arrives any more. Of entries with the same id the smallest counts. Null ids are ignored; an empty table gives none.
    """
    one = held(entries.where("id is not null").groupBy("id").agg(F.min(F.struct("parent", "kind", "name")).alias("e")).select("id", "e.*"))
    reached = _risen(one.select("id", "parent"))  # numbers first: names on a cycle would grow without end
    files = _risen(one.join(reached.select("id"), "id", "left_semi")).where("kind = 'file'")
    roots = one.where("parent is null").select(F.col("id").alias("up"), F.col("kind").alias("root_kind"))
    return files.join(roots, "up").select("id", F.col("up").alias("root"), "root_kind", "link", "depth", F.col("names").alias("path"))


def _risen(entries: DataFrame) -> DataFrame:
    """The entries that hang on a root (``up``), with their depth and, where they have names, the names on the way, and the nearest link above."""
    named = "name" in entries.columns
    start = entries.select("id", F.coalesce("parent", "id").alias("up"), F.col("parent").isNull().alias("done"), F.when(F.col("parent").isNull(), 0).otherwise(1).alias("depth"), *(["kind", F.coalesce("name", F.lit("")).alias("names"), F.lit(None).cast("string").alias("link")] if named else []))
    nodes, before = held(start), -1
    while (n := nodes.where("done").count()) > before:
        before = n
        more = [F.col("names").alias("more_names"), F.coalesce(F.when(F.col("kind") == "symlink", F.col("id")), "link").alias("more_link")] if named else []
        above = nodes.select(F.col("id").alias("up"), F.col("up").alias("next"), F.col("done").alias("arrives"), F.col("depth").alias("more"), *more)
        own = ["kind", F.concat_ws("/", "more_names", "names").alias("names"), F.coalesce("link", "more_link").alias("link")] if named else []
        moved = nodes.where("not done and up <> id").join(above, "up").select("id", F.col("next").alias("up"), F.col("arrives").alias("done"), (F.col("depth") + F.col("more")).alias("depth"), *own)
        nodes = held(nodes.where("done").unionByName(moved))
    return nodes.where("done")


def flatten_sql(entries: str) -> str:
    """The same as a recursive query, from the roots down, for engines that run it on one machine."""
    return f"""
WITH RECURSIVE one AS (SELECT * FROM {entries}),
t AS (
  SELECT id, id AS root, kind AS root_kind, CASE WHEN kind = 'symlink' THEN id END AS link, 0 AS depth, name AS path, kind FROM one WHERE parent IS NULL
  UNION ALL
  SELECT e.id, t.root, t.root_kind, CASE WHEN e.kind = 'symlink' THEN e.id ELSE t.link END, t.depth + 1, concat(t.path, '/', e.name), e.kind FROM t JOIN one e ON e.parent = t.id)
SELECT id, root, root_kind, link, depth, path FROM t WHERE kind = 'file'
"""
