"""Line dedup by pairwise alignment: overlapping documents are found through shared line hashes, aligned with patience diff, and lose aligned blocks."""

from __future__ import annotations

from bisect import bisect_left
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscope.llm.common import cut, tidied

#: Words a common block must have to go. Two letters of a script that sets no spaces between words count as one.
BLOCK_WORDS = 5
#: Blanks that don't count at the end of a line.
ENDS = " \t\r"
# A word, BLOCK_WORDS words, and letters of scripts without spaces, as Java writes them.
WORD = r"[^ \t\n\x0B\f\r]+"
LONG = r"^[ \t\n\x0B\f\r]*(?:[^ \t\n\x0B\f\r]+[ \t\n\x0B\f\r]+){%d}[^ \t\n\x0B\f\r]" % (BLOCK_WORDS - 1)
UNSPACED = r"[\p{IsHan}\p{IsHiragana}\p{IsKatakana}\p{IsThai}\p{IsLao}\p{IsKhmer}\p{IsMyanmar}]"
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


def runs(lines: np.ndarray, words: np.ndarray, least: int = BLOCK_WORDS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(key, start, length) of the shortest runs of ``least`` words that begin or end at each line, each run once.

    Every line of a block of ``least`` words or more lies in such a run inside the block: in the one that begins there or, if
    too little follows, in the one that ends with the block. So texts have a common block if and only if they share a key, and
    the shared runs cover exactly the common blocks. Keys are polynomials over line hashes, from sums up to each line.
    """
    n = len(lines)
    upto = np.append(0, np.cumsum(words.astype(np.int64)))
    stop = np.searchsorted(upto, upto[:-1] + least)
    begin = np.searchsorted(upto, upto[1:] - least, "right") - 1
    start = np.append(np.arange(n)[stop <= n], begin[begin >= 0])
    end = np.append(stop[stop <= n], np.arange(1, n + 1)[begin >= 0])
    span = np.unique(start * (n + 1) + end)
    start, end = span // (n + 1), span % (n + 1)
    with np.errstate(over="ignore"):
        sums = np.append(np.uint64(0), np.add.accumulate(lines.view(np.uint64) * _powers(_BASE, n)))
        key = (sums[end] - sums[start]) * _powers(_INVERSE, n + 1)[start] + (end - start).astype(np.uint64)
        key ^= key >> np.uint64(31)
        key *= np.uint64(0xBF58476D1CE4E5B9)
        key ^= key >> np.uint64(29)
    return key.view(np.int64), start, end - start


def patience(shared: list[tuple[int, int, int]]) -> list[tuple[int, int, int, bool]]:
    """Aligned blocks (start in the later text, start in the earlier one, length, moved) of two texts with ``shared`` runs (start, earlier start, length).

    The longest chain of runs in order of both texts anchors the alignment; runs that touch on one diagonal are one block.
    What the chain leaves are blocks that moved or repeat: they are aligned with the same text on their own diagonals.
    """
    longest: dict[int, tuple[int, int]] = {}
    for j, i, n in shared:
        longest[j] = max(longest.get(j, (0, 0)), (n, -i))
    anchors = [(j, -i, n) for j, (n, i) in sorted(longest.items())]
    tails: list[int] = []
    ends: list[int] = []
    back: list[int] = []
    for k, (_, i, _) in enumerate(anchors):
        at = bisect_left(tails, i)
        back.append(ends[at - 1] if at else -1)
        if at == len(tails):
            tails.append(i)
            ends.append(k)
        else:
            tails[at], ends[at] = i, k
    chain, k = set(), ends[-1] if ends else -1
    while k >= 0:
        chain.add(anchors[k])
        k = back[k]
    out = _blocks(chain, False)
    held = defaultdict(list)
    for j, i, n, _ in out:
        held[j - i].append((j, j + n))
    loose = [x for x in shared if x not in chain and not any(a <= x[0] and x[0] + x[2] <= b for a, b in held.get(x[0] - x[1], ()))] if len(chain) < len(shared) else []
    return sorted(out + _blocks(loose, True))


def _blocks(found, moved: bool) -> list[tuple[int, int, int, bool]]:
    """Runs merged where they touch or overlap on one diagonal."""
    out: list[list[int]] = []
    for d, j, n in sorted((j - i, j, n) for j, i, n in found):
        if out and out[-1][0] == d and j <= out[-1][1] + out[-1][2]:
            out[-1][2] = max(out[-1][2], j + n - out[-1][1])
        else:
            out.append([d, j, n])
    return [(j, j - d, n, moved) for d, j, n in out]


def text_hash():
    return F.unhex(F.md5(F.coalesce(F.col("text").cast("string"), F.lit(""))))


def _weight(line):
    """Words of a line, counted up to BLOCK_WORDS."""
    few = F.regexp_count(line, F.lit(WORD)) + F.floor(F.regexp_count(line, F.lit(UNSPACED)) / 2)
    return F.when(F.regexp_like(line, F.lit(LONG)), F.lit(BLOCK_WORDS)).otherwise(F.least(few, F.lit(BLOCK_WORDS))).cast("int")


def texts_of(docs: DataFrame) -> DataFrame:
    """(h, doc_id, copies, lines, words): each distinct text with its first document, hashes and words of its lines, written once to the shared checkpoint folder."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_hash().alias("h"), F.split(text, "\n").alias("raw")).where("doc_id is not null")
    rows = rows.select("doc_id", "h", F.struct(F.transform("raw", lambda x: F.xxhash64(F.rtrim(x, F.lit(ENDS)))).alias("lines"), F.transform("raw", _weight).alias("words")).alias("l"))
    firsts = rows.groupBy("h").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies"), F.min_by("l", "doc_id").alias("l"))
    return cut(firsts.select("h", "doc_id", "copies", "l.lines", "l.words"))


def _posted(texts: DataFrame) -> DataFrame:
    """(key, doc_id, h, pos, n): the runs of every distinct text."""

    def over(batches):
        for batch in batches:
            lists = [batch.column(2), batch.column(3)]
            lines, words = (x.flatten().to_numpy(zero_copy_only=False) for x in lists)
            at = np.append(0, np.cumsum(np.asarray(lists[0].value_lengths())))
            found = [runs(lines[a:b], words[a:b]) for a, b in zip(at, at[1:], strict=False)]
            row = pa.array(np.repeat(np.arange(len(found)), [len(x[0]) for x in found]))
            key, pos, n = (np.concatenate([x[k] for x in found]) if found else np.empty(0, np.int64) for k in range(3))
            yield pa.RecordBatch.from_arrays([pa.array(key), batch.column(1).take(row), batch.column(0).take(row), pa.array(pos, pa.int32()), pa.array(n, pa.int32())], names=["key", "doc_id", "h", "pos", "n"])

    return texts.select("h", "doc_id", "lines", "words").mapInArrow(tidied(over), "key long, doc_id long, h binary, pos int, n int")


def aligned(texts: DataFrame) -> DataFrame:
    """(h, blocks): for each distinct text of ``texts_of`` that shares a run with an earlier one, its aligned blocks (start, n, first, first_start, moved).

    Each run of BLOCK_WORDS words or more meets the earliest text that holds it (``first``, a doc_id), however many do: runs that
    text shares are all aligned with it, so alignment with further holders would delete nothing more, and pairs grow with the
    rows. Exact copies never meet: they share one entry here. Earlier means a smaller doc_id; texts of one id don't meet.
    """
    posted = _posted(texts)
    firsts = posted.groupBy("key").agg(F.min(F.struct("doc_id", "pos")).alias("first"), F.max("doc_id").alias("last")).where("first.doc_id < last")
    # Cut, so that this side is dealt anew and the join may split the rows of a very frequent run over tasks.
    firsts = cut(firsts.select("key", F.col("first.doc_id").alias("first"), F.col("first.pos").alias("first_pos")))
    shared = posted.join(firsts, "key").where("doc_id > first").select("h", F.struct("first", "pos", "first_pos", "n").alias("run"))
    met = shared.groupBy("h").agg(F.collect_list("run").alias("runs"))

    def over(batches):
        kind = pa.list_(pa.struct([("start", pa.int32()), ("n", pa.int32()), ("first", pa.int64()), ("first_start", pa.int32()), ("moved", pa.bool_())]))
        for batch in batches:
            out = []
            for every in batch.column(1):
                by = defaultdict(list)
                for x in every.as_py():
                    by[x["first"]].append((x["pos"], x["first_pos"], x["n"]))
                out.append(sorted((j, n, first, i, moved) for first, own in by.items() for j, i, n, moved in patience(sorted(own))))
            blocks = pa.array([[dict(zip(("start", "n", "first", "first_start", "moved"), b, strict=True)) for b in x] for x in out], kind)
            yield pa.RecordBatch.from_arrays([batch.column(0), blocks], names=["h", "blocks"])

    return met.mapInArrow(tidied(over), "h binary, blocks array<struct<start:int,n:int,first:bigint,first_start:int,moved:boolean>>")


def deletions(texts: DataFrame) -> DataFrame:
    """(h, gone): the indexes of the lines in aligned blocks, ascending, by distinct text."""
    lines = F.flatten(F.transform("blocks", lambda b: F.sequence(b["start"], b["start"] + b["n"] - 1)))
    return aligned(texts).select("h", F.array_sort(F.array_distinct(lines)).alias("gone"))


def deduplicated(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` (doc_id, text, ...), all columns kept, with the duplicate lines gone from later documents' texts, and ``n_removed`` (int) and ``n_lines`` (int) added.

    A line goes if it is in a block of adjacent lines, of BLOCK_WORDS words or more in all, that an earlier document has as well
    (blanks at line ends don't count). The result is that of aligning all pairs of documents.
    Of exact copies all but the first lose every line; a copy of a text whose lines partly go anyway too. Null texts stay null
    and take no part; empty texts stay. A repeated row (same id and text) is a copy of the first of them only if ids differ;
    with the same id it is treated as the first is. Different texts of one id don't meet. Rows of a null id keep their text. No other column takes part; ``n_lines``
    and ``n_removed`` replace columns of those names. An empty table gives an empty result.
    """
    texts = texts_of(docs)
    found = deletions(texts).select(F.col("h").alias("__fs_h"), F.col("gone").alias("__fs_gone"))
    firsts = texts.where("copies > 1").select(F.col("h").alias("__fs_h"), F.col("doc_id").alias("__fs_first"))
    fate = cut(found.join(firsts, "__fs_h", "full"))  # cut: see ``aligned``
    joined = docs.withColumn("__fs_h", text_hash()).join(fate, "__fs_h", "left")
    text = F.col("text").cast("string")
    copy = F.col("__fs_first").isNotNull() & (F.col("doc_id") > F.col("__fs_first")) & (F.length(text) > 0)
    some = F.col("__fs_gone").isNotNull() & F.col("doc_id").isNotNull() & text.isNotNull()
    joined = joined.withColumn("__fs_lines", F.split(text, "\n")).withColumn("__fs_copy", F.coalesce(copy, F.lit(False)))
    total = F.coalesce(F.greatest(F.size("__fs_lines"), F.lit(0)), F.lit(0)).cast("int")
    # What stays are the runs of lines between deleted ones.
    runs = F.zip_with(
        F.concat(F.array(F.lit(-1)), F.col("__fs_gone")),
        F.concat(F.col("__fs_gone"), F.array(total)),
        lambda a, b: F.slice(F.col("__fs_lines"), a + 2, F.greatest(b - a - 1, F.lit(0))),
    )
    out = joined.withColumns({
        "n_lines": total,
        "n_removed": F.when(F.col("__fs_copy"), total).when(some, F.size("__fs_gone")).otherwise(0).cast("int"),
        "text": F.when(F.col("__fs_copy"), F.lit("")).when(some, F.array_join(F.flatten(runs), "\n")).otherwise(text),
    })
    return out.select(*[c for c in docs.columns if c not in ("n_lines", "n_removed")], "n_lines", "n_removed")


def sql(table: str = "documents") -> str:
    """doc_id, n_lines, n_removed and the digest of what stays, in DuckDB's SQL: every run of lines, as text, against the earliest text that holds it."""
    word, unspaced = r"[^ \t\n\x0B\f\r]+", r"[\p{Han}\p{Hiragana}\p{Katakana}\p{Thai}\p{Lao}\p{Khmer}\p{Myanmar}]"
    return f"""
WITH firsts AS (SELECT text, min(doc_id) AS doc_id, string_split(text, chr(10)) AS raw FROM (SELECT doc_id, coalesce(text, '') AS text FROM {table} WHERE doc_id IS NOT NULL) GROUP BY text),
texts AS (SELECT row_number() OVER () AS k, doc_id, text, raw, list_transform(raw, lambda x: rtrim(x, ' ' || chr(9) || chr(13))) AS xs FROM firsts),
lines AS (SELECT k, unnest(xs) AS x, generate_subscripts(xs, 1) AS p FROM texts),
weighed AS (SELECT k, p, least({BLOCK_WORDS}, len(regexp_extract_all(x, '{word}')) + len(regexp_extract_all(x, '{unspaced}')) // 2) AS w FROM lines),
summed AS (SELECT k, p, w, sum(w) OVER (PARTITION BY k ORDER BY p) AS upto FROM weighed),
spans AS (SELECT a.k, a.p AS s, min(b.p) AS e FROM summed a JOIN summed b ON a.k = b.k AND b.p >= a.p AND b.upto - a.upto + a.w >= {BLOCK_WORDS} GROUP BY a.k, a.p
  UNION SELECT b.k, max(a.p), b.p FROM summed a JOIN summed b ON a.k = b.k AND b.p >= a.p AND b.upto - a.upto + a.w >= {BLOCK_WORDS} GROUP BY b.k, b.p),
runs AS (SELECT k, doc_id, s, e, array_to_string(xs[s:e], chr(10)) AS run FROM spans JOIN texts USING (k)),
known AS (SELECT run, min(doc_id) AS low FROM runs GROUP BY run HAVING min(doc_id) < max(doc_id)),
gone AS (SELECT k, list(DISTINCT p) AS ps FROM (SELECT k, unnest(generate_series(s, e)) AS p FROM runs JOIN known USING (run) WHERE doc_id > low) GROUP BY k),
fate AS (SELECT text, texts.doc_id AS low, len(raw) AS n, coalesce(ps, []) AS ps, array_to_string(list_transform(list_filter(generate_series(1, len(raw)), lambda p: NOT list_contains(coalesce(ps, []), p)), lambda p: raw[p]), chr(10)) AS kept FROM texts LEFT JOIN gone USING (k))
SELECT d.doc_id, CAST(CASE WHEN d.text IS NULL THEN 0 ELSE len(string_split(d.text, chr(10))) END AS INTEGER) AS n_lines,
  CAST(CASE WHEN d.text IS NULL OR f.low IS NULL THEN 0 WHEN d.doc_id > f.low AND d.text <> '' THEN f.n ELSE len(f.ps) END AS INTEGER) AS n_removed,
  sha256(CASE WHEN d.text IS NULL OR f.low IS NULL THEN coalesce(d.text, '') WHEN d.doc_id > f.low THEN '' ELSE f.kept END) AS kept_sha256
FROM {table} d LEFT JOIN fate f ON d.doc_id IS NOT NULL AND coalesce(d.text, '') = f.text
"""
