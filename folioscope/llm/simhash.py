"""SimHash near-duplicates, with pigeonring pruning before the full Hamming check."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscope.llm.common import cut, tidied
from folioscope.llm.graph import components

SEED = 42
BITS = 64
SEGMENTS = 8
MAX_BITS = 3
CHUNK = 1 << 16
#: Values of one join key from which the key is split.
CROWD = 64
#: Crowded keys up to which they are broadcast (8 MB); more are joined by a shuffle.
FEW = 1 << 20
#: Bits of a key: its place in the ring and 32 bits of a fingerprint.
KEY_BITS = 37


def shingles(text: str | None, width: int = 3) -> Iterator[bytes]:
    """Word shingles of a text, A-Z lowered, in order, repeats included. Fewer words than ``width``: the whole sequence; no word: none."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: only A-Z and ASCII white space count
    if not words:
        return iter(())
    if len(words) < width:
        return iter((b" ".join(words),))
    return map(b" ".join, zip(*(words[i:] for i in range(width)), strict=False))


def digests(text: str | None, width: int = 3) -> np.ndarray:
    """The eight octets of each shingle's XXH64, a row each."""
    return np.frombuffer(b"".join(map(xxhash.xxh64_digest, shingles(text, width), repeat(SEED))), np.uint8).reshape(-1, 8)


def folded(octets: np.ndarray) -> int:
    """The bits that are set in over half of the rows of ``digests``; 0 without rows."""
    if not len(octets):
        return 0
    ones = sum(np.unpackbits(octets[k : k + CHUNK], axis=1).sum(axis=0, dtype=np.int64) for k in range(0, len(octets), CHUNK))
    return int.from_bytes(np.packbits(ones * 2 > len(octets)).tobytes(), "big")


def fingerprint(text: str | None, width: int = 3) -> int:
    """64-bit SimHash: a bit is 1 if it is set in over half of the shingles' XXH64. Null and wordless texts: 0."""
    return folded(digests(text, width))


def fingerprints(docs: DataFrame, width: int = 3) -> DataFrame:
    """(doc_id, fp long) of every row of ``docs``: whole texts, one Arrow batch at a time."""

    def over(batches):
        for batch in batches:
            fps = np.fromiter((fingerprint(x.as_py(), width) for x in batch.column(1)), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps.view(np.int64))], names=["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(tidied(over), "doc_id long, fp long")


def ring_budgets(segments: int, most: int) -> list[int]:
    """Largest cumulative difference of a chain's first 1, 2, ... segments, in proportion to its length."""
    return [n * most // segments for n in range(1, segments + 1)]


def _turned(x: str, start: str) -> str:
    """``x`` rotated so that segment ``start`` holds its lowest bits."""
    return f"(case when {start} = 0 then {x} else shiftrightunsigned({x}, 8 * {start}) | shiftleft({x}, 64 - 8 * {start}) end)"


def _viable(x: str, start: str) -> str:
    """SQL: the chain of ``x`` (the xor of two fingerprints) from segment ``start`` stays within every proportional budget.

    Sums over a chain never fall as it gets longer, so a budget is tested only at the last length that has it.
    """
    budgets, turned = ring_budgets(SEGMENTS, MAX_BITS), _turned(x, start)
    last = [n for n in range(1, SEGMENTS + 1) if n == SEGMENTS or budgets[n] > budgets[n - 1]]
    masks = {n: (1 << 8 * n) - 1 if n < SEGMENTS else -1 for n in last}
    return " and ".join(f"bit_count({turned} & {masks[n]}L) <= {budgets[n - 1]}" for n in last)


def links(fps: DataFrame) -> DataFrame:
    """(a, b) with a <> b: every pair of distinct values ``fp`` at 3 or fewer differing bits, once.

    Pigeonring: of the 8 segments of a linked pair's xor there is one from which every chain of consecutive segments has
    cumulative differences within its share of the 3 bits: none in the first two segments, one in the first five, two in the
    first seven. So the first two segments agree, and of the next three at least two do: 32 agreeing bits, in 24 possible
    places, are the join key. The chains are checked before the full distance, and a pair counts only at its first viable
    segment. Crowded keys are split (see ``_split``). ``fps`` must hold each value once, so exact copies never meet here; no
    cap on partners.
    """
    segment = [f"(shiftrightunsigned(fp, {8 * i}) & 255L)" for i in range(SEGMENTS)]
    keys = []
    for i in range(SEGMENTS):
        ring = [segment[(i + j) % SEGMENTS] for j in range(5)]
        for left_out in range(3):
            used = ring[:2] + [ring[2 + j] for j in range(3) if j != left_out]
            packed = " | ".join(f"shiftleft({s}, {8 * k})" for k, s in enumerate(used))
            keys.append(f"shiftleft({3 * i + left_out}L, 32) | {packed}")
    dealt = fps.select("fp", F.explode(F.expr(f"array({', '.join(keys)})")).alias("place"))
    dealt = _split(dealt)
    a, b = dealt.select(F.col("fp").alias("a"), "place"), dealt.select(F.col("fp").alias("b"), "place")
    # A segment left out that agrees does so in all three places: the first of them counts.
    own = " and ".join(f"({OUT} <> {k} or {k} = 0 or (shiftrightunsigned({_turned('(a ^ b)', START)}, {16 + 8 * k}) & 255L) <> 0)" for k in range(3))
    before = " and ".join(f"({START} <= {i} or not ({_viable('(a ^ b)', str(i))}))" for i in range(SEGMENTS - 1))
    first = " and ".join(f"(place >> {KEY_BITS} & 7L) <= {j + 1} or {_rest('(a ^ b)', j)} <> 0" for j in range(3)).replace(" and ", ") and (")
    pair = f"a < b and bit_count(a ^ b) <= {MAX_BITS} and {_viable('(a ^ b)', START)} and {own} and {before} and ({first})"
    joined = a.join(b, "place").where(F.expr(pair))
    return joined.select("a", "b")


#: SQL: of a key ``place``, the segment at which its chain starts, and which of the three after the first two is left out.
START = f"int(shiftrightunsigned(place & {(1 << KEY_BITS) - 1}L, 32) div 3)"
OUT = f"(shiftrightunsigned(place & {(1 << KEY_BITS) - 1}L, 32) % 3)"


def _rest(x: str, j: int) -> str:
    """SQL: the j-th of the four segments of ``x`` that are no part of the key ``place``: the one left out, and the last three of the ring."""
    shift = f"int(16 + 8 * {OUT})" if j == 0 else str(8 * (j + 4))
    return f"(shiftrightunsigned({_turned(x, START)}, {shift}) & 255L)"


def _split(dealt: DataFrame) -> DataFrame:
    """``dealt`` (fp, place) with keys of more than CROWD values split: of the four segments outside the key a linked pair differs in three at most, so it agrees in one.

    A value of a crowded key is dealt four times, by the key and one such segment each; a pair counts at the first that agrees.
    """
    crowded = cut(dealt.groupBy("place").agg(F.count("*").alias("k")).where(F.col("k") > CROWD).select("place"))
    n = crowded.count()
    if not n:
        return dealt
    crowded = F.broadcast(crowded) if n <= FEW else crowded
    finer = [f"place | shiftleft({j + 1}L, {KEY_BITS}) | shiftleft({_rest('fp', j)}, {KEY_BITS + 3})" for j in range(4)]
    split = dealt.join(crowded, "place", "left_semi").select("fp", F.explode(F.expr(f"array({', '.join(finer)})")).alias("place"))
    return dealt.join(crowded, "place", "left_anti").select("fp", "place").union(split)


def near_duplicates(docs: DataFrame, width: int = 3) -> DataFrame:
    """(doc_id, fingerprint, component_id, n_links) for every row of ``docs`` (doc_id, text).

    ``fingerprint`` is 16 lowercase hex digits; ``component_id`` the smallest doc_id reachable over links of 3 or fewer bits,
    the own one included; ``n_links`` the number of other fingerprint values linked to this one (copies aren't counted one by
    one). Null, empty and wordless texts have fingerprint zero and link like any other. Repeated rows stay, with one result
    each; a null doc_id is kept but names no component. Other columns are ignored. An empty table gives an empty result.
    """
    fps = cut(fingerprints(docs, width))
    values = cut(fps.groupBy("fp").agg(F.min("doc_id").alias("least")))
    edges = cut(links(values.select("fp")))
    ends = edges.select(F.col("a").alias("fp"), F.col("b").alias("other")).union(edges.select("b", "a"))
    degree = ends.groupBy("fp").agg(F.count("*").alias("n_links"))
    named = components(edges)
    # A component is named by fingerprint here; its smallest document follows by one more minimum.
    member = values.join(named.withColumnRenamed("node", "fp"), "fp", "left").join(degree, "fp", "left")
    member = cut(member.select("fp", "least", F.coalesce("component", "fp").alias("component"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links")))
    smallest = member.groupBy("component").agg(F.min("least").alias("component_id"))
    classes = member.join(smallest, "component").select("fp", "component_id", "n_links")
    return fps.join(classes, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", "n_links")
