"""Document fingerprints by consistent weighted sampling."""

from __future__ import annotations

import hashlib
import math
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscope.llm.common import parallelism, tidied

SAMPLES = 64
#: Words in a term. Terms are weighted by how often they occur.
WIDTH = 5
#: Quantiles in the tables of variates.
STEPS = 1 << 16
BLOCK = 256
#: Terms of a text up to which its costs are kept while the next text comes.
LONG = 1 << 16
EMPTY = "0" * (4 * SAMPLES)


@lru_cache(maxsize=1)
def _variates() -> tuple[np.ndarray, np.ndarray]:
    """Quantiles of Gamma(2, 1) and their logarithms, at the middles of STEPS equal shares."""
    u = (np.arange(STEPS) + 0.5) / STEPS
    low, high = np.zeros(STEPS), np.full(STEPS, 60.0)
    for _ in range(60):
        x = (low + high) / 2
        below = 1 - np.exp(-x) * (1 + x) < u
        low, high = np.where(below, x, low), np.where(below, high, x)
    x = (low + high) / 2
    return x.astype(np.float32), np.log(x).astype(np.float32)


@lru_cache(maxsize=1)
def _seeds() -> np.ndarray:
    return np.frombuffer(b"".join(hashlib.blake2b(b"cws%d" % k, digest_size=4).digest() for k in range(SAMPLES)), np.uint32)


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(map(xxhash.xxh64_digest, words)), np.uint64)


def words_of(text: str | None) -> list[bytes]:
    """Words between ASCII white space, A-Z lowered."""
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def runs(words: np.ndarray, width: int = WIDTH) -> np.ndarray:
    """64-bit names of the runs of ``width`` words, in order, repeats included. Fewer words: the whole sequence; none: none."""
    width = min(width, len(words))
    if not width:
        return np.empty(0, np.uint64)
    n = len(words) - width + 1
    out = np.zeros(n, np.uint64)
    for i in range(width):
        out *= np.uint64(0x9E3779B97F4A7C15)
        out += words[i : i + n]
    out ^= out >> np.uint64(32)
    out *= np.uint64(0xBF58476D1CE4E5B9)
    out ^= out >> np.uint64(29)
    return out


def _draw(names: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A 32-bit number for every name and sample; its halves pick r and c, and another one b, from the unit interval."""
    x = (names & np.uint64(0xFFFFFFFF)).astype(np.uint32)[:, None] ^ _seeds()
    x *= np.uint32(0x85EBCA6B)
    x ^= x >> np.uint32(15)
    x += (names >> np.uint64(32)).astype(np.uint32)[:, None]
    x *= np.uint32(0xC2B2AE35)
    x ^= x >> np.uint32(14)
    b = x * np.uint32(0x27D4EB2F)
    b >>= np.uint32(8)
    b = b.astype(np.float32)
    b *= np.float32(2.0**-24)
    return x, b


def costs(names: np.ndarray, weights: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray | None]:
    """ln cost of every term and sample, and t (None: 0 everywhere, as ln(1) is 0, for weights of 1)."""
    gamma, logarithm = _variates()
    cost = np.empty((len(names), SAMPLES), np.float32)
    ts = None if weights is None else np.empty((len(names), SAMPLES), np.float32)
    for a in range(0, len(names), BLOCK):
        x, b = _draw(names[a : a + BLOCK])
        at = np.right_shift(x, np.uint32(16), dtype=np.uint32).astype(np.intp)
        r = gamma.take(at, mode="clip")
        np.bitwise_and(x, np.uint32(0xFFFF), out=at, casting="unsafe")
        logarithm.take(at, mode="clip", out=cost[a : a + BLOCK])
        if ts is None:
            np.subtract(np.float32(1), b, out=b)
        else:
            t = np.floor(np.log(weights[a : a + BLOCK]).astype(np.float32)[:, None] / r + b, out=ts[a : a + BLOCK])
            b = t - b + np.float32(1)
        r *= b
        cost[a : a + BLOCK] -= r
    return cost, ts


def signature(names: np.ndarray, rows: np.ndarray | None = None) -> np.ndarray | None:
    """SAMPLES 16-bit codes of a multiset of terms; None for an empty one. ``rows``: the names' costs at weight 1, if known.

    Two multisets share a code with the probability of their generalised Jaccard similarity (and 1 in 65,536 by chance). For
    every term and sample, its name alone gives r and c from Gamma(2, 1) and b from the unit interval. With
    t = floor(ln(weight) / r + b) the term's cost is c * exp(-r * (t - b + 1)); the cheapest term and its t are the sample.
    """
    if not len(names):
        return None
    every = np.arange(SAMPLES)
    distinct, first, n = np.unique(names, return_index=True, return_counts=True)
    best, term, level = np.full(SAMPLES, np.inf, np.float32), np.zeros(SAMPLES, np.uint64), np.zeros(SAMPLES, np.float32)
    for repeated in (False, True):
        own = np.flatnonzero((n > 1) == repeated)
        for a in range(0, len(own), LONG):
            part = own[a : a + LONG]
            if repeated or rows is None:
                cost, t = costs(distinct[part], n[part] if repeated else None)
            else:
                cost, t = rows[first[part]], None
            at = cost.argmin(axis=0)
            less = cost[at, every]
            # Equal costs: the term of the smaller name, in whatever order the parts come.
            better = (less < best) | ((less == best) & (distinct[part][at] < term))
            best = np.where(better, less, best)
            term = np.where(better, distinct[part][at], term)
            level = np.where(better, 0 if t is None else t[at, every], level)
    code = term ^ (level.astype(np.int64).astype(np.uint64) * np.uint64(0x94D049BB133111EB))
    code ^= code >> np.uint64(31)
    code *= np.uint64(0xD6E8FEB86659FD93)
    return (code >> np.uint64(48)).astype(np.uint16)


def fingerprint(text: str | None, width: int = WIDTH) -> np.ndarray | None:
    """Signature of a text; None for one without words."""
    return signature(runs(word_hashes(words_of(text)), width))


class Drawn:
    """A text's words, terms, costs (of texts up to LONG words) and signature."""

    def __init__(self, text: str, width: int):
        self.text, self.width = text, width
        self.words = word_hashes(words_of(text))
        self.names = runs(self.words, width)
        self.rows = costs(self.names)[0] if 0 < len(self.names) <= LONG else None
        self.signature = signature(self.names, self.rows)

    def edited(self, cut: int, other: Drawn, taken: int) -> np.ndarray | None:
        """Signature of text[:cut] + other.text[:taken], with the terms that it shares with either text drawn only once."""
        a, b = self.text[:cut].encode("utf-8", "surrogatepass").lower(), other.text[:taken].encode("utf-8", "surrogatepass").lower()
        first, second, width = a.split(), b.split(), self.width
        p, q = len(first) - 1, len(second) - 1  # words before the last of the one, after the first of the other
        if min(p, q - 1) < width or self.rows is None or other.rows is None:
            return signature(runs(word_hashes((a + b).split()), width))
        seam = [first[-1] + second[0]] if a[-1:].strip() and b[:1].strip() else [first[-1], second[0]]
        # The last word of the second part may be cut, so the terms that hold it are drawn anew, as are those over the seam.
        middle = np.concatenate([self.words[p - width + 1 : p], word_hashes(seam), other.words[1:width]])
        end = np.concatenate([other.words[q - width + 1 : q], word_hashes(second[-1:])])
        new = [runs(middle, width), runs(end, width)]
        drawn = costs(np.concatenate(new))[0]
        k, m = len(new[0]), q - width
        names = np.concatenate([self.names[: p - width + 1], new[0], other.names[1 : 1 + m], new[1]])
        return signature(names, np.concatenate([self.rows[: p - width + 1], drawn[:k], other.rows[1 : 1 + m], drawn[k:]]))


def likeness(a: np.ndarray | None, b: np.ndarray | None) -> float:
    """Share of equal codes, the estimate of the generalised Jaccard similarity. Two wordless texts are alike, one alone isn't like any other."""
    if a is None or b is None:
        return float(a is b)
    return float((a == b).mean())


def hexed(a: np.ndarray | None) -> str:
    return EMPTY if a is None else a.astype(">u2").tobytes().hex()


def fingerprints(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """(doc_id, fingerprint) of every row of ``docs`` (doc_id, text): 64 codes of 4 hex digits. Null and wordless texts: zeros."""

    def over(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([hexed(fingerprint(x.as_py(), width)) for x in batch.column(1)], pa.string())], names=["doc_id", "fingerprint"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(tidied(over), "doc_id long, fingerprint string")


def _place(value: Column, bounds: list[int]) -> Column:
    """How many of the sorted bounds are below a value: first among every k-th, then among the k from there, with k the root of their number."""
    if not bounds:
        return F.lit(0)
    k = math.isqrt(len(bounds) - 1) + 1
    below = lambda some: F.size(F.filter(some, lambda b: b < value))
    every, coarse = F.array(*map(F.lit, bounds)), F.array(*map(F.lit, bounds[::k]))
    block = F.greatest(below(coarse) - 1, F.lit(0)) * k
    return block + below(F.slice(every, block + 1, F.lit(k)))


def _dealt(docs: DataFrame) -> DataFrame:
    """``docs`` (doc_id, text) in ranges of ids, a task each, in descending order, with the first row of the next range at the end (``extra``).

    One shuffle of the texts. Bounds come from quantiles of the ids, and from each range's largest id: as many values as there are tasks.
    An id that is several quantiles at once, and null ids, have several ranges, by a hash of the text.
    """
    spark = docs.sparkSession
    n = parallelism(spark)
    ids = docs.select("doc_id").where("doc_id is not null")
    found = list(map(int, ids.approxQuantile("doc_id", [i / n for i in range(1, n)], max(1e-5, 0.1 / n))))
    bounds = sorted(set(found))
    n_rows, n_nulls = docs.agg(F.count("*"), F.count_if(F.col("doc_id").isNull())).first()
    # Ranges by number, from the last to be read: those of null ids, then for each place its ids and, above them, its bound's shares.
    nulls = -(-n_nulls * n // max(1, n_rows))
    shares = [found.count(b) if found.count(b) > 1 else 0 for b in bounds] + [0]
    start = [nulls + sum(shares[:k]) + k for k in range(len(shares))]
    of = lambda values: F.element_at(F.array(*map(F.lit, values)), F.col("place") + 1)
    bucket = lambda m: F.pmod(F.xxhash64("text"), F.greatest(m, F.lit(1)))
    share = F.when(F.col("doc_id") == of([*bounds, None] if bounds else [0]), of(shares)).otherwise(0)
    split = F.col("doc_id").isNull() | (share > 0)
    spot = F.when(F.col("doc_id").isNull(), nulls - 1 - bucket(F.lit(nulls))).when(share > 0, of(start) + share - bucket(share)).otherwise(of(start))
    rows = docs.withColumn("place", F.coalesce(_place(F.col("doc_id"), bounds).cast("int"), F.lit(0)))
    rows = rows.select("doc_id", "text", spot.cast("int").alias("spot"), F.coalesce(split, F.lit(False)).alias("split"))
    tops = sorted((r["spot"], r["split"], r["top"]) for r in rows.groupBy("spot", "split").agg(F.max("doc_id").alias("top")).collect())
    if not tops:
        return docs.select("doc_id", "text", F.lit(0).alias("spot"), F.lit(False).alias("extra"))
    # The range above gets the row too; the first of all goes to the lowest range, as the last document's next is the first.
    above = {spot: tops[(i + 1) % len(tops)][0] for i, (spot, _, _) in enumerate(tops)}
    first = F.broadcast(spark.createDataFrame([(top, above[s]) for s, shared, top in tops if not shared], "top long, above int"))
    next_of = F.broadcast(spark.createDataFrame([(s, above[s]) for s, shared, _ in tops if shared], "spot int, above int"))
    ends = docs.join(first, F.col("doc_id") == F.col("top")).select("doc_id", "text", F.col("above").alias("spot"), F.lit(True).alias("extra"))
    least = rows.where("split").groupBy("spot").agg(F.max("doc_id").alias("doc_id"), F.min("text").alias("text"))
    more = least.join(next_of, "spot").select("doc_id", "text", F.col("above").alias("spot"), F.lit(True).alias("extra"))
    return rows.select("doc_id", "text", "spot", F.lit(False).alias("extra")).unionByName(ends).unionByName(more)


def with_edits(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next) for every row of ``docs`` (doc_id, text).

    The edited text replaces the last floor(n_chars / 2) code points by the first as many (or all) of the next document's, in
    descending order of doc_id; the last one's next is the first. Rows of one id are ordered by text, or, where they fill whole
    ranges, by a hash of it first; null ids come last. A null text is empty. A table of one row is its own next. Other columns are ignored; an empty table gives an empty result.
    """
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    n = parallelism(docs.sparkSession)
    order = ["spot", F.col("extra"), F.col("doc_id").desc_nulls_last(), "text"]
    dealt = _dealt(texts).repartitionById(n, "spot").sortWithinPartitions(*order)

    def rows(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                yield [batch.column(i)[k].as_py() for i in range(4)]

    def over(batches):
        held, first, out = None, None, []
        # Rows of a range, then its extra row, of which there is one (or, for repeated ids, the first counts).
        for doc_id, text, spot, extra in rows(batches):
            own = Drawn(text, width)
            if held is not None:
                # Only a table of nothing but null ids has a range without a row after its last: its first row is that.
                out.append(result(held, own if held[2] == spot else first))
            if first is None or held is None or held[2] != spot:
                first = own
            held = None if extra else (doc_id, own, spot)
            if len(out) >= 2000:
                yield packed(out)
                out = []
        if held is not None:
            out.append(result(held, first))
        yield packed(out)

    def result(held, other):
        doc_id, own, _ = held
        half = len(own.text) // 2
        edited = own.text[: len(own.text) - half] + other.text[:half]
        changed = own.signature if edited == own.text else own.edited(len(own.text) - half, other, half)
        sha = hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest()
        return doc_id, len(own.text), sha, hexed(own.signature), hexed(changed), likeness(own.signature, changed), likeness(own.signature, other.signature)

    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]

    def packed(out):
        columns = list(zip(*out, strict=True)) or [[]] * len(kinds)
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)

    return dealt.mapInArrow(tidied(over), "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
