"""Links between texts by Jaccard similarity of word shingles: an exact set join with prefix, size and position filters."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscope.llm.common import clean_up, cut_small, hand_back, tidied
from folioscope.llm.graph import components
from folioscope.llm.simhash import SEED, digests, folded, links

WIDTH = 5
#: Holders in a sample of one text in RATE from which a shingle counts as common. That only orders shingles: any order gives the same pairs.
HOT = 3
RATE = 16
#: Looks at the sample for common shingles; each may find some that the one before moved up.
ROUNDS = 3
#: Bits of the table of common shingles, two for each; its size is fixed.
BITS = 25
#: 64-bit segments of a set's odd sketch.
SEGMENTS = 16
#: Holders of a shingle up to which its pairs are few; those of more holders carry their sketches into the join.
SOME = 8
#: Rows of a few numbers up to which they are broadcast: about 50 MB. More are joined by a shuffle.
FEW = 1 << 20


def shingle_set(octets: np.ndarray) -> np.ndarray:
    """The distinct hashes of a text's shingles, ascending."""
    return np.unique(octets.reshape(-1).view(">u8").astype(np.uint64))


def _rows(docs: DataFrame) -> DataFrame:
    """(doc_id, h, text), with a hash of the text."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), row_hash().alias("h"), F.col("text").cast("string").alias("text"))


def row_hash():
    """What tells different texts of one id apart; a null text has its own."""
    return F.unhex(F.md5(F.coalesce(F.concat(F.lit("t"), F.col("text").cast("string")), F.lit(""))))


def _long(values) -> pa.Array:
    return pa.array(np.array(values, np.uint64).view(np.int64))


def name_of(own: np.ndarray) -> int:
    """Hash of a whole set."""
    return xxhash.xxh64_intdigest(own.tobytes(), SEED)


def odd_sketch(own: np.ndarray) -> np.ndarray:
    """SEGMENTS 64-bit words; each member of a set turns one bit. Two sets' sketches differ in no more bits than members are in just one of them."""
    at = (own >> np.uint64(20)) & np.uint64(64 * SEGMENTS - 1)
    odd = np.bincount(at.astype(np.int64), minlength=64 * SEGMENTS) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.int64)


def shingled(rows: DataFrame, width: int) -> DataFrame:
    """(doc_id, h, fp, sig, n, odd) of every row: SimHash, hash, size and odd sketch of the shingle set.

    The members themselves aren't kept: ``_posted`` and ``_alike`` make them again where they are asked for.
    """

    def over(batches):
        for batch in batches:
            fps, sigs, sizes, odd = [], [], [], []
            for x in batch.column(2):
                octets = digests(x.as_py(), width)
                own = shingle_set(octets)
                fps.append(folded(octets))
                sigs.append(name_of(own))
                sizes.append(len(own))
                odd.append(odd_sketch(own))
            columns = [batch.column(0), batch.column(1), _long(fps), _long(sigs), pa.array(sizes, pa.int32()), pa.array(odd, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "h", "fp", "sig", "n", "odd"])

    return rows.mapInArrow(tidied(over), "doc_id long, h binary, fp long, sig long, n int, odd array<long>")


def _posted(rows: DataFrame, width: int, common=None) -> DataFrame:
    """(x, sig, n, pos, late): the first n - ceil(0.8 n) + 1 shingles of each set, common ones (``late``) last. A set that a task meets again isn't listed again."""

    def over(batches):
        met: set[int] = set()
        for batch in batches:
            found = []
            for x in batch.column(0):
                own = shingle_set(digests(x.as_py(), width))
                sig = name_of(own)
                if sig in met or not len(own):
                    continue
                met.add(sig)
                flags = np.zeros(len(own), np.bool_) if common is None else flagged(common.value, own)
                order = np.argsort(flags, kind="stable")[: len(own) - (4 * len(own) + 4) // 5 + 1]
                found.append((own[order], np.full(len(order), sig, np.uint64), np.full(len(order), len(own), np.int32), np.arange(len(order), dtype=np.int32), flags[order]))
            if found:
                xs, sigs, n, pos, late = (np.concatenate(c) for c in zip(*found, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(xs.view(np.int64)), pa.array(sigs.view(np.int64)), pa.array(n), pa.array(pos), pa.array(late)], names=["x", "sig", "n", "pos", "late"])

    return rows.select("text").mapInArrow(tidied(over), "x long, sig long, n int, pos int, late boolean")


def flagged(table: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Which hashes have both their bits set: all that were put in, and few others."""
    x = hashes.view(np.uint64)
    bit = lambda at: (table[at >> np.uint64(6)] >> (at & np.uint64(63))) & np.uint64(1)
    return (bit(x >> np.uint64(64 - BITS)) & bit(x & np.uint64((1 << BITS) - 1))).astype(np.bool_)


def common_shingles(rows: DataFrame, width: int):
    """A bit table of the shingles that HOT or more texts of a sample have among their first ones, as a broadcast variable; None without any.

    Sums and bits are combined before the shuffle, and 2 ** BITS bits at most reach the driver.
    """
    spark, table, held = rows.sparkSession, np.zeros(1 << (BITS - 6), np.uint64), None
    sample = rows.where(F.pmod(F.xxhash64("h"), F.lit(RATE)) == 0)
    for _ in range(ROUNDS):
        seen = _posted(sample, width, held).where("not late").groupBy("x").agg(F.count("*").alias("k"))
        often = seen.where(F.col("k") >= HOT)
        bits = often.select(F.explode(F.expr(f"array(shiftrightunsigned(x, {64 - BITS}), x & {(1 << BITS) - 1}L)")).alias("at"))
        words = bits.groupBy(F.shiftright("at", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, int(at & 63))")).alias("bits")).toArrow()
        if not words.num_rows:
            break
        table[words["word"].to_numpy()] |= words["bits"].to_numpy().view(np.uint64)
        held = spark.sparkContext.broadcast(table.copy())
    del table
    hand_back()
    return held


def _members(rows: DataFrame, width: int) -> DataFrame:
    """(sig, hashes): the whole shingle sets of ``rows`` (sig, text)."""

    def over(batches):
        for batch in batches:
            hashes = [shingle_set(digests(x.as_py(), width)).view(np.int64) for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(hashes, pa.list_(pa.int64()))], names=["sig", "hashes"])

    return rows.select("sig", "text").mapInArrow(tidied(over), "sig long, hashes array<long>")


def _near(a: str, b: str) -> str:
    """SQL: the odd sketches of two sets differ in no more bits than sets of similarity 0.8 do, segment after segment added up."""
    bits = " + ".join(f"bit_count({a}.odd[{k}] ^ {b}.odd[{k}])" for k in range(SEGMENTS))
    return f"9 * ({bits}) <= {a}.n + {b}.n"


def _alike(pairs: DataFrame, sets: DataFrame, rows: DataFrame, width: int) -> DataFrame:
    """(a, b) of ``pairs`` whose whole shingle sets have a Jaccard similarity of 0.8 or more.

    At that similarity, (n + m) / 9 members at most are in just one of the sets, so odd sketches that differ in more bits tell a
    pair apart. For the pairs that are left, the whole sets are made anew, from a text of each, and compared.
    """
    pairs = cut_small(pairs.where("a <> b").distinct())
    own = cut_small(sets.join(pairs.select(F.col("a").alias("sig")).union(pairs.select("b")).distinct(), "sig", "left_semi").groupBy("sig").agg(F.min(F.struct("h", "n", "odd")).alias("r")).select("sig", "r.*"))
    side = lambda x: own.select(F.col("sig").alias(x), F.struct("n", "odd").alias(f"of_{x}"))
    pairs = cut_small(pairs.join(side("a"), "a").join(side("b"), "b").where(_near("of_a", "of_b")).select("a", "b"))
    asked = cut_small(own.select("sig", "h").join(pairs.select(F.col("a").alias("sig")).union(pairs.select("b")).distinct(), "sig", "left_semi"))
    few = asked.count() <= FEW
    texts = rows.select("h", "text").join(F.broadcast(asked) if few else asked, "h")
    # Copies of a text that stands for a set give the set again: one is kept.
    held = _members(texts, width).groupBy("sig").agg(F.first("hashes").alias("hashes"))
    a, b = held.select(F.col("sig").alias("a"), F.col("hashes").alias("x")), held.select(F.col("sig").alias("b"), F.col("hashes").alias("y"))
    both = pairs.join(a, "a").join(b, "b").withColumn("k", F.size(F.array_intersect("x", "y")))
    return cut_small(both.where("9 * k >= 4 * (size(x) + size(y))").select("a", "b"))


def _ordered(a: str, b: str) -> list:
    return [F.least(a, b).alias("a"), F.greatest(a, b).alias("b")]


def _near_fingerprints(sets: DataFrame) -> DataFrame:
    """(a, b): pairs of sets whose SimHashes pigeonring links, or which have one SimHash; one set stands for all of a SimHash."""
    own = cut_small(sets.where("n > 0").groupBy("fp", "sig").agg(F.first("n").alias("n")))
    first = cut_small(own.groupBy("fp").agg(F.min("sig").alias("hub")))
    a, b = first.select(F.col("fp").alias("a"), F.col("hub").alias("x")), first.select(F.col("fp").alias("b"), F.col("hub").alias("y"))
    linked = links(first.select("fp")).join(a, "a").join(b, "b").select(*_ordered("x", "y"))
    return linked.union(own.join(first, "fp").select(*_ordered("sig", "hub")))


def classes(sets: DataFrame, rows: DataFrame, width: int) -> DataFrame:
    """(sig, component): the sets of ``shingled`` that chains of pairs of similarity 0.8 or more join; sets alike no other have no row.

    Candidates come first from SimHashes linked by pigeonring. What their budget of bits loses is found by an exact join: two
    such sets share a shingle among the first n - ceil(0.8 n) + 1 of the larger one and the first n - ceil(8/9 n) + 1 of the
    smaller one, whatever the common order, and at the first one they share the rest of both is long enough. There each set
    first meets, for each such shingle, one holder of it, chosen by a hash that differs by shingle; then every pair that shares
    a shingle and isn't in one component yet is compared. Every candidate is checked on its whole sets. So no pair is lost, and
    a large group of copies isn't squared.
    """
    # Dealt once by shingle for all that follows; sets that several tasks have met count once then.
    posted = _posted(rows, width, common_shingles(rows, width)).select("x", "sig", "n", "pos").repartition("x")
    posted = posted.groupBy("x", "sig").agg(F.first("n").alias("n"), F.first("pos").alias("pos"))
    held = posted.groupBy("x").agg(F.count("*").alias("k"), F.min_by(F.struct("sig", "n", "pos"), F.xxhash64("sig", "x")).alias("hub")).where("k > 1")
    posted = cut_small(posted.join(held, "x").select("x", "sig", "n", "pos", "k", "hub"))
    del held
    clean_up(rows.sparkSession)
    stars = posted.where(F.expr("sig <> hub.sig and 9 * least(n - pos, hub.n - hub.pos) >= 4 * (n + hub.n)"))
    first = components(_alike(stars.select(*_ordered("sig", "hub.sig")).union(_near_fingerprints(sets)), sets, rows, width)).select(F.col("node").alias("sig"), "component")
    clean_up(rows.sparkSession)
    own = cut_small(posted.join(first, "sig", "left").select("x", "sig", "n", "pos", "k", F.coalesce("component", "sig").alias("c")))
    # Shingles whose holders are all in one component have no pair left.
    open_ = own.groupBy("x").agg(F.min("c").alias("low"), F.max("c").alias("high")).where("low <> high").select("x")
    own = own.join(open_, "x", "left_semi")
    many = own.where(F.col("k") > SOME)
    sketches = sets.select("sig", "odd").join(many.select("sig").distinct(), "sig", "left_semi").groupBy("sig").agg(F.first("odd").alias("odd"))
    many = cut_small(many.join(sketches, "sig"))

    def pairs(rows: DataFrame, test: str) -> DataFrame:
        p, q = rows.alias("p"), rows.where("pos < n - ceil(8 * n / 9) + 1").alias("q")
        pair = f"p.c <> q.c and (q.n, q.sig) < (p.n, p.sig) and 9 * least(p.n - p.pos, q.n - q.pos) >= 4 * (p.n + q.n) and {test}"
        return p.join(q, F.expr(f"p.x = q.x and {pair}")).select(*_ordered("p.sig", "q.sig"))

    rest = _alike(pairs(own.where(F.col("k") <= SOME), "true").union(pairs(many, _near("p", "q"))), sets, rows, width)
    del stars, posted, own, many, sketches, open_
    clean_up(rows.sparkSession)
    # The components that the rest joins: named by what they were called before.
    name = first.withColumnRenamed("component", "c")
    ends = rest.join(name.withColumnRenamed("sig", "a").withColumnRenamed("c", "ca"), "a", "left").join(name.withColumnRenamed("sig", "b").withColumnRenamed("c", "cb"), "b", "left")
    ends = cut_small(ends.select("a", "b", F.coalesce("ca", "a").alias("ca"), F.coalesce("cb", "b").alias("cb")))
    joined = components(ends.select(F.col("ca").alias("a"), F.col("cb").alias("b"))).select(F.col("node").alias("c"), "component")
    every = name.union(ends.select("a", "ca")).union(ends.select("b", "cb")).distinct()
    return every.join(joined, "c", "left").select("sig", F.coalesce("component", "c").alias("component"))


def near_copies(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """(doc_id, h, component, first_id, first_h) for every row of ``docs`` (doc_id, text): rows that chains of pairs of similarity 0.8 or more join have one component.

    Similarity is the Jaccard similarity of the sets of ``width``-word shingles (see ``simhash.shingles``). Equal sets are
    alike; wordless, empty and null texts have the empty set. ``h`` tells different texts of one id apart. ``first_id`` and
    ``first_h`` name the component's first text: the smallest doc_id, nulls last, then the smallest ``h``. Repeated rows and
    null ids have a row each; an empty table gives an empty result; other columns are ignored.
    """
    texts = _rows(docs)
    sets = cut_small(shingled(texts, width))
    rows = cut_small(sets.join(classes(sets, texts, width), "sig", "left").select("doc_id", "h", F.coalesce("component", "sig").alias("component")))
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "h")
    firsts = cut_small(rows.groupBy("component").agg(F.min(order).alias("f")).select("component", F.col("f.doc_id").alias("first_id"), F.col("f.h").alias("first_h")))
    return rows.join(firsts, "component").select("doc_id", "h", "component", "first_id", "first_h")


def one_of_each(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """The rows of ``docs`` (doc_id, text, ...) without near copies: one row of each component of ``near_copies`` stays, its first; all columns are kept."""
    found = near_copies(docs, width)
    keep = found["doc_id"].eqNullSafe(found["first_id"]) & (found["h"] == found["first_h"])
    fate = found.groupBy("doc_id", "h").agg(F.max(keep).alias("__fs_keep"), F.count("*").alias("__fs_n"))
    fate = cut_small(fate.where("not __fs_keep or __fs_n > 1").select(F.col("doc_id").alias("__fs_id"), F.col("h").alias("__fs_h"), "__fs_keep"))
    # Few enough to be broadcast, fates spare the texts a shuffle; else both sides are dealt by key.
    fate = F.broadcast(fate) if fate.count() <= FEW else fate
    rows = docs.withColumn("__fs_own", row_hash())
    here = rows["doc_id"].cast("long").eqNullSafe(fate["__fs_id"]) & (rows["__fs_own"] == fate["__fs_h"])
    once = rows.join(fate, here, "left_anti").select(*docs.columns)
    # Of a kept row that stands there more than once, one: combined before the shuffle.
    again = rows.join(fate.where("__fs_keep"), here, "left_semi")
    again = again.groupBy("doc_id", "__fs_own").agg(F.first(F.struct(*docs.columns)).alias("r")).select("r.*")
    return once.unionByName(again)
