"""Phrase collocations: candidates from a sketch's upper bounds, counted by automata over shards of text."""

from __future__ import annotations

import re
import string
from collections.abc import Iterator
from itertools import pairwise
from operator import itemgetter
from typing import NamedTuple

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from folioscope.llm.common import cut, hand_back, parallelism, tidied

UNKNOWN = "und"
LONGEST = 3
LEAST = 10
TOP = 2000
INSIDE = 50
#: Words of a shard: what one automaton is made from and read against; and how many times that the open shards of all languages hold.
SHARD_WORDS, HELD = 3 << 19, 4
#: Bytes of text that are cut into words at a time; texts of all languages that wait for it together hold up to HELD times as many.
WINDOW = 1 << 20
#: Cells of the sketch: one for this many bytes of text, a power of two, at least these. No task holds them all: of its n-grams'
#: cells a task sorts so many together and hands on those that it met, by block; the task that adds a block up holds a byte for each of its cells.
CELL_BYTES, FEWEST = 8, 1 << 16
SORTED, BLOCK, CELLS_A_TASK = 1 << 24, 1 << 16, 1 << 26
#: Bits of the table that says which cells reached the least: as many as cells, up to this; of more cells some share a bit.
BITS = 1 << 28
#: Patterns of an automaton.
PATTERNS = 1 << 19
#: Bytes of a batch that a task hands on.
BATCH_BYTES = 1 << 22
#: Between the words of a phrase, and beside them; no word holds it. END stands among the words where a piece ends, and is no word.
GUARD, END = b" ", b"\n"
SALTS = 64

_PIECE_END = b".,;:!?\n\x0b\x0c\r"
_TABLE = bytes.maketrans(string.ascii_uppercase.encode() + b"\t" + _PIECE_END, string.ascii_lowercase.encode() + GUARD + END * len(_PIECE_END))
_VALUE = itemgetter(1)
_LETTERS = np.array([xxhash.xxh64_intdigest(bytes([k])) for k in range(256)], np.uint64)
_STEP = 0x9E3779B97F4A7C15
_BACK = pow(_STEP, -1, 1 << 64)
_CUT = re.compile(rb"[ \t.,;:!?\n-\r]")


def _cut_up(octets: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(bytes with A-Z lowered, starts and ends of the words, whether a piece ends before each word) of a text."""
    data = np.frombuffer(octets.translate(_TABLE), np.uint8)
    over = data == END[0]
    word = np.zeros(len(data) + 2, bool)
    word[1:-1] = ~(over | (data == GUARD[0]))
    edges = np.flatnonzero(word[1:] != word[:-1])
    starts, ends = edges[::2], edges[1::2]
    before = np.cumsum(over, dtype=np.int32)[starts] if len(starts) else np.empty(0, np.int32)
    return data, starts, ends, np.diff(before, prepend=0) > 0


def _lined(words: np.ndarray, after_end: np.ndarray) -> np.ndarray:
    """The words with 0 where a piece ends before one."""
    line = np.zeros(len(words) + int(after_end.sum()), words.dtype)
    line[np.arange(len(words)) + np.cumsum(after_end)] = words
    return line


def _hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A hash of each word: a polynomial of its bytes. It is never 0."""
    if not len(starts):
        return np.empty(0, np.uint64)
    n = len(data)
    with np.errstate(over="ignore"):
        powers = np.full(n, _STEP, np.uint64)
        powers[0] = 1
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(_LETTERS[data] * np.cumprod(powers), out=sums[1:])
        powers[1:] = _BACK
        return _mix(np.uint64(7), (sums[ends] - sums[starts]) * np.cumprod(powers)[starts]) | np.uint64(1)


class Line(NamedTuple):
    """Words in a row: their hashes, 0 where a piece ends; their lengths; their bytes."""

    hashes: np.ndarray
    lengths: np.ndarray
    letters: np.ndarray

    def at(self, a: int, b: int | None = None) -> Line:
        lengths = self.lengths[a:b]
        start = int(self.lengths[:a].sum())
        return Line(self.hashes[a:b], lengths, self.letters[start : start + int(lengths.sum())])

    @staticmethod
    def of(octets: bytes) -> Line:
        """The words of a text, A-Z lowered, with the ends of its pieces."""
        data, starts, ends, after_end = _cut_up(octets)
        last = END in data[ends[-1] if len(ends) else 0 :].tobytes()
        lined = Line(_lined(_hashes(data, starts, ends), after_end), _lined((ends - starts).astype(np.int32), after_end), data[(data != GUARD[0]) & (data != END[0])])
        return Line.joined([lined, PIECE_END]) if last else lined

    @staticmethod
    def joined(lines: list[Line]) -> Line:
        return Line(*map(np.concatenate, zip(*lines, strict=True)))


NOTHING = Line(np.empty(0, np.uint64), np.empty(0, np.int32), np.empty(0, np.uint8))
PIECE_END = Line(np.zeros(1, np.uint64), np.zeros(1, np.int32), np.empty(0, np.uint8))


def _groups(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(a place of each different hash, which of them stands at each place). The hashes are sorted with their places in their low bits; if that parts or brings together what it shouldn't, by themselves."""
    low = np.uint64((1 << len(hashes).bit_length()) - 1)
    packed = (hashes & ~low) | np.arange(len(hashes), dtype=np.uint64)
    packed.sort()
    order = (packed & low).astype(np.int64)
    in_order = hashes[order]
    new = np.r_[True, in_order[1:] != in_order[:-1]]
    if not np.array_equal(new[1:], (packed[1:] | low) != (packed[:-1] | low)):
        order = np.argsort(hashes)
        in_order = hashes[order]
        new = np.r_[True, in_order[1:] != in_order[:-1]]
    which = np.empty(len(hashes), np.int64)
    which[order] = np.cumsum(new) - 1
    return order[new], which


def _numbered(line: Line, step: int = 1 << 18) -> tuple[np.ndarray, pa.Array]:
    """(the number of each word, the words by their numbers): 0 is the end of a piece, then the more frequent come first. Words are told apart by their hashes, and where these are equal their bytes are compared."""
    first, which = _groups(line.hashes)
    n = np.bincount(which)
    starts = np.zeros(len(line.lengths) + 1, np.int32)
    np.cumsum(line.lengths, out=starts[1:])
    words = pa.BinaryArray.from_buffers(pa.binary(), len(line.lengths), [None, pa.py_buffer(starts), pa.py_buffer(line.letters)])
    same = first[which]
    equal = np.array_equal(line.lengths[same], line.lengths)
    for k in range(0, len(same) if equal else 0, step):
        lengths = line.lengths[k : k + step]
        back = np.repeat(starts[k : k + step][: len(lengths)] - starts[same[k : k + step]], lengths)
        here = np.arange(starts[k], starts[k] + len(back), dtype=np.int32)
        equal = equal and np.array_equal(line.letters[here], line.letters[here - back])
    if not equal:
        known: dict[bytes, int] = {}
        which = np.fromiter((known.setdefault(x, len(known)) for x in words.to_pylist()), np.int64, len(line.lengths))
        _, first, n = np.unique(which, return_index=True, return_counts=True)
    n[line.lengths[first] == 0] = len(line.lengths) + 1
    order = np.argsort(-n, kind="stable")
    place = np.empty(len(order), np.int32)
    place[order] = np.arange(len(order))
    return place[which], words.take(pa.array(first[order]))


def _seed(lang: str | None) -> np.ndarray:
    return np.uint64(xxhash.xxh64_intdigest((lang or "").encode("utf-8", "surrogatepass"), 5))


def _grams(lang: str | None, of: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(n, places, hashes) of the n-grams of every length in a line of hashes of words; none spans the end of a piece."""
    mixed = _mix(_seed(lang), of)
    inside = word = of != 0
    for n in range(1, LONGEST + 1):
        if n > 1:
            mixed, inside = _mix(mixed[:-1], of[n - 1 :]), inside[:-1] & word[n - 1 :]
        places = np.flatnonzero(inside)
        yield n, places, mixed[places]
        if len(mixed) < 2:
            return


def _spelled(words: np.ndarray) -> tuple[str, np.ndarray]:
    """Rows of numbers of words as text, and where each row begins: a guard before each word, and its digits; a word 0 at the end of a row is none."""
    out = np.empty((*words.shape, 4), np.uint32)
    out[..., 0], out[..., 1], out[..., 2], out[..., 3] = GUARD[0], 64 + (words >> 12), 64 + ((words >> 6) & 63), 64 + (words & 63)
    kept = np.ones(out.shape, bool)
    kept[..., 1], kept[..., 2] = words >> 12 != 0, words >> 6 != 0
    if words.shape[1] > 1:
        kept &= (words != 0)[..., None]
    begins = np.zeros(len(words) + 1, np.int64)
    np.cumsum(kept.reshape(len(words), -1).sum(axis=1), out=begins[1:])
    return out[kept].tobytes().decode("utf-32-le"), begins


class Shard:
    """Texts of one language as lines of words, in parts that an end of a piece follows, each with a sign."""

    def __init__(self, lang: str | None):
        self.lang, self.size = lang, 0
        self.parts: dict[int, list[Line]] = {1: [], -1: []}

    def add(self, line: Line, sign: int = 1) -> None:
        self.parts[sign] += [line, PIECE_END]
        self.size += len(line.hashes)

    def n_words(self) -> int:
        return sum(sign * int((x.hashes != 0).sum()) for sign, parts in self.parts.items() for x in parts)

    def counts(self, bits: np.ndarray) -> tuple[list[str], list[int], list[int]]:
        """(phrases by their bytes, sizes, occurrences) of ``counted``."""
        phrases, sizes, found = self.counted(bits)
        return [x.decode("latin-1") for x in phrases.to_pylist()], sizes.tolist(), found.tolist()

    def counted(self, bits: np.ndarray) -> tuple[pa.Array, np.ndarray, np.ndarray]:
        """(phrases, sizes, occurrences) of the shard's n-grams that the sketch lets through: those whose cell, an upper bound of their number, reached the least, as the cells of all n-grams within them did.

        Words are counted by their numbers. The phrases of more words make automata, which read the shard. One place of each
        hash names its phrase: were two phrases of one hash, the automata would find fewer places than there are, and then all
        places name theirs.
        """
        whole = Line.joined([NOTHING, *self.parts[1], *self.parts[-1]])
        size = sum(len(x.hashes) for x in self.parts[1])
        if not size:
            return pa.array([], pa.binary()), np.empty(0, np.int32), np.empty(0, np.int64)
        numbers, names = _numbered(whole)
        line, less = numbers[:size], numbers[size:]
        words, passed = np.zeros(len(names), bool), np.zeros(size, bool)
        candidates: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for n, places, hashes in _grams(self.lang, whole.hashes[:size]):
            cells = hashes & np.uint64(len(bits) * 8 - 1)
            may = (bits[cells >> np.uint64(3)] >> (cells & np.uint64(7)).astype(np.uint8)) & 1 == 1
            if n == 1:
                words[line[places[may]]] = True
            else:
                may &= passed[places] & passed[places + 1]
                candidates.append((np.full(may.sum(), n, np.int32), places[may], hashes[may]))
            passed = np.zeros(size, bool)
            passed[places[may]] = True
        del whole
        total = np.bincount(line, minlength=len(names)) - np.bincount(less, minlength=len(names))
        own = np.flatnonzero(words)
        phrases, sizes, found = [names.take(pa.array(own))], [np.ones(len(own), np.int32)], [total[own]]
        if sum(len(x[0]) for x in candidates):
            n, places, hashes = map(np.concatenate, zip(*candidates, strict=True))
            of = np.stack([np.where(k < n, line[np.minimum(places + k, size - 1)], 0) for k in range(LONGEST)], axis=1)
            first, which = _groups(hashes)
            named, n_found, n_seen = self._read(line, less, of[first], places, which)
            if n_seen != len(places):
                different, which = np.unique(of, axis=0, return_inverse=True)
                named, n_found, _ = self._read(line, less, different, places, which.reshape(-1))
            for k in range(2, LONGEST + 1):
                own = np.flatnonzero((named != 0).sum(axis=1) == k)
                phrases.append(pc.binary_join_element_wise(*(names.take(pa.array(named[own, i])) for i in range(k)), GUARD))
                sizes.append(np.full(len(own), k, np.int32))
                found.append(n_found[own])
        return pa.concat_arrays(phrases), np.concatenate(sizes), np.concatenate(found)

    def _read(self, line: np.ndarray, less: np.ndarray, phrases: np.ndarray, places: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """The phrases, a row of words each, in order; their occurrences in ``line`` without those in ``less``; and at how many places of ``line`` the automata met them. ``which`` of them stands at each of ``places``: an automaton reads the words of ``line`` that its own phrases have there."""
        order = np.lexsort(phrases.T[::-1])  # in order, a tree grows where it was touched last
        phrases = phrases[order]
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        rank = rank[which]
        total, n_seen, guard = np.zeros(len(phrases), np.int64), 0, GUARD.decode()
        for a in range(0, len(phrases), PATTERNS):
            some = phrases[a : a + PATTERNS]
            letters, begins = _spelled(some)
            automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS)
            for k, (x, y) in enumerate(pairwise(begins.tolist())):
                automaton.add_word(letters[x:y] + guard, k)
            automaton.make_automaton()
            needed = np.zeros(len(line), bool)
            mine = (rank >= a) & (rank < a + PATTERNS)
            here, own = places[mine], rank[mine] - a
            for k in range(LONGEST):
                needed[here[some[own, k] != 0] + k] = True
            near_only = np.where(needed, line, 0)
            near_only = near_only[needed | np.r_[True, needed[:-1]]]  # one END for words that no candidate has
            for sign, read in ((1, near_only), (-1, less)):
                for part in _parts(read):
                    seen = np.fromiter(map(_VALUE, automaton.iter(_spelled(part[:, None])[0] + guard)), np.int64)
                    total[a : a + PATTERNS] += sign * np.bincount(seen, minlength=len(some))
                    n_seen += len(seen) if sign > 0 else 0
        return phrases, total, n_seen


def _parts(line: np.ndarray, most: int = 1 << 18) -> Iterator[np.ndarray]:
    """A line of words cut at ends of pieces into parts of about ``most`` words."""
    ends, at = np.flatnonzero(line == 0), 0
    while at < len(line):
        k = np.searchsorted(ends, at + most)
        end = int(ends[k]) + 1 if k < len(ends) else len(line)
        yield line[at:end]
        at = end


def _mix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A hash of two hashes, the order counting."""
    with np.errstate(over="ignore"):
        x = (a * np.uint64(0x9E3779B97F4A7C15)) ^ b
        x = (x ^ (x >> np.uint64(31))) * np.uint64(0xD6E8FEB86659FD93)
        return x ^ (x >> np.uint64(32))


def _windows(octets: memoryview, most: int) -> Iterator[bytes]:
    """A text cut before a blank or a sign after about so many bytes, so that no word is cut."""
    at = 0
    while at < len(octets):
        found = _CUT.search(octets, at + most)
        end = found.start() if found else len(octets)
        yield bytes(octets[at:end])
        at = end


def added(shard: Shard, octets: memoryview, most: int, window: int = WINDOW) -> Iterator[Shard]:
    """Puts a text into a shard, and yields the shard when it is full; the text goes on in a new one.

    The two share LONGEST - 1 words, which come once more with sign -1, so that the sum over shards is that of the whole text.
    """
    rest = NOTHING
    for part in _windows(octets, window):
        rest = Line.joined([rest, Line.of(part)])
        while len(rest.hashes) + shard.size >= most + LONGEST:
            cut = max(0, most - shard.size)
            shard.add(rest.at(0, cut + LONGEST - 1))
            shard.add(rest.at(cut, cut + LONGEST - 1), -1)
            rest = rest.at(cut)
            yield shard
            shard = Shard(shard.lang)
    shard.add(rest)
    yield shard


def _texts(batches, window: int = WINDOW) -> Iterator[tuple[str, memoryview]]:
    """The texts of a task, those of one language together, with ends of pieces between, in about ``window`` bytes or more."""
    waiting: dict[str, list[bytes]] = {}
    sizes: dict[str, int] = {}
    total = 0
    for batch in batches:
        for lang, text in zip(batch.column(0), batch.column(1), strict=True):
            if not text.is_valid:
                continue
            lang, octets = lang.as_py(), memoryview(text.as_buffer())
            if len(octets) >= window:
                yield lang, octets
                continue
            waiting.setdefault(lang, []).append(bytes(octets))
            sizes[lang] = sizes.get(lang, 0) + len(octets) + 1
            total += len(octets) + 1
            if sizes[lang] >= window or total >= HELD * window:
                if sizes[lang] < window:
                    lang = max(sizes, key=sizes.get)
                total -= sizes.pop(lang)
                yield lang, memoryview(END.join(waiting.pop(lang)))
    for lang, own in waiting.items():
        yield lang, memoryview(END.join(own))


def _shards(batches, most: int) -> Iterator[Shard]:
    """The texts of a task in shards of one language; all languages of a task together hold up to HELD times ``most`` words before the largest shard goes."""
    shards: dict[str, Shard] = {}
    total = 0
    for lang, octets in _texts(batches):
        own = shards.pop(lang, None) or Shard(lang)
        total -= own.size
        *full, last = added(own, octets, most)
        yield from full
        shards[lang] = last
        total += last.size
        if total >= HELD * most:
            largest = max(shards.values(), key=lambda s: s.size)
            total -= largest.size
            yield shards.pop(largest.lang)
    yield from shards.values()


def _hashed(batches) -> Iterator[np.ndarray]:
    """Hashes of the n-grams of a task's texts. Where a long text is cut, those of the last words may come twice: what is counted is a bound."""
    for lang, octets in _texts(batches):
        rest = np.empty(0, np.uint64)
        for part in _windows(octets, WINDOW):
            data, starts, ends, after_end = _cut_up(part)
            line = np.concatenate((rest, _lined(_hashes(data, starts, ends), after_end)))
            rest = line[1 - LONGEST :]
            for _, _, hashes in _grams(lang, line):
                yield hashes


def _met(cells: np.ndarray, least: int) -> Iterator[pa.RecordBatch]:
    """(block, at, n): the cells that stand here, by block, and how often, up to ``least``."""
    cells.sort()
    first = np.flatnonzero(np.r_[True, cells[1:] != cells[:-1]])
    n = np.minimum(np.diff(np.r_[first, len(cells)]), least).astype(np.uint8)
    cells = cells[first]
    blocks = (cells >> cells.dtype.type(BLOCK.bit_length() - 1)).astype(np.int64)
    at = (cells & cells.dtype.type(BLOCK - 1)).astype(np.uint16)
    edges = np.append(np.flatnonzero(np.r_[True, blocks[1:] != blocks[:-1]]), len(blocks))
    step = max(1, BATCH_BYTES * (len(edges) - 1) // (3 * len(cells)))
    for k in range(0, len(edges) - 1, step):
        some = edges[k : k + step + 1]
        a, b = some[0], some[-1]
        binary = lambda values: pa.BinaryArray.from_buffers(pa.binary(), len(some) - 1, [None, pa.py_buffer(((some - a) * values.itemsize).astype(np.int32)), pa.py_buffer(values[a:b].copy())])  # noqa: B023, E731
        yield pa.RecordBatch.from_arrays([pa.array(blocks[some[:-1]]), binary(at), binary(n)], names=["block", "at", "n"])


def sketch(docs: DataFrame, n_cells: int, least: int) -> np.ndarray:
    """One bit a cell, or for as many cells as share it: whether the n-grams that fall into one are ``least`` or more together.

    A task sorts the cells of some n-grams and hands on those that it met; the tasks' counts are added by block, up to ``least``, in
    tasks that hold no more than their own blocks. Only the bits reach the driver, up to BITS of them.
    """
    n_folds = max(1, min(n_cells, BITS) // BLOCK)
    kind = np.uint32 if n_cells <= 1 << 32 else np.uint64

    def over(batches):
        waiting, size = [], 0
        for hashes in _hashed(batches):
            waiting.append((hashes & np.uint64(n_cells - 1)).astype(kind))
            size += len(hashes)
            if size >= SORTED:
                cells, waiting, size = np.concatenate(waiting), [], 0
                yield from _met(cells, least)
                del cells
        if size:
            yield from _met(np.concatenate(waiting), least)

    def merged(batches):
        blocks: dict[int, np.ndarray] = {}
        for batch in batches:
            for block, at, n in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2), strict=True):
                own = blocks.get(block)
                if own is None:
                    own = blocks[block] = np.zeros(min(BLOCK, n_cells), np.uint8)
                at = np.frombuffer(at.as_buffer(), np.uint16)
                own[at] = np.minimum(least, own[at] + np.frombuffer(n.as_buffer(), np.uint8))
        folds: dict[int, np.ndarray] = {}
        for block in list(blocks):
            reached = blocks.pop(block) >= least
            if reached.any():
                folds[block % n_folds] = reached | folds.get(block % n_folds, False)
        for fold, reached in folds.items():
            yield pa.RecordBatch.from_arrays([pa.array([fold], pa.int64()), pa.array([np.packbits(reached, bitorder="little").tobytes()], pa.binary())], names=["fold", "bits"])

    spark = docs.sparkSession
    parts = docs.mapInArrow(tidied(over), "block long, at binary, n binary")
    parts = parts.repartition(min(max(parallelism(spark), n_cells // CELLS_A_TASK), n_folds), F.col("block") % n_folds)
    out = np.zeros(min(n_cells, BITS) // 8, np.uint8)
    for fold, bits in zip(*(c.to_pylist() for c in parts.mapInArrow(tidied(merged), "fold long, bits binary").toArrow().columns), strict=True):
        out[fold * BLOCK // 8 :][: len(bits)] = np.frombuffer(bits, np.uint8)
    return out


def cells_of(size: int) -> int:
    """Cells for so many bytes of text: a power of two, in proportion."""
    return max(FEWEST, 1 << (size // CELL_BYTES).bit_length())


def cells_for(docs: DataFrame) -> int:
    """Cells for a corpus."""
    return cells_of(docs.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0)


def frequencies(docs: DataFrame, least: int = LEAST, n_cells: int | None = None, most: int = SHARD_WORDS) -> DataFrame:
    """(lang, phrase, size, f): every phrase of one to LONGEST words that occurs ``least`` times or more, overlaps counted, and, as the empty phrase of size 0, all words.

    Two passes over the texts: the sketch, then the automata of each shard, made of the shard's own n-grams which the sketch
    lets through. Their counts are summed by phrase, combined before the shuffle. Memory is bounded by the shard, the blocks of the sketch that a task adds up, and its bits.
    """
    if not 0 < least <= 100:
        raise ValueError("least must be from 1 to 100: the sketch counts up to it in one byte")
    spark = docs.sparkSession
    texts = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit(UNKNOWN)).alias("lang"), F.col("text").cast("string").alias("text"))
    bits = spark.sparkContext.broadcast(sketch(texts, n_cells or cells_for(texts), least))  # BITS / 8 bytes at most, 32 MB

    def over(batches):
        for shard in _shards(batches, most):
            phrases, sizes, found = shard.counted(bits.value)
            words = shard.n_words()
            names = pa.concat_arrays([pa.array([b""], pa.binary()), phrases]).cast(pa.string())
            yield pa.RecordBatch.from_arrays([pa.repeat(pa.scalar(shard.lang, pa.string()), len(names)), names, pa.array(np.r_[np.int32(0), sizes]), pa.array(np.r_[np.int64(words), found])], names=["lang", "phrase", "size", "f"])
            del shard, phrases, sizes, found, names
            hand_back()

    found = texts.mapInArrow(tidied(over), "lang string, phrase string, size int, f long")
    return found.groupBy("lang", "phrase", "size").agg(F.sum("f").alias("f")).where(F.col("f") >= F.when(F.col("size") == 0, 1).otherwise(least))


def _score(a: Column, l: Column, r: Column) -> Column:  # noqa: E741
    """floor(1000000 a a / (l r)) in decimals of 38 digits."""
    exact = lambda x: x.cast("decimal(38,0)")
    return F.call_function("div", exact(exact(a) * exact(a)) * F.lit(1_000_000).cast("decimal(38,0)"), exact(exact(l) * exact(r)))


def collocations(docs: DataFrame, least: int = LEAST, inside: int = INSIDE, top: int = TOP, n_cells: int | None = None, most: int = SHARD_WORDS) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the first ``top`` phrases of two to three words of each language of ``docs`` (lang, text).

    By score descending, a descending, phrase by its bytes. A phrase's score is that of its lowest cut, of equals the first. A
    phrase goes if a longer one that holds its words, and occurs ``least`` times, has ``inside`` hundredths of its occurrences or
    more. Null languages are ``und``; null and empty texts have no words; repeated rows count as often as they are there; other
    columns are ignored; an empty table gives none.
    """
    f = cut(frequencies(docs, least, n_cells, most))
    blank = GUARD.decode()
    words = F.split("phrase", blank)
    part = lambda a, n: F.array_join(F.slice(words, a, n), blank)
    phrases = f.where("size > 1")
    cuts = phrases.select("lang", "phrase", F.col("f").alias("a"), F.explode(F.sequence(F.lit(1), F.col("size") - 1)).alias("k"), "size")
    cuts = cuts.select("lang", "phrase", "a", "k", part(F.lit(1), F.col("k")).alias("left"), part(F.col("k") + 1, F.col("size") - F.col("k")).alias("right"))
    of = lambda name, n: f.select("lang", F.col("phrase").alias(name), F.col("f").alias(n))
    cuts = cuts.join(of("left", "l"), ["lang", "left"]).join(of("right", "r"), ["lang", "right"])
    lowest = cuts.select("lang", "phrase", "a", F.struct(_score(F.col("a"), F.col("l"), F.col("r")).alias("score"), "k", "l", "r").alias("cut")).groupBy("lang", "phrase", "a").agg(F.min("cut").alias("cut"))

    longer = phrases.where("size > 2").select("lang", "f", "size", "phrase", F.explode(F.sequence(F.lit(2), F.col("size") - 1)).alias("n"))
    longer = longer.select("lang", "f", "phrase", "n", F.explode(F.sequence(F.lit(1), F.col("size") - F.col("n") + 1)).alias("at"))
    over = longer.select("lang", F.array_join(F.slice(words, F.col("at"), F.col("n")), blank).alias("phrase"), "f").groupBy("lang", "phrase").agg(F.max("f").alias("most"))
    kept = lowest.join(over, ["lang", "phrase"], "left").where("most is null or 100 * most < %d * a" % inside)

    order = [F.col("cut.score").desc(), F.col("a").desc(), F.col("phrase").asc()]
    salt = F.pmod(F.xxhash64("phrase"), F.lit(SALTS))  # no task has all of a language: first the best of each share, then of those
    best = kept.withColumn("salt", salt).withColumn("place", F.row_number().over(Window.partitionBy("lang", "salt").orderBy(*order))).where(F.col("place") <= top)
    best = best.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)
    total = f.where("size = 0").select("lang", F.col("f").alias("n"))
    return best.join(total, "lang").select("lang", "rank", "phrase", "a", F.col("cut.l").alias("l"), F.col("cut.r").alias("r"), "n", F.col("cut.score").alias("score"))


def sql(least: int = LEAST, inside: int = INSIDE, top: int = TOP) -> str:
    """The same for DuckDB, counting every phrase."""
    upper, lower = string.ascii_uppercase, string.ascii_lowercase
    grams = " UNION ALL ".join(f"SELECT lang, unnest(list_transform(range(1, len(ws) - {n} + 2), lambda i: array_to_string(ws[i:i + {n - 1}], ' '))) AS phrase, {n} AS size FROM p" for n in (1, 2, 3))
    return f"""
WITH t AS (SELECT coalesce(lang, '{UNKNOWN}') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), '{upper}', '{lower}'), '[.,;:!?\\x0A-\\x0D]')) AS piece FROM documents),
p AS (SELECT lang, list_filter(regexp_split_to_array(piece, '[ \\t]+'), lambda w: w <> '') AS ws FROM t),
total AS (SELECT lang, CAST(sum(len(ws)) AS BIGINT) AS n FROM p GROUP BY lang),
f AS (SELECT lang, phrase, size, count(*) AS f FROM ({grams}) GROUP BY ALL HAVING count(*) >= {least}),
cuts AS (
  SELECT lang, phrase, f AS a, 1 AS k, split_part(phrase, ' ', 1) AS x, substring(phrase, strpos(phrase, ' ') + 1) AS y FROM f WHERE size > 1
  UNION ALL SELECT lang, phrase, f, 2, split_part(phrase, ' ', 1) || ' ' || split_part(phrase, ' ', 2), split_part(phrase, ' ', 3) FROM f WHERE size = 3),
scored AS (SELECT c.lang, c.phrase, c.a, c.k, g.f AS l, h.f AS r, CAST((CAST(1000000 AS HUGEINT) * c.a * c.a) // (CAST(g.f AS HUGEINT) * h.f) AS BIGINT) AS score FROM cuts c JOIN f g ON g.lang = c.lang AND g.phrase = c.x JOIN f h ON h.lang = c.lang AND h.phrase = c.y),
lowest AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
longer AS (SELECT lang, phrase, max(f) AS f FROM (
  SELECT lang, f, split_part(phrase, ' ', 1) || ' ' || split_part(phrase, ' ', 2) AS phrase FROM f WHERE size = 3
  UNION ALL SELECT lang, f, split_part(phrase, ' ', 2) || ' ' || split_part(phrase, ' ', 3) FROM f WHERE size = 3) GROUP BY ALL),
kept AS (SELECT w.* FROM lowest w LEFT JOIN longer o ON o.lang = w.lang AND o.phrase = w.phrase WHERE o.f IS NULL OR 100 * o.f < {inside} * w.a),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase)) AS rank FROM kept)
SELECT r.lang, r.rank, r.phrase, r.a, r.l, r.r, total.n, r.score FROM ranked r JOIN total ON total.lang = r.lang WHERE r.rank <= {top}
"""
