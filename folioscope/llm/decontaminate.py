"""Benchmark decontamination: q-gram lemma filtering in diagonal bands, verified by banded alignment."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscope.llm.common import tidied

Q = 8
#: Edits a match may have, as a share of the benchmark text's characters.
EDIT_RATE = 0.1
#: Normalised benchmark texts of a block, in characters: what one broadcast index holds at most (more only for one longer text).
BLOCK_CHARS = 2_000_000
WINDOW = 1 << 18
#: Times a benchmark text may hold a gram that places it; a gram it repeats more often counts as found.
REPEATS = 32
#: Pairs of equal grams that are counted at once.
PAIRS = 1 << 20
_BASE = np.uint64(0x9E3779B97F4A7C15)


@lru_cache(maxsize=1)
def _kept() -> np.ndarray:
    return np.fromiter((chr(i).isalnum() for i in range(0x110000)), np.bool_, 0x110000)


def normalised(text: str | None) -> np.ndarray:
    """Code points of a text: lower-case letters and digits, with one blank for any run of other characters between them."""
    chars = np.frombuffer((text or "").lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    kept = _kept()[chars]
    keep = kept.copy()
    keep[1:] |= kept[:-1]  # of a run of others the first stays, as a blank
    out = np.where(kept, chars, np.uint32(32))[keep]
    return out[: len(out) - 1] if len(out) and out[-1] == 32 else out


def gram_codes(chars: np.ndarray, q: int = Q) -> np.ndarray:
    """A 64-bit code for the ``q`` characters from every position: a polynomial, by halves where q is even."""

    def upto(n: int, held: np.ndarray) -> np.ndarray:
        if n == 1:
            return held
        half = upto(n // 2, held)
        power = np.uint64(pow(int(_BASE), n // 2, 1 << 64))
        out = half[: len(half) - n // 2] * power
        out += half[n // 2 :]
        return out if n % 2 == 0 else out[:-1] * _BASE + held[n - 1 :]

    if len(chars) < q:
        return np.empty(0, np.uint64)
    out = upto(q, chars.astype(np.uint64))
    out ^= out >> np.uint64(29)
    return out


@dataclass
class Part:
    """The q-grams of some benchmark texts: sorted codes with item and position, and a bitmap that most other grams miss."""

    q: int
    texts: list[np.ndarray]
    place: list[int]
    codes: np.ndarray
    first: np.ndarray
    item: np.ndarray
    at: np.ndarray
    bitmap: np.ndarray
    shift: np.uint64
    budget: np.ndarray
    need: np.ndarray
    loose: list[int]

    @classmethod
    def of(cls, items: list[tuple[int, np.ndarray]], q: int, rate: float) -> Part:
        """``items``: (place in the block, text). Grams that an item repeats over REPEATS times don't place it: they count as found everywhere."""
        texts, loose = [x for _, x in items], []
        size = np.array([len(x) for x in texts], np.int64)
        budget = edits_allowed(size, rate)
        # A match with e edits keeps at least m - q + 1 - q * e of the m - q + 1 grams: at least one, as q * (e + 1) <= m.
        need = size - q + 1 - q * budget
        codes, at = [], []
        for k, x in enumerate(texts):
            own = gram_codes(x, q)
            _, of, times = np.unique(own, return_inverse=True, return_counts=True)
            spots = np.flatnonzero(times[of] <= REPEATS)
            need[k] -= len(own) - len(spots)
            if need[k] < 1:
                loose.append(k)
                spots = spots[:0]
            codes.append(own[spots])
            at.append(spots)
        item = np.repeat(np.arange(len(texts)), list(map(len, codes))).astype(np.int64)
        every, at = np.concatenate(codes), np.concatenate(at).astype(np.int64)
        order = np.argsort(every, kind="stable")
        bits = max(16, int(len(every) * 16).bit_length())
        shift = np.uint64(64 - bits)
        bitmap = np.zeros(1 << bits, np.bool_)
        bitmap[(every * _BASE) >> shift] = True
        found, first = np.unique(every[order], return_index=True)
        return cls(q, texts, [k for k, _ in items], found, np.append(first, len(item)), item[order], at[order], bitmap, shift, budget, need, loose)

    def candidates(self, grams: np.ndarray) -> list[tuple[int, int, int]]:
        """(item, lowest diagonal, highest diagonal) of regions that share enough grams in a band.

        The diagonals of a match with e edits lie within e of each other. Bands are 2e + 1 wide, and two neighbours are counted
        together, so that bands overlap by their half and every match lies whole in one of them. Pairs of equal grams are
        counted PAIRS at a time, so memory doesn't grow with their number.
        """
        out = [(i, low, high) for i in self.loose for low, high in self._dense(grams, i)]
        spots = np.flatnonzero(self.bitmap[(grams * _BASE) >> self.shift])
        if not len(spots) or not len(self.codes):
            return out
        found = grams[spots]
        at = np.minimum(np.searchsorted(self.codes, found), len(self.codes) - 1)
        known = self.codes[at] == found
        spots, low = spots[known], self.first[at[known]]
        n = self.first[at[known] + 1] - low
        if not len(spots):
            return out
        lowest = -int(max(map(len, self.texts))) - 1
        keys, counts = np.empty(0, np.int64), np.empty(0, np.int64)
        ends = n.cumsum()
        for part in np.split(np.arange(len(spots)), np.flatnonzero(np.diff(ends // PAIRS)) + 1):
            m = n[part]
            posting = np.repeat(low[part] - np.append(0, m.cumsum()[:-1]), m) + np.arange(m.sum())
            item = self.item[posting]
            band = (np.repeat(spots[part], m) - self.at[posting] - lowest) // (2 * self.budget[item] + 1)
            some, times = np.unique((item << 40) | band, return_counts=True)
            keys, of = np.unique(np.append(keys, some), return_inverse=True)
            counts = np.bincount(of, np.append(counts, times), len(keys)).astype(np.int64)
        later = np.minimum(np.searchsorted(keys, keys + 1), len(keys) - 1)
        beside = np.where(keys[later] == keys + 1, counts[later], 0)
        for k in np.flatnonzero(counts + beside >= self.need[keys >> 40]).tolist():
            i, b = int(keys[k]) >> 40, int(keys[k]) & ((1 << 40) - 1)
            w = 2 * int(self.budget[i]) + 1
            first, last = b * w + lowest, (b + 2) * w + lowest - 1
            # A gram that occurs often near its place counts once.
            own = gram_codes(self.texts[i], self.q)
            near = np.unique(grams[max(0, first) : max(0, last + len(self.texts[i]))])
            if np.isin(own, near).sum() >= len(own) - self.q * int(self.budget[i]):
                out.append((i, first, last))
        return out

    def _dense(self, grams: np.ndarray, i: int) -> list[tuple[int, int]]:
        """Diagonals of the stretches where an item of few different grams has enough of them: each window of a match's length is counted."""
        size, e = len(self.texts[i]), int(self.budget[i])
        own = np.unique(gram_codes(self.texts[i], self.q))
        least = size - self.q + 1 - self.q * e
        has = np.append(0, own[np.minimum(np.searchsorted(own, grams), len(own) - 1)] == grams).cumsum()
        span = size - self.q + 1 + e
        ends = np.minimum(np.arange(len(grams)) + span, len(grams))
        start = np.flatnonzero(has[ends] - has[:-1] >= least)
        if not len(start):
            return []
        cuts = np.flatnonzero(np.diff(start) > span) + 1
        return [(int(x[0]) - e, int(x[-1]) + e) for x in np.split(start, cuts)]


def edits_allowed(size, rate: float):
    """Edits that a match of a text of ``size`` characters may have."""
    return (size * rate).astype(np.int64) if isinstance(size, np.ndarray) else int(size * rate)


class Index:
    """A block of benchmark texts. Each is indexed by grams short enough for its length: one at least outlives every allowed number of edits."""

    def __init__(self, items: list[tuple[int | None, np.ndarray]], q: int, rate: float):
        items = [x for x in items if len(x[1])]
        self.ids = [i for i, _ in items]
        by: dict[int, list[tuple[int, np.ndarray]]] = {}
        for k, (_, x) in enumerate(items):
            by.setdefault(min(q, len(x) // (edits_allowed(len(x), rate) + 1)), []).append((k, x))
        self.parts = [Part.of(own, width, rate) for width, own in sorted(by.items())]


def banded_distance(pattern: np.ndarray, text: np.ndarray, low: int, high: int, budget: int) -> tuple[int, int, int] | None:
    """(edits, start, end) of the best alignment of the whole pattern inside ``text`` on diagonals low..high, or None beyond the budget.

    Ends in the text are free. Ties go to the first end, then the last start. Rows are patterns' characters; columns are
    diagonals, so a row is one pass over the band.
    """
    width, m, n = high - low + 1, len(pattern), len(text)
    far = np.int64(budget + 1 + m)
    column = np.arange(low, high + 1)
    cost = np.where((column >= 0) & (column <= n), 0, far)
    start = column.copy()
    steps = np.arange(width)
    for i in range(1, m + 1):
        at = column + i  # text characters used
        inside = (at >= 1) & (at <= n)
        same = np.zeros(width, np.bool_)
        same[inside] = text[at[inside] - 1] == pattern[i - 1]
        diagonal = np.where(inside, cost + ~same, far)
        above = np.append(cost[1:], far) + 1  # pattern character left out
        from_above = above < diagonal
        best = np.where(from_above, above, diagonal)
        begin = np.where(from_above, np.append(start[1:], 0), start)
        best[(at < 0) | (at > n)] = far
        # Text characters put in: cost grows by one a step to the right.
        flat = np.minimum.accumulate(best - steps) + steps
        source = np.maximum.accumulate(np.where(best - steps <= np.minimum.accumulate(best - steps), steps, 0))
        begin = begin[source]
        cost, start = np.where((at >= 0) & (at <= n), np.minimum(flat, far), far), begin
        if cost.min() > budget:  # no path gets cheaper
            return None
    k = int(cost.argmin())
    return (int(cost[k]), int(start[k]), int(low + k + m)) if cost[k] <= budget else None


def _find(chars: np.ndarray, pattern: np.ndarray) -> int:
    """First place of a pattern, or -1."""
    held, sought, at = chars.tobytes(), pattern.tobytes(), -1
    while (at := held.find(sought, at + 1)) % 4 and at >= 0:
        pass
    return at // 4 if at >= 0 else -1


def matches(index: Index, chars: np.ndarray) -> list[tuple[int, int, int, int]]:
    """(item, edits, start, end) in the normalised text: the best region of every item that has one, the first of equals."""
    return sorted((k, *v) for part in index.parts for k, v in _matches(part, chars).items())


def _matches(part: Part, chars: np.ndarray) -> dict[int, tuple[int, int, int]]:
    found: dict[int, tuple[int, int, int]] = {}
    reach = max(map(len, part.texts), default=0) * 2
    for a in range(0, len(chars), WINDOW):  # windows overlap by more than a match
        held = chars[a : a + WINDOW + reach]
        for item, low, high in dict.fromkeys(part.candidates(gram_codes(held, part.q))):
            pattern, e, k = part.texts[item], int(part.budget[item]), part.place[item]
            lo, hi = max(0, low - e), min(len(held), high + len(pattern) + e)
            exact = _find(held[lo:hi], pattern)
            if exact >= 0:
                got = (0, exact, exact + len(pattern))
            else:
                got = banded_distance(pattern, held[lo:hi], low - lo - e, high - lo + e, e) if e else None
            if got and (k not in found or (got[0], a + lo + got[1]) < found[k][:2]):
                found[k] = (got[0], a + lo + got[1], a + lo + got[2])
    return found


def _blocks(benchmark: DataFrame, block_chars: int):
    """Normalised benchmark texts in blocks of bounded size, as UTF-8; a stream, so the driver holds one block."""
    block, size = [], 0
    rows = benchmark.where("text is not null").select(F.col("item_id").cast("long").alias("item_id"), "text").distinct().orderBy("item_id", "text")
    for r in rows.toLocalIterator():
        x = normalised(r["text"])
        if block and size + len(x) > block_chars:
            yield block
            block, size = [], 0
        if len(x):
            block.append((r["item_id"], x.tobytes().decode("utf-32-le", "surrogatepass").encode("utf-8", "surrogatepass")))
            size += len(x)
    if block:
        yield block


def _sent(docs: DataFrame, benchmark: DataFrame, block_chars: int) -> list:
    """The benchmark's blocks, broadcast one by one."""
    return [docs.sparkSession.sparkContext.broadcast(x) for x in _blocks(benchmark, block_chars)]


class _Indexes:
    """Per task: the index of each block in turn. One block's is kept; of more, only one is in memory at a time."""

    def __init__(self, blocks: list, q: int, rate: float):
        self.blocks, self.q, self.rate, self.only = blocks, q, rate, None

    def __iter__(self) -> Iterator[Index]:
        for block in self.blocks:
            index = self.only or Index([(i, np.frombuffer(x.decode("utf-8", "surrogatepass").encode("utf-32-le", "surrogatepass"), np.uint32)) for i, x in block.value], self.q, self.rate)
            self.only = index if len(self.blocks) == 1 else None
            yield index


HITS = "doc_id long, item_id long, edits int, start long, end long"


def contamination(docs: DataFrame, benchmark: DataFrame, q: int = Q, rate: float = EDIT_RATE, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """(doc_id, item_id, edits, start, end) for every document of ``docs`` (doc_id, text) and text of ``benchmark`` (item_id, text) that it holds.

    Both are normalised (case, runs of signs and white space); ``start`` and ``end`` are places in the normalised text. A match
    is a region that differs from the whole benchmark text by at most ``rate`` of its characters in edits; for each pair the best region
    is given. Grams have ``q`` characters, fewer for texts so short that the allowed edits could hit every gram; a text of fewer
    than 1 / ``rate`` characters is found where it stands exactly, one without letters and digits nowhere. The benchmark is
    read in blocks of bounded size, all of them in one pass over the documents. Null and empty texts match nothing; repeated
    rows give repeated matches; null ids stay, on both sides; empty tables give an empty result; other columns are ignored.
    Whole texts of any length.
    """
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    blocks = _sent(docs, benchmark, block_chars)

    def over(batches):
        indexes = _Indexes(blocks, q, rate)
        for batch in batches:
            hits = []
            for index in indexes:
                for k, x in enumerate(batch.column(1)):
                    hits += [(k, index.ids[item], edits, start, end) for item, edits, start, end in matches(index, normalised(x.as_py()))]
            k, *rest = zip(*hits, strict=True) if hits else [[]] * 5
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(k, pa.int64())), *map(pa.array, rest, kinds)], names=["doc_id", "item_id", "edits", "start", "end"])

    return texts.mapInArrow(tidied(over), HITS)


def _holds(blocks: list, q: int, rate: float):
    """A column function: whether a text holds one of the blocks' texts."""

    @F.arrow_udf("boolean")
    def leaks(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        def over(every):
            indexes = _Indexes(blocks, q, rate)
            for texts in every:
                held = np.zeros(len(texts), np.bool_)
                for index in indexes:
                    for k in np.flatnonzero(~held).tolist():
                        chars = normalised(texts[k].as_py())
                        held[k] = any(_matches(part, chars) for part in index.parts)
                yield pa.array(held)

        yield from tidied(over)(batches)

    return leaks


def clean(docs: DataFrame, benchmark: DataFrame, q: int = Q, rate: float = EDIT_RATE, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """The rows of ``docs`` that hold no benchmark text (see ``contamination``), all columns kept.

    Rows are judged one by one, in one pass, so nothing is shuffled. Null texts stay, repeated rows share their fate; an empty
    benchmark removes nothing.
    """
    mark, blocks = "__folioscope_leak", _sent(docs, benchmark, block_chars)
    if not blocks:
        return docs
    return docs.withColumn(mark, _holds(blocks, q, rate)(F.col("text").cast("string"))).where(~F.col(mark)).drop(mark)
