"""Language identification by hyperdimensional profiles."""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscope.llm.common import hash_below, tidied

GRAM = 3
DIMENSIONS = 512
UNKNOWN = "und"
#: Texts are cut into windows of this many letters for their counts; grams across the cuts are kept.
WINDOW = 1 << 20
TABLE_ROWS = 1 << 15


@lru_cache(maxsize=1)
def _is_letter() -> np.ndarray:
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), np.bool_, 0x110000)


def grams(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct letter n-grams of a whole text and their counts. Letters are lowered; any run of other characters is one blank, as are both ends."""
    codes = np.frombuffer((text or "").lower().encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    letter = _is_letter()[codes]
    if not letter.any():
        return np.empty(0, np.int64), np.empty(0, np.int64)
    codes = np.where(letter, codes, 32)
    codes = codes[letter | np.append(letter[1:], True)]  # of a run of blanks the last stays
    codes = np.concatenate(([32] if codes[0] != 32 else [], codes, [32] if codes[-1] != 32 else [])).astype(np.int64)
    total: dict[int, int] = {}
    for a in range(0, max(1, len(codes) - GRAM + 1), WINDOW):
        part = codes[a : a + WINDOW + GRAM - 1]
        found, n = np.unique((part[:-2] << 42) | (part[1:-1] << 21) | part[2:], return_counts=True)
        if len(codes) <= WINDOW + GRAM - 1:
            return found, n
        for g, k in zip(found.tolist(), n.tolist(), strict=True):
            total[g] = total.get(g, 0) + k
    return np.fromiter(total, np.int64, len(total)), np.fromiter(total.values(), np.int64, len(total))


class Space:
    """Random letter vectors, and the n-gram vectors bound from them, kept in a bounded table."""

    def __init__(self, dimensions: int = DIMENSIONS, seed: int = 11):
        self.d, self.seed = dimensions, seed
        self.letters: dict[int, np.ndarray] = {}
        self.table, self.row = np.empty((0, dimensions), np.float32), {}

    def letter(self, code: int) -> np.ndarray:
        v = self.letters.get(code)
        if v is None:
            bits = np.random.default_rng([self.seed, code]).integers(0, 2, self.d)
            v = self.letters[code] = (bits * 2 - 1).astype(np.float32)
        return v

    def bound(self, gram: int) -> np.ndarray:
        """The product of its letters' vectors, each permuted (rotated) once for every letter that follows."""
        mask = (1 << 21) - 1
        return np.roll(self.letter(gram >> 42), 2) * np.roll(self.letter((gram >> 21) & mask), 1) * self.letter(gram & mask)

    def rows(self, found: np.ndarray) -> np.ndarray:
        new = [g for g in found.tolist() if g not in self.row]
        if new:
            if len(self.row) + len(new) > TABLE_ROWS:
                self.row, new = {}, found.tolist()
            n = len(self.row)
            if n + len(new) > len(self.table):
                grown = np.empty((min(TABLE_ROWS, max(2 * len(self.table), n + len(new), 4096)), self.d), np.float32)
                grown[:n] = self.table[:n]
                self.table = grown
            for k, g in enumerate(new, n):
                self.table[k] = self.bound(g)
                self.row[g] = k
        return self.table[np.fromiter(map(self.row.__getitem__, found.tolist()), np.int64, len(found))]

    def bundle(self, found: np.ndarray, n: np.ndarray) -> np.ndarray:
        """Sum of n-gram vectors, each as often as it occurs. Whole numbers, so exact in any order."""
        out = np.zeros(self.d)
        for a in range(0, len(found), TABLE_ROWS // 4):
            part, times = found[a : a + TABLE_ROWS // 4], n[a : a + TABLE_ROWS // 4]
            if times.sum() < 1 << 24:
                out += times.astype(np.float32) @ self.rows(part)
            else:
                out += times.astype(np.float64) @ self.rows(part).astype(np.float64)
        return out


def learn(docs: DataFrame, max_per_language: int = 1500, dimensions: int = DIMENSIONS) -> dict[str, np.ndarray]:
    """Unit prototypes by language from ``docs`` (doc_id, text, lang): the bundles of a sample's documents.

    The sample holds about ``max_per_language`` documents of each language, or all it has, chosen by a hash of doc_id; that
    bounds what is read into a bundle, not what is predicted. Null languages and texts teach nothing. Documents count alike
    whatever their length. Bundles are summed in 16 parts a language, and only those sums reach the driver.
    """
    known = docs.where("lang is not null and text is not null").select("doc_id", "lang", "text")
    sizes = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not sizes:
        return {}
    rate = F.lit(False)
    for lang, n in sorted(sizes.items()):
        rate = rate | ((F.col("lang") == F.lit(lang)) & hash_below("doc_id", max_per_language / n))
    part = F.pmod(F.xxhash64("doc_id"), F.lit(16)).cast("int")

    def over(batches):
        space, sums = Space(dimensions), {}
        for batch in batches:
            for lang, part, text in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                found, n = grams(text)
                if len(found):
                    v = space.bundle(found, n)
                    key = (lang, part)
                    sums[key] = sums.get(key, 0) + v / np.linalg.norm(v)
        if sums:
            yield pd_batch(sums)

    def pd_batch(sums):
        keys = list(sums)
        return pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys]), pa.array([k[1] for k in keys], pa.int32()), pa.array([sums[k].tolist() for k in keys], pa.list_(pa.float64()))], names=["lang", "part", "v"])

    def added(frame: pd.DataFrame) -> pd.DataFrame:
        rows = sorted(frame["v"].tolist(), key=lambda v: tuple(v))
        return pd.DataFrame({"lang": [frame["lang"].iloc[0]], "v": [np.sum(rows, axis=0).round(6)]})

    sums = known.where(rate).select("lang", part.alias("part"), "text").mapInArrow(tidied(over), "lang string, part int, v array<double>")
    sums = sums.groupBy("lang", "part").applyInPandas(added, "lang string, v array<double>")
    total: dict[str, np.ndarray] = {}
    for r in sorted(sums.collect(), key=lambda r: (r["lang"], tuple(r["v"]))):
        total[r["lang"]] = total.get(r["lang"], 0) + np.array(r["v"])
    return {lang: v / np.linalg.norm(v) for lang, v in total.items() if np.linalg.norm(v)}


def predict(docs: DataFrame, prototypes: dict[str, np.ndarray], dimensions: int = DIMENSIONS) -> DataFrame:
    """(doc_id, lang_pred, score) for every row of ``docs`` (doc_id, text), from the text alone.

    The best cosine names the language (the first by name of equals) and is the score, from 0 to 1. A null text, one without
    letters, or no prototypes: ``und`` with score 0. Whole texts; repeated rows and null ids stay; other columns are ignored.
    """
    names = sorted(prototypes)
    matrix = np.array([prototypes[x] for x in names]).reshape(len(names), dimensions)

    def one(space: Space, text: str | None) -> tuple[str, float]:
        found, n = grams(text)
        if not len(found) or not names:
            return UNKNOWN, 0.0
        v = space.bundle(found, n)
        norm = np.linalg.norm(v)
        cosines = (matrix @ v / norm if norm else np.zeros(len(names))).round(9)
        best = int(cosines.argmax())
        return names[best], float(min(1.0, max(0.0, cosines[best])))

    def over(batches):
        space = Space(dimensions)
        for batch in batches:
            found = [one(space, x.as_py()) for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())], names=["doc_id", "lang_pred", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(tidied(over), "doc_id long, lang_pred string, score double")
