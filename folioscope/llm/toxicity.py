"""Toxicity by non-negative positive-unlabelled learning."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscope.llm.common import hand_back, hash_below, tidied

WORD = re.compile(r"\w+")
HASHES = 1 << 18
PREFIXES = (3, 4, 5, 6)
CACHE_WORDS = 60_000


def word_features(word: str) -> list[int]:
    """Hashed features of a lower-case word: the word, and its beginnings (many abusive words share a stem)."""
    octets = [b"w" + word.encode("utf-8", "surrogatepass")]
    octets += [b"p" + word[:n].encode("utf-8", "surrogatepass") for n in PREFIXES if len(word) >= n]
    return [zlib.crc32(x) % HASHES for x in octets]


class Features:
    """Distinct features of texts; the features of words met before are kept, in a bounded table. ``kept``: features that count, all if None."""

    def __init__(self, kept: np.ndarray | None = None):
        self.kept = None if kept is None else set(kept.tolist())
        self.known: dict[str, frozenset[int]] = {}

    def of(self, text: str | None) -> set[int]:
        out: set[int] = set()
        if len(self.known) > CACHE_WORDS:
            self.known = {}
        known = self.known
        for w in set(WORD.findall((text or "").lower())):
            f = known.get(w)
            if f is None:
                f = frozenset(word_features(w))
                f = known[w] = f if self.kept is None else f & self.kept
            if f:
                out |= f
        return out


@dataclass
class Classifier:
    """Linear scorer on the presence of ``ids`` (sorted features); the score is a logistic of bias and weights."""

    ids: np.ndarray
    weights: np.ndarray
    bias: float

    def score(self, features: Features, text: str | None) -> float:
        found = features.of(text)
        z = self.bias + (self.weights[np.searchsorted(self.ids, sorted(found))].sum() if found else 0.0)
        return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))


def train_nnpu(pos: list[np.ndarray], unl: list[np.ndarray], prior: float, lift: float = 4.0, least: int = 5, steps: int = 600, rate: float = 0.1, decay: float = 1e-6) -> Classifier:
    """Fits the non-negative positive-unlabelled risk with a sigmoid loss by Adam, in numpy.

    Risk: prior * E_pos[l(z)] + max(0, E_unl[l(-z)] - prior * E_pos[l(-z)]); while the second part is negative the step goes
    up its gradient instead. Features that at least ``least`` confirmed documents have, ``lift`` times as often as unlabelled
    ones, take part, with weights of 0 or more: rarer or even ones can't tell the two apart. Without positives, or with prior 0, all scores are low.
    """
    n_pos, n_unl = len(pos), len(unl)
    if not n_pos or not n_unl or prior <= 0:
        return Classifier(np.empty(0, np.int64), np.empty(0), -5.0)
    cp, cu = np.zeros(HASHES, np.int64), np.zeros(HASHES, np.int64)
    for rows, into in ((pos, cp), (unl, cu)):
        for r in rows:  # each feature once a document
            into[r] += 1
    ids = np.flatnonzero((cp >= least) & (cp / n_pos >= lift * (cu + 0.5) / n_unl))

    def table(rows):
        kept = np.full(HASHES, -1, np.int64)
        kept[ids] = np.arange(len(ids))
        at = [x[x >= 0] for x in (kept[r] for r in rows)]
        return np.concatenate(at) if at else np.empty(0, np.int64), np.repeat(np.arange(len(rows)), list(map(len, at)))

    held = (*table(pos), n_pos), (*table(unl), n_unl)
    w, b = np.zeros(len(ids)), -1.0
    m, v = np.zeros(len(ids) + 1), np.zeros(len(ids) + 1)
    for step in range(1, steps + 1):
        g = direction(w, b, *held, prior)[1]
        g[:-1] += decay * w
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        move = rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        w, b = np.maximum(0, w - move[:-1]), b - move[-1]
    return Classifier(ids, w, float(b))


def direction(w: np.ndarray, b: float, pos, unl, prior: float) -> tuple[float, np.ndarray]:
    """The risk's second part E_unl[l(-z)] - prior * E_pos[l(-z)], and what to step against: the gradient of the whole risk, or, while that part is negative, the part's own turned round.

    ``pos`` and ``unl``: features and rows of the presences, and the number of rows. l(z) = 1 - s(z) and l(-z) = s(z), with the sigmoid s.
    """
    (fp, rp, n_pos), (fu, ru, n_unl) = pos, unl
    sp, su = (1 / (1 + np.exp(-np.clip(b + np.bincount(r, w[f], n), -30, 30))) for f, r, n in (pos, unl))
    dp, du = sp * (1 - sp), su * (1 - su)
    rest = su.mean() - prior * sp.mean()

    def gradient(gp: np.ndarray, gu: np.ndarray) -> np.ndarray:
        return np.append(np.bincount(fp, gp[rp], len(w)) + np.bincount(fu, gu[ru], len(w)), gp.sum() + gu.sum())

    if rest >= 0:
        return rest, gradient(-2 * prior * dp / n_pos, du / n_unl)
    return rest, -gradient(-prior * dp / n_pos, du / n_unl)


def _gathered(rows: DataFrame) -> list[np.ndarray]:
    """Feature ids of a bounded sample's texts, in order of doc_id; four bytes each on their way and on the driver."""

    def over(batches):
        features = Features()
        for batch in batches:
            found = [np.array(sorted(features.of(x.as_py())), np.int32).tobytes() for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.binary())], names=["doc_id", "f"])

    table = rows.select("doc_id", "text").mapInArrow(tidied(over), "doc_id long, f binary").toArrow().combine_chunks()
    ids, held = table.column("doc_id"), table.column("f")
    octets = [memoryview(x.as_buffer()) for x in held]
    order = sorted(range(len(octets)), key=lambda k: (ids[k].as_py() is None, ids[k].as_py() or 0, bytes(octets[k][:64])))
    return [np.frombuffer(octets[k], np.int32) for k in order]


def learn(docs: DataFrame, labels: DataFrame, max_positive: int = 3000, max_unlabelled: int = 7000) -> Classifier:
    """A classifier from ``labels`` (doc_id, toxic) with toxic = 1 as confirmed examples, and texts of any label, which isn't looked at, as unlabelled ones.

    Both samples are of labelled documents and bounded by the parameters (about; they are chosen by a hash of doc_id, and a
    repeated id gives one text, its first by order), as the driver holds their features. The class prior is the share of toxic
    rows among the labelled ones, of which the unlabelled sample is drawn. Rows of null ids, labels or texts teach nothing.
    """
    known = labels.where("doc_id is not null and toxic is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").alias("toxic"))
    n_pos, n_known = known.agg(F.sum(F.when(F.col("toxic") == 1, 1).otherwise(0)), F.count("*")).first()
    if not n_pos:
        return train_nnpu([], [], 0.0)
    texts = docs.where("text is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))

    def sample(ids: DataFrame, rate: float) -> list[np.ndarray]:
        chosen = ids.where(hash_below("doc_id", rate)).select("doc_id")
        return _gathered(texts.join(F.broadcast(chosen), "doc_id", "left_semi").groupBy("doc_id").agg(F.min("text").alias("text")))  # bounded by the rate

    pos = sample(known.where("toxic = 1"), max_positive / n_pos)
    model = train_nnpu(pos, sample(known, max_unlabelled / n_known), float(n_pos) / float(n_known))
    del pos
    hand_back()
    return model


def scorer(model: Classifier):
    """A column function from texts to scores."""

    @F.arrow_udf("double")
    def score(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        def over(every):
            features = Features(model.ids)
            for texts in every:
                yield pa.array((model.score(features, x.as_py()) for x in texts), pa.float64())

        yield from tidied(over)(batches)

    return score


def predict(docs: DataFrame, model: Classifier) -> DataFrame:
    """(doc_id, score, predicted) for every row of ``docs`` (doc_id, text), from the text alone.

    Whole texts. A null, empty or wordless text gets the score of no features, which is low. Repeated rows and null ids stay;
    other columns are ignored. ``predicted`` is 1 from a score of 0.5.
    """

    def over(batches):
        features = Features(model.ids)
        for batch in batches:
            scores = [model.score(features, x.as_py()) for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64()), pa.array([int(s >= 0.5) for s in scores], pa.int32())], names=["doc_id", "score", "predicted"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(tidied(over), "doc_id long, score double, predicted int")
