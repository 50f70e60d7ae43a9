"""Token counts: batch encoding in Arrow functions that return lengths only."""

from __future__ import annotations

import re
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscope.llm.common import tidied, tokenizer_path

#: White space that every stage of the supported vocabularies drops, and so a boundary that no token crosses.
CUTS = re.compile(r"[ \t\r\n]+")
#: Signs that end a piece after a letter: no token holds both, so the piece's word and its signs count apart.
SIGNS = ".,;:!?*&%$#|"
#: Letters past this are not told apart from marks alike by every version of Unicode.
PLAIN_LETTERS = 0x530
PLAIN = {r"[\p{L}]+", r"[\p{N}]", r"[\p{N}]+", r"[^\s\p{L}\p{N}]+"}
BATCH_BYTES = 1 << 18
CACHE_PIECES = 200_000


@lru_cache(maxsize=4)
def _library(path: str):
    """Per worker: a function from texts to token counts, and whether white space may be cut away before it."""
    if path.endswith(".json"):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import json

        from tokenizers import Tokenizer

        own = Tokenizer.from_file(path)
        own.no_truncation()
        own.no_padding()
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        split = [x for x in [spec.get("pre_tokenizer") or {}, *(spec.get("pre_tokenizer") or {}).get("pretokenizers", [])] if x.get("type") == "Split"]
        # Removed + invert: only what the pattern matches is kept. Its choices must be runs of one class or start with an apostrophe:
        # then no match holds white space, or a letter before a sign other than the apostrophe.
        kinds = split[0]["pattern"].get("Regex", "?").split("|") if len(split) == 1 and split[0]["behavior"] == "Removed" and split[0]["invert"] else ["?"]
        drops = all(re.fullmatch("'[a-z]+", x) or x in PLAIN for x in kinds)
        marked = any(re.search(r"\s", t["content"]) or t["content"][-1:] in SIGNS or t["lstrip"] or t["rstrip"] or t["single_word"] for t in spec.get("added_tokens", []))
        drops &= not marked
        return (lambda texts: [len(e) for e in own.encode_batch_fast(texts, add_special_tokens=False)]), drops
    import sentencepiece

    own = sentencepiece.SentencePieceProcessor(model_file=path)
    return (lambda texts: [len(ids) for ids in own.encode(texts, add_bos=False, add_eos=False, num_threads=1)]), False


def _ends_in_letter(stem: str) -> bool:
    """Whether a stem's last code point is a letter, to any library, and stays one letter in lower case (unlike U+0130, which ends in a mark then)."""
    last = stem[-1:].lower()
    return len(last) == 1 and last.isalpha() and ord(last) < PLAIN_LETTERS and ord(stem[-1]) < PLAIN_LETTERS


def balanced(texts: list[str], most: int = BATCH_BYTES):
    """Runs of ``texts`` of about ``most`` UTF-8 bytes each, order kept; a text larger than that is a run of its own."""
    run, size = [], 0
    for x in texts:
        n = len(x.encode("utf-8", "surrogatepass"))
        if run and size + n > most:
            yield run
            run, size = [], 0
        run.append(x)
        size += n
    if run:
        yield run


class Counts:
    """Counts of whole texts. Where the vocabulary drops white space, a text is split there, and each distinct piece is encoded once per batch (known ones not again)."""

    def __init__(self, path: str):
        self.encode, self.splits = _library(path)
        self.known: dict[str, int] = {}
        self.older: dict[str, int] = {}

    def _learn(self, pieces: list[str]) -> None:
        for run in balanced(pieces):
            self.known.update(zip(run, self.encode(run), strict=True))

    def of(self, texts: list[str]) -> list[int]:
        if not self.splits:
            return [n for run in balanced(texts) for n in self.encode(run)]
        cut = [CUTS.split(x) for x in texts]
        if len(self.known) > CACHE_PIECES:
            self.known, self.older = {}, self.known
        known, older = self.known, self.older
        fresh = [x for x in (set().union(*cut) if cut else ()) if x not in known]
        old = [x for x in fresh if x in older]
        known.update(zip(old, map(older.__getitem__, old), strict=True))
        stems = [(x, y) for x in fresh if x not in known and (y := x.rstrip(SIGNS)) != x and _ends_in_letter(y)]
        new = {p for x, y in stems for p in (y, x[len(y) :])} | set(fresh).difference(old, [x for x, _ in stems])
        self._learn([x for x in new if x not in known])
        known.update([(x, known[y] + known[x[len(y) :]]) for x, y in stems])
        at = known.__getitem__
        return [sum(map(at, pieces)) for pieces in cut]


def token_counts(docs: DataFrame, path: str | None = None, limit: int = 2048, window_bytes: int = 1 << 22) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) for every row of ``docs`` (doc_id, text), by the vocabulary file at ``path``.

    Whole texts, without begin, end or added special tokens; strings of special tokens inside a text are taken as the library
    does by default; no truncation, no padding. Null and empty texts: 0 bytes, 0 tokens. Repeated rows and null ids stay.
    Other columns are ignored. Texts pass in windows of about ``window_bytes``, so memory doesn't grow with the batch.
    """
    path = path or tokenizer_path("word_bpe_49k.json")

    def over(batches):
        counts = Counts(path)
        for batch in batches:
            column, n_bytes, n_tokens, window, size = batch.column(1), [], [], [], 0
            for x in column:
                text = x.as_py() or ""
                n_bytes.append(len(text.encode("utf-8", "surrogatepass")))
                window.append(text)
                size += n_bytes[-1]
                if size >= window_bytes:
                    n_tokens += counts.of(window)
                    window, size = [], 0
            n_tokens += counts.of(window)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n_bytes, pa.int64()), pa.array(n_tokens, pa.int64()), pa.array([n > limit for n in n_tokens], pa.bool_())],
                names=["doc_id", "n_bytes", "n_tokens", "over_limit"],
            )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(tidied(over), "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
