"""SentencePiece encoding and decoding for merge-type vocabularies, by a score-ordered agenda of adjacent symbol pairs."""

from __future__ import annotations

import codecs
import hashlib
import heapq
import re
import struct
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscope.llm.common import tidied, tokenizer_path

SPACE = "▁"
# Fixed values of the public model format: kinds of piece, kind of model.
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
BPE = 2
#: Name of the error handler that gives a replacement character for every byte that is no part of a character, as the library does.
EACH_BYTE = "folioscope-each-byte"
codecs.register_error(EACH_BYTE, lambda e: ("\ufffd", e.start + 1))
CACHE_CHUNKS = 150_000
#: Chunks up to this many characters share one agenda, a row each; a longer one has a heap of its own.
ROW_CHARS = 24
_NONE, _PAD, _CHAR = -1, -2, -3


def _varint(b: bytes, i: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        octet = b[i]
        i += 1
        value |= (octet & 127) << shift
        shift += 7
        if octet < 128:
            return value, i


def _fields(b: bytes):
    """(number, value) of a protocol-buffer message; nested messages stay bytes."""
    i = 0
    while i < len(b):
        key, i = _varint(b, i)
        kind = key & 7
        if kind == 0:
            value, i = _varint(b, i)
        elif kind == 2:
            size, i = _varint(b, i)
            value, i = b[i : i + size], i + size
        else:
            size = 4 if kind == 5 else 8
            value, i = b[i : i + size], i + size
        yield key >> 3, value


class Model:
    """A merge-type vocabulary with identity normalisation, read from its file."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            raw = f.read()
        pieces, trainer, norm = [], {}, {}
        for number, value in _fields(raw):
            if number == 1:
                x = dict(_fields(value))
                pieces.append((x[1].decode("utf-8"), struct.unpack("<f", x[2])[0] if 2 in x else 0.0, x.get(3, NORMAL)))
            elif number == 2:
                trainer = dict(_fields(value))
            elif number == 3:
                norm = dict(_fields(value))
        if trainer.get(3, 1) != BPE or norm.get(2) or norm.get(4, 1) or not norm.get(5, 1) or trainer.get(24, 0):
            raise ValueError("only merge-type vocabularies with identity normalisation and kept white space are supported")
        if any(kind in (USER, UNUSED) for *_, kind in pieces):
            raise ValueError("user-defined and unused pieces aren't supported")
        self.pieces = pieces
        self.prefix = bool(norm.get(3, 1))
        self.score = {p: s for p, s, kind in pieces if kind == NORMAL}
        self.id = {p: i for i, (p, _, kind) in enumerate(pieces) if kind == NORMAL}
        self.byte = {int(p[3:5], 16): i for i, (p, _, kind) in enumerate(pieces) if kind == BYTE}
        self.unknown = next(i for i, (*_, kind) in enumerate(pieces) if kind == UNKNOWN)
        self.fallback = bool(trainer.get(35, 0)) and len(self.byte) == 256
        self.unknown_surface = trainer.get(44, b" \xe2\x81\x87 ").decode("utf-8")
        # Where no piece holds a space mark after another character, or a line end beside one, no merge crosses such a place.
        self.splits = not any(SPACE in p.lstrip(SPACE) or "\n" in p[1:] + p[:-1] for p in self.score)
        self.chunks = re.compile(f"{SPACE}+[^{SPACE}\n]*|\n+|[^{SPACE}\n]+")
        # Where no piece joins a letter and another character but for marks in front, a chunk's words and signs are merged apart.
        fine = rf"{SPACE}+(?:[^\W\d_]+|(?:[^\w{SPACE}\n]|[\d_])+)?|[^\W\d_]+|(?:[^\w{SPACE}\n]|[\d_])+|\n+"
        self.parts = re.compile(fine) if self.splits and all(len(re.findall(fine, p)) == 1 for p in self.score) else None
        self.surfaces = [self.surface([i]) for i in range(len(pieces))]
        pairs = {self.id[p[:k]] * len(pieces) + self.id[p[k:]]: i for p, i in self.id.items() for k in range(1, len(p)) if p[:k] in self.id and p[k:] in self.id}
        self.pair_keys = np.array(sorted(pairs), np.int64)
        self.pair_ids = np.array([pairs[k] for k in self.pair_keys.tolist()] + [_NONE], np.int32)
        self.scores = np.array([s for _, s, _ in pieces] + [-np.inf], np.float32)  # the last is that of _NONE
        self.char_ids = _CHAR - np.arange(0x110000, dtype=np.int32)
        for p, i in self.id.items():
            if len(p) == 1:
                self.char_ids[ord(p)] = i

    def _pair(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Id of the piece that two symbols make, or _NONE."""
        keys = left.astype(np.int64) * len(self.pieces) + right
        at = np.searchsorted(self.pair_keys, keys)
        at[at == len(self.pair_keys)] = 0
        return np.where((left >= 0) & (right >= 0) & (self.pair_keys[at] == keys), self.pair_ids[at], _NONE)

    def merge_all(self, texts: list[str]) -> list[list[int]]:
        """``merge`` of many texts. Short ones are rows of one agenda: each round takes every row's best pair, the leftmost of equals."""
        out: list[list[int] | None] = [None] * len(texts)
        by_size: dict[int, list[int]] = {}
        for k, x in enumerate(texts):
            if len(x) <= ROW_CHARS and self.fallback:
                by_size.setdefault(max(4, -(-len(x) // 4) * 4), []).append(k)
            else:
                out[k] = self.merge(x)
        for size, every in by_size.items():
            for a in range(0, len(every), 8192):
                own = every[a : a + 8192]
                for k, ids in zip(own, self._merge_rows([texts[k] for k in own], size), strict=True):
                    out[k] = ids
        return out

    def _merge_rows(self, texts: list[str], size: int) -> list[list[int]]:
        joined = "".join([x.ljust(size, "\0") for x in texts]).encode("utf-32-le", "surrogatepass")
        symbols = self.char_ids[np.frombuffer(joined, np.uint32).reshape(-1, size)]
        symbols[np.arange(size) >= np.fromiter(map(len, texts), np.int64, len(texts))[:, None]] = _PAD
        done = np.empty_like(symbols)
        made = self._pair(symbols[:, :-1], symbols[:, 1:])
        score = self.scores[made]
        rows = np.arange(len(texts))
        column, pair_column = np.arange(size), np.arange(size - 1)
        while len(rows):
            best = score.argmax(axis=1)
            at = np.arange(len(rows))
            live = score[at, best] > -np.inf
            if not live.all():
                done[rows[~live]] = symbols[~live]
                rows, symbols, made, score, best = rows[live], symbols[live], made[live], score[live], best[live]
                at = np.arange(len(rows))
                if not len(rows):
                    break
            symbols[at, best] = made[at, best]
            take = np.minimum(column + (column > best[:, None]), size - 1)
            symbols = np.take_along_axis(symbols, take, 1)
            symbols[:, -1] = _PAD
            take = np.minimum(pair_column + (pair_column > best[:, None]), size - 2)
            made = np.take_along_axis(made, take, 1)
            made[:, -1] = _NONE
            made[at, np.minimum(best, size - 2)] = self._pair(symbols[at, best], symbols[at, np.minimum(best + 1, size - 1)])
            left = np.maximum(best - 1, 0)
            made[at, left] = np.where(best > 0, self._pair(symbols[at, left], symbols[at, best]), made[at, left])
            score = self.scores[made]
        kept = done != _PAD
        ends, flat = kept.sum(axis=1).cumsum().tolist(), done[kept].tolist()
        out = [flat[a:b] for a, b in zip([0, *ends], ends, strict=False)]
        for k in np.flatnonzero((done <= _CHAR).any(axis=1)).tolist():
            out[k] = [i for x in out[k] for i in ([x] if x >= 0 else [self.byte[o] for o in chr(_CHAR - x).encode("utf-8", "surrogatepass")])]
        return out

    def merge(self, text: str) -> list[int]:
        """Ids of an escaped text. The agenda holds adjacent pairs whose union is a piece, best score first, then leftmost."""
        score = self.score
        n = len(text)
        symbol: list[str | None] = list(text)
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        agenda = []
        for i in range(n - 1):
            s = score.get(text[i : i + 2])
            if s is not None:
                agenda.append((-s, i, i + 1, 2))
        heapq.heapify(agenda)
        push, pop = heapq.heappush, heapq.heappop
        while agenda:
            _, i, j, size = pop(agenda)
            a, b = symbol[i], symbol[j]
            if a is None or b is None or len(a) + len(b) != size or after[i] != j:
                continue  # one of the two has been merged since
            a = symbol[i] = a + b
            symbol[j] = None
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                x = a + symbol[k]
                s = score.get(x)
                if s is not None:
                    push(agenda, (-s, i, k, len(x)))
            k = before[i]
            if k >= 0:
                x = symbol[k] + a
                s = score.get(x)
                if s is not None:
                    push(agenda, (-s, k, i, len(x)))
        out, known = [], self.id
        for x in symbol:
            if x is not None:
                i = known.get(x)
                if i is not None:
                    out.append(i)
                elif self.fallback:
                    out += [self.byte[o] for o in x.encode("utf-8", "surrogatepass")]
                elif not out or out[-1] != self.unknown:
                    out.append(self.unknown)
        return out

    def escape(self, text: str) -> str:
        """Spaces as marks, with one in front where the model asks for it; the empty text stays empty."""
        text = text.replace(" ", SPACE)
        return SPACE + text if text and self.prefix else text

    def encode(self, text: str | None) -> list[int]:
        escaped = self.escape(text or "")
        return [i for x in self.split(escaped) for i in self.merge(x)]

    def split(self, escaped: str) -> list[str]:
        return self.chunks.findall(escaped) if self.splits and self.fallback else [escaped] * bool(escaped)

    def surface(self, ids: list[int], first: bool = False) -> bytes:
        """Bytes of a run of ids. ``first``: the run begins a text, and the mark that encoding put there goes."""
        out = bytearray()
        for k, i in enumerate(ids):
            piece, _, kind = self.pieces[i]
            if kind == BYTE:
                out.append(int(piece[3:5], 16))
            elif kind == UNKNOWN:
                out += self.unknown_surface.encode("utf-8")
            elif kind != CONTROL:
                if first and k == 0 and self.prefix and piece.startswith(SPACE):
                    piece = piece[1:]
                out += piece.replace(SPACE, " ").encode("utf-8")
        return bytes(out)

    def decode(self, ids: list[int]) -> str:
        lead = 0
        while lead < len(ids) and self.pieces[ids[lead]][2] == CONTROL:
            lead += 1
        return self.surface(ids[lead:], first=True).decode("utf-8", EACH_BYTE)


@lru_cache(maxsize=2)
def model(path: str) -> Model:
    return Model(path)


@lru_cache(maxsize=2)
def _library(path: str):
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=path)


class Cache:
    """Encoded chunks of one worker: (ids joined by commas, their number, surface). New chunks of a batch are merged by the agenda and checked against the library."""

    def __init__(self, path: str, check: bool, most: int = CACHE_CHUNKS):
        self.most = most
        self.model, self.check = model(path), _library(path) if check else None
        self.names = list(map(str, range(len(self.model.pieces))))
        self.known: dict[str, tuple] = {}
        self.older: dict[str, tuple] = {}
        self.differ: set[str] = set()

    def learn(self, chunks: set[str]) -> None:
        if len(self.known) > self.most:
            self.known, self.older = {}, self.known
            self.differ &= self.older.keys()
        known, older, parts = self.known, self.older, self.model.parts
        fresh = [x for x in chunks if x not in known]
        old = [x for x in fresh if x in older]
        known.update(zip(old, map(older.__getitem__, old), strict=True))
        if parts is None:
            self._merge([x for x in fresh if x not in known])
            return
        split = [(x, parts.findall(x)) for x in fresh if x not in known]
        self._merge(list({p for _, ps in split for p in ps if p not in known}))
        for x, ps in split:
            if len(ps) > 1:
                found = [known[p] for p in ps]
                known[x] = (",".join([f[0] for f in found]), sum([f[1] for f in found]), b"".join([f[2] for f in found]))
                if self.differ and not self.differ.isdisjoint(ps):
                    self.differ.add(x)

    def _merge(self, new: list[str]) -> None:
        merged, names, surfaces = self.model.merge_all(new), self.names.__getitem__, self.model.surfaces.__getitem__
        self.known.update((x, (",".join(map(names, ids)), len(ids), b"".join(map(surfaces, ids)))) for x, ids in zip(new, merged, strict=True))
        if self.check is not None and self.model.prefix:
            # The library puts the first mark back. A chunk without one is put behind a line end, where nothing merges.
            # A mark alone is what the library makes of no text; it has none to check.
            plain = [x[1:].replace(SPACE, " ") if x[0] == SPACE else "\n" + x for x in new]
            theirs = self.check.encode(plain, add_bos=False, add_eos=False, num_threads=1)
            for x, ids, own in zip(new, theirs, merged, strict=True):
                if ids != own and (ids[2:] != own if x[0] != SPACE else x != SPACE):
                    self.differ.add(x)


def encode_decode(docs: DataFrame, path: str | None = None, check: bool = True, keep_text: bool = False, window_chars: int = 1 << 21, cache_chunks: int = CACHE_CHUNKS) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256, matches_library) for every row of ``docs`` (doc_id, text).

    ``keep_text`` adds ``ids`` (array of int) and ``decoded``. Ids are those of the library for the vocabulary file at
    ``path``, without begin or end ids, no sampling. A text is split where no merge can cross (before a run of space marks,
    if no piece holds a mark elsewhere than in front), and each distinct chunk of a worker runs through the agenda once.
    ``check``: the library encodes the new chunks of each Arrow batch too, and ``matches_library`` is false for a text with a
    chunk that differs; with ``check`` off it is null. Null and empty texts: no ids, empty decoded text. Whole texts of any
    length; repeated rows and null ids stay; other columns are ignored. Memory holds one window of texts and
    up to twice ``cache_chunks`` chunks.
    """
    path = path or tokenizer_path("piece_bpe_32k.model")

    def results(cache: Cache, texts: list[str]):
        own = cache.model
        split = [own.split(own.escape(x)) for x in texts]
        cache.learn(set().union(*split) if split else set())
        at, differ = cache.known.__getitem__, cache.differ
        for chunks in split:
            found = list(map(at, chunks))
            ids = ",".join([x[0] for x in found])
            surface = b"".join([x[2] for x in found])
            if own.prefix and surface[:1] == b" " and chunks[0][0] == SPACE:
                surface = surface[1:]
            ok = (not differ or differ.isdisjoint(chunks)) if check else None
            yield ids, sum([x[1] for x in found]), surface.decode("utf-8", EACH_BYTE), ok

    def over(batches):
        cache = Cache(path, check, cache_chunks)
        for batch in batches:
            rows, window, size = [], [], 0
            for x in batch.column(1):
                window.append(x.as_py() or "")
                size += len(window[-1])
                if size >= window_chars:
                    rows += digest(results(cache, window))
                    window, size = [], 0
            rows += digest(results(cache, window))
            kinds = [pa.int64(), pa.string(), pa.string(), pa.bool_(), *[pa.list_(pa.int32()), pa.string()] * keep_text]
            columns = list(zip(*rows, strict=True)) or [[]] * len(kinds)
            yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, columns, kinds)], names=names)

    def digest(found):
        sha = lambda s: hashlib.sha256(s.encode("utf-8")).hexdigest()
        return [(n, sha(ids), sha(text), ok, *([[int(i) for i in ids.split(",") if i], text] if keep_text else [])) for ids, n, text, ok in found]

    names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "matches_library", *["ids", "decoded"] * keep_text]
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, matches_library boolean" + ", ids array<int>, decoded string" * keep_text
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(tidied(over), schema)
