"""Spelling variants of a corpus's words, by a rare-first prefix filter over positional bigrams."""

from __future__ import annotations

import string
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscope.llm.common import cut, cut_small, ensure_checkpoint_dir, tidied

RUN = "[A-Za-zÀ-ÿ]+"
LEAST_LETTERS = 6
LEAST_TIMES = 5
#: One run in so many loses a letter.
EVERY = 199
#: How many times as frequent as a word its form has to be.
LIFT = 5
Q = 2
#: One edit touches at most Q bigrams of a word, so of this many at least one stays.
RAREST = Q + 1


def altered(doc_id: Column, run: Column, every: int = EVERY) -> Column:
    """A lower-cased run as it counts: with h, the crc32 of ``<doc_id>:<run>``, it loses its code point h % length where ``every`` divides h. A null id is the empty text."""
    h = F.crc32(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), run).cast("binary"))
    at = (h % F.length(run)).cast("int")
    return F.when(h % every == 0, F.concat(F.substr(run, F.lit(1), at), F.substr(run, at + 2))).otherwise(run)


def words(docs: DataFrame, least_letters: int = LEAST_LETTERS, least_times: int = LEAST_TIMES, every: int = EVERY) -> DataFrame:
    """(word, n): distinct runs of letters of all whole texts, A-Z lowered, altered by their document, with their occurrences. Column functions only; counts are combined before the shuffle."""
    upper, lower = string.ascii_uppercase, string.ascii_lowercase
    runs = docs.select(F.col("doc_id").alias("doc_id"), F.explode(F.regexp_extract_all(F.col("text").cast("string"), F.lit(RUN), F.lit(0))).alias("run")).where(F.length("run") >= least_letters)
    low = runs.select("doc_id", F.translate("run", upper, lower).alias("run"))
    counts = low.select(altered(F.col("doc_id"), F.col("run"), every).alias("word")).where(F.length("word") >= least_letters).groupBy("word").agg(F.count("*").alias("n"))
    return counts.where(F.col("n") >= least_times)


def ranks(found: DataFrame) -> dict[str, int]:
    """The place of each bigram in an order of all bigrams, rarest first. Its size is bounded by the alphabet: at most 90 letters, so 8,100 bigrams."""
    at = F.explode(F.sequence(F.lit(1), F.length("word") - Q + 1))
    counts = found.select("word", at.alias("i")).select(F.substr(F.col("word"), F.col("i"), F.lit(Q)).alias("gram")).groupBy("gram").count().collect()
    return {r["gram"]: k for k, r in enumerate(sorted(counts, key=lambda r: (r["count"], r["gram"])))}


def keys(word: str, rank: dict[str, int]) -> Iterator[tuple[int, str]]:
    """(role, key) of a word: two words that differ by one edit share a key in roles that meet (0 with 0; 1, the shorter, with 2, the longer).

    Of the three rarest positional bigrams one stays in both words, and, as the order of all bigrams is the same for both, it is
    among the three of each. The edit lies behind it or before it. So one side of the word, up to and with the bigram, is the same
    in both: that is the limit on positions, zero from the side's end. The edit is then in the first or the second half of the rest,
    so the other half is the same as well; both go into the key, with the length of the shorter word.
    """
    n = len(word)
    for i in sorted(range(n - Q + 1), key=lambda i: (rank[word[i : i + Q]], i))[:RAREST]:
        for side, same, u in (("<", i + Q, word), (">", n - i, word[::-1])):
            head = u[:same]
            for role, short in ((0, n), (1, n), (2, n - 1)):
                rest = short - same
                if rest < (role == 0):
                    continue
                half = rest // 2
                yield role, f"{side}{role > 0}{short}{u[: same + half]}"
                if half:
                    yield role, f"{side}{role > 0}{short}{head}|{u[n - (rest - half) :]}"


def near_pairs(found: DataFrame) -> DataFrame:
    """(word, n, other, other_n): every pair of words that differ by exactly one inserted, deleted or replaced code point, in both directions, each once.

    Only words that share a key meet; the pair is verified inside the join, whose large keys the planner can split.
    """
    place = ranks(found)

    def over(batches):
        for batch in batches:
            of, hashes, roles = [], [], []
            for k, w in enumerate(batch.column(0).to_pylist()):
                for role, key in set(keys(w, place)):
                    of.append(k)
                    roles.append(role)
                    hashes.append(xxhash.xxh64_intdigest(key.encode()) - (1 << 63))
            at = pa.array(of, pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(hashes, pa.int64()), pa.array(roles, pa.int8()), batch.column(0).take(at), batch.column(1).take(at)], names=["key", "role", "word", "n"])

    held = found.mapInArrow(tidied(over), "key long, role byte, word string, n long")
    a, b = (held.where(F.col("role").isin(*roles)).select("key", F.col("role").alias(f"role_{x}"), F.col("word").alias(x), F.col("n").alias(f"n_{x}")) for x, roles in (("a", (0, 1)), ("b", (0, 2))))
    meets = (F.col("role_b") == F.col("role_a") * 2) & ((F.col("role_a") == 1) | (F.col("a") < F.col("b"))) & (F.levenshtein("a", "b", 1) == 1)
    pairs = cut(a.join(b, (a["key"] == b["key"]) & meets).select("a", "n_a", "b", "n_b").distinct())
    return pairs.toDF("word", "n", "other", "other_n").union(pairs.select("b", "n_b", "a", "n_a"))


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) for ``forms`` (word, form): the end of the chain of forms. Chains are halved each round; as every form is more frequent than its word there is no loop."""
    at = cut_small(forms.select("word", F.col("form").alias("root")))
    while True:
        on = at.select(F.col("word").alias("root"), F.col("root").alias("next"))
        after = cut_small(at.join(on, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        moved = after.where("moved").limit(1).count()
        at = after.select("word", "root")
        if not moved:
            return at


def variants(docs: DataFrame, least_letters: int = LEAST_LETTERS, least_times: int = LEAST_TIMES, lift: int = LIFT, every: int = EVERY) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of every word of ``docs`` (doc_id, text): see ``words``.

    ``form`` is the near word of largest n (of equals the first by code points), if that n is ``lift`` times the word's or more,
    else null, as is ``form_n``; ``root`` is the last word reached by following forms, the word itself if it has none. Whole texts;
    null texts have no words; repeated rows count as often as they are there; other columns are ignored; an empty table gives none.
    """
    ensure_checkpoint_dir(docs.sparkSession)
    found = cut(words(docs, max(least_letters, RAREST + Q - 1), least_times, every))
    near = near_pairs(found)
    first = F.min(F.struct((-F.col("other_n")).alias("minus"), "other")).alias("first")
    best = near.groupBy("word").agg(F.min("n").alias("own"), F.count("*").alias("n_near"), first)
    fits = -F.col("first.minus") >= lift * F.col("own")
    best = cut(best.select("word", "n_near", F.when(fits, F.col("first.other")).alias("form"), F.when(fits, -F.col("first.minus")).alias("form_n")))
    ends = roots(best.where("form is not null"))
    out = found.join(best, "word", "left").join(ends, "word", "left")
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), "form_n")
