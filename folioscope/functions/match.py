"""The word-prefix rule of the search, as a plain Column: no Python at run time, so it stays in generated code and below joins."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from folioscope.functions.text import byte_view, normalise


#: Stands between the items of an array; a code point that is no character, so no text should hold it.
JOINT = "\ufdd0"


def joined(items: Column) -> Column:
    """A string array's items, each normalised and in lower case, in one string with JOINT between them. Generated code, unlike a loop over the array."""
    ends = F.regexp_replace(F.array_join(items, JOINT), rf"[\x00-\x20]*+{JOINT}[\x00-\x20]*+", JOINT)
    return F.lower(normalise(ends))


def clamp(coef: float) -> float:
    """1 and more, and negative values, mean 0.99; 0 is allowed."""
    return 0.99 if coef >= 1 or coef < 0 else float(coef)


def normalise_needle(needle: str, author: bool = False) -> str:
    """A needle as sources are normalised: lower case, trimmed of 0 to 32, single spaces; for authors no space after a full stop."""
    x = needle.lower().strip("".join(map(chr, range(33))))
    while "  " in x:
        x = x.replace("  ", " ")
    return x.replace(". ", ".") if author else x


@dataclass(frozen=True)
class Rule:
    """A needle's constants: its bytes that must match, all its bytes, and the bytes at the source's end where no word may begin."""

    prefix: bytes
    size: int
    tail: int

    @classmethod
    def of(cls, needle: str, coef: float) -> Rule | None:
        """None for a needle that matches nothing. Weights add up in float64, a byte at a time, as scores are defined."""
        octets, coef = needle.encode("utf-8"), clamp(coef)
        n = len(octets)
        if not n:
            return None
        weight, k = 0.0, 0
        while k < n:
            weight, k = weight + 1.0 / n, k + 1
            if weight >= coef:
                return cls(octets[:k], n, int(n * (1 - coef)))
        return None  # the sum of all falls short of the coefficient by rounding

    def _pattern(self, start: str, byte: str) -> str:
        """Java's pattern of a word's begin: the needle's size from ``start`` on, the prefix there or behind a space, and more than ``tail`` bytes from that place."""
        t, n = "".join(f"\\x{b:02x}" for b in self.prefix), len(self.prefix)
        return f"(?s){start}(?={byte}{{{self.size}}})(?:{t}{byte}{{{max(0, self.tail + 1 - n)}}}|{byte}+ {t}{byte}{{{max(0, self.tail - n)}}})"

    def column(self, source: Column) -> Column:
        """True where a word of ``source`` (normalised, lower case) begins with the prefix, far enough from the end. Null: false. The source stands in it once."""
        return F.coalesce(F.regexp_like(byte_view(source), F.lit(self._pattern("^", "."))), F.lit(False))

    def any_of(self, sources: Column) -> Column:
        """The same for a string array's items, joined by JOINT (normalised, lower case). Null and empty arrays: false."""
        octets = F.replace(byte_view(sources), F.lit(JOINT.encode().decode("iso-8859-1")), F.lit("\xff"))  # a byte that UTF-8 never has
        return F.coalesce(F.regexp_like(octets, F.lit(self._pattern("(?:^|\\xff)", "[^\\xff]"))), F.lit(False))

    def sql(self, source: str) -> str:
        """The same for DuckDB, where the prefix is whole characters."""
        t = "'" + self.prefix.decode("utf-8").replace("'", "''") + "'"
        size = f"octet_length(encode({source}))"
        place = f"strpos(substring({source}, 2), concat(' ', {t}))"
        octets = f"octet_length(encode(substring({source}, 1, CAST({place} AS BIGINT))))"
        return f"({size} >= {self.size} AND ((starts_with({source}, {t}) AND {size} > {self.tail}) OR ({place} > 0 AND {octets} < {size} - {self.tail})))"


def prefix_match(source: Column, needle: str, coef: float, author: bool = False) -> Column:
    """The rule for a raw needle against a source that is normalised and lower-cased already."""
    rule = Rule.of(normalise_needle(needle, author), coef)
    return F.lit(False) if rule is None else rule.column(source)
