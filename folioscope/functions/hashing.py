"""Content hashes."""

from __future__ import annotations

import hashlib

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def sha256_hex(text: Column) -> Column:
    """The built-in dedup key: stays in generated code."""
    return F.sha2(F.encode(text, "UTF-8"), 256)


@F.pandas_udf(T.BinaryType())
def blake2b_256(content: pd.Series) -> pd.Series:
    """BLAKE2b of 32 bytes of a binary column, where hashes must equal those of existing collections."""
    return content.map(lambda v: hashlib.blake2b(bytes(v), digest_size=32).digest(), na_action="ignore")


def crc32(text: Column) -> Column:
    return F.crc32(F.encode(text, "UTF-8"))
