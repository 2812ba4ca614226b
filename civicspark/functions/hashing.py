"""Deterministic hashing for sampling: md5 of salt and key, which any SQL engine can repeat."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

HASH_SPACE = 2147483648


def key_hash(key: Column | str, salt: int = 0) -> Column:
    """A value in [0, 2**31) from a key of any type (as text; NULL counts as empty) and a scenario salt.

    Salts give independent values.
    """
    k = F.col(key) if isinstance(key, str) else key
    text = F.concat(F.lit(f"{salt}:"), F.coalesce(k.cast("string"), F.lit("")))
    return F.shiftright(F.conv(F.substring(F.md5(text.cast("binary")), 1, 8), 16, 10).cast("bigint"), 1)


def key_hash_sql(key: str, salt: int = 0) -> str:
    """The same value as SQL text."""
    return f"(CAST('0x' || substr(md5('{salt}:' || coalesce(CAST({key} AS VARCHAR), '')), 1, 8) AS BIGINT) >> 1)"


def hash_bucket(hashed: Column, buckets: int | Column) -> Column:
    """Equal slices of the hash space, in hash order."""
    return F.floor(hashed * (F.lit(buckets) if isinstance(buckets, int) else buckets) / F.lit(HASH_SPACE)).cast("int")
